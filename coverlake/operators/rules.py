"""Ordered rule tables of any size: the first rule that holds for a row, or all that do.

A rule table is a DataFrame of conditions: ``rule`` (long; the least number comes first), ``clause`` (int), ``field`` (which text
of the row), ``kind`` and ``value``. A clause holds if any of its values is found in its field, and a rule if all its clauses
hold. Clause 0 is the one whose kind of match is told. Kinds, strongest first: ``exact``, ``prefix``, ``suffix``, ``part`` (anywhere)
and ``word`` (anywhere between characters that are no letters or digits). A null text holds nothing; an empty value is found
in any text but as a word. Case and accents are the caller's: values are as they are to be found, and texts of the fields named
in ``fold`` meet them in lower case and without accents.

Two ways with equal results. Tables of up to ``most_bytes`` (counted first) are broadcast and become one automaton for each
field, which reads a text once whatever the number of rules. Larger ones meet the texts in joins. Only distinct values meet distinct
texts there: a value of some length can only be where as many characters of the text are the same, so texts are cut to the
lengths that values have, and joined. What no text has is then taken out of the rules, those that are equal in the rest become
one class, and a class meets the texts that hold a value of its rarest clause. So rules that share their values, or values that
begin alike, cost no pairs.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from .stages import stored

KINDS = ("exact", "prefix", "suffix", "part", "word")
#: Characters by which a long value is found inside a text, before it is compared in whole.
ANCHOR = 32
#: Texts whose results a worker holds as Python objects at a time; of the texts themselves it holds one so.
SLICE = 256
SCHEMA = "rule long, clause int, field string, kind string, value string"
#: A rule file is an array of these, first rule first.
CLAUSE = "struct<field: string, exact: array<string>, prefix: array<string>, suffix: array<string>, part: array<string>, word: array<string>>"
FILE = f"array<struct<label: string, attributes: map<string, string>, clauses: array<{CLAUSE}>>>"


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """The rules of a JSON file: rule (its place), label, attributes, clauses."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", FILE)).alias("rule", "r")).select(F.col("rule").cast("long").alias("rule"), "r.*")


def conditions(rules: DataFrame) -> DataFrame:
    """The conditions of what read_rules() returns."""
    each = rules.select("rule", F.posexplode("clauses").alias("clause", "c"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"c.{k}").alias("values")) for k in KINDS])
    listed = each.select("rule", "clause", F.col("c.field").alias("field"), F.explode(kinds).alias("k"))
    return listed.select("rule", "clause", "field", "k.kind", F.explode("k.values").alias("value"))


def listed(rows: DataFrame, rule: Column, clauses: list[tuple[str, str, Column]]) -> DataFrame:
    """Conditions from rows: for each (field, kind, array of values) a clause; one whose array is null does not bind."""
    each = [
        F.struct(F.lit(k).alias("clause"), F.lit(field).alias("field"), F.lit(kind).alias("kind"), values.alias("values"))
        for k, (field, kind, values) in enumerate(clauses)
    ]
    made = rows.select(rule.cast("long").alias("rule"), F.explode(F.array(*each)).alias("c"))
    return made.select("rule", "c.clause", "c.field", "c.kind", F.explode("c.values").alias("value"))


@lru_cache(maxsize=1 << 16)
def inside_word(c: str) -> bool:
    return unicodedata.category(c)[0] in "LN"


class Matcher:
    """The rules that hold, by one automaton for each field."""

    def __init__(self, table: list[tuple[int, int, str, str, str]]):
        import ahocorasick

        need: dict[int, set[int]] = {}
        values: dict[str, dict[str, list[tuple[int, int, int]]]] = {}
        for rule, clause, field, kind, value in table:
            need.setdefault(rule, set()).add(clause)
            values.setdefault(field, {}).setdefault(value, []).append((rule, clause, KINDS.index(kind)))
        self.need = {rule: len(c) for rule, c in need.items()}
        self.empty = {field: own.pop("", []) for field, own in values.items()}
        self.automata = {}
        for field, own in values.items():
            if own:
                a = ahocorasick.Automaton()
                for value, entries in own.items():
                    a.add_word(value, (value, entries))
                a.make_automaton()
                self.automata[field] = a

    def found(self, field: str, text: str) -> Iterator[tuple[int, int, int, str]]:
        """(rule, clause, kind, value) of each condition on the field that the text meets."""
        for rule, clause, kind in self.empty.get(field, ()):
            if kind in (1, 2, 3) or kind == 0 and not text:
                yield rule, clause, kind, ""
        if field not in self.automata or not text:
            return
        n = len(text)
        for last, (value, entries) in self.automata[field].iter(text):
            end = last + 1
            first = end - len(value)
            edges = None
            for rule, clause, kind in entries:
                if kind == 4:
                    if edges is None:
                        edges = not (first and inside_word(text[first - 1])) and not (end < n and inside_word(text[end]))
                    ok = edges
                else:
                    ok = (kind in (2, 3) or first == 0) and (kind in (1, 3) or end == n)
                if ok:
                    yield rule, clause, kind, value

    def held(self, texts: dict[str, str | None]) -> list[tuple[int, int, int]]:
        """(rule, strongest kind, how many values of clause 0) of the rules that hold, in order."""
        clauses: dict[int, set[int]] = {}
        first: dict[int, set[tuple[int, str]]] = {}
        for field, text in texts.items():
            if text is not None:
                for rule, clause, kind, value in self.found(field, text):
                    clauses.setdefault(rule, set()).add(clause)
                    if clause == 0:
                        first.setdefault(rule, set()).add((kind, value))
        out = []
        for rule, own in clauses.items():
            if len(own) == self.need[rule]:
                kinds = first.get(rule, ())
                out.append((rule, min((k for k, _ in kinds), default=0), len({v for _, v in kinds})))
        return sorted(out)


_matchers: dict[int, Matcher] = {}


def matcher(table) -> Matcher:
    """One for each broadcast table and worker process."""
    if table.id not in _matchers:
        _matchers.clear()
        _matchers[table.id] = Matcher(table.value)
    return _matchers[table.id]


class Shared:
    """A broadcast table that knows its number on the workers too."""

    def __init__(self, broadcast):
        self.id, self.broadcast = broadcast._jbroadcast.id(), broadcast

    def __getstate__(self):
        return {"id": self.id, "broadcast": self.broadcast}

    @property
    def value(self):
        return self.broadcast.value


def by_automaton(rows: DataFrame, table: list[tuple], fields: dict[str, Column], first: bool, fold: tuple[str, ...] = ()) -> DataFrame:
    shared, names = Shared(rows.sparkSession.sparkContext.broadcast(table)), list(fields)
    kind = pa.list_(pa.struct([("rule", pa.int64()), ("kind", pa.int32()), ("n", pa.int32())]))
    each = [tx.fold if f in fold else str for f in names]

    # texts are folded here, not in a function before: so they go to one worker, and only what is found comes back
    @F.arrow_udf("array<struct<rule: bigint, kind: int, n: int>>")
    def held(texts: pa.Array) -> pa.Array:
        m, out = matcher(shared), []
        for at in range(0, len(texts), SLICE):
            found = []
            for row in zip(*texts.slice(at, SLICE).flatten()):
                own = m.held({f: None if (v := t.as_py()) is None else how(v) for f, how, t in zip(names, each, row)})
                found.append([{"rule": r, "kind": k, "n": n} for r, k, n in (own[:1] if first else own)])
            out.append(pa.array(found, kind))
        return pa.concat_arrays(out) if out else pa.array([], kind)

    return rows.withColumn("_held", held(F.struct(*[fields[f].cast("string").alias(f) for f in names])))


def cuts(values: DataFrame) -> Column:
    """All (kind, gram) of a text (columns field, text) that a value may be, by the lengths of a field's values; values: field, kind, size."""
    inner = lambda c: c.rlike(r"[\p{L}\p{N}]")
    text, size, none = F.col("text"), F.col("_size"), F.array().cast("array<struct<kind: string, gram: string>>")
    gram = lambda kind, i, n: F.struct(F.lit(kind).alias("kind"), text.substr(i, n).alias("gram"))
    own: dict[str, dict[str, list[int]]] = {}
    for r in values.distinct().collect():  # a row for each length that there is
        own.setdefault(r["field"], {}).setdefault(r["kind"], []).append(r["size"])
    out = none
    for field, kinds in own.items():
        every = []
        for kind, sizes in sorted(kinds.items()):
            listed = F.array(*[F.lit(n) for n in sorted(sizes)])
            fit = F.filter(listed, lambda n: n <= size)
            if kind == "exact":
                every.append(F.array(gram(kind, F.lit(1), size)))
            elif kind == "prefix":
                every.append(F.transform(fit, lambda n: gram("prefix", F.lit(1), n)))
            elif kind == "suffix":
                every.append(F.transform(fit, lambda n: gram("suffix", size - n + 1, n)))
            else:
                places = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array(F.lit(1)))
                if kind == "word":
                    places = F.filter(places, lambda i: (i == 1) | ~inner(text.substr(i - 1, F.lit(1))))
                    # a long value is compared in whole, with its end
                    ends = lambda i, n: (n >= ANCHOR) | (i + n > size) | ~inner(text.substr(i + n, F.lit(1)))
                    at = lambda i: F.filter(listed, lambda n: (i + n - 1 <= size) & ends(i, n))
                    every.append(F.flatten(F.transform(places, lambda i: F.transform(at(i), lambda n: gram("word", i, n)))))
                else:
                    at = lambda i: F.filter(listed, lambda n: (i + n - 1 <= size) & ((n > 0) | (i == 1)))
                    every.append(F.flatten(F.transform(places, lambda i: F.transform(at(i), lambda n: gram("part", i, n)))))
        out = F.when(F.col("field") == field, F.array_distinct(F.concat(none, *every))).otherwise(out)
    return out


def met_values(each: DataFrame, values: DataFrame) -> DataFrame:
    """(field, text, vid) of the values (vid, field, kind, value) that hold for texts; each: distinct field and text."""
    anywhere = F.col("kind").isin("part", "word")
    cut = values.filter("not (kind = 'word' and value = '')").withColumn(
        "gram", F.when(anywhere, F.substring("value", 1, ANCHOR)).otherwise(F.col("value"))
    )
    # of exact values one length says that there are some
    sizes = cut.select("field", "kind", F.when(F.col("kind") == "exact", 0).otherwise(F.length("gram")).alias("size"))
    grams = each.withColumn("_size", F.length("text")).select("field", "text", F.explode(cuts(sizes)).alias("g")).select("field", "text", "g.*")
    text, value = F.col("text"), F.col("value")
    edges = F.expr(r"text rlike concat('(?<![\\p{L}\\p{N}])\\Q', replace(value, '\\E', '\\E\\\\E\\Q'), '\\E(?![\\p{L}\\p{N}])')")
    short = ~F.col("kind").isin("part", "word") | (F.length("gram") < ANCHOR)
    holds = F.when(short, True).when(F.col("kind") == "part", text.contains(value)).otherwise(edges)
    return grams.join(cut, ["field", "kind", "gram"]).filter(holds).select("field", "text", "vid")


def by_joins(rows: DataFrame, table: DataFrame, fields: dict[str, Column], first: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with _texts, found, members): found has _texts, class, rule (its least), kind and n, for each class that holds;
    members the rules of each class."""
    texts = F.array(*[F.struct(F.lit(f).alias("field"), c.cast("string").alias("text")) for f, c in fields.items()])
    keyed = rows.withColumn("_texts", F.filter(texts, lambda t: t["text"].isNotNull()))
    tuples = stored(keyed.select("_texts").distinct().withColumn("_tid", F.monotonically_increasing_id()))
    told = tuples.select("_tid", F.explode("_texts").alias("t")).select("_tid", "t.field", "t.text")
    table = stored(table.distinct())
    values = stored(table.select("field", "kind", "value").distinct().withColumn("vid", F.monotonically_increasing_id()))
    of_text = met_values(told.select("field", "text").distinct(), values).groupBy("field", "text").agg(F.collect_set("vid").alias("vids"))
    met = stored(told.join(of_text, ["field", "text"]).groupBy("_tid").agg(F.flatten(F.collect_list("vids")).alias("vids")))
    often = stored(met.select(F.explode("vids").alias("vid")).groupBy("vid").agg(F.count("*").alias("often")))
    # what no text has can not help a clause; a clause without the rest can not hold
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    live = table.join(values, ["field", "kind", "value"]).join(often, "vid").withColumn("_kind", rank)
    zero = F.when(F.col("clause") == 0, F.struct("vid", F.col("_kind").alias("kind"), "value"))
    clauses = live.groupBy("rule", "clause").agg(
        F.array_sort(F.collect_set("vid")).alias("vids"), F.sum("often").alias("often"), F.array_sort(F.collect_set(zero)).alias("zero")
    )
    need = table.groupBy("rule").agg(F.count_distinct("clause").alias("_need"))
    whole = clauses.groupBy("rule").agg(
        F.count("*").alias("_live"), F.array_sort(F.collect_set("vids")).alias("clauses"), F.flatten(F.collect_list("zero")).alias("zero"),
        F.min(F.struct("often", "vids"))["vids"].alias("key")
    ).join(need, "rule").filter("_live = _need")
    classes = stored(
        whole.groupBy("clauses", "zero").agg(F.min("rule").alias("rule"), F.min("key").alias("key"), *([] if first else [F.collect_list("rule").alias("rules")]))
        .withColumn("class", F.monotonically_increasing_id())
    )
    keys = classes.select("class", "rule", "clauses", "zero", "key", F.explode("key").alias("vid"))
    asked = met.select("_tid", "vids", F.explode("vids").alias("vid")).join(keys, "vid")
    once = F.array_min(F.array_intersect("key", "vids")) == F.col("vid")
    good = asked.filter(once & F.forall("clauses", lambda c: F.arrays_overlap(c, "vids")))
    own = F.filter("zero", lambda z: F.array_contains("vids", z["vid"]))
    found = good.select("_tid", "class", "rule", own.alias("_own")).select(
        "_tid", "class", "rule", F.coalesce(F.array_min(F.transform("_own", lambda z: z["kind"])), F.lit(0)).alias("kind"),
        F.size(F.array_distinct(F.transform("_own", lambda z: z["value"]))).alias("n")
    )
    if first:
        found = found.groupBy("_tid").agg(F.min(F.struct("rule", "class", "kind", "n")).alias("h")).select("_tid", "h.*")
    members = classes.select("class", F.explode(F.array("rule") if first else F.col("rules")).alias("rule"))
    return keyed, tuples.join(found, "_tid").select("_texts", "class", "rule", "kind", "n"), members


def conditions_of(table: DataFrame, most_bytes: int) -> tuple[DataFrame, bool]:
    """What binds of a rule table, and whether it is small."""
    some = table.select("rule", "clause", "field", "kind", "value").filter(F.col("value").isNotNull())
    size = some.agg(F.coalesce(F.sum(F.octet_length("value") + 64), F.lit(0))).first()[0]  # one row
    return some, size <= most_bytes


#: Bytes of a table that becomes an automaton: some thousand conditions, as a text may meet each of them.
MOST_BYTES = 256 << 10


def in_folds(fields: dict[str, Column], fold: tuple[str, ...]) -> dict[str, Column]:
    """The fields, those to fold folded; null stays null."""
    return {f: F.when(c.isNotNull(), tx.folded(c.cast("string"))) if f in fold else c for f, c in fields.items()}


def held(
    rows: DataFrame, table: DataFrame, fields: dict[str, Column], *, first: bool = False, most_bytes: int = MOST_BYTES,
    fold: tuple[str, ...] = ()
) -> DataFrame:
    """rows, then _held: array of (rule, kind, n) for the rules that hold, in order, or the first of them. n: values of clause 0."""
    some, small = conditions_of(table, most_bytes)
    if small:
        return by_automaton(rows, [tuple(r) for r in some.collect()], fields, first, fold)
    fields = in_folds(fields, fold)
    keyed, found, members = by_joins(rows, some, fields, first)
    one = F.struct("rule", "kind", "n")
    if first:
        best = found.select("_texts", F.array(one).alias("_held"))
    else:
        best = found.drop("rule").join(members, "class").groupBy("_texts").agg(F.array_sort(F.collect_list(one)).alias("_held"))
    none = F.array().cast("array<struct<rule: bigint, kind: int, n: int>>")
    return keyed.join(best, "_texts", "left").withColumn("_held", F.coalesce("_held", none)).select(*rows.columns, "_held")


def rule_counts(rows: DataFrame, table: DataFrame, fields: dict[str, Column], *, most_bytes: int = MOST_BYTES, fold: tuple[str, ...] = ()) -> DataFrame:
    """(rule, n, rows): for how many rows a rule holds by so many values of its clause 0. Rules that are equal in what rows have are
    counted together, so pairs of rows and rules are not made."""
    some, small = conditions_of(table, most_bytes)
    if small:
        each = held(rows, table, fields, most_bytes=most_bytes, fold=fold).select(F.explode("_held").alias("h"))
        return each.groupBy("h.rule", "h.n").agg(F.count("*").alias("rows"))
    keyed, found, members = by_joins(rows, some, in_folds(fields, fold), False)
    texts = keyed.groupBy("_texts").agg(F.count("*").alias("rows"))
    counted = found.join(texts, "_texts").groupBy("class", "n").agg(F.sum("rows").alias("rows"))
    return counted.join(members, "class").select("rule", "n", "rows")


def first_rule(rows: DataFrame, table: DataFrame, fields: dict[str, Column], **how) -> DataFrame:
    """rows, then rule (null if none holds) and matched_by (the strongest kind of match in its clause 0)."""
    found = held(rows, table, fields, first=True, **how)
    one = F.get("_held", F.lit(0))
    return found.select(
        *rows.columns, one["rule"].alias("rule"), F.get(F.array(*[F.lit(k) for k in KINDS]), one["kind"]).alias("matched_by")
    )


def all_rules(rows: DataFrame, table: DataFrame, fields: dict[str, Column], **how) -> DataFrame:
    """A row for each row and rule that holds: its columns, then rule, matched_by and n (distinct values of clause 0 found)."""
    found = held(rows, table, fields, **how).withColumn("_h", F.explode("_held"))
    return found.select(
        *rows.columns, F.col("_h.rule").alias("rule"), F.get(F.array(*[F.lit(k) for k in KINDS]), F.col("_h.kind")).alias("matched_by"),
        F.col("_h.n").alias("n")
    )


__all__ = ["KINDS", "SCHEMA", "all_rules", "conditions", "first_rule", "held", "listed", "read_rules", "rule_counts"]
