"""Language-model scoring by prediction by partial matching over bytes, pretrained on the corpus.

The trie's levels are the counts of all byte strings of one to ``order + 1`` bytes in the training texts. A byte is coded at
the longest context known: with its count there over the context's total plus its number of different bytes (escape by
method C); if it never followed that context, the escape is coded and the next shorter context tried, without the bytes
that the longer one has ruled out (symbol exclusion). Below the empty context all bytes not yet ruled out are equally likely.
As the bytes seen after a context are always among those seen after its shorter ones, the bytes ruled out at a level are just
those of the level above, so that totals after exclusion are sums that can be tabled per context; scoring is table lookups
on whole arrays of bytes.

Scale: one pass counts strings and tokens per task and sends counts, not rows, to the shuffle; the counts come from the whole
training corpus and grow with it. What is broadcast is bounded: tokens are kept in order of count, down to the power of two
at which at most ``head_rows`` are left; with fewer, all are kept. Tokens below that line are looked up by a join, in which no
key has more rows than the line, so there is no hot key by construction. A trie of at most ``model_rows`` strings is broadcast
whole. Of a larger one, the longest strings are, down to such a line, each with its probability in the whole trie; what a
text has besides is looked up by joins: strings below the line with their probabilities, strings not in the trie, each once,
with the counts of their ends in the stored levels. Ends of one or two bytes, the keys that many share, are fixed tables.

Edge cases: null text is empty: it scores its end only; null or repeated ids are scored row by row, and rows with a null id are
of the training texts; input columns named like the results give way to them; texts of any length are scored whole; without training texts all bytes are equally likely; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, unpacked
from .tables import Table

ORDER = 5
#: Neither byte occurs in UTF-8: one ends a text, the other stands for what lies before it.
END, START = 0xFF, 0xFE
#: The digest that stands for the end token.
END_TOKEN = np.uint64(0xFFFFFFFFFFFFFFFF)
SYMBOLS = 257
PART = 1 << 20


def held_out(doc_id: object) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 10 == 0 if doc_id is not None else False


def lowered(text: str | None) -> bytes:
    # bytes.lower changes A-Z only
    return (text or "").encode("utf-8", "surrogatepass").lower()


def token_digests(text: bytes) -> np.ndarray:
    digest = xxhash.xxh64_intdigest  # bytes.split cuts at space and 9-13 only
    words = text.split()
    return np.fromiter(map(digest, words), dtype=np.uint64, count=len(words))


def strings(texts: list[bytes], order: int) -> np.ndarray:
    """For each byte and each end, the order bytes before it and itself, as one number."""
    flat = np.frombuffer(b"".join(bytes([START]) * order + t + bytes([END]) for t in texts), dtype=np.uint8).astype(np.uint64)
    out = np.zeros(len(flat) - order, dtype=np.uint64)
    for k in range(order + 1):
        out = out << np.uint64(8) | flat[k : len(flat) - order + k]
    lengths = np.array([len(t) + 1 for t in texts])
    # windows that end within the next text's start are none of its own
    starts = np.concatenate([[0], np.cumsum(lengths + order)[:-1]])
    return out[np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())]


def runs(rows: Iterator, most: int = PART) -> Iterator[list]:
    """Lists of rows (…, bytes) of about so many bytes."""
    own, size = [], 0
    for r in rows:
        own.append(r)
        size += len(r[-1]) + 1
        if size >= most:
            yield own
            own, size = [], 0
    if own:
        yield own


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])
    by = np.argsort(keys, kind="stable")
    keys, counts = keys[by], counts[by]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, dtype=int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def count(docs: DataFrame, *, key: str, text: str, order: int = ORDER) -> DataFrame:
    """kind (0 tokens, 1 strings), item (long), n: counts over the texts that are not held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list] = [[], []]

        def out(kind: int) -> pa.RecordBatch:
            keys, counts = merged(kept[kind])
            kept[kind] = []
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), kind, dtype=np.int32)), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))],
                names=["kind", "item", "n"]
            )

        rows = ((lowered(t.as_py()),) for b in batches for k, t in zip(b.column(0), b.column(1), strict=True) if not held_out(k.as_py()))
        for some in runs(rows):
            texts = [t for (t,) in some]
            tokens = np.concatenate([np.full(len(texts), END_TOKEN), *map(token_digests, texts)])
            for kind, values in enumerate((tokens, strings(texts, order))):
                kept[kind].append(np.unique(values, return_counts=True))
                if sum(len(k) for k, _ in kept[kind]) > 4 * PART:
                    kept[kind] = [merged(kept[kind])]
                    if len(kept[kind][0][0]) > 2 * PART:
                        yield out(kind)
        for kind in (0, 1):
            if kept[kind]:
                yield out(kind)

    counted = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, "kind int, item long, n long")
    return counted.groupBy("kind", "item").agg(F.sum("n").alias("n"))


def cutoff(counts: DataFrame, most: int) -> int:
    """The least power of two such that at most so many rows have that count."""
    row = counts.agg(*[F.count_if(F.col("n") >= 2**k).alias(str(k)) for k in range(62)]).first()
    return next(2**k for k in range(62) if row[k] <= most)


class Listed:
    """Log10 probabilities by string; NaN for a string that is not listed."""

    def __init__(self, keys: np.ndarray, logp: np.ndarray):
        self.strings, self.logp = Table(keys), np.append(logp.astype(float), np.nan)

    def score(self, grams: np.ndarray) -> np.ndarray:
        return self.logp[self.strings.find(grams)]


class Model:
    """Log10 probabilities of bytes from the counts of all strings of one to order + 1 bytes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int = ORDER):
        """keys: level << 56 | string, where a string of level k has k bytes of context."""
        self.order = order
        level = (keys >> np.uint64(56)).astype(int)
        self.levels = []
        string = keys & np.uint64((1 << 56) - 1)
        raw = []
        for k in range(order + 1):
            by = np.flatnonzero(level == k)
            by = by[np.argsort(string[by])]
            raw.append((string[by], counts[by].astype(np.int64)))
        for k in range(order + 1):
            s, n = raw[k]
            contexts, first, size = np.unique(s >> np.uint64(8), return_index=True, return_counts=True)
            total = np.add.reduceat(n, first) if len(first) else np.empty(0, dtype=np.int64)
            entry = {
                "contexts": Table(contexts), "strings": Table(s), "log_n": np.log10(n), "open": np.log10(total + size),
                "escape": np.log10(size) - np.log10(total + size)
            }
            if k:
                # of the shorter context, what this one does not rule out
                below, n_below = raw[k - 1]
                mine = self.levels[k - 1]["contexts"].find(contexts & np.uint64((1 << 8 * (k - 1)) - 1))
                shorter_total, shorter_size = self.levels[k - 1]["totals"][mine], self.levels[k - 1]["sizes"][mine]
                same = np.searchsorted(below, s & np.uint64((1 << 8 * k) - 1))
                ruled = np.add.reduceat(n_below[same], first) if len(first) else np.empty(0, dtype=np.int64)
                left, kinds = shorter_total - ruled, shorter_size - size
                some = kinds > 0
                safe = np.where(some, left + kinds, 1)
                entry["next_open"] = np.where(some, np.log10(safe), 0.0)
                entry["next_escape"] = np.where(some, np.log10(np.where(some, kinds, 1)) - np.log10(safe), 0.0)
            entry["totals"], entry["sizes"] = total, size
            self.levels.append(entry)
        top = self.levels[order]
        if len(top["log_n"]):
            top["final"] = top["log_n"] - top["open"][top["contexts"].find(raw[order][0] >> np.uint64(8))]
        else:
            top["final"] = top["log_n"]
        seen = int(self.levels[0]["sizes"][0]) if len(self.levels[0]["sizes"]) else 0
        self.floor = -np.log10(max(SYMBOLS - seen, 1))

    def score(self, grams: np.ndarray) -> np.ndarray:
        """Log10 probability of the last byte of each string after those before it."""
        out = np.zeros(len(grams))
        top = self.levels[self.order]
        at = top["strings"].find(grams)
        hit = at >= 0
        out[hit] = top["final"][at[hit]]
        rest = np.flatnonzero(~hit)
        # open_: the denominator here after exclusion, NaN if no longer context was known; leave: the escape from here
        open_, leave = np.full(len(rest), np.nan), np.zeros(len(rest))
        g = grams[rest]
        for k in range(self.order, -1, -1):
            level = self.levels[k]
            string = g & np.uint64((1 << 8 * (k + 1)) - 1)
            at = level["strings"].find(string) if k < self.order else np.full(len(g), -1)
            context = level["contexts"].find(string >> np.uint64(8))
            fresh = np.isnan(open_) & (context >= 0)
            open_[fresh], leave[fresh] = level["open"][context[fresh]], level["escape"][context[fresh]]
            hit = at >= 0
            out[rest[hit]] += level["log_n"][at[hit]] - open_[hit]
            miss = ~hit
            rest, g, open_, leave, context = rest[miss], g[miss], open_[miss], leave[miss], context[miss]
            out[rest] += leave
            if k:
                known = context >= 0
                open_ = np.where(known, level["next_open"][context] if len(level["next_open"]) else np.nan, np.nan)
                leave = np.where(known, level["next_escape"][context] if len(level["next_escape"]) else 0.0, 0.0)
        out[rest] += self.floor
        return out


def trie_levels(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """item (level << 56 | string), n: from the counts of the longest strings those of all levels."""
    longest = counts.select("item", "n")
    each = longest.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(k << 56).bitwiseOR(F.col("item").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))).alias("item"),
                        F.col("n").alias("n")
                    )
                    for k in range(order + 1)
                ]
            )
        ).alias("x")
    )
    return each.groupBy(F.col("x.item").alias("item")).agg(F.sum("x.n").alias("n"))


def mask(length: str) -> str:
    """Of so many bytes, as SQL."""
    return f"(shiftleft(1L, 8 * ({length})) - 1)"


def leveled(levels: DataFrame) -> DataFrame:
    """item and n of trie_levels, then level, string and context (level << 56 | the string but for its last byte)."""
    level, string = "cast(shiftright(item, 56) as int)", f"(item & {mask('7')})"
    return levels.selectExpr(
        "item", "n", f"{level} level", f"{string} string", f"shiftleft(cast({level} as bigint), 56) | shiftright({string}, 8) context"
    )


def context_logs(levels: DataFrame) -> DataFrame:
    """context, level, then Log10: open and escape, the denominator and the escape there; next_open and next_escape, those of
    the next shorter context without the bytes that this one rules out. No key here has more than 256 rows."""
    each = leveled(levels)
    ends = each.selectExpr("*", f"if(level > 0, shiftleft(cast(level - 1 as bigint), 56) | (string & {mask('level')}), null) below")
    below = levels.selectExpr("item below", "n n_below")
    sums = ends.join(below, "below", "left").groupBy("context").agg(
        F.first("level").alias("level"), F.sum("n").alias("total"), F.count("*").alias("size"), F.sum("n_below").alias("ruled")
    )
    keyed = stored(
        sums.selectExpr("*", f"if(level > 0, shiftleft(cast(level - 1 as bigint), 56) | (context & {mask('level - 1')}), null) shorter")
    )
    beside = keyed.join(
        keyed.selectExpr("context shorter", "total whole", "size sizes"), "shorter", "left"
    ).selectExpr("*", "whole - ruled left_", "sizes - size kinds")
    return beside.selectExpr(
        "context", "level", "log10(total + size) open", "log10(size) - log10(total + size) escape",
        "if(kinds > 0, log10(left_ + kinds), 0.0D) next_open", "if(kinds > 0, log10(kinds) - log10(left_ + kinds), 0.0D) next_escape",
    )


def joined(rows: DataFrame, table: DataFrame, key: str, few: str) -> DataFrame:
    """rows with what table has for their key; keys where few holds, a condition on level, are shared by many and few in all."""
    own = table.drop("level")
    return rows.filter(few).join(
        F.broadcast(table.filter(few).drop("level")), key, "left"
    ).unionByName(rows.filter(f"not ({few})").join(own, key, "left"))


def escaped(grams: DataFrame, levels: DataFrame, contexts: DataFrame, floor: float, order: int) -> DataFrame:
    """grams: gram, distinct, none of them in the trie. gram and Log10 of the probability of its last byte: of the longest
    context known the escape, then those of the shorter ones, down to the first that the byte did follow."""
    ends = grams.select("gram", F.explode(F.sequence(F.lit(0), F.lit(order))).alias("level"))
    ends = ends.selectExpr(
        "gram", "level", f"shiftleft(cast(level as bigint), 56) | (gram & {mask('level + 1')}) item",
        f"shiftleft(cast(level as bigint), 56) | (shiftright(gram, 8) & {mask('level')}) context"
    )
    strings_ = leveled(levels).select("item", "n", "level")
    rows = joined(joined(ends, strings_, "item", "level <= 1"), contexts, "context", "level <= 2")
    known = F.when(F.col("open").isNotNull(), F.col("level"))
    hit = F.when(F.col("n").isNotNull(), F.col("level"))
    each = rows.groupBy("gram").agg(
        F.max(known).alias("m"), F.coalesce(F.max(hit), F.lit(-1)).alias("h"), F.max_by("open", known).alias("open"),
        F.max_by("escape", known).alias("escape"), F.max_by("n", hit).alias("n"),
        F.collect_list(F.struct("level", "next_open", "next_escape")).alias("next")
    )
    passed = "aggregate(filter(next, x -> x.level >= h + 2 and x.level <= m), 0.0D, (s, x) -> s + x.next_escape)"
    there = "log10(n) - element_at(filter(next, x -> x.level = h + 1), 1).next_open"
    return each.selectExpr("gram", f"if(h = m, log10(n) - open, escape + {passed} + if(h >= 0, {there}, {floor!r}D)) logp")


def outside(flat: np.ndarray, inside: np.ndarray, first: np.ndarray, n: np.ndarray) -> list[pa.Array]:
    """Of each text's n values from first on, those that are not inside, and how often: two columns of lists."""
    values, times, sizes = [], [], []
    for f, m in zip(first, n, strict=True):
        t, k = np.unique(flat[f : f + m][~inside[f : f + m]], return_counts=True)
        values.append(t), times.append(k), sizes.append(len(t))
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return [
        pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(values).view(np.int64))),
        pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(times).astype(np.int32)))
    ]


def arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of a table whose size is bounded: item and n."""
    t = df.select("item", "n").toArrow()
    return t.column("item").to_numpy().view(np.uint64), t.column("n").to_numpy()


_models: dict[str, tuple] = {}


def score(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", order: int = ORDER, model_rows: int = 1_500_000,
    head_rows: int = 1_000_000, smooth: float = 0.1
) -> DataFrame:
    """The columns of docs but for the text, then held_out, n_tokens, n_known, train_tokens, base_score and score."""
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c != text]
    counts = stored(count(docs, key=key, text=text, order=order))
    tokens = counts.filter("kind = 0").select("item", "n")
    totals = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    train, kinds = int(totals["n"]), int(totals["v"])
    head_from = cutoff(tokens, head_rows)
    levels = stored(trie_levels(counts.filter("kind = 1"), order))
    whole = levels.count() <= model_rows
    if whole:
        model_of = levels
    else:
        contexts = stored(context_logs(levels))
        top = leveled(levels).filter(F.col("level") == order).join(
            contexts.select("context", "open"), "context"
        ).selectExpr("string item", "n", "log10(n) - open logp")
        longest = stored(top)
        string_from = cutoff(longest, model_rows)
        model_of = longest.filter(F.col("n") >= string_from).select("item", F.col("logp").alias("n"))
    shared = spark.sparkContext.broadcast((*arrays(tokens.filter(F.col("n") >= head_from)), *arrays(model_of)))
    name = uuid.uuid4().hex
    logs = np.log10(train + smooth * (kinds + 1))

    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in columns]).alias("_row"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    schema = rows.select(
        "_row", F.lit(True).alias("held_out"),
        *[
            F.lit(0).cast(t).alias(c)
            for c, t in (("_id", "long"), ("n_tokens", "long"), ("_known", "long"), ("_base", "double"), ("score", "double"))
        ],
        F.array(F.lit(0).cast("long")).alias("_tail"), F.array(F.lit(0).cast("int")).alias("_times"),
        *([] if whole else [F.array(F.lit(0).cast("long")).alias("_grams"), F.array(F.lit(0).cast("int")).alias("_often")])
    ).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _models:  # one for each worker process
            _models.clear()
            head, head_n, strings_, strings_n = shared.value
            _models[name] = (Table(head), head_n, Model(strings_, strings_n, order) if whole else Listed(strings_, strings_n))
        head, head_n, model = _models[name]
        head_log = np.log10(head_n + smooth) - logs
        made = TaskContext.get().partitionId() << 40
        for b in batches:
            at = 0
            for some in runs((k, lowered(t)) for k, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                texts = [t for _, t in some]
                sizes = np.array([len(t) + 1 for t in texts])
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                grams = strings(texts, order)
                each = model.score(grams)
                logp = np.add.reduceat(np.nan_to_num(each, nan=0.0), starts)
                more = [] if whole else outside(grams, ~np.isnan(each), starts, sizes)
                digests = [np.append(token_digests(t), END_TOKEN) for t in texts]
                n = np.array([len(d) for d in digests])
                first = np.concatenate([[0], np.cumsum(n)[:-1]])
                flat = np.concatenate(digests)
                place = head.find(flat)
                inside = place >= 0
                known = np.add.reduceat(inside.astype(np.int64), first)
                base = np.add.reduceat(np.where(inside, head_log[place] if len(head_log) else 0.0, 0.0), first)
                ids = made + np.arange(len(some))
                made += len(some)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(some)), pa.array([held_out(k) for k, _ in some]), pa.array(ids), pa.array(n), pa.array(known), pa.array(base), pa.array(logp), *outside(flat, inside, first, n), *more],
                    names=schema.names,
                )
                at += len(some)

    scored = stored(rows.mapInArrow(run, schema))
    tail = scored.select("_id", F.explode(F.arrays_zip("_tail", "_times")).alias("_t")).select(
        "_id", F.col("_t._tail").alias("item"), F.col("_t._times").alias("times")
    )
    rare = tokens.filter(F.col("n") < head_from)
    c = F.coalesce("n", F.lit(0))
    found = tail.join(rare, "item", "left").groupBy("_id").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("_rare_known"),
        F.sum(F.col("times") * (F.log10(c + F.lit(smooth)) - F.lit(float(logs)))).alias("_rare_base")
    )
    rest = F.lit(0.0)
    if not whole:
        grams = scored.select("_id", F.explode(F.arrays_zip("_grams", "_often")).alias("_g")).select(
            "_id", F.col("_g._grams").alias("gram"), F.col("_g._often").alias("times")
        )
        listed = longest.filter(F.col("n") < string_from).select(F.col("item").alias("gram"), "logp")
        # texts of the training have no others
        new = scored.filter("held_out").select(F.explode("_grams").alias("gram")).distinct().join(listed, "gram", "left_anti")
        floor = -float(np.log10(max(SYMBOLS - levels.filter(F.col("item") < 1 << 56).count(), 1)))
        logs_of = listed.unionByName(escaped(new, levels, contexts, floor, order))
        found = found.join(
            grams.join(logs_of, "gram").groupBy("_id").agg(F.sum(F.col("times") * F.col("logp")).alias("_rare_score")), "_id", "full"
        )
        rest = F.coalesce("_rare_score", F.lit(0.0))
    zero = F.lit(0).cast("long")
    added = {
        "held_out": F.col("held_out"),
        "n_tokens": F.col("n_tokens"),
        "n_known": F.col("_known") + F.coalesce("_rare_known", zero),
        "train_tokens": F.lit(train).cast("long"),
        "base_score": F.col("_base") + F.coalesce("_rare_base", F.lit(0.0)),
        "score": F.col("score") + rest,
    }
    return unpacked(scored.drop("_tail", "_times", "_grams", "_often").join(found, "_id", "left"), columns, added)
