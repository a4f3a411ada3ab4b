"""Chat formatting: a finite-state machine over roles and a declarative template.

The template gives each role its marks and says whether its text counts for the loss. Marks are the control strings; where a
text holds one, a backslash goes in after its first character, and backslashes are doubled, so a text can never end its
turn or open another, and reading back is exact.

The machine's state is the role last seen, so a step needs the turn before only. It runs in chunks of ``chunk`` turns: the
last role of each chunk goes to the next chunk. Turn texts are joined within chunks first, so a conversation with a third
of all rows is one row only in its final form, which the output calls for.

Edge cases: null text is empty; a null or unknown role is written between the marks of ``other`` with its name, and the
machine rejects the conversation; null turns come first; rows with equal turns are ordered by role, then text; rows with
null conv_id are one conversation; empty conversations do not occur; repeated rows are turns of their own; other columns than
conv_id, turn, role and text are dropped, whatever their names; an empty table gives an empty table; texts of any length are
written whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    #: role: (opening mark, closing mark, does the text count for the loss)
    roles: dict = field(
        default_factory=lambda: {
            "system": ("<<SYS>>", "<</SYS>>", False), "user": ("[INST] ", " [/INST]", False), "assistant": ("<s>", "</s>", True)
        }
    )
    #: opening mark, mark between name and text, closing mark of any other role
    other: tuple = ("[ROLE]", "[TEXT]", "[/ROLE]")
    #: role seen: roles that may follow; "" is the start
    follows: dict = field(
        default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    #: roles that may end a conversation
    ends: tuple = ("assistant",)

    def controls(self) -> list[str]:
        return sorted(
            {m.strip() for a, b, _ in self.roles.values() for m in (a, b)} | {m.strip() for m in self.other}, key=lambda m: (-len(m), m)
        )


def escaped(text: Column, t: Template) -> Column:
    firsts = "|".join(f"{re.escape(m[0])}(?={re.escape(m[1:])})" for m in t.controls())
    return F.regexp_replace(text, rf"\\|{firsts}", r"$0\\")


def unescaped(text: Column) -> Column:
    """A backslash pair is a backslash; a single one was put in."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def rendered(role: Column, text: Column, t: Template) -> tuple[Column, Column, Column]:
    """Opening with name, escaped text, closing."""
    opening = F.concat(F.lit(t.other[0]), escaped(role, t), F.lit(t.other[1]))
    closing: Column = F.lit(t.other[2])
    for name, (a, b, _) in t.roles.items():
        opening, closing = F.when(role == name, F.lit(a)).otherwise(opening), F.when(role == name, F.lit(b)).otherwise(closing)
    return opening, escaped(text, t), closing


def segments(turns: DataFrame, template: Template | None = None, chunk: int = 256) -> DataFrame:
    """One row per turn: conv_id, _chunk, _turn_key, role, text, opening, body, closing, loss (boolean), step_ok."""
    t = template or Template()
    rows = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    rows = rows.select("*", F.coalesce(F.floor(F.col("turn") / chunk), F.lit(-(2**62))).alias("_chunk"))
    part = ["conv_id", "_chunk"]
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    last = rows.groupBy(*part).agg(
        F.max(F.struct(F.coalesce("turn", F.lit(-(2**63))).alias("turn"), "role", "text"))["role"].alias("_last")
    )
    entering = last.select(
        F.col("conv_id").alias("_conv"), F.col("_chunk").alias("_part"),
        F.lag("_last").over(W.partitionBy("conv_id").orderBy("_chunk")).alias("_enter")
    )
    joined = rows.join(entering, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_chunk") == F.col("_part"))).drop("_conv", "_part")
    seen = F.coalesce(F.lag("role").over(W.partitionBy(*part).orderBy(*order)), "_enter", F.lit(""))
    step = F.lit(False)
    for before, after in t.follows.items():
        step = step | ((F.col("_before") == before) & F.col("role").isin(*after))
    opening, body, closing = rendered(F.col("role"), F.col("text"), t)
    loss = F.col("role").isin(*[r for r, m in t.roles.items() if m[2]])
    return joined.select("*", seen.alias("_before")).select(
        "conv_id", "_chunk", "turn", "role", "text", opening.alias("opening"), body.alias("body"), closing.alias("closing"),
        loss.alias("loss"), step.alias("step_ok")
    )


def conversations(turns: DataFrame, template: Template | None = None, chunk: int = 256) -> DataFrame:
    """One row per conversation: conv_id, n_turns, valid, formatted, segments (array of (text, loss) that join to formatted)."""
    t = template or Template()
    rows = segments(turns, t, chunk)
    order = F.struct(
        F.coalesce("turn", F.lit(-(2**63))).alias("turn"), "role", "text",
        F.array(
            F.struct(F.col("opening").alias("text"), F.lit(False).alias("loss")),
            F.struct(F.col("body").alias("text"), F.col("loss").alias("loss")),
            F.struct(F.col("closing").alias("text"), F.lit(False).alias("loss"))
        ).alias("parts")
    )
    listed = F.flatten(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["parts"]))
    chunks = rows.groupBy("conv_id", "_chunk").agg(
        listed.alias("parts"), F.count("*").alias("n"), F.bool_and("step_ok").alias("ok"),
        F.max(F.struct(F.coalesce("turn", F.lit(-(2**63))).alias("turn"), "role", "text"))["role"].alias("last")
    )
    whole = chunks.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), (F.bool_and("ok") & F.max_by("last", "_chunk").isin(*t.ends)).alias("valid"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_chunk", "parts"))), lambda x: x["parts"])).alias("segments")
    )
    return whole.select(
        "conv_id", "n_turns", "valid", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments"
    )


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """array of (role, text), read from the formatted text alone."""
    t = template or Template()
    kinds = [*[(re.escape(a), re.escape(b)) for a, b, _ in t.roles.values()], (re.escape(t.other[0]), re.escape(t.other[2]))]
    pattern = "(?s)" + "|".join(f"{a}.*?{b}" for a, b in kinds)

    def turn(x: Column) -> Column:
        inner = F.substring(x, len(t.other[0]) + 1, F.length(x) - len(t.other[0]) - len(t.other[2]))
        role, text = F.regexp_extract(
            inner, rf"(?s)^(.*?){re.escape(t.other[1])}(.*)$", 1
        ), F.regexp_extract(inner, rf"(?s)^(.*?){re.escape(t.other[1])}(.*)$", 2)
        for name, (a, b, _) in t.roles.items():
            mine = x.startswith(F.lit(a))
            role = F.when(mine, F.lit(name)).otherwise(role)
            text = F.when(mine, F.substring(x, len(a) + 1, F.length(x) - len(a) - len(b))).otherwise(text)
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(pattern), F.lit(0)), turn)
