"""Multi-party chats seen from every participant: one rendering for each perspective.

Every speaker of a conversation is once the assistant; all others are users
named by their role, and system turns stay system turns. Only the assistant's
own words are trained on: the mask lists their character spans.

A conversation is rendered in parts of ``part_turns`` turn numbers, so that a
conversation of any length is many rows of bounded size. Nothing is cut: parts joined by
``part`` (null last) are the whole dialogue, in which ``part_start`` is where a part
begins; masks count within the part. ``part_turns`` None gives one row for each dialogue.

Marks begin with ``<|`` and names end with ``|>``; where words or names hold these
themselves, a backslash comes before the bar (and a line break in a name is a space), so no
speaker can forge a turn.

Defined results: turns are ordered by number, then role, then text, and null
numbers come last, in a part of their own (``part`` null); a null text is an empty
message; a null role speaks as "unknown"; repeated rows are repeated turns; a null
conversation is a conversation of its own; conversations in which only the system
speaks have no perspective and give no row; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UNKNOWN = "unknown"
SYSTEM = "system"


def rotate_perspectives(
    turns: DataFrame,
    conversation_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    part_turns: int | None = 256,
) -> DataFrame:
    """Rows (conversation, perspective, part, part_start, n_turns, n_trained, rendered, mask).

    ``mask`` joins "start:end" code point spans of trained text by commas, ends exclusive.
    """
    rows = turns.select(
        F.col(conversation_col).alias("c"),
        F.col(turn_col).cast("long").alias("t"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(UNKNOWN)).alias("r"),
        F.replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit("<|"), F.lit("<\\|")).alias("x"),
    ).withColumn("part", F.floor(F.col("t") / part_turns) if part_turns else F.lit(0).cast("bigint"))
    message = F.struct(F.col("t").isNull().alias("late"), "t", "r", "x")
    parts = rows.groupBy("c", "part").agg(F.sort_array(F.collect_list(message)).alias("messages"))
    speakers = rows.where(F.col("r") != SYSTEM).select("c", "r").distinct().withColumnsRenamed({"c": "sc", "r": "perspective"})
    seen = parts.join(speakers, parts["c"].eqNullSafe(speakers["sc"])).drop("sc")
    name = r"replace(replace(replace(m.r, '<|', '<\\|'), '|>', '\\|>'), '\n', ' ')"
    head = f"case when m.r = perspective then '<|assistant|>' when m.r = 'system' then '<|system|>' else concat('<|user name=', {name}, '|>') end"
    seen = seen.selectExpr("c", "perspective", "part", "messages", f"transform(messages, m -> concat({head}, '\n')) as heads")
    # A message is its head, its words and an end mark; offsets are running sums of lengths.
    tail = "<|end|>\n"
    pieces = f"zip_with(heads, messages, (h, m) -> concat(h, m.x, '{tail}'))"
    own = f"""aggregate(zip_with(heads, messages, (h, m) -> struct(length(h) as h, length(m.x) as n, m.r = perspective as own)),
        cast(struct(0, array()) as struct<at:int,spans:array<string>>),
        (a, m) -> struct(a.at + m.h + m.n + {len(tail)} as at,
                         if(m.own and m.n > 0, concat(a.spans, array(concat(a.at + m.h, ':', a.at + m.h + m.n))), a.spans) as spans),
        a -> array_join(a.spans, ','))"""
    out = seen.selectExpr(
        "c",
        "perspective",
        "part",
        "cast(size(messages) as bigint) as n_turns",
        "cast(aggregate(messages, 0L, (a, m) -> a + if(m.r = perspective, length(m.x), 0)) as bigint) as n_trained",
        f"array_join({pieces}, '') as rendered",
        f"{own} as mask",
    )
    before = W.partitionBy("c", "perspective").orderBy(F.col("part").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("rendered")).over(before), F.lit(0)).cast("bigint")
    return out.select(F.col("c").alias(conversation_col), "perspective", "part", start.alias("part_start"), "n_turns", "n_trained", "rendered", "mask")
