"""Mixing sources to target weights by pivotal dependent rounding.

A source with ratio r of target to size takes each of its documents r times: the
whole part of r outright, the rest as a copy probability. Probabilities meet in
pairs: mass, measured in words, moves at random from one document to the other
until one of the two is certain; the other goes on as the residual. Both the
words taken and each document's probability are kept in expectation, and the
words exactly but for the last residual. Documents meet first within blocks of
bounded size; the blocks' residuals meet in further rounds, a reduction tree
that ends with one residual for each source, which is then drawn.

Defined results: a null text has size 0; a null source is a source of its own and
comes last; documents of size 0 are never taken; rows that repeat an identifier
are separate documents; an empty table gives an empty result. Draws come from hashes of
identifiers and sizes, so reruns agree whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mapwright.llm.common import Scratch, uniform, word_count

ITEM = "struct<id:bigint,size:bigint,slot:bigint,p:double>"
STATE = f"struct<done:array<struct<slot:bigint,id:bigint,size:bigint,take:int>>,rest:{ITEM}>"


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, size) rows.

    Water filling in closed form: sources sorted by the level at which they reach
    their limit; those before the level that all others share stop at the limit.
    The table has one row for each source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((place - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("limit", F.lit(float(most)) * F.col("source_size")).withColumn("full_at", F.col("limit") / F.col("weight"))
    order = W.orderBy("full_at", F.col("source").asc_nulls_last())
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / open_weight)
    # Levels rise while sources stop; the first source that doesn't stop sets the level.
    first_open = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(everything)
    per = per.withColumn("shared", first_open["level"])
    target = F.when(F.col("level") <= F.col("full_at"), F.col("weight") * F.coalesce("shared", "level")).otherwise(F.col("limit"))
    return per.select("source", "source_size", "n_docs", F.least(target, F.col("limit")).alias("target"))


def _fold(items: str, seed: int) -> str:
    """SQL: pivotal pairs over an array of ITEM, largest first; state STATE."""
    draw = f"(shiftrightunsigned(xxhash64(acc.rest.slot, acc.rest.id, acc.rest.size, x.slot, x.id, x.size, {seed}), 11) / 9007199254740992D)"
    met = f"""
      aggregate({items}, cast(struct(array(), null) as {STATE}),
        (acc, x) -> case
          when x.p <= 0D or x.p >= 1D then struct(concat(acc.done, array(struct(x.slot as slot, x.id as id, x.size as size, cast(x.p as int) as take))) as done, acc.rest as rest)
          when acc.rest is null then struct(acc.done as done, x as rest)
          else transform(array(struct(
              least((1D - acc.rest.p) * acc.rest.size, x.p * x.size) as up,
              least(acc.rest.p * acc.rest.size, (1D - x.p) * x.size) as down)), m ->
            case when {draw} * (m.up + m.down) < m.down then
              case when (1D - acc.rest.p) * acc.rest.size <= x.p * x.size
                then struct(concat(acc.done, array(struct(acc.rest.slot as slot, acc.rest.id as id, acc.rest.size as size, 1 as take))) as done,
                            struct(x.id as id, x.size as size, x.slot as slot, x.p - m.up / x.size as p) as rest)
                else struct(concat(acc.done, array(struct(x.slot as slot, x.id as id, x.size as size, 0 as take))) as done,
                            struct(acc.rest.id as id, acc.rest.size as size, acc.rest.slot as slot, acc.rest.p + m.up / acc.rest.size as p) as rest) end
            else
              case when acc.rest.p * acc.rest.size <= (1D - x.p) * x.size
                then struct(concat(acc.done, array(struct(acc.rest.slot as slot, acc.rest.id as id, acc.rest.size as size, 0 as take))) as done,
                            struct(x.id as id, x.size as size, x.slot as slot, x.p + m.down / x.size as p) as rest)
                else struct(concat(acc.done, array(struct(x.slot as slot, x.id as id, x.size as size, 1 as take))) as done,
                            struct(acc.rest.id as id, acc.rest.size as size, acc.rest.slot as slot, acc.rest.p - m.down / acc.rest.size as p) as rest) end
            end)[0] end)"""
    return met


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    most: float = 3.0,
    block: int = 256,
    seed: int = 20,
) -> DataFrame:
    """One row per document: id, size, source, source_size, target, copies, taken.

    A block holds ``block`` documents in the mean; the work of a round is a fold
    over each block, and rounds are as many as the logarithm of the count.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    sizes = scratch.keep(docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")), "sizes")
    targets = scratch.keep(source_targets(sizes, weights, most).coalesce(1), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # One row per source; joined by a plain join, which broadcasts it while it is small.
    rows = sizes.join(targets, sizes["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    rows = rows.withColumn("ratio", ratio).withColumn("whole", F.floor("ratio").cast("int")).withColumn("p", F.when(F.col("size") > 0, F.col("ratio") - F.floor("ratio")).otherwise(0.0))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / block)).cast("long")
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("id", "size", F.lit(seed)), blocks))
    item = F.struct("id", "size", "slot", "p").cast(ITEM)
    grouped = rows.groupBy("source", "slot").agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("o"), "id", item.alias("item")))).alias("items"), F.first("whole").alias("whole"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    first = scratch.keep(grouped.selectExpr("source", "slot", "whole", "source_size", "target", f"{_fold('transform(items, i -> i.item)', seed)} as state"), "round-0")

    # Residuals meet in rounds; each leaves at most one residual of each slot of the round before.
    n_blocks = targets.agg(F.max(F.ceil(F.col("n_docs") / block))).first()[0] or 1
    level, rest, decided = 0, first.where("state.rest is not null").selectExpr("source", "state.rest as item"), []
    while True:
        level += 1
        n_blocks = max(1, -(-n_blocks // block))
        pooled = rest.groupBy("source", F.pmod(F.xxhash64("item.slot", F.lit(seed + level)), F.lit(n_blocks)).alias("pool")).agg(F.sort_array(F.collect_list(F.struct((-F.col("item.size")).alias("o"), "item.slot", "item"))).alias("items"))
        met = scratch.keep(pooled.selectExpr("source", f"{_fold('transform(items, i -> i.item)', seed + level)} as state"), f"round-{level}")
        decided.append(met.selectExpr("source", "inline(state.done)"))
        rest = met.where("state.rest is not null").selectExpr("source", "state.rest as item")
        if n_blocks == 1:
            break
    drawn = (uniform(F.col("item.slot"), F.col("item.id"), seed) < F.col("item.p")).cast("int")
    late = rest.select("source", "item.slot", "item.id", "item.size", drawn.alias("take"))
    for d in decided:
        late = late.unionByName(d)
    late = late.select(F.col("source").alias("s"), F.col("slot").alias("t"), F.col("take").alias("late"))
    # A block has at most one residual, so (source, slot) finds its draw.
    blockwise = first.join(late, first["source"].eqNullSafe(late["s"]) & (first["slot"] == late["t"]), "left")
    taken = blockwise.selectExpr("source", "whole", "source_size", "target", "inline(concat(state.done, case when state.rest is null then array() else array(struct(state.rest.slot as slot, state.rest.id as id, state.rest.size as size, late as take)) end))")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("take")).otherwise(0)
    return taken.select(F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
