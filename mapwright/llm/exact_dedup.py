"""Exact duplicates by a log-structured merge index of text digests.

Every scan task is a memtable: it flushes one run of (digest, identifier) rows,
sorted by digest, with a Parquet bloom filter on the digest. Compaction merges
runs and keeps the smallest identifier of each digest. A digest that more than
one row has is only a hit; the texts themselves are compared before rows count
as equal, and rows whose digest collides are grouped by their text instead.

Defined results: a null text counts as empty; a null identifier is kept only if
its whole group has none; rows that repeat identifier and text are copies of one
another, and exactly one of them is kept; an empty table gives an empty result.
Columns of the input other than identifier and text are not looked at.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mapwright.llm.common import Scratch, ascii_lower

#: Runs carry filters so that a point lookup skips runs that lack the digest.
RUN_OPTIONS = {"parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.expected.ndv#key": "100000", "parquet.bloom.filter.max.bytes": "262144"}


#: Keys of one lookup; each is an equality of its own, as filters answer no ranges.
MOST_LOOKED_UP = 64


class DigestIndex:
    """Sorted digest runs in level 0, one compacted level above them.

    ``rank`` orders identifiers; the smallest of a key survives compaction.
    """

    def __init__(self, spark: SparkSession, scratch: Scratch):
        self.spark, self.scratch, self.flushed, self.generation = spark, scratch, 0, 0
        self.merged: DataFrame | None = None
        self.runs: list[str] = []

    def flush(self, rows: DataFrame) -> DataFrame:
        """Append rows (key, rank, ...) as one sorted run for each scan task."""
        name = f"run-{self.flushed}"
        self.flushed += 1
        self.runs.append(name)
        return self.scratch.keep(rows.sortWithinPartitions("key", "rank"), name, **RUN_OPTIONS)

    def _parts(self) -> list[DataFrame]:
        """Runs not yet merged and the merged level, as (key, rank, n)."""
        parts = [self.spark.read.parquet(self.scratch.path(r)).select("key", "rank", F.lit(1).cast("long").alias("n")) for r in self.runs]
        if self.merged is not None:
            parts.append(self.merged)
        if not parts:
            raise ValueError("nothing was flushed")
        return parts

    @staticmethod
    def _merge(parts: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.min("rank").alias("rank"), F.sum("n").alias("n"))

    def lookup(self, keys: list[bytes]) -> DataFrame:
        """(key, rank, n) of those of a few digests that runs or level hold; row groups whose filter lacks them aren't read."""
        if len(keys) > MOST_LOOKED_UP:
            raise ValueError(f"a lookup takes at most {MOST_LOOKED_UP} keys; join with the level instead")
        wanted = reduce(or_, [F.col("key") == F.lit(bytearray(k)) for k in keys], F.lit(False))
        return self._merge([p.where(wanted) for p in self._parts()])

    def compact(self) -> DataFrame:
        """Merge all runs not yet merged, and the merged level, into (key, rank, n)."""
        level = self._merge(self._parts())
        self.generation += 1
        self.merged = self.scratch.keep(level.sortWithinPartitions("key"), f"level-{self.generation}", **RUN_OPTIONS)
        self.runs = []
        return self.merged


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise=ascii_lower,
    digest_bytes: int = 32,
) -> DataFrame:
    """One row per input row: identifier, keep_id, group_size, kept, text_sha256.

    ``keep`` names which identifier of a group stays, "smallest" or "largest";
    the latter ranks by the complement, so that the index still keeps minima.
    ``digest_bytes`` shortens the index's key; results don't depend on it.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep}")
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    flip = (lambda c: F.bitwise_not(c)) if keep == "largest" else (lambda c: c)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sha: Column = F.unhex(F.sha2(normalise(F.col("text")).cast("binary"), 256))
    index = DigestIndex(spark, scratch)
    rows = index.flush(
        base.select("id", sha.alias("sha")).select(F.substring("sha", 1, digest_bytes).alias("key"), flip(F.col("id")).alias("rank"), "id", "sha")
    )
    level = index.compact()
    tagged = scratch.keep(rows.drop("rank").join(level, "key"), "tagged")
    alone = tagged.where("n = 1").select("id", "id", "n", F.lit(True), "sha").toDF("id", "keep_id", "group_size", "kept", "sha")

    # Hits: their texts are read again and compared with the text of the survivor.
    hits = tagged.where("n > 1").select(F.col("id").alias("hit"), "key", "sha", "rank", "n").distinct()
    again = base.join(hits, base["id"].eqNullSafe(hits["hit"])).withColumn("text", normalise(F.col("text"))).where(F.unhex(F.sha2(F.col("text").cast("binary"), 256)) == F.col("sha"))
    held = scratch.keep(again.select("id", "key", "sha", "rank", "n", "text"), "hits")
    survivor = held.where(flip(F.col("id")).eqNullSafe(F.col("rank"))).groupBy("key").agg(F.max("text").alias("survivor"))
    same = F.col("text") == F.col("survivor")
    verdict = scratch.keep(held.join(survivor, "key").select("id", "key", "sha", "rank", "n", same.alias("same"), F.when(~same, F.col("text")).alias("other")), "verdict")
    strays = verdict.where(~F.col("same"))
    lost = strays.groupBy("key").agg(F.count("*").alias("lost"))
    equal = verdict.where("same").join(lost, "key", "left").select("id", flip(F.col("rank")).alias("keep_id"), (F.col("n") - F.coalesce("lost", F.lit(0))).alias("group_size"), "sha")
    regrouped = strays.groupBy("key", "other").agg(F.min(flip(F.col("id"))).alias("least"), F.count("*").alias("group_size"))
    stray = strays.join(regrouped, ["key", "other"]).select("id", flip(F.col("least")).alias("keep_id"), "group_size", "sha")
    copies = equal.unionByName(stray)
    nth = F.row_number().over(W.partitionBy("sha", "id").orderBy("id"))
    copies = copies.withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")) & (nth == 1))
    out = alone.unionByName(copies.select("id", "keep_id", "group_size", "kept", "sha"))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))
