"""A training corpus from raw documents: five stages, each written and read again.

Quality, near duplicates, benchmark leaks, mixing and token files, in this order.
Every stage works on what its predecessor kept; all but the last return the columns of
documents, so a document that the mix takes twice is two rows.

Defined results: null and empty texts are rejected by the first stage, and where a later one gets
them they have no copies, no leaks and no words, so the mix takes none. A row without an identifier
is a document like any other, named by its text where a stage needs a name. Of rows that repeat
an identifier one stays in the second stage, whatever their texts; the others treat them as separate
documents. Of rows in one group that tie, the least hash of the text decides. Empty tables give empty results;
columns beside those of documents are carried along, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mapwright.llm.common import Scratch
from mapwright.llm.decontaminate import decontaminate
from mapwright.llm.jaccard import jaccard_components
from mapwright.llm.mixing import mix_sources
from mapwright.llm.quality import classify_quality
from mapwright.llm.token_output import tokens_round_trip

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _row(docs: DataFrame):
    """All columns as one, so that none can clash with a stage's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    scored = classify_quality(docs, labels, score_col="mapwright_score", predicted_col="mapwright_predicted")
    return scored.where("mapwright_predicted = 1").select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest identifier of each component."""
    # Made-up identifiers are larger than real ones, so that these name a component if they can.
    made = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    rows = docs.select(_row(docs), F.coalesce(F.col("doc_id").cast("long"), made).alias("id"))
    found = jaccard_components(rows.select("id", F.col("row.text").alias("text")), "id").where("id = component_id").select(F.col("id").alias("kept")).distinct()
    nth = F.row_number().over(W.partitionBy("id").orderBy(F.xxhash64("row.text"), "row.text"))
    return rows.join(found, F.col("id") == F.col("kept"), "left_semi").withColumn("nth", nth).where("nth = 1").select("row.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    key = F.xxhash64("doc_id", "source", "text").alias("key")
    taken = mix_sources(docs.select(key, "source", "text"), "key").where("copies > 0").select("key", "copies")
    # Rows that are equal take turns.
    taken = taken.withColumn("nth", F.row_number().over(W.partitionBy("key").orderBy(F.desc("copies"))))
    rows = docs.select(_row(docs), key).withColumn("nth", F.row_number().over(W.partitionBy("key").orderBy("key")))
    return rows.join(taken, ["key", "nth"]).select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, as read back."""
    return tokens_round_trip(docs, TOKENIZER)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix),
    ("tokens", tokens),
]
#: Votes of neighbours, random draws and coded files are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
