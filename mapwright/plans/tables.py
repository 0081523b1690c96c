"""The driver's tables in the roles of the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapwright.session import table


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item_text"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as laid-out blocks: 40 lines a page, some pages in two columns, feet set apart."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    row = F.col("pos") % 40
    lines = lines.withColumn("page", F.floor(F.col("pos") / 40).cast("int") + 1)
    lines = lines.withColumn("x0", F.lit(50.0) + F.when((F.col("doc_id") % 3 == 0) & (F.col("pos") % 2 == 1), 260.4).otherwise(0.0) + F.when((F.col("doc_id") % 7 == 0) & (F.col("pos") % 5 == 4), 410.0).otherwise(0.0))
    lines = lines.withColumn("y0", F.lit(60.0) + row * 16 + F.when(row >= 6, (F.col("doc_id") % 4) * 40.0).otherwise(0.0))
    return lines.withColumn("x1", F.col("x0") + F.least(F.length("text") * 2, F.lit(240)).cast("double")).withColumn("y1", F.col("y0") + 12.0)


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as verdicts: level from the type's length, confidence from the value."""
    n = F.length("event_type") % 3
    level = F.when(n == 0, "fully_compliant").when(n == 1, "partially_compliant").otherwise("non_compliant")
    return table(spark, sf_dir, "events").select("user_id", "event_id", level.alias("level"), F.least(F.floor(F.abs("value") * 50) / 10000, F.lit(1.0)).alias("confidence"), "event_type")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw model answers, well formed and not."""
    e = table(spark, sf_dir, "events")
    flag = F.when(F.col("event_id") % 2 == 0, "true").otherwise("false")
    conf = F.format_string("%.2f", F.least(F.floor(F.abs("value") / 2) / 100, F.lit(1.0)))
    level = F.get(F.array(*[F.lit(x) for x in ("fully_compliant", "partially_compliant", "non_compliant", "unknown")]), (F.col("event_id") % 4).cast("int"))
    subs = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit(', "sub_requirements": [{"requirement": "a", "covered": true}, {"requirement": "b", "covered": '), F.when(F.col("event_id") % 3 == 0, "true").otherwise("false"), F.lit("}]"))).otherwise("")
    good = F.concat(F.lit('{"type": "MappingRationale", "is_compliant": '), flag, F.lit(', "compliance_level": "'), level, F.lit('", "confidence_score": '), conf, F.lit(', "explanation": "'), F.col("event_type"), F.lit('"'), subs, F.lit("}"))
    k = F.col("event_id") % 11
    raw = (
        F.when(k == 1, F.concat(F.lit("```json\n"), good, F.lit("\n```")))
        .when(k == 2, F.concat(F.lit("Here you are: "), good, F.lit(" as asked.")))
        .when(k == 3, F.lit('{"type": "InsufficientEvidence", "reason": "none", "required_context": "more"}'))
        .when(k == 4, F.lit('{"type": "InsufficientEvidence", "reason": "none"}'))
        .when(k == 5, F.lit("no json at all"))
        .when(k == 6, F.lit('{"type": "Other"}'))
        .when(k == 7, F.concat(F.substring(good, F.lit(1), F.length(good) - 3)))
        .otherwise(good)
    )
    return e.select("event_id", "user_id", raw.alias("raw"))
