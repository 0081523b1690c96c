"""Verdicts: parsing model answers, voting, coverage, sibling resolution, clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mapwright.functions import constants as K
from mapwright.functions import text as T

RATIONALE = "MappingRationale"
INSUFFICIENT = "InsufficientEvidence"
ANSWER = "type string, is_compliant boolean, compliance_level string, confidence_score double, explanation string, reason string, required_context string, sub_requirements array<struct<requirement:string,covered:boolean,evidence:string>>"
FULL, PARTIAL, NONE = K.LEVELS


def level_order(level: Column) -> Column:
    return F.when(level == FULL, 3).when(level == PARTIAL, 2).when(level == NONE, 1).otherwise(0)


def consistent_level(is_compliant: Column, level: Column) -> Column:
    """The level that goes with the flag; a partial level is left alone."""
    level = F.coalesce(level, F.lit(NONE))
    return F.when(is_compliant & (level == NONE), FULL).when(~is_compliant & (level == FULL), NONE).otherwise(level)


def floored(level: Column, confidence: Column) -> Column:
    return F.when((level == FULL) & (confidence < K.CONFIDENCE_FLOOR), PARTIAL).otherwise(level)


def parse_answer(raw: Column) -> Column:
    """A model's answer as a struct (kind, is_compliant, compliance_level, confidence_score, explanation, reason, required_context), null if unusable."""
    # Arrays of one element bind the text and its parsed form, so that each is made once.
    read = F.transform(F.array(T.json_object(raw)), lambda t: F.struct(F.from_json(t, ANSWER).alias("a"), (F.try_parse_json(t).isNotNull() & t.startswith("{")).alias("valid")))
    return F.get(F.transform(read, lambda x: F.when(x["valid"], _verdict(x["a"]))), F.lit(0))


def _verdict(a: Column) -> Column:
    none = lambda t: F.lit(None).cast(t)

    def made(kind, comp, level, conf, expl, reason, context):
        return F.struct(F.lit(kind).alias("kind"), comp.alias("is_compliant"), level.alias("compliance_level"), conf.alias("confidence_score"), expl.alias("explanation"), reason.alias("reason"), context.alias("required_context"))

    def lacking(reason: Column, context: Column) -> Column:
        return made(INSUFFICIENT, none("boolean"), none("string"), none("double"), none("string"), reason, context)

    subs = a["sub_requirements"]
    n, covered = F.size(subs), F.size(F.filter(subs, lambda s: F.coalesce(s["covered"], F.lit(False))))
    counted = F.when(covered == n, FULL).when(covered > 0, PARTIAL).otherwise(NONE)
    has_subs = subs.isNotNull() & (n > 0)
    given = F.when(a["compliance_level"].isin(*K.LEVELS), a["compliance_level"])
    comp = F.when(has_subs, counted != NONE).otherwise(a["is_compliant"])
    level = consistent_level(comp, F.when(has_subs, counted).otherwise(given))
    usable = a["is_compliant"].isNotNull() & a["confidence_score"].isNotNull() & a["explanation"].isNotNull() & a["confidence_score"].between(0, 1)
    final = floored(level, a["confidence_score"])
    rationale = made(RATIONALE, F.when(final != level, F.lit(True)).otherwise(comp), final, a["confidence_score"], a["explanation"], none("string"), none("string"))
    zero = lacking(F.coalesce(F.nullif(a["explanation"], F.lit("")), F.lit(K.ZERO_CONFIDENCE[0])), F.lit(K.ZERO_CONFIDENCE[1]))
    return F.when(a["type"] == RATIONALE, F.when(usable & (a["confidence_score"] == 0), zero).when(usable, rationale)).when(
        a["type"] == INSUFFICIENT, F.when(a["reason"].isNotNull() & a["required_context"].isNotNull(), lacking(a["reason"], a["required_context"]))
    ).otherwise(lacking(*map(F.lit, K.UNKNOWN_TYPE)))


def insufficient(why: tuple[Column | str, Column | str]) -> Column:
    """A verdict of insufficient evidence with a reason and what would be needed."""
    reason, context = (F.lit(x) if isinstance(x, str) else x for x in why)
    return F.struct(F.lit(INSUFFICIENT).alias("kind"), F.lit(None).cast("boolean").alias("is_compliant"), F.lit(None).cast("string").alias("compliance_level"), F.lit(None).cast("double").alias("confidence_score"), F.lit(None).cast("string").alias("explanation"), reason.alias("reason"), context.alias("required_context"))


def parse_batch(frame: DataFrame, raw: str, expected: str, keys: list[str]) -> DataFrame:
    """Rows (keys, pos, verdict) for each expected answer of a batch, by place in the array.

    Rows whose answer holds no JSON array give none. Elements that can't be used,
    and missing ones, count as insufficient evidence; surplus ones are dropped.
    """
    text = T.json_array(F.col(raw))
    items = F.from_json(text, "array<string>")
    got = frame.withColumn("items", items).where(F.col("items").isNotNull() & F.try_parse_json(text).isNotNull())
    each = got.where(F.col(expected) > 0).select(*keys, "items", F.explode(F.sequence(F.lit(0), F.col(expected) - 1)).alias("pos"))
    item = F.get("items", F.col("pos"))
    reason = F.when(F.col("pos") >= F.size("items"), K.MISSING_ELEMENT[0]).when(~item.startswith("{") | item.isNull(), K.NO_OBJECT[0]).otherwise(K.UNPARSED_ELEMENT[0])
    context = F.when(F.col("pos") >= F.size("items"), K.MISSING_ELEMENT[1]).when(~item.startswith("{") | item.isNull(), K.NO_OBJECT[1]).otherwise(K.UNPARSED_ELEMENT[1])
    return each.withColumn("verdict", F.coalesce(F.when(item.startswith("{"), parse_answer(item)), insufficient((reason, context)))).drop("items")


def batch_usable(raw: Column) -> Column:
    """Whether a batch answer holds a JSON array."""
    text = T.json_array(raw)
    return F.coalesce(F.from_json(text, "array<string>").isNotNull() & F.try_parse_json(text).isNotNull(), F.lit(False))


def batch_sub_requirements(frame: DataFrame, raw: str, expected: str, keys: list[str]) -> DataFrame:
    """Rows (keys, pos, requirement, covered) of the sub-requirements in the first ``expected`` elements of a batch answer.

    Elements are read one by one: what isn't an object, or holds no list, has none, and takes none from the others.
    """
    items = frame.where(batch_usable(F.col(raw))).select(*keys, F.col(expected).alias("_most"), F.posexplode(F.from_json(T.json_array(F.col(raw)), "array<string>")).alias("pos", "item"))
    lists = items.where((F.col("pos") < F.col("_most")) & F.col("item").startswith("{")).select(*keys, "pos", F.get_json_object("item", "$.sub_requirements").alias("subs"))
    each = lists.where(F.col("subs").startswith("[")).select(*keys, "pos", F.explode(F.from_json("subs", "array<string>")).alias("sub")).where(F.col("sub").startswith("{"))
    covered = F.coalesce(F.get_json_object("sub", "$.covered") == "true", F.lit(False))
    return each.select(*keys, "pos", F.coalesce(F.get_json_object("sub", "$.requirement"), F.lit("")).alias("requirement"), covered.alias("covered"))


def batch_flags(frame: DataFrame, raw: str, n: str, keys: list[str]) -> DataFrame:
    """Rows (keys, pos, is_meta) of a batch classification; whatever is missing is false."""
    items = F.from_json(T.json_array(F.col(raw)), "array<struct<control_index:int,is_meta:boolean>>")
    flagged = F.exists(F.coalesce(items, F.array().cast("array<struct<control_index:int,is_meta:boolean>>")), lambda i: (i["control_index"] == F.col("pos")) & F.coalesce(i["is_meta"], F.lit(False)))
    return frame.where(F.col(n) > 0).select("*", F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("pos")).select(*keys, "pos", F.coalesce(flagged, F.lit(False)).alias("is_meta"))


def best_rationale(votes: DataFrame, key: str, level: str = "level", confidence: str = "confidence", pos: str = "pos") -> DataFrame:
    """Plurality of levels, ties to the lower one; within it the highest confidence, first at ties: (key, level, confidence, pos, n_votes)."""
    per = votes.groupBy(key, level).agg(F.count("*").alias("n_votes"), F.max_by(F.struct(F.col(confidence).alias("confidence"), F.col(pos).alias("pos")), F.struct(F.col(confidence), -F.col(pos))).alias("best"))
    won = F.min_by(F.struct(F.col(level).alias("level"), "n_votes", "best"), F.struct(-F.col("n_votes"), level_order(F.col(level))))
    return per.groupBy(key).agg(won.alias("w")).select(key, F.col("w.level").alias("level"), F.col("w.best.confidence").alias("confidence"), F.col("w.best.pos").alias("pos"), F.col("w.n_votes").alias("n_votes"))


def coverage(subs: DataFrame, key: str, requirement: str = "requirement", covered: str = "covered", pos: str = "pos") -> DataFrame:
    """Union of sub-requirements of a control: (key, n_total, n_covered, level, covered_texts, missing_texts)."""
    rows = subs.withColumn("norm", T.requirement_key(F.col(requirement))).where("norm <> ''")
    merged = rows.groupBy(key, "norm").agg(F.coalesce(F.bool_or(F.col(covered)), F.lit(False)).alias("met"), F.min_by(F.col(requirement), F.col(pos)).alias("first_text"), F.min(pos).alias("first_pos"))
    listed = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("first_pos", "first_text")))), lambda x: x["first_text"]), "; ")
    out = merged.groupBy(key).agg(F.count("*").alias("n_total"), F.count_if("met").alias("n_covered"), listed(F.col("met")).alias("covered_texts"), listed(~F.col("met")).alias("missing_texts"))
    return out.withColumn("level", F.when(F.col("n_covered") == F.col("n_total"), FULL).when(F.col("n_covered") > 0, PARTIAL).otherwise(NONE))


def aggregate_verdicts(votes: DataFrame, subs: DataFrame, key: str) -> DataFrame:
    """Votes corrected by sub-requirement coverage: (key, level, is_compliant, confidence, changed)."""
    best, met = best_rationale(votes, key), coverage(subs, key).select(key, F.col("level").alias("computed"))
    out = best.join(met, key, "left").withColumn("changed", F.coalesce(F.col("computed") != F.col("level"), F.lit(False)))
    level = F.when(F.col("computed").isNull(), F.col("level")).otherwise(floored(F.col("computed"), F.col("confidence")))
    return out.select(key, level.alias("level"), (level != NONE).alias("is_compliant"), "confidence", "changed")


def hundredths(x: Column) -> Column:
    """A double from 0 to 1 rounded to two places by its exact binary value, exact halves to even."""
    # Scaled by a power of two the value is a whole number; decimals then compare without error.
    whole = (x * F.lit(float(1 << 60))).cast("bigint").cast("decimal(38,0)") * F.lit(100).cast("decimal(3,0)")
    one = F.lit(1 << 60).cast("decimal(19,0)")
    read = F.transform(F.array(whole.cast("decimal(38,0)")), lambda n: F.struct(((n - F.pmod(n, one)) / one).cast("bigint").alias("q"), F.pmod(n, one).alias("rest")))
    up = lambda v: (v["rest"] * 2 > one) | ((v["rest"] * 2 == one) & (v["q"] % 2 == 1))
    return F.get(F.transform(read, lambda v: (v["q"] + F.when(up(v), 1).otherwise(0)) / F.lit(100.0)), F.lit(0))


def resolve_siblings(results: DataFrame, key: str = "control_id", meta: str = "is_meta", level: str = "level", confidence: str = "confidence", order: str = "pos") -> DataFrame:
    """Governance requirements take their verdict from evaluated siblings of their family.

    Adds resolved_level, resolved_confidence, explanation. Rows that are not governance
    requirements, or have no evaluated sibling, keep their own.
    """
    frame = results.withColumn("family", T.family_of(F.col(key)))
    told = frame.where(~F.col(meta) & F.col(level).isNotNull())
    ids = lambda v: F.transform(F.array_sort(F.collect_list(F.when(F.col(level) == v, F.struct(F.col(order), F.col(key))))), lambda x: x[key])
    # Summed in order, so that the last bits of a mean don't depend on partitioning.
    mean = F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(confidence).cast("double").alias("c")))), lambda x: x["c"]), F.lit(0.0), lambda a, x: a + x) / F.count("*")
    per = told.groupBy("family").agg(F.count("*").alias("n"), F.count_if(F.col(level) == FULL).alias("n_full"), F.count_if(F.col(level) == NONE).alias("n_none"), mean.alias("mean"), ids(NONE).alias("none_ids"), ids(PARTIAL).alias("partial_ids"))
    out = frame.join(per, "family", "left")
    takes = F.col(meta) & F.col("n").isNotNull()
    all_none, all_full = F.col("n_none") == F.col("n"), F.col("n_full") == F.col("n")
    text = (
        F.when(all_none, T.filled(K.SIBLINGS_NONE, n=F.col("n"), family=F.col("family"), ids=F.array_join("none_ids", ", ")))
        .when(all_full, T.filled(K.SIBLINGS_FULL, n=F.col("n"), family=F.col("family")))
        .otherwise(T.filled(K.SIBLINGS_MIXED, full=F.col("n_full"), n=F.col("n"), family=F.col("family"), ids=F.array_join(F.concat("none_ids", "partial_ids"), ", ")))
    )
    resolved = F.when(all_none, NONE).when(all_full, FULL).otherwise(PARTIAL)
    rounded = hundredths(F.least("mean", F.lit(1.0)))
    return out.select(*results.columns, "family", F.when(takes, resolved).otherwise(F.col(level)).alias("resolved_level"), F.when(takes, F.when(all_none, 0.90).otherwise(rounded)).otherwise(F.col(confidence)).alias("resolved_confidence"), F.when(takes, text).alias("explanation"))


def first_chunks(frame: DataFrame, keys: list[str], text: str, order: str) -> DataFrame:
    """The first row of each (keys, first 100 characters)."""
    place = F.row_number().over(W.partitionBy(*keys, F.substring(F.col(text), 1, 100)).orderBy(order))
    return frame.withColumn("_n", place).where("_n = 1").drop("_n")


def long_enough(frame: DataFrame, text: str, least: int = 30) -> DataFrame:
    return frame.where(F.length(T.strip(F.col(text))) >= least)
