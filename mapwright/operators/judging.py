"""Model judgements as DataFrame stages around a replaceable Judge.

A judge is ``answer(prompts) -> texts`` for one batch; ReplayJudge answers from a
table of recorded texts, LexicalJudge from word overlap, HttpJudge asks a server. Work that
needs no judge is kept away from it: short chunks, repeated chunks, governance
requirements that a pattern tells, prompts whose answer is cached. Answers are written to the
shared folder before they are used, so a lost executor asks nothing twice.
"""

from __future__ import annotations

import json
import re
import time
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from mapwright.functions import constants as K
from mapwright.functions import text as T
from mapwright.operators import verdicts as V
from mapwright.operators.prompts import numbered, prompt, with_source
from mapwright.operators.store import AnswerCache, with_cache
from mapwright.scratch import Scratch


class Judge(Protocol):
    def answer(self, prompts: list[str]) -> list[str | None]: ...


class ReplayJudge:
    """Recorded answers by prompt."""

    def __init__(self, answers: dict[str, str]):
        self.answers = answers

    def answer(self, prompts: list[str]) -> list[str | None]:
        return [self.answers.get(p) for p in prompts]


class LexicalJudge:
    """A deterministic stand-in: confidence is the share of the control's words that a text holds.

    It answers every prompt of operators.prompts; no control governs others, and a gap is certain.
    """

    def answer(self, prompts: list[str]) -> list[str | None]:
        return [self._one(p) for p in prompts]

    @staticmethod
    def _parts(prompt: str) -> dict[str, str]:
        return {h.strip(): t.strip("\n") for h, t in re.findall(r"(?s)(?:^|\n)## ([^\n]+)\n(.*?)(?=\n## |\Z)", prompt)}

    def _one(self, prompt: str) -> str:
        parts = self._parts(prompt)
        if "Controls" in parts:
            return json.dumps([{"control_index": i, "is_meta": False} for i in range(parts["Controls"].count("### Control "))])
        words = {w for w in re.findall(r"\w+", parts.get("Control", "").lower()) if len(w) > 3}
        if "Policy texts" in parts:
            chunks = re.split(r"(?:^|\n)### Chunk \d+\n", parts["Policy texts"])[1:]
            return json.dumps([{"chunk_index": i, **self._verdict(words, c)} for i, c in enumerate(chunks)])
        if "Policy text" in parts:
            found = self._verdict(words, parts["Policy text"])
            return json.dumps({"relevant": found["type"] == V.RATIONALE} if '"relevant"' in parts["Answer"] else found)
        if "is_meta" in parts.get("Answer", ""):
            return json.dumps({"is_meta": False})
        return json.dumps({"type": V.RATIONALE, "is_compliant": False, "compliance_level": V.NONE, "confidence_score": 1.0, "explanation": f"No text holds any of {len(words)} words."})

    @staticmethod
    def _verdict(words: set[str], chunk: str) -> dict:
        held = words & set(re.findall(r"\w+", re.sub(r"^\[Source: [^\n]*\]\n", "", chunk).lower()))
        share = round(len(held) / len(words), 4) if words else 0.0
        if share < 0.2:
            return {"type": V.INSUFFICIENT, "reason": "Few words in common.", "required_context": "Text on the control's subject."}
        level = V.FULL if share >= 0.8 else V.PARTIAL if share >= 0.4 else V.NONE
        return {"type": V.RATIONALE, "is_compliant": level != V.NONE, "compliance_level": level, "confidence_score": share, "explanation": f"{len(held)} of {len(words)} words.", "sub_requirements": []}


class HttpJudge:
    """A server with a generate endpoint that takes {model, prompt, stream, options} and returns {response}.

    Prompts whose answer is one object are sent with format "json", which holds the server to JSON.
    """

    def __init__(self, url: str, model: str, timeout: float = 120.0, retries: int = 2):
        self.url, self.model, self.timeout, self.retries = url, model, timeout, retries

    def answer(self, prompts: list[str]) -> list[str | None]:
        return [self._one(p) for p in prompts]

    def _one(self, prompt: str) -> str | None:
        asked = {"model": self.model, "prompt": prompt, "stream": False, "options": {"temperature": 0}}
        if "A JSON array" not in prompt:
            asked["format"] = "json"
        body = json.dumps(asked).encode()
        for attempt in range(self.retries + 1):
            try:
                with urllib.request.urlopen(urllib.request.Request(self.url, body, {"Content-Type": "application/json"}), timeout=self.timeout) as got:
                    return json.loads(got.read())["response"]
            except (OSError, ValueError, KeyError):
                time.sleep(min(2**attempt, 10))
        return None

    def is_available(self) -> bool:
        try:
            with urllib.request.urlopen(self.url.rsplit("/api", 1)[0], timeout=5):
                return True
        except OSError:
            return False


def holds_array(answer: str | None) -> bool:
    """Whether an answer has a JSON array, from its first to its last bracket."""
    return _parses(answer, "[", "]", list)


def holds_object(answer: str | None) -> bool:
    return _parses(answer, "{", "}", dict)


def _parses(answer: str | None, first: str, last: str, kind: type) -> bool:
    text = answer or ""
    try:
        return isinstance(json.loads(text[text.index(first) : text.rindex(last) + 1]), kind)
    except ValueError:
        return False


def ask(frame: DataFrame, prompt: str, judge: Judge, out: str = "answer", batch: int = 32, usable: Callable[[str | None], bool] | None = None, attempts: int = 1) -> DataFrame:
    """Adds the judge's answers; those that ``usable`` refuses are asked for again, ``attempts`` times in all."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            prompts, got = part[prompt].tolist(), {}
            todo = [*range(len(prompts))]
            for _ in range(attempts):
                for i in range(0, len(todo), batch):
                    some = todo[i : i + batch]
                    got.update(zip(some, judge.answer([prompts[j] for j in some]), strict=True))
                todo = [j for j in todo if usable and not usable(got[j])]
            part[out] = [got[j] for j in range(len(prompts))]
            yield part

    return frame.mapInPandas(run, StructType([*frame.schema.fields]).add(out, StringType()))


def ask_cached(frame: DataFrame, prompt: str, judge: Judge, model: str, cache: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(frame with answer, new cache rows): only prompts without a cached response reach the judge."""
    keyed = with_cache(frame.withColumn("model", F.lit(model)), cache, "model", prompt)
    known = keyed.where("hit").withColumn("answer", F.col("response"))
    fresh = ask(keyed.where("not hit"), prompt, judge, **options)
    news = fresh.where(F.col("answer").isNotNull()).groupBy("key").agg(F.min("answer").alias("response"))
    return known.unionByName(fresh).drop("response", "model"), news


class Desk:
    """Where stages ask: one judge, an optional cache that it adds to, and a folder that keeps all answers."""

    def __init__(self, judge: Judge, scratch: Scratch, cache: AnswerCache | None = None, model: str = ""):
        self.judge, self.scratch, self.cache, self.model, self.asked = judge, scratch, cache, model, 0

    def ask(self, frame: DataFrame, **options) -> DataFrame:
        """``frame`` (with a column prompt) and answer, as written to the shared folder."""
        self.asked += 1
        name = f"answers-{self.asked}"
        if self.cache is None:
            return self.scratch.keep(ask(frame, "prompt", self.judge, **options), name)
        both, _ = ask_cached(frame, "prompt", self.judge, self.model, self.cache.read(), **options)
        kept = self.scratch.keep(both, name)
        counts = kept.agg(F.count_if("hit").alias("hits"), F.count("*").alias("n")).first()
        self.cache.hits += counts["hits"]
        self.cache.misses += counts["n"] - counts["hits"]
        self.cache.put(kept.where("not hit and answer is not null").groupBy("key").agg(F.min("answer").alias("response")))
        return kept.drop("hit", "key")


def evaluate_each(frame: DataFrame, keys: list[str], texts: str, desk: Desk) -> DataFrame:
    """One question for each text: (keys, pos, verdict); insufficient evidence after three unusable answers."""
    each = frame.select(*keys, "control_text", "requirement_family", F.posexplode(texts).alias("pos", "text"))
    asked = desk.ask(each.withColumn("prompt", prompt("merged_relevance_rationale", control_text=F.col("control_text"), requirement_family=F.col("requirement_family"), chunk_text=F.col("text"))).select(*keys, "pos", "prompt"), usable=holds_object, attempts=3)
    return asked.select(*keys, "pos", F.coalesce(V.parse_answer(F.col("answer")), V.insufficient(K.RETRIES_SPENT)).alias("verdict"))


def evaluate_batches(frame: DataFrame, keys: list[str], texts: str, desk: Desk) -> tuple[DataFrame, DataFrame]:
    """One question for all texts of a control: (keys, pos, verdict) and (keys, pos, requirement, covered).

    An answer without an array is asked for once more; controls that still have none are
    asked about each text by itself, and have no sub-requirements.
    """
    full = frame.withColumn("n_asked", F.size(texts)).where("n_asked > 0")
    question = prompt("batch_evaluation", control_text=F.col("control_text"), requirement_family=F.col("requirement_family"), chunk_count=F.col("n_asked"), numbered_chunks=numbered("Chunk", F.col(texts)))
    asked = desk.ask(full.withColumn("prompt", question), usable=holds_array, attempts=2)
    good = V.batch_usable(F.col("answer"))
    batch = V.parse_batch(asked.where(good), "answer", "n_asked", keys).select(*keys, "pos", "verdict")
    alone = evaluate_each(asked.where(~good), keys, texts, desk)
    return batch.unionByName(alone), V.batch_sub_requirements(asked.where(good), "answer", "n_asked", keys)


def check_relevance(frame: DataFrame, desk: Desk, out: str = "relevant") -> DataFrame:
    """Adds whether a text (chunk_text) is direct evidence; kept where the answer can't be read."""
    question = prompt("relevance_check", control_text=F.col("control_text"), requirement_family=F.col("requirement_family"), chunk_text=F.col("chunk_text"))
    return desk.ask(frame.withColumn("prompt", question)).withColumn(out, T.truth(F.col("answer"), "relevant", True)).drop("prompt", "answer")


def classify_controls(frame: DataFrame, desk: Desk, out: str = "is_meta") -> DataFrame:
    """Adds whether a control governs others, one question each; false where the answer can't be read."""
    question = prompt("meta_classification", control_text=F.col("control_text"))
    return desk.ask(frame.withColumn("prompt", question)).withColumn(out, T.truth(F.col("answer"), "is_meta", False)).drop("prompt", "answer")


def classify_in_batches(frame: DataFrame, keys: list[str], desk: Desk, batch: int = 50) -> DataFrame:
    """(keys, is_meta) of controls, asked about in batches of ``batch`` in the mean."""
    n = max(1, -(-frame.count() // batch))
    dealt = frame.withColumn("batch", F.pmod(F.xxhash64(*keys), F.lit(n)))
    placed = dealt.withColumn("pos", F.row_number().over(W.partitionBy("batch").orderBy(*keys)) - 1)
    texts = placed.groupBy("batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "control_text"))), lambda x: x["control_text"]).alias("texts"))
    question = prompt("batch_meta_classification", control_count=F.size("texts"), numbered_controls=numbered("Control", F.col("texts")))
    asked = desk.ask(texts.select("batch", F.size("texts").alias("n"), question.alias("prompt")))
    flags = V.batch_flags(asked, "answer", "n", ["batch"])
    return placed.join(flags, ["batch", "pos"]).select(*keys, "is_meta")


def gap_rationales(frame: DataFrame, keys: list[str], desk: Desk) -> DataFrame:
    """(keys, verdict) of controls without evidence; answers that aren't rationales give none."""
    asked = desk.ask(frame.select(*keys, prompt("gap_rationale", control_text=F.col("control_text")).alias("prompt")))
    return asked.select(*keys, V.parse_answer(F.col("answer")).alias("verdict")).where(F.col("verdict.kind") == V.RATIONALE)


def rationales(frame: DataFrame, keys: list[str], desk: Desk) -> DataFrame:
    """Adds the verdict of one text (chunk_text) on one control."""
    question = prompt("compliance_rationale", control_text=F.col("control_text"), chunk_text=F.col("chunk_text"))
    return desk.ask(frame.withColumn("prompt", question)).withColumn("verdict", V.parse_answer(F.col("answer"))).drop("prompt", "answer")


def _rationale(is_compliant: Column, level: Column, confidence: Column, explanation: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(V.RATIONALE).alias("kind"), is_compliant.alias("is_compliant"), level.alias("compliance_level"), confidence.alias("confidence_score"), explanation.alias("explanation"), none.alias("reason"), none.alias("required_context"))


def enrich(mapped: DataFrame, judge: Judge, fast: Judge | None = None, cache: AnswerCache | None = None, models: tuple[str, str] = ("primary", "fast")) -> DataFrame:
    """Verdicts for mapped controls.

    ``mapped`` has control_id, framework, title, description, chunks (structs with
    document_name, section_header, raw_text) and, if known, requirement_family and a place ``pos``.
    In order: short and repeated chunks go; controls that no pattern calls governing have all their
    chunks evaluated; the fast judge says which others govern, and explains controls without
    evidence; governing ones take their verdict from siblings. Adds is_meta, chunks that
    count, level, confidence, the family-resolved verdict, and all of it as ``rationale``.
    """
    scratch = Scratch(mapped.sparkSession, "enrich")
    desk, quick = Desk(judge, scratch, cache, models[0]), Desk(fast or judge, Scratch(mapped.sparkSession, "enrich-fast"), cache, models[1])
    keys = ["framework", "control_id"]
    enough = F.filter("chunks", lambda c: F.length(T.strip(c["raw_text"])) >= 30)
    key = lambda c: F.struct(c["document_name"], c["section_header"], F.substring(c["raw_text"], 1, 100))
    firsts = F.transform("chunks", key)
    frame = mapped.withColumn("chunks", enough).withColumn("by_rule", T.is_meta(F.col("description")))
    frame = frame.withColumn("chunks", F.when(F.col("by_rule"), F.col("chunks")).otherwise(F.filter("chunks", lambda c, i: F.array_position(firsts, key(c)) == i + 1)))
    frame = frame.withColumn("control_text", T.prompt_text(F.col("control_id"), F.col("title"), F.col("description")))
    for c, made in (("requirement_family", F.lit("")), ("pos", F.xxhash64(*keys))):
        frame = frame if c in frame.columns else frame.withColumn(c, made)
    frame = scratch.keep(frame.withColumn("texts", F.transform("chunks", with_source)), "controls")

    each, subs = evaluate_batches(frame.where("not by_rule").select(*keys, "control_text", "requirement_family", "texts"), keys, "texts", desk)
    each = scratch.keep(each.where(F.col("verdict.kind") == V.RATIONALE), "rationales")
    ck = F.struct(*keys).alias("ck")
    votes = each.select(ck, "pos", F.col("verdict.compliance_level").alias("level"), F.col("verdict.confidence_score").alias("confidence"))
    told = subs.join(each.select(*keys, "pos"), [*keys, "pos"], "left_semi").select(ck, "pos", "requirement", "covered")
    best = V.best_rationale(votes, "ck").select("ck", F.col("level").alias("voted"), F.col("pos").alias("best_pos"))
    covered = V.coverage(told, "ck").withColumnRenamed("level", "computed").join(told.groupBy("ck").agg(F.count_distinct("pos").alias("n_lists")), "ck")
    judged = V.aggregate_verdicts(votes, told, "ck").join(best, "ck").join(covered, "ck", "left").select(*[F.col(f"ck.{k}") for k in keys], "*").drop("ck")
    explained = judged.join(each.select(*keys, F.col("pos").alias("best_pos"), F.col("verdict.explanation").alias("own")), [*keys, "best_pos"])
    more = V.level_order(F.col("computed")) > V.level_order(F.col("voted"))
    text = F.when(~F.col("changed"), F.col("own")).when(more, T.filled(K.COMBINED_ALL, chunks=F.col("n_lists"), n=F.col("n_total"), texts=F.col("covered_texts")))
    text = text.otherwise(T.filled(K.COMBINED_SOME, chunks=F.col("n_lists"), covered=F.col("n_covered"), n=F.col("n_total"), texts=F.col("missing_texts")))
    verdict = explained.select(*keys, _rationale(F.col("is_compliant"), F.col("level"), F.col("confidence"), text).alias("verdict"))
    relevant = each.groupBy(*keys).agg(F.collect_set("pos").alias("relevant"))
    out = frame.drop("texts").join(verdict, keys, "left").join(relevant, keys, "left")
    kept = F.filter("chunks", lambda c, i: F.coalesce(F.array_contains("relevant", i), F.lit(False)))
    out = scratch.keep(out.withColumn("chunks", F.when(F.col("by_rule"), F.col("chunks")).otherwise(kept)).drop("relevant"), "judged")

    flags = classify_in_batches(out.where("not by_rule").select(*keys, "control_text"), keys, quick)
    gaps = gap_rationales(out.where(F.col("verdict").isNull() & (F.size("chunks") == 0)).select(*keys, "control_text"), keys, quick).withColumnRenamed("verdict", "gap")
    out = out.join(flags, keys, "left").join(gaps, keys, "left").withColumn("is_meta", F.col("by_rule") | F.coalesce("is_meta", F.lit(False)))
    out = out.withColumn("verdict", F.coalesce("verdict", "gap")).drop("gap", "by_rule")
    out = out.withColumn("level", F.col("verdict.compliance_level")).withColumn("confidence", F.col("verdict.confidence_score")).withColumn("is_compliant", F.col("verdict.is_compliant"))
    out = V.resolve_siblings(scratch.keep(out, "before-siblings"))
    inferred = _rationale(F.col("resolved_level") != V.NONE, F.col("resolved_level"), F.col("resolved_confidence"), F.col("explanation"))
    out = out.withColumn("rationale", F.when(F.col("explanation").isNotNull(), inferred).otherwise(F.col("verdict")))
    return out.withColumn("chunks", F.when(F.col("explanation").isNotNull(), F.slice("chunks", 1, 0)).otherwise(F.col("chunks"))).drop("verdict")


def extract_controls(segments: DataFrame, desk: Desk, keys: list[str], segment: str = "segment") -> DataFrame:
    """Requirements that a model finds in segments, as far as a segment holds them: (keys, section, raw_text, place)."""
    asked = desk.ask(segments.withColumn("prompt", prompt("control_extraction", segment=F.col(segment))), usable=holds_array, attempts=2)
    return verified_controls(asked, segment, "answer", keys)


def verified_controls(frame: DataFrame, segment: str, answer: str, keys: list[str]) -> DataFrame:
    """Controls that a model extracted from a segment, without those that the segment doesn't hold.

    Rows (keys, section, raw_text, place), at least 50 characters, by where they stand in the segment.
    """
    items = F.from_json(T.json_array(F.col(answer)), "array<struct<section:string,text:string>>")
    each = frame.select(*keys, T.squeeze(F.col(segment)).alias("seg"), F.explode(items).alias("x")).select(*keys, "seg", F.nullif(T.strip(F.coalesce("x.section", F.lit(""))), F.lit("")).alias("section"), T.strip(F.coalesce("x.text", F.lit(""))).alias("raw_text"))
    place = F.expr("locate(needle60, seg)")
    each = each.withColumn("needle60", T.squeeze(F.substring("raw_text", 1, 60))).withColumn("needle30", T.squeeze(F.substring("raw_text", 1, 30)))
    held = each.where((F.length("raw_text") >= 50) & F.expr("locate(needle30, seg) > 0"))
    return held.select(*keys, "section", "raw_text", F.when(place > 0, place - 1).otherwise(F.length("seg")).alias("place"))
