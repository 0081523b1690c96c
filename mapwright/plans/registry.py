"""All queries of the engine by name, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mapwright.functions import text as T
from mapwright.operators import chunking as C
from mapwright.operators import evaluation as E
from mapwright.operators import export as X
from mapwright.operators import harmonize as H
from mapwright.operators import judging as J
from mapwright.operators import layout as L
from mapwright.operators import retrieval as R
from mapwright.operators import store as S
from mapwright.operators import verdicts as V
from mapwright.plans import tables as I
from mapwright.plans.oracle import SQL
from mapwright.scratch import Scratch
from mapwright.session import table
from mapwright.sources.catalog import flatten_catalogs, page_texts, read_chunks, read_golden

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def six(name: str):
    return F.round(name, 6).alias(name)


@query
def tokenize_counts(s, d):
    t = T.tokens(F.col("text"))
    return I.chunks(s, d).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query
def sentence_split(s, d):
    return I.chunks(s, d).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


@query
def bm25_topk(s, d):
    return R.bm25_top(I.chunks(s, d), I.controls(s, d), "doc_id", "text", "item_id", "item_text", 5).select("item_id", "doc_id", six("score"), "rank")


def _vectors(s, d, **where):
    e = table(s, d, "embeddings")
    return R.vector_top(e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), "vec_id", "embedding", "query_id", "embedding", 5, where).select("query_id", "vec_id", six("score"), "rank")


@query
def vector_topk(s, d):
    return _vectors(s, d)


@query
def vector_topk_filtered(s, d):
    return _vectors(s, d, label=3)


def _ranks(s, d, k):
    docs, items = I.chunks(s, d), I.controls(s, d)
    key = R.bm25_top(docs, items, "doc_id", "text", "item_id", "item_text", 2 * k)
    vec = R.vector_top(R.embed(docs, "text", "vec"), R.embed(items, "item_text", "vec"), "doc_id", "vec", "item_id", "vec", 2 * k)
    return vec, key


@query
def rrf_fusion(s, d):
    return R.fuse(*_ranks(s, d, 5), "item_id", "doc_id", 5).select("item_id", "doc_id", six("rrf"), six("score"), "rank")


def _mapped(s, d):
    return R.map_controls(I.chunks(s, d), I.controls(s, d), "doc_id", "text", "item_id", "item_text", 3)


@query
def map_controls(s, d):
    return _mapped(s, d).select("item_id", "doc_id", six("score"), "rank")


@query
def query_expansion(s, d):
    seeds = ["Protect Information at Rest and audit events", "physical access control for visitors", "nothing to add", "Shared user IDs are revoked; flow enforcement is documented"]
    seeded = s.createDataFrame([(-i - 1, t) for i, t in enumerate(seeds)], "item_id long, item_text string")
    every = I.controls(s, d).unionByName(seeded)
    family = F.when(F.col("item_id") % 2 == 0, "Access").otherwise("")
    return every.select("item_id", T.expand_query(T.with_family(family, F.col("item_text"))).alias("query"))


@query
def embedding_queries(s, d):
    """What controls are looked up by, in both lists."""
    family = F.when(F.col("item_id") % 3 == 0, "Physical access").otherwise("")
    return R.control_queries(I.controls(s, d).withColumn("family", family), "item_text", "family").select("item_id", "keyword_query", "vector_query")


@query
def trailing_words(s, d):
    """Lines that end within a clause; some have their full stop taken."""
    lines = I.chunks(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    cut = F.when(F.col("pos") % 4 == 0, F.concat(F.col("line"), F.lit(" and the."))).when(F.col("pos") % 4 == 1, F.concat(F.col("line"), F.lit(" THEREOF")))
    return lines.select("doc_id", "pos", T.ends_with_trailing_word(F.coalesce(cut, F.col("line"))).alias("open"))


@query
def chunk_files(s, d):
    """Documents written as chunk lines, some of them no chunks, and read back with what is wrong."""
    k = F.col("doc_id") % 5
    row = F.struct(F.when(k != 3, F.col("doc_id").cast("string")).alias("chunk_id"), F.col("source").alias("document_name"), F.when(k == 2, 0).otherwise(1).alias("page_number"), F.when(k == 1, F.substring("text", 1, 20)).otherwise(F.col("text")).alias("raw_text"))
    lines = table(s, d, "documents").select(F.when(k == 4, F.concat(F.lit("not json "), F.col("doc_id"))).otherwise(F.to_json(row)))
    path = Scratch(s, "chunks").path("lines")
    lines.write.text(path)
    return read_chunks(s, path, strict=False).groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count("*").alias("n"))


@query
def golden_files(s, d):
    """Items written as a golden set, read back in its order."""
    one = F.struct(F.col("item_text").alias("query"), F.array(F.col("item_id").cast("string")).alias("expected_ids"))
    whole = I.controls(s, d).agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("item_id", one.alias("q")))), lambda x: x["q"]).alias("queries"))).alias("value"))
    path = Scratch(s, "golden").path("set")
    whole.coalesce(1).write.text(path)
    return read_golden(s, path).select("ordinal", F.md5(F.col("query").cast("binary")).alias("query_md5"), F.array_join("expected_ids", ",").alias("expected"))


@query
def all_chunks(s, d):
    """The store's chunks in order of extraction."""
    e = table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "label", "embedding", (-F.col("vec_id")).alias("extraction_order"))
    store = S.ChunkStore(s, Scratch(s, "store").path("chunks"))
    store.index("vectors", e)
    rows = store.all_chunks("vectors")
    return rows.select("chunk_id", "label", F.row_number().over(W.orderBy("extraction_order", "chunk_id")).alias("place"))


@query
def read_flags(s, d):
    """Flags in answers about relevance and governance, readable and not."""
    k = F.col("event_id") % 7
    raw = F.when(k == 0, '{"flag": true}').when(k == 1, 'Here: {"flag": false}.').when(k == 2, '{"flag": "yes"}').when(k == 3, "{}").when(k == 4, "no answer").when(k == 5, '{"flag": 0}').otherwise('{"flag": tr')
    e = table(s, d, "events").select("event_id", raw.alias("raw"))
    return e.select("event_id", T.truth(F.col("raw"), "flag", True).alias("relevant"), T.truth(F.col("raw"), "flag", False).alias("is_meta"))


@query
def evaluation_handoff(s, d):
    """Items with the texts of their best documents, by content hash."""
    docs, items = I.chunks(s, d), I.controls(s, d)
    best = R.bm25_top(docs, items, "doc_id", "text", "item_id", "item_text", 3).join(docs, "doc_id")
    out = E.handoff(items, best, "item_id", "item_text", "text", "rank")
    return out.select("item_id", F.md5(F.array_join("contexts", "|").cast("binary")).alias("contexts_md5"), F.size("contexts").cast("long").alias("n"), (F.col("question") == F.col("ground_truth")).alias("same"))


@query
def vote_best_rationale(s, d):
    best = V.best_rationale(I.votes(s, d), "user_id", pos="event_id")
    level = V.floored(F.col("level"), F.col("confidence"))
    return best.select("user_id", "level", level.alias("final_level"), F.round("confidence", 4).alias("confidence"), F.col("pos").alias("event_id"), "n_votes")


def _subs(s, d):
    e = I.votes(s, d)
    text = F.concat(F.lit("  Req "), F.upper("event_type"), F.lit("   no"), (F.col("event_id") % 3).cast("string"), F.when(F.col("event_id") % 2 == 0, F.lit(".;")).otherwise(F.lit(" ")))
    return e.select("user_id", "event_id", text.alias("requirement"), F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("confidence") > 0.4).alias("covered"))


@query
def subrequirement_coverage(s, d):
    return V.coverage(_subs(s, d), "user_id", pos="event_id")


@query
def aggregate_verdicts(s, d):
    votes = I.votes(s, d).withColumnRenamed("event_id", "pos")
    return V.aggregate_verdicts(votes, _subs(s, d).withColumnRenamed("event_id", "pos"), "user_id").withColumn("confidence", F.round("confidence", 4))


def _results(s, d):
    best = V.best_rationale(I.votes(s, d), "user_id", pos="event_id")
    cid = F.concat(F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("AC-"), F.col("user_id") % 100)).otherwise(F.concat((F.col("user_id") % 10).cast("string"), F.lit("."), F.col("user_id").cast("string"))))
    level = F.when(F.col("user_id") % 13 != 0, F.col("level"))
    return best.select(cid.alias("control_id"), (F.col("user_id") % 5 == 0).alias("is_meta"), level.alias("level"), (F.floor(F.col("confidence") * 200) / 200).alias("confidence"), F.col("user_id").alias("pos"))


@query
def sibling_resolution(s, d):
    return V.resolve_siblings(_results(s, d)).select("pos", "control_id", "family", "resolved_level", "resolved_confidence", "explanation")


@query
def meta_heuristic(s, d):
    seeds = ["All security policies and operational procedures for Requirement 3 are:\nDocumented.", "ROLES AND  RESPONSIBILITIES for performing activities in Requirement 8 are known", "all security policies exist"]
    seeded = s.createDataFrame([(-i - 1, t) for i, t in enumerate(seeds)], "item_id long, item_text string")
    return I.controls(s, d).unionByName(seeded).select("item_id", T.is_meta(F.col("item_text")).alias("is_meta"))


@query
def parse_verdicts(s, d):
    return I.answers(s, d).select("event_id", V.parse_answer(F.col("raw")).alias("v")).select("event_id", "v.*")


@query
def parse_batch_verdicts(s, d):
    rows = I.answers(s, d).withColumn("item", F.when(F.try_parse_json("raw").isNotNull() & F.col("raw").startswith("{"), F.col("raw")).otherwise(F.lit("17")))
    items = rows.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "item"))), lambda x: x["item"]).alias("items"))
    raw = F.concat(F.lit("Answer: ["), F.array_join("items", ","), F.lit("] end"))
    batches = items.select("user_id", (F.size("items") + F.col("user_id") % 3 - 1).cast("int").alias("n"), raw.alias("raw"))
    return V.parse_batch(batches, "raw", "n", ["user_id"]).select("user_id", "pos", "verdict.kind", "verdict.compliance_level", "verdict.confidence_score", "verdict.reason")


@query
def batch_sub_requirements(s, d):
    """Answers of a user as one batch with elements that are no objects, and lists that are none."""
    e = table(s, d, "events")
    k = F.col("event_id") % 6
    sub = F.concat(F.lit('{"requirement": "'), F.col("event_type"), F.lit('", "covered": '), F.when(F.col("event_id") % 5 == 0, "null").when(F.col("event_id") % 2 == 0, "true").otherwise("false"), F.lit("}"))
    item = F.when(k == 0, F.lit("17")).when(k == 1, F.lit('{"sub_requirements": "oops"}')).when(k == 2, F.lit("{}")).when(k == 3, F.concat(F.lit('{"sub_requirements": [4, '), sub, F.lit("]}"))).otherwise(F.concat(F.lit('{"sub_requirements": ['), sub, F.lit("]}")))
    items = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", item.alias("item")))), lambda x: x["item"]).alias("items"))
    raw = F.when(F.col("user_id") % 9 == 4, F.lit("nothing")).otherwise(F.concat(F.lit("Answer: ["), F.array_join("items", ","), F.lit("] end")))
    return V.batch_sub_requirements(items.select("user_id", F.greatest(F.size("items") - F.col("user_id") % 3, F.lit(0)).cast("int").alias("n"), raw.alias("raw")), "raw", "n", ["user_id"])


@query
def batch_meta_flags(s, d):
    rows = table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("e"))
    raw = F.concat(F.lit('[{"control_index": 0, "is_meta": true}, {"control_index": '), F.col("e") % 5, F.lit(', "is_meta": '), F.when(F.col("e") % 2 == 0, "true").otherwise("false"), F.lit("}]"))
    raw = F.when(F.col("e") % 7 == 0, "no answer").otherwise(raw)
    return V.batch_flags(rows.select("user_id", F.lit(4).alias("n"), raw.alias("raw")), "raw", "n", ["user_id"])


@query
def dedup_chunks(s, d):
    return V.first_chunks(table(s, d, "documents").select("doc_id", "source", "lang", "text"), ["source"], "text", "doc_id").select("doc_id", "source", "lang")


@query
def prefilter_chunks(s, d):
    return V.long_enough(table(s, d, "conversations"), "text", 200).select("conv_id", "turn")


@query
def harmonize_clusters(s, d):
    e = table(s, d, "embeddings")
    return H.cluster(e, "vec_id", "embedding", 0.40)


@query
def harmonize_controls(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding", F.concat(F.lit("C-"), F.col("vec_id")).alias("control_id"), F.concat(F.lit("Title "), F.col("vec_id")).alias("title"), F.concat(F.lit("About "), F.repeat(F.lit("x"), (F.col("vec_id") % 4).cast("int")), F.col("label")).alias("description"))
    out = H.harmonize(e, "vec_id", "embedding", "control_id", "title", "description", 0.40)
    return out.select("theme", "unified_description", F.array_join("source_references", ",").alias("refs"), "cluster")


@query
def detect_layout(s, d):
    return L.detect_layout(I.blocks(s, d), ["doc_id", "page"])


@query
def classify_blocks(s, d):
    return L.classify_blocks(I.blocks(s, d), "doc_id", "page").select("doc_id", "pos", "role")


@query
def classify_margins(s, d):
    return I.blocks(s, d).select("doc_id", "pos", L.classify_by_margin(F.col("y0"), F.lit(842.0)).alias("role"))


@query
def order_columns(s, d):
    return L.order_by_columns(I.blocks(s, d), "doc_id", "page").select("doc_id", "pos", "place")


@query
def page_text(s, d):
    return page_texts(I.blocks(s, d), "doc_id").select("doc_id", "page", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query
def boilerplate_repeats(s, d):
    return C.drop_boilerplate(I.blocks(s, d), "doc_id").select("doc_id", "pos")


def _paragraphs(s, d):
    """Each line a paragraph; some lines get headings."""
    head = F.when(F.col("pos") % 6 == 2, F.concat(F.lit("Section "), F.col("pos"), F.lit(": Title"))).when(F.col("pos") % 11 == 7, F.concat((F.col("pos") % 9).cast("string"), F.lit(".1  Purpose")))
    return I.blocks(s, d).select("doc_id", F.col("pos").alias("paragraph"), "page", F.coalesce(head, T.strip(F.col("text"))).alias("text"))


@query
def structural_sections(s, d):
    return C.sections(_paragraphs(s, d), "doc_id").select("doc_id", "section_no", "header", "page", F.size("sentences").cast("long").alias("n_sentences"), F.md5(F.array_join("sentences", "|").cast("binary")).alias("sentences_md5"))


@query
def semantic_breaks(s, d):
    e = table(s, d, "embeddings").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("x"))
    joined = C.semantic_chunks(F.transform("x", lambda v: v["vec_id"].cast("string")), F.transform("x", lambda v: v["embedding"]), 0.1)
    return e.select("label", F.posexplode(joined).alias("pos", "ids"))


@query
def merge_short(s, d):
    lines = F.filter(F.transform(F.split("text", "\n"), T.strip), lambda x: x != "")
    return I.chunks(s, d).select("doc_id", F.posexplode(C.merge_short(lines, 50)).alias("pos", "t")).select("doc_id", "pos", F.md5(F.col("t").cast("binary")).alias("text_md5"))


@query
def heal_sentences(s, d):
    lines = F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, r"\.$", ""))
    return I.chunks(s, d).select("doc_id", F.posexplode(C.heal(lines)).alias("pos", "text"))


@query
def join_paragraphs(s, d):
    return C.join_paragraphs(I.blocks(s, d), "doc_id", "pos")


@query
def chunk_documents(s, d):
    body = L.order_by_columns(L.classify_blocks(I.blocks(s, d), "doc_id", "page").where("role = 'body'").drop("role"), "doc_id", "page")
    return C.chunk_documents(body, "doc_id").select("document_name", "page_number", "section_header", "raw_text", "section_no", "ordinal")


@query
def fixed_chunks(s, d):
    return C.fixed_chunks(I.blocks(s, d), "doc_id", 500)


@query
def chunk_fragments(s, d):
    lines = I.chunks(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    seeds = F.when(F.col("pos") % 9 == 3, F.lit("Approved by the Chief Security Officer")).when(F.col("pos") % 9 == 5, F.concat(F.lit("("), F.col("line"))).otherwise(F.col("line"))
    return lines.select("doc_id", "pos", T.is_fragment(seeds).alias("is_fragment"), T.comparable(seeds).alias("comparable"))


@query
def page_segments(s, d):
    marked = F.regexp_replace("text", r"\n([A-ZÉÀ])", "\n3.1  $1")
    return I.chunks(s, d).select("doc_id", F.posexplode(T.page_segments(marked)).alias("pos", "segment")).select("doc_id", "pos", F.md5(F.col("segment").cast("binary")).alias("segment_md5"))


@query
def llm_extracted_controls(s, d):
    docs = table(s, d, "documents").select("doc_id", "text", F.get(F.split("text", "\n"), F.lit(1)).alias("line")).where("line is not null and length(line) > 0")
    item = F.struct(F.lit(" 2.1 ").alias("section"), F.col("line").alias("text"))
    fake = F.struct(F.lit("").alias("section"), F.concat(F.lit("Not in the text at all, but fifty characters long: "), F.col("doc_id").cast("string")).alias("text"))
    asked = docs.select("doc_id", "text", F.concat(F.lit("```json\n"), F.to_json(F.array(fake, item)), F.lit("\n```")).alias("answer"))
    return J.verified_controls(asked, "text", "answer", ["doc_id"]).select("doc_id", "section", "raw_text", "place")


def _golden(s, d):
    """Every item with the documents that hold it (by its first eight words) and the five best by keyword."""
    docs, items = I.chunks(s, d), I.controls(s, d)
    eight = lambda t: F.array_join(F.slice(t, 1, 8), " ")
    wanted = items.select("item_id", eight(T.tokens(F.col("item_text"))).alias("gram"))
    grams = docs.select("doc_id", T.tokens(F.col("text")).alias("t")).where(F.size("t") >= 8)
    grams = grams.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - 7), lambda i: F.array_join(F.slice("t", i, 8), " "))).alias("gram"))
    expected = grams.join(wanted, "gram").groupBy("item_id").agg(F.array_sort(F.collect_set("doc_id")).alias("expected"))
    got = R.bm25_top(docs, items, "doc_id", "text", "item_id", "item_text", 5).groupBy("item_id").agg(F.array_sort(F.collect_list("doc_id")).alias("retrieved"))
    empty = F.array().cast("array<bigint>")
    return expected.join(got, "item_id", "left").select("item_id", "expected", F.coalesce("retrieved", empty).alias("retrieved"))


@query
def retrieval_precision(s, d):
    return E.evaluate_retrieval(_golden(s, d), "precision", 0.1).withColumn("score", F.round("score", 6))


@query
def retrieval_recall(s, d):
    return E.evaluate_retrieval(_golden(s, d), "recall", 0.9).withColumn("score", F.round("score", 6))


@query
def hit_rate(s, d):
    return E.evaluate_retrieval(_golden(s, d), "hit", 0.9).withColumn("score", F.round("score", 6))


@query
def binary_metrics(s, d):
    return E.binary_metrics(table(s, d, "labels"), "quality", "toxic")


@query
def multiclass_accuracy(s, d):
    return E.accuracy(table(s, d, "labels"), "quality", "toxic").withColumn("accuracy", F.round("accuracy", 6))


@query
def faithfulness(s, d):
    """Every turn against the one before it."""
    c = table(s, d, "conversations")
    pairs = c.select("conv_id", "turn", "text").join(c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("source")), ["conv_id", "turn"])
    return E.faithfulness(pairs, "text", ["source"], ["policy", "control"]).select("conv_id", "turn", six("faithfulness"))


def _coverage(s, d):
    docs = table(s, d, "documents").select("doc_id", "source")
    return E.chunk_controls(docs, _mapped(s, d), "doc_id", "item_id")


@query
def gap_stats(s, d):
    return E.gap_statistics(V.best_rationale(I.votes(s, d), "user_id", pos="event_id").withColumn("level", F.when(F.col("user_id") % 13 != 0, F.col("level"))), "level")


@query
def coverage_stats(s, d):
    return E.coverage_statistics(_coverage(s, d), "source")


@query
def coverage_by_document(s, d):
    return E.coverage_by_document(_coverage(s, d), "source").withColumn("controls", F.array_join("controls", ","))


@query
def unmapped_chunks(s, d):
    return _coverage(s, d).where(F.size("controls") == 0).select("doc_id", "source")


def _reported(s, d):
    """Users as controls with the verdict of their first event, their events as chunks."""
    e = I.answers(s, d).select("user_id", "event_id", V.parse_answer(F.col("raw")).alias("v"))
    chunk = F.struct(F.concat(F.lit("e"), F.col("event_id")).alias("chunk_id"), F.lit("events").alias("document_name"), F.lit(1).alias("page_number"), F.lit(None).cast("string").alias("section_header"), F.concat(F.lit("Event\n"), F.col("event_id"), F.lit(" "), F.repeat(F.lit("word "), (F.col("event_id") % 60).cast("int"))).alias("raw_text"))
    per = e.groupBy("user_id").agg(F.min_by("v", "event_id").alias("rationale"), F.transform(F.array_sort(F.collect_list(F.struct("event_id", chunk.alias("c")))), lambda x: x["c"]).alias("chunks"))
    return per.select(F.col("user_id").cast("string").alias("control_id"), F.lit("F").alias("framework"), F.concat(F.lit("User "), F.col("user_id")).alias("title"), F.lit("About a user.").alias("description"), F.when(F.col("user_id") % 4 == 0, F.array().cast(X.CHUNKS)).otherwise(F.col("chunks").cast(X.CHUNKS)).alias("chunks"), F.col("rationale").cast(X.VERDICT).alias("rationale"))


@query
def csv_rows(s, d):
    return X.csv_rows(_reported(s, d))


@query
def verdict_labels(s, d):
    r = F.col("rationale")
    return _reported(s, d).select("control_id", X.report_label(r).alias("report"), X.markdown_verdict(r).alias("markdown"), X.assessment_state(r).alias("state"))


@query
def markdown_report(s, d):
    return X.markdown_sections(_reported(s, d))


@query
def oscal_findings(s, d):
    return X.findings(_reported(s, d))


@query
def truncate_text(s, d):
    return I.chunks(s, d).select("doc_id", T.truncate(F.col("text")).alias("short"), F.md5(T.truncate_at_sentence(F.col("text")).cast("binary")).alias("cut_md5"))


@query
def prompt_text(s, d):
    texts = table(s, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("t"))
    listed = F.array_join(F.transform("t", lambda t, i: F.concat(F.lit("### Chunk "), i, F.lit("\n"), t)), "\n")
    return texts.select("conv_id", F.md5(listed.cast("binary")).alias("listing_md5"), T.prompt_text(F.col("conv_id").cast("string"), F.lit("Title"), T.truncate(F.get("t", F.lit(0)))).alias("prompt"))


CATALOG = """{"catalog": {"metadata": {"title": "NIST SP 800-53 Rev 5"}, "groups": [
 {"id": "ac", "title": "Access Control", "controls": [
  {"id": "ac-1", "title": "Policy", "props": [{"name": "label", "value": "AC-1"}], "parts": [{"id": "s", "name": "statement", "prose": "Write it down."}],
   "controls": [{"id": "ac-1.1", "title": "Deeper", "props": [{"name": "sort-id", "value": "x"}], "controls": [{"title": "Deepest", "parts": [{"name": "guidance", "prose": "g"}]}]}]},
  {"id": "ac-2", "title": "Accounts", "parts": [{"name": "statement"}]}]},
 {"id": "au", "title": "Audit", "controls": [{"id": "au-2", "title": "Events", "props": [], "parts": [{"name": "statement", "prose": "Log."}]}]}]}}"""


@query
def oscal_flatten(s, d):
    base = table(s, d, "nation").select("n_nationkey", F.concat(F.lit(CATALOG)).alias("j"))
    titled = base.withColumn("j", F.when(F.col("n_nationkey") % 2 == 0, F.col("j")).otherwise(F.replace("j", F.lit("NIST SP 800-53 Rev 5"), F.lit("My pci catalog"))))
    return flatten_catalogs(titled, "j", ["n_nationkey"])


@query
def upsert_chunks(s, d):
    docs = table(s, d, "documents").select("doc_id", "source", F.length("text").alias("n"))
    old = docs.where("doc_id % 3 <> 0").withColumn("batch", F.lit(1))
    new = docs.where("doc_id % 2 = 0 or doc_id % 3 = 0").withColumn("batch", F.lit(2)).withColumn("n", F.col("n") + 1)
    return S.merge_by_key(old, new, "doc_id").select("doc_id", "source", "n", "batch")


@query
def store_round_trip(s, d):
    """Two upserts into a chunk store in the shared folder, read back with a filter."""
    e = table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("label"), "embedding", F.col("vec_id").alias("extraction_order"))
    store = S.ChunkStore(s, Scratch(s, "store").path("chunks"))
    store.index("vectors", e.where("extraction_order % 3 <> 0"))
    late = e.where("extraction_order % 2 = 0 or extraction_order % 3 = 0").withColumn("label", F.col("label") + 100)
    again = late.where("extraction_order % 4 = 0").withColumn("label", F.col("label") + 100).withColumn("extraction_order", F.col("extraction_order") + 1_000_000)
    store.index("vectors", late.unionByName(again))
    return store.read("vectors").select("chunk_id", "label", "extraction_order")


@query
def cache_lookup(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn", F.lit("m").alias("model"), F.col("text").alias("prompt"))
    cache = c.where("turn = 0").select(F.sha2(F.concat(F.lit("m::"), F.col("prompt")), 256).alias("key"), F.concat(F.lit("r"), F.length("prompt")).alias("response")).dropDuplicates(["key"])
    return S.with_cache(c, cache).select("conv_id", "turn", "key", "response", "hit")


@query
def enrich_lexical(s, d):
    """Mapped controls judged by word overlap, with governance requirements resolved."""
    docs = table(s, d, "documents").select("doc_id", "source", "text")
    chunk = F.struct(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("document_name"), F.lit(1).alias("page_number"), F.lit(None).cast("string").alias("section_header"), F.col("text").alias("raw_text"))
    mapped = _mapped(s, d).where("doc_id is not null").join(docs, "doc_id").groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", chunk.alias("c")))), lambda x: x["c"]).alias("chunks"))
    items = I.controls(s, d).join(mapped, "item_id", "left")
    ready = items.select(F.concat((F.col("item_id") % 5).cast("string"), F.lit("."), F.col("item_id").cast("string")).alias("control_id"), F.lit("BM").alias("framework"), F.lit("Item").alias("title"), F.col("item_text").alias("description"), F.coalesce("chunks", F.array().cast(X.CHUNKS)).alias("chunks"))
    out = J.enrich(Scratch(s, "enrich").keep(ready, "mapped"), J.LexicalJudge())
    return out.select("control_id", "is_meta", F.size("chunks").alias("n_chunks"), "level", F.round("confidence", 4).alias("confidence"), "resolved_level")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
