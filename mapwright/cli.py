"""Command line: parse, index, map, harmonize, eval over files of the engine's own formats."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mapwright.functions import text as T
from mapwright.operators import chunking, evaluation, export, harmonize, judging, layout, retrieval, store
from mapwright.scratch import Scratch
from mapwright.session import local_session
from mapwright.sources import catalog


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="mapwright", description=__doc__)
    verbs = parser.add_subparsers(dest="verb", required=True)
    p = verbs.add_parser("parse", help="laid-out blocks (Parquet: doc, page, pos, x0, y0, x1, y1, text) to chunk JSON lines")
    p.add_argument("blocks")
    p.add_argument("out")
    p.add_argument("--strategy", choices=["semantic", "fixed", "llm"], default="semantic")
    p.add_argument("--judge", help="for strategy llm: URL of a generate endpoint, or model name after it: URL#model")
    p.add_argument("--size", type=int, default=500)
    p = verbs.add_parser("index", help="chunk JSON lines, and catalogs, into a store")
    p.add_argument("chunks")
    p.add_argument("store")
    p.add_argument("--catalog")
    p = verbs.add_parser("map", help="controls of a catalog to stored chunks")
    p.add_argument("store")
    p.add_argument("catalog")
    p.add_argument("--top-k", type=int, default=5)
    p.add_argument("--format", default="json")
    p.add_argument("--out")
    p.add_argument("--rationale", action="store_true", help="have a judge evaluate what was mapped")
    p.add_argument("--judge", default="lexical", help="lexical, or URL#model of a generate endpoint")
    p.add_argument("--fast-judge", help="for classification and gaps; the judge if not given")
    p.add_argument("--cache", help="folder of answers to use again and add to")
    p = verbs.add_parser("harmonize", help="common controls of a folder of catalogs")
    p.add_argument("folder")
    p.add_argument("--threshold", type=float, default=0.85)
    p = verbs.add_parser("eval", help="retrieval quality over golden queries")
    p.add_argument("store")
    p.add_argument("golden")
    p.add_argument("--metric", default="precision", help="precision, recall, hit, or handoff: rows for an outside evaluation")
    p.add_argument("--top-k", type=int, default=5)
    p.add_argument("--threshold", type=float, default=0.0)
    p.add_argument("--limit", type=int, default=0)
    args = parser.parse_args(argv)
    spark = local_session(app="mapwright-cli")
    return globals()[f"_{args.verb}"](spark, args)


def _parse(spark, args) -> int:
    blocks = layout.order_by_columns(layout.classify_blocks(spark.read.parquet(args.blocks), "doc", "page").where("role = 'body'").drop("role"), "doc", "page")
    if args.strategy == "llm":
        pages = catalog.page_texts(blocks.withColumnRenamed("place", "at"), "doc", pos="at")
        segments = pages.select("doc", "page", F.posexplode(T.page_segments(F.col("text"))).alias("part", "segment")).where(F.length("segment") >= 50)
        desk = judging.Desk(_judge(args.judge), Scratch(spark, "parse"))
        found = judging.extract_controls(segments, desk, ["doc", "page", "part"])
        out = found.select(F.sha2(F.concat_ws("|", "doc", "page", "part", "place", "raw_text"), 256).alias("chunk_id"), F.col("doc").alias("document_name"), F.col("page").alias("page_number"), F.col("section").alias("section_header"), "raw_text")
    elif args.strategy == "fixed":
        out = chunking.fixed_chunks(blocks, "doc", args.size, "place")
        out = out.select(F.sha2(F.concat_ws("|", "doc", "ordinal"), 256).alias("chunk_id"), F.col("doc").alias("document_name"), F.col("page").alias("page_number"), "raw_text")
    else:
        out = chunking.chunk_documents(blocks, "doc").drop("section_no", "ordinal")
    out.write.mode("append").json(args.out)
    return 0


def _vectors(frame, text: str):
    return retrieval.embed(frame, text, "embedding").withColumn("embedding", F.col("embedding").cast("array<float>"))


def _index(spark, args) -> int:
    kept = store.ChunkStore(spark, args.store)
    chunks = catalog.read_chunks(spark, args.chunks).drop("embedding")
    kept.index("chunks", _vectors(chunks, "raw_text"))
    if args.catalog:
        c = catalog.read_catalogs(spark, args.catalog)
        rows = c.select(F.concat(F.lit("ctrl-"), "control_id").alias("chunk_id"), F.concat(F.lit("framework:"), "framework").alias("document_name"), F.lit(1).alias("page_number"), F.concat_ws(": ", "control_id", F.concat_ws(". ", "title", "description")).alias("raw_text"), F.col("title").alias("section_header"))
        kept.index("controls", _vectors(rows, "raw_text"))
    return 0


def _judge(name: str | None) -> judging.Judge:
    """``lexical``, or the URL of a generate endpoint with the model after #."""
    if not name or name == "lexical":
        return judging.LexicalJudge()
    url, _, model = name.partition("#")
    found = judging.HttpJudge(url, model)
    if not found.is_available():
        raise SystemExit(f"no answer from {url}")
    return found


def _numbered(frame, *keys: str):
    """A long key for operators that rank by number."""
    return frame.withColumn("num", F.xxhash64(*keys))


def _map(spark, args) -> int:
    chunks = _numbered(store.ChunkStore(spark, args.store).read("chunks"), "chunk_id")
    controls = _numbered(catalog.read_catalogs(spark, args.catalog), "framework", "control_id").withColumnRenamed("num", "cnum").withColumn("q", T.prompt_text(F.col("control_id"), F.col("title"), F.col("description")))
    controls = retrieval.control_queries(controls, "q", "requirement_family").withColumn("pos", F.struct("file", "place"))
    got = retrieval.map_controls(chunks, controls, "num", "raw_text", "cnum", "keyword_query", args.top_k, vector_text="vector_query", chunk_vector="embedding")
    chunk = F.struct("chunk_id", "document_name", "page_number", "section_header", "raw_text")
    per = got.where("num is not null").join(chunks, "num").groupBy("cnum").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", chunk.alias("c")))), lambda x: x["c"]).cast(export.CHUNKS).alias("chunks"))
    wanted = ["control_id", "framework", "title", "description", "chunks", "rationale"]
    rows = controls.join(per, "cnum", "left").withColumn("chunks", F.coalesce("chunks", F.array().cast(export.CHUNKS)))
    if args.rationale:
        ready = Scratch(spark, "map").keep(rows.select("control_id", "framework", "title", "description", "requirement_family", "pos", "chunks"), "mapped")
        cache = store.AnswerCache(spark, args.cache) if args.cache else None
        judged = judging.enrich(ready, _judge(args.judge), _judge(args.fast_judge or args.judge), cache, (args.judge, args.fast_judge or args.judge))
        rows = Scratch(spark, "map").keep(judged.withColumn("rationale", F.col("rationale").cast(export.VERDICT)), "judged")
        if cache is not None:
            print(f"cache: {cache.hits} hits, {cache.misses} misses", file=sys.stderr)
    else:
        rows = rows.withColumn("rationale", F.lit(None).cast(export.VERDICT))
    out = export.emit(rows.orderBy("pos").select(*wanted), args.format, args.out, chunks)
    if not args.out:
        sys.stdout.write(out[0])
    return 0


def _harmonize(spark, args) -> int:
    c = catalog.read_catalogs(spark, args.folder)
    # The catalogs' order: a catalog's controls are numbered from where the one before it ends.
    sizes = {r["file"]: r["n"] for r in c.groupBy("file").agg(F.count("*").alias("n")).collect()}
    starts = [(f, sum(sizes[g] for g in sizes if g < f)) for f in sizes]
    first = spark.createDataFrame(starts, "file string, start long")
    c = c.join(F.broadcast(first), "file").withColumn("num", F.col("start") + F.row_number().over(W.partitionBy("file").orderBy("place")))
    c = Scratch(spark, "harmonize").keep(retrieval.embed(c.withColumn("t", T.prompt_text(F.col("control_id"), F.col("title"), F.col("description"))), "t", "vec"), "controls")
    for r in harmonize.harmonize(c, "num", "vec", "control_id", "title", "description", args.threshold).orderBy("cluster").drop("cluster").toJSON().toLocalIterator():
        print(r)
    return 0


def _eval(spark, args) -> int:
    golden = catalog.read_golden(spark, args.golden)
    if args.limit:
        golden = golden.where(F.col("ordinal") < args.limit)
    chunks = _numbered(store.ChunkStore(spark, args.store).read("chunks"), "chunk_id")
    found = retrieval.vector_top(chunks, retrieval.embed(golden, "query", "vec"), "num", "embedding", "ordinal", "vec", args.top_k)
    got = found.join(chunks.select("num", "chunk_id"), "num").groupBy("ordinal").agg(F.collect_list("chunk_id").alias("retrieved"))
    frame = golden.join(got, "ordinal", "left").select(F.col("expected_ids").alias("expected"), F.coalesce("retrieved", F.array().cast("array<string>")).alias("retrieved"))
    if args.metric == "handoff":
        texts = found.join(chunks.select("num", "raw_text"), "num")
        for r in evaluation.handoff(golden, texts, "ordinal", "query", "raw_text", "rank").orderBy("ordinal").drop("ordinal").toJSON().toLocalIterator():
            print(r)
        return 0
    row = evaluation.evaluate_retrieval(frame, args.metric, args.threshold).first()
    print(f"{row['metric']}: {row['score']:.4f} over {row['n_queries']} queries, {'PASS' if row['passed'] else 'FAIL'}")
    return int(args.threshold > 0 and not row["passed"])


if __name__ == "__main__":
    sys.exit(main())
