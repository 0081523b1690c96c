"""Catalogs, chunk files, golden queries and page text as frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = "chunk_id string, document_name string, page_number int, raw_text string, section_header string, embedding array<float>"
CONTROL = "id string, title string, props array<struct<name:string,value:string>>, parts array<struct<id:string,name:string,prose:string>>"
BLOCKS = "path string, pos int, page int, x0 double, y0 double, x1 double, y1 double, text string"


def read_chunks(spark: SparkSession, path: str, strict: bool = True, least: int = 50) -> DataFrame:
    """Chunk JSON lines; strict reading stops at the first line that is no chunk, otherwise such rows carry ``problem``.

    A chunk has a text of ``least`` characters, an identifier, a document and a page from 1 on. Blank lines are none.
    """
    frame = spark.read.schema(CHUNK + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    short = F.coalesce(F.length("raw_text"), F.lit(0)) < least
    unnamed = F.col("chunk_id").isNull() | F.col("document_name").isNull()
    problem = F.when(F.col("_corrupt_record").isNotNull(), "not JSON").when(short, f"text under {least} characters").when(F.coalesce("page_number", F.lit(0)) < 1, "page under 1").when(unnamed, "no identifier or document")
    told = frame.withColumn("problem", problem)
    if not strict:
        return told
    names = [x.split()[0] for x in CHUNK.split(", ")]
    stop = F.raise_error(F.concat(F.lit("not a chunk: "), F.col("problem"))).cast("string")
    return told.withColumn("chunk_id", F.when(F.col("problem").isNull(), F.col("chunk_id")).otherwise(stop)).select(*names)


def framework_of(title: Column) -> Column:
    return F.when(F.contains(title, F.lit("800-53")), "NIST-800-53").when(F.contains(F.upper(title), F.lit("PCI")), "PCI-DSS").otherwise(title)


def flatten_catalogs(frame: DataFrame, json_col: str, order: list[str]) -> DataFrame:
    """Controls of catalog JSON texts in pre-order: parents, then their enhancements at any depth.

    Only controls within top-level groups count; enhancements take the group's title as
    family. Levels are unrolled until one is empty, so rows move only as text.
    """
    read = "catalog struct<metadata:struct<title:string>,groups:array<struct<id:string,title:string,controls:array<string>>>>"
    top = frame.withColumn("c", F.from_json(json_col, read)["catalog"])
    level = top.select(*order, framework_of(F.col("c.metadata.title")).alias("framework"), F.posexplode("c.groups").alias("g", "group")).select(*order, "framework", F.coalesce(F.col("group.title"), F.lit("")).alias("family"), "g", F.posexplode("group.controls").alias("i", "raw"))
    level = level.withColumn("place", F.format_string("%06d.%06d", "g", "i"))
    done = None
    while True:
        read_one = F.from_json("raw", CONTROL + ", controls array<string>")
        rows = level.select(*order, "framework", "family", "place", read_one.alias("k"))
        done = rows if done is None else done.unionByName(rows)
        level = rows.select(*order, "framework", "family", "place", F.posexplode("k.controls").alias("i", "raw")).withColumn("place", F.concat("place", F.format_string(".%06d", "i")))
        if level.isEmpty():
            break
    label = F.get(F.filter("k.props", lambda p: p["name"] == "label"), F.lit(0))["value"]
    prose = F.get(F.filter("k.parts", lambda p: p["name"] == "statement"), F.lit(0))["prose"]
    return done.select(*order, "place", F.coalesce(label, F.col("k.id"), F.lit("UNKNOWN")).alias("control_id"), "framework", F.coalesce(F.col("k.title"), F.lit("")).alias("title"), F.coalesce(prose, F.lit("")).alias("description"), F.col("family").alias("requirement_family"))


def read_catalogs(spark: SparkSession, path: str) -> DataFrame:
    """A catalog file, or all *.json of a folder in order of name."""
    files = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    if not files.where(F.get_json_object("value", "$.catalog").isNull()).isEmpty():
        raise ValueError("a file has no catalog")
    return flatten_catalogs(files, "value", ["file"]).orderBy("file", "place")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, query, expected_ids); an empty set is an error."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "queries array<struct<query:string,expected_ids:array<string>>>")["queries"].alias("q"))
    out = raw.select(F.posexplode("q").alias("ordinal", "x")).select("ordinal", "x.query", "x.expected_ids")
    if out.isEmpty():
        raise ValueError("no queries in the golden set")
    return out


def read_blocks(spark: SparkSession, path: str, extractor: Callable[[bytes], list[tuple[int, float, float, float, float, str]]]) -> DataFrame:
    """Text blocks of document files by a plug-in that returns (page, x0, y0, x1, y1, text); sorted by page and y0, blanks dropped."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for name, content in zip(part["path"], part["content"], strict=True):
                found = sorted((b for b in extractor(bytes(content)) if b[5].strip()), key=lambda b: (b[0], b[2]))
                rows += [(name, i, b[0], b[1], b[2], b[3], b[4], b[5].strip()) for i, b in enumerate(found)]
            yield pd.DataFrame(rows, columns=["path", "pos", "page", "x0", "y0", "x1", "y1", "text"])

    return files.mapInPandas(run, BLOCKS)


def page_texts(blocks: DataFrame, doc: str, page: str = "page", pos: str = "pos", text: str = "text") -> DataFrame:
    """(doc, page, text) of pages that aren't blank."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), "\n")
    return blocks.groupBy(doc, page).agg(joined.alias("text")).where(F.trim("text") != "")
