"""Keyword and vector ranking, their fusion, and the mapping of controls to chunks."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mapwright.functions import constants as K
from mapwright.functions import text as T

#: Query vectors sent to all tasks at a time.
QUERY_BLOCK = 4096


def top(frame: DataFrame, by: str, score: str, key: str, k: int) -> DataFrame:
    """The k best of each group with their rank; ties by key. The filter sits on the window, so that each task keeps k rows at most."""
    order = W.partitionBy(by).orderBy(F.round(score, 9).desc(), F.col(key))
    return frame.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25_scores(chunks: DataFrame, queries: DataFrame, chunk_id: str, chunk_text: str, query_id: str, query_text: str) -> DataFrame:
    """(query, chunk, score > 0) by Okapi BM25; terms repeated in a query count each time.

    Terms meet in an equi-join. Postings are reduced to the queries' terms before anything
    moves if those are few, and only chunk lengths and document counts cover the rest.
    """
    docs = chunks.select(F.col(chunk_id).alias("d"), T.tokens(F.col(chunk_text)).alias("t")).withColumn("len", F.size("t"))
    wanted = queries.select(F.col(query_id).alias("q"), F.explode(T.tokens(F.col(query_text))).alias("term")).groupBy("q", "term").agg(F.count("*").alias("qf"))
    corpus = docs.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    seen = docs.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = seen.join(F.broadcast(corpus)).select("term", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    mean = idf.agg(F.avg("idf").alias("mean_idf"))
    terms = wanted.join(idf, "term").join(F.broadcast(mean)).select("q", "term", "qf", F.when(F.col("idf") < 0, K.BM25_EPSILON * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))
    tf = docs.select("d", "len", F.explode("t").alias("term")).join(wanted.select("term").distinct(), "term", "left_semi").groupBy("d", "len", "term").agg(F.count("*").alias("tf"))
    scored = tf.join(terms, "term").join(F.broadcast(corpus))
    part = F.col("qf") * F.col("idf") * F.col("tf") * (K.BM25_K1 + 1) / (F.col("tf") + K.BM25_K1 * (1 - K.BM25_B + K.BM25_B * F.col("len") / F.col("avg_len")))
    out = scored.groupBy("q", "d").agg(F.sum(part).alias("score")).where(F.col("score") > 0)
    return out.select(F.col("q").alias(query_id), F.col("d").alias(chunk_id), "score")


def bm25_top(chunks: DataFrame, queries: DataFrame, chunk_id: str, chunk_text: str, query_id: str, query_text: str, k: int = 5) -> DataFrame:
    return top(bm25_scores(chunks, queries, chunk_id, chunk_text, query_id, query_text), query_id, "score", chunk_id, k)


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def vector_top(chunks: DataFrame, queries: DataFrame, chunk_id: str, chunk_vec: str, query_id: str, query_vec: str, k: int = 5, where: dict | None = None) -> DataFrame:
    """(query, chunk, score, rank): exact cosine, k best chunks of each query, score max(0, cosine).

    Queries go to all tasks in blocks of fixed size; each task keeps its own k
    best of every query, so what moves is k rows for each query and task.
    ``where`` holds equalities on chunk columns, applied before the scan's output.
    """
    for name, value in (where or {}).items():
        chunks = chunks.where(F.col(name) == value)
    base = chunks.select(F.col(chunk_id).cast("long").alias("d"), F.col(chunk_vec).alias("v")).where("v is not null and d is not null")
    rows = queries.select(F.col(query_id).cast("long").alias("q"), F.col(query_vec).alias("v")).where("v is not null and q is not null")
    n_blocks = max(1, -(-rows.count() // QUERY_BLOCK))
    best = None
    for block in range(n_blocks):
        own = rows if n_blocks == 1 else rows.where(F.pmod(F.xxhash64("q"), F.lit(n_blocks)) == block)
        part = own.toPandas()
        ids = part["q"].to_numpy(np.int64)
        vectors = _unit(np.array([*part["v"]], np.float64).reshape(len(part), -1)) if len(part) else np.zeros((0, 1))
        sent = chunks.sparkSession.sparkContext.broadcast((ids, vectors))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, vectors = sent.value
            for batch in batches:
                if not batch.num_rows or not len(ids):
                    continue
                d = batch.column("d").to_numpy()
                score = np.round(np.clip(vectors @ _unit(_matrix(batch.column("v"))).T, -1, 1), 12)
                keep = np.lexsort((np.broadcast_to(d, score.shape), -np.round(score, 9)), axis=1)[:, :k]
                n = keep.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(d[keep].ravel()), pa.array(np.take_along_axis(score, keep, 1).ravel())], names=["q", "d", "score"])

        found = base.mapInArrow(scan, "q long, d long, score double")
        best = found if best is None else best.unionByName(found)
    best = best.select(F.col("q").alias(query_id), F.col("d").alias(chunk_id), "score")
    return top(best, query_id, "score", chunk_id, k).withColumn("score", F.greatest(F.lit(0.0), F.col("score")))


def fuse(vector: DataFrame, keyword: DataFrame, query_id: str, chunk_id: str, k: int = 5) -> DataFrame:
    """Reciprocal rank fusion of two rank lists: (query, chunk, rrf, score, rank)."""
    a = vector.select(query_id, chunk_id, F.col("rank").alias("v_rank"))
    b = keyword.select(query_id, chunk_id, F.col("rank").alias("k_rank"))
    part = lambda c: F.coalesce(1.0 / (K.RRF_K + F.col(c)), F.lit(0.0))
    both = a.join(b, [query_id, chunk_id], "full_outer").withColumn("rrf", part("v_rank") + part("k_rank"))
    both = both.withColumn("score", F.least(F.col("rrf") / (2.0 / (K.RRF_K + 1)), F.lit(1.0)))
    return top(both, query_id, "rrf", chunk_id, k)


def _slots(text: str | None, size: int, slot: dict[str, int]) -> Counter[int]:
    """Counts of tokens by the first 32 bits of their md5."""
    found: Counter[int] = Counter()
    for w, n in Counter(re.findall(r"\w+", (text or "").lower())).items():
        if w not in slot:
            slot[w] = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % size
        found[slot[w]] += n
    return found


def _hashed(text: str | None, size: int, slot: dict[str, int]) -> np.ndarray:
    v = np.zeros(size)
    for at, n in _slots(text, size, slot).items():
        v[at] = n
    return v


def embedding_of(size: int = 256) -> Callable[[Column], Column]:
    """A deterministic bag-of-words vector of each text, made in Arrow batches."""

    @F.pandas_udf("array<double>")
    def embed_batch(texts: pd.Series) -> pd.Series:
        slot: dict[str, int] = {}
        return pd.Series([_hashed(t, size, slot) for t in texts])

    return embed_batch


def embedding_of_each(size: int = 256) -> Callable[[Column], Column]:
    """The same for arrays of texts."""

    @F.pandas_udf("array<array<double>>")
    def embed_batch(texts: pd.Series) -> pd.Series:
        slot: dict[str, int] = {}
        return pd.Series([[_hashed(t, size, slot) for t in ts] for ts in texts])

    return embed_batch


def neighbour_cosines(size: int = 256) -> Callable[[Column], Column]:
    """For arrays of texts: each text's cosine with the one before, by ``embedding_of``; null for the first.

    8 bytes a text leave Python; its vectors would be ``size`` times that, gigabytes a batch.
    """

    def cosines(texts: list[str], slot: dict[str, int]) -> list[float | None]:
        out: list[float | None] = []
        before, norm_before = Counter(), 0.0
        for t in texts:
            now = _slots(t, size, slot)
            norm = math.sqrt(sum(n * n for n in now.values()))
            both = norm_before * norm
            out.append((sum(n * before[at] for at, n in now.items() if at in before) / both if both > 0 else 0.0) if out else None)
            before, norm_before = now, norm
        return out

    @F.pandas_udf("array<double>")
    def cosines_of_batch(texts: pd.Series) -> pd.Series:
        slot: dict[str, int] = {}
        return pd.Series([cosines(ts, slot) for ts in texts])

    return cosines_of_batch


def embed(frame: DataFrame, text_col: str, out: str, embedder: Callable[[Column], Column] | None = None) -> DataFrame:
    """Add a vector column; an embedder is a function from a text column to a vector column."""
    return frame.withColumn(out, (embedder or embedding_of())(F.col(text_col)))


def control_queries(controls: DataFrame, text: str, family: str | None = None) -> DataFrame:
    """Adds what a control is looked up by: keyword_query, widened by family and concepts, and vector_query, with an instruction before it."""
    plain = T.with_family(F.col(family), F.col(text)) if family else F.col(text)
    wide = controls.withColumn("keyword_query", T.expand_query(plain))
    return wide.withColumn("vector_query", T.embedding_query(F.col("keyword_query")))


def map_controls(
    chunks: DataFrame,
    controls: DataFrame,
    chunk_id: str,
    chunk_text: str,
    control_id: str,
    control_text: str,
    k: int = 3,
    min_score: float = K.MIN_SCORE,
    embedder=None,
    vector_text: str | None = None,
    chunk_vector: str | None = None,
) -> DataFrame:
    """Every control with its chunks that both lists rank and whose score suffices: (control, chunk or null, score, rank).

    ``vector_text`` is what is embedded of a control, if not its text; ``chunk_vector`` names vectors that the chunks have already.
    """
    keyword = bm25_top(chunks, controls, chunk_id, chunk_text, control_id, control_text, 2 * k)
    stored = chunks.withColumnRenamed(chunk_vector, "vec") if chunk_vector else embed(chunks, chunk_text, "vec", embedder)
    vector = vector_top(stored, embed(controls, vector_text or control_text, "vec", embedder), chunk_id, "vec", control_id, "vec", 2 * k)
    kept = fuse(vector, keyword, control_id, chunk_id, k).where(F.col("score") >= min_score)
    return controls.select(control_id).join(kept.select(control_id, chunk_id, "score", "rank"), control_id, "left_outer")
