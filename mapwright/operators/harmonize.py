"""Overlapping controls of several catalogs as common controls: single-linkage clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapwright.operators.components import least_reachable
from mapwright.operators.retrieval import _matrix, _unit
from mapwright.scratch import Scratch

#: Vectors compared with all others at a time.
BLOCK = 4096


def similarity_edges(frame: DataFrame, key: str, vec: str, threshold: float) -> DataFrame:
    """Links (a, b) that connect the same rows as all pairs with cosine >= threshold.

    Rows are compared in blocks of fixed size with all others. A task hands on only
    links that join two groups not yet joined within it, so links never exceed rows.
    """
    base = frame.select(F.col(key).cast("long").alias("k"), F.col(vec).alias("v")).where("v is not null and k is not null")
    n_blocks = max(1, -(-base.count() // BLOCK))
    out = None
    for block in range(n_blocks):
        own = base if n_blocks == 1 else base.where(F.pmod(F.xxhash64("k"), F.lit(n_blocks)) == block)
        part = own.toPandas()
        vectors = _unit(np.array([*part["v"]], np.float64).reshape(len(part), -1)) if len(part) else np.zeros((0, 1))
        sent = frame.sparkSession.sparkContext.broadcast((part["k"].to_numpy(np.int64), vectors))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, vectors = sent.value
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while parent.setdefault(x, x) != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for batch in batches:
                if not batch.num_rows or not len(ids):
                    continue
                k = batch.column("k").to_numpy()
                i, j = np.nonzero(np.round(_unit(_matrix(batch.column("v"))) @ vectors.T, 9) >= threshold)
                links = []
                for a, b in zip(k[i].tolist(), ids[j].tolist(), strict=True):
                    x, y = root(a), root(b)
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        links.append((a, b))
                if links:
                    a, b = zip(*links, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        found = base.mapInArrow(scan, "a long, b long")
        out = found if out is None else out.unionByName(found)
    return out


def cluster(frame: DataFrame, key: str, vec: str, threshold: float = 0.85) -> DataFrame:
    """(key, cluster): the smallest key of each row's cluster."""
    scratch = Scratch(frame.sparkSession, "harmonize")
    found = least_reachable(similarity_edges(frame, key, vec, threshold), scratch)
    return frame.select(key).join(found.withColumnRenamed("id", key), key, "left").select(key, F.coalesce("component", F.col(key)).alias("cluster"))


def harmonize(controls: DataFrame, key: str, vec: str, control_id: str, title: str, description: str, threshold: float = 0.85) -> DataFrame:
    """(common_id, theme, unified_description, source_references, cluster), one row per cluster.

    ``key`` gives the controls' order; the first names the theme.
    """
    frame = controls.join(cluster(controls, key, vec, threshold), key)
    longest_first = F.array_sort(F.collect_set(F.struct((-F.length(description)).alias("n"), F.col(description).alias("t"))))
    per = frame.groupBy("cluster").agg(
        F.min_by(title, key).alias("theme"),
        F.array_join(F.transform(longest_first, lambda x: x["t"]), " | ").alias("unified_description"),
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("o"), F.col(control_id).alias("c")))), lambda x: x["c"]).alias("source_references"),
    )
    common = F.concat(F.lit("CC-"), F.substring(F.sha2(F.array_join("source_references", "|"), 256), 1, 8))
    return per.select(common.alias("common_id"), "theme", "unified_description", "source_references", "cluster")
