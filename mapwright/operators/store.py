"""The chunk store: Parquet tables under one folder, merged by key."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merge_by_key(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """``new`` over ``old``: rows of ``old`` whose key ``new`` lacks, and the last of ``new`` for each key."""
    if order:
        new = new.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.col(order).desc()))).where("_n = 1").drop("_n")
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


class ChunkStore:
    """Collections of chunks; each version of a collection is a folder, and the newest counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._root = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not self._fs.mkdirs(self._root):
            raise OSError(f"can't make {path}")

    def _versions(self, name: str) -> list[int]:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path, name)
        found = self._fs.listStatus(where) if self._fs.exists(where) else []
        done = lambda p: self._fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return sorted(int(s.getPath().getName()[1:]) for s in found if s.getPath().getName()[1:].isdigit() and done(s.getPath()))

    def collections(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._root) if s.isDirectory())

    def index(self, name: str, chunks: DataFrame, keep: int = 2) -> int:
        """Upsert by chunk_id, the last of a call's rows winning; returns the number of rows given.

        ``extraction_order`` is the place in this call; where it isn't given, rows are numbered
        as they are read. The newest ``keep`` versions stay, so that readers of the one before can end.
        """
        if "embedding" not in chunks.columns or not chunks.where("embedding is null").isEmpty():
            raise ValueError("every chunk needs an embedding")
        if "extraction_order" not in chunks.columns:
            chunks = chunks.withColumn("extraction_order", F.monotonically_increasing_id())
        old = self._versions(name)
        base = self._read(name, old[-1]) if old else chunks.where("false")
        merge_by_key(base, chunks, "chunk_id", "extraction_order").write.parquet(f"{self.path}/{name}/v{(old[-1] + 1) if old else 1}")
        for version in old[: max(0, len(old) + 1 - keep)]:
            self._fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path, f"{name}/v{version}"), True)
        return chunks.count()

    def _read(self, name: str, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}/v{version}")

    def read(self, name: str, where: dict | None = None) -> DataFrame:
        """The collection with equalities on its columns, which reach the scan."""
        versions = self._versions(name)
        if not versions:
            raise FileNotFoundError(f"no collection {name} in {self.path}")
        frame = self._read(name, versions[-1])
        for k, v in (where or {}).items():
            frame = frame.where(F.col(k) == v)
        return frame

    def all_chunks(self, name: str) -> DataFrame:
        """Without vectors, in order of extraction."""
        frame = self.read(name).drop("embedding")
        return frame.orderBy("extraction_order", "chunk_id") if "extraction_order" in frame.columns else frame.orderBy("chunk_id")


def cache_key(model: str, prompt: str) -> str:
    return hashlib.sha256(f"{model}::{prompt}".encode()).hexdigest()


def with_cache(requests: DataFrame, cache: DataFrame, model: str = "model", prompt: str = "prompt") -> DataFrame:
    """Adds key, response (null at a miss) and hit; the cache has one row per key."""
    keyed = requests.withColumn("key", F.sha2(F.concat(F.col(model), F.lit("::"), F.col(prompt)), 256))
    return keyed.join(cache.select("key", "response"), "key", "left").withColumn("hit", F.col("response").isNotNull())


class AnswerCache:
    """Answers by key in a Parquet folder, appended to as they come; a key that was put twice has one answer."""

    SCHEMA = "key string, response string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.hits, self.misses = spark, path.rstrip("/"), 0, 0
        self._where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def read(self) -> DataFrame:
        if not self._fs.exists(self._where):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path).groupBy("key").agg(F.min("response").alias("response"))

    def put(self, answers: DataFrame) -> None:
        """Append (key, response) rows."""
        answers.select("key", "response").where("response is not null").write.mode("append").parquet(self.path)

    def clear(self) -> None:
        self._fs.delete(self._where, True)

    def stats(self) -> dict[str, int]:
        return {"hits": self.hits, "misses": self.misses, "entries": self.read().count()}
