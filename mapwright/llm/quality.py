"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

Terms are hashed byte trigrams. A bounded, documented sample of labelled training
rows (``per_class`` of each class, those with the smallest hash of their
identifier) gives term weights and a truncated singular value decomposition; its
vectors, at most ``2 * per_class`` of ``rank`` numbers, are broadcast. Every
document is projected and compared with all of them by blocked matrix products,
so the cosines are exact, to DIGITS places; the nearest ``k`` and all that tie with the
last of them vote with weights that grow with similarity. A score depends on the text and
the model alone, not on the rows around it.

The sample's terms are counted where its texts are and fitted in one task, whose rows
the sample bounds; only the model, a few MB, passes through the driver.

Defined results: null and empty texts score 0; texts too short for a term score the
share of label 1 in the sample; without labelled rows of both
classes every other document scores the share of label 1 among those there are
(0.5 if none); labels that repeat an identifier count once each; a null label
is not used; a null identifier is scored but never a training row. Columns of
the input besides identifier and text play no part.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from mapwright.llm.textbytes import slices

TERMS = 2048
#: Places to which cosines count, so that equal texts tie whatever block they are in.
DIGITS = 5
#: Rows and bytes that are counted at once.
ROWS, BYTES = 512, 1 << 21
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


def term_counts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Counts of hashed byte trigrams within each row, (rows, TERMS) float32."""
    n = len(off) - 1
    out = np.zeros(n * TERMS, np.int64)
    row = np.repeat(np.arange(n), np.diff(off))
    for lo in range(0, len(buf) - 2, BYTES):
        b = buf[lo : lo + BYTES + 2].astype(np.uint32)
        h = ((b[:-2] * _A) ^ (b[1:-1] * _B) ^ (b[2:] * _C)) * _A >> np.uint32(32 - TERMS.bit_length() + 1)
        first = row[lo : lo + len(h)]
        whole = first == row[lo + 2 : lo + 2 + len(h)]
        out += np.bincount(first[whole] * TERMS + h[whole], minlength=n * TERMS)
    return out.reshape(n, TERMS).astype(np.float32)


def counted(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, counts, which are empty) of runs of a batch's rows."""
    for lo, hi, buf, off in slices(column):
        for x in range(0, hi - lo, ROWS):
            part = off[x : x + ROWS + 1]
            yield lo + x, term_counts(buf[part[0] : part[-1]], part - part[0]), np.diff(part) == 0


class Voter:
    """The fitted model: term weights, projection and labelled vectors."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, rank: int = 64, k: int = 15, power: float = 8.0):
        self.k, self.power, self.labels = k, power, labels.astype(np.float32)
        self.vectors = np.zeros((0, rank), np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        if len(np.unique(labels)) < 2:
            return
        seen = (counts > 0).sum(0)
        self.weight = np.log((1 + len(counts)) / (1 + seen)).astype(np.float32) + np.float32(1)
        x = self._weigh(counts)
        values, basis = np.linalg.eigh((x.T @ x).astype(np.float64))
        self.basis = np.ascontiguousarray(basis[:, ::-1][:, :rank].astype(np.float32))
        self.vectors = self._unit(x @ self.basis)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def _weigh(self, counts: np.ndarray) -> np.ndarray:
        return self._unit(np.log1p(counts) * self.weight)

    def score(self, counts: np.ndarray, empty: np.ndarray) -> np.ndarray:
        if not len(self.vectors):
            return np.where(empty, 0.0, self.prior)
        cosine = np.round(self._unit(self._weigh(counts) @ self.basis) @ self.vectors.T, DIGITS)
        k = min(self.k, cosine.shape[1])
        last = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
        weight = np.where(cosine >= last, np.maximum(cosine, 1e-3).astype(np.float64), 0.0) ** self.power
        got = (weight * self.labels).sum(1) / weight.sum(1)
        got[counts.sum(1) == 0] = self.prior
        return np.where(empty, 0.0, np.clip(got, 0.0, 1.0))


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, counts, _ in counted(batch.column("text")):
            rows = [x.tobytes() for x in counts]
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(lo, len(rows)), pa.array(rows, pa.binary())], names=["label", "terms"])


def _fit_rows(options: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((label, terms) for batch in batches for label, terms in zip(batch.column("label").to_pylist(), batch.column("terms").to_pylist(), strict=True))
        counts = np.frombuffer(b"".join(x[1] for x in rows), np.float32).reshape(len(rows), TERMS)
        voter = Voter(counts, np.array([x[0] for x in rows], np.float32), **options)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(voter)], pa.binary())], names=["model"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 2048, **options) -> Voter:
    """Fit on at most ``per_class`` labelled rows of each class."""
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    order = [F.xxhash64("id"), F.col("id")]
    sample = usable.where("label = 0").orderBy(*order).limit(per_class).unionByName(usable.where("label = 1").orderBy(*order).limit(per_class))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # The sample is bounded by 2 * per_class rows of two numbers.
    rows = texts.join(F.broadcast(sample), "id").select("label", "text").mapInArrow(_count_rows, "label int, terms binary")
    models = rows.repartition(1).mapInArrow(_fit_rows(options), "model binary").collect()
    return pickle.loads(bytes(models[0]["model"])) if models else Voter(np.zeros((0, TERMS), np.float32), np.zeros(0, np.float32), **options)


def classify_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.3,
    voter: Voter | None = None,
    score_col: str = "score",
    predicted_col: str = "predicted",
    **options,
) -> DataFrame:
    """The input's columns with score (double, 0 to 1) and predicted (int), which replace columns of these names."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(voter or fit(docs, labels, id_col, text_col, **options))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.value.score(counts, empty) for _, counts, empty in counted(batch.column(batch.schema.names.index(text_col)))]
            scores = np.concatenate(got) if got else np.zeros(0)
            arrays = [*batch.columns, pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, score_col, predicted_col])

    base = docs.drop(score_col, predicted_col)
    schema = StructType([*base.schema.fields]).add(score_col, DoubleType()).add(predicted_col, IntegerType())
    return base.mapInArrow(score, schema)
