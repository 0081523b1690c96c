"""Benchmark decontamination by SimHash of item-sized windows.

Every benchmark item has a 64-bit SimHash of its weighted shingles. Items of one
size share a multi-index: for each of eight 8-bit blocks of the fingerprint, a table from a
block's value to the items whose own block is within ``radius // 8`` bits of it. By the
pigeonhole principle the tables hold every item within ``radius`` of a fingerprint.
A document's windows of that size are fingerprinted where they overlap a
shingle of any item (a window without one has similarity 0 with all and can't match), and
the tables name the items to compare. Those within the radius are decided by exact
weighted Jaccard similarity of shingles, counted with their multiplicity.

The radius is a bound on fingerprints, not on similarity: a window at the threshold is
about 10 bits away, and 20 bits miss fewer than one in a thousand (measured in the tests).

The benchmark is read to the driver and broadcast only up to ``most_items`` items;
a larger one is processed in blocks of about that many, each a pass over the documents.
Long texts are fingerprinted in pieces of PIECE windows.

Defined results: null and empty texts match nothing; items with fewer words than
a shingle are one shingle, their whole sequence, and match as a run of words;
empty items match nothing; of windows that tie the first is reported; rows that repeat item identifier and text are one
item; repeated documents are each reported; a null identifier is reported as null; empty tables give an empty
result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapwright.llm.textbytes import mix64, runs, slices, word_bounds, word_hashes

BLOCKS, VALUES = 8, 256
#: Windows that are fingerprinted at once.
PIECE = 8192


def shingle_run(h: np.ndarray, k: int) -> np.ndarray:
    return runs(h, min(k, len(h)), seed=min(k, len(h))) if len(h) else np.zeros(0, np.uint64)


def planes(s: np.ndarray) -> np.ndarray:
    """(64, len + 1): sums over the shingles before each place of +1 and -1 for the bits of their hashes."""
    bits = (mix64(s ^ np.uint64(0xA0761D6478BD642F))[None, :] >> np.arange(64, dtype=np.uint64)[:, None]) & np.uint64(1)
    total = np.zeros((64, len(s) + 1), np.int32)
    np.cumsum(bits.astype(np.int32) * 2 - 1, axis=1, out=total[:, 1:])
    return total


def fingerprints(total: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """SimHashes of windows of ``size`` shingles from the given places on, as BLOCKS bytes each."""
    return np.packbits(total[:, first + size] > total[:, first], axis=0, bitorder="little").T


class SizeIndex:
    """The items of one shingle length and size, and their multi-index."""

    def __init__(self, prints: np.ndarray, items: np.ndarray, radius: int):
        self.items, self.radius, self.prints = items, radius, prints
        near = np.bitwise_count(np.arange(VALUES, dtype=np.uint8)[:, None, None] ^ prints[None]) <= radius // BLOCKS
        self.tables = np.packbits(near, axis=1)  # (value, items / 8, block)

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) for all items that a table names and that are within the radius."""
        hit = self.tables[prints[:, 0], :, 0]
        for b in range(1, BLOCKS):
            hit = hit | self.tables[prints[:, b], :, b]
        window, item = np.nonzero(np.unpackbits(hit, axis=1, count=len(self.items)))
        apart = np.bitwise_count(prints[window] ^ self.prints[item]).sum(1, dtype=np.int64)
        return window[apart <= self.radius], self.items[item[apart <= self.radius]]


class ItemIndex:
    """Items' shingles and an index for each of their sizes."""

    def __init__(self, ids: list, texts: list[str | None], k: int = 5, radius: int = 20):
        self.ids, self.sets, self.sizes, prints = [], [], [], []
        for i, (_, _, buf, off) in zip(ids, [x for t in texts for x in slices(pa.array([t], pa.string()))], strict=True):
            start, end, _ = word_bounds(buf, off)
            s = shingle_run(word_hashes(buf, start, end, lower=True), k)
            if len(s):
                self.ids.append(i)
                self.sets.append(np.unique(s, return_counts=True))
                self.sizes.append((min(k, len(start)), len(s)))
                prints.append(fingerprints(planes(s), np.zeros(1, np.int64), len(s))[0])
        self.lengths = sorted({length for length, _ in self.sizes})
        self.shingles, self.by_size = {}, {}
        for length in self.lengths:
            own = [i for i, x in enumerate(self.sizes) if x[0] == length]
            self.shingles[length] = np.unique(np.concatenate([self.sets[i][0] for i in own]))
            for size in sorted({self.sizes[i][1] for i in own}):
                same = np.array([i for i in own if self.sizes[i][1] == size])
                self.by_size[length, size] = SizeIndex(np.array([prints[i] for i in same]), same, radius)
        self.filter = np.zeros(1 << 16, bool)
        for s in self.shingles.values():
            self.filter[(s & np.uint64(0xFFFF)).astype(np.int64)] = True

    def hot(self, s: np.ndarray, length: int) -> np.ndarray:
        """Places of a run of shingles that some item has."""
        p = np.flatnonzero(self.filter[(s & np.uint64(0xFFFF)).astype(np.int64)])
        known = self.shingles[length]
        return p[known[np.minimum(np.searchsorted(known, s[p]), len(known) - 1)] == s[p]]

    def similarity(self, s: np.ndarray, item: int) -> tuple[int, int]:
        """Shared shingles and all shingles of a window and an item, with their multiplicity."""
        u, c = np.unique(s, return_counts=True)
        own, mult = self.sets[item]
        _, x, y = np.intersect1d(u, own, assume_unique=True, return_indices=True)
        both = int(np.minimum(c[x], mult[y]).sum())
        return both, len(s) + self.sizes[item][1] - both

    def matches(self, h: np.ndarray, percent: int) -> list[tuple[int, int, float]]:
        """(item, first word, similarity) of the best window of each item that matches; h: the text's word hashes."""
        best: dict[int, tuple[float, int]] = {}
        for length in self.lengths:
            s = shingle_run(h, length) if len(h) >= length else np.zeros(0, np.uint64)
            hot = self.hot(s, length)
            if not len(hot):
                continue
            sizes = [m for n, m in self.by_size if n == length]
            most = min(max(sizes), len(s))
            # Stretches of windows of any size that overlap a hot place.
            new = np.flatnonzero(np.r_[True, np.diff(hot) >= 2 * most])
            for a, b in zip(np.maximum(hot[new] - most + 1, 0), hot[np.r_[new[1:], len(hot)] - 1] + 1, strict=True):
                for lo in range(int(a), int(b), PIECE):
                    hi = min(lo + PIECE, int(b))
                    total = planes(s[lo : hi + most])
                    seen = np.searchsorted(hot, np.arange(lo, min(hi + most, len(s)) + 1))
                    for m in sizes:
                        size = min(m, len(s))
                        if 100 * size < percent * m:
                            continue
                        first = np.arange(min(hi, len(s) - size + 1) - lo)
                        first = first[seen[first + size] > seen[first]] if len(first) else first
                        if not len(first):
                            continue
                        for w, item in zip(*self.by_size[length, m].candidates(fingerprints(total, first, size)), strict=True):
                            at = lo + int(first[w])
                            both, every = self.similarity(s[at : at + size], item)
                            if 100 * both >= percent * every and both / every > best.get(int(item), (0.0, 0))[0]:
                                best[int(item)] = (both / every, at)
        return [(item, at, sim) for item, (sim, at) in sorted(best.items())]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    k: int = 5,
    percent: int = 80,
    radius: int = 20,
    most_items: int = 1000,
) -> DataFrame:
    """Rows (document, item, first_word, n_words, similarity), the best window of each pair."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).cast("string").alias("t")).distinct()
    schema = f"{id_col} long, {item_col} long, first_word long, n_words long, similarity double"
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    n_blocks = max(1, -(-items.count() // most_items))
    out = None
    for block in range(n_blocks):
        own = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == block)
        rows = own.orderBy("i", "t").collect()
        index = spark.sparkContext.broadcast(ItemIndex([r["i"] for r in rows], [r["t"] for r in rows], k, radius))

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            it = index.value
            for batch in batches:
                ids, rows = batch.column("id").to_pylist(), []
                for lo, hi, buf, off in slices(batch.column("text")):
                    start, end, row = word_bounds(buf, off)
                    h = word_hashes(buf, start, end, lower=True)
                    first = np.searchsorted(row, np.arange(hi - lo + 1))
                    # One look at all shingles of the run; rows without any hit end here.
                    hot: set[int] = set()
                    for length in it.lengths:
                        if len(h) >= length:
                            hot |= set(row[it.hot(shingle_run(h, length), length)].tolist())
                    for r in sorted(hot):
                        for item, w, sim in it.matches(h[first[r] : first[r + 1]], percent):
                            size, m = it.sizes[item]
                            n = min(m + size - 1, int(first[r + 1] - first[r]) - w)
                            rows.append((ids[lo + r], it.ids[item], w, n, sim))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=[id_col, item_col, "first_word", "n_words", "similarity"])

        part = base.mapInArrow(scan, schema)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without those that hold a benchmark item, each judged by its own text, whatever its identifier."""
    key = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(9))
    found = find_contamination(docs.select(key.alias("key"), F.col(text_col).alias("text")), benchmark, "key", "text", **options)
    hit = found.select(F.col("key").alias("mapwright_hit")).distinct()
    return docs.join(hit, key == F.col("mapwright_hit"), "left_anti")
