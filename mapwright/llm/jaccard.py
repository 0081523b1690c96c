"""Near duplicates: all links of shingle-set Jaccard similarity, and their components.

1. Each text's sorted set of shingle hashes is reduced to a 128-bit key and its
   size; texts with equal sets form one class, named by its least identifier,
   and one text of each goes on.
2. All shingles are counted in a table of hashed counters of fixed size. One global order
   follows from it: shingles of crowded counters last, else by hash. A class posts the
   part of its set, in that order, that any partner must share a shingle with (the
   first ``size - ceil(t * size) + 1``).
3. Classes are banded by size: partners' sizes differ by a factor 1/t at most, so only
   the same and the next band matter. The classes of a band that post one shingle, with
   those of the next band, are a list; lists are joined into one tile if the same class
   has their least hash, so the many lists of a group of near copies make a few tiles,
   and a class is in as many tiles as it has such leads.
4. A tile is dealt into units of two blocks of bounded size, a class to its block by hash. A pair
   is judged in the first of the tiles that both are in: bit counts of hashed bitmap signatures
   bound its overlap from above, and classes with a partner that may reach the threshold meet
   again with their sorted hash arrays, whose exact intersections decide.
5. A unit hands on one row for each class that has links: their number, and the root of
   the class in a forest of the unit's links. Components follow from these.

No pair of classes becomes a row, and nothing is capped.

Defined results: null and empty texts have no shingles and link with nothing;
shorter texts are one shingle, their whole sequence of words; rows that repeat
an identifier are one document to links: the classes of their texts are in one
component, and share their number of links; an empty table gives an empty result.
A null identifier makes no class; its row shows those of its text, if any. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapwright.llm.common import Scratch
from mapwright.llm.textbytes import mix64, runs, slices, word_bounds, word_hashes
from mapwright.operators.components import least_reachable

#: Bitmaps have at least four times as many bits as their sets have shingles, within these bounds.
LEAST_BITS, MOST_BITS = 256, 1 << 18
#: A list of at most this many identifiers is sent to all tasks.
MOST_SENT = 250_000
#: Hashed counters of shingles, and the rows that carry those of one task.
COUNTERS, SLOTS = 1 << 16, 16
#: Shingles of a block; a class takes LEAST_ROOM of them at least, so that a unit's pairs are bounded too.
BLOCK, LEAST_ROOM = 1 << 20, 1 << 10
#: Rows of a block whose pairs are bounded at once.
STEP = 512


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a batch, lower-cased A-Z."""
    for lo, hi, buf, off in slices(column):
        start, end, row = word_bounds(buf, off)
        h = word_hashes(buf, start, end, lower=True)
        first = np.searchsorted(row, np.arange(hi - lo + 1))
        run = runs(h, k)
        for i in range(hi - lo):
            a, b = first[i], first[i + 1]
            if b - a >= k:
                s = np.sort(run[a : b - k + 1])
                yield s[np.r_[True, s[1:] != s[:-1]]]
            elif b > a:
                yield runs(h[a:b], int(b - a), seed=1000 + int(b - a))
            else:
                yield np.zeros(0, np.uint64)


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that identify a set."""
    with np.errstate(over="ignore"):
        a = np.bitwise_xor.reduce(mix64(s + np.uint64(77))) + np.add.reduce(mix64(s ^ np.uint64(0x5851F42D4C957F2D)))
        b = np.add.reduce(mix64(s + np.uint64(0x2545F4914F6CDD1D))) ^ np.uint64(len(s))
    key = mix64(np.array([a, b], np.uint64)).view(np.int64)
    return int(key[0]), int(key[1])


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap with which sizes a and b reach the threshold."""
    return -(-percent * (a + b) // (100 + percent))


def n_posted(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _band(n: np.ndarray, percent: int) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / np.log(100 / percent) + 1e-9).astype(np.int32)


def crowding(counts: np.ndarray) -> np.ndarray:
    """0 for counters as full as chance makes them, else a level that grows with the excess."""
    mean = counts.mean()
    least = 6 * np.sqrt(mean) + 32
    return np.where(counts > mean + least, 1 + np.floor(np.log2(np.maximum(counts - mean, least) / least)), 0).astype(np.uint8)


def posted(s: np.ndarray, level: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of a sorted set that its class posts."""
    crowded = level[(s >> np.uint64(48)).astype(np.int64)]
    if crowded.any():
        s = s[np.argsort(crowded, kind="stable")]
    return s[: n_posted(len(s), percent)]


def _leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lead, band, cls, n, own) for rows (token, band, cls, n) sorted by token, band and hash of the class.

    ``own`` marks classes of the list's band. The lead of a list is its first row; lists of one class make nothing. Of a list that a
    batch ends in, the first row is carried over, with that of the list of the band below.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        token, band, cls, n = (batch.column(c).to_numpy() for c in ("token", "band", "cls", "n"))
        done = np.zeros(len(token), bool)
        old = 0
        if held is not None:
            old = len(held[0])
            token, band, cls, n, done = (np.concatenate(x) for x in zip(held, (token, band, cls, n, done), strict=True))
        new = np.r_[True, (token[1:] != token[:-1]) | (band[1:] != band[:-1])]
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        size = np.diff(np.r_[first, len(token)])
        next_up = (token[first[1:]] == token[first[:-1]]) & (band[first[1:]] == band[first[:-1]] + 1)
        above, below = np.r_[next_up, False], np.r_[False, next_up]
        own = ((size > 1) | above)[group] & ~done
        up = below[group]
        up[:old] = False
        lead = cls[first]
        i, j = np.flatnonzero(own), np.flatnonzero(up)
        parts = [(lead[group[i]], band[i], cls[i], n[i], np.ones(len(i), bool)), (lead[group[j] - 1], band[j] - 1, cls[j], n[j], np.zeros(len(j), bool))]
        arrays = [pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)]
        if len(arrays[0]):
            yield pa.RecordBatch.from_arrays(arrays, names=["lead", "band", "cls", "n", "own"])
        keep = first[-2:] if len(first) > 1 and below[-1] else first[-1:]
        held = (token[keep], band[keep], cls[keep], n[keep], (done | own)[keep])


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all of b."""
    shared = np.intersect1d(np.concatenate(a), np.concatenate(b))
    out = np.zeros((len(a), len(b)), np.int64)
    if not len(shared):
        return out

    def cells(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(shared, flat), len(shared) - 1)
        hit = shared[at] == flat
        order = np.argsort(at[hit], kind="stable")
        return row[hit][order], at[hit][order]

    sides = [cells(a), cells(b)]
    step = max(1024, (1 << 22) // sum(out.shape))
    for lo in range(0, len(shared), step):
        width, marks = min(step, len(shared) - lo), []
        for (row, at), n in zip(sides, out.shape, strict=True):
            x, y = np.searchsorted(at, [lo, lo + width])
            m = np.zeros((n, width), np.float32)  # sums below 2 ** 24 are exact
            m[row[x:y], at[x:y] - lo] = 1
            marks.append(m)
        out += (marks[0] @ marks[1].T).astype(np.int64)
    return out


def bitmap(s: np.ndarray) -> bytes:
    """One bit for each shingle, hashed into places (which may coincide); sizes decide the width."""
    width = min(MOST_BITS, max(LEAST_BITS, 1 << (4 * len(s) - 1).bit_length()))
    marks = np.zeros(width, bool)
    marks[(mix64(s ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(marks, bitorder="little").tobytes()


def _same_width(maps: list[bytes], words: int) -> np.ndarray:
    """Bitmaps as rows, folded to the width of the narrowest."""
    out = np.empty((len(maps), words), np.uint64)
    for i, x in enumerate(maps):
        bits = np.frombuffer(x, np.uint64)
        while len(bits) > words:
            bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
        out[i] = bits
    return out


def may_link(maps_a: list[bytes], na: np.ndarray, maps_b: list[bytes], nb: np.ndarray, percent: int) -> np.ndarray:
    """Where bit counts allow two sets to reach the threshold: a shingle whose bit the other side lacks isn't shared."""
    words = min(len(x) for x in [*maps_a, *maps_b]) // 8
    a, b = _same_width(maps_a, words), _same_width(maps_b, words)
    ones_a, ones_b = (np.bitwise_count(x).sum(1, dtype=np.int64) for x in (a, b))
    both = np.empty((len(a), len(b)), np.int64)
    step = max(1, (1 << 20) // b.size)
    for x in range(0, len(a), step):
        both[x : x + step] = np.bitwise_count(a[x : x + step, None, :] & b[None, :, :]).sum(2, dtype=np.int64)
    most = np.minimum((na - ones_a)[:, None] + both, (nb - ones_b)[None, :] + both)
    return most >= needed(na[:, None], nb[None, :], percent)


def linked(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of a link with which of b, by exact intersection."""
    if len(a) * len(b) <= 8:
        common = np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in b] for x in a])
    else:
        common = _overlaps(a, b)
    na, nb = (np.array([len(x) for x in side]) for side in (a, b))
    return 100 * common >= percent * (na[:, None] + nb[None, :] - common)


def _forest(link: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the first row that its links lead to."""
    root = np.full(len(link), -1)
    for i in range(len(link)):
        if root[i] >= 0:
            continue
        root[i] = i
        edge = np.array([i])
        while len(edge):
            edge = np.flatnonzero(link[edge].any(0) & (root < 0))
            root[edge] = i
    return root


class _Unit:
    """The rows of one unit: which pairs of them are this unit's to judge."""

    def __init__(self, rows: dict[str, list]):
        self.cls, self.side, self.own = np.array(rows["cls"]), np.array(rows["side"]), np.array(rows["own"])
        self.earlier = [np.array(x, np.int64) for x in rows["earlier"]]

    def blocks(self, step: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Pairs of runs of at most ``step`` rows that hold all pairs of the unit."""
        left, right = ([at[x : x + step] for x in range(0, len(at), step)] for at in (np.flatnonzero(self.side == 0), np.flatnonzero(self.side == 1)))
        return [(x, y) for x in left for y in right] if right else [(x, y) for i, x in enumerate(left) for y in left[i:]]

    def only(self, pairs: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """``pairs`` of rows x and y without those of one class, of the upper band alone, or of an earlier tile."""
        pairs = pairs & (self.own[x][:, None] | self.own[y][None, :]) & (self.cls[x][:, None] != self.cls[y][None, :])
        if pairs.any() and any(len(self.earlier[i]) for i in x) and any(len(self.earlier[i]) for i in y):
            pairs &= _overlaps([self.earlier[i] for i in x], [self.earlier[i] for i in y]) == 0
        return pairs


def _open_rows(rows: dict[str, list], percent: int) -> np.ndarray:
    """Rows of a unit that have a partner as far as bit counts tell."""
    unit, n = _Unit(rows), np.array(rows["n"])
    found = np.zeros(len(n), bool)
    for x, y in unit.blocks(STEP):
        fit = may_link([rows["bits"][i] for i in x], n[x], [rows["bits"][i] for i in y], n[y], percent)
        fit = unit.only(fit, x, y)
        found[x] |= fit.any(1)
        found[y] |= fit.any(0)
    return np.flatnonzero(found)


def _links(rows: dict[str, list], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cls, root, links) of the classes of a unit that have links which no earlier tile counts."""
    unique = {(side, cls, text): i for i, (side, cls, text) in reversed([*enumerate(zip(rows["side"], rows["cls"], rows["hashes"], strict=True))])}
    if len(unique) < len(rows["cls"]):  # rows that repeat identifier and text
        rows = {c: [x[i] for i in sorted(unique.values())] for c, x in rows.items()}
    unit, sets = _Unit(rows), [np.frombuffer(x, np.uint64) for x in rows["hashes"]]
    link = np.zeros((len(sets), len(sets)), bool)
    for x, y in unit.blocks(STEP):
        found = unit.only(linked([sets[i] for i in x], [sets[i] for i in y], percent), x, y)
        link[np.ix_(x, y)] |= found
        link[np.ix_(y, x)] |= found.T
    links = link.sum(1)
    has = np.flatnonzero(links)
    return unit.cls[has], unit.cls[has][_forest(link[np.ix_(has, has)])], links[has]


def _by_unit(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[int, dict[str, list]]]:
    """Sorted units of more than one row, one at a time."""
    held: dict[str, list] = {c: [] for c in names}
    at = None
    for batch in batches:
        if not batch.num_rows:
            continue
        unit = batch.column("unit").to_numpy()
        cuts = np.r_[0, np.flatnonzero(unit[1:] != unit[:-1]) + 1, len(unit)]
        columns = {c: batch.column(c).to_pylist() for c in names}
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if unit[s] != at:
                if len(held["cls"]) > 1:
                    yield at, held
                at, held = int(unit[s]), {c: [] for c in names}
            for c in names:
                held[c] += columns[c][s:e]
    if len(held["cls"]) > 1:
        yield at, held


def _bounded(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"unit": pa.int64(), "cls": pa.int64(), "side": pa.int32(), "own": pa.bool_(), "earlier": pa.list_(pa.int64())}
        out: dict[str, list] = {c: [] for c in kinds}
        for unit, rows in _by_unit(batches, ["cls", "side", "own", "earlier", "n", "bits"]):
            at = _open_rows(rows, percent).tolist()
            out["unit"] += [unit] * len(at)
            for c in ("cls", "side", "own", "earlier"):
                out[c] += [rows[c][i] for i in at]
            if len(out["unit"]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in kinds.items()], names=[*kinds])
                out = {c: [] for c in kinds}
        yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in kinds.items()], names=[*kinds])

    return run


def _decided(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, waiting = [], 0
        for _, rows in _by_unit(batches, ["cls", "side", "own", "earlier", "hashes"]):
            out.append(_links(rows, percent))
            waiting += len(out[-1][0])
            if waiting > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], names=["cls", "root", "links"])
                out, waiting = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], names=["cls", "root", "links"])

    return run


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: identifier, n_shingles, class_id, component_id, n_links.

    ``class_id`` is the smallest identifier with the same set, ``component_id``
    the smallest reachable by links, ``n_links`` the number of other classes
    that the class links with, all of them.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "key", "more", "n", "slot", "counts"]
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            key, n = [], []
            for s in shingle_sets(batch.column("text"), k):
                key.append(set_key(s))
                n.append(len(s))
                np.add.at(counts, (s >> np.uint64(48)).astype(np.int64), 1)
            a, b = zip(*key, strict=True) if key else ((), ())
            none = pa.nulls(len(n))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], names=names)
        blobs = [x.tobytes() for x in counts.reshape(SLOTS, -1)]
        none = pa.nulls(SLOTS, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(range(SLOTS), pa.int32()), pa.array(blobs, pa.binary())], names=names)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, blob in zip(batch.column("slot").to_pylist(), batch.column("counts"), strict=True):
                got = np.frombuffer(blob.as_buffer(), np.int64)
                total[slot] = total[slot] + got if slot in total else got.copy()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["slot", "counts"])

    first = scratch.keep(base.mapInArrow(keyed, "id long, key long, more long, n long, slot int, counts binary"), "keyed")
    # SLOTS rows, COUNTERS numbers in all, whatever the input.
    slots = first.where("slot is not null").select("slot", "counts").repartition(SLOTS, "slot").mapInArrow(summed, "slot int, counts binary").collect()
    counts = np.zeros((SLOTS, COUNTERS // SLOTS), np.int64)
    for row in slots:
        counts[row["slot"]] += np.frombuffer(bytes(row["counts"]), np.int64)
    level = spark.sparkContext.broadcast(crowding(counts.reshape(-1)))

    rows = first.where("slot is null").select("id", "key", "more", "n")
    named = rows.where("n > 0 and id is not null").groupBy("key", "more", "n").agg(F.min("id").alias("rep"))
    placed = scratch.keep(rows.join(named, ["key", "more", "n"], "left").select("id", "n", "rep"), "placed")
    scratch.drop("keyed")
    by_id = placed.where("id is not null and rep is not null").groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"))
    copies = scratch.keep(by_id.where("lo <> id").select("id"), "copies")
    strange = by_id.where("lo <> hi").select("id", "lo")
    same_id = placed.join(strange, "id").select(F.col("rep").alias("u"), F.col("lo").alias("v")).where("u <> v")
    # One number for each text that another row holds too: sent to all tasks up to a fixed count, else joined.
    few = F.broadcast(copies) if copies.count() <= MOST_SENT else copies
    single = base.where("id is not null").join(few, "id", "left_anti")

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, n, who = [], [], batch.column("id").to_numpy()
            for s in shingle_sets(batch.column("text"), k):
                token.append(posted(s, level.value, percent).view(np.int64) if len(s) else s.view(np.int64))
                n.append(len(s))
            if token:
                n, many = np.array(n, np.int32), [len(t) for t in token]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token)), pa.array(np.repeat(_band(n, percent), many)), pa.array(np.repeat(who, many)), pa.array(np.repeat(n, many))], names=["token", "band", "cls", "n"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [s.tobytes() for s in shingle_sets(batch.column("text"), k)]
            kept = pa.array([bool(x) for x in hashes], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(kept), pa.array(hashes, pa.binary()).filter(kept)], names=["cls", "hashes"])

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, bits = [], []
            for s in shingle_sets(batch.column("text"), k):
                n.append(len(s))
                bits.append(bitmap(s) if len(s) else None)
            kept = pa.array([x > 0 for x in n], pa.bool_())
            yield pa.RecordBatch.from_arrays([x.filter(kept) for x in (batch.column("id"), pa.array(n, pa.int64()), pa.array(bits, pa.binary()))], names=["cls", "n", "bits"])

    def only(ids: DataFrame, name: str) -> DataFrame:
        wanted = scratch.keep(ids.distinct(), name)
        return single.join(F.broadcast(wanted) if wanted.count() <= MOST_SENT else wanted, "id", "left_semi")

    postings = single.mapInArrow(post, "token long, band int, cls long, n int")
    lists = postings.repartition("token").sortWithinPartitions("token", "band", F.xxhash64("cls"), "cls").mapInArrow(_leads, "lead long, band int, cls long, n int, own boolean")
    members = scratch.keep(lists.groupBy("cls", "band", "own").agg(F.max("n").alias("n"), F.sort_array(F.collect_set("lead")).alias("leads")), "members")
    one = members.select("cls", "band", "own", "n", "leads", F.explode("leads").alias("lead"))
    blocks = one.groupBy("lead", "band").agg(F.ceil(F.sum(F.greatest("n", F.lit(LEAST_ROOM))) / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    dealt = one.join(blocks, ["lead", "band"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("cls", F.lit(3)), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = met.select(
        "cls",
        F.xxhash64("lead", "band", F.least("block", "other"), F.greatest("block", "other")).alias("unit"),
        F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"),
        "own",
        F.filter("leads", lambda x: x < F.col("lead")).alias("earlier"),
    )
    signed = units.join(only(members.select(F.col("cls").alias("id")), "in-tiles").mapInArrow(signatures, "cls long, n long, bits binary"), "cls")
    bounded = signed.repartition("unit").sortWithinPartitions("unit", "side", "cls").mapInArrow(_bounded(percent), "unit long, cls long, side int, own boolean, earlier array<long>")
    rest = scratch.keep(bounded, "bounded")
    held = rest.join(only(rest.select(F.col("cls").alias("id")), "with-partners").mapInArrow(sets, "cls long, hashes binary"), "cls")
    decided = held.repartition("unit").sortWithinPartitions("unit", "side", "cls").mapInArrow(_decided(percent), "cls long, root long, links long")
    found = scratch.keep(decided, "links")
    for name in ("members", "in-tiles", "bounded", "with-partners"):
        scratch.drop(name)
    edges = found.select(F.col("cls").alias("a"), F.col("root").alias("b")).unionByName(same_id.toDF("a", "b"))
    final = scratch.keep(least_reachable(edges, scratch, "cc"), "components")
    degrees = found.groupBy(F.col("cls").alias("rep")).agg(F.sum("links").alias("n_links"))
    out = placed.join(final.toDF("rep", "component"), "rep", "left").join(degrees, "rep", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("rep", "id").alias("class_id"), F.coalesce("component", "rep", "id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
