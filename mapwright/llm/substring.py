"""Passages that occur earlier in the corpus, found with suffix automata and removed.

A window is ``window`` consecutive words of one document. Every window is filed under
the least hash among its shorter runs of words (its anchor), so equal windows meet
under the same anchor. The windows of a document that share an anchor are one
context, about 25 words. Anchors with a single occurrence end here.

Contexts of an anchor are the reference, in the order of the corpus; identical contexts are
streamed once, and all but their first are repeats as a whole. Reference
shards, whole anchors up to ``shard_words`` words, become suffix automata whose
states know where their words first end. Contexts are streamed through the
automata of their anchor's shards for matching statistics: a window is a repeat where
the match covers it and first ended earlier. An anchor with more words than a
shard is several automata, each sent the contexts that come after its own.

The most frequent anchors, which a list of bounded size names, are dealt to salted groups,
each of which judges its contexts by itself as they pass. Their first contexts, and those of
anchors with more than ``crowded`` different ones, don't stay together: each of their windows
is looked at by itself, under 128 bits of its words, in salted groups whose first windows are
compared once more. What any other anchor holds in a task is bounded by ``crowded``
contexts, or by one in MOST_SENT of all rows if that is more.

Shards hold contexts rather than being broadcast whole: the anchor says which
shard can match, which saves streaming every document through every shard.

Defined results: a null text has no words; texts shorter than a window lose
nothing; a null identifier comes before all others; rows that repeat identifier and
text are one document, each with its row in the result; rows that share an
identifier but not the text come in the order of a hash of the text; an empty table
gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mapwright.llm.common import Scratch
from mapwright.llm.textbytes import keys, mix64, runs, slices, word_bounds, word_hashes

ROW = "anchor long, context long, id long, mark long, lo int, n int, hot boolean"
CUT = "anchor long, second long, id long, mark long, lo int, words binary"
#: Frequent anchors are 8 bytes; a list of at most this many is sent to all tasks.
MOST_SENT = 1_000_000
#: A frequent anchor's or window's rows are dealt to this many groups.
SALTS = 256


class SuffixAutomaton:
    """Over sequences of words, with the first end of each state's words."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        self.last, self.size = 0, 0

    def extend(self, word: int) -> None:
        nxt, link, length, first = self.next, self.link, self.length, self.first
        cur = len(nxt)
        nxt.append({})
        length.append(length[self.last] + 1)
        first.append(self.size)
        link.append(0)
        self.size += 1
        p = self.last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                first.append(first[q])
                link.append(link[q])
                while p >= 0 and nxt[p].get(word) == q:
                    nxt[p][word] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        self.last = cur

    def earlier(self, words: list[int], window: int, own_start: int | None) -> list[int]:
        """Starts of windows of ``words`` that first ended before their own place.

        ``own_start`` is where ``words`` stand in the automaton's text; None: everything there is earlier.
        """
        nxt, link, length, first = self.next, self.link, self.length, self.first
        state = matched = 0
        found = []
        for i, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                matched = length[state]
            to = nxt[state].get(w)
            if to is None:
                matched = 0
                continue
            state, matched = to, matched + 1
            if matched >= window:
                while length[link[state]] >= window:
                    state = link[state]
                matched = min(matched, length[state])
                if own_start is None or first[state] < own_start + i:
                    found.append(i - window + 1)
        return found


def anchors(h: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, number of windows, place of the anchor in the first window) of one text."""
    gram = runs(h, k, seed=31)
    view = np.lib.stride_tricks.sliding_window_view(gram, window - k + 1)
    place = view.argmin(axis=1) + np.arange(len(view))
    start = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return gram[place[start]], start, np.diff(np.r_[start, len(place)]), place[start] - start


def text_mark(h: np.ndarray) -> int:
    """A hash of a sequence of words, which tells texts of one identifier apart."""
    with np.errstate(over="ignore"):
        q = mix64(np.arange(1, len(h) + 1, dtype=np.uint64))
        return int(mix64(np.array([np.add.reduce(mix64(h ^ q))], np.uint64)).view(np.int64)[0])


def _texts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, word starts, word ends, word hashes) of each text of a batch."""
    for lo, hi, buf, off in slices(column):
        start, end, row = word_bounds(buf, off)
        h = word_hashes(buf, start, end)
        first = np.searchsorted(row, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            s = slice(first[i], first[i + 1])
            yield buf, start[s], end[s], h[s]


def _file_windows(window: int, k: int, hot: int):
    q = keys(2 * window, 41)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cols = batch.column("id").to_numpy(zero_copy_only=False), [[] for _ in range(6)]
            for i, (_, _, _, h) in enumerate(_texts(batch.column("text"))):
                if len(h) < window:
                    continue
                a, lo, n, at = anchors(h, window, k)
                # A context's hash: its words by place, its length and its anchor's place.
                total = np.zeros((2 * window, len(lo)), np.uint64)
                for j in range(int(n.max()) + window - 1):
                    inside = j < n + window - 1
                    total[j, inside] = h[lo[inside] + j] * q[j]
                context = mix64(total.sum(0, dtype=np.uint64) + mix64(n.astype(np.uint64) * np.uint64(64) + at.astype(np.uint64)))
                for c, x in zip(cols, (a.view(np.int64), context.view(np.int64), np.full(len(lo), ids[i]), np.full(len(lo), text_mark(h)), lo.astype(np.int32), n.astype(np.int32)), strict=True):
                    c.append(x)
            if cols[0]:
                whole = [np.concatenate(c) for c in cols]
                _, back, count = np.unique(whole[0], return_inverse=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*whole, count[back] >= hot)], names=["anchor", "context", "id", "mark", "lo", "n", "hot"])

    return run


def _judge_contexts(crowded: int):
    """Of sorted rows: repeats of a whole context (open 0), and first contexts of anchors with several (1) or too many (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        names = ["anchor", "salt", "context", "id", "mark", "lo", "n"]

        def judged(c: dict[str, np.ndarray]) -> pa.RecordBatch | None:
            a, x = c["anchor"], c["context"]
            new = np.r_[True, (a[1:] != a[:-1]) | (c["salt"][1:] != c["salt"][:-1])]
            frequent = c["salt"] >= 0
            first = new | np.r_[True, x[1:] != x[:-1]]
            twice = ~first & np.r_[False, (c["id"][1:] == c["id"][:-1]) & (c["mark"][1:] == c["mark"][:-1]) & (c["lo"][1:] == c["lo"][:-1])]
            # A row that repeats identifier, text and place is the same occurrence; only its first
            # occurrence's decision stands, which is the previous row's.
            group = np.cumsum(new) - 1
            contexts = np.bincount(group, first)[group]
            state = np.where(first, np.where(frequent | (contexts > crowded), 2, 1), 0).astype(np.int32)
            keep = (~first & ~twice) | (first & (frequent | (contexts > 1)))
            head = np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
            same = (c["id"] == c["id"][head]) & (c["mark"] == c["mark"][head]) & (c["lo"] == c["lo"][head])
            keep &= first | ~same
            if not keep.any():
                return None
            return pa.RecordBatch.from_arrays([*[pa.array(c[n][keep]) for n in ("anchor", "id", "mark", "lo", "n")], pa.array(state[keep])], names=["anchor", "id", "mark", "lo", "n", "open"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {n: batch.column(n).to_numpy() for n in names}
            frequent = cols["salt"][-1] >= 0
            held.append(cols)
            if not frequent and held[0]["anchor"][-1] == cols["anchor"][-1]:
                continue
            cols = {n: np.concatenate([c[n] for c in held]) for n in names}
            if frequent:
                # All of it is judged; the last context's first and last row stay for what follows and are judged
                # once more, which repeats decisions but changes none.
                out = judged(cols)
                if out is not None:
                    yield out
                moved = np.flatnonzero((cols["salt"][1:] != cols["salt"][:-1]) | (cols["context"][1:] != cols["context"][:-1]) | (cols["anchor"][1:] != cols["anchor"][:-1]))
                ends = np.unique([moved[-1] + 1 if len(moved) else 0, len(cols["salt"]) - 1])
                held = [{n: v[ends] for n, v in cols.items()}]
                continue
            cut = int(np.searchsorted(cols["anchor"], cols["anchor"][-1], "left"))
            if cut:
                out = judged({n: v[:cut] for n, v in cols.items()})
                if out is not None:
                    yield out
            held = [{n: v[cut:] for n, v in cols.items()}]
        if held:
            out = judged({n: np.concatenate([c[n] for c in held]) for n in names})
            if out is not None:
                yield out

    return run


def _stream(window: int, shard_words: int):
    """Contexts sorted by anchor and place in the corpus: the windows of each that are repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        words = 0
        out: list[tuple[int, int, int]] = []

        def automaton(part: list[tuple]) -> tuple[SuffixAutomaton, list[int]]:
            sam, starts = SuffixAutomaton(), []
            for i, r in enumerate(part):
                starts.append(sam.size)
                for w in r[4]:
                    sam.extend(w)
                sam.extend(-1 - i)  # no match reaches across contexts
            return sam, starts

        def report(r: tuple, found: list[int]) -> None:
            out.extend((r[1], r[2], r[3] + i) for i in found)

        def solve(part: list[tuple]) -> None:
            """Whole anchors, or one anchor of any size by shards."""
            lo = 0
            while lo < len(part):
                hi, n = lo, 0
                while hi < len(part) and (n < shard_words or hi == lo):
                    n += len(part[hi][4])
                    hi += 1
                sam, starts = automaton(part[lo:hi])
                for r, at in zip(part[lo:hi], starts, strict=True):
                    report(r, sam.earlier(r[4], window, at))
                for r in part[hi:]:
                    report(r, sam.earlier(r[4], window, None))
                lo = hi

        def flush() -> pa.RecordBatch | None:
            if not out:
                return None
            ids, mark, lo = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(mark, pa.int64()), pa.array(lo, pa.int32()), pa.array(np.ones(len(ids), np.int32))], names=["id", "mark", "lo", "n"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("anchor", "id", "mark", "lo", "words")]
            for anchor, i, mark, lo, raw in zip(*cols, strict=True):
                if rows and words >= shard_words and rows[-1][0] != anchor:
                    solve(rows)
                    rows, words = [], 0
                    got = flush()
                    if got is not None:
                        yield got
                w = np.frombuffer(raw, np.int64).tolist()
                rows.append((anchor, i, mark, lo, [x if x >= 0 else x & 0x7FFFFFFFFFFFFFFF for x in w]))
                words += len(w)
        if rows:
            solve(rows)
        got = flush()
        if got is not None:
            yield got

    return run


def _repeated_windows(windows: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, mark, lo, n) of the windows that aren't the first of their words."""
    place = F.struct("id", "mark", "lo")
    nth = F.rank().over(W.partitionBy("anchor", "second", "salt").orderBy("id", "mark", "lo"))
    placed = scratch.keep(windows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).withColumn("nth", nth), "windows")
    # No window has more than SALTS rows from here on.
    local = placed.where("nth = 1").select("anchor", "second", "id", "mark", "lo").distinct()
    first = local.groupBy("anchor", "second").agg(F.min(place).alias("first"))
    beyond = local.join(first, ["anchor", "second"]).where(place != F.col("first"))
    return placed.where("nth > 1").select("id", "mark", "lo").unionByName(beyond.select("id", "mark", "lo")).withColumn("n", F.lit(1))


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 20,
    anchor_words: int = 10,
    shard_words: int = 40_000,
    crowded: int = 4096,
    hot: int = 64,
) -> DataFrame:
    """One row per input row: identifier, n_words, n_removed, kept (the words left, joined by a space).

    Anchors that some batch holds ``hot`` times are counted beforehand. Neither ``shard_words``,
    ``crowded`` nor ``hot`` changes the result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    least = -(1 << 63)
    base = docs.select(F.col(id_col).cast("long").alias("real_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(least)).alias("id"), F.col(text_col).cast("string").alias("text"))
    filed = scratch.keep(base.select("id", "text").mapInArrow(_file_windows(window, anchor_words, hot), ROW), "filed")
    # Fewer than MOST_SENT anchors can hold more than one in MOST_SENT of all rows each.
    bar = max(crowded, filed.count() // MOST_SENT)
    frequent = scratch.keep(filed.where("hot").groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > bar).select(F.col("anchor").alias("frequent")), "frequent")
    salt = F.when(F.col("frequent").isNull(), -1).otherwise(F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    salted = filed.join(F.broadcast(frequent), F.col("anchor") == F.col("frequent"), "left").select("anchor", salt.alias("salt"), "context", "id", "mark", "lo", "n")
    dealt = salted.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "context", "id", "mark", "lo")
    judged = scratch.keep(dealt.mapInArrow(_judge_contexts(crowded), "anchor long, id long, mark long, lo int, n int, open int"), "judged")

    # First contexts of anchors that have several: their words come from the texts once more.
    wanted = judged.where("open > 0").groupBy("id").agg(F.collect_list(F.struct("mark", "anchor", "lo", "n", "open")).alias("wanted"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "second", "id", "mark", "lo", "words"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        for batch in batches:
            ids, wanted, rows = batch.column("id").to_pylist(), batch.column("wanted"), []
            single: list[list[np.ndarray]] = [[] for _ in range(5)]
            for i, (_, _, _, h) in enumerate(_texts(batch.column("text"))):
                mark, at = text_mark(h), []
                for x in wanted[i].as_py():
                    if x["mark"] == mark and x["open"] == 2:
                        at.append(np.arange(x["lo"], x["lo"] + x["n"], dtype=np.int32))
                    elif x["mark"] == mark:
                        rows.append((x["anchor"], 0, ids[i], mark, x["lo"], h[x["lo"] : x["lo"] + x["n"] + window - 1].tobytes()))
                if at:
                    lo = np.concatenate(at)
                    pair = [runs(h, window, seed=s)[lo].view(np.int64) for s in (51, 52)]
                    for c, v in zip(single, (*pair, np.full(len(lo), ids[i], np.int64), np.full(len(lo), mark, np.int64), lo), strict=True):
                        c.append(v)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            if single[0]:
                flat = [pa.array(np.concatenate(c), t) for c, t in zip(single, kinds, strict=False)]
                yield pa.RecordBatch.from_arrays([*flat, pa.nulls(len(flat[0]), pa.binary())], names=names)

    cut = scratch.keep(base.select("id", "text").join(wanted, "id").select("id", "text", "wanted").mapInArrow(cut_out, CUT), "cut")
    # Rows that repeat identifier and text give a context once.
    contexts = cut.where("words is not null").drop("second").repartition("anchor").dropDuplicates(["anchor", "id", "mark", "lo"]).sortWithinPartitions("anchor", "id", "mark", "lo")
    repeats = contexts.mapInArrow(_stream(window, shard_words), "id long, mark long, lo int, n int").unionByName(judged.where("open = 0").select("id", "mark", "lo", "n"))
    repeats = repeats.unionByName(_repeated_windows(cut.where("words is null").drop("words"), scratch))
    # A document's repeats are at most its windows.
    per_doc = scratch.keep(repeats.groupBy("id").agg(F.collect_list(F.struct("mark", "lo", "n")).alias("gone")), "repeats").withColumnRenamed("id", "gone_id")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, n_words, n_removed, kept = batch.column("gone"), [], [], []
            for i, (buf, start, end, h) in enumerate(_texts(batch.column("text"))):
                cover = np.zeros(len(h) + 1, np.int64)
                if gone[i].is_valid:
                    flat = gone[i].values
                    own = flat.field("mark").to_numpy() == text_mark(h)
                    lo, n = flat.field("lo").to_numpy()[own], flat.field("n").to_numpy()[own]
                    np.add.at(cover, lo, 1)
                    np.add.at(cover, np.minimum(lo + n + window - 1, len(h)), -1)
                stay = np.cumsum(cover[:-1]) <= 0
                n_words.append(len(h))
                n_removed.append(int(len(h) - stay.sum()))
                raw = buf.tobytes() if len(start) and len(buf) < 4096 else memoryview(buf)
                kept.append(b" ".join([bytes(raw[a:b]) for a, b in zip(start[stay].tolist(), end[stay].tolist(), strict=True)]))
            text = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("real_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), text], names=[id_col, "n_words", "n_removed", "kept"])

    joined = base.join(per_doc, F.col("id") == F.col("gone_id"), "left").select("real_id", "text", "gone")
    return joined.mapInArrow(strip, f"{id_col} long, n_words long, n_removed long, kept string")
