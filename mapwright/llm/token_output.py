"""Token ids in a binary file format of independently coded, checksummed blocks.

Texts are tokenised, each followed by an end id, and written in ascending order of
identifier. A file row is a segment: whole documents of about ``segment_ids``
ids (more for one long document), as

    magic "MWT2", uint32 block size, uint32 ids, uint32 blocks, uint32 bytes of
    the table, table of the segment's ids and their frequencies,
    for each block: uint32 payload bytes, uint32 crc32 of its ids, payload

with each block's payload coded from an empty model and the table (see range_coder), so
that a reader may start at any block. Beside it stand the documents' identifiers and
lengths, and where the segment starts within its part.

Words repeat far more often than texts: the ids of a word, or of a run of
letters, don't depend on its neighbours, as the tokenizer cuts there, so each
Python worker tokenises it once and keeps its ids, within a bounded cache that its tasks share.

Defined results: a null text counts as empty and gives the end id alone; null
identifiers come first; rows that repeat an identifier follow one another in order of
their text; an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mapwright.llm import range_coder
from mapwright.llm.common import Scratch
from mapwright.llm.textbytes import mix64, slices, word_hashes

MAGIC = b"MWT2"
#: Pieces kept by a worker, at 24 to 48 bytes each, and their ids, at 2 bytes.
MOST_WORDS, MOST_IDS = 2_600_000, 1 << 24
# Kinds of bytes: 0 white space, 1 letter, 2 digit, 3 mark, 4 anything else.
_KIND = np.full(256, 4, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[0x30:0x3A] = 2
_KIND[0x27] = 4
_KIND = _KIND.tobytes()
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
SEGMENT = "part int, seq long, seg_start long, n_ids long, doc_ids array<long>, lengths array<long>, data binary"
#: Bytes of text looked up, ids coded and bytes decoded in lockstep at a time.
SLICE_BYTES, BATCH_IDS, BATCH_BYTES = 1 << 18, 1 << 21, 1 << 22


def piece_hashes(buf: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of pieces of a buffer that goes on for 16 bytes behind them, by eight bytes at a time."""
    eight = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    h = eight[first] & _FIRST.take(size, mode="clip")
    long = np.flatnonzero(size > 8)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h[long] ^= mix64(eight[first[long] + 8] & _FIRST.take(size[long] - 8, mode="clip"))
    rest = np.flatnonzero(size > 16)
    h[rest] = word_hashes(buf, first[rest], first[rest] + size[rest])
    h += size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix64(h)


class WordTokenizer:
    """ids of texts by way of a bounded cache of pieces' ids.

    Words of ASCII letters, digits, marks and the letters U+00C0 to U+00FF are
    cut where the tokenizer cuts them: into runs of letters, single digits and runs of
    marks. Any other word, and any with an apostrophe or a special token's
    opening, is a piece as it stands. Pieces are looked up by a 64-bit hash.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit, Sequence

        self.tokenizer = Tokenizer.from_file(path)
        # The same model behind a cut at spaces: plain pieces are normalised already.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = Sequence([CharDelimiterSplit(" "), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        # By open addressing: hash of the piece that holds a slot (0: free), its begin in flat and its size.
        self.hashes, self.spans, self.bits = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int64), 16
        self.flat, self.used, self.known = np.zeros(1 << 16, np.uint16), 0, 0

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot of each hash, places of those not known)."""
        slot = self._slots(h)
        seen = self.hashes.take(slot, mode="clip")
        left, new = np.flatnonzero(seen != h), []
        seen = seen[left]
        while len(left):
            free = seen == 0
            new.append(left[free])
            left = left[~free]
            slot[left] = (slot[left] + 1) & (len(self.hashes) - 1)
            seen = self.hashes.take(slot[left], mode="clip")
            other = seen != h[left]
            left, seen = left[other], seen[other]
        return slot, np.concatenate(new) if new else left

    def _put(self, h: np.ndarray, span: np.ndarray) -> None:
        """Files different hashes, none of them known."""
        if 3 * (self.known + len(h)) > 2 * len(self.hashes):
            full = np.flatnonzero(self.hashes)
            h, span = np.concatenate([self.hashes[full], h]), np.concatenate([self.spans[full], span])
            self.bits = (2 * len(h)).bit_length()
            self.hashes, self.spans, self.known = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int64), 0
        slot, left = self._slots(h), np.arange(len(h))
        while len(left):
            at = slot[left]
            free = self.hashes[at] == 0
            self.hashes[at[free]] = h[left[free]]
            mine = self.hashes[at] == h[left]
            self.spans[at[mine]] = span[left[mine]]
            left = left[~mine]
            slot[left] = (slot[left] + 1) & (len(self.hashes) - 1)
        self.known += len(h)

    def _keep(self, h: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], flat, np.zeros(self.used + (1 << 16), np.uint16)])
        else:
            self.flat[self.used : self.used + len(flat)] = flat
        self._put(h, (self.used + np.cumsum(size) - size) << 31 | size)
        self.used += len(flat)

    def _ids(self, text: str, plain: bool = False) -> np.ndarray:
        # The batch form keeps no offsets, which halves the time.
        tokenizer = self.plain if plain else self.tokenizer
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint16)

    def _learn(self, h: np.ndarray, low: np.ndarray, first: np.ndarray, last: np.ndarray, odd: np.ndarray) -> None:
        """Keeps different pieces' ids by their hashes.

        Plain pieces are tokenised in one go: each ends with the one id that closes a word.
        """
        plain, single = np.flatnonzero(~odd), np.flatnonzero(odd)
        if len(plain):
            size = last[plain] - first[plain] + 1
            end = np.cumsum(size)
            text = low.take(np.arange(end[-1]) + np.repeat(first[plain] - (end - size), size), mode="clip")
            text[end - 1] = 0x20
            got = self._ids(text.tobytes().decode("utf-8", "replace"), plain=True)
            close = np.flatnonzero(self.closes[got]) + 1
            if len(close) == len(plain):
                self._keep(h[plain], got, np.diff(close, prepend=0))
            else:
                single = np.arange(len(h))
        if len(single):
            ids = [self._ids(low[a:b].tobytes().decode("utf-8", "replace")) for a, b in zip(first[single].tolist(), last[single].tolist(), strict=True)]
            self._keep(h[single], np.concatenate(ids), np.array([len(x) for x in ids], np.int64))

    def _pieces(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes as they are tokenised, pieces' first bytes, ends, whether they are odd)."""
        # A byte more, so that one may look behind the last.
        kind = np.frombuffer(bytearray(buf.tobytes() + b" ").translate(_KIND), np.uint8)
        low = np.zeros(len(buf) + 16, np.uint8)
        np.bitwise_or(buf, (kind[:-1] == 1).view(np.uint8) << 5, out=low[: len(buf)])
        lead = np.flatnonzero(buf == 0xC3)
        lead = lead[(buf[lead + 1] != 0x97) & (buf[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = 1
        low[lead[buf[lead + 1] < 0x9F] + 1] += 32
        special = np.flatnonzero(buf[:-1] == 0x3C)
        kind[special[buf[special + 1] == 0x7C]] = 4
        cut = np.empty(len(buf) + 1, bool)
        np.not_equal(kind[1:], kind[:-1], out=cut[1:])
        cut |= kind == 2
        cut[off] = True
        cut[0] = cut[-1] = True
        first = np.flatnonzero(cut)
        first, last = first[:-1], first[1:]
        kinds = kind.take(first)
        # Without white space.
        some = np.flatnonzero(kinds)
        first, last, kinds = first.take(some), last.take(some), kinds.take(some)
        odd = kinds == 4
        if odd.any():
            edge = np.zeros(len(buf) + 1, bool)
            edge[off] = True
            begins = edge[first]
            begins[0] = True
            begins[1:] |= first[1:] != last[:-1]
            word = np.cumsum(begins) - 1
            odd_word = np.zeros(int(word[-1]) + 1, bool)
            odd_word[word[odd]] = True
            odd = odd_word[word]
            ends = last[np.r_[np.flatnonzero(begins)[1:] - 1, len(last) - 1]]
            last[odd] = ends[word[odd]]
            whole = begins | ~odd
            first, last, odd = first[whole], last[whole], odd[whole]
            size = last[odd] - first[odd]
            at = np.repeat(first[odd] - (np.cumsum(size) - size), size)
            at += np.arange(len(at))
            low[at] = buf[at]
        return low, first, last, odd

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text) of a run of texts in one buffer."""
        if self.known > MOST_WORDS or self.used > MOST_IDS:
            self._clear()
        low, first, last, odd = self._pieces(buf, off) if len(buf) else (buf, *[np.zeros(0, np.int64)] * 3)
        if not len(first):
            return np.zeros(0, np.uint16), np.zeros(len(off) - 1, np.int64)
        h = piece_hashes(low, first, last - first)
        h[odd] ^= np.uint64(0x9E3779B97F4A7C15)
        # 0 marks a free slot.
        np.maximum(h, np.uint64(1), out=h)
        slot, new = self._find(h)
        if len(new):
            unique, where = np.unique(h[new], return_index=True)
            where, bits = new[where], self.bits
            self._learn(unique, low, first[where], last[where], odd[where])
            if self.bits == bits:
                slot[new] = self._find(h[new])[0]
            else:
                slot = self._find(h)[0]
        span = self.spans.take(slot, mode="clip")
        size = span & ((1 << 31) - 1)
        ends = np.cumsum(size)
        span >>= 31
        span -= ends
        span += size
        at = np.repeat(span, size)
        at += np.arange(len(at))
        ids = self.flat.take(at, mode="clip")
        return ids, np.diff(np.r_[0, ends][np.searchsorted(first, off)])


_TOKENIZERS: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """This process's own, with the pieces that earlier tasks have met."""
    if path not in _TOKENIZERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _TOKENIZERS.clear()
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def pack(n: int, table: bytes, coded: list[tuple[bytes, int]], block: int) -> bytes:
    head = MAGIC + struct.pack("<IIII", block, n, len(coded), len(table)) + table
    return head + b"".join(struct.pack("<II", len(p), c) + p for p, c in coded)


def unpack(data: bytes) -> tuple[list[bytes], list[int], list[int], list[bytes]]:
    """(payloads, numbers of ids, checksums, tables) of a segment's blocks."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    block, n, blocks, size = struct.unpack_from("<IIII", data, 4)
    table, at, payloads, checks = data[20 : 20 + size], 20 + size, [], []
    for _ in range(blocks):
        size, check = struct.unpack_from("<II", data, at)
        payloads.append(data[at + 8 : at + 8 + size])
        checks.append(check)
        at += 8 + size
    return payloads, [min(block, n - i * block) for i in range(blocks)], checks, [table] * blocks


def write_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    out_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    block: int = 1024,
    segment_ids: int = 1 << 15,
) -> None:
    """Write the documents' ids to ``out_path``, parts in ascending order of identifier."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = base.repartitionByRange(n_parts, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, tokenizer = TaskContext.get().partitionId(), word_tokenizer(tokenizer_path)
        held: list[tuple[list, list[int], np.ndarray]] = []
        doc_ids: list = []
        lengths: list[int] = []
        parts: list[np.ndarray] = []
        seq = start = waiting = pending = 0

        def close() -> None:
            nonlocal doc_ids, lengths, parts, pending, waiting
            if doc_ids:
                held.append((doc_ids, lengths, np.concatenate(parts)))
                waiting += pending
                doc_ids, lengths, parts, pending = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, start, waiting
            cut = [[ids[i : i + block] for i in range(0, len(ids), block)] for _, _, ids in held]
            tables = [range_coder.frequencies(ids) for _, _, ids in held]
            coded = iter(range_coder.encode([b for c in cut for b in c], [t for c, t in zip(cut, tables, strict=True) for _ in c]))
            rows = []
            for (who, sizes, ids), c, table in zip(held, cut, tables, strict=True):
                rows.append((part, seq, start, len(ids), who, sizes, pack(len(ids), table, [next(coded) for _ in c], block)))
                seq, start = seq + 1, start + len(ids)
            held.clear()
            waiting = 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()), strict=True)], names=["part", "seq", "seg_start", "n_ids", "doc_ids", "lengths", "data"])

        for batch in batches:
            who = batch.column("id").to_pylist()
            for lo, hi, buf, off in slices(batch.column("text"), SLICE_BYTES):
                ids, n = tokenizer.encode(buf, off)
                at = 0
                for i, size in enumerate(n.tolist()):
                    doc_ids.append(who[lo + i])
                    lengths.append(size + 1)
                    parts += [ids[at : at + size], np.array([end_id], np.uint16)]
                    at, pending = at + size, pending + size + 1
                    if pending >= segment_ids:
                        close()
                        if waiting >= BATCH_IDS:
                            yield flush()
        close()
        if held:
            yield flush()

    ordered.mapInArrow(encode, SEGMENT).write.mode("overwrite").parquet(out_path)


def read_tokens(spark, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per document from the files: id, start, n_tokens, ids_crc32, on request ids."""
    files = spark.read.schema(SEGMENT).parquet(path)
    # One row for each part: what stands before it.
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = parts.select("part", F.coalesce(F.sum("part_ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = files.join(before, "part").select((F.col("before") + F.col("seg_start")).alias("at"), "doc_ids", "lengths", "data")
    kind = f"{id_col} long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column("data")])
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(np.cumsum(sizes[lo:]), BATCH_BYTES)) + lo)
                some = batch.slice(lo, hi - lo)
                lo = hi
                cut = [unpack(x) for x in some.column("data").to_pylist()]
                got = iter(range_coder.decode(*([x for c in cut for x in c[k]] for k in range(4))))
                rows = []
                for at, who, n, c in zip(some.column("at").to_pylist(), some.column("doc_ids").to_pylist(), some.column("lengths").to_pylist(), cut, strict=True):
                    ids, inner = np.concatenate([next(got) for _ in c[0]]).astype("<u4", copy=False), 0
                    for i, size in zip(who, n, strict=True):
                        own = ids[inner : inner + size]
                        rows.append((i, at + inner, size, zlib.crc32(own), *([own.astype(np.int32)] if with_ids else [])))
                        inner += size
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int32())] if with_ids else [])]
                names = [id_col, "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return placed.mapInArrow(decode, kind)


def tokens_round_trip(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write to the shared folder and read back."""
    scratch = Scratch(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer_path, scratch.path("ids"), **options)
    return read_tokens(docs.sparkSession, scratch.path("ids"), options.get("id_col", "doc_id"))
