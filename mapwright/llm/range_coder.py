"""Adaptive context-mixing range coder for token ids, many blocks in lockstep.

Each block starts from an empty model, so blocks decode independently; blocks of
a call advance together, one id a step, with numpy doing each step for all.

Model of a block: an order-2 and an order-1 table give one predicted id each and
how often it has held lately; for each such level of trust the block learns how often
that order is right, and the two shares and the rest are mixed into one split of the
interval: order-2 prediction, order-1 prediction, or escape. An escaped id is
coded by order 0: the frequencies of all ids of the segment that the block belongs to,
counted beforehand and kept beside its blocks. A block without a segment carries its own.

The coder is the range variant of asymmetric numeral systems: a state of 63 bits to
which 32-bit words are added, written from a block's end to its start.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Of each order and block; more lanes' tables than a core's cache holds cost more than they predict.
SLOTS = 256
#: Bits of a split between the orders, and of an order-0 frequency.
_MIX, _ZERO = 15, 16
_ALL, _WHOLE = 1 << _MIX, 1 << _ZERO
_LEAST = 1 << 31
#: Order-0 tables laid out at a time, at 128 KB each.
_TABLES = 256
#: Steps whose share of the work that needs no order is done at once.
_AT_ONCE = 16


class _Model:
    """Of all lanes; what stands in row 0 is order 2, in row 1 order 1. A slot holds 4 * (id + 1) + trust, 0 at first."""

    def __init__(self, lanes: int):
        base = np.arange(2 * lanes, dtype=np.int64).reshape(2, lanes)
        self.table = np.zeros(2 * lanes * SLOTS, np.int32)
        self.hits = np.full(2 * lanes * 4, _ALL // 4, np.int32)
        self.slots, self.levels = base * SLOTS, base * 4

    def spots(self, c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
        """Slots of contexts (int64, the last id and that before it; lanes last), orders next to last."""
        spot = np.empty((*c1.shape[:-1], 2, c1.shape[-1]), np.int64)
        one = c1 * 40503
        np.add(c2 * 30011, one, out=spot[..., 0, :])
        spot[..., 0, :] >>= 4
        np.right_shift(one, 3, out=spot[..., 1, :])
        spot &= SLOTS - 1
        spot += self.slots[:, : c1.shape[-1]]
        return spot

    def look(self, spot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(what the slots hold, its trust, its level's hits)."""
        e = self.table.take(spot, mode="clip")
        trust = e & 3
        self.level = self.levels[:, : spot.shape[-1]] + trust
        return e, trust, self.hits.take(self.level, mode="clip")

    def learn(self, spot: np.ndarray, e: np.ndarray, trust: np.ndarray, w: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Takes ids as 4 * (id + 1), int32; returns which orders were right."""
        # -1 where an order was right, else 0.
        right = e ^ fresh
        right -= 4
        right >>= 31
        # Right: more trust, 3 at most; wrong: less, and the id itself if there was little.
        after = right | 1
        np.subtract(e, after, out=after)
        np.minimum(after, e | 3, out=after)
        trust |= right
        np.copyto(after, fresh, where=(trust & 2) == 0)
        self.table[spot] = after
        share = right & (_ALL - 2048)
        share += 512
        share -= w
        share >>= 4
        share += w
        self.hits[self.level] = share
        return right


def _shares(e: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(both predictions + 1, share of order 2, of order 1); an order's share is 0 only if it predicts nothing new."""
    p = e >> 2
    p2, p1 = p[..., 0, :], p[..., 1, :]
    f2 = w[..., 0, :] * (p2 != 0)
    f1 = _ALL - f2
    f1 *= w[..., 1, :]
    f1 >>= _MIX
    f1 *= (p1 != 0) & (p1 != p2)
    return p, f2, f1


def _check(block: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(block, dtype="<u4"))


def frequencies(ids: np.ndarray) -> bytes:
    """The order-0 table of a segment's ids (< 65536)."""
    count = np.bincount(ids, minlength=1)
    known = np.flatnonzero(count)
    if not len(known):
        return struct.pack("<I", 0)
    f = 1 + count[known] * (_WHOLE - len(known)) // int(count.sum())
    f[np.argmax(f)] += _WHOLE - int(f.sum())
    planes = np.concatenate([np.diff(known, prepend=0), f - 1]).astype("<u2").view(np.uint8).reshape(-1, 2).T
    return struct.pack("<I", len(known)) + zlib.compress(planes.tobytes(), 1)


def _read(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, frequencies) of an order-0 table."""
    (n,) = struct.unpack_from("<I", table)
    if not n:
        return np.zeros(1, np.int64), np.full(1, _WHOLE, np.int64)
    try:
        planes = np.frombuffer(zlib.decompress(table[4:]), np.uint8)
    except zlib.error as e:
        raise ValueError("a table of frequencies is damaged") from e
    if len(planes) != 4 * n:
        raise ValueError("a table of frequencies is damaged")
    both = np.ascontiguousarray(planes.reshape(2, -1).T).view("<u2").ravel().astype(np.int64)
    ids, f = np.cumsum(both[:n]), both[n:] + 1
    if ids[-1] >= _WHOLE or int(f.sum()) != _WHOLE:
        raise ValueError("a table of frequencies is damaged")
    return ids, f


def _lanes(lengths: list[int]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(order of blocks by falling length, their lengths, lanes with an id at each step)."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    lens = np.array([lengths[i] for i in order])
    return order, lens, np.searchsorted(-lens, -np.arange(int(lens[0])), "left")


def _turned(a: np.ndarray, band: int = 64) -> np.ndarray:
    """The transpose, copied by squares: whole columns would push each other out of the cache."""
    out = np.empty(a.shape[::-1], a.dtype)
    for i in range(0, a.shape[0], band):
        for j in range(0, a.shape[1], band):
            out[j : j + band, i : i + band] = a[i : i + band, j : j + band].T
    return out


def encode(blocks: list[np.ndarray], tables: list[bytes] | None = None) -> list[tuple[bytes, int]]:
    """(payload, crc32 of the ids as little-endian 32-bit numbers) of each block; ids < 65536.

    ``tables``: the order-0 table of each block's segment; None: each payload begins with its own.
    """
    if not blocks:
        return []
    given = tables is not None
    tables = tables if given else [frequencies(b) for b in blocks]
    order, lens, live = _lanes([len(b) for b in blocks])
    steps, lanes = len(live), len(blocks)
    ids, zero = np.zeros((lanes, steps + 2), np.uint16), np.zeros((lanes, steps), np.uint32)
    of = np.zeros(_WHOLE, np.uint32)
    last = None
    for lane in sorted(range(lanes), key=lambda k: order[k]):
        i = order[lane]
        if last is None or (tables[i] is not last and tables[i] != last):
            last = tables[i]
            known, f = _read(last)
            of[known] = ((f - 1) << 16) | (np.cumsum(f) - f)
        ids[lane, 2 : lens[lane] + 2] = blocks[i]
        zero[lane, : lens[lane]] = of[blocks[i]]
    # Two steps of zeros go ahead.
    ids, zero = _turned(ids), _turned(zero)
    # Forth: how each id splits the interval. What isn't escaped takes all of order 0's.
    start, share = np.zeros((steps, lanes), np.uint16), np.zeros((steps, lanes), np.uint16)
    m = _Model(lanes)
    held, hits, rights = (np.zeros((_AT_ONCE, 2, lanes), k) for k in (np.int32, np.int32, np.int32))
    for begin in range(0, steps, _AT_ONCE):
        end = min(begin + _AT_ONCE, steps)
        some = ids[begin : end + 2].astype(np.int64)
        spots, fresh = m.spots(some[1:-1], some[:-2]), ((some[2:] + 1) << 2).astype(np.int32)
        for k, n in enumerate(live[begin:end].tolist()):
            spot = spots[k, :, :n]
            e, trust, w = m.look(spot)
            rights[k, :, :n] = m.learn(spot, e, trust, w, fresh[k, :n])
            held[k, :, :n], hits[k, :, :n] = e, w
        _, f2, f1 = _shares(held[: end - begin], hits[: end - begin])
        is2, is1, g = rights[: end - begin, 0] != 0, rights[: end - begin, 1] != 0, f2 + f1
        np.copyto(zero[begin:end], np.uint32((_WHOLE - 1) << 16), where=is2 | is1)
        is1 &= ~is2
        size = _ALL - g
        np.copyto(g, f2, where=is1)
        np.copyto(size, f1, where=is1)
        np.copyto(g, 0, where=is2)
        np.copyto(size, f2, where=is2)
        start[begin:end], share[begin:end] = g, size
    # Back: the states.
    state = np.full(lanes, _LEAST, np.uint64)
    words, written = np.zeros((steps, lanes), "<u4"), np.zeros((steps, lanes), bool)
    u32 = np.uint64(32)
    for begin in range((steps - 1) // _AT_ONCE * _AT_ONCE, -1, -_AT_ONCE):
        end = min(begin + _AT_ONCE, steps)
        z, f, s = zero[begin:end], share[begin:end].astype(np.uint64), start[begin:end].astype(np.uint64)
        f0, s0 = (z >> 16).astype(np.uint64) + np.uint64(1), (z & np.uint32(0xFFFF)).astype(np.uint64)
        most, rest0, rest = f * f0, np.uint64(_WHOLE) - f0, np.uint64(_ALL) - f
        for k in range(end - begin - 1, -1, -1):
            n = live[begin + k]
            x = state[:n]
            high = x >> u32
            full = np.greater_equal(high, most[k, :n], out=written[begin + k, :n])
            words[begin + k, :n] = x
            np.copyto(x, high, where=full)
            q = x // f0[k, :n]
            q *= rest0[k, :n]
            x += q
            x += s0[k, :n]
            q = x // f[k, :n]
            q *= rest[k, :n]
            x += q
            x += s[k, :n]
    written = _turned(written)
    out = _turned(words).ravel()[np.flatnonzero(written)]
    place = np.cumsum(np.r_[0, np.count_nonzero(written, axis=1)])
    done: list = [None] * lanes
    for lane, i in enumerate(order):
        body = struct.pack("<Q", int(state[lane])) + out[place[lane] : place[lane + 1]].tobytes()
        done[i] = (body if given else struct.pack("<I", len(tables[i])) + tables[i] + body, _check(blocks[i]))
    return done


def decode(payloads: list[bytes], lengths: list[int], checks: list[int] | None = None, tables: list[bytes] | None = None) -> list[np.ndarray]:
    """The blocks again; raises ValueError where a checksum doesn't hold."""
    if not payloads:
        return []
    if tables is None:
        sizes = [struct.unpack_from("<I", p)[0] for p in payloads]
        tables = [p[4 : 4 + k] for p, k in zip(payloads, sizes, strict=True)]
        payloads = [p[4 + k :] for p, k in zip(payloads, sizes, strict=True)]
    if len(set(tables)) > _TABLES:
        half = len(payloads) // 2
        return [b for s in (slice(half), slice(half, None)) for b in decode(payloads[s], lengths[s], checks and checks[s], tables[s])]
    if min(map(len, payloads)) < 8:
        raise ValueError("a block is cut short")
    order, lens, live = _lanes(lengths)
    steps, lanes = len(live), len(payloads)
    # Of each different table: the entry of every place in its range; ids, frequencies and starts by entry.
    numbers: dict[bytes, int] = {}
    table = np.array([numbers.setdefault(tables[i], len(numbers)) for i in order])
    entry, known, begin = np.empty(len(numbers) * _WHOLE, np.uint16), [], [0]
    for k, raw in enumerate(numbers):
        i, f = _read(raw)
        entry[k * _WHOLE : (k + 1) * _WHOLE] = np.repeat(np.arange(len(i), dtype=np.uint16), f)
        known.append(i << 32 | (f - 1) << 16 | (np.cumsum(f) - f))
        begin.append(begin[-1] + len(i))
    known, begin = np.concatenate(known), np.array(begin)[table]
    table = table * _WHOLE
    words = np.frombuffer(b"".join(p[8 : 8 + (len(p) - 8) // 4 * 4] for p in (payloads[i] for i in order)) + b"\0\0\0\0", "<u4")
    place = np.cumsum([0] + [(len(payloads[i]) - 8) // 4 for i in order])[:-1]
    state = np.array([struct.unpack_from("<Q", payloads[i])[0] & 0x7FFFFFFFFFFFFFFF for i in order], np.int64)
    ids = np.zeros((steps, lanes), np.uint16)
    m = _Model(lanes)
    c1 = sym = np.zeros(lanes, np.int64)
    for t, n in enumerate(live.tolist()):
        x, c1, c2 = state[:n], sym[:n], c1[:n]
        spot = m.spots(c1, c2)
        e, trust, w = m.look(spot)
        p, f2, f1 = _shares(e, w)
        v = (x & (_ALL - 1)).astype(np.int32)
        g = f2 + f1
        is2, guessed = v < f2, v < g
        # As if escaped at first.
        size = _ALL - g
        np.copyto(size, f1, where=guessed)
        np.copyto(size, f2, where=is2)
        np.copyto(g, f2, where=guessed)
        np.copyto(g, 0, where=is2)
        v -= g
        x >>= _MIX
        x *= size
        x += v
        v = x & (_WHOLE - 1)
        at = known.take(entry.take(table[:n] + v, mode="clip") + begin[:n], mode="clip")
        p = p.astype(np.int64)
        np.copyto(p[1], p[0], where=is2)
        p[1] <<= 32
        p[1] -= (1 << 32) - ((_WHOLE - 1) << 16)
        np.copyto(at, p[1], where=guessed)
        x >>= _ZERO
        x *= (at >> 16 & 0xFFFF) + 1
        x += v
        x -= at & 0xFFFF
        sym = at >> 32
        short = np.flatnonzero(x < _LEAST)
        if len(short):
            x[short] = (x[short] << 32) | words.take(place[short], mode="clip")
            place[short] += 1
        ids[t, :n] = sym
        m.learn(spot, e, trust, w, ((sym + 1) << 2).astype(np.int32))
    ids = _turned(ids)
    done: list = [None] * lanes
    for lane, i in enumerate(order):
        done[i] = ids[lane, : lens[lane]].astype(np.uint32)
        if checks is not None and _check(done[i]) != checks[i]:
            raise ValueError(f"block {i} doesn't match its checksum")
    return done
