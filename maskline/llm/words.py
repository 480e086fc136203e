"""Whole texts as numpy arrays: word spans and their 64-bit hashes straight from Arrow buffers."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of one pass of the per-byte kernels, and of the text of rows that are handled together.
STEP, SLICE = 1 << 19, 2 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: spreads every input bit over all 64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_R = 0xD6E8FEB86659FD93
_POW = _INV = np.ones(1, np.uint64)
#: A 64-bit value for each byte; FOLD has those of a-z for A-Z too.
EXACT = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _GOLD)
FOLD = EXACT.copy()
FOLD[65:91] = EXACT[97:123]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        def run(base: int) -> np.ndarray:
            x = np.full(n, base & (2**64 - 1), np.uint64)
            x[0] = 1
            return np.cumprod(x, dtype=np.uint64)

        _POW, _INV = run(_R), run(pow(_R, -1, 2**64))
    return _POW, _INV


def release() -> None:
    """Gives memory that was freed back to the system: workers live on, and the next stage's need the room."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have at most limit bytes together (a longer text comes alone)."""
    off = text_buffer(batch.column(column))[1]
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi
    release()


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def _cuts(data: np.ndarray, off: np.ndarray, separator: np.ndarray) -> Iterator[tuple[int, int]]:
    """Steps over data that end at a document's end or before a separator."""
    lo, n = 0, len(data)
    while lo < n:
        hi = min(n, lo + STEP)
        if hi < n:
            doc = int(off[np.searchsorted(off, hi, "right") - 1])
            if doc > lo:
                hi = doc
            else:  # inside one long text
                at, width = hi, 4096
                while True:
                    back = np.flatnonzero(separator[data[max(lo + 1, at - width) : at]])
                    if len(back):
                        hi = max(lo + 1, at - width) + int(back[-1])
                        break
                    if at - width <= lo + 1:  # one word fills the step: take it whole
                        far = np.flatnonzero(separator[data[hi:]])
                        nxt = int(off[np.searchsorted(off, hi, "right")]) if np.searchsorted(off, hi, "right") < len(off) else n
                        hi = min(nxt, hi + int(far[0]) if len(far) else n)
                        break
                    width *= 8
        yield lo, hi
        lo = hi


def spans(data: np.ndarray, off: np.ndarray, separator: np.ndarray = SPACE, values: np.ndarray = EXACT, lead: bool = False, tail=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end, hash) of each maximal run of other bytes than separators.

    lead: a span begins at the end of the one before, thus with the separators in front of it;
    separators at a document's end are a span of their own, and the spans tile the text.
    tail: a function (bytes, starts, ends) of where each span is to be cut in two; its end if nowhere.
    """
    docs, starts, ends, hashes = [], [], [], []
    for lo, hi in _cuts(data, off, separator):
        part = data[lo:hi]
        sep = separator[part]
        first = np.zeros(len(part) + 1, bool)  # a document begins here
        at = off[(off >= lo) & (off <= hi)] - lo
        first[at] = True
        first[0] = first[-1] = True
        word = ~sep
        before = np.empty(len(part), bool)
        before[0] = True
        before[1:] = sep[:-1]
        s = np.flatnonzero(word & (before | first[:-1]))
        after = np.empty(len(part), bool)
        after[-1] = True
        after[:-1] = sep[1:]
        e = np.flatnonzero(word & (after | first[1:])) + 1
        if lead:
            # the step ends before a separator, so each bound is a document's or a word's end
            first[e] = True
            edge = np.flatnonzero(first)
            s, e = edge[:-1], edge[1:]
        if tail is not None and len(s):
            cut = tail(part, s, e)
            edge = np.empty(2 * len(s), np.int64)
            s2, e2 = edge.copy(), edge
            s2[0::2], s2[1::2], e2[0::2], e2[1::2] = s, cut, cut, e
            some = s2 < e2
            s, e = s2[some], e2[some]
        power, inverse = _powers(max(len(part) + 1, 1 << 16))
        run = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(values[part] * power[: len(part)], out=run[1:])
        h = mix((run[e] - run[s]) * inverse[s] + (e - s).astype(np.uint64) * _GOLD)
        docs.append(np.searchsorted(off, s + lo, "right") - 1)
        starts.append(s + lo)
        ends.append(e + lo)
        hashes.append(h)
    if not docs:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in (docs, starts, ends, hashes))


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one span for each hash, for each span the number of its hash)."""
    _, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    return at, inverse.reshape(-1)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes starts[i], ..., starts[i] + lengths[i] - 1 of all i, one after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


class HashIndex:
    """64-bit keys to 0, 1, 2, ... in order of insertion, looked up as arrays; at most limit keys."""

    def __init__(self, limit: int):
        self.limit, self.n = limit, 0
        self._make(1 << 12)

    def _make(self, size: int) -> None:
        self.bits = size.bit_length() - 1
        self.keys = np.zeros(size, np.uint64)
        self.rank = np.full(size, -1, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each key, -1 if it isn't held."""
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        rank = self.rank[at]
        left = np.flatnonzero((rank >= 0) & (self.keys[at] != h))
        out = rank
        at, mask = at[left], len(self.keys) - 1
        while len(left):
            at = (at + 1) & mask
            rank = self.rank[at]
            out[left] = rank
            more = (rank >= 0) & (self.keys[at] != h[left])
            left, at = left[more], at[more]
        return out

    def add(self, h: np.ndarray) -> int:
        """Inserts distinct keys that aren't held, as many as fit; returns how many."""
        h = h[: self.limit - self.n]
        if 5 * (self.n + len(h)) > 2 * len(self.keys):
            size = len(self.keys)
            while 5 * (self.n + len(h)) > 2 * size:
                size *= 2
            old, rank = self.keys[self.rank >= 0], self.rank[self.rank >= 0]
            self._make(size)
            self._place(old, rank)
        self._place(h, np.arange(self.n, self.n + len(h), dtype=np.int32))
        self.n += len(h)
        return len(h)

    def _place(self, h: np.ndarray, rank: np.ndarray) -> None:
        at, mask = (h >> np.uint64(64 - self.bits)).astype(np.int64), len(self.keys) - 1
        while len(h):
            free = self.rank[at] < 0
            self.keys[at[free]], self.rank[at[free]] = h[free], rank[free]
            lost = ~free
            lost[free] = self.rank[at[free]] != rank[free]
            h, rank, at = h[lost], rank[lost], (at[lost] + 1) & mask


class SpanTable:
    """For each distinct span a run of values, computed once by a function of its bytes.

    It holds at most limit spans; values of further ones are computed at each need. Spans are told
    apart by 64-bit hashes.
    """

    def __init__(self, limit: int, dtype: type):
        self.index, self.n = HashIndex(limit), 0
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool = np.zeros(1 << 16, dtype)

    def look(self, raw: bytes, s: np.ndarray, e: np.ndarray, h: np.ndarray, make) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(values, start, length): span i has values[start[i]:start[i] + length[i]].

        make gets the bytes of new spans as a list and returns (values, length of each's run).
        """
        rank = self.index.find(h)
        new = np.flatnonzero(rank < 0)
        if not len(new):
            return self.pool, self.first[rank], self.size[rank].astype(np.int64)
        keys, at, which = np.unique(h[new], return_index=True, return_inverse=True)
        at = new[at]
        values, size = make([raw[a:b] for a, b in zip(s[at].tolist(), e[at].tolist(), strict=True)])
        size = np.asarray(size, np.int64)
        first = np.cumsum(size) - size
        kept = self.index.add(keys)
        total = int(size[:kept].sum())
        while self.n + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), self.pool.dtype)])
        self.pool[self.n : self.n + total] = values[:total]
        self.first = np.concatenate([self.first, self.n + first[:kept]])
        self.size = np.concatenate([self.size, size[:kept].astype(np.int32)])
        old = self.n
        self.n += total
        start, length = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
        held = rank >= 0
        start[held], length[held] = self.first[rank[held]], self.size[rank[held]]
        which = which.reshape(-1)
        start[new], length[new] = old + first[which], size[which]
        if kept == len(keys):
            return self.pool, start, length
        # the table is full: the runs of the others follow the pool's end
        over = which >= kept
        start[new[over]] += self.n - (old + total)
        return np.concatenate([self.pool[: self.n], values[total:]]), start, length
