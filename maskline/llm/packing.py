"""Harmonic packing of token sequences, independently in each worker and without a shuffle."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from maskline.llm.tokens import encoder
from maskline.llm.words import slices, text_buffer

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(c, T.LongType(), False) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
)
#: Full sequences of filler, and bins that wait for some, that a worker holds; classes from this one on are filler
#: where bins wait.
POOL, LAST = 32, 16


class Packer:
    """Bins of one worker. A document is (key, ids, its number of ids); a piece is a range of its ids.

    Class k holds documents of more than capacity/(k+1) and at most capacity/k ids; a bin closes with
    k of them, whatever they are, so classes never wait for each other. What a closed bin lacks is
    filled from the filler: the parts of documents over the capacity, the documents of the last classes that
    arrive while closed bins wait, and any document where POOL of them do. No id of a class's documents
    is cut until the end of the worker's input, where what is left is laid end to end; the last sequence
    is cut at powers of two, which need no padding. Documents over the capacity fill first, as they are cut
    anyway; then the longest whole ones that fit, and one that is cut serves many small rests.
    """

    def __init__(self, capacity: int, base: int):
        self.capacity, self.next = capacity, base
        self.bins: dict[int, list] = {}
        self.long: deque = deque()  # filler: of documents over the capacity
        self.whole: list = []  # others by their length, as (length, number of arrival, piece)
        self.rest: tuple | None = None  # of the one that is being cut
        self.held = self.arrived = 0
        self.waiting: deque = deque()
        self.out: list[tuple] = []

    def _close(self, pieces: list) -> None:
        offset = 0
        for key, ids, total, a, b in pieces:
            self.out.append((key, a, b - a, zlib.crc32(ids[a:b].tobytes()), total, self.next, offset))
            offset += b - a
        self.next += 1

    def _take(self, n: int) -> list:
        """Pieces of n ids in all from the filler, or of all that it holds."""
        pieces = []
        while n and self.held:
            at = bisect_right(self.whole, n, key=lambda x: x[0]) if not self.long else 0
            if at:
                piece = self.whole.pop(at - 1)[2]
            else:
                if self.long:
                    piece = self.long.popleft()
                elif self.rest:
                    piece, self.rest = self.rest, None
                else:
                    piece = self.whole.pop(0)[2]
            key, ids, total, a, b = piece
            m = min(n, b - a)
            pieces.append((key, ids, total, a, a + m))
            n, self.held = n - m, self.held - m
            if a + m < b:
                left = (key, ids, total, a + m, b)
                if total > self.capacity:
                    self.long.appendleft(left)
                else:
                    self.rest = left
        return pieces

    def _pour(self, piece: tuple) -> None:
        if piece[2] > self.capacity:
            self.long.append(piece)
        else:
            self.arrived += 1
            insort(self.whole, (piece[2], self.arrived, piece))
        self.held += piece[4] - piece[3]
        while self.waiting and self.held >= self.waiting[0][1]:
            pieces, gap = self.waiting.popleft()
            self._close(pieces + self._take(gap))
        while self.held > POOL * self.capacity:
            self._close(self._take(self.capacity))

    def add(self, key, ids: np.ndarray) -> None:
        n = len(ids)
        k = self.capacity // n
        if not k or self.waiting and (k >= LAST or len(self.waiting) > POOL):
            self._pour((key, ids, n, 0, n))
            return
        group = self.bins.setdefault(k, [])
        group.append((key, ids, n, 0, n))
        if len(group) == k:
            del self.bins[k]
            gap = self.capacity - sum(p[2] for p in group)
            if self.held >= gap:
                self._close(group + self._take(gap))
            else:
                self.waiting.append((group, gap))

    def finish(self) -> None:
        for k in sorted(self.bins, reverse=True):
            for piece in self.bins[k]:
                self._pour(piece)
        self.bins.clear()
        while self.waiting:  # too little filler is left: open the last of them
            pieces, _ = self.waiting.pop()
            for piece in pieces:
                self._pour(piece)
        while self.held >= self.capacity:
            self._close(self._take(self.capacity))
        size = 1 << (self.capacity.bit_length() - 1)
        while self.held:
            while size > self.held:
                size >>= 1
            self._close(self._take(size))


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = 2048) -> DataFrame:
    """Pieces of all documents' ids, packed into sequences of at most capacity ids.

    docs needs doc_id and text; other columns are left unread. A null or empty text has its end id
    alone. Equal texts and doc_ids are packed one by one. An empty table gives no rows. Rows are read
    once and never shuffled: a worker packs the rows of its input split, so a lost one's work is done
    again alike. sequence_id is the split's number times 2**33 plus a count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        packer = Packer(capacity, TaskContext.get().partitionId() << 33)

        def flush() -> pa.RecordBatch:
            rows, packer.out = packer.out, []
            columns = list(zip(*rows, strict=True)) or [[]] * len(SCHEMA)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=SCHEMA.names)

        for batch in batches:
            for part in slices(batch):
                ids, counts = encode(*text_buffer(part.column("text")))
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id).astype("<u4")
                ends += np.arange(1, len(ends) + 1)
                begin = 0
                for key, stop in zip(part.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                    packer.add(key, ids[begin:stop].copy())
                    begin = stop
                yield flush()
        packer.finish()
        yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
