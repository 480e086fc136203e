"""Token ids in binary files of patched frame-of-reference blocks, and back.

A file, all numbers little-endian:

    magic    b"PFOR0001"
    blocks   for each: minimum u32, count u16, width u8, reserved u8, exceptions u16, then the packed
             low bits of (id - minimum), least significant bit first, then the exceptions' positions
             as u16 and the bits of their values beyond the width as u32
    index    u64 for each block: the byte at which it starts
    docs     i64 doc_id and u32 number of ids for each document, in order; bit 31: the id is null
    footer   u64 blocks, u64 documents, u64 ids, u64 byte of the index, magic

Blocks run over document ends; all but a file's last hold BLOCK ids. The index finds the block of any
id without reading others.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskline.llm.common import scratch, written
from maskline.llm.tokens import encoder
from maskline.llm.words import slices, text_buffer

MAGIC, BLOCK, PERCENTILE = b"PFOR0001", 1024, 90
#: Bytes of text and documents of a file, on average.
FILE_BYTES, FILE_ROWS = 64 << 20, 1 << 20
_HEAD = np.dtype([("low", "<u4"), ("count", "<u2"), ("width", "u1"), ("zero", "u1"), ("odd", "<u2")])
_DOC = np.dtype([("doc_id", "<i8"), ("n", "<u4")])
_FOOT = struct.Struct("<QQQQ8s")
_NULL = 1 << 31


def encode_blocks(ids: np.ndarray, percentile: int = PERCENTILE) -> list[bytes]:
    """The blocks of ids. The width fits the given share of a block's values; the rest are exceptions."""
    blocks = []
    for lo in range(0, len(ids), BLOCK * 256):
        part = ids[lo : lo + BLOCK * 256].astype(np.int64)
        full = len(part) // BLOCK
        groups = ([part[: full * BLOCK].reshape(full, BLOCK)] if full else []) + ([part[full * BLOCK :][None]] if len(part) % BLOCK else [])
        for x in groups:
            n = x.shape[1]
            low = x.min(1)
            y = x - low[:, None]
            at = np.partition(y, (n - 1) * percentile // 100, axis=1)[:, (n - 1) * percentile // 100]
            width = np.ceil(np.log2(at + 1)).astype(int)
            packed: list = [None] * len(x)
            for w in np.unique(width):
                rows = np.flatnonzero(width == w)
                bits = ((y[rows, :, None] >> np.arange(w)) & 1).astype(np.uint8).reshape(len(rows), -1)
                for i, line in zip(rows, np.packbits(bits, axis=1, bitorder="little"), strict=True):
                    packed[i] = line.tobytes()
            for i in range(len(x)):
                odd = np.flatnonzero(y[i] >> width[i])
                head = np.array([(low[i], n, width[i], 0, len(odd))], _HEAD)
                blocks.append(head.tobytes() + packed[i] + odd.astype("<u2").tobytes() + (y[i, odd] >> width[i]).astype("<u4").tobytes())
    return blocks


def decode_block(raw: bytes, at: int = 0) -> np.ndarray:
    head = np.frombuffer(raw, _HEAD, 1, at)[0]
    n, w, odd = int(head["count"]), int(head["width"]), int(head["odd"])
    at += _HEAD.itemsize
    size = (n * w + 7) // 8
    bits = np.unpackbits(np.frombuffer(raw, np.uint8, size, at), bitorder="little")[: n * w].reshape(n, w)
    out = (bits.astype(np.uint32) << np.arange(w, dtype=np.uint32)).sum(1, dtype=np.uint32) if w else np.zeros(n, np.uint32)
    at += size
    where = np.frombuffer(raw, "<u2", odd, at)
    out[where] |= np.frombuffer(raw, "<u4", odd, at + 2 * odd) << np.uint32(w)
    return out + head["low"]


class Writer:
    """A file of the format, written block by block; close() returns (documents, ids)."""

    def __init__(self, sink):
        self.sink, self.at, self.index, self.docs, self.rest, self.total = sink, 0, [], [], np.zeros(0, np.uint32), 0
        self._put(MAGIC)

    def _put(self, raw: bytes) -> None:
        self.sink.write(raw)
        self.at += len(raw)

    def _blocks(self, ids: np.ndarray) -> None:
        for b in encode_blocks(ids):
            self.index.append(self.at)
            self._put(b)

    def add(self, keys: list, ids: np.ndarray, counts: np.ndarray) -> None:
        docs = np.zeros(len(keys), _DOC)
        docs["doc_id"] = [0 if k is None else k for k in keys]
        docs["n"] = counts | np.array([_NULL if k is None else 0 for k in keys], np.int64)
        self.docs.append(docs)
        self.total += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // BLOCK * BLOCK
        self._blocks(ids[:whole])
        self.rest = ids[whole:]

    def close(self) -> tuple[int, int]:
        self._blocks(self.rest)
        at, docs = self.at, np.concatenate(self.docs) if self.docs else np.zeros(0, _DOC)
        self._put(np.array(self.index, "<u8").tobytes())
        self._put(docs.tobytes())
        self._put(_FOOT.pack(len(self.index), len(docs), self.total, at, MAGIC))
        return len(docs), self.total


class Reader:
    """Random access to a file of the format, by ranges of bytes."""

    def __init__(self, source, size: int):
        self.source = source
        blocks, docs, self.total, at, magic = _FOOT.unpack(self._read(size - _FOOT.size, _FOOT.size))
        if magic != MAGIC or self._read(0, 8) != MAGIC:
            raise ValueError("not a token file")
        tail = self._read(at, 8 * blocks + _DOC.itemsize * docs)
        self.index = np.append(np.frombuffer(tail, "<u8", blocks), at).astype(np.int64)
        self.docs = np.frombuffer(tail, _DOC, docs, 8 * blocks)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids number start to stop - 1 of the file."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        a, b = start // BLOCK, (stop - 1) // BLOCK + 1
        lo = self.index[a]
        raw = self._read(int(lo), int(self.index[b] - lo))
        return np.concatenate([decode_block(raw, int(self.index[i] - lo)) for i in range(a, b)])[start - a * BLOCK : stop - a * BLOCK]

    def documents(self, chunk: int = 1 << 20) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) in order; about chunk ids are held at once."""
        counts = (self.docs["n"] & (_NULL - 1)).astype(np.int64)
        ends = np.cumsum(counts)
        i = 0
        while i < len(ends):
            first = int(ends[i] - counts[i])
            j = max(i + 1, int(np.searchsorted(ends, first + chunk, "right")))
            ids = self.ids(first, int(ends[j - 1]))
            for k in range(i, j):
                key = None if self.docs["n"][k] & _NULL else int(self.docs["doc_id"][k])
                yield key, ids[ends[k] - counts[k] - first : ends[k] - first]
            i = j


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """(store, path in it) of a folder: local, HDFS (hdfs, viewfs), S3 (s3, s3a), Azure (abfs) or Google (gs)."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", folder))


def write(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 1) -> DataFrame:
    """Writes all documents' ids in ascending doc_id order; returns the manifest (part, path, docs, ids).

    docs needs doc_id and text. Rows are dealt by ranges of doc_id into files of about FILE_BYTES of text;
    rows of one doc_id go by a hash of the text, so many of them are as many files. A null text is an empty
    one, a null doc_id comes first. A worker writes under a name of its own attempt and renames the file
    when it is whole, so one done again replaces it alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        encode, part = encoder(vocabulary).encode, context.partitionId()
        path = f"{root}/part-{part:06d}.pfor"
        half = f"{path}.{context.taskAttemptId()}"
        with store.open_output_stream(half) as sink:
            w = Writer(sink)
            for batch in batches:
                for rows in slices(batch):
                    ids, counts = encode(*text_buffer(rows.column("text")))
                    ids = np.insert(ids, np.cumsum(counts), end_id)
                    w.add(rows.column("doc_id").to_pylist(), ids, counts + 1)
            n, total = w.close()
        store.move(half, path)
        yield pa.RecordBatch.from_pydict({"part": [part], "name": [path.rpartition("/")[2]], "docs": [n], "ids": [total]})

    size = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.count("*").alias("rows")).first()
    few = 1 + max((size["bytes"] or 0) // FILE_BYTES, size["rows"] // FILE_ROWS)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text").asc_nulls_first()]
    dealt = docs.select("doc_id", "text").repartitionByRange(few, *order[:2]).sortWithinPartitions(*order)
    return written(dealt.mapInArrow(run, "part long, name string, docs long, ids long"))


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) of all documents, from the files that the manifest names.

    start counts the ids of all documents before. The manifest has a row for each file, thus few.
    """
    files, at = [], 0
    for r in manifest.orderBy("part").collect():
        files.append((r["name"], at))
        at += r["ids"]
    names = spark.createDataFrame(files or [("", 0)], "name string, first long").where("name <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("first").to_pylist(), strict=True):
                path = f"{root}/{name}"
                rows: list[tuple] = []
                with store.open_input_file(path) as source:
                    for key, ids in Reader(source, source.size()).documents():
                        rows.append((key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) >= 20_000:
                            yield _rows(rows)
                            rows = []
                yield _rows(rows)

    return names.repartition(max(1, len(files))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """Writes all documents to token files in the shared folder and returns what the files hold.

    A null text is empty and has the end id alone; equal doc_ids are all kept; an empty table gives no
    rows. Other columns than doc_id and text are left unread.
    """
    folder = scratch(docs.sparkSession)
    return read(docs.sparkSession, folder, write(docs, vocabulary, folder, end_id))
