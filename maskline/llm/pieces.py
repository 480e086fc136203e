"""SentencePiece encoding and decoding over a trie of marked words with shared forward states."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskline.llm.words import SpanTable, ragged, slices, spans, text_buffer

MARK = "\u2581"
#: Distinct words, and pairs of pieces, that a worker remembers; ids whose bytes are laid out together.
CACHE, PAIRS, CHUNK = 600_000, 300_000, 1 << 20
_ONLY_SPACE = np.zeros(256, bool)
_ONLY_SPACE[32] = True
_MODELS: dict[tuple[str, str], PieceModel] = {}


class PieceModel:
    """Pieces and scores of a model file; kind is 'unigram' or 'bpe'.

    encode_words() sorts distinct marked words and walks the trie that they span depth-first. The
    state at a trie node is that of the prefix it stands for, so words share the states of their
    common prefixes: the best score and the last piece of the best path, and the places in the trie of all
    pieces that the prefix's suffixes reach, so a step looks only at pieces that can end there. A merge
    model's result isn't the best-scored path: there the state has the last piece of the prefix's merged
    form. A piece can end a prefix if the form of what is before it ends in a piece with which it stays
    unmerged, which is found once for a pair of pieces.
    """

    def __init__(self, pieces: list[str], scores: list[float], kind: str, byte_ids: dict[int, int], unknown: int = 0, skip: frozenset[int] = frozenset()):
        self.kind, self.unknown, self.byte_ids, self.pieces = kind, unknown, byte_ids, pieces
        special = set(byte_ids.values()) | skip | {unknown}
        self.ids = {p: i for i, p in enumerate(pieces) if i not in special and p}
        self.scores = {p: scores[i] for p, i in self.ids.items()}
        self.score = [scores[i] for i in range(len(pieces))]
        self.poor = min(self.scores.values(), default=0.0) - 10
        self.whole = any(MARK in p.lstrip(MARK) for p in self.ids)  # a piece crosses words
        byte_of = {i: b for b, i in byte_ids.items()}
        raw = [bytes([byte_of[i]]) if i in byte_of else b"" if i in skip else " \u2047 ".encode() if i == unknown else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.raw_first = np.cumsum(self.raw_size) - self.raw_size
        self.is_byte = np.zeros(len(pieces), bool)
        self.is_byte[list(byte_of)] = True
        self.child: dict[int, int] = {}  # node << 21 | character -> node; the root is 0
        self.ends_at = [-1]  # the piece that a node spells
        for p, i in self.ids.items():
            node = 0
            for ch in p:
                key = node << 21 | ord(ch)
                node = self.child.setdefault(key, len(self.ends_at))
                if node == len(self.ends_at):
                    self.ends_at.append(-1)
            self.ends_at[node] = i
        self.apart: dict[int, bool] = {}
        self.alone = [len(p) == 1 or None for p in pieces]

    @classmethod
    def load(cls, path: str, kind: str) -> PieceModel:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(sp.vocab_size())
        pieces = [sp.id_to_piece(i) for i in n]
        return cls(pieces, [sp.get_score(i) for i in n], kind, {int(pieces[i][1:-1], 16): i for i in n if sp.is_byte(i)}, sp.unk_id(), frozenset(i for i in n if sp.is_control(i)))

    def merge(self, text: str) -> list[str]:
        """The merged form of a short text: the best-scored neighbouring pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.scores.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _ends(self, before: int | None, piece: int) -> bool:
        """Whether piece stays whole, and unmerged with the piece (or unknown character, as len(pieces) + its number) before."""
        if before is None:
            if self.alone[piece] is None:
                self.alone[piece] = self.merge(self.pieces[piece]) == [self.pieces[piece]]
            return self.alone[piece]
        key = before << 21 | piece
        ok = self.apart.get(key)
        if ok is None:
            if len(self.apart) >= PAIRS:
                self.apart.clear()
            n, text = len(self.pieces), self.pieces[piece]
            left = self.pieces[before] if before < n else chr(before - n)
            ok = self.apart[key] = self.merge(left + text) == [left, text]
        return ok

    def encode_words(self, words: list[str]) -> list[list[int]]:
        out: list = [None] * len(words)
        child, ends_at, n, viterbi = self.child, self.ends_at, len(self.pieces), self.kind == "unigram"
        # of each prefix: score, last piece or n + an unknown character, where that begins, open (begin, node of the trie of pieces)
        states: list = [(0.0, -1, 0, [])]
        last = ""
        for at in sorted(range(len(words)), key=words.__getitem__):
            w = words[at]
            k, most = 0, min(len(w), len(last))
            while k < most and w[k] == last[k]:
                k += 1
            del states[k + 1 :]
            for i in range(k, len(w)):
                ch = ord(w[i])
                open_, found, begin, best = [], -1, i, None
                for j, node in [*states[i][3], (i, 0)]:  # longest first
                    node = child.get(node << 21 | ch)
                    if node is None:
                        continue
                    open_.append((j, node))
                    p = ends_at[node]
                    if p < 0:
                        continue
                    if viterbi:
                        s = states[j][0] + self.score[p]
                        if best is None or s > best:
                            best, found, begin = s, p, j
                    elif found < 0 and (j == i or self._ends(None, p) and (j == 0 or self._ends(states[j][1], p))):
                        found, begin = p, j
                if viterbi:
                    s = states[i][0] + self.poor
                    if best is None or s > best:
                        best, found, begin = s, -1, i
                states.append((best or 0.0, found if found >= 0 else n + ch, begin, open_))
            last, i, ids = w, len(w), []
            while i:
                _, p, begin, _ = states[i]
                if p < n:
                    ids.append(p)
                elif self.byte_ids:
                    ids.extend(self.byte_ids[b] for b in reversed(chr(p - n).encode()))
                elif not ids or ids[-1] != self.unknown or self.kind == "bpe":
                    ids.append(self.unknown)
                i = begin
            out[at] = ids[::-1]
        return out

    def encode(self, data: np.ndarray, off: np.ndarray, table: SpanTable) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of each text's)."""
        some = np.flatnonzero(np.diff(off))
        data = np.insert(data, off[:-1][some], 32)  # the mark in front of a text
        more = np.zeros(len(off), np.int64)
        more[1:] = np.cumsum(np.diff(off) > 0)
        off = off + more
        none = np.zeros(256, bool)
        doc, s, e, h = spans(data, off, none if self.whole else _ONLY_SPACE, lead=not self.whole)

        def make(raw: list[bytes]) -> tuple[np.ndarray, list[int]]:
            ids = self.encode_words([x.decode().replace(" ", MARK) for x in raw])
            return np.array([i for x in ids for i in x], np.int32), [len(x) for x in ids]

        if not len(h):
            return np.zeros(0, np.int32), np.zeros(len(off) - 1, np.int64)
        values, first, size = table.look(data.tobytes(), s, e, h, make)
        return values[ragged(first, size)], np.bincount(doc, weights=size, minlength=len(off) - 1).astype(np.int64)

    def decode(self, ids: np.ndarray, off: np.ndarray) -> pa.Array:
        """Texts of id lists: list i is ids[off[i]:off[i + 1]]."""
        parts = [np.zeros(0, np.uint8)]
        for lo in range(0, len(ids), CHUNK):
            x = ids[lo : lo + CHUNK]
            parts.append(self.raw[ragged(self.raw_first[x], self.raw_size[x])])
        data = np.concatenate(parts)
        ends = np.append(0, np.cumsum(self.raw_size[ids]))[off]
        first = np.zeros(len(off) - 1, bool)
        some = np.flatnonzero(np.diff(ends))
        first[some] = data[ends[some]] == 32  # the mark in front of a text
        keep = np.ones(len(data), bool)
        keep[ends[:-1][first]] = False
        ends = ends - np.append(0, np.cumsum(first))
        data = data[keep]
        texts = pa.StringArray.from_buffers(len(off) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))
        bad = np.flatnonzero(np.append(0, np.cumsum(self.is_byte[ids]))[off[1:]] > np.append(0, np.cumsum(self.is_byte[ids]))[off[:-1]])
        if not len(bad):
            return texts
        mended = {int(i): data[ends[i] : ends[i + 1]].tobytes().decode(errors="replace") for i in bad}  # bytes may be cut off
        return pa.array([mended[i] if i in mended else texts[i].as_py() for i in range(len(texts))], pa.string())


def model(path: str, kind: str) -> PieceModel:
    if (path, kind) not in _MODELS:
        _MODELS[path, kind] = PieceModel.load(path, kind)
        _MODELS[path, kind].table = SpanTable(CACHE, np.int32)
    return _MODELS[path, kind]


def encode(docs: DataFrame, path: str, kind: str = "bpe", decoded: bool = False) -> DataFrame:
    """docs with ids (array of int) and n_tokens (long) of the whole text; with decoded too, the text of these ids, if asked for.

    Spaces become marks, one more stands in front; no other normalisation is done. A null or empty
    text has no ids. Equal rows are encoded one by one; a text of any length is encoded whole. Further
    columns are passed on, those named as a result are replaced. An empty table gives no rows. Decoding in
    the same pass spares a second worker for each task, with its own tables.
    """
    kept = docs.drop("ids", "n_tokens", *(["decoded"] if decoded else []))
    made = {"ids": F.array(F.lit(0)), "n_tokens": F.lit(0).cast("long")} | ({"decoded": F.lit("")} if decoded else {})
    schema = kept.withColumns(made).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path, kind)
        for batch in batches:
            for part in slices(batch):
                ids, counts = m.encode(*text_buffer(part.column("text")), m.table)
                off = np.append(0, np.cumsum(counts))
                lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(counts), *([m.decode(ids, off)] if decoded else [])], names=schema.names)

    return kept.mapInArrow(run, schema)


def decode(coded: DataFrame, path: str, kind: str = "bpe") -> DataFrame:
    """coded with decoded, the text of its ids; null ids give an empty text."""
    kept = coded.drop("decoded")
    schema = kept.withColumn("decoded", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path, kind)
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy())
            lo = 0
            while lo < batch.num_rows:  # slices of about CHUNK ids
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + CHUNK, "right")))
                part = batch.slice(lo, hi - lo)
                ids = part.column("ids")
                ids = ids if not ids.null_count else pc.if_else(ids.is_null(), pa.scalar([], ids.type), ids)
                off = np.append(0, np.cumsum(pc.list_value_length(ids).to_numpy()))
                yield pa.RecordBatch.from_arrays([*part.columns, m.decode(ids.flatten().to_numpy(), off)], names=schema.names)
                lo = hi

    return kept.mapInArrow(run, schema)
