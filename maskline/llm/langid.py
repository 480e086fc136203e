"""Language identification by prediction by partial matching over bytes, with frozen statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskline.llm.common import bounded_sample, sliced
from maskline.llm.words import HashIndex, mix, slices, text_buffer

#: Bytes of labelled text that a language is learned from at most, those of all languages together, the longest
#: context, and languages that share a table of grams: tables grow with the bytes learned, not with their product
#: with the number of languages.
LEARN_BYTES, TOTAL_BYTES, ORDER, GROUP = 2 << 20, 64 << 20, 4, 8
UNKNOWN = "und"
#: Bytes that are coded together.
STEP = 1 << 18


class _Keys:
    """Sorted distinct grams of one length, with their numbers."""

    def __init__(self, keys: np.ndarray):
        self.index = HashIndex(len(keys) + 1)
        self.index.add(mix(keys + np.uint64(1)))
        self.n = len(keys)

    def find(self, grams: np.ndarray) -> np.ndarray:
        return self.index.find(mix(grams + np.uint64(1)))


def grams(data: np.ndarray, off: np.ndarray, n: int) -> np.ndarray:
    """For each byte the n bytes that end with it as a number; bytes before a document count as 0."""
    g = np.zeros(len(data), np.uint64)
    for back in range(n):
        g[back:] |= data[: len(data) - back].astype(np.uint64) << np.uint64(8 * back)
    for j in range(n - 1):
        at = off[:-1][off[1:] - off[:-1] > j] + j
        g[at] &= np.uint64((1 << (8 * (j + 1))) - 1)
    return g


class PPM:
    """Models of all languages, in groups of GROUP that share tables."""

    def __init__(self, texts: dict[str, list[bytes]], order: int = ORDER):
        self.languages = sorted(texts)
        names = [self.languages[i : i + GROUP] for i in range(0, len(texts), GROUP)]
        self.groups = [Trees({x: texts[x] for x in some}, order) for some in names]

    def bits(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Exact code length of each document under each language's model."""
        return np.concatenate([np.zeros((len(off) - 1, 0)), *(g.bits(data, off) for g in self.groups)], axis=1)


class Trees:
    """One context tree for each language, to depth order; all trees share one table for each depth.

    With T symbols seen after a context, D of them distinct, a symbol seen n times there has
    probability n / (T + D), and the escape to the next shorter context D / (T + D). Below the empty
    context all 256 bytes are alike. cost[k] holds the bits of each gram of k + 1 bytes that any
    language has seen, for each language; escape[k] those of leaving a context of k bytes.
    """

    def __init__(self, texts: dict[str, list[bytes]], order: int = ORDER):
        self.languages, self.order = sorted(texts), order
        m = len(self.languages)
        self.keys: list[_Keys] = []
        self.contexts: list[_Keys] = []
        self.cost: list[np.ndarray] = []
        self.escape: list[np.ndarray] = []
        if not m:
            return
        joined = [(np.frombuffer(b"".join(texts[x]), np.uint8), np.cumsum([0, *map(len, texts[x])])) for x in self.languages]
        for n in range(1, order + 2):
            seen = [np.unique(grams(d, o, n), return_counts=True) for d, o in joined]
            keys = np.unique(np.concatenate([k for k, _ in seen]))
            counts = np.zeros((len(keys), m))
            for i, (k, c) in enumerate(seen):
                counts[np.searchsorted(keys, k), i] = c
            context, group = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(context), m)), np.zeros((len(context), m))
            np.add.at(total, group, counts)
            np.add.at(kinds, group, counts > 0)
            escape = np.where(total > 0, np.log2(np.maximum(total + kinds, 1) / np.maximum(kinds, 1)), 0.0)
            below = np.full((len(keys), m), 8.0)
            if n > 1:
                below = self.cost[-1][self.keys[-1].find(keys & np.uint64((1 << (8 * (n - 1))) - 1))].astype(float)
            cost = np.where(counts > 0, np.log2(np.maximum((total + kinds)[group], 1) / np.maximum(counts, 1)), escape[group] + below)
            self.keys.append(_Keys(keys))
            self.contexts.append(_Keys(context))
            self.cost.append(cost.astype(np.float32))
            self.escape.append(escape.astype(np.float32))

    def byte_costs(self, g: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each gram of order + 1 bytes, for each language."""
        out = np.zeros((len(g), len(self.languages)), np.float32)
        at = self.keys[self.order].find(g)
        np.take(self.cost[self.order], np.maximum(at, 0), axis=0, out=out)
        left = np.flatnonzero(at < 0)
        out[left] = 0
        rest = g[left]
        for n in range(self.order, -1, -1):  # these were not found with n context bytes
            if not len(left):
                break
            c = self.contexts[n].find(rest >> np.uint64(8))
            out[left] += np.where((c >= 0)[:, None], self.escape[n][np.maximum(c, 0)], 0)
            if n == 0:
                out[left] += 8
                break
            rest = rest & np.uint64((1 << (8 * n)) - 1)
            at = self.keys[n - 1].find(rest)
            hit = at >= 0
            out[left[hit]] += self.cost[n - 1][at[hit]]
            left, rest = left[~hit], rest[~hit]
        return out

    def bits(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Exact code length of each document under each language's model."""
        total = np.zeros((len(off) - 1, len(self.languages)))
        for lo in range(0, len(data), STEP):
            a, hi = max(0, lo - self.order), min(len(data), lo + STEP)
            near = np.clip(off - a, 0, hi - a)
            g = grams(data[a:hi], near[np.searchsorted(off, a, "right") - 1 :], self.order + 1) if a == 0 or a in off else self._inner(data, off, a, hi)
            cost = self.byte_costs(g[lo - a :])
            first, last = int(np.searchsorted(off, lo, "right")) - 1, int(np.searchsorted(off, hi, "left"))
            edge = np.clip(off[first : last + 1] - lo, 0, hi - lo)
            full = np.flatnonzero(edge[1:] > edge[:-1])
            total[first + full] += np.add.reduceat(cost, edge[:-1][full], axis=0, dtype=np.float64)
        return total

    def _inner(self, data: np.ndarray, off: np.ndarray, a: int, hi: int) -> np.ndarray:
        """As grams() from byte a on, which is inside a document."""
        bounds = np.concatenate([off[(off > a) & (off < hi)] - a, [hi - a]])
        g = grams(data[a:hi], bounds, self.order + 1)
        return g


def learn(labelled: DataFrame, bound: int = LEARN_BYTES, order: int = ORDER) -> PPM:
    """The models of the languages in labelled (doc_id, text, lang), from whole texts of a sample.

    The sample has at most bound bytes of each language (less where there are more than TOTAL_BYTES / bound
    languages), chosen by a hash of doc_id and text over all rows. A text of over bound / 64 characters enters in slices
    of that many, so none is too long to be learned from. Null texts and languages are left out; equal rows count each.
    """
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    bound = max(1, min(bound, TOTAL_BYTES // max(1, rows.select("lang").distinct().count())))
    chosen = bounded_sample(sliced(rows, max(bound // 64, 1)), "lang", F.octet_length("text").cast("long"), bound, ["doc_id", "slice", "text"])
    texts: dict[str, list[bytes]] = {}
    for r in chosen.orderBy("lang", "doc_id", "slice", "text").toLocalIterator():
        if r["text"]:
            texts.setdefault(r["lang"], []).append(r["text"].encode())
    return PPM(texts, order)


def predict(docs: DataFrame, model: PPM) -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte, *the rest of docs) for every row, from text alone.

    lang_pred is the language whose model gives the whole text the shortest code (ties: the name that
    sorts first), score its share of the posterior under equal priors. A text that is null or has no
    letter, or a model without any language, gives 'und' with score 0. A text of any length is read whole; equal rows
    are judged each, alike. docs may have further columns,
    which are passed on; those named as a result column are replaced. Empty tables give no rows.
    """
    made = ["lang_pred", "score", "bits_per_byte"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 5 grams a learned byte
    kept = docs.drop(*made).withColumn("_letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    schema = docs.drop(*made).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "bits_per_byte": F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch):
                data, off = text_buffer(part.column("text"))
                letter = part.column("_letter").to_numpy(zero_copy_only=False)
                size = np.maximum(np.diff(off), 1)
                if m.languages:
                    bits = m.bits(data, off)
                    best = bits.argmin(1)
                    score = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
                    rate = bits.min(1) / size
                else:
                    letter, best, score, rate = letter & False, np.zeros(len(size), int), np.zeros(len(size)), np.zeros(len(size))
                names = np.array([*m.languages, UNKNOWN], object)[np.where(letter, best, len(m.languages))]
                columns = [c for n, c in zip(part.schema.names, part.columns, strict=True) if n != "_letter"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(np.where(letter, score, 0.0)), pa.array(np.where(letter, rate, 0.0))], names=schema.names)

    return kept.mapInArrow(run, schema)
