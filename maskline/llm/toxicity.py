"""Toxicity by bags of subword embeddings, averaged over a text and fed to a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskline.llm.common import bounded_sample, sliced
from maskline.llm.words import EXACT, FOLD, SpanTable, distinct, mix, release, slices, spans, text_buffer

#: What the model is fitted on at most: labelled texts and bytes of them, for each class.
LEARN_ROWS, LEARN_BYTES = 3000, 5 << 20
BUCKET_BITS, DIMENSIONS, SEED = 17, 2, 11
GRAMS = (3, 4, 5)
#: Passes over the sample, step, shrinkage of embeddings a pass, and the (word, text) pairs that a
#: feature must be met in to be learned.
EPOCHS, STEP, DECAY, SUPPORT = 80, 1.0, 0.02, 30
THRESHOLD = 0.3
#: Distinct words that a worker remembers.
CACHE = 500_000
#: Words whose features are found at once.
CHUNK = 8192
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[*range(33), *b".,;:!?|()[]{}<>\"/\\`"]] = True


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all words' features, number of each word's): its character n-grams and itself.

    The word stands between < and >. A-Z are folded before, so the bytes of words arrive as they are.
    """
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    if len(words) > CHUNK:  # the working arrays take some hundred bytes a letter
        parts = [features(words[i : i + CHUNK]) for i in range(0, len(words), CHUNK)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    raw = np.frombuffer(b"".join(b"<" + w.lower() + b">" for w in words), np.uint8)
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    end = np.cumsum(size)
    value = EXACT[raw]
    shift = np.uint64(64 - BUCKET_BITS)
    owner = np.repeat(np.arange(len(words)), size)
    buckets, owners = [], []
    room = end[owner] - np.arange(len(raw))
    h = np.zeros(len(raw), np.uint64)
    for n in range(1, min(max(GRAMS), len(raw)) + 1):
        h[: len(raw) - n + 1] = h[: len(raw) - n + 1] * np.uint64(0x100000001B3) + value[n - 1 :]
        if n in GRAMS:
            at = np.flatnonzero(room >= n)
            buckets.append((mix(h[at] + np.uint64(n)) >> shift).astype(np.int64))
            owners.append(owner[at])
    step = np.zeros(len(raw), np.uint64)
    step[:] = value * mix((np.arange(len(raw)) - np.repeat(end - size, size)).astype(np.uint64))
    buckets.append((mix(np.add.reduceat(step, end - size)) >> shift).astype(np.int64))
    owners.append(np.arange(len(words)))
    bucket, own = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return bucket[order].astype(np.int32), np.bincount(own, minlength=len(words))


class Model:
    """What scoring needs of embeddings and layer: averaging and the layer are linear, so a bucket's share in
    the difference of the two logits is one number (margin); offset is that of the biases.
    """

    def __init__(self, margin: np.ndarray, offset: float):
        self.margin, self.offset = margin.astype(np.float32), offset

    @classmethod
    def of(cls, embedding: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> Model:
        """From embeddings (buckets x dimensions), weights (dimensions x 2) and two biases."""
        return cls(embedding @ (weight[:, 1] - weight[:, 0]), float(bias[1] - bias[0]))

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        bucket, size = features(words)
        first = np.cumsum(size) - size
        return (np.add.reduceat(self.margin[bucket], first) / size).astype(np.float32), np.ones(len(words), np.int64)

    def score(self, data: np.ndarray, off: np.ndarray, known: SpanTable) -> np.ndarray:
        """Probability of label 1 for each text; one without words has that of the bias."""
        doc, s, e, h = spans(data, off, SEPARATOR, FOLD)
        n = len(off) - 1
        mean = np.zeros(n)
        if len(h):
            values, first, _ = known.look(data.tobytes(), s, e, h, self.words)
            count = np.bincount(doc, minlength=n)
            mean = np.bincount(doc, weights=values[first], minlength=n) / np.maximum(count, 1)
        return 1 / (1 + np.exp(-np.clip(mean + self.offset, -500, 500)))


def fit(texts: list[str], labels: np.ndarray, weights: np.ndarray) -> Model:
    """Embeddings and layer trained jointly, with Adam on all texts at once; deterministic.

    With two classes the gradient of every embedding lies along one direction, so few dimensions do.
    A feature's step is damped by the mean over features, so rare ones don't memorise single texts.
    """
    rng = np.random.default_rng(SEED)
    full = np.zeros((1 << BUCKET_BITS, DIMENSIONS))
    W = rng.normal(0, 1, (DIMENSIONS, 2))
    if not len(texts) or len(set(labels.tolist())) < 2:
        rate = float(np.mean(labels)) if len(labels) else 0.0
        return Model.of(full, W, np.array([0, np.log((rate + 1e-6) / (1 - rate + 1e-6))]))
    data, off = text_buffer(pa.array(texts, pa.large_string()))
    doc, s, e, h = spans(data, off, SEPARATOR, FOLD)
    at, word = distinct(h)
    raw = data.tobytes()
    bucket, size = features([raw[a:z] for a, z in zip(s[at].tolist(), e[at].tolist(), strict=True)])
    n_texts, n_words = len(texts), len(at)
    pair, count = np.unique(doc * n_words + word, return_counts=True)
    text_of, word_of = pair // max(n_words, 1), pair % max(n_words, 1)
    share = count / np.bincount(doc, minlength=n_texts)[text_of]
    text_of, word_of = text_of.astype(np.int32), word_of.astype(np.int32)
    owner = np.repeat(np.arange(n_words, dtype=np.int32), size)
    del data, off, doc, s, e, h, at, word, raw, pair, count
    met = np.bincount(bucket, weights=np.bincount(word_of, minlength=n_words)[owner], minlength=1 << BUCKET_BITS)
    learned = met[bucket] >= SUPPORT
    owner = owner[learned]
    used, local = np.unique(bucket[learned], return_inverse=True)
    local = local.astype(np.int32)
    del bucket, met, learned
    E = rng.normal(0, 0.05, (len(used), DIMENSIONS))
    mass = np.array([weights[labels == k].sum() for k in (0, 1)])
    b = np.log(mass / mass.sum())
    target, importance = np.eye(2)[labels], (weights / weights.sum())[:, None]
    state = [[p, np.zeros_like(p), np.zeros_like(p)] for p in (E, W, b)]
    for t in range(1, EPOCHS + 1):
        D = np.empty((n_texts, DIMENSIONS))
        for k in range(DIMENSIONS):
            V = np.bincount(owner, weights=E[local, k], minlength=n_words) / size
            D[:, k] = np.bincount(text_of, weights=V[word_of] * share, minlength=n_texts)
        z = D @ W + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - target) * importance
        gD, gE = g @ W.T, np.empty_like(E)
        for k in range(DIMENSIONS):
            gV = np.bincount(word_of, weights=gD[text_of, k] * share, minlength=n_words) / size
            gE[:, k] = np.bincount(local, weights=gV[owner], minlength=len(used))
        for (x, m, v), grad, rate, damp in zip(state, (gE, D.T @ g, g.sum(0)), (STEP, 0.3 * STEP, 0.1 * STEP), (1, 0, 0), strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            second = v / (1 - 0.99**t)
            x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(second) + damp * np.sqrt(second.mean() if second.size else 0) + 1e-12)
        E *= 1 - DECAY
    full[used] = E
    return Model.of(full, W, b)


def learn(docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS, size: int = LEARN_BYTES) -> Model:
    """A model from labelled documents, whole texts of a sample of each class.

    labels (doc_id, label); doc_ids of at most rows labels of each class are chosen by hash over all of
    them, and of their texts at most size bytes of each class; a text of over size / 64 characters enters
    in slices of that many, so none is too long. Losses are weighted to the classes' true shares. Null labels
    and null texts are left out; a doc_id with two labels counts under each, equal rows count each. Labels over 1 count
    as 1. Without labels, or with those of one class, the model is a constant: the share of label 1.
    """
    labels = labels.where("label is not null").select("doc_id", F.col("label").cast("int").alias("label"))
    share = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    ids = bounded_sample(labels, "label", F.lit(1), rows, ["doc_id"])
    texts = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most rows of each class
    got = bounded_sample(sliced(texts, max(size // 64, 1)), "label", F.octet_length("text").cast("long"), size, ["doc_id", "slice", "text"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: (r[0] is None, r[0], r[1], r[2]))
        y = np.array([min(max(r[1], 0), 1) for r in found], int)
        n = np.bincount(y, minlength=2)
        w = np.array([share.get(k, 0) / max(n[k], 1) for k in (0, 1)])
        m = fit([r[2] for r in found], y, w[y] if len(y) else np.zeros(0))
        del found
        release()
        yield pa.RecordBatch.from_arrays([pa.array([m.margin.tobytes()], pa.binary()), pa.array([m.offset])], names=["margin", "offset"])

    # the sample is bounded, so one task learns from it; the driver gets one number a bucket
    learned = got.select("doc_id", "label", "text").repartition(1).mapInArrow(train, "margin binary, offset double").first()
    if learned is None:  # a table known to be empty is no task's
        return fit([], np.zeros(0, int), np.zeros(0))
    return Model(np.frombuffer(learned["margin"], np.float32), learned["offset"])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (probability of label 1, from the whole text alone) and predicted (1 from threshold on).

    A null or empty text, or one without words, gets the bias's score. Equal rows get equal scores, each a row
    of its own; a text of any length is scored whole. Further columns are passed on; those named score or
    predicted are replaced. Empty tables give no rows.
    """
    kept = docs.drop("score", "predicted")
    schema = kept.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema
    margin, offset = model.margin, model.offset
    shared = docs.sparkSession.sparkContext.broadcast((margin, offset))  # 2**BUCKET_BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        known = SpanTable(CACHE, np.float32)
        for batch in batches:
            for part in slices(batch):
                p = m.score(*text_buffer(part.column("text")), known)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=schema.names)

    return kept.mapInArrow(run, schema)
