"""Exact Jaccard join of word n-gram sets by vertical partitioning of the global n-gram order.

The order of all n-grams is (how often their bucket of a fixed-size sketch is met, hash): rare ones
first. A set of size n that is similar to another shares one of its first n - ceil(t n) + 1 n-grams
with it, so only these prefixes are posted. Candidates are then counted vertically: the order is cut
into fragments of equal mass, each set into one segment for each fragment, overlaps are counted
fragment by fragment and summed for each pair.

Equal sets are one class, whichever rows have them. A pair of classes is only looked at while it can
still join two components: first each class with a few of its posting list and size band. What is left
of the posting lists is compared in tasks, a bounded block at a time, and one link for each member of
a block leaves it: classes that these connect are a family. Families are compared in cells of bounded
size, each fragment of a cell by itself; the partial overlaps of a cell's pairs travel as one array. No
table of pairs of a family is made.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskline.llm.common import components, discard, local_components, written
from maskline.llm.words import EXACT, FOLD, SPACE, mix, ragged, release, slices, spans, text_buffer

#: The sketch has a counter (4 bytes) for each LOAD n-grams, 2**MOST_BITS at most; it only orders n-grams.
LEAST_BITS, MOST_BITS, LOAD, BLOCK, FRAGMENTS = 12, 24, 64, 4096, 8
#: Rounds (a second one adds few links for its stages), and in each the classes of a posting list that all its others are held against.
ROUNDS, LEADERS = 1, 3
#: Entries of posting lists that are compared in one task, on average; a longer list is cut into parts.
LIST = 1024
#: Entries of a posting list, and how many times the mean of all counters, from which on it is dealt over several tasks.
HOT, HOT_MEANS = 1 << 14, 16
#: Classes that are compared with each other in one task, on average; those of a block of a large family.
CELL, HALF = 256, 1024
#: Hashes of texts that are broadcast at most: 8 bytes each, about 24 in a table. Beyond, texts are shuffled.
BROADCAST = 1_500_000
#: Pairs of entries looked at together in a task.
PAIRS = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, off: np.ndarray, words: int, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct n-gram hashes of all texts one after the other, number of each text's).

    A text of fewer words has its whole sequence as its one n-gram; one without words has none.
    """
    doc, _, _, h = spans(data, off, SPACE, FOLD if fold else EXACT)
    n = len(off) - 1
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    enough = np.flatnonzero(count >= words)
    at = np.arange(max(0, len(h) - words + 1))
    at = at[doc[at] == doc[at + words - 1]] if len(at) else at
    g = h[at].copy()
    for j in range(1, words):
        g = g * _ODD + h[at + j]
    g = mix(g)
    of = doc[at]
    sizes, out = np.zeros(n, np.int64), []
    lo = np.searchsorted(of, enough, "left")
    hi = np.searchsorted(of, enough, "right")
    sets = dict(zip(enough.tolist(), zip(lo.tolist(), hi.tolist(), strict=True), strict=True))
    for i in range(n):
        if i in sets:
            a, b = sets[i]
            x = np.unique(g[a:b])
        elif count[i]:
            k = np.array([count[i]], np.uint64)
            for w in h[first[i] : first[i] + count[i]]:
                k = k * _ODD + w
            x = mix(k)
        else:
            continue
        sizes[i] = len(x)
        out.append(x)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def sketch_bits(docs: DataFrame) -> int:
    """Size of the sketch by the table's bytes, taking six for a word."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(max(1, size // (6 * LOAD)))))))


def _signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)


def fingerprints(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set; sets are equal where both and the sizes are."""
    some = np.flatnonzero(sizes)
    first = (np.cumsum(sizes) - sizes)[some]
    out = np.zeros((2, len(sizes)), np.uint64)
    if len(some):
        out[0, some] = np.add.reduceat(mix(h + _ODD), first)
        out[1, some] = np.add.reduceat(mix(h ^ _ODD), first)
    return _signed(out[0]), _signed(out[1])


def _scan(docs: DataFrame, words: int, bits: int) -> DataFrame:
    """A row (doc_id, th, n, h1, h2) for each of docs (doc_id, th, text), and each task's part of the sketch (block, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << bits, np.int32)

        def rows(ids, th, n, h1, h2, block, counts) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, k) if not isinstance(x, pa.Array) else x for x, k in zip((ids, th, n, h1, h2, block, counts), kinds, strict=True)], names=["doc_id", "th", "n", "h1", "h2", "block", "counts"])

        for batch in batches:
            for part in slices(batch):
                h, sizes = shingle_sets(*text_buffer(part.column("text")), words)
                at, count = np.unique(_bucket(h, bits), return_counts=True)
                sketch[at] += count.astype(np.int32)
                none = [None] * len(sizes)
                yield rows(part.column("doc_id").cast(pa.int64()), part.column("th"), sizes.astype(np.int32), *fingerprints(h, sizes), none, none)
        blocks = sketch.reshape(-1, BLOCK)
        used = np.flatnonzero(blocks.any(1))
        none = [None] * len(used)
        yield rows(none, none, none, none, none, used.astype(np.int32), [zlib.compress(blocks[i].astype("<i4").tobytes(), 1) for i in used])

    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, n int, h1 long, h2 long, block int, counts binary")


def _sketch(scan: DataFrame, bits: int) -> np.ndarray:
    """The counters, summed over tasks in two steps; at most 4 * 2**bits bytes come to the driver."""
    import pandas as pd

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK, np.int64)
        for c in pdf["counts"]:
            total += np.frombuffer(zlib.decompress(c), "<i4")
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "counts": [zlib.compress(np.minimum(total, 2**31 - 1).astype("<i4").tobytes(), 1)]})

    parts = scan.where("block is not null").select("block", "counts", (F.spark_partition_id() % 16).alias("salt"))
    for keys in (["block", "salt"], ["block"]):
        parts = parts.groupBy(*keys).applyInPandas(add, "block int, counts binary").withColumn("salt", F.lit(0))
    out = np.zeros(1 << bits, np.int32).reshape(-1, BLOCK)
    for r in parts.toLocalIterator():
        out[r["block"]] = np.frombuffer(zlib.decompress(r["counts"]), "<i4")
    return out.reshape(-1)


def _fragments(sketch: np.ndarray) -> np.ndarray:
    """For each bucket its fragment: the order of counts, cut where about equal masses end. Equal counts that cuts fall on are dealt over their fragments."""
    step = 1 << 20
    total, goal, cuts, mass = int(sketch.sum(dtype=np.int64)), 1, [], 0
    ordered = np.sort(sketch)
    for lo in range(0, len(ordered), step):
        upto = mass + np.cumsum(ordered[lo : lo + step], dtype=np.int64)
        while goal < FRAGMENTS and upto[-1] * FRAGMENTS >= goal * total and total:
            cuts.append(ordered[lo + int(np.searchsorted(upto * FRAGMENTS, goal * total))])
            goal += 1
        mass = int(upto[-1])
    del ordered
    cuts = np.array(cuts, sketch.dtype)
    out = np.empty(len(sketch), np.int8)
    for lo in range(0, len(sketch), step):
        part = sketch[lo : lo + step]
        first, last = np.searchsorted(cuts, part, "left"), np.searchsorted(cuts, part, "right")
        out[lo : lo + step] = first + np.arange(lo, lo + len(part)) % (last - first + 1)
    return out


def _fresh(c: np.ndarray, sizes: np.ndarray, seen: set[int]) -> np.ndarray:
    """Numbers of the texts with n-grams whose class the task meets for the first time."""
    out = []
    for i, (x, n) in enumerate(zip(c.tolist(), sizes.tolist(), strict=True)):
        if n and x not in seen:
            seen.add(x)
            out.append(i)
    return np.array(out, np.int64)


def _postings(docs: DataFrame, words: int, percent: int, shared) -> DataFrame:
    """(token, c, place, salts, salt): a row for each of the first n-grams of each set in the global order.

    c is the set's fingerprint, place its size and the n-gram's rank in it; salts says over how many tasks the
    n-gram's list is dealt, by its counter, and salt which of them is the row's. A task gives each set once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, bits = shared.value[0], shared.value[2]
        hot = HOT + HOT_MEANS * int(sketch.mean())
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch):
                h, sizes = shingle_sets(*text_buffer(part.column("text")), words)
                c, _ = fingerprints(h, sizes)
                some = _fresh(c, sizes, seen)
                first = np.cumsum(sizes) - sizes
                often = sketch[_bucket(h, bits)]
                at = [np.zeros(0, np.int64)]
                for lo, n in zip(first[some].tolist(), sizes[some].tolist(), strict=True):
                    k = n - (percent * n + 99) // 100 + 1
                    at.append(lo + np.argsort(often[lo : lo + n], kind="stable")[:k])  # ties: by hash
                count = np.array([len(x) for x in at[1:]], np.int64)
                at = np.concatenate(at)
                owner = np.repeat(some, count)
                rank = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
                salts = 1 + often[at] // hot
                salt = (mix(c[owner].view(np.uint64) ^ _ODD) % salts.astype(np.uint64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(h[at])), pa.array(c[owner]), pa.array((sizes[owner] << 32) | rank), pa.array(salts.astype(np.int32)), pa.array(salt)], names=["token", "c", "place", "salts", "salt"])

    return docs.select("text").mapInArrow(run, "token long, c long, place long, salts int, salt int")


def _segments(docs: DataFrame, wanted: DataFrame, words: int, shared) -> DataFrame:
    """(c, n, fragment, part): the sets of the wanted classes (c, th) cut into a segment for each fragment.

    th is the hash of one text of the class; texts are read again by it, and whatever text turns out to
    be of the class serves, as all its texts have one set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fragment, bits = shared.value[1:]
        seen: set[int] = set()
        for batch in batches:
            for rows in slices(batch):
                h, sizes = shingle_sets(*text_buffer(rows.column("text")), words)
                c, _ = fingerprints(h, sizes)
                some = _fresh(c, sizes, seen)
                key = np.repeat(np.arange(len(sizes)), sizes) * FRAGMENTS + fragment[_bucket(h, bits)]
                order = np.argsort(key, kind="stable")
                key, h = key[order], h[order]
                slot = (some[:, None] * FRAGMENTS + np.arange(FRAGMENTS)).ravel()
                lo, hi = np.searchsorted(key, slot, "left"), np.searchsorted(key, slot, "right")
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(hi - lo)), pa.int32()), pa.array(_signed(h[ragged(lo, hi - lo)])))
                doc = slot // FRAGMENTS
                yield pa.RecordBatch.from_arrays([pa.array(c[doc]), pa.array(sizes[doc].astype(np.int32)), pa.array((slot % FRAGMENTS).astype(np.int32)), lists], names=["c", "n", "fragment", "part"])

    wanted = written(wanted)
    hashes = wanted.select("th").distinct()
    few = F.broadcast(hashes) if wanted.count() <= BROADCAST else hashes  # else texts move to their hashes
    texts = docs.join(few, "th", "left_semi").select("text")
    cut = texts.mapInArrow(run, "c long, n int, fragment int, part array<long>")
    segments = written(cut.join(wanted.select("c").distinct(), "c", "left_semi").dropDuplicates(["c", "fragment"]))
    discard(wanted)
    return segments


def _links(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int, shared) -> DataFrame:
    """Of the pairs (a, na, b, nb) those that are similar: partial overlaps, summed for each pair.

    Only the sets of classes in a pair are cut into segments and moved.
    """
    pairs = written(pairs)
    wanted = classes.join(pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct(), "c").select("c", "th")
    segments = _segments(docs, wanted, words, shared)
    each = pairs.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))))
    a = segments.select(F.col("c").alias("a"), "fragment", F.col("part").alias("pa"))
    b = segments.select(F.col("c").alias("b"), "fragment", F.col("part").alias("pb"))
    counted = each.join(a, ["a", "fragment"]).join(b, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("pa", "pb")).alias("k"))
    overlap = counted.groupBy("a", "b", "na", "nb").agg(F.sum("k").alias("k"))
    links = written(overlap.where(F.col("k") * (100 + percent) >= percent * (F.col("na") + F.col("nb")).cast("long")).select("a", "b"))
    discard(segments, pairs)
    return links


def candidates(token: np.ndarray, n: np.ndarray, room: np.ndarray, g: np.ndarray, side: np.ndarray | None, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of entries (i, j) of one posting list whose classes may still be similar and aren't of one component g.

    Their sizes are close enough, and so many n-grams are left after the common one in both sets. Where
    sides are given, only pairs of different sides count. About PAIRS pairs are looked at together.
    """
    order = np.lexsort((n, token))
    token, n, room, g = token[order], n[order].astype(np.int64), room[order].astype(np.int64), g[order]
    run = np.cumsum(np.diff(token, prepend=token[:1]) != 0) if len(token) else token
    key = run * (1 << 33) + n
    stop = np.searchsorted(key, run * (1 << 33) + 100 * n // percent, "right")
    count = np.maximum(stop - np.arange(len(n)) - 1, 0)
    ends = np.cumsum(count)
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
        i = np.repeat(np.arange(lo, hi), count[lo:hi])
        j = ragged(np.arange(lo, hi) + 1, count[lo:hi])
        keep = (g[i] != g[j]) & ((100 + percent) * np.minimum(room[i], room[j]) >= percent * (n[i] + n[j]))
        if side is not None:
            keep &= side[order][i] != side[order][j]
        yield order[i[keep]], order[j[keep]]
        lo = hi


def _cut_lists(lists: DataFrame, columns: list[str]) -> DataFrame:
    """Posting lists dealt over groups: short lists share one, a long one is cut into parts that meet two by two.

    Most entries of a long list may be of one component, its top: their parts needn't meet each other, only
    the others' parts. Columns group, lo and hi name the place; part is the row's own part in it.
    """
    groups = F.greatest(F.lit(1), F.ceil(F.lit(lists.count() / LIST))).cast("long")
    tops, rest = (F.ceil(F.col(x) / LIST).cast("int") for x in ("m_top", "m_rest"))
    long_ = F.col("m_top") + F.col("m_rest") > LIST
    mine = F.xxhash64("c", F.lit(3))
    part = F.when(~long_, 0).when(F.col("top"), F.pmod(mine, tops)).otherwise(tops + F.pmod(mine, rest)).cast("int")
    others = F.when(~long_, F.array(F.lit(0))).when(F.col("top"), F.sequence(tops, tops + rest - 1)).otherwise(F.sequence(F.lit(0), tops + rest - 1))
    dealt = lists.select(*columns, F.when(long_, F.col("token")).otherwise(F.pmod(F.xxhash64("token"), groups)).alias("group"), long_.alias("long"), part.alias("part"), F.explode(others).alias("other"))
    return dealt.withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other"))


def _families(lists: DataFrame, percent: int) -> DataFrame:
    """(node, component): the classes that candidates connect. A task gives one link for each class that it connects."""

    def connect(table: pa.Table) -> pa.Table:
        token, c, n, room, g, part = (table.column(x).to_numpy() for x in ("token", "c", "n", "room", "g", "part"))
        nodes, of = np.unique(c, return_inverse=True)
        root = np.arange(len(nodes))
        two = table.column("lo")[0].as_py() != table.column("hi")[0].as_py()
        for i, j in candidates(token, n, room, g, part if two else None, percent):
            u, v = root[of[i]], root[of[j]]
            new = u != v
            if new.any():
                u, v = np.divmod(np.unique(u[new] * len(nodes) + v[new]), len(nodes))
                root = local_components(len(nodes), u, v)[root]
        linked = np.flatnonzero(root != np.arange(len(nodes)))
        release()
        return pa.table({"a": nodes[linked], "b": nodes[root[linked]]})

    dealt = _cut_lists(lists, ["token", "c", "n", "room", "g"])
    # written: else each task would hold a worker for connect and one for what components do first
    links = written(dealt.groupBy("group", "long", "lo", "hi").applyInArrow(connect, "a long, b long"))
    found = components(links)
    discard(links)
    return found


def _blocks_met(lists: DataFrame, percent: int) -> DataFrame:
    """(x, y): blocks with candidates between them, or within where x = y; lists have the block of each entry."""

    def meet(table: pa.Table) -> pa.Table:
        token, n, room, g, block, part = (table.column(x).to_numpy() for x in ("token", "n", "room", "g", "block", "part"))
        names, of = np.unique(block, return_inverse=True)
        met = np.zeros(0, np.int64)
        two = table.column("lo")[0].as_py() != table.column("hi")[0].as_py()
        for i, j in candidates(token, n, room, g, part if two else None, percent):
            x, y = np.minimum(of[i], of[j]), np.maximum(of[i], of[j])
            met = np.union1d(met, x * len(names) + y)
        x, y = np.divmod(met, max(len(names), 1))
        return pa.table({"x": names[x], "y": names[y]})

    dealt = _cut_lists(lists, ["token", "c", "n", "room", "g", "block"])
    return dealt.groupBy("group", "long", "lo", "hi").applyInArrow(meet, "x long, y long").distinct()


def overlap(parts: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a few segments (each without repeats), m x m."""
    m = len(parts)
    token, column, count = np.unique(np.concatenate(parts) if m else np.zeros(0, np.int64), return_inverse=True, return_counts=True)
    owner, column = np.repeat(np.arange(m), [len(x) for x in parts]), column.reshape(-1)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    out, n = np.zeros((m, m), np.float32), int(shared.sum())  # exact up to 2**24 common n-grams of a segment
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for lo in range(0, n, 2048):
        a, b = np.searchsorted(column, (lo, lo + 2048))
        met = np.zeros((m, min(2048, n - lo)), np.float32)
        met[owner[a:b], column[a:b] - lo] = 1
        out += met @ met.T
    return out


def _open_pairs(n: np.ndarray, family: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pairs of a cell that are to be counted: of one family, of sizes that fit."""
    n, at, pairs = n.astype(np.int64), np.arange(len(n)), []
    for lo in range(0, len(n), 256):
        x = slice(lo, lo + 256)
        least, most = np.minimum(n[x, None], n[None]), np.maximum(n[x, None], n[None])
        i, j = np.nonzero((family[x, None] == family[None]) & (100 * least >= percent * most) & (at[x, None] < at[None]))
        pairs.append(np.stack([i + lo, j]).astype(np.int32))
    return tuple(np.concatenate(pairs, axis=1))


def _settle(lists: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int, shared) -> DataFrame:
    """Links (a, b) that join what all similar classes join that the lists leave open, in families.

    Small families share a cell of about CELL classes. A larger one is cut into blocks of about HALF
    classes, those of one rarest common n-gram together, and each two blocks with a candidate between
    them are a cell. Each fragment of a cell is counted by itself: one row has the partial overlaps of
    the cell's pairs, which are summed over the fragments.
    """
    family = _families(lists, percent)
    size = family.groupBy("component").agg(F.count("*").alias("m"))
    first = lists.groupBy("c").agg(F.min(F.struct("rank", "token")).alias("t"), F.min("n").alias("n"))
    of = written(family.join(size, "component").join(first, family["node"] == first["c"]).select("c", "n", "component", "m", F.col("t.token").alias("t")))
    cells = F.greatest(F.lit(1), F.ceil(F.lit(family.count() / CELL))).cast("long")
    small = of.where(F.col("m") <= CELL).select("c", "component", F.pmod(F.xxhash64("component"), cells).alias("x"), F.pmod(F.xxhash64("component"), cells).alias("y"))
    large = of.where(F.col("m") > CELL).withColumn("b", F.pmod(F.xxhash64("t"), F.ceil(F.col("m") / HALF)))
    full = large.groupBy("component", "b").agg(F.ceil(F.count("*") / HALF).alias("cuts"))
    blocks = large.join(full, ["component", "b"]).select("c", "component", F.xxhash64("component", "b", F.pmod(F.xxhash64("c"), F.col("cuts"))).alias("block"))
    blocks = written(blocks)
    members, met = small, None
    if not blocks.isEmpty():
        met = written(_blocks_met(lists.join(blocks.select("c", "block"), "c"), percent))
        sides = met.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
        members = small.unionByName(blocks.join(sides, "block").select("c", "component", "x", "y"))
    segments = _segments(docs, classes.join(of.select("c"), "c").select("c", "th"), words, shared)

    def count(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("c")
        c, n, family = (table.column(x).to_numpy() for x in ("c", "n", "component"))
        part = table.column("part").combine_chunks()
        flat, off = part.flatten().to_numpy(), np.append(0, np.cumsum(part.value_lengths().to_numpy()))
        k = overlap([flat[a:b] for a, b in zip(off[:-1], off[1:], strict=True)])
        i, j = _open_pairs(n, family, percent)
        f = table.column("fragment")[0].as_py()
        one = lambda x: pa.array([x.tobytes()], pa.binary())
        none = pa.array([None], pa.binary())
        release()
        return pa.table({"x": table.column("x")[:1], "y": table.column("y")[:1], "counts": pa.array([zlib.compress(k[i, j].astype("<u4").tobytes(), 1)], pa.binary()), "c": one(c) if f == 0 else none, "n": one(n) if f == 0 else none, "family": one(family) if f == 0 else none})

    def total(table: pa.Table) -> pa.Table:
        k, c = 0, None
        for row in table.to_pylist():  # a row for each fragment
            k = k + np.frombuffer(zlib.decompress(row["counts"]), "<u4").astype(np.int64)
            if row["c"] is not None:
                c, n, family = (np.frombuffer(row[x], kind) for x, kind in (("c", "<i8"), ("n", "<i4"), ("family", "<i8")))
        i, j = _open_pairs(n, family, percent)
        hit = k * (100 + percent) >= percent * (n[i].astype(np.int64) + n[j])
        root = local_components(len(c), i[hit], j[hit])
        linked = np.flatnonzero(root != np.arange(len(c)))
        return pa.table({"a": c[linked], "b": c[root[linked]]})

    partial = members.join(segments, "c").groupBy("x", "y", "fragment").applyInArrow(count, "x long, y long, counts binary, c binary, n binary, family binary")
    links = written(partial.groupBy("x", "y").applyInArrow(total, "a long, b long"))
    discard(segments, family, of, blocks, *([met] if met is not None else []))
    return links


def grouped(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, th, n, c, g) for every row of docs (doc_id, text): th is a hash of the text, n the size of its set,
    c its class and g the component of classes that links reach, both null for empty sets.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("th", F.xxhash64("text"))
    bits = sketch_bits(docs)
    scan = written(_scan(docs, words, bits))
    rows = scan.where("n is not null").select("doc_id", "th", "n", F.col("h1").alias("c"), "h2")
    sketch = _sketch(scan, bits)
    shared = spark.sparkContext.broadcast((sketch, _fragments(sketch), bits))  # 5 bytes a counter
    classes = written(rows.where("n > 0").groupBy("c", "n", "h2").agg(F.min("th").alias("th")))
    bound = float(np.log(100 / percent))
    posted = _postings(docs, words, percent, shared)  # one exchange of all postings; a long list's parts are kept unseen
    mine = Window.partitionBy("token", "salt")
    shared_by = posted.withColumns({"c0": F.min("c").over(mine), "c1": F.max("c").over(mine)}).where("c0 <> c1 or salts > 1").dropDuplicates(["token", "salt", "c"])
    n = F.shiftright("place", 32).cast("int")
    lists = written(shared_by.select("token", "salt", "salts", "c", n.alias("n"), F.col("place").bitwiseAND((1 << 32) - 1).cast("int").alias("rank"), F.floor(F.log(n.cast("double")) / bound).cast("int").alias("band"), F.col("c").alias("g")))
    fits = (100 * F.least("na", "nb").cast("long")) >= (percent * F.greatest("na", "nb").cast("long"))

    def ordered(pairs: DataFrame) -> DataFrame:
        """One row for each pair that its prefixes leave open.

        The set whose prefix ends first in the order shares with the other only n-grams of both prefixes
        and of its own rest, so the common n-grams of the prefixes and the longer rest must reach what
        the overlap has to.
        """
        low = F.col("a") < F.col("b")
        met = pairs.where(fits).select(
            F.least("a", "b").alias("a"), F.when(low, F.col("na")).otherwise(F.col("nb")).alias("na"),
            F.greatest("a", "b").alias("b"), F.when(low, F.col("nb")).otherwise(F.col("na")).alias("nb"),
        ).groupBy("a", "na", "b", "nb").agg(F.count("*").alias("k"))
        rest = F.ceil(F.greatest("na", "nb").cast("long") * percent / 100.0 - 1e-9) - 1
        return met.where((F.col("k") + rest) * (100 + percent) >= percent * (F.col("na") + F.col("nb")).cast("long")).drop("k")

    def salted(tokens: DataFrame) -> DataFrame:
        """Rows of tokens once for each part of their posting lists."""
        return tokens.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    links = None
    for k in range(ROUNDS):
        seats = [F.min(F.struct(F.xxhash64("c", F.lit(k * LEADERS + i)).alias("h"), "c", "n", "g")) for i in range(LEADERS)]
        leaders = salted(lists.groupBy("token", "band").agg(F.array(*seats).alias("m"), F.max("salts").alias("salts")))
        stars = lists.join(leaders, ["token", "band", "salt"]).select("c", "n", "g", F.explode(F.array_distinct("m")).alias("m"))
        stars = stars.where("g <> m.g").select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("m.c").alias("b"), F.col("m.n").alias("nb"))
        new = _links(ordered(stars), docs, classes, words, percent, shared)
        links = new if links is None else links.unionByName(new)
        # lists of one component are done
        found = components(links)
        named = written(lists.drop("g").join(found, F.col("c") == found["node"], "left").withColumn("g", F.coalesce("component", "c")).drop("node", "component"))
        of = named.groupBy("token", "g").agg(F.count("*").alias("m"), F.max("salts").alias("salts"))
        of = of.groupBy("token").agg(F.max(F.struct("m", "g")).alias("t"), F.sum("m").alias("m"), F.max("salts").alias("salts")).where("m > t.m")
        mixed = salted(of.select("token", "salts", F.col("t.g").alias("g0"), F.col("t.m").alias("m_top"), (F.col("m") - F.col("t.m")).alias("m_rest")))
        rest = written(named.join(mixed, ["token", "salt"]).withColumn("top", F.col("g") == F.col("g0")).drop("g0"))
        discard(lists, named)
        lists = rest
    # a common n-gram of a pair: no more than it and what follows it in either set can be common, if it is the first
    lists = lists.withColumn("room", F.col("n") - F.col("rank"))
    links = links.unionByName(_settle(lists, docs, classes, words, percent, shared))
    found = components(links)
    of = classes.join(found, classes["c"] == found["node"], "left").select("c", "n", "h2", F.coalesce("component", "c").alias("g"))
    of, empty = written(of), F.lit(None).cast("long")
    out = written(
        rows.where("n > 0").join(of, ["c", "n", "h2"]).select("doc_id", "th", "n", "c", "g")
        .unionByName(rows.where("n = 0").select("doc_id", "th", "n", empty.alias("c"), empty.alias("g")))
    )
    discard(scan, classes, lists, links, found, of)
    shared.destroy()
    return out


def join(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text; others are left unread).

    Words are runs of other characters than ASCII white space, A-Z folded. Documents link when
    100 * intersection >= percent * union of their sets of distinct word n-grams; component_id is the
    smallest doc_id that links reach. A null text, or one without words, has an empty set and links with
    nothing. Equal rows are returned one by one and are linked; rows of one doc_id with other texts are
    documents of their own and are not linked by it. A row without doc_id has its component's smallest
    doc_id, or null; it links as others do. N-grams and sets are told apart by 64-bit and 128-bit hashes.
    """
    rows = grouped(docs, words, percent)
    # written, so that a large group's rows can be split where they meet their name; empty sets don't meet at all
    smallest = written(rows.where("g is not null").groupBy("g").agg(F.min("doc_id").alias("component_id")))
    size = F.col("n").cast("long").alias("n_shingles")
    named = rows.where("g is not null").join(smallest, "g").select("doc_id", size, "component_id")
    return named.unionByName(rows.where("g is null").select("doc_id", size, F.col("doc_id").alias("component_id")))
