"""Nearest neighbours by inner product: probed lists, scanned dimension by dimension."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskline.llm.common import bounded_sample, discard, written
from maskline.llm.vectors import matrix, sizes, usable

#: Rows that the lists are fitted on at most, of them those that give each query its first bound; lists; rows
#: and queries of a cell of work, on average.
SAMPLE, FIRST, MOST_LISTS, CELL_ROWS, CELL_QUERIES = 32768, 8192, 8192, 4096, 512
#: Columns between two tests, the tests' strictness, and the sample's recall that fixes the probes.
COLUMNS, EPSILON, RECALL, SEED = 16, 3.0, 0.95, 3
#: Share of candidates from which on the rest are followed one by one.
FEW = 0.1


class Lists:
    """Centroids and a random rotation for vectors of one length.

    Largest inner product is least distance once each vector has a component more, sqrt(longest^2 -
    |x|^2), and each query a 0. How many lists a query probes is measured: the fewest with which the
    sample's own queries find RECALL of their k nearest of the sample.
    """

    def __init__(self, ids: np.ndarray, sample: np.ndarray, rows: int, longest: float, k: int):
        rng = np.random.default_rng(SEED)
        self.longest, self.k = longest, k
        some = rng.permutation(len(sample))[:FIRST]
        self.first_id, self.first = ids[some], sample[some]
        d = sample.shape[1] + 1
        self.rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
        x = self.lift(sample)
        n = max(1, min(MOST_LISTS, int(np.sqrt(rows) / 2), len(x) // 4))
        self.centroids = x[rng.permutation(len(x))[:n]].copy()
        for _ in range(8):
            of = self.own(x)
            count = np.bincount(of, minlength=n)
            total = np.zeros_like(self.centroids)
            np.add.at(total, of, x)
            self.centroids[count > 0] = total[count > 0] / count[count > 0, None]
        of = self.own(x)
        at = rng.permutation(len(x))[:256]
        score = sample[at] @ sample.T
        score[np.arange(len(at)), at] = -np.inf
        top = np.argsort(-score, axis=1, kind="stable")[:, : min(k, max(1, len(x) - 1))]
        place = np.argsort(self.nearest(self.lift(sample[at], True), n), axis=1)
        need = np.sort(np.take_along_axis(place, of[top], axis=1).ravel())
        self.probes = int(need[min(len(need) - 1, int(np.ceil(RECALL * len(need))) - 1)]) + 1 if len(need) else n

    def lift(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """The vectors with their component more, rotated."""
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.longest**2 - np.einsum("ij,ij->i", x, x)))
        return np.column_stack([x, more]) @ self.rotation

    def _far(self, x: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", self.centroids, self.centroids) - 2 * x @ self.centroids.T

    def own(self, x: np.ndarray) -> np.ndarray:
        """Number of each vector's nearest centroid: its list."""
        return np.concatenate([np.zeros(0, np.int64), *(self._far(x[lo : lo + 1024]).argmin(1) for lo in range(0, len(x), 1024))])

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """Numbers of the n nearest centroids, nearest first."""
        return np.argsort(self._far(x), axis=1, kind="stable")[:, :n]

    def begin(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, score) of the k + 1 best of FIRST rows for each query: found already, whatever lists are probed."""
        rough = q @ self.first.T
        n = min(self.k + 1, rough.shape[1])
        at = np.argpartition(-rough, n - 1, axis=1)[:, :n]
        score = dot(np.repeat(q, n, axis=0), self.first[at.ravel()]).reshape(at.shape)
        return self.first_id[at], score


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up component by component: equal vectors give equal numbers."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def scan(lists: Lists, q_id: np.ndarray, q: np.ndarray, least: np.ndarray, x_id: np.ndarray, x_vec: np.ndarray, x: np.ndarray, k: int, step: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row number, score) of each query's k nearest of the rows, of those that score least or more.

    After each block of columns, D / d of the squared distance over the first d of D rotated columns
    estimates the whole; a candidate is abandoned when that exceeds the k-th best found so far by more
    than EPSILON standard errors. Blocks are products of matrices until few candidates are left, which are
    then followed one by one. What is left in the end is scored exactly, ties to the smaller x_vec. Ids are
    those of rows: only a query's own row is left out.
    """
    if not len(q) or not len(x):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    Q, X = lists.lift(q, True), lists.lift(x)
    D = X.shape[1]
    fixed = lists.longest**2 + np.einsum("ij,ij->i", q, q)
    best = np.maximum(fixed - 2 * least, 0)  # squared distance of the k-th best
    held = [np.zeros(0, int), np.zeros(0, int), np.zeros(0)]
    order = np.lexsort((x_id, x_vec))
    for lo in range(0, len(x), step):
        rows = order[lo : lo + step]
        part = np.zeros((len(q), len(rows)))
        i = j = None
        for a in range(0, D, COLUMNS):
            b = min(D, a + COLUMNS)
            limit = best * (1 + EPSILON / np.sqrt(b)) ** 2 * (b / D) if b < D else best
            limit = limit + 1e-9 * (1 + limit)
            qa, xa = Q[:, a:b], X[rows, a:b]
            if i is None:
                part += np.einsum("ij,ij->i", qa, qa)[:, None] + np.einsum("ij,ij->i", xa, xa)[None, :] - 2 * qa @ xa.T
                keep = part <= limit[:, None]
                if b == D or keep.mean() < FEW:
                    i, j = np.nonzero(keep)
                    part = part[i, j]
            else:
                gap = qa[i] - xa[j]
                part = part + np.einsum("ij,ij->i", gap, gap)
                keep = part <= limit[i]
                i, j, part = i[keep], j[keep], part[keep]
            if i is not None and not len(i):
                break
        other = q_id[i] != x_id[rows[j]]
        i, j = i[other], j[other]
        if not len(i):
            continue
        held = [np.concatenate(p) for p in zip(held, (i, rows[j], dot(q[i], x[rows[j]])), strict=True)]
        by = np.lexsort((x_id[held[1]], x_vec[held[1]], -held[2], held[0]))
        held = [h[by] for h in held]
        start = np.flatnonzero(np.diff(held[0], prepend=-1))
        rank = np.arange(len(by)) - np.repeat(start, np.diff(np.append(start, len(by))))
        last = np.flatnonzero(rank == k - 1)
        best[held[0][last]] = np.minimum(best[held[0][last]], np.maximum(fixed[held[0][last]] - 2 * held[2][last], 0))
        held = [h[rank < k] for h in held]
    return tuple(held)


def search(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for each query.

    vectors has vec_id and embedding; a query's own row is no candidate of its own. Nearest first, ties to
    the smaller vec_id; fewer than k only where there are fewer candidates. Null, zero and non-finite
    vectors, null components and null vec_ids take no part; vectors meet only those of their own length.
    Repeated vec_ids are candidates each, and as queries they have a list each, under the same query_id.
    Other columns are left unread; no rows give none.

    Lists are fitted on at most SAMPLE rows; every row is in one. FIRST of these rows are held against each
    query at once, which gives its first bound and fills its list where the probed lists hold too few. A
    list is cut into cells of about CELL_ROWS rows by CELL_QUERIES queries by hashes, so a list of a third
    of all rows is as many cells.
    """
    spark = vectors.sparkSession
    ok = vectors.where(usable("embedding") & F.col("vec_id").isNotNull())
    ok = ok.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    out = None
    for d in sizes(ok, "v"):
        found = _search(ok.where(F.size("v") == d), k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return out


def _search(rows: DataFrame, k: int) -> DataFrame:
    spark = rows.sparkSession
    rows = written(rows.withColumn("r", F.monotonically_increasing_id()))  # once written, a row's number stays
    about = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("longest")).first()
    chosen = bounded_sample(rows, F.lit(0), F.lit(1), SAMPLE, ["vec_id", "v"]).select("vec_id", "r", "v").toArrow()
    chosen = (chosen if chosen.num_rows else rows.select("vec_id", "r", "v").limit(1).toArrow()).sort_by([("vec_id", "ascending"), ("r", "ascending")])
    lists = Lists(np.column_stack([chosen.column(x).to_numpy() for x in ("r", "vec_id")]), matrix(chosen.column("v")), about["n"], float(np.sqrt(about["longest"])), k)
    del chosen
    shared = spark.sparkContext.broadcast(lists)  # at most MOST_LISTS centroids and FIRST rows

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            of = shared.value.own(shared.value.lift(matrix(batch.column("v")))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of)], names=["r", "vec_id", "v", "q", "list"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                v, own = matrix(part.column("v")), part.column("r").to_numpy()
                of = shared.value.nearest(shared.value.lift(v, True), shared.value.probes).astype(np.int32)
                ids, score = shared.value.begin(v)
                other = ids[:, :, 0] != own[:, None]
                order = np.lexsort((ids[:, :, 1], np.where(other, -score, np.inf)), axis=1)[:, :k]
                ids, score, other = np.take_along_axis(ids, order[:, :, None], 1), np.take_along_axis(score, order, 1), np.take_along_axis(other, order, 1)
                least = np.where(other.sum(1) == k, score[:, -1], -np.inf)  # the k-th best of these
                to = pa.ListArray.from_arrays(pa.array(np.arange(len(of) + 1) * of.shape[1], pa.int32()), pa.array(of.ravel()))
                ends = pa.array(np.append(0, np.cumsum(other.sum(1))), pa.int32())
                firsts = [pa.ListArray.from_arrays(ends, pa.array(x[other])) for x in (ids[:, :, 0], ids[:, :, 1], score)]
                yield pa.RecordBatch.from_arrays([part.column("r"), part.column("vec_id"), part.column("v"), to, pa.array(least), *firsts], names=["r", "vec_id", "v", "lists", "least", "first_r", "first_id", "first_score"])

    held = written(rows.select("r", "vec_id", "v", "q").mapInArrow(assign, "r long, vec_id long, v array<double>, q boolean, list int"))
    asked = written(held.where("q").select("r", "vec_id", "v").mapInArrow(probe, "r long, vec_id long, v array<double>, lists array<int>, least double, first_r array<long>, first_id array<long>, first_score array<double>"))
    size = held.groupBy("list").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("cuts"))
    busy = asked.select(F.explode("lists").alias("list")).groupBy("list").agg(F.ceil(F.count("*") / CELL_QUERIES).cast("int").alias("turns"))
    cells = written(size.join(busy, "list"))  # a row for each list, at most MOST_LISTS
    some = F.abs(F.xxhash64("r", F.lit(17)) % 1_000_003)
    none = F.lit(None).cast("double").alias("least")
    left = held.join(F.broadcast(cells), "list").select("list", (some % F.col("cuts")).alias("cut"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns").cast("long") - 1)).alias("turn"), "r", "vec_id", "v", none)
    right = asked.select("r", "vec_id", "v", "least", F.explode("lists").alias("list")).join(F.broadcast(cells), "list").select("list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts").cast("long") - 1)).alias("cut"), (some % F.col("turns")).alias("turn"), "r", "vec_id", "v", "least")

    def meet(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        least = table.column("least")
        asks = least.is_valid().to_numpy(zero_copy_only=False)
        r, ids, v = table.column("r").to_numpy(), table.column("vec_id").to_numpy(), matrix(table.column("v"))
        q, x = np.flatnonzero(asks), np.flatnonzero(~asks)
        i, j, score = scan(shared.value, r[q], v[q], least.to_numpy()[q], r[x], ids[x], v[x], k)
        return pa.table({"qr": r[q][i], "query_id": ids[q][i], "r": r[x][j], "vec_id": ids[x][j], "score": score})

    met = left.unionByName(right).groupBy("list", "cut", "turn").applyInArrow(meet, "qr long, query_id long, r long, vec_id long, score double")
    firsts = asked.select(F.col("r").alias("qr"), F.col("vec_id").alias("query_id"), F.explode(F.arrays_zip("first_r", "first_id", "first_score")).alias("f"))
    firsts = firsts.select("qr", "query_id", F.col("f.first_r").alias("r"), F.col("f.first_id").alias("vec_id"), F.col("f.first_score").alias("score"))
    best = Window.partitionBy("qr").orderBy(F.col("score").desc(), "vec_id", "r")
    both = met.unionByName(firsts).groupBy("qr", "query_id", "r", "vec_id").agg(F.max("score").alias("score"))
    out = written(both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    discard(rows, held, asked, cells)
    shared.destroy()
    return out
