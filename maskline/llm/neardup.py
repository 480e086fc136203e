"""Near-duplicate vectors: sorted projection passes find the groups, exact cells count inside them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskline.llm.common import components, discard, local_components, written
from maskline.llm.vectors import matrix, usable

#: Rows of the order that each row is compared with at least, before it; bits of a key; the chance that a
#: pair right at the threshold is met in some pass; seed of the hyperplanes.
WINDOW, BITS, TARGET, SEED = 512, 48, 0.999, 5
#: Vectors of a part of a large group at most (about), and their components in all; members of small groups in one cell.
BLOCK, ROOM, CELL = 4096, 1 << 21, 256
#: Rows of a product made at once.
STEP = 256


def hits(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of x and y, unit vectors, have a cosine of at least threshold."""
    s = x @ y.T
    i, j = np.nonzero(np.abs(s - threshold) < 1e-9)  # sums of another order could fall on the other side
    s[i, j] = np.where(np.einsum("ij,ij->i", x[i], y[j]) >= threshold, threshold, -2)
    return s >= threshold


def joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots after the links (i, j)."""
    u, v = root[i], root[j]
    new = u != v
    if not new.any():
        return root
    u, v = np.divmod(np.unique(u[new] * len(root) + v[new]), len(root))
    return local_components(len(root), u, v)[root]


def compared(x: np.ndarray, y: np.ndarray, m: np.ndarray, k: np.ndarray, threshold: float, groups: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links of each row of x, of each row of y, component of each of x and y) for unit rows x and y of
    multiplicities m and k; where y is x, each pair counts once. Components are numbers of rows, y after x.
    groups: the group of each row of x and of y; only rows of one group link.
    """
    same, n = y is x, len(x)
    of_x, of_y = np.zeros(n), np.zeros(len(y))
    root = np.arange(n if same else n + len(y))
    for lo in range(0, n, STEP):
        hit = hits(x[lo : lo + STEP], y, threshold)
        if same:
            hit &= np.arange(n)[None] > np.arange(lo, lo + len(hit))[:, None]
        if groups is not None:
            hit &= groups[0][lo : lo + STEP, None] == groups[1][None]
        if not hit.any():
            continue
        of_x[lo : lo + STEP] += hit @ k
        of_y += m[lo : lo + STEP] @ hit
        i, j = np.nonzero(hit)
        root = joined(root, lo + i, j if same else n + j)
    return of_x, of_y, root


def passes_for(rows: int, threshold: float, window: int = WINDOW, target: float = TARGET) -> int:
    """Passes after which a pair at the threshold was met within the window with the chance target.

    Two vectors agree in a bit with the probability 1 - angle / pi, and lie within the window if they agree
    in as many leading bits as halve rows down to it.
    """
    if rows <= window:
        return 1
    meet = (1 - np.arccos(threshold) / np.pi) ** np.log2(rows / window)
    return max(3, int(np.ceil(np.log(1 - target) / np.log(1 - meet))))


def _keys(some: DataFrame, passes: int) -> DataFrame:
    """some (c, label, d, v) once for each pass: (label, d, pass, key, c, v); a key is the signs of BITS random projections."""
    schema = some.select("label", "d", "c", "v", F.array(F.lit(0).cast("long")).alias("keys")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weight = 1 << np.arange(BITS, dtype=np.int64)[::-1]
        for batch in batches:
            size = batch.column("d").to_numpy()
            for d in np.unique(size).tolist():
                part = batch.filter(pa.array(size == d))
                if d not in planes:
                    planes[d] = np.random.default_rng((SEED, d)).standard_normal((d, passes * BITS))
                x = matrix(part.column("v"))
                keys = np.concatenate([((x[lo : lo + 1024] @ planes[d]) > 0).reshape(-1, passes, BITS) @ weight for lo in range(0, len(x), 1024)])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * passes, pa.int32()), pa.array(keys.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in ("label", "d", "c", "v")), lists], names=schema.names)

    keyed = some.select("label", "d", "c", "v").mapInArrow(run, schema)
    return keyed.select("label", "d", "c", "v", F.posexplode("keys").alias("pass", "key"))


def _passes(some: DataFrame, passes: int, threshold: float, window: int) -> DataFrame:
    """(a, b): links of classes that meet in a window of some pass; of a window, one for each class that links.

    Each pass is an order of all vectors of a label by key, equal keys by a hash that depends on the pass.
    Ranges of all orders are the tasks, so no key or label is ever one task's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, c, x = None, np.zeros(0, np.int64), np.zeros((0, 0))
        for batch in batches:
            if not batch.num_rows:
                continue
            place = list(zip(batch.column("label").to_pylist(), batch.column("d").to_pylist(), batch.column("pass").to_pylist(), strict=True))
            cuts = [0, *(i for i in range(1, len(place)) if place[i] != place[i - 1]), len(place)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if place[lo] != at:
                    at, c, x = place[lo], np.zeros(0, np.int64), np.zeros((0, place[lo][1]))
                for a in range(lo, hi, window):
                    part = batch.slice(a, min(window, hi - a))
                    new = matrix(part.column("v"))
                    new /= np.sqrt(np.einsum("ij,ij->i", new, new))[:, None]
                    c, x = np.concatenate([c, part.column("c").to_numpy()]), np.concatenate([x, new])
                    i, j = np.nonzero(hits(new, x, threshold))
                    i += len(x) - len(new)
                    root = joined(np.arange(len(x)), i[j < i], j[j < i])
                    linked = np.flatnonzero(root != np.arange(len(x)))
                    if len(linked):
                        yield pa.RecordBatch.from_arrays([pa.array(c[linked]), pa.array(c[root[linked]])], names=["a", "b"])
                    c, x = c[-window:], x[-window:]

    order = ["label", "d", "pass", "key", "tie"]
    keyed = _keys(some, passes).withColumn("tie", F.xxhash64("c", "pass"))
    parts = int(some.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("label", "d", "pass", "c", "v").mapInArrow(run, "a long, b long").distinct()


def _counted(dealt: DataFrame, threshold: float) -> DataFrame:
    """(c, n, root) of the classes that link, for dealt (c, m, label, d, v, g, cell, parts): all pairs of one group g that share a cell.

    Cells of several parts are compared two parts at a time, so every pair is, once, whatever the size of a group.
    """
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("c", F.lit(2)), F.col("parts")).cast("int"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.select("c", "m", "label", "d", "v", "g", "cell", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("part", "ascending"), ("c", "ascending")])
        c, m, part, g = (table.column(x).to_numpy() for x in ("c", "m", "part", "g"))
        x = matrix(table.column("v"))
        x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        if low == high:
            a, b, root = compared(x, x, m, m, threshold, (g, g))
            n = a + b
        else:
            cut = int(np.searchsorted(part, high))
            a, b, root = compared(x[:cut], x[cut:], m[:cut], m[cut:], threshold, (g[:cut], g[cut:]))
            n = np.concatenate([a, b])
        linked = np.flatnonzero(n)
        return pa.table({"c": c[linked], "n": n[linked].astype(np.int64), "root": c[root[linked]]})

    return cells.groupBy("label", "d", "cell", "low", "high").applyInArrow(compare, "c long, n long, root long")


def link(vectors: DataFrame, threshold: float = 0.93, passes: int | None = None, block: int = BLOCK, window: int = WINDOW) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label).

    Vectors of one label link at a cosine of at least threshold, in double precision. A null label and
    a null, zero or non-finite vector, or one with a null component, link with nothing; nor do vectors
    of different lengths. Equal vectors of a label are one class that is compared once and whose rows
    all link. n_links counts the other rows linked; component_id is the smallest vec_id reachable.
    Repeated vec_ids are rows of their own. Further columns are left unread; no rows give none.

    Vectors are ordered by concatenated signs of random projections, anew in each pass, and each is
    compared with at least window vectors before it; verified pairs unite groups across passes. As many
    passes are made as the largest label needs (passes_for), unless passes says how many. A group may be
    larger than any window, so its links are then counted exactly: all pairs of a group meet in cells of
    about block vectors. A label of at most window vectors is one group from the start. No table of pairs
    is made: a window or cell gives one link, and a cell one count, for each member that has links.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"),
        (usable("embedding") & F.col("label").isNotNull()).alias("ok"),
    ).withColumns({"h1": F.when(F.col("ok"), F.xxhash64("v")), "h2": F.when(F.col("ok"), F.xxhash64(F.lit(1), "v"))})
    key = ["label", "h1", "h2"]
    classes = rows.where("ok").groupBy(*key).agg(F.min("vec_id").alias("id"), F.count("*").alias("m"))
    classes = written(classes.withColumn("c", F.xxhash64(*key)))
    some = rows.where("ok").withColumn("c", F.xxhash64(*key)).groupBy("c").agg(F.first("label").alias("label"), F.first("v").alias("v"))
    some = some.join(classes.select("c", "m"), "c").withColumn("d", F.size("v"))
    sizes = some.groupBy("label", "d").agg(F.count("*").alias("rows"))
    some = written(some.join(sizes, ["label", "d"]))
    most = some.agg(F.max("rows")).first()[0] or 0
    one = F.lit(1)
    small = some.where(F.col("rows") <= window).withColumns({"g": F.lit(0).cast("long"), "cell": F.lit(0).cast("long"), "parts": one})
    counted = written(_counted(small, threshold))
    links = counted.select(F.col("c").alias("a"), F.col("root").alias("b"))
    large = some.where(F.col("rows") > window)
    if most > window:
        links = links.unionByName(written(_passes(large, passes or passes_for(most, threshold, window), threshold, window)))
    reach = components(links)
    if most > window:
        size = reach.groupBy("component").agg(F.count("*").alias("s"))
        cells = F.greatest(one, F.ceil(F.lit(reach.count() / CELL))).cast("long")
        of = large.join(reach.join(size, "component").select(F.col("node").alias("c"), F.col("component").alias("g"), "s"), "c")
        room = F.least(F.lit(block), F.greatest(one, F.floor(F.lit(ROOM) / F.col("d"))))
        alone = F.col("s") > CELL
        of = of.withColumns({"cell": F.when(alone, F.col("g")).otherwise(F.pmod(F.xxhash64("g"), cells)), "parts": F.when(alone, F.ceil(F.col("s") / room)).otherwise(one).cast("int")})
        counted = counted.unionByName(written(_counted(of, threshold)))
    counts = counted.groupBy("c").agg(F.sum("n").alias("n"))
    named = classes.join(reach, classes["c"] == reach["node"], "left").select("c", *key, "id", "m", F.coalesce("component", "c").alias("g"))
    smallest = named.groupBy("g").agg(F.min("id").alias("component_id"))
    of = named.join(smallest, "g").join(counts, "c", "left").select(*key, "component_id", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    of = written(of)
    linked = rows.where("ok").select("vec_id", *key).join(of, key).select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))  # they meet nothing
    out = written(linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
    discard(some, classes, counted, links, reach, of)
    return out
