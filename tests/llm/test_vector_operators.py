"""Near-duplicate vectors and neighbour search against brute force."""

import numpy as np
from pyspark.sql import functions as F

from maskline.llm import ann, neardup

SCHEMA = "vec_id long, embedding array<float>, label int"


def sample(seed, n, d=24):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, d)).astype(np.float32)
    for i in range(0, n, 5):  # near copies, in chains
        x[i] = x[i - 1] + 0.2 * r.standard_normal(d)
    x[3] = x[9]
    x[10:14] = x[20]
    label = r.integers(0, 3, n)
    label[0::5] = np.roll(label, 1)[0::5]
    label[10:14] = label[20]
    rows = [(i, [float(v) for v in x[i]], int(label[i])) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [0.0] * d, 1), (n + 2, [float("nan")] * d, 1), (n + 3, rows[4][1], None), (n + 4, [None] + [1.0] * (d - 1), 1), (n + 5, [1.0, 2.0], 1), (n + 6, [], 1)]
    return rows


def brute_links(rows, t):
    ok = {i: (np.array(v, float), y) for i, v, y in rows if v and y is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    n, root = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(ok)
    for a in keys:
        for b in keys:
            (x, p), (y, q) = ok[a], ok[b]
            if a < b and p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= t:
                n[a] += 1
                n[b] += 1
                i, j = find(a), find(b)
                root[max(i, j)] = min(i, j)
    return {i: (n[i], find(i)) for i in n}


def test_links(spark):
    rows = sample(1, 200)
    d = spark.createDataFrame(rows, SCHEMA).withColumn("kept", F.lit("x"))
    want = brute_links(rows, 0.93)
    got = {r.vec_id: (r.n_links, r.component_id) for r in neardup.link(d).collect()}
    assert got == want and sum(n for n, _ in want.values()) > 50
    assert neardup.link(d.where("false")).count() == 0


def test_windows_find_the_groups_and_cells_count_them(spark):
    rows = sample(2, 160)
    want = brute_links(rows, 0.93)
    got = {r.vec_id: (r.n_links, r.component_id) for r in neardup.link(spark.createDataFrame(rows, SCHEMA), passes=24, block=16, window=8).collect()}
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.98 * sum(n for n, _ in want.values())


def test_passes_of_a_large_label_find_its_pairs(spark):
    r = np.random.default_rng(6)
    n, d = 8000, 64
    x = r.standard_normal((n, d))
    x /= np.sqrt((x * x).sum(1))[:, None]
    off = r.standard_normal((n // 2, d))
    off -= (off * x[0::2]).sum(1)[:, None] * x[0::2]
    off /= np.sqrt((off * off).sum(1))[:, None]
    x[1::2] = 0.935 * x[0::2] + np.sqrt(1 - 0.935**2) * off  # pairs right above the threshold
    assert neardup.passes_for(n, 0.93) < neardup.passes_for(100 * n, 0.93) < 60
    got = neardup.link(spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")).toPandas().set_index("vec_id").sort_index()
    assert (got.n_links == 1).mean() >= 0.99 and got.n_links.max() == 1
    linked = got[got.n_links == 1]
    assert (linked.component_id == linked.index // 2 * 2).all()


def test_search(spark):
    rows = sample(3, 400)
    d = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit(1))
    ok = {i: np.array(v, float) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and np.any(v) and len(v) == 24}
    got = {}
    for r in ann.search(d, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        assert abs(r.score - ok[r.query_id] @ ok[r.vec_id]) < 1e-9
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in (i for i in ok if i % 20 == 0):
        near = sorted((i for i in ok if i != q), key=lambda i: (-ann.dot(ok[q][None], ok[i][None])[0], i))[:20]
        assert [x[0] for x in got[q]] == list(range(1, 21))
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(got[q], got[q][1:]))
        hits += len({x[1] for x in got[q]} & set(near))
    assert hits >= 0.9 * 20 * len(got)
    assert ann.search(d.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(d.where("vec_id < 3"), F.col("vec_id") % 20 == 0).count() == 2


def test_large_group_of_near_copies(spark):
    r = np.random.default_rng(4)
    n, d = 5000, 64
    x = r.standard_normal(d) + 1e-4 * r.standard_normal((n, d))  # the worst for signs: all agree
    rows = [(i, v, 1) for i, v in enumerate(x.tolist())] + [(n + i, v, 1) for i, v in enumerate(r.standard_normal((500, d)).tolist())]
    got = neardup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).toPandas().set_index("vec_id").sort_index()
    assert (got.n_links[:n] == n - 1).all() and (got.component_id[:n] == 0).all()
    assert (got.n_links[n:] == 0).all() and got.kept.sum() == 501
