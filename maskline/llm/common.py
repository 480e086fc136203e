"""What the operators of this subpackage share: tables, scratch folders, sampling, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Levels of the geometric sampler; a row is on level k with probability 2**-(k+1).
LEVELS = 48
#: Bytes of a batch of rows for Python.
BATCH = 8 << 20
#: Links that a task contracts at a time, and that one of a later round has on average.
ROOM, ROWS = 1 << 20, 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def light_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of at most BATCH bytes from here on: 10,000 long texts at once would fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def scratch(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share.

    It is the cluster's spark.checkpoint.dir; only where that is unset (tests, local mode) a local
    temporary folder is set and used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="maskline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/maskline-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes tables that written() made and nothing reads any more.

    The JVM is then asked to collect garbage, so the shuffle files of finished jobs go with them.
    """
    _remove(*tables)
    if tables:
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def _remove(*tables: DataFrame) -> None:
    for df in tables:
        spark = df.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def crc_mod(key: str | Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; null keys count as an empty text."""
    text = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % n


def level(*keys: str) -> Column:
    """Number of trailing zero bits of a hash of keys: rows with level >= k are a 2**-k sample."""
    h = F.xxhash64(*keys, F.lit(7919))
    bits = F.length(F.regexp_extract(F.conv(F.hex(h), 16, 2), "(0*)$", 1))
    return F.least(F.when(h == 0, F.lit(LEVELS - 1)).otherwise(bits), F.lit(LEVELS - 1)).cast("int")


def bounded_sample(df: DataFrame, group: Column | str, weight: Column, bound: int, keys: list[str]) -> DataFrame:
    """Rows of df such that weight sums to at most bound in each group, by a hash of keys.

    The choice is deterministic and depends on the whole table: one small aggregation counts weight
    by (group, level); each group then keeps the lowest level whose rows all fit. Where not even the
    highest level fits (many rows of one key), as many of its rows as fit are taken in the order of their
    hash, one at least. Groups are few (classes, languages); what comes to the driver is at most LEVELS
    rows for each.
    """
    group = F.col(group) if isinstance(group, str) else group
    rows = df.select(group.alias("g"), level(*keys).alias("k"), weight.alias("w")).groupBy("g", "k").agg(F.sum("w").alias("w"), F.max("w").alias("most")).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r.g, {})[r.k] = (r.w or 0, r.most or 0)
    keep, parts = F.lit(False), []
    for g, ks in sorted(by.items(), key=lambda x: str(x[0])):
        total, low = 0, LEVELS
        for k in sorted(ks, reverse=True):
            if total + ks[k][0] > bound:
                break
            total, low = total + ks[k][0], k
        if low == LEVELS:
            top = max(ks)
            own = df.filter(group.eqNullSafe(F.lit(g)) & (level(*keys) == top))
            parts.append(own.orderBy(F.xxhash64(*keys)).limit(max(1, bound // max(ks[top][1], 1))))
        else:
            keep = keep | (group.eqNullSafe(F.lit(g)) & (level(*keys) >= low))
    return reduce(lambda x, y: x.unionByName(y), parts, df.filter(keep))


def sliced(df: DataFrame, most: int) -> DataFrame:
    """df with its texts cut into slices of at most most characters, numbered from null (the first), 1 on.

    Hashes leave nulls out, so a text of one slice is sampled as it is without numbers.
    """
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / most)).cast("int")
    cut = df.withColumn("slice", F.explode(F.sequence(F.lit(0), n - 1)))
    text = F.when(F.length("text") <= most, F.col("text")).otherwise(F.substring("text", F.col("slice") * most + 1, F.lit(most)))
    return cut.withColumn("text", text).withColumn("slice", F.when(F.col("slice") > 0, F.col("slice")))


def _contracted(links: DataFrame) -> DataFrame:
    """(u, v), v < u: of each task's links a forest that joins the same nodes, one link a node; ROOM links at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def forest() -> pa.RecordBatch:
            pair = np.concatenate(held, axis=1) if held else np.zeros((2, 0), np.int64)
            nodes, at = np.unique(pair, return_inverse=True)
            at = at.reshape(2, -1)
            root = local_components(len(nodes), at[0], at[1])
            some = np.flatnonzero(root != np.arange(len(nodes)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(nodes[some], pa.int64()), pa.array(nodes[root[some]], pa.int64())], names=["u", "v"])

        for batch in batches:
            held.append(np.stack([c.to_numpy() for c in batch.columns]))
            if sum(x.shape[1] for x in held) >= ROOM:
                yield forest()
        yield forest()

    return links.where("a is not null and b is not null").select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(run, "u long, v long")


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(a, b) links to (node, component): the smallest node that links reach, for nodes with links.

    Each task's links are first contracted by themselves. Then large-star and small-star rounds alternate;
    each round ends in a written table, and the rounds are logarithmic in the longest chain; an error is
    raised should they not end. Only counts come to the driver. A node with many links may be the centre of a
    star: the least neighbour of each node is written before the links meet it, so that join's hot
    partitions can be split.
    """
    e = written(_contracted(edges).distinct())
    parts = 1 + e.count() // ROWS
    few = lambda df: df.coalesce(parts)  # noqa: E731  tasks by the number of links, not of shuffle partitions
    for _ in range(max_rounds):
        node = e.select("u", F.lit(1).alias("above"), F.lit(0).alias("below")).unionByName(e.select(F.col("v").alias("u"), F.lit(0).alias("above"), F.lit(1).alias("below")))
        if few(node.groupBy("u").agg(F.sum("above").alias("above"), F.max("below").alias("below")).where("above > 1 or above = 1 and below = 1")).isEmpty():
            break  # stars: each node but the roots has one link, to a root
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(few(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        made = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        made = written(few(made.where("u > v").distinct()))
        _remove(low, e)
        e = made
    else:
        raise RuntimeError(f"links are not settled after {max_rounds} rounds")
    roots = e.select("v").distinct()
    found = written(few(e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("component")))))
    _remove(e)
    return found


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links (a, b): the smallest node of each one's component."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        m = np.minimum(ra, rb)
        new = root.copy()
        np.minimum.at(new, ra, m)
        np.minimum.at(new, rb, m)
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    while (root[root] != root).any():
        root = root[root]
    return root


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, columns, F.lit(False))
