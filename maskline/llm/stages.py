"""Operators as stages over a table of documents: rows are judged, dropped or packed; columns stay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskline.llm import jaccard, langid, packing, toxicity
from maskline.llm.common import discard, light_batches, table, written

#: A document goes as of no known language where even the best model needs more bits for a byte than a
#: byte has.
MOST_BITS = 8.0


def _aside(docs: DataFrame, taken: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(docs with columns that have a taken name renamed, what gives a table of its rows their columns back)."""
    names = docs.columns
    free = [f"{c} {i} of docs" if c.lower() in taken else c for i, c in enumerate(names)]
    return docs.toDF(*free), lambda rows: rows.select(*(F.col(f"`{x}`").alias(c) for x, c in zip(free, names, strict=True)))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those the operator predicts as toxic; the model is learned from all labels.

    Null and empty texts stay if the model's bias says so; without labels it is a constant near 0 and all stay.
    Each of equal rows is judged alike. An empty table gives no rows; columns of any name stay as they are.
    """
    light_batches(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    rows, back = _aside(docs, ("score", "predicted"))
    return back(toxicity.score(rows, toxicity.learn(docs, labels)).where("predicted = 0"))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that have no letter (null and empty texts too) or that no learned language explains.

    Without a known language in the table nothing can be explained and no row stays. Each of equal rows is
    judged alike. An empty table gives no rows; columns of any name stay as they are.
    """
    light_batches(spark)
    rows, back = _aside(docs, ("lang_pred", "score", "bits_per_byte", "_letter"))
    judged = langid.predict(rows, langid.learn(docs))
    return back(judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("bits_per_byte") <= MOST_BITS)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each group that near-copies link: that of the smallest (doc_id, hash of the text).

    Rows without doc_id come after all others. Of equal rows one stays, and of rows of one doc_id with other
    texts each group's. Empty texts are no one's copies and all stay. An empty table gives no rows; columns stay
    as they are, and none of their names is in the way.
    """
    light_batches(spark)
    rows = jaccard.grouped(docs.select("doc_id", "text"))
    who = rows.where("g is not null").groupBy("g", "doc_id", "th").agg(F.count("*").alias("copies"))
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "th")
    stay = written(who.groupBy("g").agg(F.count("*").alias("rows"), F.min(F.struct(place.alias("at"), "copies")).alias("r")))
    some = written(who.join(stay.where("rows > 1 or r.copies > 1").select("g", "r"), "g"))
    name = lambda d, t: F.xxhash64(F.coalesce(d.cast("string"), F.lit("")), d.isNull(), t)
    first = place == F.col("r.at")
    judged = written(some.groupBy(name(F.col("doc_id"), F.col("th")).alias("_name")).agg(F.bool_and(~F.coalesce(first, F.lit(False))).alias("_out")).withColumn("_met", F.lit(True)))
    discard(rows, stay, some)
    judged = F.broadcast(judged) if judged.count() <= jaccard.BROADCAST else judged  # else documents move to their names
    kept, back = _aside(docs, ("_name", "_out", "_met"))
    known = kept.withColumn("_name", name(F.col("doc_id").cast("long"), F.xxhash64("text"))).join(judged, "_name", "left").where("_out is null or not _out")
    # of a group's first rows, which are alike but for further columns, one
    return back(known.where("_met is null")).unionByName(back(known.where("_met").dropDuplicates(["_name"])))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of docs' token sequences."""
    light_batches(spark)
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
