"""Precision, recall and F1 of entity predictions over thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskline.functions.text import SPACE, strip

# The thresholds that are tried.
THRESHOLDS = (0.0, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def normalize_entity(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(value), f"{SPACE}+", " "), r"[.,;:!?]+\z", "")


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def with_metrics(counts: DataFrame) -> DataFrame:
    """counts (tp, fp, fn) with precision, recall and f1; 0 where a denominator is."""
    d = counts.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return d.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def compare(expected: DataFrame, predicted: DataFrame, thresholds: Sequence[float] = THRESHOLDS, sample: str = "sample_id") -> DataFrame:
    """(threshold, sample, type, value, expected, predicted): the sets of entities of each sample joined.

    Predictions are made once; a set's member is predicted from every threshold up to its best score.
    """
    steps = F.array(*(F.lit(float(t)) for t in thresholds))
    key = [sample, "type", "value"]
    gold = expected.select(sample, "type", normalize_entity(F.col("value")).alias("value")).distinct()
    best = predicted.select(sample, "type", normalize_entity(F.col("value")).alias("value"), "confidence").groupBy(*key).agg(F.max("confidence").alias("best"))
    both = gold.withColumn("e", F.lit(True)).join(best, key, "full")
    at = both.withColumn("threshold", F.explode(steps))
    hit = F.coalesce(F.col("best") >= F.col("threshold"), F.lit(False))
    return at.select("threshold", *key, F.coalesce("e", F.lit(False)).alias("expected"), hit.alias("predicted")).where("expected or predicted")


def _count(df: DataFrame, by: Sequence[str]) -> DataFrame:
    e, p = F.col("expected"), F.col("predicted")
    return with_metrics(df.groupBy(*by).agg(F.count_if(e & p).alias("tp"), F.count_if(~e & p).alias("fp"), F.count_if(e & ~p).alias("fn")))


def sweep(compared: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """A row of counts and metrics for each threshold."""
    spark = compared.sparkSession
    all_steps = spark.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    counts = _count(compared, ["threshold"])
    return all_steps.join(counts, "threshold", "left").na.fill(0)


def best(swept: DataFrame) -> DataFrame:
    """The threshold of the largest F1, of equals the highest."""
    return swept.orderBy(F.col("f1").desc(), F.col("threshold").desc()).limit(1)


def per_type(compared: DataFrame, threshold: float) -> DataFrame:
    """A row of counts and metrics for each type, in their order."""
    return _count(compared.where(F.col("threshold") == threshold), ["type"]).orderBy("type")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold samples of JSON files (an array of {text, entities: [{type, value}]} each): (file, sample, text, type, value).

    A sample is numbered by its place in its file; one without entities has a row with null type and value.
    """
    schema = "text string, entities array<struct<type:string,value:string>>"
    read = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", f"array<struct<{schema.replace(' string', ':string').replace('entities array', 'entities:array')}>>").alias("s"))
    each = read.select("file", F.posexplode("s").alias("sample", "x"))
    return each.select("file", "sample", "x.text", F.explode_outer("x.entities").alias("e")).select("file", "sample", "text", "e.type", "e.value")


def errors(compared: DataFrame, predicted: DataFrame, threshold: float, sample: str = "sample_id") -> DataFrame:
    """False positives, with the confidence of the first prediction that matches, and false negatives, in alphabetical order."""
    wrong = compared.where((F.col("threshold") == threshold) & (F.col("expected") != F.col("predicted")))
    key = [sample, "type", "value"]
    first = predicted.where(F.col("confidence") >= threshold).select(sample, "type", normalize_entity(F.col("value")).alias("value"), "confidence", "ord").groupBy(*key).agg(F.min_by("confidence", "ord").alias("confidence"))
    listed = wrong.join(first, key, "left").select(*key, F.when(F.col("predicted"), "FP").otherwise("FN").alias("error"), F.when(F.col("predicted"), F.col("confidence")).alias("confidence"))
    return listed.orderBy(sample, "error", "type", "value")
