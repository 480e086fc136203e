"""Named-entity predictions as findings: neighbours merged, labels mapped."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskline.functions.text import is_blank

# The model's groups and our types.
TYPES = {"PER": "PERSON", "LOC": "LOCATION", "ORG": "ORGANIZATION"}


def predict(pages: DataFrame, keys: Sequence[str], load: Callable[[], Callable[[str], list[dict]]]) -> DataFrame:
    """Raw entities of every page's text, by a model that each worker loads once.

    load returns a function of a text that gives dicts of entity_group, score, start and end.
    """
    kinds = ", ".join(f"{k} {t}" for k, t in pages.select(*keys).dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            rows = [(*key, i, e["entity_group"], float(e["score"]), int(e["start"]), int(e["end"])) for *key, text in batch.itertuples(index=False) if text for i, e in enumerate(model(text))]
            yield pd.DataFrame(rows, columns=[*keys, "ord", "entity_group", "score", "start", "end"])

    return pages.select(*keys, "text").mapInPandas(run, f"{kinds}, ord int, entity_group string, score double, start int, end int")


def merge(entities: DataFrame, pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs of entities of one group with only white space between, each as one; then labels are mapped.

    entities (keys, ord, entity_group, score, start, end) join pages (keys, text). A run has the lowest
    score and ends where its last entity does. Groups without a type still break a run.
    """
    order = Window.partitionBy(*keys).orderBy("ord")
    e = entities.join(pages.select(*keys, "text"), list(keys))
    last, same = F.lag("end").over(order), F.lag("entity_group").over(order) == F.col("entity_group")
    gap = F.when(F.col("start") > last, F.substring(F.col("text"), last + 1, F.col("start") - last)).otherwise("")
    fresh = F.coalesce((~same | ~is_blank(gap)).cast("int"), F.lit(1))
    runs = e.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(order))
    merged = runs.groupBy(*keys, "_run").agg(
        F.first("entity_group").alias("entity_group"), F.min("score").alias("confidence"), F.min_by("start", "ord").alias("start"), F.max_by("end", "ord").alias("end"), F.min("ord").alias("match_ord")
    )
    kind = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])[F.col("entity_group")]
    found = merged.withColumn("type", kind).where("type is not null").join(pages.select(*keys, "text"), list(keys))
    return found.select(
        *keys, "type", F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")).alias("value"), "start", "end", "confidence", F.lit("ner_model").alias("source"),
        F.lit(None).cast("string").alias("normalized_value"), F.lit(5).alias("detector_ord"), "match_ord",
    )
