"""The corpus pipeline: drop toxic documents, those of no known language and near duplicates, then pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskline.llm import stages
from maskline.llm.common import discard, table, written

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("language_id", stages.drop_unknown_language),
    ("ngram_jaccard", stages.drop_near_duplicates),
    ("packing", stages.pack),
]

#: No stage's model or hash can be expressed in SQL; a test holds the result against the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        kept = written(stage(spark, docs, sf_dir))
        if k:
            discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
