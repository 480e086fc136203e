"""Grading of findings, and which of them are redacted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskline.operators.detect import RULE_TYPES, findings

HIGH, MEDIUM = 0.85, 0.60


def confidence_level(confidence: Column) -> Column:
    c = F.coalesce(confidence, F.lit(0.0))
    return F.when(c >= HIGH, "HIGH").when(c >= MEDIUM, "MEDIUM").otherwise("LOW")


def privacy_status(kind: Column) -> Column:
    return F.when(kind.isin("PERSON", *RULE_TYPES), "SENSITIVE").when(kind.isin("LOCATION", "ORGANIZATION"), "REVIEW").otherwise("UNKNOWN")


def redaction_action(kind: Column, level: Column) -> Column:
    low = level.eqNullSafe(F.lit("LOW"))
    return (
        F.when(kind.isin(*RULE_TYPES), "AUTO_REDACT").when(kind.isin("LOCATION", "ORGANIZATION"), "REVIEW")
        .when(kind == "PERSON", F.when(low, "REVIEW").otherwise("AUTO_REDACT")).otherwise("KEEP")
    )


def finding_id(page: Column, start: Column, end: Column, kind: Column) -> Column:
    return F.concat_ws(":", page.cast("string"), start.cast("string"), end.cast("string"), kind)


def enrich(findings: DataFrame, page: str | None = None) -> DataFrame:
    """findings with confidence_level, then privacy_status, then redaction_action, and finding_id."""
    graded = findings.withColumn("confidence_level", confidence_level(F.col("confidence"))).withColumn("privacy_status", privacy_status(F.col("type")))
    graded = graded.withColumn("redaction_action", redaction_action(F.col("type"), F.col("confidence_level")))
    return graded.withColumn("finding_id", finding_id(F.col(page) if page else F.lit(1), F.col("start"), F.col("end"), F.col("type")))


def with_status(findings: DataFrame, status: str = "SENSITIVE") -> DataFrame:
    return findings.where(F.col("privacy_status") == status)


def with_action(findings: DataFrame, action: str = "AUTO_REDACT") -> DataFrame:
    return findings.where(F.col("redaction_action") == action)


def select_for_redaction(findings: DataFrame, selections: DataFrame, doc: str = "doc_id") -> DataFrame:
    """All automatic findings, and those under review that selections (doc, finding_id) name."""
    chosen = with_action(findings, "REVIEW").join(selections.select(doc, "finding_id"), [doc, "finding_id"], "left_semi")
    return with_action(findings).unionByName(chosen.select(*findings.columns))


def select_all(findings: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Selections (doc, finding_id) of all findings under review."""
    return with_action(findings, "REVIEW").select(doc, "finding_id").distinct()


def clear(selections: DataFrame) -> DataFrame:
    return selections.limit(0)


def toggle(selections: DataFrame, ids: DataFrame, doc: str = "doc_id") -> DataFrame:
    """selections without those that ids name too, and with those that only ids name."""
    s, i = (x.select(doc, "finding_id").distinct() for x in (selections, ids))
    return s.join(i, [doc, "finding_id"], "left_anti").unionByName(i.join(s, [doc, "finding_id"], "left_anti"))


def union_findings(rules: DataFrame, model: DataFrame | None = None, include_model: bool = True) -> DataFrame:
    """Findings of the rules and, unless that is switched off, those of an entity model."""
    return rules.unionByName(model.select(*rules.columns)) if include_model and model is not None else rules


def in_document_order(findings: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """findings sorted by page and start; those of one start in the order of detectors and matches."""
    return findings.orderBy(*keys, "start", "detector_ord", "match_ord")


def nothing_selected(documents: DataFrame, selected: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Documents without a selected finding, as rows of status 404."""
    return documents.select(doc).join(selected.select(doc), doc, "left_anti").withColumn("http_code", F.lit(404)).withColumn("status", F.lit("nothing_selected"))


def summary(documents: DataFrame, found: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """For each document its findings, the automatic ones and those under review; 0 where it has none."""
    action = F.col("redaction_action")
    counts = found.groupBy(*keys).agg(F.count("*").alias("finding_count"), F.count_if(action == "AUTO_REDACT").alias("auto_count"), F.count_if(action == "REVIEW").alias("review_count"))
    return documents.select(*keys).join(counts, list(keys), "left").na.fill(0, ["finding_count", "auto_count", "review_count"])


def summary_in_row(documents: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """As summary() of the rule findings, counted in each document's row: one scan, no join."""
    action = lambda x: redaction_action(x["type"], confidence_level(x["confidence"]))
    of = documents.select(*keys, F.coalesce(findings(F.col(text)), F.array()).alias("_found"))
    count = lambda a: F.size(F.filter("_found", lambda x: action(x) == a)).cast("long")
    return of.select(*keys, F.size("_found").cast("long").alias("finding_count"), count("AUTO_REDACT").alias("auto_count"), count("REVIEW").alias("review_count"))


def counts_with_selection(graded: DataFrame, selections: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, finding_count, auto_count, review_count, selected_count) of documents with findings or selections."""
    action = F.col("redaction_action")
    of = graded.groupBy(doc).agg(F.count("*").alias("finding_count"), F.count_if(action == "AUTO_REDACT").alias("auto_count"), F.count_if(action == "REVIEW").alias("review_count"))
    chosen = selections.select(doc, "finding_id").distinct().groupBy(doc).agg(F.count("*").alias("selected_count"))
    return of.join(chosen, doc, "full").na.fill(0, ["finding_count", "auto_count", "review_count", "selected_count"])


def percent_label(confidence: Column) -> Column:
    return F.concat(F.floor(confidence * 100 + 0.5).cast("string"), F.lit("%"))
