"""Findings of whole documents: all pages searched, graded, numbered and put in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskline.operators.detect import DETECTORS, Detector, findings
from maskline.operators.policy import confidence_level, finding_id, privacy_status, redaction_action

FIELDS = ("type", "value", "start", "end", "confidence", "source", "normalized_value")


def graded(found: Column, page: Column) -> Column:
    """An array of findings, sorted and graded, each with its page; its first fields are its place."""

    def one(x: Column) -> Column:
        level = confidence_level(x["confidence"])
        made = {"confidence_level": level, "privacy_status": privacy_status(x["type"]), "redaction_action": redaction_action(x["type"], level), "finding_id": finding_id(page, x["start"], x["end"], x["type"])}
        return F.struct(page.alias("page_number"), *(x[f].alias(f) for f in FIELDS), *(c.alias(n) for n, c in made.items()))

    placed = F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["detector_ord"].alias("detector_ord"), x["match_ord"].alias("match_ord"), x.alias("f")))
    return F.transform(F.array_sort(placed), lambda x: one(x["f"]))


def analyze(pages: DataFrame, doc: str = "doc_id", page: str = "page_number", text: str = "text", detectors: Sequence[Detector] = DETECTORS) -> DataFrame:
    """(doc, status, page_count, finding_count, findings) of documents in pages (doc, page, text).

    findings is an array in document order. Each page is searched in its row; what is grouped by document
    are the findings of pages that have any.
    """
    found = F.coalesce(findings(F.col(text), detectors), F.array())
    each = pages.select(doc, page, graded(found, F.col(page)).alias("_found"))
    some = F.when(F.size("_found") > 0, F.struct(page, "_found"))
    of = each.groupBy(doc).agg(F.count("*").alias("page_count"), F.collect_list(some).alias("_pages"))
    all_ = F.flatten(F.transform(F.array_sort("_pages"), lambda x: x["_found"]))
    return of.select(doc, F.lit("analyzed").alias("status"), "page_count", all_.alias("findings")).select(doc, "status", "page_count", F.size("findings").cast("long").alias("finding_count"), "findings")
