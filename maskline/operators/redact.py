"""Masks laid over texts; where several overlap, a star of any wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskline.functions.masks import guarded, mask_value
from maskline.operators.detect import DETECTORS, Detector, findings


def joined(text: Column, spans: Column) -> Column:
    """spans, an array of (start, end, mask), in order, overlapping ones joined into one each."""
    def star(a: Column, b: Column) -> Column:
        return F.when((a == "*") | (b == "*"), "*").otherwise(a)

    def chars(c: Column) -> Column:
        return F.filter(F.split(c, ""), lambda x: x != "")

    def join(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        at, width = x["start"] - last["start"], F.greatest(last["end"], x["end"]) - last["start"]
        # under each mask stand the characters of the text where it doesn't reach
        base = F.substring(text, last["start"] + 1, width)
        one = F.concat(last["mask"], F.substring(base, F.length(last["mask"]) + 1, width))
        two = F.concat(F.substring(base, F.lit(1), at), x["mask"], F.substring(base, at + F.length(x["mask"]) + 1, width))
        both = F.array_join(F.zip_with(chars(one), chars(two), star), "")
        merged = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), both.alias("mask"))
        return F.when((F.size(acc) > 0) & (x["start"] < last["end"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(merged))).otherwise(F.concat(acc, F.array(x)))

    kind = "array<struct<start:int,end:int,mask:string>>"
    return F.aggregate(F.array_sort(spans).cast(kind), F.array().cast(kind), join)


def laid(text: Column, apart: Column) -> Column:
    """text with spans that don't overlap laid over it; it is cut and put together once."""
    before = lambda i: F.coalesce(F.get(apart, i - 1)["end"], F.lit(0))
    pieces = F.transform(apart, lambda x, i: F.concat(F.substring(text, before(i) + 1, x["start"] - before(i)), x["mask"]))
    tail = F.substring(text, F.element_at(apart, -1)["end"] + 1, F.length(text))
    return F.when(F.size(apart) > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(text)


def lay_over(text: Column, spans: Column) -> Column:
    """text with spans, an array of (start, end, mask), laid over it; a star of any of them wins."""
    return laid(text, joined(text, spans))


def mask_of(value: Column, kind: Column, start: Column, end: Column) -> Column:
    """A finding's mask, as wide as its span."""
    return guarded(mask_value(value, kind), end - start)


def masked(findings: DataFrame) -> DataFrame:
    """findings with mask, as wide as the finding's span."""
    return findings.withColumn("mask", mask_of(F.col("value"), F.col("type"), F.col("start"), F.col("end")))


def _laid(pages: DataFrame, text: str) -> DataFrame:
    """pages with redacted out of _spans; each step is a projection of its own, so none is repeated."""
    apart = F.when(F.size("_spans") > 0, joined(F.col(text), F.col("_spans")))
    out = pages.withColumn("_apart", apart).withColumn("redacted", F.when(F.col("_apart").isNull(), F.col(text)).otherwise(laid(F.col(text), F.col("_apart"))))
    return out.drop("_spans", "_apart")


def redact_rules(pages: DataFrame, text: str = "text", detectors: Sequence[Detector] = DETECTORS) -> DataFrame:
    """pages with redacted, the text under the masks of all its rule findings.

    Each row is searched, masked and put together by itself, in one scan: no join and no shuffle, and rows
    that share a key don't meet. A null text stays null.
    """
    mask = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), mask_of(x["value"], x["type"], x["start"], x["end"]).alias("mask"))
    return _laid(pages.withColumn("_spans", F.transform(findings(F.col(text), detectors), mask)), text)


def redact(pages: DataFrame, found: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """pages with redacted, the text under the masks of any findings (keys, type, value, start, end).

    keys must name a page: findings are laid over every page of their keys. Only spans and masks are grouped,
    an array for each page with findings.
    """
    spans = masked(found).groupBy(*keys).agg(F.collect_list(F.struct("start", "end", "mask")).alias("_spans"))
    return _laid(pages.join(spans, list(keys), "left"), text)
