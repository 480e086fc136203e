"""Page geometry: findings to boxes, page classes, hybrid texts and duplicate spans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskline.functions.masks import drawable, mask_value, segment
from maskline.functions.text import SPACE, folded, is_blank, strip
from maskline.operators.layout import meeting

# An image's least share of its page, the words' least cover of it, and the overlap of duplicates.
IMAGE_SHARE, WORD_COVER, SAME_BOX, OCR_FONT, SEPARATOR = 0.20, 0.05, 0.80, "GlyphLessFont", "\n|\n"
# Fixed value: room in points between a box and what is written in it.
PADDING = 1
SIDES = ("x0", "y0", "x1", "y1")


def bbox(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*(c.cast("double").alias(n) for c, n in zip((x0, y0, x1, y1), SIDES, strict=True)))


def _finite(box: Column) -> Column:
    ok = F.lit(True)
    for s in SIDES:
        ok = ok & box[s].isNotNull() & ~F.isnan(box[s]) & (F.abs(box[s]) != float("inf"))
    return ok


def intersection_area(a: Column, b: Column) -> Column:
    """0 for boxes that are malformed, not finite, or don't meet."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.coalesce(F.when(_finite(a) & _finite(b) & (w > 0) & (h > 0), w * h), F.lit(0.0))


def bbox_area(a: Column) -> Column:
    return intersection_area(a, a)


def overlap_ratio(a: Column, b: Column) -> Column:
    """Share of the smaller box that both cover."""
    small = F.least(bbox_area(a), bbox_area(b))
    return F.when(small > 0, intersection_area(a, b) / small).otherwise(0.0)


def normalize_span(text: Column) -> Column:
    """Folded case, one space for white space."""
    return strip(F.regexp_replace(folded(text), f"{SPACE}+", " "))


def region_boxes(findings: DataFrame, regions: DataFrame, keys: Sequence[str], finding: Sequence[str]) -> DataFrame:
    """(keys, finding, x0.., box_start, box_end, box_ord): the boxes of each finding.

    Pieces where a finding meets regions close the gaps between them: each ends where the next begins,
    the first begins and the last ends with the finding. Pieces of one box become one. regions has
    region_ord, start, end and bbox.
    """
    f = findings.withColumnRenamed("start", "fs").withColumnRenamed("end", "fe")
    hit = meeting(f, regions.select(*keys, "region_ord", F.col("start").alias("rs"), F.col("end").alias("re"), "bbox"), keys, ("fs", "fe"), ("rs", "re"))
    one = [*keys, *finding]
    order = Window.partitionBy(*one).orderBy("a", "region_ord")
    pieces = hit.withColumn("a", F.greatest("rs", "fs")).withColumn("n", F.row_number().over(order)).withColumn("next", F.lead("a").over(order))
    pieces = pieces.withColumn("s", F.when(F.col("n") == 1, F.col("fs")).otherwise(F.col("a")) - F.col("fs")).withColumn("e", F.coalesce("next", "fe") - F.col("fs"))
    boxes = pieces.groupBy(*one, *(F.col(f"bbox.{s}").alias(s) for s in SIDES)).agg(F.min("s").cast("int").alias("box_start"), F.max("e").cast("int").alias("box_end"), F.min("n").alias("first"))
    return boxes.withColumn("box_ord", F.row_number().over(Window.partitionBy(*one).orderBy("first"))).drop("first")


def occurrence_starts(text: Column, value: Column) -> Column:
    """Start of each non-overlapping occurrence of value in text; an empty value has one at each place."""
    pieces = F.split(text, F.concat(F.lit(r"\Q"), F.regexp_replace(value, r"\\E", r"\\\\E\\\\\\E\\\\Q"), F.lit(r"\E")), -1)
    many = F.size(pieces)
    lengths = F.transform(F.slice(pieces, F.lit(1), many - 1), F.length)
    grow = lambda a, n: F.concat(a, F.array(F.coalesce(F.element_at(a, -1) + F.length(value), F.lit(0)) + n))
    return F.when((value != "") & (many > 1), F.aggregate(lengths, F.array().cast("array<int>"), lambda a, n: F.when(F.size(a) == 0, F.array(n)).otherwise(grow(a, n)))).otherwise(F.array().cast("array<int>"))


def occurrence(text: Column, value: Column, start: Column) -> Column:
    """(occurrence, occurrences): which occurrence of value in text begins at start, the first if none does, and of how many (1 at least)."""
    starts = occurrence_starts(text, value)
    at = F.coalesce(F.array_position(starts, start.cast("int")), F.lit(0))
    return F.struct(F.greatest(at - 1, F.lit(0)).cast("int").alias("occurrence"), F.greatest(F.size(starts), F.lit(1)).alias("occurrences"))


def locate_values(found: DataFrame, pages: DataFrame, rectangles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of the rectangles (keys, value, rect_ord) of each value on its page those of each finding's occurrence.

    found (keys, value, start) meets its page (keys, text) for the occurrence alone; texts stay there.
    """
    own = [*keys, "value"]
    asked = found.join(pages.select(*keys, F.col("text").alias("_text")), list(keys)).withColumn("_at", occurrence(F.col("_text"), F.col("value"), F.col("start")))
    return allocate_rectangles(asked.select(*found.columns, "_at.*"), rectangles, own)


def redaction_plan(boxes: DataFrame, findings: DataFrame, page_counts: DataFrame, doc: str, page: str, finding: Sequence[str]) -> DataFrame:
    """What is drawn: for each box of a finding its rectangle, its part of the mask and where that is written.

    boxes (doc, page, finding, x0.., box_start, box_end), findings (doc, page, finding, type, value),
    page_counts (doc, page_count). Pages that the document doesn't have are left out. drawn is false where
    there is nothing to write or no room inside the padding; the rectangle is blanked all the same.
    """
    kept = findings.join(page_counts, doc).where(F.col(page).between(1, F.col("page_count")))
    one = [doc, page, *finding]
    masked = kept.select(*one, "type", "value", mask_value(F.col("value"), F.col("type")).alias("mask"))
    out = boxes.join(masked, one).withColumn("segment", drawable(segment(F.col("mask"), F.col("box_start"), F.col("box_end"), F.length("value"))))
    inner = {f"text_{s}": F.col(s) + (PADDING if s in ("x0", "y0") else -PADDING) for s in SIDES}
    out = out.withColumns(inner)
    room = (F.col("text_x0") < F.col("text_x1")) & (F.col("text_y0") < F.col("text_y1"))
    return out.withColumn("drawn", (F.col("segment") != "") & room).drop("mask", "value", "type")


def ocr_layout(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Non-empty spans (keys, block, line, span_ord, text) with start and end in their page's text: a break after each line with text."""
    order = Window.partitionBy(*keys).orderBy("block", "line", "span_ord")
    here, was = F.struct("block", "line"), F.lag(F.struct("block", "line")).over(order)
    placed = spans.where("text <> ''").withColumn("gap", F.when(was.isNull() | (was == here), "").otherwise("\n"))
    placed = placed.withColumn("end", F.sum(F.length("gap") + F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return placed.withColumn("start", (F.col("end") - F.length("text")).cast("int"))


def ocr_text(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, text) of pages with text; chars of a span, an array, are joined by array_join before."""
    laid = ocr_layout(spans, keys)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "gap", "text"))), lambda x: F.concat(x["gap"], x["text"])), "")
    return laid.groupBy(*keys).agg(F.concat(joined, F.lit("\n")).alias("text"))


def allocate_rectangles(found: DataFrame, rectangles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of the rectangles (keys, rect_ord) of a value on its page those of one occurrence.

    found (keys, occurrence, occurrences) says which of how many; the rectangles are dealt in order, the
    earlier occurrences get one more where they don't divide. No occurrence counts as the first of one.
    """
    count = rectangles.groupBy(*keys).agg(F.count("*").alias("n"))
    k, m = F.greatest(F.coalesce("occurrence", F.lit(0)), F.lit(0)), F.greatest(F.col("occurrences"), F.lit(1))
    base, more = F.floor(F.col("n") / m), F.col("n") % m
    dealt = found.join(count, list(keys)).withColumn("first", k * base + F.least(k, more)).withColumn("size", base + F.when(k < more, 1).otherwise(0))
    chosen = dealt.join(rectangles, list(keys))
    return chosen.where((F.col("rect_ord") >= F.col("first")) & (F.col("rect_ord") < F.col("first") + F.col("size"))).withColumn("rect_index", (F.col("rect_ord") - F.col("first")).cast("int")).drop("first", "n")


def fragment_starts(value: Column, fragments: Column) -> Column:
    """Where in value each rectangle's text begins; by even shares where it isn't found. Never backwards."""
    n = F.size(fragments)

    def step(a: Column, x: Column) -> Column:
        at, part = F.element_at(a, -1), strip(x)
        found = F.when(part != "", _find(value, part, at)).otherwise(-1)
        even = F.bround(F.length(value) * F.size(a) / n.cast("double"), 0).cast("int")
        to = F.when(found < 0, even).otherwise(found)
        return F.concat(a, F.array(F.greatest(at, F.least(to, F.length(value))).cast("int")))

    starts = F.aggregate(F.slice(fragments, F.lit(2), F.greatest(n - 1, F.lit(0))), F.array(F.lit(0)), step)
    return F.when(n > 0, starts).otherwise(F.array().cast("array<int>"))


def _find(value: Column, part: Column, start: Column) -> Column:
    """First place of part in value from start on, -1 if none."""
    at = F.instr(F.substring(value, start + 1, F.length(value)), part)
    return F.when(at > 0, at + start - 1).otherwise(-1)


def classify_pages(pages: DataFrame, images: DataFrame, words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """pages (keys, text, rect) with page_class: ocr, hybrid or native.

    Blank pages are ocr. An image of at least IMAGE_SHARE of the page that native words (keys, word_ord, bbox)
    cover by less than WORD_COVER makes it hybrid. Their areas are added in the order of word_ord, since at the
    threshold the order of adding decides; no area is negative, so the largest sum is the last.
    """
    area = F.greatest(F.col("rect.x1") - F.col("rect.x0"), F.lit(0.0)) * F.greatest(F.col("rect.y1") - F.col("rect.y0"), F.lit(0.0))
    sized = pages.where(area > 0).select(*keys, "rect", area.alias("page_area"))
    large = images.join(sized, list(keys)).withColumn("image_area", intersection_area(F.col("bbox"), F.col("rect"))).where(F.col("image_area") / F.col("page_area") >= IMAGE_SHARE)
    one = [*keys, "image_ord", "image_area"]
    order = Window.partitionBy(*one).orderBy("word_ord").rowsBetween(Window.unboundedPreceding, 0)
    covered = (
        large.select(*one, F.col("bbox").alias("image"))
        .join(words.select(*keys, "word_ord", F.col("bbox").alias("word")), list(keys), "left")
        .withColumn("covered", F.sum(intersection_area(F.col("word"), F.col("image"))).over(order))
        .groupBy(*one).agg(F.max("covered").alias("covered"))
    )
    bare = covered.groupBy(*keys).agg(F.bool_or(F.least("covered", "image_area") / F.col("image_area") < WORD_COVER).alias("bare"))
    return pages.join(bare, list(keys), "left").withColumn("page_class", F.when(is_blank(F.col("text")), "ocr").when(F.coalesce("bare", F.lit(False)), "hybrid").otherwise("native")).drop("bare")


def drop_duplicate_spans(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """spans (keys, span_ord, source, text, bbox) without OCR spans that a native one of the same text covers."""
    s = spans.withColumn("_norm", normalize_span(F.col("text")))
    native = s.where("source = 'native'").select(*(F.col(k).alias(f"n_{k}") for k in keys), F.col("_norm").alias("n_norm"), F.col("bbox").alias("n_bbox"))
    same = [F.col(k) == F.col(f"n_{k}") for k in keys] + [F.col("_norm") == F.col("n_norm"), F.col("_norm") != "", F.col("source") == "ocr", overlap_ratio(F.col("bbox"), F.col("n_bbox")) >= SAME_BOX]
    return s.join(native, same, "left_anti").drop("_norm")


def span_source(font: Column) -> Column:
    return F.when(font == OCR_FONT, "ocr").otherwise("native")


def hybrid_layout(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """spans with start and end in the page's text: native ones, a separator, then OCR ones; lines broken within a source."""
    rank = F.when(F.col("source") == "native", 0).otherwise(1)
    order = Window.partitionBy(*keys).orderBy(rank, "span_ord")
    gap = (
        F.when(F.lag("source").over(order).isNull(), "").when(F.lag("source").over(order) != F.col("source"), SEPARATOR)
        .when(F.lag("line_number").over(order) != F.col("line_number"), "\n").otherwise("")
    )
    placed = spans.withColumn("gap", gap)
    placed = placed.withColumn("end", F.sum(F.length("gap") + F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return placed.withColumn("start", (F.col("end") - F.length("text")).cast("int"))


def hybrid_text(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    laid = hybrid_layout(spans, keys)
    return laid.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "span_ord", "gap", "text"))), lambda x: F.concat(x["gap"], x["text"])), "").alias("text"))
