"""Texts built from runs, cells and rows with the offsets of every part, and findings mapped back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskline.operators.redact import joined, laid

CELL_GAP, LINE_GAP = " | ", "\n"
#: Characters of a stretch of a page in which findings meet parts.
STRETCH = 1024


def prefix_offsets(parts: DataFrame, within: Sequence[str], order: Sequence[str], text: str, gap: int = 0) -> DataFrame:
    """parts with start and end inside the text that they make, gap characters between neighbours.

    Empty parts take part in the offsets like any other.
    """
    before = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + gap).over(before), F.lit(0)).cast("int")
    return parts.withColumn("start", start).withColumn("end", (F.col("start") + F.length(text)).cast("int"))


def line_offsets(cells: DataFrame, page: Sequence[str], row: str, column: str, text: str = "cell_text", cell_gap: str = CELL_GAP, line_gap: str = LINE_GAP) -> DataFrame:
    """Non-empty cells with start and end in their page's text: rows are lines, cells joined in each.

    One pass in reading order: what separates a cell from the one before is the line gap where the row
    changes and the cell gap elsewhere.
    """
    kept = cells.where(F.col(text).isNotNull() & (F.col(text) != ""))
    reading = Window.partitionBy(*page).orderBy(row, column)
    gap = F.when(F.lag(row).over(reading).isNull(), 0).when(F.lag(row).over(reading) == F.col(row), len(cell_gap)).otherwise(len(line_gap))
    placed = kept.withColumn("_gap", gap)
    upto = F.sum(F.col("_gap") + F.length(text)).over(reading.rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("end", upto.cast("int")).withColumn("start", (F.col("end") - F.length(text)).cast("int")).drop("_gap")


def page_text(cells: DataFrame, page: Sequence[str], row: str, column: str, text: str = "cell_text", cell_gap: str = CELL_GAP, line_gap: str = LINE_GAP) -> DataFrame:
    """(page, text): lines of non-empty rows, each of its non-empty cells."""
    kept = cells.where(F.col(text).isNotNull() & (F.col(text) != ""))
    lines = kept.groupBy(*page, row).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(column).alias("c"), F.col(text).alias("t")))), lambda x: x["t"]), cell_gap).alias("line"))
    return lines.groupBy(*page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(row).alias("r"), "line"))), lambda x: x["line"]), line_gap).alias("text"))


def meeting(x: DataFrame, y: DataFrame, keys: Sequence[str], x_at: tuple[str, str], y_at: tuple[str, str], width: int = STRETCH) -> DataFrame:
    """Pairs of rows of x and y of equal keys whose intervals (start, end) share a character, each pair once.

    Rows meet by stretches of width characters, so a page of any length is many small groups: each row is
    dealt to the stretches that it touches, and a pair counts in the first that it shares.
    """
    def dealt(d: DataFrame, at: tuple[str, str]) -> DataFrame:
        first, last = F.floor(F.col(at[0]) / width), F.floor((F.col(at[1]) - 1) / width)
        return d.where(F.col(at[1]) > F.col(at[0])).withColumn("_stretch", F.explode(F.sequence(first, last)))

    pairs = dealt(x, x_at).join(dealt(y, y_at), [*keys, "_stretch"])
    begin = F.greatest(x_at[0], y_at[0])
    return pairs.where((begin < F.least(x_at[1], y_at[1])) & (F.floor(begin / width) == F.col("_stretch"))).drop("_stretch")


def locate(findings: DataFrame, parts: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Every part that a finding meets, with match_start, match_end and matched_text inside the part.

    An equi-join on stretches of the page, with the overlap as its residual condition.
    """
    f = findings.withColumnRenamed("start", "finding_start").withColumnRenamed("end", "finding_end")
    hit = meeting(f, parts, keys, ("finding_start", "finding_end"), ("start", "end"))
    hit = hit.withColumn("match_start", F.greatest("finding_start", "start") - F.col("start")).withColumn("match_end", F.least("finding_end", "end") - F.col("start"))
    return hit.withColumn("matched_text", F.substring(F.col(text), F.col("match_start") + 1, F.col("match_end") - F.col("match_start")))


def part_masks(located: DataFrame, mask: str = "mask") -> DataFrame:
    """Each part's slice of its finding's mask; stars where the slice isn't as long as the match."""
    width = F.col("match_end") - F.col("match_start")
    cut = F.substring(F.col(mask), F.greatest("start", "finding_start") - F.col("finding_start") + 1, width)
    return located.withColumn("mask_slice", F.when(F.length(cut) == width, cut).otherwise(F.repeat(F.lit("*"), width)))


def cell_masks(located: DataFrame, keys: Sequence[str], text: str = "cell_text") -> DataFrame:
    """(keys, text, new_text, matches): each part that findings meet, under all their mask slices; keys name the part.

    located comes from part_masks(). Of overlapping slices a star wins.
    """
    spans = F.collect_list(F.struct(F.col("match_start").alias("start"), F.col("match_end").alias("end"), F.col("mask_slice").alias("mask")))
    of = located.groupBy(*keys, text).agg(spans.alias("_spans"), F.count("*").alias("matches"))
    apart = of.withColumn("_apart", joined(F.col(text), F.col("_spans")))
    return apart.withColumn("new_text", laid(F.col(text), F.col("_apart"))).drop("_spans", "_apart")


def block_counters(blocks: DataFrame, doc: Sequence[str], order: str, kind: str = "kind") -> DataFrame:
    """Number of each block among those of its kind, from 0, empty ones included."""
    return blocks.withColumn("kind_index", F.row_number().over(Window.partitionBy(*doc, kind).orderBy(order)) - 1)
