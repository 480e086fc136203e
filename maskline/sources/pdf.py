"""PDF files through a parser that is given: pages with their words, images and scanned spans, and the pages' texts.

No PDF library is assumed. A parser gets a file's bytes and gives one dict for each page, in order, with
text (the native one), rect, words, images and spans; a page that isn't native has its recognised spans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskline.operators import regions

_BOX = "x0 double, y0 double, x1 double, y1 double"
_STRUCT = _BOX.replace(" double", ":double")
PAGES = (
    f"doc_id string, page_number int, text string, rect struct<{_STRUCT}>, images array<struct<{_STRUCT}>>, words array<struct<{_STRUCT},text:string>>, "
    f"spans array<struct<block:int,line:int,font:string,chars:array<string>,{_STRUCT}>>"
)
Parser = Callable[[bytes], list[dict]]


def parse(files: DataFrame, load: Callable[[], Parser]) -> DataFrame:
    """Pages of files (doc_id, content) by a parser that each worker loads once.

    A file that the parser raises an error for has one row of page_number 0 with the error as its text;
    readable() and errors() tell the two apart.
    """
    names = [x.split(" ")[0] for x in ("doc_id", "page_number", "text", "rect", "images", "words", "spans")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = load()
        for batch in batches:
            for key, raw in zip(batch["doc_id"], batch["content"], strict=True):
                try:
                    found = [(key, n, p.get("text") or "", p.get("rect"), p.get("images") or [], p.get("words") or [], p.get("spans") or []) for n, p in enumerate(read(raw), 1)]
                except Exception as e:  # the parser is anyone's: its error is the file's row, not the job's end
                    found = [(key, 0, f"{type(e).__name__}: {e}", None, [], [], [])]
                yield pd.DataFrame(found, columns=names)

    return files.select("doc_id", "content").mapInPandas(run, PAGES)


def readable(parsed: DataFrame) -> DataFrame:
    return parsed.where("page_number > 0")


def errors(parsed: DataFrame) -> DataFrame:
    return parsed.where("page_number = 0").select("doc_id", F.lit(422).alias("http_code"), F.lit("parse_error").alias("status"), F.col("text").alias("message"))


def spans(pages: DataFrame) -> DataFrame:
    """A row for each span: (doc_id, page_number, span_ord, block, line, line_number, source, text, bbox)."""
    each = pages.select("doc_id", "page_number", F.posexplode("spans").alias("span_ord", "s"))
    return each.select("doc_id", "page_number", "span_ord", "s.block", "s.line", F.col("s.line").alias("line_number"), regions.span_source(F.col("s.font")).alias("source"), F.array_join("s.chars", "").alias("text"), regions.bbox(*(F.col(f"s.{x}") for x in regions.SIDES)).alias("bbox"))


def page_texts(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, text_source, text): the native text, the recognised one of blank pages, or both of hybrid ones."""
    key = ["doc_id", "page_number"]
    box = lambda c: regions.bbox(*(F.col(f"{c}.{x}") for x in regions.SIDES))
    images = pages.select(*key, F.posexplode("images").alias("image_ord", "i")).select(*key, "image_ord", box("i").alias("bbox"))
    words = pages.select(*key, F.posexplode("words").alias("word_ord", "w")).select(*key, "word_ord", box("w").alias("bbox"))
    kinds = regions.classify_pages(pages.select(*key, "text", "rect"), images, words, key)
    all_ = spans(pages).where("text <> ''")
    scanned = regions.ocr_text(all_, key).withColumnRenamed("text", "ocr")
    mixed = regions.hybrid_text(regions.drop_duplicate_spans(all_, key), key).withColumnRenamed("text", "hybrid")
    text = F.when(F.col("page_class") == "native", F.col("text")).when(F.col("page_class") == "ocr", F.coalesce("ocr", F.lit(""))).otherwise(F.coalesce("hybrid", "text"))
    return kinds.join(scanned, key, "left").join(mixed, key, "left").select(*key, F.col("page_class").alias("text_source"), text.alias("text"))
