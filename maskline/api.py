"""The batch interface: files in, texts, analyses and masked files out; what fails is a row with its code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskline.operators import analyze as analysis
from maskline.operators import layout, policy, redact
from maskline.sources import ingest, office


def ingested(files: DataFrame) -> DataFrame:
    """files (filename, content_type, size_bytes, content) judged by the gate, archives looked into."""
    return ingest.gate(ingest.with_entries(files))


def pages(files: DataFrame, kind: str) -> DataFrame:
    """(doc_id, page_number, text) of DOCX or XLSX files (doc_id, content); a DOCX is one page, a sheet another."""
    if kind == "docx":
        return office.docx_text(office.docx_layout(office.parse_docx(files)), files)
    text = layout.page_text(office.parse_xlsx(files), ["doc_id", "page_number"], "row", "column")
    sheets = office.parse_sheets(files).select("doc_id", "page_number")
    return sheets.join(text, ["doc_id", "page_number"], "left").select("doc_id", "page_number", F.coalesce("text", F.lit("")).alias("text"))


def extract_text(files: DataFrame, kind: str) -> DataFrame:
    """(doc_id, status, page_count, pages): an array of (page_number, text) in order; office.errors() has files that can't be read."""
    of = pages(files, kind).groupBy("doc_id").agg(F.count("*").alias("page_count"), F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("pages"))
    return of.select("doc_id", F.lit("parsed").alias("status"), "page_count", "pages")


def analyze(files: DataFrame, kind: str) -> DataFrame:
    return analysis.analyze(pages(files, kind))


def redacted(files: DataFrame, kind: str, selections: DataFrame | None = None) -> DataFrame:
    """files (doc_id, content) with automatic findings masked in place, and those under review that selections name.

    Each finding meets the runs or cells that it covers; a part's new text is laid under all its mask slices,
    and the parts of a file are written into it. Files without a finding stay as they are.
    """
    from maskline.operators.detect import detect

    if kind == "docx":
        key = list(office.ADDRESS)
        placed = office.docx_layout(office.parse_docx(files)).withColumn("page_number", F.lit(1))
        part = "text"
    else:
        key = ["page_number", "sheet_name", "coordinate"]
        placed = layout.line_offsets(office.parse_xlsx(files), ["doc_id", "page_number"], "row", "column")
        part = "cell_text"
    found = policy.enrich(detect(pages(files, kind), ["doc_id", "page_number"]), "page_number")
    empty = found.select("doc_id", "finding_id").limit(0)
    chosen = redact.masked(policy.select_for_redaction(found, selections if selections is not None else empty))
    located = layout.part_masks(layout.locate(chosen, placed.withColumnRenamed(part, "part_text"), ["doc_id", "page_number"], "part_text"))
    # null-safe: an address has nulls where its kind has no such number
    named = located.withColumn("_at", F.to_json(F.struct(*key)))
    new = layout.cell_masks(named, ["doc_id", "_at"], "part_text")
    kinds = ", ".join(f"{k} {t}" for k, t in placed.select(*key).dtypes)
    parts = new.select("doc_id", F.from_json("_at", kinds).alias("a"), F.col("new_text")).select("doc_id", "a.*", "new_text")
    return office.redact_files(files, parts, kind)
