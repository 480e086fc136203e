"""The gate for incoming files: names, types, sizes, signatures and archive safety."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from io import BytesIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Limits, accepted types and the parts that office files must have.
MAX_FILE = 20 * 1024 * 1024
MAX_ENTRIES, MAX_ENTRY, MAX_TOTAL, MAX_RATIO = 2000, 50 * 1024 * 1024, 200 * 1024 * 1024, 100
EXTENSIONS = (".pdf", ".docx", ".xlsx")
MIME_TYPES = (
    "application/pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
)
REQUIRED = {".docx": ("[Content_Types].xml", "word/document.xml"), ".xlsx": ("[Content_Types].xml", "xl/workbook.xml")}

ENTRY = T.StructType([T.StructField("name", T.StringType()), T.StructField("file_size", T.LongType()), T.StructField("compress_size", T.LongType()), T.StructField("flag_bits", T.IntegerType())])
DOC_ID = r"\A[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z"


def extension(filename: Column) -> Column:
    """The last suffix in lower case, '' if none; a leading dot is no suffix."""
    name = F.element_at(F.split(filename, "/"), -1)
    return F.lower(F.regexp_extract(name, r"(?s)\A.+(\.[^.]+)\z", 1))


def extension_after_dot(filename: Column) -> Column:
    """What follows the last dot, in lower case, as a browser shows it; '' without a dot."""
    return F.when(filename.contains("."), F.lower(F.substring_index(filename, ".", -1))).otherwise("")


def size_label(size: Column) -> Column:
    return F.concat(F.format_string("%.1f", size / 1024.0), F.lit(" KB"))


def is_document_id(c: Column) -> Column:
    return F.coalesce(c.rlike(DOC_ID), F.lit(False))


def is_pdf(content: Column) -> Column:
    return F.coalesce(F.substring(content, 1, 5) == F.lit(b"%PDF-"), F.lit(False))


def is_unsafe_name(name: Column) -> Column:
    """Empty, absolute, with a drive letter, or with a segment '..'."""
    n = F.translate(name, "\\", "/")
    return F.coalesce((n == "") | n.startswith("/") | n.rlike(r"(?s)\A.:") | F.array_contains(F.split(n, "/"), ".."), F.lit(True))


def is_safe_archive(entries: Column) -> Column:
    """Only metadata is judged; null (no archive) is unsafe. All limits are exclusive."""
    def bad(e: Column) -> Column:
        size, packed = e["file_size"], e["compress_size"]
        ratio = F.when(packed == 0, size > 0).otherwise(size > packed * MAX_RATIO)
        return is_unsafe_name(e["name"]) | (e["flag_bits"].bitwiseAND(1) == 1) | (size > MAX_ENTRY) | ratio

    total = F.aggregate(entries, F.lit(0).cast("long"), lambda a, e: a + e["file_size"])
    return F.coalesce((F.size(entries) <= MAX_ENTRIES) & ~F.exists(entries, bad) & (total <= MAX_TOTAL), F.lit(False))


def has_parts(entries: Column, ext: str) -> Column:
    return F.coalesce(F.size(F.array_except(F.array(*(F.lit(x) for x in REQUIRED[ext])), F.transform(entries, lambda e: e["name"]))) == 0, F.lit(False))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as rows (path, filename, size_bytes, modified, content)."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), "content")


def stream_files(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """As read_files(), of files as they arrive."""
    kind = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(kind).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), "content")


def account(chunks: DataFrame, upload: str = "upload", order: str = "chunk", size: str = "n_bytes", limit: int = MAX_FILE) -> DataFrame:
    """(upload, bytes_read, chunks_read, accepted): sizes added up chunk by chunk; reading ends with the chunk that exceeds limit."""
    upto = Window.partitionBy(upload).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    running = chunks.withColumn("_total", F.sum(size).over(upto)).withColumn("_before", F.col("_total") - F.col(size))
    read = running.where(F.col("_before") <= limit)  # an upload within the limit so far is read on
    return read.groupBy(upload).agg(F.max("_total").alias("bytes_read"), F.count("*").alias("chunks_read")).withColumn("accepted", F.col("bytes_read") <= limit)


def with_entries(files: DataFrame) -> DataFrame:
    """files with entries, the archive's table of contents; null where content is no archive. Nothing is inflated."""
    schema = T.StructType([*files.schema.fields, T.StructField("entries", T.ArrayType(ENTRY))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def contents(raw: bytes | None) -> list | None:
            try:
                with zipfile.ZipFile(BytesIO(raw)) as z:
                    return [{"name": i.filename, "file_size": i.file_size, "compress_size": i.compress_size, "flag_bits": i.flag_bits} for i in z.infolist()]
            except Exception:  # whatever is wrong with it, it is no archive
                return None

        for batch in batches:
            yield batch.assign(entries=[contents(x) for x in batch["content"]])

    return files.mapInPandas(run, schema)


def gate(files: DataFrame) -> DataFrame:
    """files (filename, content_type, size_bytes, content, entries) with http_code and ingest_status.

    The first check that fails wins: name, extension, type, size, content, archive.
    """
    ext = extension(F.col("filename"))
    e = F.col("entries")
    matches = F.when(ext == ".pdf", is_pdf(F.col("content"))).when(ext == ".docx", has_parts(e, ".docx")).when(ext == ".xlsx", has_parts(e, ".xlsx")).otherwise(False)
    status = (
        F.when(F.coalesce(F.col("filename"), F.lit("")) == "", "no_filename").when(~ext.isin(*EXTENSIONS), "bad_extension")
        .when(~F.coalesce(F.col("content_type").isin(*MIME_TYPES), F.lit(False)), "bad_type").when(F.col("size_bytes") > MAX_FILE, "too_large")
        .when(~matches, "content_mismatch").when((ext != ".pdf") & ~is_safe_archive(e), "unsafe_archive").otherwise("uploaded")
    )
    codes = {"no_filename": 400, "bad_extension": 415, "bad_type": 415, "too_large": 413, "content_mismatch": 415, "unsafe_archive": 413, "uploaded": 200}
    return files.withColumn("ingest_status", status).withColumn("http_code", F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])[F.col("ingest_status")])


def receipts(gated: DataFrame) -> DataFrame:
    """(id, filename, content_type, size_bytes, status) of what the gate let in."""
    return gated.where("ingest_status = 'uploaded'").select(F.expr("uuid()").alias("id"), "filename", "content_type", "size_bytes", F.col("ingest_status").alias("status"))


def resolve_format(sources: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Each document's one format: pdf before docx before xlsx."""
    place = F.array_position(F.array(*(F.lit(x) for x in EXTENSIONS)), F.col("ext"))
    return sources.where(place > 0).groupBy(doc).agg(F.min_by("ext", place).alias("ext"))


def delete(documents: DataFrame, deletions: DataFrame, doc: str = "doc_id") -> DataFrame:
    return documents.join(deletions.select(doc), doc, "left_anti")
