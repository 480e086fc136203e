"""The registered queries of the detection and redaction operators, and their SQL."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskline import api
from maskline.functions import masks
from maskline.operators import analyze, detect, evaluate, layout, ner, policy, redact, regions
from maskline.plans import inputs, oracle
from maskline.plans.inputs import from_sql, placed_table, table
from maskline.sources import ingest, office
from maskline.streaming import retention

FINDING = ["type", "value", "start", "end", "confidence", "normalized_value"]


def _only(kind: str) -> tuple[detect.Detector, ...]:
    return tuple(d for d in detect.DETECTORS if d.type == kind)


def _found(pages: DataFrame, key: str, kind: str, text: str = "text") -> DataFrame:
    return detect.detect(pages, [key], text, _only(kind)).select(key, *FINDING)


def r1_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(table(spark, sf_dir, "documents"), "doc_id", "EMAIL")


def r1_email_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(table(spark, sf_dir, "pages"), "page_id", "EMAIL", "html")


def r8_card_luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(table(spark, sf_dir, "documents"), "doc_id", "CARD_NUMBER")


def r8_card_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(table(spark, sf_dir, "pages"), "page_id", "CARD_NUMBER", "html")


def r2_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(from_sql(spark, sf_dir, inputs.PHONE_TEXTS), "c_custkey", "PHONE")


def r3_tckn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(from_sql(spark, sf_dir, inputs.ID_TEXTS), "c_custkey", "TCKN")


def r5_iban(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(from_sql(spark, sf_dir, inputs.IBAN_TEXTS), "c_custkey", "IBAN")


def _document_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.detect(table(spark, sf_dir, "documents"), ["doc_id"])
    return policy.enrich(redact.masked(found))


def detect_all_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = ["confidence_level", "privacy_status", "redaction_action", "finding_id"]
    return _document_findings(spark, sf_dir).select("doc_id", *FINDING, "detector_ord", *graded, "mask")


def findings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.summary_in_row(table(spark, sf_dir, "documents"))


def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = redact.redact_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "redacted", (F.col("redacted") != F.col("text")).alias("changed"))


def _masks(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return from_sql(spark, sf_dir, oracle.VALUES[kind]).select("id", "value", masks.mask_value(F.col("value"), F.lit(kind)).alias("masked"))

    return run


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.enrich(from_sql(spark, sf_dir, oracle.MIXED))


def grade_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = policy.percent_label(F.col("confidence"))
    return _graded(spark, sf_dir).select("doc_id", "type", "confidence", "confidence_level", "privacy_status", "redaction_action", "finding_id", label.alias("label"))


def select_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = _graded(spark, sf_dir)
    asked = graded.where("doc_id % 2 = 0").select("doc_id", "finding_id")
    return policy.select_for_redaction(graded, asked).select("doc_id", "finding_id", "redaction_action")


def nothing_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = _graded(spark, sf_dir)
    return policy.nothing_selected(graded.select("doc_id"), policy.with_action(graded))


def _sheet_text(spark: SparkSession, sf_dir: str, cells: str) -> DataFrame:
    return layout.page_text(from_sql(spark, sf_dir, cells), ["conv_id"], "row", "column_no")


def _cell_offsets(spark: SparkSession, sf_dir: str, cells: str) -> DataFrame:
    return layout.line_offsets(from_sql(spark, sf_dir, cells), ["conv_id"], "row", "column_no").select("conv_id", "row", "column_no", "start", "end")


def _cell_matches(spark: SparkSession, sf_dir: str, cells: str, spans: str) -> DataFrame:
    placed = layout.line_offsets(from_sql(spark, sf_dir, cells), ["conv_id"], "row", "column_no")
    found = from_sql(spark, sf_dir, spans).withColumn("mask", F.repeat(F.lit("*"), F.col("end") - F.col("start")))
    hit = layout.part_masks(layout.locate(found, placed, ["conv_id"], "cell_text"))
    return hit.select("conv_id", "finding", "row", "column_no", "match_start", "match_end", "matched_text", "mask_slice")


def sheet_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sheet_text(spark, sf_dir, oracle.CELLS)


def cell_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cell_offsets(spark, sf_dir, oracle.CELLS)


def cell_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cell_matches(spark, sf_dir, oracle.CELLS, oracle.SPANS)


def sheet_text_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sheet_text(spark, sf_dir, oracle.WHOLE_CELLS)


def cell_offsets_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cell_offsets(spark, sf_dir, oracle.WHOLE_CELLS)


def cell_matches_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cell_matches(spark, sf_dir, oracle.WHOLE_CELLS, oracle.WHOLE_SPANS)


def run_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("run", "word"))
    return layout.prefix_offsets(runs, ["conv_id", "turn"], ["run"], "word", 1).select("conv_id", "turn", "run", "start", "end")


def block_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("kind"))
    return layout.block_counters(blocks, ["conv_id"], "turn").select("conv_id", "turn", "kind", "kind_index")


def ner_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = from_sql(spark, sf_dir, oracle.NER_PAGES)
    merged = ner.merge(from_sql(spark, sf_dir, oracle.NER_ENTITIES), pages, ["page"])
    return merged.select("page", "type", "value", "start", "end", "confidence")


def region_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxed = from_sql(spark, sf_dir, oracle.REGIONS)
    boxed = boxed.select("page", "region_ord", "start", "end", regions.bbox(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("bbox"))
    return regions.region_boxes(from_sql(spark, sf_dir, oracle.REGION_FINDINGS), boxed, ["page"], ["finding"]).withColumn("box_ord", F.col("box_ord").cast("long"))


def _pair_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = from_sql(spark, sf_dir, oracle.BOX_PAIRS)
    box = lambda p: regions.bbox(*(F.col(f"{p}{s}") for s in regions.SIDES))
    return d.select("id", box("a").alias("a"), box("b").alias("b"))


def bbox_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _pair_boxes(spark, sf_dir).select("id", F.round(regions.intersection_area(a, b), 6).alias("area"), F.round(regions.overlap_ratio(a, b), 6).alias("ratio"))


def page_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = regions.bbox(*(F.col(s) for s in regions.SIDES)).alias
    pages = from_sql(spark, sf_dir, oracle.CLASS_PAGES).select("page", "text", box("rect"))
    images = from_sql(spark, sf_dir, oracle.CLASS_IMAGES).select("page", "image_ord", box("bbox"))
    words = from_sql(spark, sf_dir, oracle.CLASS_WORDS.replace("select ", "select place as word_ord, ", 1), placed_table).select("page", "word_ord", box("bbox"))
    return regions.classify_pages(pages, images, words, ["page"]).select("page", "page_class")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = from_sql(spark, sf_dir, oracle.HYBRID)
    return s.select("page", "span_ord", "line_number", "text", regions.span_source(F.col("font")).alias("source"), regions.bbox(*(F.col(x) for x in regions.SIDES)).alias("bbox"))


def hybrid_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.drop_duplicate_spans(_spans(spark, sf_dir), ["page"]).select("page", "span_ord", "source")


def hybrid_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.hybrid_text(_spans(spark, sf_dir), ["page"])


def rect_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rects = from_sql(spark, sf_dir, oracle.RECTS)
    found = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), (F.col("o_custkey") % 3).cast("int").alias("occurrence"), F.lit(3).alias("occurrences"))
    return regions.allocate_rectangles(found, rects, ["page"]).select("page", "occurrence", "rect_ord", "rect_index")


def fragment_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("value"), F.split("p_name", " ").alias("words"))
    return parts.select("p_partkey", F.posexplode(regions.fragment_starts(F.col("value"), F.col("words"))).alias("rect_index", "start"))


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.compare(from_sql(spark, sf_dir, oracle.GOLD), from_sql(spark, sf_dir, oracle.PREDICTED))


def _rounded(d: DataFrame) -> DataFrame:
    return d.withColumns({m: F.round(m, 6) for m in ("precision", "recall", "f1")})


def eval_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.sweep(_compared(spark, sf_dir)))


def eval_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.best(evaluate.sweep(_compared(spark, sf_dir))))


def eval_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.per_type(_compared(spark, sf_dir), 0.5))


def eval_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.errors(_compared(spark, sf_dir), from_sql(spark, sf_dir, oracle.PREDICTED), 0.5)


def ingest_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = from_sql(spark, sf_dir, oracle.FILES).withColumn("content", F.encode("content", "UTF-8"))
    files = files.withColumn("entries", F.when(F.col("kind") == 1, F.array(F.struct(F.lit("[Content_Types].xml").alias("name"), F.lit(10).cast("long").alias("file_size"), F.lit(5).cast("long").alias("compress_size"), F.lit(0).alias("flag_bits")), F.struct(F.lit("word/document.xml").alias("name"), F.col("entry_size").alias("file_size"), F.lit(100).cast("long").alias("compress_size"), F.col("flags").alias("flag_bits")))))
    return ingest.gate(files).select("id", "ingest_status", "http_code", ingest.extension(F.col("filename")).alias("extension"))


def uuid_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, oracle.UUIDS).select("id", ingest.is_document_id(F.col("doc")).alias("valid"))


def zip_name_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, oracle.NAMES).select("id", ingest.is_unsafe_name(F.col("name")).alias("unsafe"))


def resolve_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.resolve_format(from_sql(spark, sf_dir, oracle.SOURCES))


def delete_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return ingest.delete(docs, table(spark, sf_dir, "labels").where("toxic = 1"))


def retention_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    touches = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), "ts")
    end = touches.agg(F.max("ts")).first()[0]
    gone = retention.stale(touches, F.lit(end))
    return gone.select("doc_id", F.col("age_s").cast("long").alias("age_s"))


def retention_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    touches = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), "ts")
    return retention.sessions(touches).select("doc_id", F.unix_micros(F.to_timestamp_ltz("opened")).alias("opened_us"), F.unix_micros(F.to_timestamp_ltz("expired")).alias("expired_us"), "touches")


def _files(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """A file for each conversation, its turns as paragraphs or rows."""
    turns = table(spark, sf_dir, "conversations").where("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def build(batches):
        for batch in batches:
            made = []
            for rows in batch["turns"]:
                if kind == "docx":
                    made.append(office.make_docx([[r["role"], r["text"]] for r in rows]))
                else:
                    made.append(office.make_xlsx({"chat": [[int(r["turn"]), r["role"], r["text"]] for r in rows]}))
            yield batch[["doc_id"]].assign(content=made)

    return turns.select(F.col("conv_id").cast("string").alias("doc_id"), "turns").mapInPandas(build, "doc_id string, content binary")


def docx_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = office.docx_layout(office.parse_docx(_files(spark, sf_dir, "docx")))
    return runs.select("doc_id", "paragraph_index", "run_index", "start", "end", "text")


def xlsx_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = office.parse_xlsx(_files(spark, sf_dir, "xlsx"))
    return cells.select("doc_id", "page_number", "sheet_name", "row", "column", "coordinate", "cell_text", "is_formula")


def _streamed(spark: SparkSession, touches: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stream over touches up to their end, run once and read back."""
    at = _scratch(spark)
    state = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state)
    touches.write.parquet(f"{at}/in")
    made = make(spark.readStream.schema(touches.schema).parquet(f"{at}/in"))
    retention.run_sweeps(made, f"{at}/out", f"{at}/state", once=True).awaitTermination()
    out = spark.read.schema(made.schema).parquet(f"{at}/out")
    return out.withColumn("last_ms", F.unix_millis("last_touch")).drop("last_touch")


def _scratch(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="maskline-")
    return f"{root.rstrip('/')}/maskline-{uuid.uuid4().hex}"


def _touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.to_timestamp_ltz("ts").alias("ts"), (F.col("event_type") == "purchase").alias("closes"))


def retention_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that expire by the events' end."""
    return _streamed(spark, _touches(spark, sf_dir).drop("closes"), retention.expire_stream)


def close_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that expire or, with a purchase for a download, are removed at once."""
    return _streamed(spark, _touches(spark, sf_dir), retention.close_stream)


def retention_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    return retention.deleted_count(retention.sweep(from_sql(spark, sf_dir, oracle.TOUCHED), F.lit(end)))


def analyzed(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = analyze.analyze(from_sql(spark, sf_dir, oracle.PAGES).withColumnRenamed("doc", "doc_id"))
    line = lambda f: F.concat_ws("|", f["finding_id"], f["redaction_action"], F.coalesce(f["normalized_value"], F.lit("")))
    return done.withColumn("found", F.array_join(F.transform("findings", line), ";")).drop("findings")


def findings_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.detect(from_sql(spark, sf_dir, oracle.MAIL_PAGES), ["page"])
    both = policy.enrich(policy.union_findings(found, from_sql(spark, sf_dir, oracle.MODEL_FOUND)), "page")
    return policy.in_document_order(both, ["page"]).select("page", "type", "value", "start", "end", "source", "redaction_action", "detector_ord")


def occurrence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = from_sql(spark, sf_dir, oracle.THRICE)
    rects = from_sql(spark, sf_dir, oracle.RECTS).join(pages.select("page", "value"), "page")
    found = regions.locate_values(pages.select("page", "value", "start"), pages.select("page", "text"), rects, ["page"])
    return found.select("page", "rect_ord", "rect_index")


def redaction_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = from_sql(spark, sf_dir, oracle.PLAN_FINDINGS)
    at = ["doc", "page_number", "page"]
    boxes = region_boxes(spark, sf_dir).join(found.select(*at, "finding"), ["page", "finding"])
    boxes = boxes.withColumns({s: F.col(s) * 10 for s in regions.SIDES})
    counts = found.select("doc").distinct().withColumn("page_count", F.lit(60))
    plan = regions.redaction_plan(boxes, found, counts, "doc", "page_number", ["page", "finding"])
    return plan.select("page", "finding", "box_ord", "segment", *(f"text_{s}" for s in regions.SIDES), "drawn")


def ocr_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.ocr_text(from_sql(spark, sf_dir, oracle.SCANNED), ["page"])


def gold_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples written as JSON files of some hundred each and read as gold."""
    entity = lambda kind, value: F.struct(F.lit(kind).alias("type"), F.col(value).alias("value"))
    none = F.array().cast("array<struct<type:string,value:string>>")
    entities = F.when(F.col("bare"), none).otherwise(F.array(entity("PERSON", "person"), entity("LOCATION", "city")))
    samples = from_sql(spark, sf_dir, oracle.SAMPLES).select("pile", F.struct("text", entities.alias("entities")).alias("x"))
    at = _scratch(spark)
    samples.groupBy("pile").agg(F.to_json(F.array_sort(F.collect_list("x"))).alias("value")).write.partitionBy("pile").text(at)
    return evaluate.read_gold(spark, at).select("text", "type", "value")


def cell_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = layout.line_offsets(from_sql(spark, sf_dir, oracle.WHOLE_CELLS), ["conv_id"], "row", "column_no")
    found = from_sql(spark, sf_dir, oracle.WHOLE_SPANS).withColumn("mask", F.repeat(F.lit("*"), F.col("end") - F.col("start")))
    located = layout.part_masks(layout.locate(found, placed, ["conv_id"], "cell_text"))
    return layout.cell_masks(located, ["conv_id", "row", "column_no"]).drop("cell_text")


def upload_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.account(from_sql(spark, sf_dir, oracle.CHUNKS))


def review_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = _graded(spark, sf_dir)
    every = policy.select_all(graded)
    return policy.counts_with_selection(graded, policy.toggle(every.where("doc_id % 2 = 0"), every.where("doc_id % 3 = 0")))


def file_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, oracle.LABELS).select("id", ingest.extension_after_dot(F.col("filename")).alias("extension"), ingest.size_label(F.col("size_bytes")).alias("size"))


def _client_files(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """A file of twenty customers each: paragraphs of several runs and tables, or rows with formulas and dates."""
    rows = from_sql(spark, sf_dir, oracle.CLIENTS).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name", "mail", "days"))).alias("rows"))

    def build(batches):
        for batch in batches:
            made = []
            for clients in batch["rows"]:
                if kind == "docx":
                    made.append(office.make_docx([b for r in clients for b in (["E-mail: ", r["mail"][:-6], r["mail"][-6:]], [[[[r["c_name"]]], [["Kart 4111 1111 1111 1111"]]]])]))
                else:
                    start = dt.datetime(2020, 1, 1, 12)
                    made.append(office.make_xlsx({"clients": [[r["c_name"], ("LOWER(A1)", r["mail"]), start + dt.timedelta(days=int(r["days"])), ("3+4", 7)] for r in clients]}))
            yield batch[["doc_id"]].assign(content=made)

    return rows.select(F.col("doc").cast("string").alias("doc_id"), "rows").mapInPandas(build, "doc_id string, content binary")


def docx_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = api.redacted(_client_files(spark, sf_dir, "docx"), "docx")
    return office.parse_docx(done).select("doc_id", "kind", "block", F.coalesce("cell_index", F.lit(0)).alias("cell_index"), "run_index", "text")


def xlsx_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = api.redacted(_client_files(spark, sf_dir, "xlsx"), "xlsx")
    return office.parse_xlsx(done).select("doc_id", "coordinate", "cell_text", "is_formula")


analyzed.__name__ = "analyze"

QUERIES = (
    r1_email, r1_email_pages, r8_card_luhn, r8_card_pages, r2_phone, r3_tckn, r5_iban, detect_all_enriched, findings_summary, redact_text, grade_findings, select_review,
    nothing_selected, sheet_text, cell_offsets, cell_matches, sheet_text_whole, cell_offsets_whole, cell_matches_whole, run_offsets, block_counters, ner_merge, region_boxes, bbox_overlap, page_class, hybrid_dedupe, hybrid_text,
    rect_allocation, fragment_starts, eval_sweep, eval_best, eval_per_type, eval_errors, ingest_gate, uuid_check, zip_name_guard, resolve_format, delete_documents,
    retention_stale, retention_sessions, docx_parse, xlsx_parse, retention_stream, close_stream, retention_sweep, analyzed, findings_union, occurrence_index, redaction_plan, ocr_text, gold_json,
    cell_masks, upload_bytes, review_selection, file_labels, docx_redact, xlsx_redact,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES} | {f"mask_{k.lower()}": _masks(k) for k in oracle.VALUES}


def oracle_sql() -> dict[str, str]:
    return oracle.sql()
