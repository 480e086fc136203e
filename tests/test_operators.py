"""Detection, redaction, layout, entities, evaluation, files and retention on small literal inputs."""

import datetime as dt
import functools
import io
import itertools
import re
import zipfile

from pyspark.sql import functions as F

from maskline import api
from maskline.operators import analyze, detect, evaluate, layout, ner, policy, redact, regions
from maskline.plans import catalogue
from maskline.sources import ingest, office, pdf
from maskline.streaming import retention


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id int, text string")


CARD = "5500 0000 0000 0004"


def test_document_order(spark):
    t = texts(spark, f"Yaz: deniz@posta.example.org\nAra: 0555 987 65 43\nOde: {CARD}", f"Ode: {CARD}; Yaz: deniz@posta.example.org", None, "", "nothing to see")
    got = policy.in_document_order(detect.detect(t, ["doc_id"])).collect()
    assert [(r.doc_id, r.type) for r in got] == [(0, "EMAIL"), (0, "PHONE"), (0, "CARD_NUMBER"), (1, "CARD_NUMBER"), (1, "EMAIL")]
    assert got[2].normalized_value == CARD.replace(" ", "") and [r.confidence for r in got[:2]] == [0.99, 0.95]
    by = {r.doc_id: r.text for r in t.collect()}
    assert all(by[r.doc_id][r.start : r.end].strip() == r.value for r in got)


def test_rows_that_share_a_key_stay_apart(spark):
    rows = [(1, "to a@b.example"), (1, "a@b.example and c@d.example"), (1, "to a@b.example"), (None, "x a@b.example")]
    t = spark.createDataFrame(rows, "doc_id int, text string")
    assert sorted((str(r.doc_id), r.start) for r in detect.detect(t, ["doc_id"]).collect()) == [("1", 0), ("1", 3), ("1", 3), ("1", 16), ("None", 2)]
    assert sorted(r.redacted for r in redact.redact_rules(t).collect()) == ["*@*.example and *@*.example", "to *@*.example", "to *@*.example", "x *@*.example"]
    plan = redact.redact_rules(t)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_patterns_as_unicode_regex(spark):
    """Seeded strings around every pattern's alphabet: the native patterns equal Unicode-aware matching."""
    import random

    r = random.Random(7)
    parts = ["0532", "532", " 123", "-45", "67", "+90", "TR", "tr", "12", "1234", " ", "\u00a0", "\x1c", "\u0661", "a", "é", "\u0301", "_", "4111", "1111", "@", "x.y", ".com", "\u212a", "\u0131", "10000000146", "😀", "\n"]
    rows = ["".join(r.choice(parts) for _ in range(r.randint(2, 14))) for _ in range(3000)]
    want = {
        "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
        "TCKN": r"(?<!\d)[1-9]\d{10}(?!\d)",
        "CARD_NUMBER": r"(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)",
        "IBAN": r"(?<![A-Z0-9])TR\d{2}(?:\s?\d{4}){5}\s?\d{2}(?![A-Z0-9])",
        "PHONE": r"(?<!\d)(?:\+90|0090|0)?[\s-]?5\d{2}[\s-]?\d{3}[\s-]?\d{2}[\s-]?\d{2}(?!\d)",
    }
    found = detect.candidates(texts(spark, *rows), ["doc_id"]).collect()
    got = {(x.doc_id, detect.DETECTORS[x.detector_ord].type, x.start, x.end) for x in found}
    assert got == {(i, k, m.start(), m.end()) for i, t in enumerate(rows) for k, p in want.items() for m in re.finditer(p, t, re.I if k == "IBAN" else 0)}


def test_redaction(spark):
    t = texts(spark, "Yaz: deniz.kaya@posta.example.org, 😀 ara 0555 987 65 43!", "clean", None)
    want = {0: "Yaz: d********a@p***a.e*****e.org, 😀 ara 0*** *** ** *3!", 1: "clean", 2: None}
    assert {r.doc_id: r.redacted for r in redact.redact(t, detect.detect(t, ["doc_id"])).collect()} == want
    assert {r.doc_id: r.redacted for r in redact.redact_rules(t).collect()} == want
    spans = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(m).alias("mask")) for a, b, m in ((2, 6, "c**f"), (4, 8, "**gh"), (9, 10, "*"))))
    assert spark.range(1).select(redact.lay_over(F.lit("abcdefghij"), spans)).first()[0] == "abc***ghi*"
    both = [(0, "55598765432", 0, 11, "TCKN"), (0, "55598765432", 0, 11, "PHONE")]
    f = spark.createDataFrame(both, "doc_id int, value string, start int, end int, type string")
    assert redact.redact(texts(spark, "55598765432"), f).first().redacted == "*" * 11


def test_rows_and_cells(spark):
    cells = spark.createDataFrame([("s", 1, 1, "Kod"), ("s", 1, 2, None), ("s", 1, 3, "Tutar"), ("s", 2, 1, ""), ("s", 5, 2, "Toplam")], "page string, row int, col int, cell_text string")
    text = layout.page_text(cells, ["page"], "row", "col").first().text
    assert text == "Kod | Tutar\nToplam"
    assert all(text[r.start : r.end] == r.cell_text for r in layout.line_offsets(cells, ["page"], "row", "col").collect())
    two = layout.line_offsets(spark.createDataFrame([("s", 1, 1, "Merhaba"), ("s", 1, 2, "dost")], "page string, row int, col int, cell_text string"), ["page"], "row", "col")
    f = spark.createDataFrame([("s", "PERSON", "haba | dos", 3, 13)], "page string, type string, value string, start int, end int")
    located = layout.part_masks(layout.locate(redact.masked(f), two, ["page"], "cell_text"))
    new = layout.cell_masks(located, ["page", "row", "col"]).orderBy("col").collect()
    assert [(r.new_text, r.matches) for r in new] == [("Merh**a", 1), ("d*st", 1)]


def test_long_findings_meet_each_part_once(spark):
    parts = spark.createDataFrame([(1, i, i * 700, i * 700 + 699) for i in range(30)] + [(1, 99, 5, 5), (2, 0, 0, 50)], "page int, part int, start int, end int")
    found = spark.createDataFrame([(1, 0, 650, 15_000), (1, 1, 1023, 1025), (1, 2, 699, 700), (1, 3, 5, 5), (2, 4, 49, 9000)], "page int, f int, start int, end int")
    got = layout.locate(found, parts.withColumn("text", F.repeat(F.lit("x"), 699)), ["page"]).collect()
    want = sorted((f, p) for pg, f, a, b in [tuple(r) for r in found.collect()] for q, p, c, d in [tuple(r) for r in parts.collect()] if pg == q and max(a, c) < min(b, d))
    assert sorted((r.f, r.part) for r in got) == want and len(want) > 20


def test_whole_cells(spark, tmp_path):
    from maskline.plans import catalogue

    texts = ["a" * 500, "b" * 30 + "😀" + "c" * 1900, "", "d" * 700]
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    text = catalogue.sheet_text_whole(spark, str(tmp_path)).first().text
    assert text == f"user | {texts[0]} | 0\nuser | {texts[1]}\nuser | 2\nuser | {texts[3]}"
    placed = {(r.row, r.column_no): text[r.start : r.end] for r in catalogue.cell_offsets_whole(spark, str(tmp_path)).collect()}
    assert all(placed.get((i, 1), "") == t for i, t in enumerate(texts)) and len(placed) == 9
    for r in catalogue.cell_matches_whole(spark, str(tmp_path)).collect():
        assert r.matched_text == placed[r.row, r.column_no][r.match_start : r.match_end] and r.mask_slice == "*" * len(r.matched_text)


def test_regions(spark):
    r = spark.createDataFrame([(1, 0, 0, 5, 0.0), (1, 1, 5, 12, 9.0)], "page int, region_ord int, start int, end int, x double").select("page", "region_ord", "start", "end", regions.bbox(F.col("x"), F.lit(0), F.col("x") + 5, F.lit(1)).alias("bbox"))
    f = spark.createDataFrame([(1, 0, 3, 12)], "page int, finding int, start int, end int")
    got = regions.region_boxes(f, r, ["page"], ["finding"]).orderBy("box_ord").collect()
    assert [(x.box_start, x.box_end) for x in got] == [(0, 2), (2, 9)]


def test_entities(spark):
    pages = spark.createDataFrame([(1, "Deniz  Kaya Bursa Deniz")], "page int, text string")
    model = lambda: lambda text: [dict(zip(("entity_group", "score", "start", "end"), x)) for x in (("PER", 0.9, 0, 5), ("PER", 0.8, 7, 11), ("LOC", 0.95, 12, 17), ("PER", 0.7, 18, 23))]
    got = ner.merge(ner.predict(pages, ["page"], model), pages, ["page"])
    assert [(r.type, r.value, r.confidence) for r in got.orderBy("start").collect()] == [("PERSON", "Deniz  Kaya", 0.8), ("LOCATION", "Bursa", 0.95), ("PERSON", "Deniz", 0.7)]
    rules = detect.detect(pages, ["page"])
    assert policy.union_findings(rules, got).count() == 3 and policy.union_findings(rules, got, include_model=False).count() == 0


def test_analyze(spark):
    rows = [(7, 2, f"card {CARD} mail x@y.example"), (7, 1, "mail z@y.example"), (7, 3, None), (8, 1, "clean")]
    got = {r.doc_id: r for r in analyze.analyze(spark.createDataFrame(rows, "doc_id int, page_number int, text string")).collect()}
    assert (got[7].status, got[7].page_count, got[7].finding_count) == ("analyzed", 3, 3) and (got[8].page_count, got[8].finding_count, got[8].findings) == (1, 0, [])
    assert [(f.page_number, f.type, f.finding_id.split(":")[0], f.redaction_action) for f in got[7].findings] == [(1, "EMAIL", "1", "AUTO_REDACT"), (2, "CARD_NUMBER", "2", "AUTO_REDACT"), (2, "EMAIL", "2", "AUTO_REDACT")]


def test_redaction_plan(spark):
    found = spark.createDataFrame([(1, 1, 0, "PERSON", "Deniz Kaya"), (1, 9, 1, "PERSON", "Er"), (1, 0, 2, "PERSON", "Er")], "doc int, page int, f int, type string, value string")
    boxes = spark.createDataFrame([(1, 1, 0, 0.0, 30.0, 0, 6), (1, 1, 0, 40.0, 41.5, 6, 10), (1, 1, 0, 50.0, 90.0, 6, 99), (1, 9, 1, 0.0, 9.0, 0, 2), (1, 0, 2, 0.0, 9.0, 0, 2)], "doc int, page int, f int, x0 double, x1 double, box_start int, box_end int").withColumns({"y0": F.lit(0.0), "y1": F.lit(10.0)})
    counts = spark.createDataFrame([(1, 3)], "doc int, page_count int")
    got = regions.redaction_plan(boxes, found, counts, "doc", "page", ["f"]).orderBy("x0").collect()
    assert [(r.segment, r.drawn, r.text_x0, r.text_x1) for r in got] == [("D***z ", True, 1.0, 29.0), ("K**a", False, 41.0, 40.5), ("*" * 10, True, 51.0, 89.0)]


def test_ocr_text(spark):
    rows = [(1, 0, 0, 0, "Fatura"), (1, 0, 0, 1, " no"), (1, 0, 1, 0, ""), (1, 0, 2, 0, "42"), (1, 1, 2, 0, "son"), (2, 0, 0, 0, "")]
    spans = spark.createDataFrame(rows, "page int, block int, line int, span_ord int, text string")
    assert [tuple(r) for r in regions.ocr_text(spans, ["page"]).collect()] == [(1, "Fatura no\n42\nson\n")]
    laid = regions.ocr_layout(spans, ["page"]).orderBy("start").collect()
    assert all("Fatura no\n42\nson\n"[r.start : r.end] == r.text for r in laid) and len(laid) == 4


def test_evaluation(spark):
    gold = spark.createDataFrame([(1, "PERSON", "Ece  Tan."), (1, "LOCATION", "Rize")], "sample_id int, type string, value string")
    made = spark.createDataFrame([(1, "PERSON", " Ece Tan", 0.8, 0), (1, "PERSON", "Naz", 0.45, 1)], "sample_id int, type string, value string, confidence double, ord int")
    c = evaluate.compare(gold, made)
    rows = {r.threshold: (r.tp, r.fp, r.fn) for r in evaluate.sweep(c).collect()}
    assert rows[0.0] == (1, 1, 1) and rows[0.5] == (1, 0, 1) and rows[0.9] == (0, 0, 2)
    assert evaluate.best(evaluate.sweep(c)).first().threshold == 0.8
    assert sorted((r.value, r.error) for r in evaluate.errors(c, made, 0.4).collect()) == [("Naz", "FP"), ("Rize", "FN")]


def test_files(spark):
    doc = office.make_docx([["Posta: deniz@po", "sta.example.org"], [], [[[["Kod"]], [[""]], [["x"], ["y"]]]], ["bitti"]])
    book = office.make_xlsx({"S1": [["Kod", None, "Tutar"], [7, 2.5, False, dt.datetime(2021, 3, 4, 5, 6, 7)]], "S2": [[("B1", "Deniz Kaya"), ("A1", None)]], "S3": []})
    files = spark.createDataFrame([("d", doc), ("empty", office.make_docx([])), ("bad", b"PK"), ("other", book)], "doc_id string, content binary")
    runs = office.docx_layout(office.parse_docx(files))
    text = "Posta: deniz@posta.example.org\nKod | x\ny\nbitti"
    assert [(r.text, text[r.start : r.end]) for r in runs.orderBy("start").collect()] == [(x, x) for x in ("Posta: deniz@po", "sta.example.org", "Kod", "x", "y", "bitti")]
    assert {r.doc_id: r.text for r in office.docx_text(office.parse_docx(files), files).collect()} == {"d": text, "empty": ""}
    assert sorted((r.doc_id, r.http_code) for r in office.errors(files, "docx").collect()) == [("bad", 422), ("other", 422)]
    books = spark.createDataFrame([("b", book)], "doc_id string, content binary")
    cells = office.parse_xlsx(books)
    assert sorted((r.sheet_name, r.coordinate, r.cell_text) for r in cells.collect()) == [("S1", "A1", "Kod"), ("S1", "A2", "7"), ("S1", "B2", "2.5"), ("S1", "C1", "Tutar"), ("S1", "C2", "False"), ("S1", "D2", "2021-03-04 05:06:07"), ("S2", "A1", "Deniz Kaya"), ("S2", "B1", "")]
    new = office.redact_files(books, cells.where("coordinate = 'A1' and sheet_name = 'S2'").withColumn("new_text", F.lit("D***z <&> K**a")), "xlsx")
    again = office.parse_xlsx(new).where("sheet_name = 'S2' and coordinate = 'A1'").first()
    assert again.cell_text == "D***z <&> K**a" and not again.is_formula and office.parse_xlsx(new).where("is_formula").count() == 1
    changed = office.redact_files(files.where("doc_id = 'd'"), office.parse_docx(files).where("text = 'bitti'").withColumn("new_text", F.lit("b\t**\ni")), "docx")
    assert [r.text for r in office.parse_docx(changed).where("paragraph_index = 2").collect()] == ["b\t**\ni"]
    parsed = {r.doc_id: r for r in api.extract_text(files.where("doc_id in ('d', 'empty')"), "docx").collect()}
    assert parsed["d"].pages[0].text == text and parsed["empty"].page_count == 1
    sheets = api.extract_text(books, "xlsx").first()
    assert sheets.page_count == 3 and [p.text for p in sheets.pages] == ["Kod | Tutar\n7 | 2.5 | False | 2021-03-04 05:06:07", "Deniz Kaya", ""]


def _archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, raw in parts.items():
            z.writestr(name, raw)
    return out.getvalue()


def test_every_other_byte_of_a_file_stays():
    w = office.W[1:-1]
    head = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\r\n<w:document xmlns:w="{w}" xmlns:mc="urn:mc" xmlns:w14="urn:w14" mc:Ignorable="w14"><!-- > kept --><w:body>'
    run = lambda inner: f'<w:p w14:id="a>b"><w:r><w:rPr><w:b/></w:rPr>{inner}</w:r></w:p>'
    tail = "</w:body></w:document>"
    old = head + run("<w:t>bir</w:t>") + run("<w:t>iki</w:t><w:tab/><w:t xml:space='preserve'> üç</w:t>") + tail
    new = office.write_docx(_archive({"word/document.xml": old, "x.bin": b"raw"}), {("paragraph", 1, 1, None, None, None, None, 0): "*&*"})
    with zipfile.ZipFile(io.BytesIO(new)) as z:
        assert z.read("word/document.xml").decode() == head + run("<w:t>bir</w:t>") + run('<w:t xml:space="preserve">*&amp;*</w:t>') + tail and z.read("x.bin") == b"raw"


def test_a_formula_goes_with_its_place_in_the_order_of_calculation():
    s, r = office.S[1:-1], office.R[1:-1]
    parts = {
        "[Content_Types].xml": '<Types><Override PartName="/xl/calcChain.xml" ContentType="c"/><Override PartName="/xl/workbook.xml" ContentType="w"/></Types>',
        "xl/workbook.xml": f'<workbook xmlns="{s}" xmlns:r="{r}"><workbookPr date1904="1"/><sheets><sheet name="T" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/><Relationship Id="r2" Target="calcChain.xml"/></Relationships>',
        "xl/calcChain.xml": "<calcChain/>",
        "xl/styles.xml": f'<styleSheet xmlns="{s}"><numFmts><numFmt numFmtId="170" formatCode="[h]:mm"/><numFmt numFmtId="171" formatCode="0.0&quot; days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/><xf numFmtId="20"/></cellXfs></styleSheet>',
        "xl/worksheets/s.xml": f'<x:worksheet xmlns:x="{s}"><x:sheetData><x:row r="1"><x:c r="A1" s="1" t="n"><x:f>1+1</x:f><x:v>2</x:v></x:c><x:c r="B1" s="2"><x:v>1.5</x:v></x:c><x:c r="C1" s="3"><x:v>2.5</x:v></x:c><x:c r="D1" s="4"><x:v>0.25</x:v></x:c></x:row></x:sheetData></x:worksheet>',
    }
    raw = _archive(parts)
    assert [(c[4], c[5], c[6]) for c in office.xlsx_cells(raw)] == [("A1", "1904-01-03 00:00:00", True), ("B1", "1 day, 12:00:00", False), ("C1", "2.5", False), ("D1", "06:00:00", False)]
    new = office.write_xlsx(raw, {("T", "A1"): "**"})
    with zipfile.ZipFile(io.BytesIO(new)) as z:
        assert "xl/calcChain.xml" not in z.namelist() and "calcChain" not in z.read("[Content_Types].xml").decode() + z.read("xl/_rels/workbook.xml.rels").decode()
        assert '<x:c r="A1" s="1" t="inlineStr"><x:is><x:t xml:space="preserve">**</x:t></x:is></x:c><x:c r="B1" s="2">' in z.read("xl/worksheets/s.xml").decode()
    assert [(c[4], c[5], c[6]) for c in office.xlsx_cells(new)][0] == ("A1", "**", False)


def test_shared_formulas():
    assert office._moved("SUM(A1:$B2)+C$3&\"A1\"&'A1'!D4+LOG10(AA9)", 2, 1) == "SUM(B3:$B4)+D$3&\"A1\"&'A1'!E6+LOG10(AB11)"
    s, r = office.S[1:-1], office.R[1:-1]
    cell = lambda at, f: f'<c r="{at}"><f t="shared" si="0"{f}<v>1</v></c>'
    raw = _archive({
        "xl/workbook.xml": f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="T" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>',
        "xl/worksheets/s.xml": f'<worksheet xmlns="{s}"><sheetData><row r="1">{cell("C1", ">A1*$B$1</f>")}</row><row r="2">{cell("C2", "/>")}{cell("D2", "/>")}</row></sheetData></worksheet>',
    })
    assert [c[7] for c in office.xlsx_cells(raw)] == ["=A1*$B$1", "=A2*$B$1", "=B2*$B$1"]


def test_pdf_pages_of_any_parser(spark):
    import json

    def load():
        def read(raw):
            return json.loads(raw)

        return read

    box = {"x0": 0.0, "y0": 0.0, "x1": 100.0, "y1": 100.0}
    span = lambda line, font, text, x=0.0: {"block": 0, "line": line, "font": font, "chars": list(text), "x0": x, "y0": 0.0, "x1": x + 10, "y1": 10.0}
    scan = "GlyphLessFont"
    doc = [
        {"text": "Yerli metin", "rect": box},
        {"text": " ", "rect": box, "spans": [span(0, scan, "Taranan"), span(0, scan, " satir", 20.0), span(1, scan, ""), span(2, scan, "son")]},
        {"text": "Baslik", "rect": box, "images": [box], "spans": [span(0, "Serif", "Baslik"), span(1, scan, "baslik"), span(2, scan, "x@y.example", 50.0)]},
    ]
    files = spark.createDataFrame([("1", bytearray(json.dumps(doc).encode())), ("2", bytearray(b"?"))], "doc_id string, content binary")
    parsed = pdf.parse(files, load)
    got = [(r.page_number, r.text_source, r.text) for r in pdf.page_texts(pdf.readable(parsed)).orderBy("page_number").collect()]
    assert got == [(1, "native", "Yerli metin"), (2, "ocr", "Taranan satir\nson\n"), (3, "hybrid", "Baslik\n|\nx@y.example")]
    assert [(r.doc_id, r.http_code) for r in pdf.errors(parsed).collect()] == [("2", 422)]


def test_page_class_adds_words_in_their_order(spark):
    box = lambda *sides: dict(zip(regions.SIDES, map(float, sides), strict=True))
    kind = "struct<x0:double,y0:double,x1:double,y1:double>"
    # Areas that make 0.05 of the image: the class depends on the order in which they are added.
    orders = list(itertools.permutations((n * 3, 1, n * 3 + q / 10, 20) for n, q in ((3, 19), (7, 17), (1, 17), (5, 47))))
    totals = [functools.reduce(lambda a, w: a + (w[2] - w[0]) * 19, o, 0.0) for o in orders]
    want = ["hybrid" if t / 3800 < 0.05 else "native" for t in totals]
    pages = spark.createDataFrame([(i, "a", box(0, 0, 100, 100)) for i in range(len(orders))], f"page int, text string, rect {kind}")
    images = spark.createDataFrame([(i, 1, box(0, 0, 76, 50)) for i in range(len(orders))], f"page int, image_ord int, bbox {kind}")
    rows = [(i, k, box(*w)) for i, o in enumerate(orders) for k, w in enumerate(o)]
    assert set(want) == {"hybrid", "native"}
    for arriving in (rows, rows[::-1]):
        words = spark.createDataFrame(arriving, f"page int, word_ord int, bbox {kind}").coalesce(1)
        assert [r.page_class for r in regions.classify_pages(pages, images, words, ["page"]).orderBy("page").collect()] == want


def test_page_class_equals_its_sql_where_the_order_of_adding_decides(spark, tmp_path):
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    lines = [o for n, m in itertools.product(range(3, 8), range(4, 8)) for o in itertools.permutations([(1, 38.0), (3, 12.0), (n, 17.0), (m, 33.0)])]
    table = lambda rows, names: pa.table(dict(zip(names, zip(*rows, strict=True), strict=True)))
    names = ["l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey", "l_extendedprice"]
    (tmp_path / "orders.parquet").mkdir()
    (tmp_path / "lineitem.parquet").mkdir()
    pq.write_table(table([(i, "2-HIGH") for i in range(len(lines))], ["o_orderkey", "o_orderpriority"]), tmp_path / "orders.parquet" / "0.parquet")
    for part in (0, 1):
        rows = [(i, n, q, k, 1, 1.0) for i, o in enumerate(lines) for k, (n, q) in enumerate(o) if (k > 0) == part]
        pq.write_table(table(rows, names), tmp_path / "lineitem.parquet" / f"{part}.parquet")
    con = duckdb.connect()
    con.execute("set threads = 1")
    for t in ("orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(con.execute(catalogue.oracle_sql()["page_class"]).fetchall())
    got = sorted(tuple(r) for r in catalogue.queries()["page_class"](spark, str(tmp_path)).collect())
    assert got == want and {c for _, c in want} == {"hybrid", "native", "ocr"}


def test_files_are_redacted_end_to_end(spark):
    doc = office.make_docx([["Posta: deniz@po", "sta.example.org", " ok"], [[[["Kart"]], [[CARD]]]]])
    book = office.make_xlsx({"S": [["a", ("LOWER(A1)", "deniz@posta.example.org")], [CARD, ("1+1", 2)]]})
    docs = spark.createDataFrame([("1", doc), ("2", office.make_docx([["clean"]]))], "doc_id string, content binary")
    got = {r.doc_id: [x.text for x in r.pages] for r in api.extract_text(api.redacted(docs, "docx"), "docx").collect()}
    assert got == {"1": ["Posta: d***z@p***a.e*****e.org ok\nKart | 5*** **** **** ***4"], "2": ["clean"]}
    books = spark.createDataFrame([("1", book)], "doc_id string, content binary")
    done = api.redacted(books, "xlsx")
    assert api.extract_text(done, "xlsx").first().pages[0].text == "a | d***z@p***a.e*****e.org\n5*** **** **** ***4 | 2"
    assert [(r.coordinate, r.formula) for r in office.parse_xlsx(done).where("is_formula").collect()] == [("B2", "=1+1")]
    assert api.analyze(books, "xlsx").first().finding_count == 2


def test_gold_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"text": "Deniz Bursa\'da", "entities": [{"type": "PERSON", "value": "Deniz"}, {"type": "LOCATION", "value": "Bursa"}]},\n {"text": "yok", "entities": []}]')
    got = sorted((r.sample, r.text, r.type, r.value) for r in evaluate.read_gold(spark, str(tmp_path)).where("type is not null").collect())
    assert got == [(0, "Deniz Bursa'da", "LOCATION", "Bursa"), (0, "Deniz Bursa'da", "PERSON", "Deniz")]
    assert evaluate.read_gold(spark, str(tmp_path)).where("type is null").first().text == "yok"


def test_uploads(spark, tmp_path):
    (tmp_path / "one.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "two.docx").write_bytes(office.make_docx([["x"]]))
    assert {r.filename: r.size_bytes for r in ingest.read_files(spark, str(tmp_path)).collect()}["one.pdf"] == 8
    stream = ingest.stream_files(spark, str(tmp_path))
    stream.drop("content").writeStream.format("parquet").option("path", f"{tmp_path}/.out").option("checkpointLocation", f"{tmp_path}/.state").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.filename for r in spark.read.parquet(f"{tmp_path}/.out").collect()) == ["one.pdf", "two.docx"]
    chunks = spark.createDataFrame([("a", 0, 6), ("a", 1, 4), ("b", 0, 6), ("b", 1, 5), ("b", 2, 9)], "upload string, chunk int, n_bytes int")
    got = {r.upload: (r.bytes_read, r.chunks_read, r.accepted) for r in ingest.account(chunks, limit=10).collect()}
    assert got == {"a": (10, 2, True), "b": (11, 2, False)}
    judged = api.ingested(ingest.read_files(spark, str(tmp_path)).withColumn("content_type", F.lit("application/pdf")))
    assert {r.filename: r.ingest_status for r in judged.collect()} == {"one.pdf": "uploaded", "two.docx": "uploaded"} and ingest.receipts(judged).count() == 2


def test_gate(spark):
    doc = office.make_docx([["x"]])
    pdf = "application/pdf"
    rows = [("", pdf, 1, b""), ("a.exe", pdf, 1, b""), ("a.pdf", "x/y", 1, b""), ("a.pdf", pdf, ingest.MAX_FILE + 1, b"%PDF-1"), ("a.pdf", pdf, ingest.MAX_FILE, b"%PDF-1"), ("a.docx", pdf, 1, doc), ("a.xlsx", pdf, 1, doc), ("a.docx", pdf, 1, b"PK")]
    files = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, filename string, content_type string, size_bytes long, content binary")
    got = [r.ingest_status for r in ingest.gate(ingest.with_entries(files)).orderBy("id").collect()]
    assert got == ["no_filename", "bad_extension", "bad_type", "too_large", "uploaded", "uploaded", "content_mismatch", "content_mismatch"]
    entry = lambda **k: F.array(F.struct(*(F.lit(v).alias(n) for n, v in ({"name": "a", "file_size": 100, "compress_size": 1, "flag_bits": 0} | k).items())))
    safe = lambda e: spark.range(1).select(ingest.is_safe_archive(e)).first()[0]
    assert safe(entry()) and not safe(entry(file_size=101)) and not safe(entry(flag_bits=1)) and not safe(entry(compress_size=0)) and not safe(entry(name="../a"))


def test_retention(spark, tmp_path):
    t0 = dt.datetime(2026, 1, 1)
    rows = [("old", t0), ("kept", t0), ("kept", t0 + dt.timedelta(seconds=3000)), ("edge", t0 + dt.timedelta(seconds=400))]
    touches = spark.createDataFrame(rows, "doc_id string, ts timestamp")
    now = F.lit(t0 + dt.timedelta(seconds=4000))
    assert sorted(r.doc_id for r in retention.stale(touches, now).collect()) == ["edge", "old"]
    late = spark.createDataFrame([("new", t0 + dt.timedelta(hours=5))], "doc_id string, ts timestamp")
    for part in (touches, late, late.withColumn("ts", F.col("ts") + F.expr("interval 1 minute"))):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(touches.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    retention.run_sweeps(retention.expire_stream(stream), f"{tmp_path}/out", f"{tmp_path}/state", once=True).awaitTermination()
    assert sorted(r.doc_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["edge", "kept", "old"]


def test_downloads_close_documents(spark, tmp_path):
    t0 = dt.datetime(2026, 5, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    rows = [("down", at(0), False), ("down", at(10), True), ("old", at(0), False), ("fresh", at(9000), False)]
    touches = spark.createDataFrame(rows, "doc_id string, ts timestamp, closes boolean")
    for part in (touches, touches.where("doc_id = 'fresh'").withColumn("ts", F.col("ts") + F.expr("interval 1 minute"))):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(touches.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    retention.run_sweeps(retention.close_stream(stream), f"{tmp_path}/out", f"{tmp_path}/state", once=True).awaitTermination()
    assert sorted((r.doc_id, r.reason) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("down", "downloaded"), ("old", "expired")]
    names = spark.createDataFrame([("0f8fad5b-d9cb-469f-a165-70867728950e", t0), ("notes", t0)], "doc_id string, ts timestamp")
    assert retention.deleted_count(retention.sweep(names, F.lit(at(3600)))).first().deleted_count == 1


def test_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "detect_all_enriched" in e.queries()
