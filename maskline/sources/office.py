"""DOCX and XLSX files to tables of runs and cells, and masked tables back into files.

Files are archives of XML; each is parsed in the task that holds its row. What can't be parsed gives no
rows; errors() names it. A file is written again by cutting the changed texts out of its XML and putting
the new ones in their place: every other byte, declarations among them, stays.
"""

from __future__ import annotations

import datetime as dt
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from io import BytesIO
from xml.etree import ElementTree as ET
from xml.parsers import expat
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
RUNS = "doc_id string, kind string, block int, paragraph_index int, table_index int, row_index int, cell_index int, cell_paragraph int, run_index int, text string"
SHEETS = "doc_id string, page_number int, sheet_name string"
#: Columns that tell a run of a file.
ADDRESS = ("kind", "block", "paragraph_index", "table_index", "row_index", "cell_index", "cell_paragraph", "run_index")
#: What a broken file raises: no archive, a missing or malformed part, a reference to nothing.
UNREADABLE = (zipfile.BadZipFile, zlib.error, ET.ParseError, expat.ExpatError, KeyError, IndexError, ValueError, AttributeError, TypeError, EOFError, NotImplementedError, RuntimeError)
# Number formats of dates and times by their number, and the days that serial numbers count from.
DATE_FORMATS = {14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0"}
EPOCH, EPOCH_1904 = dt.datetime(1899, 12, 30), dt.datetime(1904, 1, 1)
CELLS = "doc_id string, page_number int, sheet_name string, row int, column int, coordinate string, cell_text string, is_formula boolean, formula string"


def _run_text(run: ET.Element) -> str:
    out = []
    for x in run:
        if x.tag == f"{W}t":
            out.append(x.text or "")
        elif x.tag == f"{W}tab":
            out.append("\t")
        elif x.tag in (f"{W}br", f"{W}cr"):
            out.append("\n")
    return "".join(out)


def _runs(paragraph: ET.Element) -> list[ET.Element]:
    """Runs in order, those of hyperlinks with them."""
    return [r for x in paragraph for r in ([x] if x.tag == f"{W}r" else x.findall(f"{W}r") if x.tag == f"{W}hyperlink" else [])]


def _walk(body: ET.Element) -> Iterator[tuple[tuple, ET.Element]]:
    """((kind, block, paragraph, table, row, cell, cell paragraph, run), run element) in document order."""
    paragraphs = tables = 0
    for block, x in enumerate(body):
        if x.tag == f"{W}p":
            for i, r in enumerate(_runs(x)):
                yield ("paragraph", block, paragraphs, None, None, None, None, i), r
            paragraphs += 1
        elif x.tag == f"{W}tbl":
            for j, row in enumerate(x.findall(f"{W}tr")):
                for k, cell in enumerate(row.findall(f"{W}tc")):
                    for p, paragraph in enumerate(cell.findall(f"{W}p")):
                        for i, r in enumerate(_runs(paragraph)):
                            yield ("table_cell", block, None, tables, j, k, p, i), r
            tables += 1


def docx_runs(raw: bytes) -> list[tuple]:
    with zipfile.ZipFile(BytesIO(raw)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{W}body")
    return [(*at, _run_text(r)) for at, r in _walk(body)]


def _number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def _letters(n: int) -> str:
    return _letters((n - 1) // 26) + chr(65 + (n - 1) % 26) if n > 0 else ""


def _moved(formula: str, rows: int, columns: int) -> str:
    """A formula as it reads so many rows and columns further on; quoted names and texts stay."""
    def to(m: re.Match) -> str:
        fixed_column, letters, fixed_row, row = m.groups()
        return f"{fixed_column}{letters if fixed_column else _letters(_number(letters) + columns)}{fixed_row}{row if fixed_row else int(row) + rows}"

    parts = re.split(r"(\"[^\"]*\"|'[^']*')", formula)
    return "".join(x if i % 2 else re.sub(r"(?<![A-Za-z0-9_.$])(\$?)([A-Z]{1,3})(\$?)(\d+)(?![A-Za-z0-9_(.])", to, x) for i, x in enumerate(parts))


def _time_kind(code: str) -> str:
    """'span' for a format of elapsed time, 'date' for one of dates or times of day, else ''."""
    first = code.split(";")[0]
    if re.search(r"\[(h+|m+|s+)\]", first, re.I):
        return "span"
    shown = re.sub(r'"[^"]*"|\[[^\]]*\]|[\\_*].', "", first)
    return "date" if re.search("[dmhys]", shown, re.I) and shown.lower() != "general" else ""


def _formats(z: zipfile.ZipFile) -> list[str]:
    """For each cell style its kind of time."""
    if "xl/styles.xml" not in z.namelist():
        return []
    root = ET.fromstring(z.read("xl/styles.xml"))
    codes = DATE_FORMATS | {int(x.get("numFmtId")): x.get("formatCode") or "" for x in root.iter(f"{S}numFmt")}
    styles = root.find(f"{S}cellXfs")
    return [] if styles is None else [_time_kind(codes.get(int(x.get("numFmtId") or 0), "")) for x in styles.findall(f"{S}xf")]


def _moment(days: float, kind: str, epoch: dt.datetime) -> str:
    """A serial number as a date with its time, a time of day, or a span, to the millisecond."""
    whole, part = divmod(days, 1)
    rest = dt.timedelta(milliseconds=round(part * 86_400_000))
    if kind == "span":
        return str(dt.timedelta(days=whole) + rest)
    if 0 <= days < 1 and not rest.days:
        return str((dt.datetime.min + rest).time())
    if 0 < days < 60 and epoch == EPOCH:
        whole += 1  # the count has a day that 1900 had not
    return str(epoch + dt.timedelta(days=whole) + rest)


def _value(cell: ET.Element, strings: list[str], formats: list[str] = (), epoch: dt.datetime = EPOCH) -> str:
    kind, v = cell.get("t", "n"), cell.find(f"{S}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{S}t"))
    if v is None or v.text is None:
        return ""
    if kind == "s":
        return strings[int(v.text)]
    if kind == "b":
        return "True" if v.text == "1" else "False"
    if kind == "n":
        x, style = float(v.text), int(cell.get("s") or 0)
        if style < len(formats) and formats[style]:
            return _moment(x, formats[style], epoch)
        return str(int(x)) if x.is_integer() and not re.search("[.eE]", v.text) else str(x)
    return v.text


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, path) of each sheet in the workbook's order."""
    book = ET.fromstring(z.read("xl/workbook.xml"))
    links = {x.get("Id"): x.get("Target") for x in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    path = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
    return [(s.get("name"), path(links[s.get(f"{R}id")])) for s in book.iter(f"{S}sheet")]


def xlsx_cells(raw: bytes) -> list[tuple]:
    with zipfile.ZipFile(BytesIO(raw)) as z:
        strings = []
        if "xl/sharedStrings.xml" in z.namelist():
            strings = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{S}si")]
        formats = _formats(z)
        old = ET.fromstring(z.read("xl/workbook.xml")).find(f"{S}workbookPr")
        epoch = EPOCH_1904 if old is not None and old.get("date1904") in ("1", "true") else EPOCH
        rows = []
        for n, (name, path) in enumerate(_sheets(z), 1):
            shared: dict[str, tuple[str, int, int]] = {}
            for c in ET.fromstring(z.read(path)).iter(f"{S}c"):
                at, f, text = c.get("r"), c.find(f"{S}f"), _value(c, strings, formats, epoch)
                letters, row = re.fullmatch(r"([A-Z]+)(\d+)", at).groups()
                row, column, formula = int(row), _number(letters), None
                if f is not None:
                    formula = f.text or ""
                    if f.get("t") == "shared":  # the first cell of a range has the formula, the others its number
                        first = shared.setdefault(f.get("si"), (formula, row, column))
                        formula = formula or _moved(first[0], row - first[1], column - first[2])
                if text or f is not None:
                    rows.append((n, name, row, column, at, text, f is not None, None if f is None else "=" + formula))
    return rows


def xlsx_sheets(raw: bytes) -> list[tuple]:
    with zipfile.ZipFile(BytesIO(raw)) as z:
        return [(n, name) for n, (name, _) in enumerate(_sheets(z), 1)]


def _parse(files: DataFrame, read: Callable[[bytes], list[tuple]], schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, raw in zip(batch["doc_id"], batch["content"], strict=True):
                try:
                    rows = read(raw)
                except UNREADABLE:  # a broken file is a row of errors(), not a failed job
                    continue
                yield pd.DataFrame([(key, *r) for r in rows], columns=names).astype({n: "Int32" for n, t in (x.split() for x in schema.split(", ")) if t == "int"})

    return files.select("doc_id", "content").mapInPandas(run, schema)


def parse_docx(files: DataFrame) -> DataFrame:
    """Runs of files (doc_id, content): body paragraphs and table cells in order, nothing nested."""
    return _parse(files, docx_runs, RUNS)


def parse_xlsx(files: DataFrame) -> DataFrame:
    """Cells with cached values; a formula without one has an empty text."""
    return _parse(files, xlsx_cells, CELLS)


def parse_sheets(files: DataFrame) -> DataFrame:
    """The sheets of files, those without a cell too."""
    return _parse(files, xlsx_sheets, SHEETS)


def errors(files: DataFrame, kind: str) -> DataFrame:
    """(doc_id, http_code, status, message) of files that can't be read, as status 422; an empty document can."""
    read = docx_runs if kind == "docx" else xlsx_cells

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bad = []
            for key, raw in zip(batch["doc_id"], batch["content"], strict=True):
                try:
                    read(raw)
                except UNREADABLE as e:
                    bad.append((key, 422, "parse_error", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(bad, columns=["doc_id", "http_code", "status", "message"])

    return files.select("doc_id", "content").mapInPandas(run, "doc_id string, http_code int, status string, message string")


def _laid(runs: DataFrame) -> DataFrame:
    """Runs of paragraphs and cells with text, with what stands before each, start and end in the document's text."""
    doc, line = ["doc_id"], ["doc_id", "block", F.coalesce("row_index", F.lit(0))]
    cell = [*line, F.coalesce("cell_index", F.lit(0))]
    r = runs.withColumn("paragraph", F.coalesce("cell_paragraph", F.lit(0)))
    # paragraphs of a cell keep their line breaks even where they are empty, if the cell has any text
    inside = Window.partitionBy(*cell).orderBy("paragraph", "run_index")
    has = F.max(F.length("text")).over(Window.partitionBy(*cell)) > 0
    last = F.lag("paragraph").over(inside)
    r = r.withColumn("breaks", F.when(last.isNull(), F.when(F.col("kind") == "table_cell", F.col("paragraph")).otherwise(0)).otherwise(F.col("paragraph") - last)).withColumn("has", has).where("has")
    order = Window.partitionBy(*doc).orderBy("block", F.coalesce("row_index", F.lit(0)), F.coalesce("cell_index", F.lit(0)), "paragraph", "run_index")
    here = F.struct("block", F.coalesce("row_index", F.lit(0)).alias("row"), F.coalesce("cell_index", F.lit(0)).alias("cell"))
    r = r.withColumn("here", here).withColumn("was", F.lag("here").over(order))
    gap = (
        F.when(F.col("was").isNull(), "").when((F.col("was.block") != F.col("block")) | (F.col("was.row") != F.col("here.row")), "\n")
        .when(F.col("was.cell") != F.col("here.cell"), " | ").otherwise("")
    )
    r = r.withColumn("before", F.concat(gap, F.repeat(F.lit("\n"), F.col("breaks").cast("int"))))
    r = r.withColumn("end", F.sum(F.length("before") + F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return r.withColumn("start", (F.col("end") - F.length("text")).cast("int")).drop("paragraph", "breaks", "has", "here", "was")


def docx_layout(runs: DataFrame) -> DataFrame:
    """Non-empty runs with start and end in the document's text.

    Lines are paragraphs and table rows with text; cells of a row are joined by ' | ', paragraphs of a
    cell by a line break, runs by nothing.
    """
    return _laid(runs).where("text <> ''").drop("before")


def docx_text(runs: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, page_number, text): each readable file as one page, empty if it has no text."""
    pieces = F.array_sort(F.collect_list(F.struct("start", "end", "before", "text")))
    text = _laid(runs).groupBy("doc_id").agg(F.array_join(F.transform(pieces, lambda x: F.concat(x["before"], x["text"])), "").alias("text"))
    known = files.select("doc_id").join(errors(files, "docx").select("doc_id"), "doc_id", "left_anti")
    return known.join(text, "doc_id", "left").select("doc_id", F.lit(1).alias("page_number"), F.coalesce("text", F.lit("")).alias("text"))


def _rewrite(raw: bytes, changed: dict[str, bytes], dropped: set[str] = frozenset()) -> bytes:
    out = BytesIO()
    with zipfile.ZipFile(BytesIO(raw)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for i in old.infolist():
            if i.filename not in dropped:
                new.writestr(i, changed.get(i.filename, old.read(i.filename)))
    return out.getvalue()


def _set_text(run: ET.Element, text: str) -> None:
    for x in [x for x in run if x.tag in (f"{W}t", f"{W}tab", f"{W}br", f"{W}cr")]:
        run.remove(x)
    t = ET.SubElement(run, f"{W}t", {"{http://www.w3.org/XML/1998/namespace}space": "preserve"})
    t.text = text


class _Node:
    """An element with the bytes that it and its tags take in its document."""

    def __init__(self, tag: str, prefix: str, attrs: dict[str, str], start: int, inner: int):
        self.tag, self.prefix, self.attrs, self.start, self.inner = tag, prefix, attrs, start, inner
        self.close = self.end = inner
        self.children: list[_Node] = []

    def __iter__(self) -> Iterator[_Node]:
        return iter(self.children)

    def findall(self, tag: str) -> list[_Node]:
        return [x for x in self.children if x.tag == tag]

    def walk(self) -> Iterator[_Node]:
        yield self
        for x in self.children:
            yield from x.walk()


_TAG = re.compile(rb"<[^\s/>]+(?:\s+[^\s=>/]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*\s*/?>")


def _utf8(raw: bytes) -> bytes:
    """An XML document in UTF-8."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        name = "utf-16"
    else:
        said = re.match(rb"(?:\xef\xbb\xbf)?\s*<\?xml[^>]*encoding=[\"']([A-Za-z0-9._-]+)", raw)
        name = said.group(1).decode() if said else "utf-8"
    if name.lower() in ("utf-8", "utf8", "us-ascii", "ascii"):
        return raw
    return re.sub(r"(<\?xml[^>]*encoding=[\"'])[^\"']*", r"\1UTF-8", raw.decode(name).lstrip("\ufeff"), count=1).encode()


def _tree(raw: bytes) -> _Node:
    top, stack = [], []
    p = expat.ParserCreate(None, "}")
    p.namespace_prefixes = True

    def begin(name: str, attrs: dict) -> None:
        uri, local, prefix = ([*name.split("}"), ""] if name.count("}") == 1 else name.split("}")) if "}" in name else ("", name, "")
        at = p.CurrentByteIndex
        node = _Node(f"{{{uri}}}{local}" if uri else local, prefix + ":" if prefix else "", attrs, at, _TAG.match(raw, at).end())
        (stack[-1].children if stack else top).append(node)
        stack.append(node)

    def finish(name: str) -> None:
        node = stack.pop()
        if raw[node.inner - 2 : node.inner] != b"/>":
            node.close = p.CurrentByteIndex
            node.end = raw.index(b">", node.close) + 1

    p.StartElementHandler, p.EndElementHandler = begin, finish
    p.Parse(raw, True)
    return top[0]


def _edited(raw: bytes, edits: list[tuple[int, int, str]]) -> bytes:
    """raw with the bytes of each (start, end, text) replaced."""
    for start, end, text in sorted(edits, reverse=True):
        raw = raw[:start] + text.encode() + raw[end:]
    return raw


def _run_xml(q: str, text: str) -> str:
    """A run's text as elements: tabs and line breaks are their own."""
    parts = (x for x in re.split(r"([\t\n])", text) if x)
    return "".join(f"<{q}tab/>" if x == "\t" else f"<{q}br/>" if x == "\n" else f'<{q}t xml:space="preserve">{escape(x, {chr(13): "&#13;"})}</{q}t>' for x in parts)


def write_docx(raw: bytes, texts: dict[tuple, str]) -> bytes:
    """The file with the texts of the runs at the given addresses replaced; all else stays."""
    with zipfile.ZipFile(BytesIO(raw)) as z:
        xml = _utf8(z.read("word/document.xml"))
    edits = []
    for at, r in _walk(_tree(xml).findall(f"{W}body")[0]):
        if at in texts:
            old = [x for x in r if x.tag in (f"{W}t", f"{W}tab", f"{W}br", f"{W}cr")]
            first = old[0].start if old else r.close
            edits += [(x.start, x.end, "") for x in old[1:]]
            edits.append((first, old[0].end if old else first, _run_xml(r.prefix, texts[at])))
    return _rewrite(raw, {"word/document.xml": _edited(xml, edits)})


def write_xlsx(raw: bytes, texts: dict[tuple[str, str], str]) -> bytes:
    """The file with the cells at (sheet, coordinate) replaced by plain strings, formulas among them.

    Where a formula goes, the stored order of calculation goes too: programs make it anew.
    """
    changed, formulas = {}, False
    with zipfile.ZipFile(BytesIO(raw)) as z:
        for name, path in _sheets(z):
            xml = _utf8(z.read(path))
            edits = []
            for c in _tree(xml).walk():
                text = texts.get((name, c.attrs.get("r"))) if c.tag == f"{S}c" else None
                if text is not None:
                    formulas = formulas or any(x.tag == f"{S}f" for x in c)
                    tag = re.sub(r"\s+t\s*=\s*(\"[^\"]*\"|'[^']*')", "", xml[c.start : c.inner].decode()).rstrip("/> \t\r\n")
                    q = c.prefix
                    edits.append((c.start, c.end, f'{tag} t="inlineStr"><{q}is><{q}t xml:space="preserve">{escape(text)}</{q}t></{q}is></{q}c>'))
            if edits:
                changed[path] = _edited(xml, edits)
        dropped = set()
        if formulas and "xl/calcChain.xml" in z.namelist():
            dropped = {"xl/calcChain.xml"}
            for path in ("[Content_Types].xml", "xl/_rels/workbook.xml.rels"):
                xml = _utf8(z.read(path))
                gone = [x for x in _tree(xml).walk() if "calcChain.xml" in (x.attrs.get("PartName") or x.attrs.get("Target") or "")]
                changed[path] = _edited(xml, [(x.start, x.end, "") for x in gone])
    return _rewrite(raw, changed, dropped)


def redact_files(files: DataFrame, parts: DataFrame, kind: str) -> DataFrame:
    """files (doc_id, content) with content rewritten; parts holds each changed part's address and new text.

    kind is docx (address as in RUNS) or xlsx (sheet_name, coordinate). Parts of a file meet its row by
    a grouped join, one file at a time.
    """
    keys = list(ADDRESS) if kind == "docx" else ["sheet_name", "coordinate"]

    def run(file: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
        clean = lambda x: None if pd.isna(x) else x if isinstance(x, str) else int(x)
        texts = {tuple(clean(x) for x in r[:-1]): r[-1] for r in changes[[*keys, "new_text"]].itertuples(index=False)}
        return file.assign(content=[(write_docx if kind == "docx" else write_xlsx)(raw, texts) for raw in file["content"]])[["doc_id", "content"]]

    return files.select("doc_id", "content").groupBy("doc_id").cogroup(parts.select(F.col("doc_id").alias("doc_id"), *keys, "new_text").groupBy("doc_id")).applyInPandas(run, "doc_id string, content binary")


def make_docx(blocks: list) -> bytes:
    """A minimal file: a block is a list of runs (paragraph) or a list of rows of cells of paragraphs of runs (table)."""
    def paragraph(runs: list[str]) -> ET.Element:
        p = ET.Element(f"{W}p")
        for text in runs:
            _set_text(ET.SubElement(p, f"{W}r"), text)
        return p

    root = ET.Element(f"{W}document")
    body = ET.SubElement(root, f"{W}body")
    for block in blocks:
        if not block or isinstance(block[0], str):
            body.append(paragraph(block))
            continue
        table = ET.SubElement(body, f"{W}tbl")
        for row in block:
            tr = ET.SubElement(table, f"{W}tr")
            for cell in row:
                tc = ET.SubElement(tr, f"{W}tc")
                tc.extend(paragraph(p) for p in cell)
    out = BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", ET.tostring(root, encoding="utf-8", xml_declaration=True))
    return out.getvalue()


def make_xlsx(sheets: dict[str, list[list]]) -> bytes:
    """A minimal file of sheets of rows; a cell is None, a string, a number, a bool, a date with its time or (formula, cached text)."""
    book, links = ET.Element(f"{S}workbook"), ET.Element("Relationships")
    names, out = ET.SubElement(book, f"{S}sheets"), BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{S[1:-1]}"><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>')
        for n, (name, rows) in enumerate(sheets.items(), 1):
            ET.SubElement(names, f"{S}sheet", {"name": name, "sheetId": str(n), f"{R}id": f"r{n}"})
            ET.SubElement(links, "Relationship", {"Id": f"r{n}", "Target": f"worksheets/sheet{n}.xml"})
            root = ET.Element(f"{S}worksheet")
            data = ET.SubElement(root, f"{S}sheetData")
            for i, row in enumerate(rows, 1):
                r = ET.SubElement(data, f"{S}row", {"r": str(i)})
                for j, v in enumerate(row, 1):
                    if v is None:
                        continue
                    c = ET.SubElement(r, f"{S}c", {"r": f"{_letters(j)}{i}"})
                    if isinstance(v, tuple):
                        ET.SubElement(c, f"{S}f").text, v = v
                        if v is None:
                            continue
                    if isinstance(v, dt.datetime):
                        c.set("s", "1")
                        v = (v - EPOCH) / dt.timedelta(days=1)
                    c.set("t", "b" if isinstance(v, bool) else "n" if isinstance(v, (int, float)) else "str")
                    ET.SubElement(c, f"{S}v").text = str(int(v)) if isinstance(v, bool) else str(v)
            z.writestr(f"xl/worksheets/sheet{n}.xml", ET.tostring(root, encoding="utf-8", xml_declaration=True))
        z.writestr("xl/workbook.xml", ET.tostring(book, encoding="utf-8", xml_declaration=True))
        z.writestr("xl/_rels/workbook.xml.rels", ET.tostring(links, encoding="utf-8", xml_declaration=True))
    return out.getvalue()
