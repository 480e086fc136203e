"""Texts made for the queries, in SQL that both engines read, and the queries' results as DuckDB SQL."""

from __future__ import annotations

from maskline.plans.inputs import IBAN_TEXTS, ID_TEXTS, PHONE_TEXTS

VALUES = {
    "EMAIL": "select c_custkey as id, concat(lower(replace(c_name, '#', '.')), '@', case c_custkey % 5 when 0 then 'gmail.com' when 1 then 'Mail.Example.com' when 2 then 'a-b.co' when 3 then 'bad' else '-x.com' end) as value from customer",
    "PHONE": "select c_custkey as id, concat('0 5', lpad(cast(c_custkey % 100 as string), 2, '0'), '-', lpad(cast(c_custkey % 1000 as string), 3, '0'), ' 45 67') as value from customer",
    "CARD_NUMBER": "select c_custkey as id, concat('4111-', lpad(cast(c_custkey as string), 4, '0'), ' 1111-1111') as value from customer",
    "TCKN": "select c_custkey as id, cast(10000000000 + c_custkey as string) as value from customer",
    "IBAN": "select c_custkey as id, case when c_custkey % 9 = 0 then 'T-' else concat('TR33 0006 1005 ', lpad(cast(c_custkey as string), 4, '0'), ' 6457 8413 26') end as value from customer",
    "PERSON": "select c_custkey as id, concat(c_name, ' ', c_mktsegment, ' x ab ', cast(c_custkey as string)) as value from customer",
    "SECRET": "select c_custkey as id, concat(c_name, '-', cast(c_custkey as string), ' ü!') as value from customer",
}
MIXED = """
select c_custkey as doc_id, 'PERSON' as type, c_custkey % 50 as start, c_custkey % 50 + 5 as end, cast(c_custkey % 100 as double) / 100 as confidence from customer
union all select s_suppkey, 'ORGANIZATION', 60, 66, cast(s_suppkey % 100 as double) / 100 from supplier
union all select cast(n_nationkey as bigint), 'LOCATION', 70, 76, cast(null as double) from nation
union all select s_suppkey, 'EMAIL', 80, 90, cast(0.99 as double) from supplier
union all select cast(n_nationkey as bigint), 'OTHER', 95, 99, cast(0.7 as double) from nation
"""
CELLS = """
select conv_id, turn as row, 0 as column_no, role as cell_text from conversations
union all select conv_id, turn, 1, case when turn % 5 = 3 then '' else substring(text, 1, 40) end from conversations
union all select conv_id, turn, 2, case when turn % 2 = 0 then cast(turn as string) end from conversations
"""
#: The same sheets with whole texts, and findings that lie deep in their cells.
WHOLE_CELLS = """
select conv_id, turn as row, 0 as column_no, role as cell_text from conversations
union all select conv_id, turn, 1, text from conversations
union all select conv_id, turn, 2, case when turn % 2 = 0 then cast(turn as string) end from conversations
"""
WHOLE_SPANS = "select conv_id, turn as finding, cast(turn * 397 as int) as start, cast(turn * 397 + 350 as int) as end from conversations"
SPANS = "select conv_id, turn as finding, cast(turn * 23 as int) as start, cast(turn * 23 + 20 as int) as end from conversations"
_PAGE_TEXT = "concat(n_name, case when n_nationkey % 3 = 0 then '  ' else ', ' end, n_name, ' | ', n_name)"
NER_PAGES = f"select n_nationkey as page, {_PAGE_TEXT} as text from nation"
NER_ENTITIES = """
select n_nationkey as page, 0 as ord, 'LOC' as entity_group, cast(0.9 as double) as score, 0 as start, length(n_name) as end from nation
union all select n_nationkey, 1, case when n_nationkey % 4 = 0 then 'ORG' else 'LOC' end, cast(0.6 as double), length(n_name) + 2, 2 * length(n_name) + 2 from nation
union all select n_nationkey, 2, case when n_nationkey % 5 = 0 then 'MISC' else 'PER' end, cast(0.7 as double), 2 * length(n_name) + 5, 3 * length(n_name) + 5 from nation
"""
REGIONS = """
select l_orderkey as page, l_linenumber as region_ord, cast((l_linenumber - 1) * 12 as int) as start, cast((l_linenumber - 1) * 12 + 8 as int) as end,
  cast(l_linenumber % 3 as double) as x0, cast(0 as double) as y0, cast(l_linenumber % 3 + 1 as double) as x1, cast(1 as double) as y1 from lineitem
"""
REGION_FINDINGS = "select o_orderkey as page, o_custkey % 3 as finding, cast(o_custkey % 20 as int) as start, cast(o_custkey % 20 + 5 + o_orderkey % 60 as int) as end from orders"
BOX_PAIRS = """
select l_orderkey * 10 + l_linenumber as id, l_quantity as ax0, cast(0 as double) as ay0, l_quantity + 10 as ax1, l_discount * 100 as ay1,
  cast(20 as double) as bx0, cast(-1 as double) as by0, cast(30 + l_linenumber as double) as bx1, l_tax * 100 as by1 from lineitem
"""
CLASS_PAGES = "select o_orderkey as page, case when o_orderkey % 7 = 0 then '  ' else o_orderpriority end as text, cast(0 as double) as x0, cast(0 as double) as y0, cast(case when o_orderkey % 11 = 0 then 0 else 100 end as double) as x1, cast(100 as double) as y1 from orders"
CLASS_IMAGES = "select l_orderkey as page, no as image_ord, cast(0 as double) as x0, cast(0 as double) as y0, l_quantity * 2 as x1, cast(50 as double) as y1 from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as no from lineitem) li where no <= 2"
RECTS = "select l_orderkey as page, cast(no - 1 as bigint) as rect_ord from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as no from lineitem) li"
CLASS_WORDS = "select l_orderkey as page, cast(l_linenumber * 3 as double) as x0, cast(1 as double) as y0, cast(l_linenumber * 3 + l_quantity / 10 as double) as x1, cast(20 as double) as y1 from lineitem"
HYBRID = """
select l_orderkey as page, no as span_ord, cast(floor(l_linenumber / 2) as int) as line_number, case when l_linenumber % 2 = 0 then concat('Word ', cast(l_suppkey % 3 as string)) else concat('word  ', cast(l_suppkey % 3 as string)) end as text,
  case when l_returnflag = 'N' then 'Helvetica' else 'GlyphLessFont' end as font, cast(0 as double) as x0, cast(0 as double) as y0, cast(8 + l_linenumber % 2 as double) as x1, cast(10 as double) as y1 from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as no from lineitem) li
"""
GOLD = """
select o_orderkey as sample_id, 'PERSON' as type, concat('Name  ', cast(o_custkey % 40 as string), '.') as value from orders
union all select o_orderkey, 'LOCATION', concat('City ', cast(o_custkey % 7 as string)) from orders
"""
PREDICTED = """
select o_orderkey as sample_id, 'PERSON' as type, concat(' Name ', cast((o_custkey + case when o_orderkey % 3 = 0 then 1 else 0 end) % 40 as string)) as value, cast(o_orderkey % 100 as double) / 100 as confidence, 0 as ord from orders
union all select o_orderkey, 'LOCATION', concat('City ', cast(o_custkey % 7 as string)), cast(o_orderkey % 50 as double) / 50, 1 from orders where o_orderkey % 2 = 0
union all select o_orderkey, 'LOCATION', concat('City ', cast(o_custkey % 7 as string), ','), cast(o_orderkey % 50 as double) / 60, 2 from orders where o_orderkey % 4 = 0
"""
FILES = """
select page_id as id, case page_id % 9 when 0 then '' when 1 then 'a.txt' when 2 then 'b.PDF' when 3 then 'c.docx' when 4 then '.pdf' when 5 then 'd.docx' when 6 then 'x.tar.pdf' when 7 then 'e.docx' else 'f.pdf' end as filename,
  case when page_id % 13 = 0 then 'text/plain' else 'application/pdf' end as content_type, case when page_id % 17 = 0 then 20971521 else 20971520 end as size_bytes,
  case when page_id % 2 = 0 then '%PDF-1.7' else 'PK' end as content, case when page_id % 9 in (3, 5, 7) then 1 else 0 end as kind,
  cast(page_id % 9 * 2000 as bigint) as entry_size, cast(page_id % 5 as int) as flags from pages
"""
UUIDS = """
select c_custkey as id, concat(lpad(cast(c_custkey as string), 8, 'a'), '-12ab-', case when c_custkey % 3 = 0 then '5' else '4' end, 'abc-', case c_custkey % 4 when 0 then 'c' when 1 then '8' when 2 then 'B' else 'a' end, '123-0123456789ab', case when c_custkey % 50 = 0 then ' ' else '' end) as doc from customer
"""
NAMES = """
select p_partkey as id, case p_partkey % 8 when 0 then '../evil.txt' when 1 then '/etc/passwd' when 2 then concat('..', chr(92), 'evil.txt') when 3 then 'C:evil.txt' when 4 then '' when 5 then concat('word/', p_name) when 6 then 'a/..b/c' else concat('a/../', p_name) end as name from part
"""
SOURCES = "select o_orderkey % 1000 as doc_id, case o_custkey % 4 when 0 then '.xlsx' when 1 then '.docx' when 2 then '.pdf' else '.txt' end as ext from orders"

#: Pages of which ten make a document, texts with a name and an address, values that occur thrice, spans of scanned lines.
PAGES = "select cast(floor(doc_id / 10) as bigint) as doc, cast(doc_id % 10 + 1 as bigint) as page_number, text from documents"
MAIL_PAGES = "select n_nationkey as page, concat(n_name, ' <', lower(replace(n_name, ' ', '.')), '@example.com>') as text from nation"
MODEL_FOUND = """
select n_nationkey as page, 'LOCATION' as type, n_name as value, 0 as start, length(n_name) as end, cast(0.9 as double) as confidence, 'ner_model' as source, cast(null as string) as normalized_value, 5 as detector_ord, 0 as match_ord from nation
"""
THRICE = "select o_orderkey as page, o_orderpriority as value, concat(o_orderpriority, ' ', o_orderpriority, ' ', o_orderpriority) as text, cast(o_custkey % 4 * (length(o_orderpriority) + 1) as int) as start from orders"
PLAN_FINDINGS = "select o_orderkey as page, o_custkey % 3 as finding, cast(floor(o_orderkey / 100) as bigint) as doc, o_orderkey % 100 as page_number, 'PERSON' as type, substring(repeat('Name  Other ab ', 8), 1, cast(5 + o_orderkey % 60 as int)) as value from orders"
SCANNED = """
select l_orderkey as page, cast(floor(no / 3) as int) as block, cast(floor(no / 2) as int) as line, no as span_ord, case when no % 4 = 0 then '' else concat('Span ', cast(l_suppkey % 5 as string)) end as text
from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as no from lineitem) li
"""
SAMPLES = "select cast(floor(o_orderkey / 1000) as bigint) as pile, o_orderkey, concat('Order ', cast(o_orderkey as string)) as text, concat('Name ', cast(o_custkey % 40 as string)) as person, concat('City ', cast(o_custkey % 7 as string)) as city, o_orderkey % 5 = 0 as bare from orders"
TOUCHED = "select concat(lpad(cast(user_id as string), 8, '0'), '-0000-', case when user_id % 5 = 0 then '5' else '4' end, '000-8000-000000000000') as doc_id, ts from events"
CHUNKS = "select l_orderkey as upload, no as chunk, cast(l_quantity * 200000 as bigint) as n_bytes from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as no from lineitem) li"
LABELS = "select p_partkey as id, case p_partkey % 4 when 0 then concat(p_name, '.PDF') when 1 then '.hidden' when 2 then 'plain' else 'a.tar.Xlsx' end as filename, cast(p_partkey * 1000 + 7 as bigint) as size_bytes from part"
#: A file of twenty customers: an address cut over two runs, a table with a card; a sheet with formulas and dates.
CLIENTS = "select cast(floor(c_custkey / 20) as bigint) as doc, c_custkey, c_name, concat('client.', cast(c_custkey as string), '@example.com') as mail, cast(c_custkey % 1000 as int) as days from customer"

_A, _N = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]"


def _matches(source: str, key: str, text: str, alphabet: str, filler: str, pattern: str) -> str:
    """(key, k, start, len, value): characters outside the pattern's alphabet are neutral before it is matched."""
    norm = f"regexp_replace({text}, '{alphabet}', {filler}, 'g')" if alphabet else text
    return f"""(select {key}, k - 2 as k, "start", len, substring(t, cast("start" + 1 as bigint), len) as value from (
  select {key}, t, k, position(chr(57345) in s) - 1 as len, sum(length(s) - case when k > 1 then 1 else 0 end) over (partition by {key} order by k rows between unbounded preceding and 1 preceding) as "start"
  from (select {key}, t, unnest(p) as s, generate_subscripts(p, 1) as k from (
    select {key}, {text} as t, string_split(regexp_replace({norm}, '{pattern}', chr(57344) || '\\0' || chr(57345), 'g'), chr(57344)) as p from ({source}) src) a) b) c where k > 1)"""


_LUHN = "list_sum(list_transform(range(length(n)), lambda i: case when i % 2 = 1 then (case when cast(n[length(n) - i] as int) * 2 > 9 then cast(n[length(n) - i] as int) * 2 - 9 else cast(n[length(n) - i] as int) * 2 end) else cast(n[length(n) - i] as int) end)) % 10 = 0"


def _digit(i: int) -> str:
    return f"cast(value[{i}] as int)"


def _found(kind: str, source: str, key: str, text: str) -> str:
    shape = {
        "EMAIL": ("", "''", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
        "PHONE": (r"[^0-9+\s-]", "'~'", r"(?:\B\+90[\s-]?|\b(?:0090|0)[\s-]?|\B[\s-]|\b)5[0-9]{2}[\s-]?[0-9]{3}[\s-]?[0-9]{2}[\s-]?[0-9]{2}\b"),
        "TCKN": ("[^0-9]", "'~'", r"\b[1-9][0-9]{10}\b"),
        "IBAN": (r"[^A-Za-z0-9\s]", "'~'", r"\b[Tt][Rr][0-9]{2}(?:\s?[0-9]{4}){5}\s?[0-9]{2}\b"),
        "CARD_NUMBER": ("[^0-9 -]", "chr(10)", r"\b(?:[0-9][ -]?){12,18}[0-9]\b"),
    }[kind]
    m = _matches(source, key, text, *shape)
    value, normal, valid, conf = "value", "cast(null as varchar)", "true", "0.99"
    if kind == "PHONE":
        value, conf = "trim(value)", "0.95"
    if kind == "TCKN":
        odd, even = "+".join(_digit(i) for i in (1, 3, 5, 7, 9)), "+".join(_digit(i) for i in (2, 4, 6, 8))
        valid = f"((7 * ({odd}) - ({even})) % 10 + 10) % 10 = {_digit(10)} and ({'+'.join(_digit(i) for i in range(1, 11))}) % 10 = {_digit(11)}"
    if kind == "IBAN":
        normal = r"upper(regexp_replace(value, '\s', '', 'g'))"
        valid = rf"cast(substring({normal}, 5) || '2927' || substring({normal}, 3, 2) as hugeint) % 97 = 1"
    if kind == "CARD_NUMBER":
        normal = "regexp_replace(value, '[ -]', '', 'g')"
        valid = _LUHN.replace("n[", "n_[").replace("length(n)", "length(n_)").replace("n_", f"({normal})")
    return f"""select {key}, '{kind}' as type, {value} as value, cast("start" as integer) as "start", cast("start" + len as integer) as "end", cast({conf} as double) as confidence, {normal} as normalized_value, k from {m} m where {valid}"""


def _plain(kind: str, source: str, key: str, text: str = "text") -> str:
    return f'select {key}, type, value, "start", "end", confidence, normalized_value from ({_found(kind, source, key, text)}) f'


def _part(x: str) -> str:
    return f"(case when length({x}) <= 2 then repeat('*', length({x})) else substring({x}, 1, 1) || repeat('*', length({x}) - 2) || substring({x}, length({x}), 1) end)"


def _mask(kind: str, v: str) -> str:
    star = f"regexp_replace({v}, '{_A}', '*', 'g')"
    if kind == "TCKN":
        return f"repeat('*', length({v}))"
    if kind == "PERSON":
        return f"array_to_string(list_transform(string_split({v}, ' '), lambda x: {_part('x')}), ' ')"
    if kind in ("PHONE", "CARD_NUMBER", "IBAN"):
        n, other = (2, v) if kind == "IBAN" else (1, star)
        front, back = f"regexp_extract({v}, '^(?:{_N}*{_A}){{{n}}}')", f"regexp_extract({v}, '{_A}{_N}*$')"
        inner = f"regexp_replace(substring({v}, length({front}) + 1, length({v}) - length({front}) - length({back})), '{_A}', '*', 'g')"
        return f"case when {front} <> '' and length({front}) + length({back}) <= length({v}) then {front} || {inner} || {back} else {other} end"
    if kind == "EMAIL":
        label = "[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
        domain, labels = f"string_split({v}, '@')[2]", f"string_split(string_split({v}, '@')[2], '.')"
        hidden = f"array_to_string(list_transform({labels}[1:-2], lambda x: {_part('x')}) || {labels}[-1:], '.')"
        return f"case when regexp_full_match({v}, '[A-Za-z0-9._%+-]+@{label}(?:[.]{label})+') then {_part(f'string_split({v}, ' + chr(39) + '@' + chr(39) + ')[1]')} || '@' || case when lower({domain}) in ('gmail.com', 'outlook.com', 'hotmail.com', 'yahoo.com', 'icloud.com', 'yandex.com', 'proton.me', 'protonmail.com') then {domain} else {hidden} end else repeat('*', length({v})) end"
    return star


_LEVEL = "case when coalesce(confidence, 0) >= 0.85 then 'HIGH' when coalesce(confidence, 0) >= 0.6 then 'MEDIUM' else 'LOW' end"
_STATUS = "case when type in ('PERSON', 'EMAIL', 'PHONE', 'TCKN', 'IBAN', 'CARD_NUMBER') then 'SENSITIVE' when type in ('LOCATION', 'ORGANIZATION') then 'REVIEW' else 'UNKNOWN' end"
_ACTION = f"case when type in ('EMAIL', 'PHONE', 'TCKN', 'IBAN', 'CARD_NUMBER') then 'AUTO_REDACT' when type in ('LOCATION', 'ORGANIZATION') then 'REVIEW' when type = 'PERSON' then (case when {_LEVEL} = 'LOW' then 'REVIEW' else 'AUTO_REDACT' end) else 'KEEP' end"
_ID = """'1:' || "start" || ':' || "end" || ':' || type"""
_KINDS = ("EMAIL", "PHONE", "TCKN", "IBAN", "CARD_NUMBER")
_ALL = " union all ".join(f"select *, {i} as detector_ord from ({_found(k, 'select doc_id, text from documents', 'doc_id', 'text')}) q{i}" for i, k in enumerate(_KINDS))
_MASKED = f"""select *, case when length(m) = "end" - "start" then m else repeat('*', "end" - "start") end as mask from (select *, case type {' '.join(f"when '{k}' then {_mask(k, 'value')}" for k in _KINDS)} end as m from ({_ALL}) a) b"""
_GRADED = f"select *, {_LEVEL} as confidence_level, {_STATUS} as privacy_status, {_ACTION} as redaction_action, {_ID} as finding_id from ({MIXED}) m"
_PLACED = """select conv_id, "row", column_no, cell_text, cast(e - length(cell_text) as integer) as "start", cast(e as integer) as "end" from (
  select *, sum(gap + length(cell_text)) over (partition by conv_id order by "row", column_no) as e from (
    select *, case when lag("row") over w is null then 0 when lag("row") over w = "row" then 3 else 1 end as gap from (%s) c where cell_text <> '' window w as (partition by conv_id order by "row", column_no)) x) y""" % CELLS
_AREA = "(case when least(ax1, bx1) > greatest(ax0, bx0) and least(ay1, by1) > greatest(ay0, by0) then (least(ax1, bx1) - greatest(ax0, bx0)) * (least(ay1, by1) - greatest(ay0, by0)) else 0.0 end)"
_OWN = {p: f"(case when {p}x1 > {p}x0 and {p}y1 > {p}y0 then ({p}x1 - {p}x0) * ({p}y1 - {p}y0) else 0.0 end)" for p in "ab"}
_HYBRID = f"select *, case when font = 'GlyphLessFont' then 'ocr' else 'native' end as source from ({HYBRID}) h"
_KEY = r"regexp_replace(trim(regexp_replace(value, '\s+', ' ', 'g')), '[.,;:!?]+$', '')"
_COMPARED = f"""select t.threshold, coalesce(g.sample_id, p.sample_id) as sample_id, coalesce(g.type, p.type) as type, coalesce(g.v, p.v) as value, g.v is not null as expected, coalesce(p.best >= t.threshold, false) as predicted
from (select distinct sample_id, type, {_KEY} as v from ({GOLD}) g0) g
full join (select sample_id, type, {_KEY} as v, max(confidence) as best from ({PREDICTED}) p0 group by 1, 2, 3) p on g.sample_id = p.sample_id and g.type = p.type and g.v = p.v
cross join (select unnest([0.0, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::double as threshold) t"""


def _metrics(by: str, where: str = "true") -> str:
    counts = f"select {by}, count(*) filter (where expected and predicted) as tp, count(*) filter (where predicted and not expected) as fp, count(*) filter (where expected and not predicted) as fn from ({_COMPARED}) c where {where} group by {by}"
    pr = f"select *, case when tp + fp > 0 then tp / (tp + fp) else 0.0 end as p, case when tp + fn > 0 then tp / (tp + fn) else 0.0 end as r from ({counts}) k"
    return f'select {by}, tp, fp, fn, round(p, 6) as "precision", round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end, 6) as f1 from ({pr}) z'


def sql() -> dict[str, str]:
    docs, pages = "select doc_id, text from documents", "select page_id, html from pages"
    out = {
        "r1_email": _plain("EMAIL", docs, "doc_id"),
        "r1_email_pages": _plain("EMAIL", pages, "page_id", "html"),
        "r8_card_luhn": _plain("CARD_NUMBER", docs, "doc_id"),
        "r8_card_pages": _plain("CARD_NUMBER", pages, "page_id", "html"),
        "r2_phone": _plain("PHONE", PHONE_TEXTS, "c_custkey"),
        "r3_tckn": _plain("TCKN", ID_TEXTS, "c_custkey"),
        "r5_iban": _plain("IBAN", IBAN_TEXTS, "c_custkey"),
        "detect_all_enriched": f"""select doc_id, type, value, "start", "end", confidence, normalized_value, cast(detector_ord as integer) as detector_ord, {_LEVEL} as confidence_level, {_STATUS} as privacy_status, {_ACTION} as redaction_action, {_ID} as finding_id, mask from ({_MASKED}) f""",
        "findings_summary": f"select d.doc_id, count(f.type) as finding_count, count(f.type) as auto_count, cast(0 as bigint) as review_count from documents d left join ({_ALL}) f on f.doc_id = d.doc_id group by 1",
        "redact_text": f"""
with recursive f as (select doc_id, "start", "end", mask, row_number() over (partition by doc_id order by "start", "end", mask) as i from ({_MASKED}) m),
r as (select doc_id, text as redacted, cast(0 as bigint) as i, text from documents
  union all select r.doc_id, substring(r.redacted, 1, f."start") || array_to_string(list_transform(range(length(f.mask)), lambda k: case when f.mask[k + 1] = '*' or (r.redacted[f."start" + k + 1] = '*' and r.text[f."start" + k + 1] <> '*') then '*' else f.mask[k + 1] end), '') || substring(r.redacted, f."end" + 1), f.i, r.text
  from r join f on f.doc_id = r.doc_id and f.i = r.i + 1)
select doc_id, redacted, redacted <> text as changed from r qualify row_number() over (partition by doc_id order by i desc) = 1""",
        "grade_findings": f"select doc_id, type, confidence, confidence_level, privacy_status, redaction_action, finding_id, cast(cast(floor(confidence * 100 + 0.5) as bigint) as varchar) || '%' as label from ({_GRADED}) g",
        "select_review": f"select doc_id, finding_id, redaction_action from ({_GRADED}) g where redaction_action = 'AUTO_REDACT' or (redaction_action = 'REVIEW' and doc_id % 2 = 0)",
        "nothing_selected": f"select doc_id, 404 as http_code, 'nothing_selected' as status from ({_GRADED}) g where doc_id not in (select doc_id from ({_GRADED}) h where redaction_action = 'AUTO_REDACT')",
        "sheet_text": f"""select conv_id, string_agg(line, chr(10) order by "row") as text from (select conv_id, "row", string_agg(cell_text, ' | ' order by column_no) as line from ({CELLS}) c where cell_text <> '' group by 1, 2) l group by 1""",
        "cell_offsets": f'select conv_id, "row", column_no, "start", "end" from ({_PLACED}) p',
        "cell_matches": f"""select f.conv_id, finding, "row", column_no, greatest(f."start", p."start") - p."start" as match_start, least(f."end", p."end") - p."start" as match_end,
  substring(cell_text, greatest(f."start", p."start") - p."start" + 1, least(f."end", p."end") - greatest(f."start", p."start")) as matched_text, repeat('*', least(f."end", p."end") - greatest(f."start", p."start")) as mask_slice
  from ({SPANS}) f join ({_PLACED}) p on f.conv_id = p.conv_id and greatest(f."start", p."start") < least(f."end", p."end")""",
        "run_offsets": """select conv_id, turn, cast(k - 1 as integer) as run, cast(e - length(w) as integer) as "start", cast(e as integer) as "end" from (
  select conv_id, turn, k, w, sum(length(w) + case when k > 1 then 1 else 0 end) over (partition by conv_id, turn order by k) as e from (
    select conv_id, turn, unnest(p) as w, generate_subscripts(p, 1) as k from (select conv_id, turn, string_split(text, ' ') as p from conversations) a) b) c""",
        "block_counters": "select conv_id, turn, role as kind, cast(row_number() over (partition by conv_id, role order by turn) - 1 as integer) as kind_index from conversations",
        "ner_merge": f"""
with e as (select n.*, p.text, lag("end") over w as last, lag(entity_group) over w as was from ({NER_ENTITIES}) n join ({NER_PAGES}) p on p.page = n.page window w as (partition by n.page order by ord)),
g as (select *, sum(case when was = entity_group and trim(substring(text, last + 1, "start" - last)) = '' then 0 else 1 end) over (partition by page order by ord) as run from e),
m as (select page, run, min(entity_group) as entity_group, min(score) as confidence, min("start") as s, max("end") as e, min(text) as text from g group by 1, 2)
select page, case entity_group when 'PER' then 'PERSON' when 'LOC' then 'LOCATION' else 'ORGANIZATION' end as type, substring(text, s + 1, e - s) as value, cast(s as integer) as "start", cast(e as integer) as "end", confidence from m where entity_group in ('PER', 'LOC', 'ORG')""",
        "region_boxes": f"""
with h as (select f.page, finding, f."start" as fs, f."end" as fe, region_ord, x0, y0, x1, y1, greatest(r."start", f."start") as a from ({REGION_FINDINGS}) f join ({REGIONS}) r on r.page = f.page and greatest(r."start", f."start") < least(r."end", f."end")),
p as (select *, row_number() over w as n, lead(a) over w as nxt from h window w as (partition by page, finding order by a, region_ord)),
b as (select page, finding, x0, y0, x1, y1, min(case when n = 1 then fs else a end - fs) as box_start, max(coalesce(nxt, fe) - fs) as box_end, min(n) as first from p group by 1, 2, 3, 4, 5, 6)
select page, finding, x0, y0, x1, y1, cast(box_start as integer) as box_start, cast(box_end as integer) as box_end, row_number() over (partition by page, finding order by first) as box_ord from b""",
        "bbox_overlap": f"select id, round({_AREA}, 6) as area, round(case when least({_OWN['a']}, {_OWN['b']}) > 0 then {_AREA} / least({_OWN['a']}, {_OWN['b']}) else 0.0 end, 6) as ratio from ({BOX_PAIRS}) p",
        "page_class": f"""
with i as (select g.page, image_ord, least(g.x1, p.x1) as w, (least(g.x1, p.x1)) * 50 as area from ({CLASS_IMAGES}) g join ({CLASS_PAGES}) p on p.page = g.page where p.x1 > 0 and least(g.x1, p.x1) * 50 / (p.x1 * 100) >= 0.2),
c as (select i.page, i.image_ord, i.area, coalesce(sum(case when least(d.x1, g.x1) > d.x0 then (least(d.x1, g.x1) - d.x0) * 19 else 0 end), 0) as cov from i join ({CLASS_IMAGES}) g on g.page = i.page and g.image_ord = i.image_ord left join ({CLASS_WORDS}) d on d.page = i.page group by 1, 2, 3)
select p.page, case when trim(p.text) = '' then 'ocr' when exists (select 1 from c where c.page = p.page and least(cov, area) / area < 0.05) then 'hybrid' else 'native' end as page_class from ({CLASS_PAGES}) p""",
        "hybrid_dedupe": rf"""with s as (select *, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) as n from ({_HYBRID}) h)
select page, span_ord, source from s where not (source = 'ocr' and exists (select 1 from s o where o.page = s.page and o.source = 'native' and o.n = s.n and least(o.x1, s.x1) * 10 / least(o.x1 * 10, s.x1 * 10) >= 0.8))""",
        "hybrid_text": f"""select page, string_agg(gap || text, '' order by r, span_ord) as text from (select *, case when lag(source) over w is null then '' when lag(source) over w <> source then chr(10) || '|' || chr(10) when lag(line_number) over w <> line_number then chr(10) else '' end as gap
  from (select *, case when source = 'native' then 0 else 1 end as r from ({_HYBRID}) h) x window w as (partition by page order by r, span_ord)) y group by 1""",
        "rect_allocation": """select page, occurrence, rect_ord, cast(row_number() over (partition by page order by rect_ord) - 1 as integer) as rect_index from (
  select page, rect_ord, cast(o_custkey % 3 as integer) as occurrence, ntile(3) over (partition by page order by rect_ord) - 1 as g from (""" + RECTS + """) r join orders on o_orderkey = page) x where g = occurrence""",
        "eval_sweep": _metrics("threshold"),
        "eval_best": f"select * from ({_metrics('threshold')}) s order by f1 desc, threshold desc limit 1",
        "eval_per_type": _metrics("type", "threshold = 0.5"),
        "eval_errors": f"""select c.sample_id, c.type, c.value, case when predicted then 'FP' else 'FN' end as error, case when predicted then (select arg_min(confidence, ord) from ({PREDICTED}) p where p.confidence >= 0.5 and p.sample_id = c.sample_id and p.type = c.type and {_KEY.replace('value', 'p.value')} = c.value) end as confidence
  from ({_COMPARED}) c where threshold = 0.5 and expected <> predicted""",
        "ingest_gate": f"""select id, ingest_status, case ingest_status when 'uploaded' then 200 when 'no_filename' then 400 when 'too_large' then 413 when 'unsafe_archive' then 413 else 415 end as http_code, ext as extension from (
  select *, case when filename = '' then 'no_filename' when ext not in ('.pdf', '.docx', '.xlsx') then 'bad_extension' when content_type <> 'application/pdf' then 'bad_type' when size_bytes > 20971520 then 'too_large'
    when not (case when ext = '.pdf' then starts_with(content, '%PDF-') else kind = 1 end) then 'content_mismatch' when ext <> '.pdf' and (flags % 2 = 1 or entry_size > 10000) then 'unsafe_archive' else 'uploaded' end as ingest_status
  from (select *, lower(regexp_extract(filename, '^.+([.][^.]+)$', 1)) as ext from ({FILES}) f) x) y""",
        "uuid_check": f"select id, regexp_full_match(doc, '[0-9a-f]{{8}}-[0-9a-f]{{4}}-4[0-9a-f]{{3}}-[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}') as valid from ({UUIDS}) u",
        "zip_name_guard": f"select id, n = '' or starts_with(n, '/') or n[2] = ':' or list_contains(string_split(n, '/'), '..') as unsafe from (select id, replace(name, chr(92), '/') as n from ({NAMES}) m) x",
        "resolve_format": f"select doc_id, case min(case ext when '.pdf' then 1 when '.docx' then 2 when '.xlsx' then 3 end) when 1 then '.pdf' when 2 then '.docx' else '.xlsx' end as ext from ({SOURCES}) s where ext <> '.txt' group by 1",
        "delete_documents": "select doc_id, source from documents where doc_id not in (select doc_id from labels where toxic = 1)",
        "retention_stale": "select doc_id, cast(trunc(age) as bigint) as age_s from (select user_id as doc_id, (epoch_us((select max(ts) from events)) - epoch_us(max(ts))) / 1e6 as age from events group by 1) x where age >= 3600",
        "retention_sessions": """select doc_id, min(us) as opened_us, max(us) + 3600000000 as expired_us, count(*) as touches from (select *, sum(case when us - last < 3600000000 then 0 else 1 end) over (partition by doc_id order by us) as n from (
  select user_id as doc_id, epoch_us(ts) as us, lag(epoch_us(ts)) over (partition by user_id order by ts) as last from events) x) y group by doc_id, n""",
        "docx_parse": """select doc_id, paragraph_index, run_index, cast(e - length(text) as integer) as "start", cast(e as integer) as "end", text from (
  select *, sum(length(text) + case when run_index = 0 and paragraph_index > 0 then 1 else 0 end) over (partition by doc_id order by paragraph_index, run_index) as e from (
    select cast(conv_id as varchar) as doc_id, cast(row_number() over (partition by conv_id order by turn) - 1 as integer) as paragraph_index, unnest([0, 1]) as run_index, unnest([role, text]) as text from conversations where text is not null) x) y where text <> ''""",
        "xlsx_parse": """select doc_id, 1 as page_number, 'chat' as sheet_name, cast(r as integer) as "row", c as "column", ['A', 'B', 'C'][c] || r as coordinate, t as cell_text, false as is_formula from (
  select cast(conv_id as varchar) as doc_id, row_number() over (partition by conv_id order by turn) as r, unnest([1, 2, 3]) as c, unnest([cast(turn as varchar), role, text]) as t from conversations where text is not null) x""",
    }
    mask = _mask("EMAIL", "mail")
    out |= {
        "analyze": f"""
with f as (select cast(floor(doc_id / 10) as bigint) as doc, doc_id % 10 + 1 as page, *, (doc_id % 10 + 1) || ':' || "start" || ':' || "end" || ':' || type || '|' || {_ACTION} || '|' || coalesce(normalized_value, '') as x from ({_ALL}) a),
g as (select doc, count(*) as n, string_agg(x, ';' order by page, "start", detector_ord, k) as x from f group by 1)
select p.doc as doc_id, 'analyzed' as status, count(*) as page_count, coalesce(min(g.n), 0) as finding_count, coalesce(min(g.x), '') as found from ({PAGES}) p left join g on g.doc = p.doc group by 1""",
        "findings_union": f"""select page, type, value, "start", "end", source, {_ACTION} as redaction_action, detector_ord from (
  select page, type, value, "start", "end", confidence, 'rule_engine' as source, 0 as detector_ord from ({_found('EMAIL', MAIL_PAGES, 'page', 'text')}) r
  union all select page, type, value, "start", "end", confidence, source, detector_ord from ({MODEL_FOUND}) m) u""",
        "occurrence_index": f"""select page, rect_ord, cast(row_number() over (partition by page order by rect_ord) - 1 as integer) as rect_index from (
  select page, rect_ord, case when o_custkey % 4 < 3 then o_custkey % 4 else 0 end as occurrence, ntile(3) over (partition by page order by rect_ord) - 1 as g from ({RECTS}) r join orders on o_orderkey = page) x where g = occurrence""",
        "redaction_plan": f"""
with b as (select * from ({out['region_boxes']}) rb),
f as (select page, finding, value, {_mask('PERSON', 'value')} as mask from ({PLAN_FINDINGS}) pf where page_number between 1 and 60),
j as (select b.*, case when box_start >= 0 and box_start < box_end and box_end <= length(mask) then substring(mask, box_start + 1, box_end - box_start) else repeat('*', length(value)) end as segment from b join f on f.page = b.page and f.finding = b.finding)
select page, finding, box_ord, segment, x0 * 10 + 1 as text_x0, y0 * 10 + 1 as text_y0, x1 * 10 - 1 as text_x1, y1 * 10 - 1 as text_y1, segment <> '' as drawn from j""",
        "ocr_text": f"""select page, string_agg(gap || text, '' order by span_ord) || chr(10) as text from (
  select *, case when lag(line) over w is null or (lag(line) over w = line and lag(block) over w = block) then '' else chr(10) end as gap from ({SCANNED}) s where text <> '' window w as (partition by page order by span_ord)) x group by 1""",
        "gold_json": f"select text, 'PERSON' as type, person as value from ({SAMPLES}) s where not bare union all select text, 'LOCATION', city from ({SAMPLES}) s where not bare union all select text, null, null from ({SAMPLES}) s where bare",
        "cell_masks": f"""select conv_id, "row", column_no, count(*) as matches, min(array_to_string(list_transform(range(length(cell_text)), lambda i: case when len(list_filter(spans, lambda s: s.a <= i and i < s.b)) > 0 then '*' else cell_text[i + 1] end), '')) as new_text
from (select p.conv_id, p."row", p.column_no, p.cell_text, list(struct_pack(a := greatest(f."start", p."start") - p."start", b := least(f."end", p."end") - p."start")) over (partition by p.conv_id, p."row", p.column_no) as spans
  from ({WHOLE_SPANS}) f join ({_PLACED.replace(CELLS, WHOLE_CELLS)}) p on f.conv_id = p.conv_id and greatest(f."start", p."start") < least(f."end", p."end")) x group by 1, 2, 3""",
        "retention_sweep": f"select count(*) as deleted_count from (select doc_id from ({TOUCHED}) t where doc_id[15] = '4' group by 1 having epoch_us((select max(ts) from events)) - epoch_us(max(ts)) >= 3600000000) x",
        "upload_bytes": f"""select upload, max(total) as bytes_read, count(*) as chunks_read, max(total) <= 20971520 as accepted from (
  select *, cast(sum(n_bytes) over (partition by upload order by chunk) as bigint) as total from ({CHUNKS}) c) x where total - n_bytes <= 20971520 group by 1""",
        "review_selection": f"""
with g as ({_GRADED}), r as (select distinct doc_id, finding_id from g where redaction_action = 'REVIEW'),
a as (select * from r where doc_id % 2 = 0), i as (select * from r where doc_id % 3 = 0),
t as ((select * from a except select * from i) union all (select * from i except select * from a)),
n as (select doc_id, count(*) as selected_count from t group by 1)
select g.doc_id, count(*) as finding_count, count(*) filter (where redaction_action = 'AUTO_REDACT') as auto_count, count(*) filter (where redaction_action = 'REVIEW') as review_count, coalesce(min(selected_count), 0) as selected_count from g left join n on n.doc_id = g.doc_id group by 1""",
        "file_labels": f"select id, case when contains(filename, '.') then lower(string_split(filename, '.')[-1]) else '' end as extension, format('{{:.1f}} KB', size_bytes / 1024) as size from ({LABELS}) l",
        "fragment_starts": """
with recursive w as (select p_partkey, p_name, string_split(p_name, ' ') as f from part),
s as (select p_partkey, p_name, f, 0 as rect_index, 0 as "start" from w
  union all select p_partkey, p_name, f, rect_index + 1, cast("start" + instr(substring(p_name, "start" + 1), f[rect_index + 2]) - 1 as integer) from s where rect_index + 1 < len(f))
select p_partkey, rect_index, "start" from s""",
        "retention_stream": "select doc_id, last_ms from (select user_id as doc_id, epoch_us(max(ts)) // 1000 as last_ms from events group by 1) x where last_ms + 3600000 < (select epoch_us(max(ts)) // 1000 from events) - 600000",
        "close_stream": """select doc_id, coalesce(closed_ms, last_ms) as last_ms, case when closed_ms is not null then 'downloaded' else 'expired' end as reason from (
  select user_id as doc_id, epoch_us(max(ts)) // 1000 as last_ms, epoch_us(max(ts) filter (where event_type = 'purchase')) // 1000 as closed_ms from events group by 1) x where closed_ms is not null or last_ms + 3600000 < (select epoch_us(max(ts)) // 1000 from events) - 600000""",
        "docx_redact": f"""
with c as (select cast(doc as varchar) as doc_id, row_number() over (partition by doc order by c_custkey) - 1 as i, c_name, mail, {mask} as mask from ({CLIENTS}) c0)
select doc_id, 'paragraph' as kind, cast(2 * i as integer) as block, 0 as cell_index, r as run_index, case r when 0 then 'E-mail: ' when 1 then substring(mask, 1, length(mail) - 6) else substring(mask, length(mail) - 5) end as text from c, (select unnest([0, 1, 2]) as r) n
union all select doc_id, 'table_cell', cast(2 * i + 1 as integer), k, 0, case k when 0 then c_name else 'Kart 4*** **** **** ***1' end from c, (select unnest([0, 1]) as k) n""",
        "xlsx_redact": f"""
with c as (select cast(doc as varchar) as doc_id, row_number() over (partition by doc order by c_custkey) as r, c_name, mail, days, {mask} as mask from ({CLIENTS}) c0)
select doc_id, ['A', 'B', 'C', 'D'][k] || r as coordinate, case k when 1 then c_name when 2 then mask when 3 then strftime(timestamp '2020-01-01 12:00:00' + to_days(days), '%Y-%m-%d %H:%M:%S') else '7' end as cell_text, k = 4 as is_formula from c, (select unnest([1, 2, 3, 4]) as k) n""",
    }
    out |= {f"{name}_whole": out[name].replace(CELLS, WHOLE_CELLS).replace(SPANS, WHOLE_SPANS) for name in ("sheet_text", "cell_offsets", "cell_matches")}
    return out | {f"mask_{k.lower()}": f"select id, value, {_mask(k, 'value')} as masked from ({v}) v" for k, v in VALUES.items()}
