"""Masks, checksums, folding and policies; expected values are made by hand or by plain arithmetic."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from maskline import settings
from maskline.functions import checks, masks, text
from maskline.operators import policy, regions
from maskline.sources import ingest


def iban(account):
    return f"TR{98 - int(account + '292700') % 97:02d}{account}"


def citizen(nine):
    d = [int(c) for c in nine]
    tenth = (7 * sum(d[0::2]) - sum(d[1::2])) % 10
    return nine + str(tenth) + str((sum(d) + tenth) % 10)


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def test_word_masks(spark):
    want = {"Zeynep": "Z****p", "Zeynep Kaya Er": "Z****p K**a **", "Q": "*", "Su": "**", "Şule\tÜnlü": "Ş**e\tÜ**ü", "": "", "  ": "  ", "a😀b": "a*b"}
    d = spark.createDataFrame([(k, v) for v in want for k in masks.WORD_TYPES], "type string, value string")
    assert all(r.got == want[r.value] for r in d.withColumn("got", masks.mask_value(F.col("value"), F.col("type"))).collect())


@pytest.mark.parametrize(
    "kind, value, want",
    [
        ("PHONE", "05559876543", "0" + "*" * 9 + "3"), ("PHONE", "+90 555-987 65 43", "+9* ***-*** ** *3"), ("PHONE", "(6)", "(*)"),
        ("CARD_NUMBER", "5500 0000 0000 0004", "5*** **** **** ***4"), ("IBAN", "tr76 0009", "tr** ***9"), ("IBAN", "x1", "x1"),
        ("EMAIL", "merve.aydin@posta.example.org", "m" + "*" * 9 + "n@p***a.e*****e.org"), ("EMAIL", "k@site.net", "*@s**e.net"), ("EMAIL", "yz@site.net", "**@s**e.net"),
        ("EMAIL", "merve@yahoo.com", "m***e@yahoo.com"), ("EMAIL", "merve@Outlook.com", "m***e@Outlook.com"), ("EMAIL", "kuzey@veri-evi.com", "k***y@v******i.com"),
        ("EMAIL", "no at sign", "*" * 10), ("EMAIL", "a@@b.co", "*" * 7), ("TCKN", "98765432101", "*" * 11), ("KEY", "Anahtar#7 x", "*******#* *"),
    ],
)
def test_other_masks(spark, kind, value, want):
    got = spark.range(1).select(masks.mask_value(F.lit(value), F.lit(kind))).first()[0]
    assert got == want and len(got) == len(value)


def test_checksums(spark):
    r = random.Random(11)
    rows = []
    for _ in range(60):
        account = "".join(r.choice("0123456789") for _ in range(22))
        good = iban(account)
        rows += [("iban", good, True), ("iban", good.lower().replace("0", "0 "), True), ("iban", good[:-1] + str((int(good[-1]) + 1) % 10), False)]
        person = citizen(r.choice("123456789") + "".join(r.choice("0123456789") for _ in range(8)))
        rows += [("tckn", person, True), ("tckn", person[:-1] + str((int(person[-1]) + 1) % 10), False)]
        card = "".join(r.choice("0123456789") for _ in range(r.randint(12, 20)))
        rows.append(("card", card, luhn(card) and 13 <= len(card) <= 19))
    thai = str.maketrans("0123456789", "".join(chr(0x0E50 + i) for i in range(10)))
    bold = str.maketrans("0123456789", "".join(chr(0x1D7CE + i) for i in range(10)))
    rows += [("card", "5500-0000 0000-0004", True), ("card", "5500000000000004".translate(thai), True), ("card", "5500000000000004".translate(bold), True), ("card", "5500000000000005".translate(thai), False)]
    rows += [("tckn", "0" * 11, False), ("tckn", "short", False), ("iban", "", False), ("iban", "XY12", False)]
    d = spark.createDataFrame(rows, "kind string, value string, want boolean")
    got = F.when(F.col("kind") == "iban", checks.is_tr_iban(F.col("value"))).when(F.col("kind") == "tckn", checks.is_tckn(F.col("value"))).otherwise(checks.is_card(F.col("value")))
    assert [r for r in d.withColumn("got", got).collect() if r.got != r.want] == []


def test_digits_and_folding_of_all_scripts(spark):
    digits = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Nd"]
    odd = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).casefold() != chr(c)]
    words = ["Straße ﬁn", "ΣΊΣΥΦΟΣ ς", "ŞİRKET", "ŉ K ſ", "plain"] + odd
    got = spark.createDataFrame([(x,) for x in digits], "x string").select("x", text.ascii_digits(F.col("x")).alias("d")).collect()
    assert all(r.d == str(unicodedata.digit(r.x)) for r in got)
    got = spark.createDataFrame([(x,) for x in words], "x string").select("x", text.folded(F.col("x")).alias("f")).collect()
    assert [r.x for r in got if r.f != r.x.casefold()] == []


@pytest.mark.parametrize(
    "check, value, want",
    [
        (ingest.is_unsafe_name, "docs/../../key.pem", True), (ingest.is_unsafe_name, "docs\\..\\key.pem", True), (ingest.is_unsafe_name, "/srv/key.pem", True),
        (ingest.is_unsafe_name, "D:/key.pem", True), (ingest.is_unsafe_name, "", True), (ingest.is_unsafe_name, "xl/styles.xml", False), (ingest.is_unsafe_name, "a..b/c...d", False),
        (ingest.extension, "v1.2/.xlsx", ""), (ingest.extension, "report.final.XLSX", ".xlsx"), (ingest.extension, "none", ""), (ingest.extension_after_dot, ".xlsx", "xlsx"), (ingest.extension_after_dot, "none", ""),
        (ingest.is_document_id, "0f8fad5b-d9cb-469f-a165-70867728950e", True), (ingest.is_document_id, "0f8fad5b-d9cb-169f-a165-70867728950e", False), (ingest.is_document_id, "0F8FAD5B-d9cb-469f-a165-70867728950e", False), (ingest.is_document_id, "0f8fad5b-d9cb-469f-a165-70867728950e\n", False),
    ],
)
def test_names(spark, check, value, want):
    assert spark.range(1).select(check(F.lit(value))).first()[0] == want


def test_size_label(spark):
    assert [spark.range(1).select(ingest.size_label(F.lit(n))).first()[0] for n in (0, 1000, 2048, 1536)] == ["0.0 KB", "1.0 KB", "2.0 KB", "1.5 KB"]


def test_policy(spark):
    rows = [("PHONE", 0.1), ("PERSON", 0.85), ("PERSON", 0.6), ("PERSON", 0.59), ("ORGANIZATION", 0.7), ("LOCATION", None), ("NOTE", 0.9)]
    d = spark.createDataFrame([(1, i * 8, i * 8 + 3, *r) for i, r in enumerate(rows)], "doc_id int, start int, end int, type string, confidence double")
    graded = policy.enrich(d)
    got = [(r.confidence_level, r.privacy_status, r.redaction_action) for r in graded.orderBy("start").collect()]
    assert got == [
        ("LOW", "SENSITIVE", "AUTO_REDACT"), ("HIGH", "SENSITIVE", "AUTO_REDACT"), ("MEDIUM", "SENSITIVE", "AUTO_REDACT"), ("LOW", "SENSITIVE", "REVIEW"),
        ("MEDIUM", "REVIEW", "REVIEW"), ("LOW", "REVIEW", "REVIEW"), ("HIGH", "UNKNOWN", "KEEP"),
    ]
    asked = spark.createDataFrame([(1, "1:24:27:PERSON"), (1, "1:48:51:NOTE"), (1, "unknown")], "doc_id int, finding_id string")
    assert sorted(r.start for r in policy.select_for_redaction(graded, asked).collect()) == [0, 8, 16, 24]
    every = policy.select_all(graded)
    assert {r.finding_id for r in every.collect()} == {"1:24:27:PERSON", "1:32:35:ORGANIZATION", "1:40:43:LOCATION"} and policy.clear(every).count() == 0
    some = policy.toggle(every, asked)
    assert {r.finding_id for r in some.collect()} == {"1:32:35:ORGANIZATION", "1:40:43:LOCATION", "1:48:51:NOTE", "unknown"}
    counts = policy.counts_with_selection(graded, some).first()
    assert (counts.finding_count, counts.auto_count, counts.review_count, counts.selected_count) == (7, 3, 3, 4)


def test_boxes(spark):
    box = lambda *x: regions.bbox(*(F.lit(float(v)) for v in x))
    area = lambda a, b: spark.range(1).select(regions.intersection_area(a, b)).first()[0]
    assert area(box(0, 0, 4, 6), box(1, 2, 9, 9)) == 12 and area(box(0, 0, 4, 6), box(4, 0, 9, 9)) == 0
    assert area(box(0, 0, "inf", 3), box(0, 0, 2, 2)) == 0 and area(box(0, "nan", 3, 3), box(0, 0, 2, 2)) == 0
    assert spark.range(1).select(regions.overlap_ratio(box(0, 0, 9, 9), box(2, 2, 4, 5))).first()[0] == 1


def test_fragments_and_occurrences(spark):
    d = spark.sql("select 'Can Deniz Er' as v, array('Can', 'Deniz', 'qq', '') as f")
    r = d.select(regions.fragment_starts(F.col("v"), F.col("f")).alias("s"), regions.occurrence_starts(F.lit("oloxolo"), F.lit("olo")).alias("o")).first()
    assert r.s == [0, 4, 6, 9] and r.o == [0, 4]
    at = lambda t, v, s: tuple(spark.range(1).select(regions.occurrence(F.lit(t), F.lit(v), F.lit(s)).alias("x")).first().x)
    assert at("a.b.a.b", "a.b", 4) == (1, 2) and at("a.b.a.b", "a.b", 3) == (0, 2) and at("xyz", "q", 0) == (0, 1)


def test_settings(monkeypatch):
    monkeypatch.delenv(settings.ORIGINS, raising=False)
    assert settings.entries(settings.ORIGINS, ("http://one",)) == ["http://one"] and settings.text(settings.UPLOAD_ROOT, "tmp") == "tmp"
    monkeypatch.setenv(settings.ORIGINS, " http://a ,, http://b,")
    monkeypatch.setenv(settings.UPLOAD_ROOT, "  /data ")
    assert settings.entries(settings.ORIGINS) == ["http://a", "http://b"] and settings.text(settings.UPLOAD_ROOT, "tmp") == "/data"
    monkeypatch.setenv(settings.ORIGINS, "http://a,*")
    with pytest.raises(ValueError):
        settings.entries(settings.ORIGINS)
    monkeypatch.setenv(settings.ORIGINS, " , ")
    assert settings.entries(settings.ORIGINS, ("d",)) == ["d"]
