"""Checksums of identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskline.functions.text import SPACE, ascii_digits


def digits(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit("[0-9]"), 0), lambda x: x.cast("int"))


def normalize_card(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?:{SPACE}|-)+", "")


def is_card(c: Column) -> Column:
    """13 to 19 digits that pass the Luhn check."""
    n = ascii_digits(normalize_card(c))
    return F.coalesce(n.rlike(r"\A[0-9]{13,19}\z") & F.call_function("luhn_check", n), F.lit(False))


def normalize_iban(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, rf"{SPACE}+", ""))


def is_tr_iban(c: Column) -> Column:
    """TR and 24 digits with remainder 1 modulo 97."""
    n = ascii_digits(normalize_iban(c))
    # T and R count as 29 and 27
    moved = F.concat(F.substring(n, 5, 22), F.lit("2927"), F.substring(n, 3, 2))
    shaped = n.rlike(r"\ATR[0-9]{24}\z")
    return F.coalesce(shaped & (F.when(shaped, moved).cast("decimal(38,0)") % 97 == 1), F.lit(False))


def is_tckn(c: Column) -> Column:
    """11 digits, no leading zero, with both check digits right."""
    n = ascii_digits(c)
    d = digits(n)
    at = lambda *k: sum((F.get(d, i) for i in k[1:]), F.get(d, k[0]))
    tenth = F.pmod(7 * at(0, 2, 4, 6, 8) - at(1, 3, 5, 7), F.lit(10))
    return F.coalesce(n.rlike(r"\A[1-9][0-9]{10}\z") & (tenth == F.get(d, 9)) & (at(*range(10)) % 10 == F.get(d, 10)), F.lit(False))
