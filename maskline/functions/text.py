"""Regular-expression classes that make Java's engine agree with Unicode-aware matching."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGIT = r"\p{Nd}"
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
NOT_SPACE = r"[^\s\x1c-\x1f\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
EDGE = rf"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))"
ALNUM = r"[\p{L}\p{N}]"
NOT_ALNUM = r"[^\p{L}\p{N}]"


def strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, rf"\A{SPACE}+", ""), rf"{SPACE}+\z", "")


def is_blank(c: Column) -> Column:
    return F.coalesce(~c.rlike(NOT_SPACE), F.lit(True))


@cache
def _folds() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Characters that fold to one other than their lower case, those others, and (character, text) of those that fold to several."""
    one, to, many = [], [], []
    for c in map(chr, range(sys.maxunicode + 1)):
        full = c.casefold()
        if len(full) == 1 and full != c:
            one.append(c)
            to.append(full)
        elif len(full) > 1:
            many.append((c, full))
    return "".join(one), "".join(to), tuple(many)


def folded(c: Column) -> Column:
    """Full case folding: single characters by a table, those that become several one by one where any occurs."""
    one, to, many = _folds()
    any_ = c.rlike("[" + "".join(x for x, _ in many) + "]")
    long = c
    for x, full in many:
        long = F.replace(long, F.lit(x), F.lit(full))
    return F.translate(F.when(any_, long).otherwise(c), one, to)


@cache
def _digits() -> str:
    """The decimal digits of all scripts but 0-9, each script's from its zero on."""
    zeros = [c for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd" and unicodedata.digit(chr(c)) == 0]
    return "".join(chr(z + d) for z in zeros for d in range(10))


def ascii_digits(c: Column) -> Column:
    """Decimal digits of any script as 0-9."""
    return F.translate(c, _digits(), "0123456789" * (len(_digits()) // 10))
