"""Rule detectors: text to findings with code-point offsets, in one scan and without Python."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskline.functions import checks
from maskline.functions.text import DIGIT, EDGE, SPACE, strip

OPEN, CLOSE = chr(0xE000), chr(0xE001)
#: Letters that fold to A-Z count with them: dotted and dotless i, long s, the Kelvin sign.
_GUARD = r"[A-Za-z0-9\u0130\u0131\u017F\u212A]"
_GAP = f"(?:{SPACE}|-)?"


def long_number(t: Column) -> Column:
    """Ten digits with at most one white space or hyphen between two: what every kind of number has."""
    return t.rlike(rf"(?:{DIGIT}{_GAP}){{9}}{DIGIT}")


@dataclass(frozen=True)
class Detector:
    """A pattern, what a match must pass, and how its value is written.

    gate and need only spare texts that can't match; need is looked at once for neighbours that share it.
    """

    type: str
    pattern: str
    confidence: float
    gate: Callable[[Column], Column]
    valid: Callable[[Column], Column] | None = None
    normalize: Callable[[Column], Column] | None = None
    clean: Callable[[Column], Column] | None = None
    need: Callable[[Column], Column] | None = None


# Patterns and confidences by type. Gates only spare texts that can't match.
DETECTORS: tuple[Detector, ...] = (
    Detector("EMAIL", rf"{EDGE}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{EDGE}", 0.99, lambda t: t.contains("@")),
    Detector("PHONE", rf"(?<!{DIGIT})(?:\+90|0090|0)?{_GAP}5{DIGIT}{{2}}{_GAP}{DIGIT}{{3}}{_GAP}{DIGIT}{{2}}{_GAP}{DIGIT}{{2}}(?!{DIGIT})", 0.95, lambda t: t.rlike(rf"5{DIGIT}{{2}}"), clean=strip, need=long_number),
    Detector("TCKN", rf"(?<!{DIGIT})[1-9]{DIGIT}{{10}}(?!{DIGIT})", 0.99, lambda t: t.rlike(rf"[1-9]{DIGIT}{{10}}"), checks.is_tckn, need=long_number),
    Detector("IBAN", rf"(?<!{_GUARD})[Tt][Rr]{DIGIT}{{2}}(?:{SPACE}?{DIGIT}{{4}}){{5}}{SPACE}?{DIGIT}{{2}}(?!{_GUARD})", 0.99, lambda t: t.rlike(rf"[Tt][Rr]{DIGIT}{{2}}"), checks.is_tr_iban, checks.normalize_iban, need=long_number),
    Detector("CARD_NUMBER", rf"(?<!{DIGIT})(?:{DIGIT}[ -]?){{12,18}}{DIGIT}(?!{DIGIT})", 0.99, lambda t: t.rlike(rf"(?:{DIGIT}[ -]?){{12}}{DIGIT}"), checks.is_card, checks.normalize_card, need=long_number),
)
RULE_TYPES = tuple(d.type for d in DETECTORS)


def _matches(text: Column, d: Detector) -> Column:
    """The pattern's matches in text as an array of (start, end, value); null without one.

    Matches are marked, the text is split at the marks, and the lengths of the pieces are added up on the way.
    Only a text that passes the gate is looked at further.
    """
    clean = F.when(text.contains(OPEN) | text.contains(CLOSE), F.translate(text, OPEN + CLOSE, chr(0xFFFD) * 2)).otherwise(text)
    pieces = F.split(F.regexp_replace(clean, d.pattern, f"{OPEN}$0{CLOSE}"), OPEN, -1)
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def place(acc: Column, piece: Column) -> Column:
        value = F.substring_index(piece, CLOSE, 1)
        one = F.struct(acc["at"].alias("start"), (acc["at"] + F.length(value)).alias("end"), value.alias("value"))
        first = acc["out"].isNull()  # the text before the first mark
        return F.struct(F.when(first, F.length(piece)).otherwise(acc["at"] + F.length(piece) - 1).alias("at"), F.when(first, none).otherwise(F.concat(F.coalesce(acc["out"], none), F.array(one))).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit(None).cast("array<struct<start:int,end:int,value:string>>").alias("out"))
    return F.when(d.gate(text), F.aggregate(pieces, begin, place, lambda acc: acc["out"]))


def found(text: Column, detectors: Sequence[Detector] = DETECTORS) -> Column:
    """All pattern matches in text, valid or not, as an array of (detector_ord, match_ord, start, end, value), in the order of detectors."""
    none = F.array().cast("array<struct<detector_ord:int,match_ord:int,start:int,end:int,value:string>>")

    def of(i: int, d: Detector) -> Column:
        numbered = lambda x, k: F.struct(F.lit(i).alias("detector_ord"), k.alias("match_ord"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"))
        return F.coalesce(F.transform(_matches(text, d), numbered), none)

    groups = [(need, F.concat(*(of(i, d) for i, d in some))) for need, some in groupby(enumerate(detectors), key=lambda x: x[1].need)]
    return F.concat(none, *(F.when(need(text), made).otherwise(none) if need else made for need, made in groups))


def _by_detector(detectors: Sequence[Detector], ord_: Column, make: Callable[[Detector], Column | None], otherwise: Column) -> Column:
    out = otherwise
    for i, d in enumerate(detectors):
        made = make(d)
        if made is not None:
            out = F.when(ord_ == i, made).otherwise(out)
    return out


def is_valid(match: Callable[[str], Column], detectors: Sequence[Detector] = DETECTORS) -> Column:
    """Whether a match, given as a function of its fields' names, passes its detector's check."""
    return _by_detector(detectors, match("detector_ord"), lambda d: d.valid(match("value")) if d.valid else None, F.lit(True))


def as_finding(match: Callable[[str], Column], detectors: Sequence[Detector] = DETECTORS) -> list[Column]:
    """The columns of a finding out of a valid match."""
    value, at = match("value"), match("detector_ord")
    return [
        _by_detector(detectors, at, lambda d: F.lit(d.type), F.lit("")).alias("type"),
        _by_detector(detectors, at, lambda d: d.clean(value) if d.clean else None, value).alias("value"), match("start").alias("start"), match("end").alias("end"),
        _by_detector(detectors, at, lambda d: F.lit(d.confidence), F.lit(0.0)).alias("confidence"), F.lit("rule_engine").alias("source"),
        _by_detector(detectors, at, lambda d: d.normalize(value) if d.normalize else None, F.lit(None).cast("string")).alias("normalized_value"),
        at.alias("detector_ord"), match("match_ord").alias("match_ord"),
    ]


def findings(text: Column, detectors: Sequence[Detector] = DETECTORS) -> Column:
    """The findings in text as an array of structs, inside its row: null text, null."""
    valid = F.filter(found(text, detectors), lambda x: is_valid(lambda n: x[n], detectors))
    return F.when(text.isNotNull(), F.transform(valid, lambda x: F.struct(*as_finding(lambda n: x[n], detectors))))


def candidates(pages: DataFrame, keys: Sequence[str], text: str = "text", detectors: Sequence[Detector] = DETECTORS) -> DataFrame:
    """(keys, detector_ord, match_ord, start, end, value) of all pattern matches, valid or not.

    Each row of pages stands for itself: offsets are found inside the row, so equal rows, and rows of one
    key with other texts, give their own matches. Nothing is shuffled.
    """
    # outer: else the optimiser repeats the whole search in a filter in front
    hit = pages.where(F.col(text).isNotNull()).select(*keys, F.explode_outer(found(F.col(text), detectors)).alias("f")).where("f is not null")
    return hit.select(*keys, "f.*")


def detect(pages: DataFrame, keys: Sequence[str], text: str = "text", detectors: Sequence[Detector] = DETECTORS) -> DataFrame:
    """Findings of all detectors: (keys, type, value, start, end, confidence, source, normalized_value, ...).

    Overlapping findings of different detectors are all kept. Their order in a page is that of
    (start, detector_ord, match_ord).
    """
    return candidates(pages, keys, text, detectors).where(is_valid(F.col, detectors)).select(*keys, *as_finding(F.col, detectors))
