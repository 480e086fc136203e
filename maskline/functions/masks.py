"""Masks that keep a value's length and layout, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskline.functions.text import ALNUM, NOT_ALNUM, NOT_SPACE

# Mail domains that are shown whole.
PUBLIC_DOMAINS = ("gmail.com", "outlook.com", "hotmail.com", "yahoo.com", "icloud.com", "yandex.com", "proton.me", "protonmail.com")
WORD_TYPES = ("PERSON", "LOCATION", "ORGANIZATION")


def stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), n.cast("int"))


def mask_part(c: Column) -> Column:
    """First and last character stay if there are more than two."""
    n = F.length(c)
    return F.when(n <= 2, stars(n)).otherwise(F.concat(F.substring(c, 1, 1), stars(n - 2), F.substring(c, -1, 1)))


def mask_words(c: Column) -> Column:
    """Each run of other characters than white space by the rule of mask_part."""
    n = NOT_SPACE
    for pattern, to in ((f"(?<!{n}){n}{n}(?!{n})", "**"), (f"(?<!{n}){n}(?!{n})", "*"), (f"(?<={n}){n}(?={n})", "*")):
        c = F.regexp_replace(c, pattern, to)
    return c


def mask_letters_digits(c: Column) -> Column:
    return F.regexp_replace(c, ALNUM, "*")


def _mask_between(c: Column, shown: int, otherwise: Column) -> Column:
    """The first few and the last letter or digit stay; otherwise applies where there are fewer."""
    front = F.regexp_extract(c, rf"(?s)\A(?:{NOT_ALNUM}*{ALNUM}){{{shown}}}", 0)
    back = F.regexp_extract(c, rf"(?s){ALNUM}{NOT_ALNUM}*\z", 0)
    inner = F.substring(c, F.length(front) + 1, F.length(c) - F.length(front) - F.length(back))
    enough = (front != "") & (F.length(front) + F.length(back) <= F.length(c))
    return F.when(enough, F.concat(front, mask_letters_digits(inner), back)).otherwise(otherwise)


def mask_number(c: Column) -> Column:
    return _mask_between(c, 1, mask_letters_digits(c))


def mask_iban(c: Column) -> Column:
    return _mask_between(c, 2, c)


def is_email(c: Column) -> Column:
    label = "[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
    return F.coalesce(c.rlike(rf"\A[A-Za-z0-9._%+-]+@{label}(?:\.{label})+\z"), F.lit(False))


def mask_email(c: Column) -> Column:
    local, domain = F.substring_index(c, "@", 1), F.substring_index(c, "@", -1)
    labels = F.split(domain, r"\.")
    masked = F.array_join(F.concat(F.transform(F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(0))), mask_part), F.slice(labels, -1, 1)), ".")
    shown = F.when(F.lower(domain).isin(*PUBLIC_DOMAINS), domain).otherwise(masked)
    return F.when(is_email(c), F.concat(mask_part(local), F.lit("@"), shown)).otherwise(stars(F.length(c)))


def mask_value(c: Column, kind: Column) -> Column:
    """The mask of a value of a finding's type."""
    return (
        F.when(kind == "TCKN", stars(F.length(c)))
        .when(kind.isin(*WORD_TYPES), mask_words(c))
        .when(kind == "IBAN", mask_iban(c))
        .when(kind.isin("PHONE", "CARD_NUMBER"), mask_number(c))
        .when(kind == "EMAIL", mask_email(c))
        .otherwise(mask_letters_digits(c))
    )


def guarded(mask: Column, width: Column) -> Column:
    """The mask, or stars over the whole span where their lengths differ."""
    return F.when(F.length(mask) == width, mask).otherwise(stars(width))


def segment(mask: Column, start: Column, end: Column, width: Column) -> Column:
    """A box's part of a mask; stars for the whole value where its offsets don't fit."""
    fits = start.isNotNull() & end.isNotNull() & (start >= 0) & (start < end) & (end <= F.length(mask))
    return F.when(fits, F.substring(mask, start + 1, end - start)).otherwise(stars(width))


def drawable(text: Column) -> Column:
    """A segment as it is drawn on a page: control breaks as spaces."""
    return F.translate(text, "\r\n\t", "   ")
