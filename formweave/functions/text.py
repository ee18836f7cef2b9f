"""Text normalisation as column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Zero-width characters that recognisers leave behind.
ZERO_WIDTH = "[\\u200b-\\u200f\\u2060\\ufeff]"


@cache
def _folds() -> tuple[str, str]:
    """Letters with marks and what they fold to, from the Unicode data of the Latin ranges."""
    src, dst = "Đđ", "Dd"
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if len(base) == 1 and base != c and c not in "Đđ":
            src, dst = src + c, dst + base
    return src, dst


def strip_accents(c: Column) -> Column:
    """Letters without their marks, Đ as D; composed and decomposed input alike."""
    return F.regexp_replace(F.translate(c, *_folds()), "\\p{Mn}+", "")


def clean_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "(?U)\\s+", " "))


def norm_key(c: Column) -> Column:
    """The form labels are compared in."""
    return F.btrim(clean_spaces(F.lower(strip_accents(c))), F.lit(" :.…-"))


def drop_zero_width(c: Column) -> Column:
    return F.regexp_replace(c, ZERO_WIDTH, "")


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null where nothing matches (``regexp_extract`` gives an empty text)."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))
