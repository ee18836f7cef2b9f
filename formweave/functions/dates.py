"""Dates, day first as in Vietnamese documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_accents

_NUMERIC = "([0-9]{1,2})\\s*[/\\-.]\\s*([0-9]{1,2})\\s*[/\\-.]\\s*([0-9]{2,4})"
_WORDED = "ngay\\s+([0-9]{1,2})\\s+thang\\s+([0-9]{1,2})\\s+nam\\s+([0-9]{2,4})"
_TIME = "([0-9]{1,2})\\s*[:hg]\\s*([0-9]{2})"


def _date(y: Column, m: Column, d: Column) -> Column:
    text = F.format_string("%04d-%02d-%02d", y, m, d)
    return F.when(y.between(1, 9999) & m.between(1, 12) & d.between(1, 31), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


def search_date(c: Column) -> Column:
    """The first date anywhere in a text, as DATE; two-digit years are of this century."""
    s = F.lower(strip_accents(c))
    numeric = s.rlike(_NUMERIC)

    def part(k: int) -> Column:
        return F.when(numeric, F.regexp_extract(s, _NUMERIC, k)).otherwise(F.regexp_extract(s, _WORDED, k)).try_cast("int")

    year = part(3)
    return _date(F.when(year < 100, year + 2000).otherwise(year), part(2), part(1))


def search_datetime(c: Column) -> Column:
    """``YYYY-MM-DDTHH:MM``, or the date alone where no valid time is found."""
    day, s = search_date(c), strip_accents(c)
    hh, mm = F.regexp_extract(s, _TIME, 1).try_cast("int"), F.regexp_extract(s, _TIME, 2).try_cast("int")
    iso = F.date_format(day, "yyyy-MM-dd")
    return F.when(day.isNotNull() & hh.between(0, 23) & mm.between(0, 59), F.concat(iso, F.format_string("T%02d:%02d", hh, mm))).otherwise(iso)


def parse_date(c: Column) -> Column:
    """A text that is a date as a whole: ISO (its first ten characters) or d/m/Y, d-m-Y, Y/m/d."""
    s = F.trim(c)

    def take(pattern: str, y: int, m: int, d: int) -> Column:
        p = lambda k: F.regexp_extract(s, pattern, k).try_cast("int")
        return F.when(s.rlike(pattern), _date(p(y), p(m), p(d)))

    return F.coalesce(
        take("^([0-9]{4})-([0-9]{2})-([0-9]{2})([T ].*)?$", 1, 2, 3),
        take("^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$", 3, 2, 1),
        take("^([0-9]{1,2})-([0-9]{1,2})-([0-9]{4})$", 3, 2, 1),
        take("^([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})$", 1, 2, 3),
    )


def iso_date(d: Column, m: Column, y: Column) -> Column:
    """Midnight UTC as text, unchecked."""
    return F.format_string("%04d-%02d-%02dT00:00:00+00:00", y.cast("int"), m.cast("int"), d.cast("int"))


def add_years(c: Column, years: Column) -> Column:
    """The same day of another year; 29 February becomes the 28th."""
    return F.add_months(c, years * 12)
