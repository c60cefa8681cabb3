"""Characters, lines and numbers in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW, _UP = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def upper_ascii(c: Column) -> Column:
    """a-z as A-Z, all else unchanged."""
    return F.translate(c, _LOW, _UP)


def equal_ignoring_case(a: Column, b: Column) -> Column:
    return upper_ascii(a) == upper_ascii(b)


def digit(c: Column) -> Column:
    """Value of a decimal digit; -1 for anything else."""
    return F.coalesce(F.when(c.rlike("^[0-9]$"), c).cast("int"), F.lit(-1))


def trimmed_length(s: Column) -> Column:
    """Length without blanks and line feeds at the end."""
    return F.length(F.rtrim(s, F.lit(" \n")))


def word_count(s: Column, separators: str = " \n") -> Column:
    """Words between separators, by default blanks and line feeds (tabs do not separate)."""
    return F.size(F.filter(F.split(s, f"[{separators}]"), lambda w: w != ""))


_MANTISSA = r"(?:\d+\.?\d*|\.\d*)"


def real(s: Column) -> Column:
    """The number at the start of s, by the grammar of free-format reals; null if there is none.

    Blanks, tabs, commas and semicolons may stand before; then a sign, blanks, digits with a point, and an exponent by E
    or D with a sign and a fraction of its own. Any other character ends it. A marker without exponent digits is an
    error. Without digits before the exponent the value is 0; an exponent below -20 gives 0.
    """
    t = F.regexp_replace(s, r"^[ \t,;]+", "")
    found = t.rlike(rf"^[+-]?[ \t]*(?:{_MANTISSA}|[eEdD])") & ~t.rlike(rf"^[+-]?[ \t]*{_MANTISSA}?[eEdD][+-]?+(?![\d.])")
    number = F.regexp_replace(F.regexp_extract(t, rf"^([+-]?[ \t]*{_MANTISSA})", 0), r"[ \t]", "")
    mantissa = F.when(number.rlike(r"\d"), number).otherwise("0").cast("double")
    power = F.regexp_extract(t, rf"^[+-]?[ \t]*{_MANTISSA}?[eEdD]([+-]?{_MANTISSA})", 1)
    exponent = F.when(power.rlike(r"\d"), power).otherwise("0").cast("double")
    scaled = F.when(exponent < -20, F.lit(0.0)).when(exponent == 0, mantissa).otherwise(mantissa * F.pow(F.lit(10.0), exponent))
    return F.when(found, scaled)


def reals(s: Column, n: int) -> Column:
    """The first n blank- or comma-separated numbers of s."""
    parts = F.filter(F.split(s, r"[\s,;]+"), lambda w: w != "")
    return F.transform(F.slice(parts, 1, n), real)


def prefix_real(s: Column) -> Column:
    """The longest number at the start of s; 0 if there is none (what C's atof gives)."""
    number = F.regexp_extract(F.ltrim(s), r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", 0)
    return F.when(number == "", F.lit("0")).otherwise(number).cast("double")


def time_text(ts: Column) -> Column:
    """A time as day, month's name, year and a twelve-hour clock."""
    return F.date_format(ts, "dd MMMM yyyy hh:mm:ss a")
