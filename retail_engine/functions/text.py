"""Clean-up, checks and parsing of text that clients send."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space in client text, and the form of an email address.
WHITE_SPACE = (
    "\t\n\x0b\f\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
SPACE = f"[{WHITE_SPACE}]"
_PART = f"[^@{WHITE_SPACE}]+"
EMAIL = rf"\A{_PART}@{_PART}\.{_PART}\z"

# A number at the start of a text; what follows it is ignored.
_LEADING_NUMBER = rf"\A{SPACE}*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
# A whole number, also written with a plus sign or zero decimals.
_WHOLE = rf"\A{SPACE}*\+?(\d+)(?:\.0*)?{SPACE}*\z"
# Text that starts like a calendar date; a bare time of day is not one.
_DATE_LIKE = rf"\A{SPACE}*\d{{4}}"
# Other spellings of a date, tried in this order, each also with a time of day.
_DATES = (
    "MMM d, yyyy", "MMMM d, yyyy", "MMM d yyyy", "MMMM d yyyy", "d MMM yyyy", "d MMMM yyyy",
    "M/d/yyyy", "yyyy/M/d",
)
_DATE_FORMATS = tuple(
    day + time for day in _DATES for time in ("[ H:mm[:ss]]", " h:mm[:ss] a")
)
# What tells formats apart, and the same of a text: it starts with a number, has a comma, has a
# slash, ends with a digit.
_MARKS = (
    (lambda f: not f.startswith("MMM"), lambda date: date.rlike(r"\A[+-]?[0-9]")),
    (lambda f: "," in f, lambda date: date.contains(",")),
    (lambda f: "/" in f, lambda date: date.contains("/")),
    (lambda f: not f.endswith("a"), lambda date: date.rlike(r"[0-9]\z")),
)
# A day of the week says nothing that the date does not.
_WEEKDAY = rf"\A{SPACE}*(?i:sun|mon|tue|wed|thu|fri|sat)[a-z]*,?{SPACE}+"


def trimmed(text: str) -> Column:
    """Without white space of any kind at both ends; the plain trim knows blanks only."""
    return F.btrim(F.col(text), F.lit(WHITE_SPACE))


def email_ok(text: str) -> Column:
    """Checked as sent: an address with white space around it is not valid."""
    return F.col(text).rlike(EMAIL)


def phone_or_null(text: str) -> Column:
    """Trimmed phone; an empty one is NULL, one of white space only becomes empty."""
    return F.when(F.col(text) != "", trimmed(text))


def number_text(text: str) -> Column:
    """The number a text starts with, as it is written, or NULL."""
    return F.nullif(F.regexp_extract(F.col(text), _LEADING_NUMBER, 1), F.lit(""))


def below_zero(number: str) -> Column:
    """Whether a written number is negative, however small it is; -0 is not."""
    return F.col(number).rlike(r"\A-[0.]*[1-9]")


def leading_number(text: str) -> Column:
    """The number a text starts with, rounded to ten places; NULL when there is none or it is
    too large."""
    return number_text(text).try_cast("decimal(38,10)")


def whole_quantity(text: str) -> Column:
    """A whole number, or NULL for anything else (also 1e2 and 3abc)."""
    return F.regexp_extract(F.col(text), _WHOLE, 1).try_cast("bigint")


def _tried(date: Column, formats: Sequence[str], marks: Sequence = _MARKS) -> Column:
    """The time by the first of the formats that fits; those that lack a mark of the text, or
    have one it lacks, cannot."""
    if not formats:
        return F.lit(None).cast("timestamp")
    if not marks:
        return F.coalesce(*(F.try_to_timestamp(date, F.lit(f)) for f in formats))
    (of_format, of_text), *rest = marks
    having = [f for f in formats if of_format(f)]
    lacking = [f for f in formats if not of_format(f)]
    return F.when(of_text(date), _tried(date, having, rest)).otherwise(_tried(date, lacking, rest))


def parsed_time(text: str) -> Column:
    """The time a text names, or NULL.

    A format that does not fit costs an exception, so only those are tried whose marks the text
    has. The text without its weekday is bound once, as an array of one, and shared by them all.
    """
    iso = F.when(F.col(text).rlike(_DATE_LIKE), F.col(text).try_cast("timestamp"))
    date = F.regexp_replace(F.col(text), _WEEKDAY, "")
    other = F.transform(F.array(date), lambda d: _tried(d, _DATE_FORMATS))
    return F.coalesce(iso, F.element_at(other, 1))
