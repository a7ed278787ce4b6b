"""Text labels for amounts and dates in report rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Currency sign, and the units of the shorthand.
RUPEE = "₹"
CRORE = 10_000_000
LAKH = 100_000
THOUSAND = 1_000

# Between the digits of an integer where a comma belongs: before the last three digits,
# and before every two to the left of them.
_COMMA_PLACE = r"(?<=\d)(?=(\d{2})*\d{3}(\.|\z))"


def grouped(number: Column) -> Column:
    """Digits grouped as 12,34,567."""
    return F.regexp_replace(number.cast("string"), _COMMA_PLACE, ",")


def rupees(amount: str) -> Column:
    """₹12,34,567.89, with the minus sign in front."""
    value = F.round(F.col(amount).cast("decimal(38,6)"), 2).cast("decimal(34,2)")
    return F.concat(F.when(value < 0, "-").otherwise(""), F.lit(RUPEE), grouped(F.abs(value)))


def shorthand(amount: str) -> Column:
    """₹1.2Cr, ₹3.4L, ₹56K; below a thousand the number as it is."""
    value = F.col(amount).cast("decimal(38,6)")
    plain = F.regexp_replace(value.cast("string"), r"\.?0+\z", "")

    def scaled(unit: int, digits: int) -> Column:
        return F.round(value / unit, digits).cast(f"decimal(34,{digits})").cast("string")

    return (
        F.when(value >= CRORE, F.concat(F.lit(RUPEE), scaled(CRORE, 1), F.lit("Cr")))
        .when(value >= LAKH, F.concat(F.lit(RUPEE), scaled(LAKH, 1), F.lit("L")))
        .when(value >= THOUSAND, F.concat(F.lit(RUPEE), scaled(THOUSAND, 0), F.lit("K")))
        .otherwise(F.concat(F.lit(RUPEE), plain))
    )


def axis_date(day: str) -> Column:
    return F.date_format(day, "dd MMM")


def long_date(day: str) -> Column:
    return F.date_format(day, "dd MMMM yyyy")


def date_time(time: str) -> Column:
    """25 Feb 2024, 05:30 am"""
    return F.concat(
        F.date_format(time, "dd MMM yyyy, hh:mm "), F.lower(F.date_format(time, "a"))
    )


def status_tag(status: str) -> Column:
    return F.lower(status)
