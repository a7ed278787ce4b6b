from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from retail_engine.functions import labels, text


def values(spark, kind, items, function):
    df = spark.createDataFrame(list(enumerate(items)), f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(function("v")).collect()]


def test_shorthand(spark):
    amounts = [0.0, 999.0, 999.5, 1000.0, 99999.99, 100000.0, 500000.0, 9999999.0, 10000000.0]
    assert values(spark, "double", amounts, labels.shorthand) == [
        "₹0", "₹999", "₹999.5", "₹1K", "₹100K", "₹1.0L", "₹5.0L", "₹100.0L", "₹1.0Cr",
    ]


def test_rupees(spark):
    amounts = [0.0, 12.5, 999.0, 1000.0, 123456.0, 1234567.891, 98765432101.0, -54321.005]
    assert values(spark, "double", amounts, labels.rupees) == [
        "₹0.00", "₹12.50", "₹999.00", "₹1,000.00", "₹1,23,456.00", "₹12,34,567.89",
        "₹98,76,54,32,101.00", "-₹54,321.01",
    ]


def test_date_labels(spark):
    day = [date(2024, 2, 25)]
    assert values(spark, "date", day, labels.axis_date) == ["25 Feb"]
    assert values(spark, "date", day, labels.long_date) == ["25 February 2024"]
    time = [datetime(2024, 2, 25, 17, 5)]
    assert values(spark, "timestamp", time, labels.date_time) == ["25 Feb 2024, 05:05 pm"]


def test_trim_takes_every_white_space(spark):
    texts = ["\t a b\u00a0", "\u3000\ufeffx\n", "   ", ""]
    assert values(spark, "string", texts, text.trimmed) == ["a b", "x", "", ""]


@pytest.mark.parametrize(
    ("address", "good"),
    [
        ("a@b.c", True),
        ("a.b+c@d.e.f", True),
        (" a@b.c", False),
        ("a@b.c\n", False),
        ("a@b", False),
        ("a@@b.c", False),
        ("a b@c.d", False),
        ("a@b.c\u00a0", False),
    ],
)
def test_email(spark, address, good):
    assert values(spark, "string", [address], text.email_ok) == [good]


def test_phone(spark):
    assert values(spark, "string", [None, "", "  ", " 1 "], text.phone_or_null) == [
        None, None, "", "1",
    ]


def test_quantity(spark):
    given = ["3", "3.0", "3.", " 4 ", "+5", "3abc", "1e2", "1.5", "-1", "0", "", None, "9" * 30]
    assert values(spark, "string", given, text.whole_quantity) == [
        3, 3, 3, 4, 5, None, None, None, None, 0, None, None, None,
    ]


def test_leading_number(spark):
    given = ["12.50", "12 INR", "1e2", "-3", ".5", "abc", "", None]
    found = values(spark, "string", given, text.leading_number)
    assert [None if v is None else float(v) for v in found] == [
        12.5, 12.0, 100.0, -3.0, 0.5, None, None, None,
    ]


def test_times(spark):
    given = ["2024-02-25", "2024-02-25T10:11:12Z", "Feb 25, 2024", "2/25/2024", "soon", "10:11"]
    day = datetime(2024, 2, 25)
    assert values(spark, "string", given, text.parsed_time) == [
        day, datetime(2024, 2, 25, 10, 11, 12), day, day, None, None,
    ]


def test_other_spellings_of_dates(spark):
    given = [
        "25 Feb 2024", "Sun Feb 25 2024", "2/25/2024 10:30", "Feb 25, 2024 10:30",
        "Sunday, February 25, 2024", "25 February 2024 10:30:15", "2/25/2024 1:05 PM",
        "2024/2/25 10:30", "Feb 30, 2024", "Sun", "25 Feb 2024 noon",
    ]
    day, time = datetime(2024, 2, 25), datetime(2024, 2, 25, 10, 30)
    assert values(spark, "string", given, text.parsed_time) == [
        day, day, time, time, day, datetime(2024, 2, 25, 10, 30, 15),
        datetime(2024, 2, 25, 13, 5), time, None, None, None,
    ]


def test_formats_that_cannot_fit_are_not_tried():
    """Each kind of text is left with the formats of its own marks, two of the sixteen."""
    left = {}
    for f in text._DATE_FORMATS:
        left.setdefault(tuple(of(f) for of, _ in text._MARKS), []).append(f)
    assert [len(of) for of in left.values()] == [2] * 8


def test_marks_leave_out_no_format_that_fits(spark):
    given = [
        day + time
        for day in (
            "Feb 5, 2024", "FEBRUARY 5, 2024", "may 05 2024", "\u017fep 5 2024", "5 feb 2024",
            "+5 Feb 2024", "0002/3/2024", "2/30/2024", "2024/2/3", "-2/3/2024",
            " 5 Feb 2024", "Feb 5,2024", "Feb/5/2024", "soon", "soon, 5/", "",
        )
        for time in ("", " 9:05", " 9:05:07", " 9:05 pm", " 13:05 PM", " 9:05:07 AM", " noon", "\n")
    ]

    def tried_all(column):
        return F.coalesce(*(F.try_to_timestamp(column, F.lit(f)) for f in text._DATE_FORMATS))

    want = values(spark, "string", given, tried_all)
    assert values(spark, "string", given, text.parsed_time) == want
    assert sum(v is not None for v in want) > 25
