"""Partial dates and years."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fuzzy_date(x: Column) -> Column:
    """year, month and day of a partial ISO date, as far as it goes; null if it is none."""
    shape = r"^\s*(\d{4})(?:[-/](\d{1,2})(?:[-/](\d{1,2}))?)?\s*$"
    part = lambda i: F.regexp_extract(x, shape, i).try_cast("int")
    year, month, day = part(1), part(2), part(3)
    fine = x.rlike(shape) & (month.isNull() | month.between(1, 12)) & (day.isNull() | day.between(1, 31))
    return F.when(fine, F.struct(year.alias("year"), month.alias("month"), day.alias("day")))


def fuzzy_to_int(d: Column) -> Column:
    """A partial date as one number that sorts by date; missing parts count as 0."""
    return d["year"] * 10000 + F.coalesce(d["month"], F.lit(0)) * 100 + F.coalesce(d["day"], F.lit(0))


def fuzzy_from_int(n: Column) -> Column:
    month, day = F.floor(n / 100) % 100, n % 100
    return F.struct(
        F.floor(n / 10000).cast("int").alias("year"),
        F.nullif(month.cast("int"), F.lit(0)).alias("month"),
        F.nullif(day.cast("int"), F.lit(0)).alias("day"),
    )


def fuzzy_start(d: Column) -> Column:
    """The first day that a partial date may mean."""
    return F.make_date(d["year"], F.coalesce(d["month"], F.lit(1)), F.coalesce(d["day"], F.lit(1)))


def parse_date(x: Column) -> Column:
    """The first format that fits: ISO, day first with a month's name, US, year and month, year."""
    formats = ("yyyy-MM-dd", "d MMM yyyy", "d MMMM yyyy", "MM/dd/yyyy", "yyyy-MM", "yyyy")
    return F.coalesce(*(F.try_to_timestamp(x, F.lit(f)).cast("date") for f in formats))


def year(x: Column) -> Column:
    """The first four digits on their own between 1500 and 2100."""
    found = F.regexp_extract(x, r"(?<!\d)(1[5-9]\d\d|20\d\d|2100)(?!\d)", 1)
    return found.try_cast("int")


def nomenclatural_year(x: Column, today: int) -> Column:
    """year and whether it is unlikely; a question mark for the last digit counts as 0."""
    text = F.regexp_replace(x, r"(?<!\d)(\d{3})\?", "$10")
    found = F.regexp_extract(text, r"(?<!\d)(\d{4})(?!\d)", 1).try_cast("int")
    return F.struct(found.alias("year"), ((found < 1753) | (found > today + 1)).alias("unlikely"))


def compare_years(a: Column, b: Column, tolerance: int = 2) -> Column:
    """EQUAL, UNKNOWN within the tolerance or where a year is missing, else DIFFERENT."""
    apart = F.abs(a - b)
    return (
        F.when(a.isNull() | b.isNull(), "UNKNOWN")
        .when(apart == 0, "EQUAL")
        .when(apart <= tolerance, "UNKNOWN")
        .otherwise("DIFFERENT")
    )
