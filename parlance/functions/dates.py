"""Dates as column expressions; what cannot be read is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Formats in the order in which they are tried. A weekday in front is cut off before.
FORMATS = ("yyyy-M-d", "M/d/yyyy", "MMM d, yyyy", "MMMM d, yyyy", "MMMM d, yyyy h:mm a", "MMM d ''yy")
_WEEKDAY = r"^(?i)(?:mon|tues|wednes|thurs|fri|satur|sun)day,\s*"
_IN_TEXT = (r"\b(20\d{2}-\d{1,2}-\d{1,2})\b", r"\b(\d{1,2}/\d{1,2}/20\d{2})\b", r"\b([A-Za-z]+\s+\d{1,2},\s+20\d{2})\b")


def parse_date(c: Column) -> Column:
    """A date written alone, with or without a weekday or a time."""
    t = F.regexp_replace(F.trim(c), _WEEKDAY, "")
    iso = F.try_to_date(F.nullif(F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})(?:[T ].*)?$", 1), F.lit("")), "yyyy-MM-dd")
    return F.coalesce(iso, *[F.try_to_date(t, f) for f in FORMATS])


def date_in(c: Column) -> Column:
    """The first date of the 2000s in a text, by the patterns in order."""
    return F.coalesce(*[parse_date(F.nullif(F.regexp_extract(c, p, 1), F.lit(""))) for p in _IN_TEXT])


def event_date(derived: Column, stamp: Column, date: Column, header: Column, scraped: Column) -> Column:
    """The fields as dates, then dates inside them, then in the header, then the time of scraping."""
    # As functions over short arrays: written out, these are some 200 date parsers, too many for one compiled method.
    first = lambda columns, read: F.get(F.filter(F.transform(F.array(*columns), read), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(first((derived, stamp, date), parse_date), first((date, stamp, derived, header), date_in), parse_date(scraped))


def quarter_in(c: Column) -> Column:
    return F.regexp_extract(c, r"(?i)\bQ([1-4])\b", 1).try_cast("int")


def year_in(c: Column) -> Column:
    return F.regexp_extract(c, r"\b(20\d{2})\b", 1).try_cast("int")


def year_quarter(year: Column, quarter: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("Q"), quarter.cast("string"))


def quarter_number(label: Column) -> Column:
    """Quarters since the year 0 of a label such as 2021Q3; null for anything else, so that an ascending sort with nulls
    last puts bad labels behind all quarters."""
    year, quarter = F.regexp_extract(label, r"^(\d{4})Q([1-4])$", 1), F.regexp_extract(label, r"^(\d{4})Q([1-4])$", 2)
    return year.try_cast("int") * 4 + quarter.try_cast("int") - 1


def date_windows(spark: SparkSession, start: str, end: str, days: int) -> DataFrame:
    """Windows (start, end) of so many days, the last one cut at the end."""
    if days < 1:
        raise ValueError("days must be 1 or more")
    if end < start:
        raise ValueError("end lies before start")
    one = spark.range(1).select(F.explode(F.expr(f"sequence(date'{start}', date'{end}', interval {days} days)")).alias("window_start"))
    return one.select("window_start", F.least(F.date_add("window_start", days - 1), F.to_date(F.lit(end))).alias("window_end"))


def next_window_days(days: Column, rows: Column, failed: Column, least: int = 1, most: int = 30) -> Column:
    """Half the window after an error or many rows, a day more after few rows."""
    half = F.greatest(F.lit(least), F.lit(1), F.floor(days / 2).cast("int"))
    return F.when(failed | (rows > 700), half).when(rows < 80, F.least(F.lit(most), days + 1)).otherwise(days)


def quarters(low: Column, high: Column) -> Column:
    """All quarters (yyyyQn) from one date to another."""
    first = lambda c: F.date_trunc("quarter", c).cast("date")
    return F.transform(F.sequence(first(low), first(high), F.expr("interval 3 months")), lambda d: year_quarter(F.year(d), F.quarter(d)))
