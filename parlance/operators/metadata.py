"""Company, ticker, date and quarter of a transcript."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import dates, text

_FIELDS = ("title", "company", "ticker", "derived_event_date", "datetime", "date", "scraped_at")


def extract_metadata(df: DataFrame, company_map: DataFrame | None = None) -> DataFrame:
    """df (raw_text and any of the raw fields) with company, ticker, event_date, year, quarter, year_quarter and title.

    company_map: company, ticker; looked up by the stripped company where no ticker was found. Adaptive execution
    decides how it is joined; repeated companies count once (their least ticker).
    """
    d = df
    for name in _FIELDS:
        if name not in d.columns:
            d = d.withColumn(name, F.lit(None).cast("string"))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    d = d.withColumn("_head", text.head(F.coalesce("raw_text", F.lit(""))))
    d = d.withColumn("title", text.title_or_first_line(F.col("title"), F.coalesce("raw_text", F.lit(""))))
    d = d.withColumn("company", text.company_or_from_title(F.col("company"), F.col("title")))
    d = d.withColumn("ticker", F.when(blank("ticker"), text.ticker_in(F.col("_head"))).otherwise(F.col("ticker")))
    if company_map is not None:
        known = company_map.groupBy(F.col("company").alias("_company")).agg(F.min("ticker").alias("_ticker"))
        d = d.join(known, F.trim("company") == F.col("_company"), "left").withColumn("ticker", F.when(blank("ticker"), F.col("_ticker")).otherwise(F.col("ticker"))).drop("_company", "_ticker")
    day = dates.event_date(F.col("derived_event_date"), F.col("datetime"), F.col("date"), F.col("_head"), F.col("scraped_at"))
    d = d.withColumn("_day", day)
    d = d.withColumn("year", F.coalesce(F.year("_day"), dates.year_in(F.col("_head"))).cast("smallint"))
    quarter = F.coalesce(dates.quarter_in(F.coalesce("title", F.lit(""))), dates.quarter_in(F.col("_head")), F.quarter("_day"))
    d = d.withColumn("quarter", quarter.cast("tinyint"))
    return d.withColumns({"year_quarter": dates.year_quarter(F.col("year"), F.col("quarter")), "event_date": F.date_format("_day", "yyyy-MM-dd")}).drop("_head", "_day")


def extend_map(existing: DataFrame, new: DataFrame, key: str = "company") -> DataFrame:
    """Both maps together; where both know a key, the existing entry stays."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti"))
