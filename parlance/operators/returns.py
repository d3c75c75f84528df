"""Forward returns of events from daily prices: an as-of join without a range join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HORIZONS = (1, 3, 5, 10)


def fetch_windows(events: DataFrame, before: int = 10, after: int = 20) -> DataFrame:
    """The days for which a ticker's prices are needed."""
    return events.groupBy("ticker").agg(F.date_sub(F.min("event_date"), before).alias("start"), F.date_add(F.max("event_date"), after).alias("end"))


def cumulative(now: Column, then: Column) -> Column:
    """(then - now) / now; null if now is null or 0."""
    return F.when(now != 0, (then - now) / now)


def forward_returns(events: DataFrame, prices: DataFrame, horizons: Sequence[int] = HORIZONS, bucket_days: int | None = None) -> DataFrame:
    """Distinct (ticker, event_date) with base_date, the first trading day on or after it, and ret_{k}d.

    Prices and events of a ticker are sorted together and the next price is carried along a running window, so the cost
    is linear after a sort by ticker and date, and no pair is tried. Later prices are looked up by trading day, counted in
    rows that exist. A ticker is one sort group of its days, or, with bucket_days, one for each so many days: then the
    prices that follow a bucket, as many as the longest horizon needs, are carried into it first, so that a ticker which
    holds all rows is many tasks.
    """
    p = prices.where(F.col("adj_close").isNotNull()).select("ticker", F.col("date").cast("date").alias("date"), "adj_close")
    wanted = events.select("ticker", F.col("event_date").cast("date").alias("date")).na.drop().distinct()
    if bucket_days is None:
        return _returns(p, wanted, ["ticker"], horizons)
    bucket = F.floor(F.unix_date("date") / bucket_days).alias("_b")
    p, wanted = p.select("*", bucket), wanted.select("*", bucket)
    return _returns(p.unionByName(_carried(p, wanted, max(horizons) + 1)), wanted, ["ticker", "_b"], horizons)


def _carried(p: DataFrame, wanted: DataFrame, deep: int) -> DataFrame:
    """For each bucket the `deep` prices behind it, as rows of the bucket. A bucket with prices has one at least, so they
    are among the heads of the next `deep` such buckets; a bucket without any takes those of the next one that has some."""
    heads = p.groupBy("ticker", "_b").agg(F.slice(F.array_sort(F.collect_list(F.struct("date", "adj_close"))), 1, deep).alias("head"))
    on = Window.partitionBy("ticker").orderBy("_b").rowsBetween(0, deep)
    full = heads.select("ticker", "_b", F.slice(F.flatten(F.collect_list("head").over(on)), 1, deep).alias("full"))
    asked = wanted.select("ticker", "_b").distinct().join(heads, ["ticker", "_b"], "left_anti").withColumn("full", F.lit(None).cast(full.schema["full"].dataType))
    behind = Window.partitionBy("ticker").orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    tails = full.unionByName(asked).select("ticker", "_b", F.last("full", ignorenulls=True).over(behind).alias("tail"))
    return tails.select("ticker", "_b", F.explode("tail").alias("t")).select("ticker", "t.date", "t.adj_close", "_b")


def _returns(p: DataFrame, wanted: DataFrame, keys: list[str], horizons: Sequence[int]) -> DataFrame:
    """forward_returns by sort groups of keys, each of which holds all the prices that its events need."""
    w = Window.partitionBy(*keys).orderBy("date")
    ahead = [F.lead("adj_close", k).over(w).alias(f"_p{k}") for k in horizons]
    days = p.select(*keys, "date", "adj_close", *ahead)
    days = days.select(*keys, "date", F.struct(F.col("date").alias("base_date"), F.col("adj_close").alias("p0"), *[F.col(f"_p{k}") for k in horizons]).alias("row"), F.lit(1).alias("is_price"))
    wanted = wanted.withColumn("row", F.lit(None).cast(days.schema["row"].dataType)).withColumn("is_price", F.lit(0))
    # From the last day backwards the next price is the last one seen, a running value; a price comes before an event of
    # its own day, so that day counts. (A frame that grows forwards would be computed anew for each row.)
    look = Window.partitionBy(*keys).orderBy(F.col("date").desc(), F.col("is_price").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = days.unionByName(wanted).withColumn("next", F.last("row", ignorenulls=True).over(look)).where("is_price = 0")
    return met.select("ticker", F.col("date").alias("event_date"), F.col("next.base_date").alias("base_date"), *[cumulative(F.col("next.p0"), F.col(f"next._p{k}")).alias(f"ret_{k}d") for k in horizons])


def event_returns(transcripts: DataFrame, prices: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """transcript_id, ticker, event_date and returns; the prices are looked up once for each distinct event."""
    t = transcripts.select("transcript_id", "ticker", F.col("event_date").cast("date").alias("event_date")).na.drop(subset=["ticker", "event_date"])
    found = forward_returns(t, prices, horizons).drop("base_date")
    return t.join(found, ["ticker", "event_date"], "left").select("transcript_id", "ticker", "event_date", *[f"ret_{k}d" for k in horizons])


def fill_rates(returns: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    return returns.agg(F.count(F.lit(1)).alias("n_events"), *[F.round(F.avg(F.col(f"ret_{k}d").isNotNull().cast("int")), 6).alias(f"fill_{k}d") for k in horizons])
