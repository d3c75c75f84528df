"""Exact quantiles of groups of any size: histograms that close in on the wanted ranks.

Percentile aggregates hold a group's distinct values in one buffer. Here each round counts, for each wanted rank, how
many values fall into each of a fixed number of bins between the bounds that the rank is known to lie in; the bin with
the rank gives the next bounds, its least and greatest value. Only counts and bounds travel, a row for each bin and task.
The least and the greatest value of a range are never in one bin, so ranges shrink to single values, by the number of
bins in each round where values are spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.session import shared_folder

BINS = 1024
#: Wanted ranks up to which they are broadcast to the rows.
MOST_BROADCAST = 100_000


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], bins: int = BINS) -> DataFrame:
    """keys, share, quantile (linear between neighbouring ranks) and n, for each key and share; nulls and NaN are left out.

    Reads df once and then once for each round, three or four for a billion values; callers cut its lineage first. Null
    keys are keys of their own."""
    spark = df.sparkSession
    v = F.col(value).cast("double")
    rows = df.select(*keys, v.alias("_v")).where(v.isNotNull() & ~F.isnan(v))
    each = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    at = F.explode(F.array(*[F.struct(F.lit(float(s)).alias("share"), (F.lit(float(s)) * (F.col("_n") - 1)).alias("at")) for s in shares]))
    ranks = each.withColumn("_s", at).select(*keys, "_n", "_low", "_high", "_s.share", F.col("_s.at").alias("_at"))
    ranks = ranks.select("*", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("_rank")).withColumn("_before", F.lit(0).cast("long"))
    first, found = ranks.select(*keys, "share", "_at", "_n").distinct(), None
    name = shared_folder(spark, "quantiles")
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    for turn in range(200):
        ranks.write.parquet(f"{name}/{turn}")
        ranks = spark.read.parquet(f"{name}/{turn}")
        done = ranks.where("_low = _high").select(*keys, "share", "_rank", F.col("_low").alias("_v"))
        found = done if found is None else found.unionByName(done)
        ranks = ranks.where("_low < _high")
        n = ranks.count()
        if not n:
            break
        wanted = (F.broadcast(ranks) if n <= MOST_BROADCAST else ranks).alias("w")
        inside = (F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high"))
        on = inside
        for c in same(_Named("r"), _Named("w")) if keys else []:
            on &= c
        met = rows.alias("r").join(wanted, on)
        whole, v, low, high = F.col("_high") - F.col("_low"), F.col("_v"), F.col("_low"), F.col("_high")
        # In halves where the range is too large for a double.
        part = F.when(whole == float("inf"), F.try_divide(v / 2 - low / 2, high / 2 - low / 2)).otherwise((v - low) / whole)
        own = [F.col(f"w.{c}").alias(c) for c in (*keys, "share", "_rank", "_before", "_at", "_n")]
        met = met.select(*own, F.least(F.lit(bins - 1), F.floor(part * bins)).cast("int").alias("_bin"), "_v")
        group = [*keys, "share", "_rank", "_before", "_at", "_n"]
        counts = met.groupBy(*group, "_bin").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        upto = F.sum("_c").over(Window.partitionBy(*keys, "share", "_rank").orderBy("_bin"))  # `bins` rows at most
        counts = counts.withColumn("_upto", F.col("_before") + upto).where((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_c") <= F.col("_rank")))
        ranks = counts.select(*keys, "_n", "_low", "_high", "share", "_at", "_rank", (F.col("_upto") - F.col("_c")).alias("_before"))
    else:
        raise RuntimeError("the ranges of the ranks have not closed")
    pairs = first.alias("f").join(found.alias("g"), _all([*same(_Named("f"), _Named("g")), F.col("f.share") == F.col("g.share")]))
    own = [F.col(f"f.{c}").alias(c) for c in (*keys, "share", "_at", "_n")]
    both = pairs.select(*own, "_rank", "_v").groupBy(*keys, "share", "_at", "_n").agg(F.min_by("_v", "_rank").alias("_a"), F.max_by("_v", "_rank").alias("_b"))
    part = F.col("_at") - F.floor("_at")
    return both.select(*keys, "share", F.when(part == 0, F.col("_a")).otherwise(F.col("_a") * (1 - part) + F.col("_b") * part).alias("quantile"), F.col("_n").alias("n"))


class _Named:
    def __init__(self, name: str):
        self.name = name

    def __getitem__(self, column: str):
        return F.col(f"{self.name}.{column}")


def _all(tests: list):
    out = tests[0]
    for t in tests[1:]:
        out &= t
    return out
