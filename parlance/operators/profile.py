"""Profiles of tables: counts, shares, quantiles, bins, coverage, checks. Each is one or two aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.dates import quarters


def value_counts(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Rows of each value (null included) and their share in percent."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias(name))
    total = counts.agg(F.sum(name).alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select(column, name, F.round(100 * F.col(name) / F.col("_total"), 6).alias("share_pct"))


def top(df: DataFrame, column: str, k: int, name: str = "n") -> DataFrame:
    """The k most frequent values; equal counts in order of the value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), F.asc(column)).limit(k)


def describe(df: DataFrame, column: str, quantiles: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    q = [F.round(F.percentile(column, F.lit(x)), 6).alias(f"p{round(x * 100)}") for x in quantiles]
    return df.agg(F.count(column).alias("n"), F.round(F.avg(column), 6).alias("mean"), *q, F.max(column).alias("max"))


def nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null counts of columns, as rows (column, n_null), from one scan."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.unpivot([], list(columns), "column", "n_null")


def floor_bins(df: DataFrame, value: Column, width: int, name: str = "bin") -> DataFrame:
    low = (F.floor(value / width) * width).cast("long")
    return df.select(F.concat(low.cast("string"), F.lit("-"), (low + width - 1).cast("string")).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def cut_bins(value: Column, edges: Sequence[float]) -> Column:
    """(low, high] bins by edges, the first one closed at its lower end, too; the last edge may be infinite."""
    out = F.when((value >= edges[0]) & (value <= edges[1]), F.lit(f"{edges[0]}-{edges[1]}"))
    for a, b in zip(edges[1:], edges[2:]):
        out = out.when((value > a) & (value <= b), F.lit(f"{a}-{b}"))
    return out


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """bins equal widths from the least to the greatest value, which falls into the last bin: rows (bin, n)."""
    edge = df.agg(F.min(column).cast("double").alias("_a"), F.max(column).cast("double").alias("_b"))
    d = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(edge))
    at = F.when(F.col("_a") == F.col("_b"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(column) - F.col("_a")) / (F.col("_b") - F.col("_a")) * bins)))
    return d.select(at.cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def upper_median_of_counts(df: DataFrame, column: str) -> DataFrame:
    """Upper median of the values' frequencies, from the frequencies' own counts (a short table at any scale)."""
    freq = df.groupBy(column).agg(F.count(F.lit(1)).alias("f"))
    of = freq.groupBy("f").agg(F.count(F.lit(1)).alias("c"))
    lists = of.agg(F.array_sort(F.collect_list(F.struct("f", "c"))).alias("a"), F.sum("c").alias("n"))
    half = F.floor(F.col("n") / 2)
    at = F.aggregate("a", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("f")), lambda s, x: F.when(s["f"].isNotNull(), s).otherwise(F.struct((s["seen"] + x["c"]).alias("seen"), F.when(s["seen"] + x["c"] > half, x["f"]).alias("f"))))
    return lists.select(at["f"].alias("upper_median"), F.col("n").alias("n_values"))


def variants(df: DataFrame, raw: str, key: Column) -> DataFrame:
    """Keys with more than one spelling: key, n_variants, variants (joined in order) and n rows."""
    each = df.select(key.alias("key"), F.col(raw).alias("raw")).groupBy("key", "raw").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("key").agg(F.count("raw").alias("n_variants"), F.array_join(F.array_sort(F.collect_set("raw")), " | ").alias("variants"), F.sum("n").alias("n")).where("n_variants > 1")


def coverage(df: DataFrame, entity: str, period: str, k: int | None = None) -> DataFrame:
    """Distinct periods of each entity over all distinct periods, six digits; the first k by ratio, then entity."""
    each = df.select(entity, period).na.drop().distinct()
    total = each.agg(F.count_distinct(period).alias("_all"))
    out = each.groupBy(entity).agg(F.count(F.lit(1)).alias("n_periods")).crossJoin(F.broadcast(total)).select(entity, "n_periods", F.round(F.col("n_periods") / F.col("_all"), 6).alias("coverage"))
    return out if k is None else out.orderBy(F.desc("coverage"), F.asc(entity)).limit(k)


def in_every_quarter(df: DataFrame, entity: str, day: str) -> DataFrame:
    """Entities present in every quarter from the first to the last, quarters without any row included."""
    d = df.select(entity, F.col(day).cast("date").alias("d")).na.drop()
    span = d.agg(F.size(quarters(F.min("d"), F.max("d"))).alias("_n"))
    each = d.select(entity, F.date_trunc("quarter", "d").alias("q")).distinct().groupBy(entity).agg(F.count(F.lit(1)).alias("n_quarters"))
    return each.join(F.broadcast(span), F.col("n_quarters") == F.col("_n")).select(entity, "n_quarters")


def pivot_counts(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Counts of row by column; the values are named, so no extra scan finds them."""
    return df.groupBy(row).pivot(column, list(values)).count().na.fill(0)


def exact_duplicates(df: DataFrame, text: str) -> DataFrame:
    """Rows in groups of equal texts and the number of such groups."""
    groups = df.groupBy(F.sha1(F.col(text))).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("dup_rows"), F.count(F.lit(1)).alias("dup_groups"))


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Distinct keys of child that parent lacks."""
    return child.select(key).where(F.col(key).isNotNull()).distinct().join(parent.select(key).distinct(), key, "left_anti")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson over pairs of columns, each over the rows where both are known: rows (a, b, corr), from one scan."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    both = lambda a, b: F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b)))
    one = df.agg(*[F.round(both(a, b), 6).alias(f"{a}|{b}") for a, b in pairs])
    return one.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "corr").select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("a"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("b"), "corr")


def box_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Quartiles of each column as rows."""
    long = df.unpivot([], list(columns), "column", "value").where("value is not null")
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return long.groupBy("column").agg(q.alias("q"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("value").alias("n")).select("column", "low", "high", "n", *[F.col("q")[i].alias(f"q{i + 1}") for i in range(3)])


def line(df: DataFrame, y: str, x: str) -> DataFrame:
    """Least-squares line: slope, intercept, r2 and n."""
    return df.agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 6).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"), F.regr_count(y, x).alias("n"))


def funnel(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows that pass the first step, the first two, and so on: one scan."""
    passed, out = F.lit(True), []
    for name, condition in steps:
        passed &= F.coalesce(condition, F.lit(False))
        out.append(F.count_if(passed).alias(name))
    return df.agg(*out)


def sample_by_hash(df: DataFrame, key: str, one_in: int) -> DataFrame:
    """One row in so many by a digest of its key: the same rows however the table is cut."""
    return df.where(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % one_in == 0)


def split_by_hash(df: DataFrame, key: str, percent: int = 85) -> DataFrame:
    """Adds is_train, true for so many percent of the keys."""
    return df.withColumn("is_train", F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % 100 < percent)


def sample_of(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows, those with the least digests of their key."""
    return df.orderBy(F.md5(F.col(key).cast("string")), F.col(key)).limit(n)
