"""The panel: sentiment of both roles, returns and metadata of each transcript."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import source_of_path
from parlance.operators.dedup import keep_first
from parlance.schemas import PANEL, conform

KEYS = ("transcript_id", "ticker", "event_date")


def roles_side_by_side(aggregated: DataFrame, keys=KEYS) -> DataFrame:
    """score_exec, score_analyst, their numbers of chunks and divergence; equal to a full outer join of the two roles,
    since a key has one row for each role, but with one aggregate and no join."""
    of = lambda role, c: F.max(F.when(F.col("speaker_role") == role, F.col(c)))
    both = aggregated.where(F.col("speaker_role").isin("exec", "analyst")).groupBy(*keys)
    wide = both.agg(of("exec", "mean_score").alias("score_exec"), of("analyst", "mean_score").alias("score_analyst"), of("exec", "n_chunks").alias("n_chunks_exec"), of("analyst", "n_chunks").alias("n_chunks_analyst"))
    return wide.withColumn("divergence", F.col("score_exec") - F.col("score_analyst"))


def is_smallcap(source: Column) -> Column:
    return F.coalesce(source == "r2k", F.lit(False)).cast("int")


def build_panel(aggregated: DataFrame, returns: DataFrame, meta: DataFrame) -> DataFrame:
    """aggregated, left joined with the first returns of (ticker, event_date) and the first metadata of transcript_id.

    meta: transcript_id, company, year, quarter, year_quarter and source or source_path."""
    day = F.to_timestamp("event_date")
    wide = roles_side_by_side(aggregated).withColumn("event_date", day)
    rets = [c for c in returns.columns if c.startswith("ret_")]
    r = keep_first(returns.select("ticker", F.to_timestamp("event_date").alias("event_date"), "transcript_id", *rets), ["ticker", "event_date"], ["transcript_id"]).drop("transcript_id")
    if "source" not in meta.columns:
        meta = meta.withColumn("source", source_of_path(F.col("source_path")))
    m = keep_first(meta.select("transcript_id", "source", "company", "year", "quarter", "year_quarter"), ["transcript_id"], ["source"])
    out = wide.join(r, ["ticker", "event_date"], "left").join(m, "transcript_id", "left")
    return conform(out.withColumn("is_smallcap", is_smallcap(F.col("source"))), PANEL)
