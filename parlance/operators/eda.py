"""Corpus exploration and checks as sets of lazy frames, to be written or collected by the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import dates, text
from parlance.operators import profile


def run_eda(df: DataFrame) -> dict[str, DataFrame]:
    """Ten tables and two summaries of a raw corpus with company, title, date and text."""
    d = df.withColumn("_day", dates.parse_date(F.col("date").cast("string"))).withColumn("_key", text.company_key(F.col("company")))
    d = d.withColumn("_quarter", dates.year_quarter(F.year("_day"), F.quarter("_day")))
    empty = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    return {
        "companies": profile.value_counts(d, "company"),
        "companies_normalised": profile.value_counts(d, "_key"),
        "quarters": profile.value_counts(d, "_quarter"),
        "years": d.groupBy(F.year("_day").alias("year")).agg(F.count(F.lit(1)).alias("n")),
        "months": d.groupBy(F.date_format("_day", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n")),
        "weekdays": d.groupBy(F.date_format("_day", "EEEE").alias("weekday")).agg(F.count(F.lit(1)).alias("n")),
        "titles": profile.top(d, "title", 50),
        "variants": profile.variants(d.where(F.col("company").isNotNull()), "company", F.col("_key")),
        "coverage": profile.coverage(d, "_key", "_quarter", 100),
        "word_bins": profile.floor_bins(d, text.n_words(F.col("text")), 1000),
        "char_bins": profile.floor_bins(d, F.length("text"), 10_000),
        "duplicates": profile.exact_duplicates(d, "text"),
        "frequency": profile.upper_median_of_counts(d.where(~empty("company")), "_key"),
        "missing": d.agg(*[F.count_if(empty(c)).alias(f"missing_{c}") for c in ("company", "title", "date", "text")]),
    }


def run_checks(transcripts: DataFrame, segments: DataFrame, chunks: DataFrame, duplicates: DataFrame, most_tokens: int = 200) -> dict[str, DataFrame]:
    """What the four tables hold: sizes, nulls, token statistics, sections, coverage, duplicates and orphans."""
    return {
        "rows": transcripts.agg(F.count(F.lit(1)).alias("transcripts")).crossJoin(segments.agg(F.count(F.lit(1)).alias("segments"))).crossJoin(chunks.agg(F.count(F.lit(1)).alias("chunks"))).crossJoin(duplicates.agg(F.count(F.lit(1)).alias("duplicates"))),
        "null_transcripts": profile.nulls(transcripts, ["transcript_id", "company", "event_date", "clean_text"]),
        "null_chunks": profile.nulls(chunks, ["chunk_id", "transcript_id", "segment_id", "chunk_text"]),
        "tokens": profile.describe(chunks, "n_tokens"),
        "over_limit": chunks.agg(F.count_if(F.col("n_tokens") > most_tokens).alias("over"), F.count_if(F.col("n_tokens") < 5).alias("tiny")),
        "sections": profile.value_counts(segments, "section"),
        "quarters": profile.value_counts(transcripts, "year_quarter"),
        "reasons": profile.value_counts(duplicates, "duplicate_reason"),
        "orphan_segments": profile.orphans(segments, transcripts, "transcript_id"),
        "orphan_chunks": profile.orphans(chunks, segments, "segment_id"),
        "tokens_by_transcript": transcripts.select("transcript_id").join(chunks.groupBy("transcript_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_chunks")), "transcript_id", "left").na.fill(0, ["n_tokens", "n_chunks"]),
    }
