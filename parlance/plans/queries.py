"""Registered queries over the star-schema tables: each applies operators of this library to whole tables, with the SQL
that says the same. documents stand for transcripts, conversations for segments, events for scored chunks and prices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import dates, text
from parlance.operators import dedup, panel, profile, regress, returns, segment, sentiment
from parlance.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """The frame, written to the shared folder and read back, so that nothing above it runs again."""
    folder = shared_folder(df.sparkSession, "stored")
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


# -- shared inputs ----------------------------------------------------------------------------------------------------
def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int") % 3
    day = F.date_format("ts", "yyyy-MM-dd")
    label = F.when(F.col("event_type") == "purchase", "positive").when(F.col("event_type") == "error", "negative").otherwise("neutral")
    return e.select(
        F.concat(F.col("user_id").cast("string"), F.lit("_"), day).alias("transcript_id"), F.col("user_id").cast("string").alias("ticker"), day.alias("event_date"),
        sentiment.role_of(F.when(k == 0, "Executive").when(k == 1, "Analyst").otherwise("Operator")).alias("speaker_role"), sentiment.label_score(label).alias("sentiment_score"), label.alias("sentiment_label"),
    )


SCORED = """scored AS (SELECT user_id || '_' || strftime(ts, '%Y-%m-%d') AS transcript_id, CAST(user_id AS VARCHAR) AS ticker, strftime(ts, '%Y-%m-%d') AS event_date,
  CASE CAST(json_extract_string(props, '$.k') AS INT) % 3 WHEN 0 THEN 'exec' WHEN 1 THEN 'analyst' ELSE 'other' END AS speaker_role,
  CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'error' THEN -1.0 ELSE 0.0 END AS sentiment_score,
  CASE event_type WHEN 'purchase' THEN 'positive' WHEN 'error' THEN 'negative' ELSE 'neutral' END AS sentiment_label FROM events)"""
AGG = SCORED + """, agg AS (SELECT transcript_id, ticker, event_date, speaker_role, avg(sentiment_score) AS mean_score, median(sentiment_score) AS median_score, stddev_samp(sentiment_score) AS std_score, count(sentiment_score) AS n_chunks FROM scored GROUP BY ALL)"""
WIDE = AGG + """, wide AS (SELECT transcript_id, ticker, event_date, max(mean_score) FILTER (speaker_role = 'exec') AS score_exec, max(mean_score) FILTER (speaker_role = 'analyst') AS score_analyst,
  max(n_chunks) FILTER (speaker_role = 'exec') AS n_chunks_exec, max(n_chunks) FILTER (speaker_role = 'analyst') AS n_chunks_analyst FROM agg WHERE speaker_role IN ('exec', 'analyst') GROUP BY ALL)"""
RETS = """prices AS (SELECT CAST(user_id AS VARCHAR) AS ticker, CAST(ts AS DATE) AS d, avg(value) AS p, row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE)) AS rn FROM events GROUP BY user_id, CAST(ts AS DATE)),
ev AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS ticker, CAST(ts AS DATE) + 1 AS event_date FROM events WHERE event_type <> 'view'),
base AS (SELECT ev.ticker, ev.event_date, min(rn) AS rn FROM ev LEFT JOIN prices ON prices.ticker = ev.ticker AND prices.d >= ev.event_date GROUP BY ALL),
rets AS (SELECT base.ticker, base.event_date, p0.d AS base_date, (p1.p - p0.p) / nullif(p0.p, 0) AS ret_1d, (p3.p - p0.p) / nullif(p0.p, 0) AS ret_3d, (p5.p - p0.p) / nullif(p0.p, 0) AS ret_5d, (p10.p - p0.p) / nullif(p0.p, 0) AS ret_10d FROM base
  LEFT JOIN prices p0 ON p0.ticker = base.ticker AND p0.rn = base.rn LEFT JOIN prices p1 ON p1.ticker = base.ticker AND p1.rn = base.rn + 1 LEFT JOIN prices p3 ON p3.ticker = base.ticker AND p3.rn = base.rn + 3
  LEFT JOIN prices p5 ON p5.ticker = base.ticker AND p5.rn = base.rn + 5 LEFT JOIN prices p10 ON p10.ticker = base.ticker AND p10.rn = base.rn + 10)"""
R6 = lambda c: F.round(c, 6).alias(c)
RET_COLS = [f"ret_{k}d" for k in returns.HORIZONS]


def daily_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("ticker"), F.to_date("ts").alias("date")).agg(F.avg("value").alias("adj_close"))


def events_to_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type <> 'view'").select(F.col("user_id").cast("string").alias("ticker"), F.date_add(F.to_date("ts"), 1).alias("event_date")).distinct()


def forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns.forward_returns(events_to_price(spark, sf_dir), daily_prices(spark, sf_dir))


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.roles_side_by_side(sentiment.by_role(scored_events(spark, sf_dir)))


def typed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("Operator", "Analyst", "Executive", "Other"))), ((F.col("conv_id") * 7 + F.col("turn") * F.col("turn")) % 4 + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("transcript_id"), F.col("turn").alias("segment_order"), kind.alias("speaker_type"), F.col("text").alias("segment_text"))


TURNS = """turns AS (SELECT conv_id AS transcript_id, turn AS segment_order, CASE (conv_id * 7 + turn * turn) % 4 WHEN 0 THEN 'Operator' WHEN 1 THEN 'Analyst' WHEN 2 THEN 'Executive' ELSE 'Other' END AS speaker_type, text AS segment_text FROM conversations),
e AS (SELECT *, bool_or(speaker_type = 'Executive') OVER w AS seen FROM turns WINDOW w AS (PARTITION BY transcript_id ORDER BY segment_order ROWS UNBOUNDED PRECEDING)),
q AS (SELECT *, bool_or(speaker_type = 'Analyst' OR (speaker_type = 'Operator' AND seen AND regexp_matches(segment_text, 'question-and-answer|q&a session|open.+(line|floor).+(question|q&a)', 'i'))) OVER w AS asked FROM e WINDOW w AS (PARTITION BY transcript_id ORDER BY segment_order ROWS UNBOUNDED PRECEDING)),
labelled AS (SELECT transcript_id, segment_order, speaker_type, CASE speaker_type WHEN 'Analyst' THEN 'Q' WHEN 'Executive' THEN CASE WHEN asked THEN 'A' ELSE 'Prepared' END WHEN 'Operator' THEN 'O' ELSE CASE WHEN asked THEN 'O' ELSE 'Prepared' END END AS section FROM q)"""


# -- scalar functions -------------------------------------------------------------------------------------------------
_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\bView Summary\b', ' ', 'gi'), '\bClick here for webcast\b', ' ', 'gi'), '\r\n?', chr(10), 'g')"""
CLEANED = rf"""l AS (SELECT doc_id, source, lang, [trim(regexp_replace(x, '\s+', ' ', 'g')) FOR x IN string_split({_CLEAN}, chr(10))] AS ls FROM documents),
k AS (SELECT doc_id, source, lang, list_filter(ls, lambda x, i: NOT (i > 1 AND x <> '' AND x = ls[i - 1] AND length(x) < 140)) AS ls FROM l),
cleaned AS (SELECT doc_id, source, lang, regexp_replace(regexp_replace(array_to_string(ls, chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g') AS clean_text FROM k)"""
_SENTS = r"""list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?])\s+([A-Z0-9"''])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: x <> '')"""
_TOKENS = r"len(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'))"


@query(f"WITH {CLEANED} SELECT doc_id, clean_text FROM cleaned")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_text(F.col("text")).alias("clean_text"))


@query(
    r"""SELECT page_id, array_to_string(list_filter([trim(regexp_replace(x, '[ \t]+', ' ', 'g')) FOR x IN string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[\s\S]*?</script>', ' ', 'gi'), '<style[\s\S]*?</style>', ' ', 'gi'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), chr(10))], lambda x: x <> ''), chr(10)) AS page_text FROM pages"""
)
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.html_to_text(F.col("html")).alias("page_text"))


@query(f"SELECT doc_id, len(s) AS n_sentences, coalesce(list_max([length(x) FOR x IN s]), 0) AS longest FROM (SELECT doc_id, {_SENTS} AS s FROM documents)")
def sentence_split_stats(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", text.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n_sentences"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).alias("longest"))


@query(f"SELECT source, count(*) AS n_docs, sum(n)::BIGINT AS n_tokens, round(avg(n), 6) AS mean_tokens, round(quantile_cont(n, 0.95), 6) AS p95_tokens FROM (SELECT source, {_TOKENS.format('text')} AS n FROM documents) GROUP BY source")
def token_stats_by_source(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", text.n_tokens(F.col("text")).alias("n"))
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_tokens"), F.round(F.avg("n"), 6).alias("mean_tokens"), F.round(F.percentile("n", F.lit(0.95)), 6).alias("p95_tokens"))


@query(
    f"WITH {CLEANED}, s AS (SELECT source, lang, unnest({_SENTS.replace('text', 'clean_text')}) AS x FROM cleaned) SELECT source, lang, count(*) AS n_sentences, round(avg({_TOKENS.format('x')}), 6) AS mean_tokens, round(median({_TOKENS.format('x')}), 6) AS median_tokens, round(quantile_cont({_TOKENS.format('x')}, 0.95), 6) AS p95_tokens FROM s GROUP BY source, lang"
)
def sentence_token_profile(spark, sf_dir):
    """The flagship: clean, split into sentences, count tokens, profile by source and language in one aggregate."""
    d = table(spark, sf_dir, "documents").select("source", "lang", F.explode(text.sentences(text.clean_text(F.col("text")))).alias("x"))
    n = text.n_tokens(F.col("x"))
    return d.select("source", "lang", n.alias("n")).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n_sentences"), F.round(F.avg("n"), 6).alias("mean_tokens"), F.round(F.median("n"), 6).alias("median_tokens"), F.round(F.percentile("n", F.lit(0.95)), 6).alias("p95_tokens"))


@query(r"SELECT p_partkey, regexp_replace(lower(p_name), '[^\p{L}\p{N}_]+', '', 'g') AS title_key, trim(regexp_replace(lower(replace(p_name, '&', ' and ')), '\s+', ' ', 'g')) AS company_key FROM part")
def name_keys(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.title_key(F.col("p_name")).alias("title_key"), text.company_key(F.col("p_name")).alias("company_key"))


@query(
    r"""SELECT doc_id, length(t) > 0 AS non_empty, length(t) >= 500 AS min_length_ok, regexp_matches(lower(t), 'upgrade now|trial access|help center|log in|sign in') AS ui_junk, length(t) >= 500 AND NOT regexp_matches(lower(t), 'upgrade now|trial access|help center|log in|sign in') AS ok
FROM (SELECT doc_id, array_to_string(list_filter([trim(regexp_replace(x, '[ \t]+', ' ', 'g')) FOR x IN string_split(text, chr(10))], lambda x: x <> ''), chr(10)) AS t FROM documents)"""
)
def raw_text_flags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.text_flags(F.col("text"), 500).alias("f")).select("doc_id", "f.*")


@query("SELECT doc_id, left(sha1(source || '|' || lang || '|' || doc_id), 16) AS row_id, left(sha256(source || '|' || lang || '|' || doc_id), 24) AS uid FROM documents")
def row_ids(spark, sf_dir):
    parts = (F.col("source"), F.col("lang"), F.col("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", text.short_id(*parts).alias("row_id"), text.short_id(*parts, kind="sha256", length=24).alias("uid"))


@query(r"SELECT doc_id, left(trim(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1]), 200) AS title, CASE WHEN contains(text, ',') THEN trim(split_part(text, ',', 1)) ELSE text END AS before_comma FROM documents")
def title_fallback(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.title_or_first_line(F.lit(None).cast("string"), F.col("text")).alias("title"), text.company_before_comma(F.col("text")).alias("before_comma"))


@query("SELECT o_orderkey, CASE WHEN contains(lower(p), 'r2k') THEN 'r2k' WHEN contains(lower(p), 'sp') THEN 'sp' ELSE 'r1000' END AS source, CAST(contains(lower(p), 'r2k') AS INT) AS is_smallcap FROM (SELECT o_orderkey, o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN '/R2K/' ELSE '' END AS p FROM orders)")
def source_from_path(spark, sf_dir):
    p = F.concat(F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 3 == 0, "/R2K/").otherwise(""))
    d = table(spark, sf_dir, "orders").select("o_orderkey", text.source_of_path(p).alias("source"))
    return d.withColumn("is_smallcap", panel.is_smallcap(F.col("source")))


@query("SELECT doc_id, len(p) AS n_parts, md5(array_to_string(p, '|')) AS parts_md5 FROM (SELECT doc_id, list_sort(list_distinct(list_filter([trim(x, chr(10) || ' ') FOR x IN string_split(text, ',')], lambda x: length(x) > 1))) AS p FROM documents)")
def participants(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.participants(F.col("text")).alias("p"))
    return d.select("doc_id", F.size("p").alias("n_parts"), F.md5(F.array_join("p", "|")).alias("parts_md5"))


# -- dates ------------------------------------------------------------------------------------------------------------
@query(
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS parsed, CAST(year(o_orderdate) AS INT) AS year, CAST(quarter(o_orderdate) AS INT) AS quarter, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS year_quarter, strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%A') AS weekday FROM orders"
)
def date_formats(spark, sf_dir):
    """Dates written in three formats are read back."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 3
    written = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "M/d/yyyy")).otherwise(F.concat(F.date_format(d, "EEEE"), F.lit(", "), F.date_format(d, "MMMM d, yyyy"), F.lit(" 11:00 AM")))
    day = table(spark, sf_dir, "orders").select("o_orderkey", dates.parse_date(written).alias("day"))
    return day.select("o_orderkey", F.date_format("day", "yyyy-MM-dd").alias("parsed"), F.year("day").alias("year"), F.quarter("day").alias("quarter"), dates.year_quarter(F.year("day"), F.quarter("day")).alias("year_quarter"), F.date_format("day", "yyyy-MM").alias("month"), F.date_format("day", "EEEE").alias("weekday"))


@query("SELECT CAST(d AS DATE) AS window_start, CAST(least(d + INTERVAL 13 DAY, DATE '2001-08-01') AS DATE) AS window_end FROM range(DATE '1995-01-01', DATE '2001-08-02', INTERVAL 14 DAY) t(d)")
def date_windows(spark, sf_dir):
    return dates.date_windows(spark, "1995-01-01", "2001-08-01", 14)


@query("SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') OR count(*) > 20 THEN greatest(1, 14 // 2) WHEN count(*) < 8 THEN least(30, 15) ELSE 14 END AS next_days FROM orders GROUP BY o_custkey")
def adaptive_window(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.col("o_orderstatus") == "P").alias("failed"), F.count(F.lit(1)).alias("n"))
    rows = F.when(F.col("n") > 20, 701).when(F.col("n") < 8, 0).otherwise(100)
    return g.select("o_custkey", dates.next_window_days(F.lit(14), rows, F.col("failed")).alias("next_days"))


@query("SELECT CAST(user_id AS VARCHAR) AS ticker, CAST(min(CAST(ts AS DATE)) - 10 AS DATE) AS \"start\", CAST(max(CAST(ts AS DATE)) + 20 AS DATE) AS \"end\" FROM events GROUP BY user_id")
def fetch_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("ticker"), F.to_date("ts").alias("event_date"))
    return returns.fetch_windows(e)


# -- duplicates -------------------------------------------------------------------------------------------------------
@query("SELECT coalesce(sum(n), 0)::BIGINT AS dup_rows, count(*) AS dup_groups FROM (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)")
def exact_dup_groups(spark, sf_dir):
    return profile.exact_duplicates(table(spark, sf_dir, "documents"), "text")


@query("SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS is_duplicate FROM documents")
def dedup_exact(spark, sf_dir):
    return dedup.exact_repeats(table(spark, sf_dir, "documents"), ["text"], "doc_id").select("doc_id", "is_duplicate")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def keep_first(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return dedup.keep_first(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


def _flagged(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return dedup.deduplicate(
        d.select(F.col("doc_id").alias("ord"), F.col("text").alias("raw_text"), F.col("source").alias("company"), F.concat(F.lit("2024-"), F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.floor(F.col("doc_id") / 12) % 28 + 1).cast("string"), 2, "0")).alias("event_date"), F.concat(F.lit("2024Q"), (F.floor(F.col("doc_id") % 12 / 3) + 1).cast("string")).alias("year_quarter"), text.first_line(F.col("text")).alias("title"), text.clean_text(F.col("text")).alias("clean_text"))
    )


@query()
def dedup_three_rules(spark, sf_dir):
    """Greedy rules and a string ratio: held against plain loops in tests/test_dedup.py."""
    return _flagged(spark, sf_dir).select(F.col("ord").alias("doc_id"), "is_duplicate", "duplicate_reason")


# -- segments ---------------------------------------------------------------------------------------------------------
@query(f"WITH {TURNS} SELECT * FROM labelled")
def section_labels(spark, sf_dir):
    return segment.label_sections(typed_turns(spark, sf_dir)).select("transcript_id", "segment_order", "speaker_type", "section")


@query(f"WITH {TURNS} SELECT section, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share_pct FROM labelled GROUP BY section")
def section_distribution(spark, sf_dir):
    return profile.value_counts(segment.label_sections(typed_turns(spark, sf_dir)), "section")


@query(f"WITH {TURNS} SELECT transcript_id, count_if(section = 'Q') AS n_q, count_if(section = 'A') AS n_a, round(count_if(section = 'Q') / nullif(count_if(section = 'A'), 0), 6) AS qa_ratio, bool_or(section = 'Q') AND bool_or(section = 'A') AS has_both FROM labelled GROUP BY transcript_id")
def qa_ratio(spark, sf_dir):
    g = segment.label_sections(typed_turns(spark, sf_dir)).groupBy("transcript_id").agg(F.count_if(F.col("section") == "Q").alias("n_q"), F.count_if(F.col("section") == "A").alias("n_a"))
    return g.select("*", F.round(F.try_divide("n_q", "n_a"), 6).alias("qa_ratio"), ((F.col("n_q") > 0) & (F.col("n_a") > 0)).alias("has_both"))


@query("SELECT role, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share_pct FROM conversations GROUP BY role")
def role_mix(spark, sf_dir):
    return profile.value_counts(table(spark, sf_dir, "conversations"), "role")


# -- sentiment and panel ----------------------------------------------------------------------------------------------
@query(f"WITH {AGG} SELECT transcript_id, ticker, event_date, speaker_role, round(mean_score, 6) AS mean_score, round(median_score, 6) AS median_score, round(std_score, 6) AS std_score, n_chunks FROM agg")
def role_sentiment(spark, sf_dir):
    a = sentiment.by_role(scored_events(spark, sf_dir))
    return a.select("transcript_id", "ticker", "event_date", "speaker_role", R6("mean_score"), R6("median_score"), R6("std_score"), "n_chunks")


@query(f"WITH {SCORED} SELECT sentiment_label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share_pct FROM scored GROUP BY sentiment_label")
def label_mix(spark, sf_dir):
    return profile.value_counts(scored_events(spark, sf_dir), "sentiment_label")


@query(f"WITH {AGG} SELECT speaker_role, count(*) AS n, round(avg(mean_score), 6) AS mean, round(median(mean_score), 6) AS median, round(stddev_samp(mean_score), 6) AS std FROM agg GROUP BY speaker_role")
def role_stats(spark, sf_dir):
    a = sentiment.by_role(scored_events(spark, sf_dir))
    return a.groupBy("speaker_role").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("mean_score"), 6).alias("mean"), F.round(F.median("mean_score"), 6).alias("median"), F.round(F.stddev_samp("mean_score"), 6).alias("std"))


@query(f"WITH {WIDE} SELECT transcript_id, ticker, event_date, round(score_exec, 6) AS score_exec, round(score_analyst, 6) AS score_analyst, n_chunks_exec, n_chunks_analyst, round(score_exec - score_analyst, 6) AS divergence FROM wide")
def exec_analyst_panel(spark, sf_dir):
    return wide(spark, sf_dir).select("transcript_id", "ticker", "event_date", R6("score_exec"), R6("score_analyst"), "n_chunks_exec", "n_chunks_analyst", R6("divergence"))


@query(f"WITH {WIDE} SELECT count(score_exec - score_analyst) AS n, round(avg(score_exec - score_analyst), 6) AS mean, round(median(score_exec - score_analyst), 6) AS median, round(stddev_samp(score_exec - score_analyst), 6) AS std FROM wide")
def divergence_stats(spark, sf_dir):
    return wide(spark, sf_dir).agg(F.count("divergence").alias("n"), F.round(F.avg("divergence"), 6).alias("mean"), F.round(F.median("divergence"), 6).alias("median"), F.round(F.stddev_samp("divergence"), 6).alias("std"))


@query(f"WITH {RETS} SELECT ticker, event_date, base_date, round(ret_1d, 6) AS ret_1d, round(ret_3d, 6) AS ret_3d, round(ret_5d, 6) AS ret_5d, round(ret_10d, 6) AS ret_10d FROM rets")
def asof_returns(spark, sf_dir):
    return forward(spark, sf_dir).select("ticker", "event_date", "base_date", *[R6(c) for c in RET_COLS])


@query(f"WITH {RETS} SELECT count(*) AS n_events, round(avg(CAST(ret_1d IS NOT NULL AS INT)), 6) AS fill_1d, round(avg(CAST(ret_3d IS NOT NULL AS INT)), 6) AS fill_3d, round(avg(CAST(ret_5d IS NOT NULL AS INT)), 6) AS fill_5d, round(avg(CAST(ret_10d IS NOT NULL AS INT)), 6) AS fill_10d FROM rets")
def return_fill_rates(spark, sf_dir):
    return returns.fill_rates(forward(spark, sf_dir))


@query(
    f"WITH {RETS}, u AS (UNPIVOT (SELECT ret_1d, ret_3d, ret_5d, ret_10d FROM rets) ON ret_1d, ret_3d, ret_5d, ret_10d INTO NAME \"column\" VALUE v) SELECT \"column\", round(min(v), 6) AS low, round(max(v), 6) AS high, count(*) AS n, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS q2, round(quantile_cont(v, 0.75), 6) AS q3 FROM u GROUP BY 1"
)
def returns_boxplot(spark, sf_dir):
    return profile.box_stats(forward(spark, sf_dir), RET_COLS).select("column", R6("low"), R6("high"), "n", R6("q1"), R6("q2"), R6("q3"))


def _panel(spark, sf_dir) -> DataFrame:
    r = forward(spark, sf_dir).withColumn("transcript_id", F.concat("ticker", F.lit("_"), F.col("event_date").cast("string")))
    w = wide(spark, sf_dir)
    meta = w.select("transcript_id", F.concat(F.lit("data/"), F.when(F.col("ticker").cast("int") % 2 == 0, "r2k/").otherwise("r1000/")).alias("source_path"), F.concat(F.lit("Company "), F.col("ticker")).alias("company"), F.year("event_date").alias("year"), F.quarter("event_date").alias("quarter"), F.concat(F.lit("W"), F.weekofyear("event_date").cast("string")).alias("year_quarter"))
    return panel.build_panel(sentiment.by_role(scored_events(spark, sf_dir)), r, meta)


PANEL = f"""{WIDE}, {RETS}, pan AS (SELECT w.transcript_id, w.ticker, 'Company ' || w.ticker AS company, 'W' || weekofyear(CAST(w.event_date AS DATE)) AS year_quarter, CASE WHEN CAST(w.ticker AS INT) % 2 = 0 THEN 'r2k' ELSE 'r1000' END AS source, CAST(CAST(w.ticker AS INT) % 2 = 0 AS INT) AS is_smallcap,
  score_exec, score_analyst, score_exec - score_analyst AS divergence, n_chunks_exec, n_chunks_analyst, ret_1d, ret_3d, ret_5d, ret_10d FROM wide w LEFT JOIN rets r ON r.ticker = w.ticker AND r.event_date = CAST(w.event_date AS DATE))"""


@query(f"WITH {PANEL} SELECT transcript_id, company, year_quarter, source, is_smallcap, round(divergence, 6) AS divergence, n_chunks_exec, n_chunks_analyst, round(ret_1d, 6) AS ret_1d, round(ret_10d, 6) AS ret_10d FROM pan")
def panel_table(spark, sf_dir):
    return _panel(spark, sf_dir).select("transcript_id", "company", "year_quarter", "source", "is_smallcap", R6("divergence"), "n_chunks_exec", "n_chunks_analyst", R6("ret_1d"), R6("ret_10d"))


@query(
    f"WITH {PANEL} SELECT a.column0 AS a, a.column1 AS b, round(CASE a.column0 || a.column1 WHEN 'score_execscore_analyst' THEN c1 WHEN 'score_execret_1d' THEN c2 WHEN 'score_execret_5d' THEN c3 WHEN 'score_analystret_1d' THEN c4 WHEN 'score_analystret_5d' THEN c5 ELSE c6 END, 6) AS corr FROM (VALUES ('score_exec','score_analyst'),('score_exec','ret_1d'),('score_exec','ret_5d'),('score_analyst','ret_1d'),('score_analyst','ret_5d'),('ret_1d','ret_5d')) a(column0, column1), (SELECT corr(score_exec, score_analyst) c1, corr(score_exec, ret_1d) c2, corr(score_exec, ret_5d) c3, corr(score_analyst, ret_1d) c4, corr(score_analyst, ret_5d) c5, corr(ret_1d, ret_5d) c6 FROM pan)"
)
def correlation_matrix(spark, sf_dir):
    return profile.correlations(_panel(spark, sf_dir), ["score_exec", "score_analyst", "ret_1d", "ret_5d"])


@query(f"WITH {PANEL} SELECT round(regr_slope(ret_5d, divergence), 6) AS slope, round(regr_intercept(ret_5d, divergence), 6) AS intercept, round(regr_r2(ret_5d, divergence), 6) AS r2, regr_count(ret_5d, divergence)::BIGINT AS n FROM pan")
def scatter_line(spark, sf_dir):
    return profile.line(_panel(spark, sf_dir), "ret_5d", "divergence")


@query(f"WITH {PANEL} SELECT count(*) AS all_rows, count_if(score_exec IS NOT NULL) AS with_exec, count_if(score_exec IS NOT NULL AND score_analyst IS NOT NULL) AS with_both, count_if(score_exec IS NOT NULL AND score_analyst IS NOT NULL AND coalesce(ret_1d, ret_3d, ret_5d, ret_10d) IS NOT NULL) AS with_return FROM pan")
def sample_funnel(spark, sf_dir):
    return profile.funnel(_panel(spark, sf_dir), [("all_rows", F.lit(True)), ("with_exec", F.col("score_exec").isNotNull()), ("with_both", F.col("score_analyst").isNotNull()), ("with_return", F.coalesce(*RET_COLS).isNotNull())])


@query(
    f"""WITH {PANEL}, d AS (SELECT ret_1d AS y, divergence AS x, year_quarter AS g FROM pan WHERE ret_1d IS NOT NULL AND divergence IS NOT NULL AND year_quarter IS NOT NULL), e AS (SELECT g, y - avg(y) OVER (PARTITION BY g) AS y, x - avg(x) OVER (PARTITION BY g) AS x FROM d),
b AS (SELECT sum(x * y) / sum(x * x) AS coef, sum(x * x) AS sxx, count(*) AS n, count(DISTINCT g) AS levels FROM e) SELECT round(coef, 6) AS coef, round(sqrt(sum((x * (y - coef * x)) ** 2) / (sxx * sxx) * n / (n - levels - 1)), 6) AS std_err, n, levels FROM e, b GROUP BY coef, sxx, n, levels"""
)
def regression_within(spark, sf_dir):
    return regress.within_slope(_panel(spark, sf_dir), "ret_1d", "divergence", "year_quarter").select(R6("coef"), R6("std_err"), "n", "levels")


@query(
    f"""WITH {PANEL}, d AS (SELECT ret_1d AS y, divergence AS x, year_quarter AS g FROM pan WHERE ret_1d IS NOT NULL AND divergence IS NOT NULL AND year_quarter IS NOT NULL), e AS (SELECT g, y - avg(y) OVER (PARTITION BY g) AS y, x - avg(x) OVER (PARTITION BY g) AS x FROM d),
b AS (SELECT sum(x * y) / sum(x * x) AS coef, sum(x * x) AS sxx, count(*) AS n, count(DISTINCT g) AS levels FROM e), r AS (SELECT coef, sqrt(sum((x * (y - coef * x)) ** 2) / (sxx * sxx) * n / (n - levels - 1)) AS se, n FROM e, b GROUP BY coef, sxx, n, levels) SELECT 'divergence' AS variable, round(coef, 6) AS coef, round(se, 6) AS std_err, round(coef / se, 4) AS t_stat, n::INT AS nobs FROM r"""
)
def regression_dummies(spark, sf_dir):
    """The same slope from the full design with dummies, robust errors and a rank-aware solve."""
    fit = regress.ols(_panel(spark, sf_dir), "ret_1d", ["divergence"], "year_quarter")
    i = 1
    rows = [] if fit is None else [(fit.names[i], round(float(fit.coef[i]), 6), round(float(fit.std_err[i]), 6), round(float(fit.t_stat[i]), 4), fit.n)]
    return spark.createDataFrame(rows, "variable string, coef double, std_err double, t_stat double, nobs int")


def _fit_sql(name: str, y: str, xs: tuple[str, ...], where: str) -> tuple[str, str]:
    """(CTEs, rows) of one fit: all columns within their level, then each regressor in turn freed from all others, one
    after the other; its slope, residuals and HC1 error follow (a regressor of one fit is the last of its own chain)."""
    k, ctes = len(xs), [f"{name} AS (SELECT {y} AS y, {', '.join(xs)}, year_quarter AS g FROM sp WHERE {where} AND year_quarter IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in (y, *xs))})"]
    within = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY g) AS {c}" for c in ("y", *xs))
    ctes.append(f"{name}_0 AS (SELECT y AS raw, g, {within} FROM {name})")
    rows = []
    for i, last in enumerate(xs):
        order, at = [*[x for x in xs if x != last], last], f"{name}_0"
        for j, x in enumerate(order):
            rest = ["y", *order[j + 1 :]]
            free = ", ".join(f"{c} - {x} * (SELECT sum({x} * {c}) / sum({x} * {x}) FROM {at}) AS {c}" for c in rest)
            ctes.append(f"{name}_{i}_{j + 1} AS (SELECT raw, g, {free}{', ' + x + ', y AS before' if j == k - 1 else ''} FROM {at})")
            at = f"{name}_{i}_{j + 1}"
        sxx = f"sum({last} * {last})"
        rows.append(f"SELECT '{last}' AS variable, sum({last} * before) / {sxx} AS coef, sqrt(sum(({last} * y) ** 2)) / {sxx} * sqrt(count(*) / (count(*) - count(DISTINCT g) - {k})) AS std_err, count(*) AS nobs, 1 - sum(y * y) / (sum(raw * raw) - sum(raw) ** 2 / count(*)) AS r2 FROM {at}")
    return ", ".join(ctes), " UNION ALL ".join(rows)


def _suite_sql() -> str:
    ctes, rows = [], []
    for i, (section, xs) in enumerate((*regress.SPECIFICATIONS[:2], ("Pre-2020", regress.SPECIFICATIONS[1][1]), ("Post-2020", regress.SPECIFICATIONS[1][1]))):
        for h in (1, 3, 5):
            c, r = _fit_sql(f"f{i}{h}", f"ret_{h}d", xs, {"Pre-2020": "year < 2020", "Post-2020": "year >= 2020"}.get(section, "true"))
            ctes.append(c)
            rows.append(f"SELECT '{section}' AS section, 'ret_{h}d' AS model, * FROM ({r})")
    return f"WITH {PANEL}, sp AS (SELECT *, divergence * is_smallcap AS div_x_small, 2019 + CAST(ticker AS INT) // 2 % 2 AS year FROM pan), {', '.join(ctes)} SELECT section, model, variable, round(coef, 6) AS coef, round(std_err, 6) AS std_err, round(coef / std_err, 4) AS t_stat, nobs::INT AS nobs, round(r2, 6) AS r2 FROM ({' UNION ALL '.join(rows)})"


@query(_suite_sql())
def regression_identified(spark, sf_dir):
    """The coefficients of all specifications whose regressors are not collinear, with both subsamples (by every second
    pair of tickers); the others' least-norm solutions are held against numpy in tests/test_designs.py."""
    half = F.floor(F.col("ticker").cast("int") / 2) % 2
    out = regress.run_all(stored(_panel(spark, sf_dir).withColumn("year", (F.lit(2019) + half).cast("int"))))
    out = out.where("section <> 'Full' and variable <> 'const'")
    return out.select("section", "model", "variable", R6("coef"), R6("std_err"), F.round("t_stat", 4).alias("t_stat"), "nobs", R6("r2"))


@query()
def regression_suite(spark, sf_dir):
    """All specifications, with both subsamples (every other ticker counts as a year later); the solver is held against
    numpy in tests/test_panel.py. The panel's lineage is cut by a table in the shared folder."""
    p = _panel(spark, sf_dir)
    first = F.col("ticker").cast("int") % 2
    return regress.run_all(stored(p.withColumn("year", (F.lit(2019) + first).cast("int"))))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN p < 0.01 THEN '***' WHEN p < 0.05 THEN '**' WHEN p < 0.10 THEN '*' ELSE '' END AS sig FROM (SELECT l_orderkey, l_linenumber, l_discount AS p FROM lineitem)")
def significance_stars(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", regress.stars(F.col("l_discount")).alias("sig"))


@query("WITH c AS (SELECT quality AS t, toxic AS g, count(*) AS n FROM labels GROUP BY ALL), x AS (SELECT label, sum(hit) hit, sum(i) i, sum(s) s FROM (SELECT t AS label, CASE WHEN t = g THEN n ELSE 0 END AS hit, n AS i, 0 AS s FROM c UNION ALL SELECT g, 0, 0, n FROM c) GROUP BY label) SELECT round(sum(hit) / sum(i), 6) AS accuracy, round(avg(2 * hit / (i + s)), 6) AS macro_f1 FROM x")
def accuracy_macro_f1(spark, sf_dir):
    return sentiment.quality(table(spark, sf_dir, "labels"), "quality", "toxic").select(R6("accuracy"), R6("macro_f1"))
