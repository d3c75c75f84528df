"""Registered queries, second part: profiles, checks, reports, set operations and streaming forms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from parlance.functions import dates, nlp, text
from parlance.operators import dedup, eda, metadata, profile, sentiment
from parlance.plans.queries import AGG, PANEL, R6, SCORED, WIDE, _panel, query, scored_events, table, wide
from parlance.sources import readers
from parlance.streaming import ingest


def order_quarter():
    return dates.year_quarter(F.year("o_orderdate"), F.quarter("o_orderdate"))


# -- corpus profile ---------------------------------------------------------------------------------------------------
@query("SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS year_quarter, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share_pct FROM orders GROUP BY 1")
def calls_per_quarter(spark, sf_dir):
    return profile.value_counts(table(spark, sf_dir, "orders").select(order_quarter().alias("year_quarter")), "year_quarter")


@query("SELECT count(*) AS n, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.10), 6) AS p10, round(quantile_cont(n, 0.25), 6) AS p25, round(quantile_cont(n, 0.75), 6) AS p75, round(quantile_cont(n, 0.90), 6) AS p90, max(n) AS max FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def calls_per_company(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("c"))
    return profile.describe(n, "c", (0.10, 0.25, 0.75, 0.90))


@query("WITH q AS (SELECT DISTINCT o_custkey % 40 AS company, date_trunc('quarter', o_orderdate) AS q FROM orders) SELECT company, count(*) AS n_quarters FROM q GROUP BY company HAVING count(*) = (SELECT datediff('quarter', min(o_orderdate), max(o_orderdate)) + 1 FROM orders)")
def companies_in_every_quarter(spark, sf_dir):
    return profile.in_every_quarter(table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("company"), "o_orderdate"), "company", "o_orderdate")


@query("SELECT o_custkey, count_if(quarter(o_orderdate) = 1) AS \"1\", count_if(quarter(o_orderdate) = 2) AS \"2\", count_if(quarter(o_orderdate) = 3) AS \"3\", count_if(quarter(o_orderdate) = 4) AS \"4\" FROM orders GROUP BY o_custkey")
def company_quarter_pivot(spark, sf_dir):
    return profile.pivot_counts(table(spark, sf_dir, "orders").select("o_custkey", F.quarter("o_orderdate").alias("q")), "o_custkey", "q", [1, 2, 3, 4])


@query("WITH e AS (SELECT DISTINCT o_custkey, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS q FROM orders) SELECT o_custkey, count(*) AS n_periods, round(count(*) / (SELECT count(DISTINCT q) FROM e), 6) AS coverage FROM e GROUP BY o_custkey ORDER BY coverage DESC, o_custkey LIMIT 100")
def coverage_ratio(spark, sf_dir):
    """The first hundred: the report's own limit."""
    return profile.coverage(table(spark, sf_dir, "orders").select("o_custkey", order_quarter().alias("q")), "o_custkey", "q", 100)


@query("SELECT (n // 100 * 100) || '-' || (n // 100 * 100 + 99) AS bin, count(*) AS n FROM (SELECT len(regexp_extract_all(text, '\\S+')) AS n FROM documents) GROUP BY 1")
def word_bins(spark, sf_dir):
    return profile.floor_bins(table(spark, sf_dir, "documents"), text.n_words(F.col("text")), 100)


@query("SELECT (n // 1000 * 1000) || '-' || (n // 1000 * 1000 + 999) AS bin, count(*) AS n FROM (SELECT length(text) AS n FROM documents) GROUP BY 1")
def char_bins(spark, sf_dir):
    return profile.floor_bins(table(spark, sf_dir, "documents"), F.length("text"), 1000)


@query("SELECT CASE WHEN q <= 10 THEN '0-10' WHEN q <= 20 THEN '10-20' WHEN q <= 30 THEN '20-30' WHEN q <= 40 THEN '30-40' ELSE '40-50' END AS bin, count(*) AS n FROM (SELECT l_quantity AS q FROM lineitem WHERE l_quantity BETWEEN 0 AND 50) GROUP BY 1")
def cut_bins(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(profile.cut_bins(F.col("l_quantity"), [0, 10, 20, 30, 40, 50]).alias("bin"))
    return d.where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query("WITH e AS (SELECT min(value) a, max(value) b FROM events) SELECT least(39, floor((value - a) / (b - a) * 40))::INT AS bin, count(*) AS n FROM events, e GROUP BY 1")
def histogram_40(spark, sf_dir):
    return profile.histogram(table(spark, sf_dir, "events"), "value", 40)


@query("WITH f AS (SELECT count(*) AS f, row_number() OVER (ORDER BY count(*)) AS rn, count(*) OVER () AS n FROM orders GROUP BY o_custkey) SELECT f AS upper_median, n AS n_values FROM f WHERE rn = n // 2 + 1")
def upper_median_frequency(spark, sf_dir):
    return profile.upper_median_of_counts(table(spark, sf_dir, "orders"), "o_custkey")


@query("WITH v AS (SELECT p_brand AS raw, trim(regexp_replace(lower(replace(CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE p_brand END, '&', ' and ')), '\\s+', ' ', 'g')) AS key, CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE p_brand END AS shown FROM part) SELECT key, count(DISTINCT shown) AS n_variants, array_to_string(list_sort(list(DISTINCT shown)), ' | ') AS variants, count(*) AS n FROM v GROUP BY key HAVING count(DISTINCT shown) > 1")
def variant_groups(spark, sf_dir):
    d = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand")).alias("shown"))
    return profile.variants(d, "shown", text.company_key(F.col("shown")))


@query("SELECT strftime(o_orderdate, '%A') AS weekday, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY GROUPING SETS ((1), (2))")
def calendar_counts(spark, sf_dir):
    """Counts by weekday and by month from one scan."""
    o = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "EEEE").alias("weekday"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return o.groupingSets([["weekday"], ["month"]], "weekday", "month").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def topk_sources(spark, sf_dir):
    """The first ten: the report's own limit."""
    return profile.top(table(spark, sf_dir, "documents"), "source", 10)


@query("SELECT year(o_orderdate)::INT AS year, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 LIMIT 10")
def first_years(spark, sf_dir):
    """The first ten years in order: the report's own limit."""
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n")).orderBy("year").limit(10)


@query("SELECT count(*) AS n, count_if(f = 1) AS freq1, round(avg(CAST(f = 1 AS INT)), 6) AS freq1_share FROM (SELECT count(*) AS f FROM orders GROUP BY o_custkey, o_orderpriority)")
def freq1_share(spark, sf_dir):
    f = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("f"))
    return f.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("f") == 1).alias("freq1"), F.round(F.avg((F.col("f") == 1).cast("int")), 6).alias("freq1_share"))


# -- checks -----------------------------------------------------------------------------------------------------------
@query("SELECT 'quality' AS \"column\", count_if(quality IS NULL) AS n_null FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'toxic', count_if(toxic IS NULL) FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'lang', count_if(lang IS NULL) FROM documents")
def null_audit(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return profile.nulls(d, ["quality", "toxic", "lang"])


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_ids(spark, sf_dir):
    return profile.orphans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT count(*) AS n_docs, count(DISTINCT doc_id) AS n_ids, count_if(text IS NULL OR trim(text) = '') AS n_empty, count_if(length(text) > 5000) AS n_long, count_if(length(text) < 50) AS n_short, round(avg(length(text)), 6) AS mean_chars FROM documents")
def dataset_checks(spark, sf_dir):
    n = F.length("text")
    return table(spark, sf_dir, "documents").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_distinct("doc_id").alias("n_ids"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("n_empty"), F.count_if(n > 5000).alias("n_long"), F.count_if(n < 50).alias("n_short"), F.round(F.avg(n), 6).alias("mean_chars")
    )


@query("SELECT source, round(1 - sum(length(regexp_replace(text, '[^\\p{L} ]', '', 'g'))) / sum(length(text)), 6) AS drop_rate FROM documents GROUP BY source")
def text_drop_rates(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.round(1 - F.sum(F.length(F.regexp_replace("text", r"[^\p{L} ]", ""))) / F.sum(F.length("text")), 6).alias("drop_rate"))


@query("SELECT o_orderkey, count(l_linenumber) AS n_chunks, coalesce(sum(l_quantity), 0) AS n_tokens, round(coalesce(sum(l_quantity), 0) / nullif(o_totalprice, 0), 6) AS ratio FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice")
def parent_child_sums(spark, sf_dir):
    """Lines are summed by key before the join."""
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("l_linenumber").alias("n_chunks"), F.sum("l_quantity").alias("n_tokens"))
    j = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(sums, "o_orderkey", "left").select("o_orderkey", "o_totalprice", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("n_tokens", F.lit(0.0)).alias("n_tokens"))
    return j.select("o_orderkey", "n_chunks", "n_tokens", F.round(F.try_divide("n_tokens", "o_totalprice"), 6).alias("ratio"))


# -- lookups and sets -------------------------------------------------------------------------------------------------
@query("SELECT c_custkey, coalesce(n_name, '') AS ticker FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 2 = 0")
def company_lookup(spark, sf_dir):
    """A small dictionary looked up by key where nothing is known yet."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("company"), F.lit("").alias("ticker"), F.lit("").alias("raw_text"))
    n = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("string").alias("company"), F.col("n_name").alias("ticker"))
    return metadata.extract_metadata(c, n).select("c_custkey", F.coalesce("ticker", F.lit("")).alias("ticker"))


@query("SELECT c_custkey FROM customer WHERE lower(trim(c_name)) NOT IN (SELECT lower(trim(c_name)) FROM customer WHERE c_custkey % 3 = 0)")
def missing_only(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return dedup.anti_existing(c, c.where("c_custkey % 3 = 0"), ["c_name"]).select("c_custkey")


@query("SELECT company, ticker FROM (SELECT c_custkey AS company, 'old' AS ticker FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0)")
def map_merge(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("company"))
    return metadata.extend_map(c.where("company % 2 = 0").withColumn("ticker", F.lit("old")), c.where("company % 3 = 0").withColumn("ticker", F.lit("new")))


@query("SELECT c_custkey AS key, NULL::VARCHAR AS p_brand, c_mktsegment FROM customer UNION ALL SELECT p_partkey, p_brand, NULL FROM part")
def union_null_filled(spark, sf_dir):
    return readers.union_all([table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_mktsegment"), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), "p_brand")])


@query("SELECT n_name AS name FROM nation UNION SELECT r_name FROM region")
def distinct_union(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).union(table(spark, sf_dir, "region").select("r_name")).distinct()


# -- samples ----------------------------------------------------------------------------------------------------------
@query("SELECT event_id FROM events WHERE CAST('0x' || left(md5(CAST(event_id AS VARCHAR)), 8) AS BIGINT) % 100 = 0")
def hash_sample(spark, sf_dir):
    """One per cent by digest: the sampling operator."""
    return profile.sample_by_hash(table(spark, sf_dir, "events"), "event_id", 100).select("event_id")


@query("SELECT event_id, value FROM events ORDER BY md5(CAST(event_id AS VARCHAR)), event_id LIMIT 12000")
def fixed_sample(spark, sf_dir):
    """12,000 rows: the sampling operator."""
    return profile.sample_of(table(spark, sf_dir, "events").select("event_id", "value"), "event_id", 12_000)


@query("SELECT doc_id, CAST('0x' || left(md5(CAST(doc_id AS VARCHAR)), 8) AS BIGINT) % 100 < 85 AS is_train FROM documents")
def train_split(spark, sf_dir):
    return profile.split_by_hash(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "is_train")


# -- reports ----------------------------------------------------------------------------------------------------------
@query(f"WITH {WIDE}, d AS (SELECT ticker, score_exec - score_analyst AS divergence, 'W' || weekofyear(CAST(event_date AS DATE)) AS year_quarter FROM wide) SELECT year_quarter, round(avg(divergence), 6) AS mean_divergence, count(divergence) AS n FROM d GROUP BY year_quarter")
def divergence_over_time(spark, sf_dir):
    w = wide(spark, sf_dir).withColumn("year_quarter", F.concat(F.lit("W"), F.weekofyear("event_date").cast("string")))
    return w.groupBy("year_quarter").agg(F.round(F.avg("divergence"), 6).alias("mean_divergence"), F.count("divergence").alias("n"))


@query(f"WITH {PANEL} SELECT count(*) AS panel_rows, count(DISTINCT transcript_id) AS transcripts, count(DISTINCT ticker) AS tickers, sum(is_smallcap)::BIGINT AS smallcaps, round(avg(CAST(score_exec IS NOT NULL AS INT)), 6) AS exec_fill, round(avg(CAST(score_analyst IS NOT NULL AS INT)), 6) AS analyst_fill, round(avg(divergence), 6) AS divergence_mean, round(stddev_samp(divergence), 6) AS divergence_std, count(divergence) AS divergence_n FROM pan")
def summary_kpis(spark, sf_dir):
    known = lambda c: F.round(F.avg(F.col(c).isNotNull().cast("int")), 6)
    return _panel(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("panel_rows"), F.count_distinct("transcript_id").alias("transcripts"), F.count_distinct("ticker").alias("tickers"), F.sum("is_smallcap").cast("long").alias("smallcaps"), known("score_exec").alias("exec_fill"), known("score_analyst").alias("analyst_fill"),
        F.round(F.avg("divergence"), 6).alias("divergence_mean"), F.round(F.stddev_samp("divergence"), 6).alias("divergence_std"), F.count("divergence").alias("divergence_n"),
    )


@query(f"WITH {AGG}, p AS (SELECT transcript_id, max(mean_score) FILTER (speaker_role = 'exec') AS exec, max(mean_score) FILTER (speaker_role = 'analyst') AS analyst, max(mean_score) FILTER (speaker_role = 'other') AS other FROM agg GROUP BY transcript_id) SELECT transcript_id, round(exec, 6) AS exec, round(analyst, 6) AS analyst, round(other, 6) AS other, round(exec - analyst, 6) AS gap, round(greatest(exec, analyst, other), 6) AS top FROM p")
def role_pivot(spark, sf_dir):
    a = sentiment.by_role(scored_events(spark, sf_dir)).groupBy("transcript_id").pivot("speaker_role", ["exec", "analyst", "other"]).agg(F.first("mean_score"))
    return a.withColumns({"gap": F.col("exec") - F.col("analyst"), "top": F.greatest("exec", "analyst", "other")}).select("transcript_id", *[R6(c) for c in ("exec", "analyst", "other", "gap", "top")])


# -- streaming --------------------------------------------------------------------------------------------------------
@query(f"WITH {SCORED} SELECT transcript_id, ticker, event_date, speaker_role, round(avg(sentiment_score), 6) AS mean_score, count(sentiment_score) AS n_chunks FROM scored GROUP BY ALL")
def stream_running_mean(spark, sf_dir):
    """The fold over batches as a streaming aggregate, to its end."""
    path = f"{sf_dir}/events.parquet"
    batch = spark.read.parquet(path)
    stream = ingest.read_new_files(spark, sf_dir, batch.schema, glob="events.parquet") if not _is_folder(batch) else ingest.read_new_files(spark, path, batch.schema)
    k = F.get_json_object("props", "$.k").cast("int") % 3
    label = F.when(F.col("event_type") == "purchase", "positive").when(F.col("event_type") == "error", "negative").otherwise("neutral")
    day = F.date_format("ts", "yyyy-MM-dd")
    scored = stream.select(F.concat(F.col("user_id").cast("string"), F.lit("_"), day).alias("transcript_id"), F.col("user_id").cast("string").alias("ticker"), day.alias("event_date"), F.when(k == 0, "exec").when(k == 1, "analyst").otherwise("other").alias("speaker_role"), sentiment.label_score(label).alias("sentiment_score"))
    return ingest.complete(ingest.running_by_role(scored), f"running_{uuid.uuid4().hex}").withColumn("mean_score", F.round("mean_score", 6))


@query("SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_daily_windows(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    batch = spark.read.parquet(path)
    stream = ingest.read_new_files(spark, sf_dir, batch.schema, glob="events.parquet") if not _is_folder(batch) else ingest.read_new_files(spark, path, batch.schema)
    w = ingest.complete(ingest.windowed(stream, "ts", "1 day"), f"daily_{uuid.uuid4().hex}")
    return w.select(F.to_date("w.start").alias("day"), "event_type", "n", "total")


def _is_folder(df) -> bool:
    return not any(f.rstrip("/").endswith("/events.parquet") for f in df.inputFiles())


# -- words, JSON, sets ------------------------------------------------------------------------------------------------
_STOP = ", ".join(f"'{w}'" for w in nlp.STOPWORDS)


@query(rf"SELECT doc_id, len(w) AS n_content, md5(array_to_string(w, ' ')) AS content_md5 FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '\p{{L}}+'), lambda x: length(x) > 1 AND x NOT IN ({_STOP})) AS w FROM documents)")
def content_words(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("doc_id", nlp.content_words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").alias("n_content"), F.md5(F.array_join("w", " ")).alias("content_md5"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, '{\"event_id\":' || event_id || ',\"k\":' || json_extract_string(props, '$.k') || '}' AS packed FROM events")
def json_round_trip(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", nlp.from_json(F.col("props"), "k int")["k"].alias("k"))
    return e.withColumn("packed", nlp.to_json(F.struct("event_id", "k")))


@query("WITH a AS (SELECT DISTINCT o_orderstatus AS s FROM orders), p AS (SELECT o_custkey, list(DISTINCT o_orderstatus) AS l FROM orders GROUP BY o_custkey) SELECT o_custkey, (SELECT count(*) FROM a WHERE s NOT IN ('F', 'O') AND list_contains(l, s)) = 0 AS only_f_o FROM p")
def subset_test(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("l"))
    return g.select("o_custkey", nlp.is_subset(F.col("l"), F.array(F.lit("F"), F.lit("O"))).alias("only_f_o"))


@query("SELECT count_if(trim(coalesce(source, '')) = '') AS missing_company, 0::BIGINT AS missing_title, 0::BIGINT AS missing_date, count_if(trim(coalesce(text, '')) = '') AS missing_text FROM documents")
def eda_missing(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("company"), F.lit("t").alias("title"), F.lit("2020-01-01").alias("date"), "text")
    return eda.run_eda(d)["missing"]
