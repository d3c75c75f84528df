"""Registered queries of statistics and models: stems of all words, exact quantiles, a learnt scorer."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parlance.functions import dates, porter
from parlance.operators import classify, profile, quantiles, returns, sentiment
from parlance.plans.queries import R6, RETS, daily_prices, query, table


@query(rf"WITH w AS (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '\p{{L}}+')) AS word FROM documents), dw AS (SELECT word, count(*) AS n FROM w GROUP BY word), {porter.stems_sql('dw')} SELECT stem, sum(n)::BIGINT AS n, count(*) AS n_words FROM stemmed JOIN dw USING (word) GROUP BY stem")
def stem_counts(spark, sf_dir):
    """How often each stem occurs, and in how many words; each distinct word is stemmed once."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(\p{L}+)"), 1)).alias("word"))
    n = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return n.select(porter.stem(F.col("word")).alias("stem"), "n").groupBy("stem").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_words"))


@query("SELECT l_returnflag, l_linestatus, unnest([0.0, 0.25, 0.5, 0.9, 1.0])::DOUBLE AS share, round(unnest(q), 4) AS quantile, n FROM (SELECT l_returnflag, l_linestatus, quantile_cont(l_extendedprice, [0.0, 0.25, 0.5, 0.9, 1.0]) AS q, count(*) AS n FROM lineitem GROUP BY ALL)")
def exact_quantiles(spark, sf_dir):
    """Quantiles of prices by flag and status, in memory that does not grow with a group."""
    q = quantiles.exact_quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", (0.0, 0.25, 0.5, 0.9, 1.0))
    return q.select("l_returnflag", "l_linestatus", "share", F.round("quantile", 4).alias("quantile"), "n")


# -- prices and quarters ----------------------------------------------------------------------------------------------
_HOT = RETS.replace("CAST(user_id AS VARCHAR) AS ticker", "'T' AS ticker").replace("PARTITION BY user_id ", "").replace("GROUP BY user_id, ", "GROUP BY ")


@query(f"WITH {_HOT} SELECT ticker, event_date, base_date, round(ret_1d, 6) AS ret_1d, round(ret_3d, 6) AS ret_3d, round(ret_5d, 6) AS ret_5d, round(ret_10d, 6) AS ret_10d FROM rets")
def asof_hot_ticker(spark, sf_dir):
    """All prices and events as those of one ticker, in buckets of four days."""
    e = table(spark, sf_dir, "events")
    prices = e.groupBy(F.lit("T").alias("ticker"), F.to_date("ts").alias("date")).agg(F.avg("value").alias("adj_close"))
    asked = e.where("event_type <> 'view'").select(F.lit("T").alias("ticker"), F.date_add(F.to_date("ts"), 1).alias("event_date"))
    return returns.forward_returns(asked, prices, bucket_days=4).select("ticker", "event_date", "base_date", *[R6(f"ret_{k}d") for k in returns.HORIZONS])


@query(f"WITH {RETS} SELECT CAST(event_id AS VARCHAR) AS transcript_id, e.ticker, e.event_date, round(ret_1d, 6) AS ret_1d, round(ret_5d, 6) AS ret_5d FROM (SELECT event_id, CAST(user_id AS VARCHAR) AS ticker, CAST(ts AS DATE) + 1 AS event_date FROM events WHERE event_type <> 'view') e LEFT JOIN rets USING (ticker, event_date)")
def returns_of_events(spark, sf_dir):
    """Every event with the returns that follow it; prices are looked up once for each ticker and day."""
    t = table(spark, sf_dir, "events").where("event_type <> 'view'").select(F.col("event_id").cast("string").alias("transcript_id"), F.col("user_id").cast("string").alias("ticker"), F.date_add(F.to_date("ts"), 1).alias("event_date"))
    return returns.event_returns(t, daily_prices(spark, sf_dir)).select("transcript_id", "ticker", "event_date", R6("ret_1d"), R6("ret_5d"))


@query(
    r"WITH q AS (SELECT CASE o_custkey % 50 WHEN 0 THEN 'unknown' WHEN 1 THEN '20xxQ1' WHEN 2 THEN year(o_orderdate) || 'Q5' ELSE year(o_orderdate) || 'Q' || quarter(o_orderdate) END AS label, count(*) AS n FROM orders GROUP BY 1) SELECT label, n, row_number() OVER (ORDER BY CASE WHEN regexp_full_match(label, '\d{4}Q[1-4]') THEN 0 ELSE 1 END, CASE WHEN regexp_full_match(label, '\d{4}Q[1-4]') THEN label END, label)::INT AS place FROM q"
)
def quarter_order(spark, sf_dir):
    """Orders by quarter in the order of quarters, labels that are none behind them; one row a label is sorted."""
    k, q = F.col("o_custkey") % 50, F.col("o_orderdate")
    label = F.when(k == 0, "unknown").when(k == 1, "20xxQ1").when(k == 2, F.concat(F.year(q).cast("string"), F.lit("Q5"))).otherwise(dates.year_quarter(F.year(q), F.quarter(q)))
    counts = table(spark, sf_dir, "orders").groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(dates.quarter_number(F.col("label")).asc_nulls_last(), "label")))


# -- a learnt scorer --------------------------------------------------------------------------------------------------
def _rated(spark, sf_dir):
    """Rated documents with their label: those to learn from and the fifth that is held out, by digest."""
    rated = table(spark, sf_dir, "labels").select("doc_id", classify.sentiment_of(F.col("quality"), F.col("toxic")).alias("label"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("chunk_text")).join(rated, "doc_id")
    d = profile.split_by_hash(d, "doc_id", 80)
    return d.where("is_train").drop("is_train"), d.where("not is_train").drop("is_train")


@query()
def learnt_quality(spark, sf_dir):
    """Accuracy and macro F1 of the learnt scorer on rated documents that it has not seen, and the share of the most
    frequent label; tests/test_models.py wants it to beat that."""
    train, held = _rated(spark, sf_dir)
    scored = classify.score_learnt(held, classify.fit_scorer(train))
    top = held.groupBy("label").count().agg((F.max("count") / F.sum("count")).alias("majority"), F.sum("count").alias("n"))
    return sentiment.quality(scored, "label", "sentiment_label").join(F.broadcast(top))


@query()
def learnt_roles(spark, sf_dir):
    """From chunk to role: all turns of all conversations, scored by what is learnt from all rated documents, and the
    means of each role."""
    train, held = _rated(spark, sf_dir)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "role", F.col("text").alias("chunk_text"))
    scored = classify.score_learnt(turns, classify.fit_scorer(train.unionByName(held)))
    return scored.groupBy("role").agg(F.count(F.lit(1)).alias("n_chunks"), *[F.avg(c).alias(f"mean_{c}") for c in ("sentiment_score", "prob_positive", "prob_neutral", "prob_negative")])
