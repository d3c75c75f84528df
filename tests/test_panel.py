import math
import random
import time

import numpy as np
from pyspark.sql import functions as F

from parlance.operators import panel, profile, regress, returns, sentiment


def test_forward_returns_equal_a_loop(spark):
    rng = random.Random(4)
    prices = {(t, d): float(rng.randrange(0, 9)) for t in "ab" for d in range(1, 40) if rng.random() < 0.7}
    events = {(t, rng.randrange(-3, 45)) for t in "abc" for _ in range(25)}
    day = lambda d: str(np.datetime64("2020-01-05") + d)
    p = spark.createDataFrame([(t, day(d), v) for (t, d), v in prices.items()], "ticker string, date string, adj_close double")
    e = spark.createDataFrame([(t, day(d)) for t, d in events], "ticker string, event_date string")
    got = {(r.ticker, str(r.event_date)): r for r in returns.forward_returns(e, p.withColumn("date", F.col("date").cast("date"))).collect()}
    assert len(got) == len(events)
    for t, d in events:
        days = sorted(x for k, x in prices if k == t)
        at = next((i for i, x in enumerate(days) if x >= d), None)
        r = got[t, day(d)]
        assert (str(r.base_date) if r.base_date else None) == (day(days[at]) if at is not None else None)
        for k in returns.HORIZONS:
            want = None
            if at is not None and at + k < len(days) and prices[t, days[at]] != 0:
                want = (prices[t, days[at + k]] - prices[t, days[at]]) / prices[t, days[at]]
            assert r[f"ret_{k}d"] == want or math.isclose(r[f"ret_{k}d"], want)


def test_roles_and_panel(spark):
    agg = spark.createDataFrame(
        [("t1", "A", "2020-01-01", "exec", 0.5, 2), ("t1", "A", "2020-01-01", "analyst", -0.5, 1), ("t2", "B", "2020-01-02", "exec", 1.0, 3), ("t3", "C", "2020-01-03", "other", 1.0, 1)],
        "transcript_id string, ticker string, event_date string, speaker_role string, mean_score double, n_chunks long",
    )
    rets = spark.createDataFrame([("t1", "A", "2020-01-01", 0.1, None, None, None)], "transcript_id string, ticker string, event_date string, ret_1d double, ret_3d double, ret_5d double, ret_10d double")
    meta = spark.createDataFrame([("t1", "r2k", "Acme", 2020, 1, "2020Q1"), ("t2", None, "Bco", 2020, 1, "2020Q1")], "transcript_id string, source string, company string, year int, quarter int, year_quarter string")
    rows = {r.transcript_id: r for r in panel.build_panel(agg, rets, meta).collect()}
    assert set(rows) == {"t1", "t2"} and len(panel.build_panel(agg, rets, meta).columns) == 18
    assert rows["t1"].divergence == 1.0 and rows["t1"].is_smallcap == 1 and rows["t1"].ret_1d == 0.1
    assert rows["t2"].divergence is None and rows["t2"].is_smallcap == 0 and rows["t2"].ret_1d is None


def test_null_keys_vanish_from_role_means(spark):
    df = spark.createDataFrame([("t", None, "d", "exec", 1.0), ("t", "A", "d", "exec", 1.0)], "transcript_id string, ticker string, event_date string, speaker_role string, sentiment_score double")
    r = sentiment.by_role(df).collect()
    assert [(x.ticker, x.mean_score, x.std_score, x.n_chunks) for x in r] == [("A", 1.0, None, 1)]


def test_scores(spark):
    df = spark.createDataFrame([("strong growth",), ("weak loss risk",), ("",), (None,)], "chunk_text string")
    rows = sentiment.score_chunks(df).collect()
    assert [r.sentiment_label for r in rows] == ["positive", "negative", "neutral", "neutral"]
    assert [r.sentiment_score for r in rows] == [1.0, -1.0, 0.0, 0.0]
    assert all(abs(r.prob_positive + r.prob_neutral + r.prob_negative - 1) < 1e-9 for r in rows)
    flipped = sentiment.score_chunks(df, labels=("negative", "neutral", "positive")).collect()
    assert [r.sentiment_label for r in flipped[:2]] == ["negative", "positive"]


def data(spark, n=200, seed=0, collinear=False):
    rng = np.random.default_rng(seed)
    x1, x2, g = rng.normal(size=n), rng.normal(size=n), rng.integers(0, 5, n)
    y = 1 + 2 * x1 - x2 + g + rng.normal(size=n) * (1 + np.abs(x1))
    x3 = x1 - x2 if collinear else rng.normal(size=n)
    df = spark.createDataFrame([tuple(map(float, r[:4])) + (f"g{int(r[4])}",) for r in zip(y, x1, x2, x3, g)], "y double, x1 double, x2 double, x3 double, g string")
    return df, np.column_stack([np.ones(n), x1, x2, x3, *[(g == k).astype(float) for k in range(1, 5)]]), y


def test_ols_equals_numpy(spark):
    df, x, y = data(spark)
    fit = regress.ols(df, "y", ["x1", "x2", "x3"], "g")
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ b
    inv = np.linalg.inv(x.T @ x)
    cov = inv @ (x.T * (e * e)) @ x @ inv * len(y) / (len(y) - x.shape[1])
    assert np.allclose(fit.coef, b) and np.allclose(fit.std_err, np.sqrt(np.diag(cov)))
    assert fit.rank == x.shape[1] and math.isclose(fit.r2, 1 - e @ e / ((y - y.mean()) @ (y - y.mean())))


def test_ols_collinear_uses_the_rank(spark):
    df, x, y = data(spark, collinear=True)
    fit = regress.ols(df, "y", ["x1", "x2", "x3"], "g")
    assert fit.rank == x.shape[1] - 1
    assert abs(fit.coef[1] - fit.coef[2] - fit.coef[3]) < 1e-8  # the minimum-norm solution
    assert regress.ols(df.limit(29), "y", ["x1"], "g") is None


def test_within_slope_equals_dummies(spark):
    df, _, _ = data(spark)
    fit, w = regress.ols(df, "y", ["x1"], "g"), regress.within_slope(df, "y", "x1", "g").first()
    assert math.isclose(fit.coef[1], w.coef) and math.isclose(fit.std_err[1], w.std_err)


def test_profiles(spark):
    df = spark.createDataFrame([(x,) for x in [1, 1, 1, 2, 2, 3, None]], "v int")
    assert profile.upper_median_of_counts(df.na.drop(), "v").first().upper_median == 2
    assert {(r.bin, r.n) for r in profile.histogram(df, "v", 2).collect()} == {(0, 3), (1, 3)}
    assert [(r.v, r.n) for r in profile.top(df, "v", 2).collect()] == [(1, 3), (2, 2)]
    got = spark.createDataFrame([(0,), (10,), (11,), (99,)], "v int").select(profile.cut_bins(F.col("v"), [0, 10, 20]).alias("b")).collect()
    assert [r.b for r in got] == ["0-10", "0-10", "10-20", None]
    d = spark.createDataFrame([("a", "2020-01-01"), ("a", "2020-04-01"), ("b", "2020-01-01"), ("a", "2020-07-05"), ("b", "2020-09-01")], "e string, d string")
    assert [r.e for r in profile.in_every_quarter(d, "e", "d").collect()] == ["a"]


def test_all_specifications(spark):
    """63 rows with both subsamples, fewer where one has under 50 rows; the full one has its sixth regressor."""
    rng = np.random.default_rng(4)
    n = 240
    x, z, k = rng.normal(size=n), rng.normal(size=n), rng.integers(1, 30, n)
    rows = [(int(2019 + i % 2), f"q{i % 5}", float(x[i] - z[i]), float(x[i]), float(z[i]), int(k[i]), int(i % 3 == 0), *[float(0.3 * k[i] + rng.normal()) for _ in range(3)]) for i in range(n)]
    df = spark.createDataFrame(rows, "year int, year_quarter string, divergence double, score_exec double, score_analyst double, n_chunks_exec long, is_smallcap int, ret_1d double, ret_3d double, ret_5d double")
    got = regress.run_all(df).collect()
    assert len(got) == 63
    full = {r.variable: r.coef for r in got if r.section == "Full" and r.model == "ret_1d"}
    assert list(full)[-1] == "n_chunks_exec" and abs(full["n_chunks_exec"] - 0.3) < 0.05
    few = df.where("year = 2019").unionByName(df.where("year = 2020").orderBy("ret_1d").limit(49))
    assert len(regress.run_all(few).collect()) == 51  # 49 rows would do for a fit, but not for a subsample


def test_returns_of_a_long_series_are_linear(spark):
    """16,000 days of one ticker, with an event on each."""
    days = spark.range(16_000).select(F.lit("T").alias("ticker"), F.date_add(F.lit("1975-01-01").cast("date"), F.col("id").cast("int")).alias("date"), (F.col("id") + 1).cast("double").alias("adj_close"))
    began = time.perf_counter()
    got = returns.forward_returns(days.select("ticker", F.col("date").alias("event_date")), days).agg(F.count("ret_1d").alias("n"), F.sum((F.col("base_date") == F.col("event_date")).cast("int")).alias("same")).first()
    assert (got.n, got.same) == (15_999, 16_000) and time.perf_counter() - began < 20


def test_returns_in_buckets_equal_those_of_whole_tickers(spark):
    """Gaps longer than a bucket, buckets with events alone, tickers without prices, several bucket lengths."""
    rng = np.random.default_rng(6)
    day = lambda i: F.date_add(F.lit("2019-12-20").cast("date"), F.col(i).cast("int"))
    held = [int(x) for x in np.unique(np.concatenate([rng.integers(0, 60, 40), rng.integers(150, 170, 12), [400, 401]]))]
    prices = [(t, i, float(rng.normal())) for t in "AB" for i in held if t == "A" or i % 2] + [("A", 7, None), ("B", 11, 0.0)]
    prices = list({(t, i): (t, i, v) for t, i, v in prices}.values())
    p = spark.createDataFrame(prices, "ticker string, i int, adj_close double").select("ticker", day("i").alias("date"), "adj_close")
    events = spark.createDataFrame([(t, i) for t in "ABC" for i in range(-5, 410, 3)], "ticker string, i int").select("ticker", day("i").alias("event_date"))
    rows = lambda n: sorted(map(str, returns.forward_returns(events, p, bucket_days=n).collect()))
    whole = rows(None)
    assert len(whole) == 3 * 139 and all(rows(n) == whole for n in (1, 7, 64, 5000))
