"""The learnt scorer on texts that it has not seen; exact quantiles against sorting; a run's figures against its tables."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import classify, quantiles
from parlance.operators.sentiment import quality
from parlance.plans import validation


def rated(n, seed):
    rng = random.Random(seed)
    kinds = {"positive": "gain rise strong".split(), "neutral": "table chair meeting".split(), "negative": "loss fall weak".split()}
    out = []
    for i in range(n):
        label = rng.choice(("positive", "neutral", "neutral", "negative"))
        words = [rng.choice(kinds[label]) if rng.random() < 0.3 else f"w{rng.randrange(300)}" for _ in range(rng.randrange(12, 40))]
        out.append((i, " ".join(words).title() + ".", label))
    return [*out, (n, None, "neutral"), (n + 1, "", "neutral"), (n + 2, "nobody rated this", None)]


def test_learnt_scorer_beats_the_majority(spark):
    schema = "i long, chunk_text string, label string"
    model = classify.fit_scorer(spark.createDataFrame(rated(600, 1), schema), slots=4096)
    held = spark.createDataFrame(rated(300, 2), schema)
    scored = classify.score_learnt(held.withColumn("words", F.lit(1)), model)
    got = quality(scored.where("label is not null"), "label", "sentiment_label").first()
    assert got.accuracy > 0.9 and got.macro_f1 > 0.9
    rows = scored.collect()
    assert len(rows) == 303 and all(math.isclose(r.prob_positive + r.prob_neutral + r.prob_negative, 1) and r.words == 1 for r in rows)
    assert {r.sentiment_label: r.sentiment_score for r in rows} == {"positive": 1.0, "neutral": 0.0, "negative": -1.0}


def test_a_label_that_no_row_had(spark):
    two = spark.createDataFrame([("good good", "positive"), ("so so", "neutral")] * 20, "chunk_text string, label string")
    r = classify.score_learnt(spark.createDataFrame([("good",)], "chunk_text string"), classify.fit_scorer(two, slots=64)).first()
    assert r.prob_negative < 1e-3 and r.sentiment_label == "positive"


@pytest.mark.parametrize("bins", (200,))
def test_quantiles_equal_sorting(spark, bins):
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=401), "b": rng.choice([1.0, 2.0, 2.5], 300), "c": np.array([7.0]), None: np.exp(40 * rng.normal(size=200)), "d": np.array([-1e308, 1e308, 0.0, 5e-324, -0.0])}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("a", None), ("a", math.nan), ("empty", None)]
    shares = (0.0, 0.1, 0.5, 0.75, 1.0)
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {(r.g, r.share): (r.quantile, r.n) for r in quantiles.exact_quantiles(df, ["g"], "x", shares, bins).collect()}
    assert len(got) == 5 * len(groups)
    for (g, s), (q, n) in got.items():
        xs = sorted(groups[g])
        at = s * (len(xs) - 1)
        a, b, part = xs[math.floor(at)], xs[math.ceil(at)], at - math.floor(at)
        assert n == len(xs) and math.isclose(q, a if part == 0 else a * (1 - part) + b * part, rel_tol=1e-12), (g, s)
    one = quantiles.exact_quantiles(df.where("g = 'a'"), [], "x", (0.5,), bins).collect()
    assert [(r.quantile, r.n) for r in one] == [(float(np.median(groups["a"])), 401)]
    assert quantiles.exact_quantiles(df.where("g = 'empty'"), ["g"], "x", shares, bins).count() == 0


def test_a_run_reports_what_is_in_its_tables(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for i in range(40):
        body = "\n".join(rng.choice(("Operator", "Ann Lee - CFO", "Bob Ray - Analyst", "We open the question and answer session now.", "Fine words. " * rng.randrange(1, 90), "<b>x</b>", "")) for _ in range(rng.randrange(0, 9)))
        if i % 6 == 0:
            body = f"Ann Lee - CFO\nHello number {i}.\nBob Ray - Analyst\nWhy is that so?\nAnn Lee - CFO\nBecause it is."
        rows.append((str(i), i, rng.choice((body, body, rows[-1][2] if rows else "")), rng.choice(("Acme", None)), f"Q{i % 4 + 1} call {i}", rng.choice(("2021-05-06", None))))
    raw = spark.createDataFrame(rows, "transcript_id string, ord long, raw_text string, company string, title string, derived_event_date string")
    tables, report = validation.run_and_validate(raw, f"{tmp_path}/run", most_tokens=40, files_seen=8, files_failed=2)
    r = report.first()
    kept, gone, segments, chunks = ([x.asDict() for x in tables[k].collect()] for k in ("transcripts", "duplicates", "segments", "chunks"))
    ids, said = {x["transcript_id"] for x in kept}, {x["transcript_id"] for x in segments}
    assert (r.records_loaded, r.duplicate_count, r.files_seen, r.files_failed, r.transcript_parse_success_rate) == (40, len(gone), 8, 2, 0.75) and len(kept) + len(gone) == 40
    assert r.transcripts_with_zero_segments == len(ids - said) > 0 and r.transcripts_with_zero_chunks == len(ids - {x["transcript_id"] for x in chunks})
    assert r.metadata_extraction_success_rate == round(sum(None not in (x["company"], x["event_date"], x["year_quarter"]) for x in kept) / len(kept), 4)
    sections = [x["section"] for x in segments]
    assert json.loads(r.section_distribution) == {s: sections.count(s) for s in ("A", "O", "Prepared", "Q")}
    both = sum({"Q", "A"} <= {x["section"] for x in segments if x["transcript_id"] == t} for t in said)
    assert r.share_transcripts_with_detected_qa == round(both / len(said), 4) and both > 0
    n = [x["n_tokens"] for x in chunks]
    assert (r.suspiciously_short_chunks, r.max_token_limit_violations, r.max_token_limit) == (sum(x < 5 for x in n), sum(x > 40 for x in n), 40)
    assert sum(json.loads(r.chunk_token_distribution).values()) == len(n) and json.loads(r.chunk_token_distribution)["[0, 25]"] == sum(x <= 25 for x in n)
    flagged = spark.read.parquet(f"{tmp_path}/run/flagged").collect()
    whole, clean = sum(len(x.raw_text or "") for x in flagged), sum(len(x.clean_text or "") for x in flagged)
    assert r.cleaning_text_drop_rate == round(1 - clean / whole, 4) and r.segmentation_text_drop_rate == round(1 - sum(len(x["segment_text"]) for x in segments) / clean, 4)


def test_a_run_over_nothing(spark, tmp_path):
    raw = spark.createDataFrame([], "transcript_id string, ord long, raw_text string, company string, title string")
    r = validation.run_and_validate(raw, f"{tmp_path}/run")[1].first()
    assert r.records_loaded == r.duplicate_count == r.transcripts_with_zero_chunks == 0 and r.cleaning_text_drop_rate == 0.0


def test_figures_of_a_run_where_speaker_lines_part_equal_lines(spark, tmp_path):
    """put into "X. Y" before a line "X.", a speaker's line leaves "X." twice, which the figures count twice."""
    import duckdb

    from parlance.plans import composites, queries

    texts = {0: "Fine words. More of them.", 1: "We grew.\nWe grew. Costs fell.", 2: "We grew.\nWe grew. Costs fell.", 4: "Costs fell. We grew\nWe grew", 7: "if a < b holds. Then b is more"}
    rows = [(k, t, "en", f"src{k}", len(t)) for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    told = db.execute(queries.ORACLE["validation_kpis"])
    names, want = [x[0] for x in told.description], told.fetchall()
    got = composites.validation_kpis(spark, str(tmp_path))
    assert got.columns == names and [tuple(r) for r in got.collect()] == want
