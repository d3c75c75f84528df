import json

import pytest

from pyspark.sql import functions as F

from parlance import schemas
from parlance.plans.preprocess import check, preprocess
from parlance.sources import readers, sinks
from parlance.streaming import ingest


def test_jsonl_skips_what_is_no_object(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b'{"text": "x", "n": 1}\n\n  \nnot json\n[1, 2]\n{"text": "y"}\n')
    good, bad = readers.read_jsonl(spark, str(tmp_path / "a.jsonl"))
    assert sorted(r.text for r in good.collect()) == ["x", "y"]
    assert sorted(r.line for r in bad.collect()) == ["[1, 2]", "not json"]


def test_canonical_names(spark):
    df = spark.createDataFrame([("c", "t" * 100, "x")], "`Company Name` string, `Some Field` string, b string")
    out = readers.canonical(df).first()
    assert out.company == "c" and out.raw_text == "t" * 100 and out.ticker is None
    assert readers.canonical(df.drop("Some Field")).first().raw_text is None
    assert readers.detect("/x/a.JSONL") == "jsonl" and readers.detect("/x/dir") == "parquet"


def test_conform_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("t", "99999999", "x")], "transcript_id string, year string, other string")
    out = schemas.conform(df, schemas.TRANSCRIPTS)
    assert out.columns == [f.name for f in schemas.struct(schemas.TRANSCRIPTS)] and out.first().year is None
    path = str(tmp_path / "t")
    for _ in range(2):
        sinks.write_new(df, path, ["transcript_id"], schemas.TRANSCRIPTS)
    assert spark.read.parquet(path).count() == 1
    dated = spark.createDataFrame([("u", "2020-02-03")], "uid string, d string")
    sinks.write_dated_json(dated, str(tmp_path / "j"), "d")
    assert (tmp_path / "j/yyyy=2020/mm=02/dd=03").exists()
    assert readers.read_csv(spark, str(tmp_path / "none"), "a int") is None
    assert sinks.bullets(spark.range(1).select(F.lit(1234).alias("n_rows"), F.lit(0.5).alias("x"))) == ["- n rows: 1,234", "- x: 0.5000"]


def test_plan_end_to_end(spark):
    body = "Acme - Q2 2020 call (ACM)\nJane Doe CEO\nWe had a good quarter. It was strong.\nJohn Roe Research\nWhy was it so?\nJane Doe CEO\nBecause we worked."
    rows = [(f"t{i}", i, t, "2020-05-04") for i, t in enumerate([body, body, "", None])]
    t = preprocess(spark.createDataFrame(rows, "transcript_id string, ord int, raw_text string, date string"))
    assert check(t) == []
    kept = {r.transcript_id: r for r in t.transcripts.collect()}
    assert kept["t0"].ticker == "ACM" and kept["t0"].company == "Acme" and kept["t0"].year_quarter == "2020Q2"
    assert "t1" in {r.transcript_id for r in t.duplicates.collect()}
    assert [r.section for r in t.segments.where("transcript_id = 't0'").orderBy("segment_order").collect()][-3:] == ["Prepared", "Q", "A"]


def test_ingest_resumes(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    step = lambda df: df.where("id % 2 = 0")
    for lo in (0, 10):
        spark.range(lo, lo + 10).write.mode("append").parquet(src)
        ingest.ingest(ingest.read_new_files(spark, src, "id long"), step, out, ck)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(0, 20, 2))


def test_entry_without_the_optional_part(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["source", "lang", "n_sentences", "mean_tokens", "median_tokens", "p95_tokens"]
    assert json.dumps(sorted(e.queries()))


def test_import_needs_no_session():
    import os
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=here, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr


def test_write_new_raises_on_a_missing_key(spark, tmp_path):
    from pyspark.errors import AnalysisException

    from parlance.sources import sinks

    df, path = spark.createDataFrame([(1, "a")], "k int, v string"), str(tmp_path / "t")
    for _ in range(2):
        sinks.write_new(df, path, ["k"], "k int, v string")
    assert spark.read.parquet(path).count() == 1
    with pytest.raises(AnalysisException):
        sinks.write_new(df, path, ["kk"], "k int, v string")
    assert spark.read.parquet(path).count() == 1


def test_dated_json_skips_what_is_known(spark, tmp_path):
    from parlance.sources import sinks

    df, path = spark.createDataFrame([("a", "2020-01-02"), ("b", "2021-03-04")], "uid string, day string"), str(tmp_path / "j")
    sinks.write_dated_json(df.where("uid = 'a'"), path, "day", ["uid"])
    sinks.write_dated_json(df, path, "day", ["uid"])
    assert sorted((r.uid, r.yyyy) for r in spark.read.json(path).collect()) == [("a", 2020), ("b", 2021)]


def test_newest_and_heads(spark, tmp_path):
    import os

    from parlance.sources import readers

    assert readers.newest(spark, str(tmp_path)) is None
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "a.parquet"))
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "b.parquet"))
    os.utime(tmp_path / "a.parquet", (2_000_000_000, 2_000_000_000))
    assert readers.newest(spark, str(tmp_path)).endswith("a.parquet")
    (tmp_path / "c.csv").write_text("x")
    assert readers.newest(spark, str(tmp_path)).endswith("c.csv")
    assert readers.head_of_each_file(readers.read_parquet(spark, str(tmp_path / "*.parquet")), 7).count() == 14
