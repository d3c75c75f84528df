"""Line numbers, counts from footers, early stop, failures by file and duplicates across micro-batches."""

import hashlib
import json
import random
import uuid
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from parlance.operators import dedup
from parlance.sources import readers
from parlance.streaming import duplicates, ingest


@pytest.fixture()
def splits(spark):
    """Sets the size of file splits for a test."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    yield lambda size: [spark.conf.set(n, str(size)) for n in names]
    for n, v in zip(names, before):
        spark.conf.set(n, v)


# -- lines ------------------------------------------------------------------------------------------------------------
def test_line_numbers_for_several_split_sizes(spark, splits, tmp_path):
    rng, want = random.Random(1), {}
    for f in range(3):
        lines = [rng.choice(("", "  ", "{bad", "[1]", json.dumps({"id": f * 1000 + k, "text": "é" * rng.randrange(90)}, ensure_ascii=False))) for k in range(400 if f else 3)]
        (tmp_path / f"f{f}.jsonl").write_text("\n".join(lines) + ("\n" if f % 2 else ""))
        want |= {(f"f{f}.jsonl", n): line for n, line in enumerate(lines, 1)}
    (tmp_path / "empty.jsonl").write_text("")
    name = F.element_at(F.split("source_file", "/"), -1)
    ids = {}
    for size in (100, 997, 5000, 1 << 20):
        splits(size)
        got = {(r.f, r.line_no): r.line for r in readers.numbered_lines(spark, str(tmp_path)).select(name.alias("f"), "line_no", "line").collect()}
        # a last line without characters and without an end is no line
        assert got == {k: v for k, v in want.items() if not (v == "" and (k[0], k[1] + 1) not in want and k not in got)}
        good, bad = readers.read_jsonl(spark, str(tmp_path), "id long, text string", numbered=True)
        ids[size] = {r.id: (r.line_no, r.t) for r in good.select("id", "line_no", readers.row_id(name, F.col("text"), F.col("line_no")).alias("t")).collect()}
        assert {(r.f, r.line_no) for r in bad.select(name.alias("f"), "line_no").collect()} == {k for k, v in want.items() if v in ("{bad", "[1]")}
    plain = {}
    for (f, n), line in want.items():
        if line.startswith("{\""):
            o = json.loads(line)
            plain[o["id"]] = (n, hashlib.sha1(f"{f}|{o['text']}|{n}".encode()).hexdigest()[:16])
    assert all(x == plain for x in ids.values()) and len(plain) > 100


def test_line_numbers_fail_rather_than_lie(spark, splits, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(str(i) for i in range(2000)))
    splits(1000)
    df = readers.numbered_lines(spark, str(tmp_path))
    splits(3000)  # the second scan is planned with other splits
    with pytest.raises(Exception, match="have changed"):
        df.agg(F.sum("line_no")).collect()


# -- footers, early stop ----------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("parts") / "p")
    spark.range(0, 1000, 1, 7).select("id", F.col("id").cast("string").alias("s")).write.parquet(folder)
    return folder


def test_counts_come_from_footers(spark, parts):
    df = readers.rows_by_file(spark, parts)
    assert sorted(r.n_rows for r in df.collect()) == [142] + [143] * 6
    assert "ReadSchema: struct<>" in df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_first_rows_opens_what_it_needs(spark, parts):
    sizes = [r.n_rows for r in readers.rows_by_file(spark, parts).orderBy("source_file").collect()]
    everything = [r.id for r in readers.read_parquet(spark, parts).orderBy("source_file", "row_index").collect()]
    for n in (-1, 0, 1, 142, 143, 144, 500, 1000, 2000):
        df = readers.first_rows(spark, parts, n)
        assert [r.id for r in df.orderBy("source_file", "row_index").collect()] == everything[: max(0, n)]
        assert n <= 0 or len(df.inputFiles()) == sum(sum(sizes[:k]) < n for k in range(7))


def test_failures_by_file(spark, tmp_path):
    (tmp_path / "j" / "deep").mkdir(parents=True)
    (tmp_path / "j" / "a.jsonl").write_text('{"x": 1}\n\nnot json\n{"x": 2}\n[3]\n')
    (tmp_path / "j" / "deep" / "b.jsonl").write_text("")
    name = F.element_at(F.split("source_file", "/"), -1).alias("f")
    rows = lambda df: {r.f: (r.n_rows, r.n_failed, r.unreadable) for r in df.select(name, "n_rows", "n_failed", "unreadable").collect()}
    assert rows(readers.folder_report(spark, str(tmp_path / "j"), "jsonl")) == {"a.jsonl": (2, 2, False)}
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.csv").write_text("i,s\n1,x\nno,y\n3,z,more\n4,w\n")
    assert rows(readers.folder_report(spark, str(tmp_path / "c"), "csv", "i int, s string")) == {"a.csv": (2, 2, False)}
    spark.range(0, 500, 1, 2).write.parquet(str(tmp_path / "p"))
    (tmp_path / "p" / "broken.parquet").write_bytes(b"PAR1 this is no Parquet file at all PAR1")
    got = rows(readers.folder_report(spark, str(tmp_path / "p"), "parquet", "id long"))
    assert got["broken.parquet"] == (0, 0, True) and sorted(v for k, v in got.items() if k.startswith("part-")) == [(250, 0, False)] * 2


# -- streams with state -----------------------------------------------------------------------------------------------
SCHEMA = "ord long, raw_text string, company string, event_date string, year_quarter string, title string, clean_text string"


def talks(n=240):
    rng = random.Random(4)
    starts = ["a" * 260, "B  b" * 70, "short", None, ""]
    out = []
    for i in range(n):
        text = rng.choice(starts)
        text = text if not text or rng.random() < 0.2 else text + "x" * rng.randrange(0, 60)
        out.append((i, rng.choice((text, f"raw {rng.randrange(60)}", None)), rng.choice(("A", "B", None)), None, rng.choice(("2024Q1", None)), "", text))
    return out


def test_stream_flags_as_the_batch_plan_does(spark, tmp_path):
    rows = talks()
    want = {r.ord: r.duplicate_reason for r in dedup.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(set(want.values())) == 3
    folder = f"{tmp_path}/{uuid.uuid4().hex}"
    batches = 0
    for k in range(4):  # four arrivals, three runs of the query: it is stopped and goes on from its checkpoint
        part = spark.createDataFrame(rows[k * 60 : k * 60 + 60], SCHEMA)
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if k != 1:
            batches += duplicates.flag_new_rows(ingest.read_new_files(spark, f"{folder}/in", part.schema, 1), f"{folder}/out", f"{folder}/checkpoint")
    got = defaultdict(list)
    for r in spark.read.parquet(f"{folder}/out").collect():
        got[r.ord].append(r.duplicate_reason)
    assert dict(got) == {k: [v] for k, v in want.items()} and batches == 4
    assert duplicates.flag_new_rows(ingest.read_new_files(spark, f"{folder}/in", part.schema, 1), f"{folder}/out", f"{folder}/checkpoint") == 0
