import random
from difflib import SequenceMatcher

from parlance.functions.text import title_key
from parlance.operators import dedup
from pyspark.sql import functions as F

SCHEMA = "ord int, raw_text string, company string, event_date string, year_quarter string, title string, clean_text string"


def plain(rows):
    """The three rules as loops over rows (dicts in order)."""
    why = {}
    seen = set()
    for r in rows:
        if r["raw_text"] in seen:
            why[r["ord"]] = "exact_raw_text"
        seen.add(r["raw_text"])
    key = lambda t: "".join(c for c in (t or "").lower() if c.isalnum() or c == "_")
    for i, r in enumerate(rows):
        if r["ord"] in why:
            continue
        for q in rows[:i]:
            if (q["company"], q["event_date"]) == (r["company"], r["event_date"]) and key(r["title"]) and key(q["title"]) and SequenceMatcher(None, key(r["title"]), key(q["title"])).ratio() >= 0.96:
                why[r["ord"]] = "same_company_date_similar_title"
                break
    for i, r in enumerate(rows):
        if r["ord"] in why:
            continue
        for q in rows[:i]:
            a, b = len(r["clean_text"] or ""), len(q["clean_text"] or "")
            if q["ord"] not in why and (q["company"], q["year_quarter"]) == (r["company"], r["year_quarter"]) and min(a, b) > 0 and abs(a - b) / max(a, b) <= 0.01 and (r["clean_text"] or "")[:250].lower() == (q["clean_text"] or "")[:250].lower():
                why[r["ord"]] = "same_company_quarter_similar_len_prefix"
                break
    return why


def test_three_rules_equal_plain_loops(spark):
    rng = random.Random(5)
    titles = [None, "", "Q1 2020 Earnings Call of the Acme Corporation", "Q1 2020 Earnings Call of the Acme Corporation.", "Q2 2020 Earnings Call of the Acme Corporation", "Another title"]
    rows = []
    for i in range(160):
        n = rng.choice([0, 300, 302, 304, 306, 308, 400])
        t = "p" * n if n else rng.choice([None, ""])
        rows.append(dict(ord=i, raw_text=f"raw {rng.randrange(90)}", company=rng.choice([None, "a", "b"]), event_date=rng.choice([None, "2020-01-01", "2020-01-02", str(i)]), year_quarter=rng.choice(["q1", "q2"]), title=rng.choice(titles + [f"title {i} {rng.random()}"] * 6), clean_text=t))
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    got = {r.ord: r.duplicate_reason for r in dedup.deduplicate(df).collect()}
    want = plain(rows)
    assert got == {r["ord"]: want.get(r["ord"], "") for r in rows}
    assert len(set(want.values())) == 3


def test_scope_keeps_batches_apart(spark):
    df = spark.createDataFrame([(0, "x", 1), (1, "x", 1), (2, "x", 2)], "ord int, raw_text string, batch int")
    for c in ("company", "event_date", "year_quarter", "title", "clean_text"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    assert {r.ord for r in dedup.deduplicate(df, scope=["batch"]).where("is_duplicate").collect()} == {1}


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([], SCHEMA).withColumn("_x", F.lit(1))
    assert dedup.deduplicate(df).columns == [*df.columns, "is_duplicate", "duplicate_reason"]
    assert dedup.deduplicate(df).count() == 0


def test_title_key(spark):
    got = spark.createDataFrame([("Ünï-Code & 1_2",), (None,)], "t string").select(title_key(F.col("t"))).collect()
    assert [r[0] for r in got] == ["ünïcode1_2", ""]


def test_keep_first_and_anti(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, None)], "k string, o int, v string")
    assert sorted((r.k, r.o, r.v) for r in dedup.keep_first(df, ["k"], ["o"]).collect()) == [("a", 1, "y"), ("b", 3, None)]
    have = spark.createDataFrame([(" A ",)], "k string")
    assert [r.k for r in dedup.anti_existing(df, have, ["k"]).collect()] == ["b"]


def test_letters_bound_the_ratio(spark):
    rng = random.Random(8)
    pairs = [("".join(rng.choice("aab\u00e9.*") for _ in range(rng.randrange(1, 12))), "".join(rng.choice("aab\u00e9.*") for _ in range(rng.randrange(1, 12)))) for _ in range(300)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    for r in df.select("a", "b", dedup.letter_bound(F.col("a"), F.col("b")).alias("x")).collect():
        assert abs(r.x - SequenceMatcher(None, r.a, r.b).quick_ratio()) < 1e-9 and r.x >= SequenceMatcher(None, r.a, r.b).ratio() - 1e-9


def test_candidates_hold_all_similar_titles(spark, monkeypatch):
    rng = random.Random(11)
    titles = {"x" * n for n in range(1, 60)} | {"ab" * n for n in range(1, 40)}
    for _ in range(12):
        base = "q1earningscall" + "".join(rng.choice("abcde") for _ in range(rng.randrange(0, 60)))
        for _ in range(25):
            t = list(base)
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(t))
                t[at : at + rng.randrange(2)] = rng.choice(["", "z", "\u00e9"])
            titles.add("".join(t))
    titles = sorted(titles)
    df = spark.createDataFrame([("g", t, i) for i, t in enumerate(titles)], "group string, title string, seen int")
    want = {(a, b) for a in titles for b in titles if a != b and SequenceMatcher(None, a, b).ratio() >= 0.96}
    for few in (0, 9, 64):  # by grams alone, by both ways, mostly directly
        monkeypatch.setattr(dedup, "FEW", few)
        rows = [(r.title, r.other) for r in dedup.candidate_titles(df).collect()]
        assert len(rows) == len(set(rows)) and want and want <= set(rows)
        assert few or len(rows) < len(titles) ** 2 / 4


def test_clashing_names(spark):
    df = spark.createDataFrame([(0, "x", 7, 8), (1, "x", 7, 9)], "ord int, raw_text string, _ord int, `__reason` int")
    for c in ("company", "event_date", "year_quarter", "title", "clean_text"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    assert sorted((r.ord, r._ord, r["__reason"], r.is_duplicate) for r in dedup.deduplicate(df).collect()) == [(0, 7, 8, False), (1, 7, 9, True)]
