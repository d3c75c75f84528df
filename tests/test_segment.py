import random
import re

from pyspark.sql import functions as F

from parlance.operators import chunk, segment


def turns(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", segment.turns(F.col("t")).alias("x"))
    return [[(y.speaker_raw, y.segment_text) for y in r.x] for r in df.orderBy("i").collect()]


def test_turns_and_speakers(spark):
    t = "Header\nOperatorOperator\nWelcome to the call.\nJane Doe - CFO\nThank you all.\nWe grew.\n\nMore of it.\nJohn SmithAnalyst\nWhat about margins?"
    got, none, *empty = turns(spark, t, "just some text without speakers here, going on and on.", "", None, " \n ", "\u3000")
    # A mark's name never starts right behind a line break, so the first name of a glued line is left on a line of its
    # own: "John" then counts as a speaker who says nothing, and the turn is that of "SmithAnalyst".
    assert got == [("Operator", "Welcome to the call."), ("Jane Doe - CFO", "Thank you all.\nWe grew.\n\nMore of it."), ("SmithAnalyst", "What about margins?")]
    assert spark.range(1).select(segment.inline_markers(F.lit("x.\nJohn SmithAnalyst\nWhat"))).first()[0].split("\n")[1] == "John "
    assert none[0][0] == "Unknown" and empty == [[], [], [], []]


def test_turns_equal_a_loop(spark):
    rng = random.Random(11)
    parts = ["Jane Doe - CFO", "Operator", "OperatorOperator", "We grew a lot.", "", "", "q&a", "more of it and so on, as said", "Bob LeeAnalyst", "View Summary", "some words here", "Ann Ray:"]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(120)]
    lines = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.posexplode(F.split(segment.inline_markers(segment.without_roster(F.col("t"))), "\n")).alias("k", "x"))
    flags = lines.select("i", "k", segment.strip(F.col("x")).alias("x"), segment.is_speaker_line(segment.strip(F.col("x"))).alias("s")).orderBy("i", "k").collect()
    for i, got in enumerate(turns(spark, *texts)):
        want, who, said = [], "Unknown", []
        for x, s in [*((r.x, r.s) for r in flags if r.i == i), (None, True)]:
            if not s:
                said.append(x)
                continue
            if "\n".join(said).strip():
                want.append((who, "\n".join(said).strip()))
            who, said = x, []
        assert got == (want or ([("Unknown", texts[i].strip())] if texts[i].strip() else []))


def test_speaker_types(spark):
    lines = ["Cooper Smith", "Morgan Lee", "Capital Group CEO", "JOHN DOE Executive", "Operator", "Pat Roe", "Jane DoeAnalyst", "ann mcKay,  CFO -", "Bob Ray - Chief Executive Officer", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string").withColumn("x", segment.speaker_line(F.col("x")))
    got = [tuple(r) for r in df.orderBy("i").select(segment.speaker_name(F.col("x")), segment.speaker_type(F.col("x"))).collect()]
    assert got == [
        ("Cooper Smith", "Executive"),  # by the letters "coo"
        ("Morgan Lee", "Analyst"),
        ("Capital Group", "Analyst"),
        ("John Doe", "Executive"),
        ("", "Operator"),
        ("Pat Roe", "Other"),
        ("Jane Doe", "Analyst"),
        ("Ann mcKay,", "Executive"),
        ("Bob Ray", "Executive"),
        ("", "Other"),
    ]


def test_speaker_lines(spark):
    yes = ["Q&A", "Jane Doe:", "Jane Doe", "Jane Doe - CFO", "John", "Vice Chair And Chief Of The Board Ann Ray"]
    no = ["", "x" * 121, "Jane Doe.", "this is a plain line of text", "Five Words Without Any Part"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(yes + no)], "i int, x string")
    assert [r[0] for r in df.orderBy("i").select(segment.is_speaker_line(F.col("x"))).collect()] == [True] * len(yes) + [False] * len(no)


def test_segment_frame(spark):
    df = spark.createDataFrame([("t1", "Jane Doe CEO\nHello there everyone.", 7), ("t2", None, 8)], "transcript_id string, clean_text string, extra int")
    rows = segment.segment(df).collect()
    assert [(r.segment_id, r.speaker_type, r.extra) for r in rows] == [("t1_s1", "Executive", 7)]


def plain_sections(turns):
    out, asked, seen = [], False, False
    for kind, said in turns:
        seen |= kind == "Executive"
        asked |= kind == "Analyst"
        out.append("Q" if kind == "Analyst" else ("A" if asked else "Prepared") if kind == "Executive" else "O" if kind == "Operator" or asked else "Prepared")
        if kind == "Operator" and seen and re.search(segment.OPENS_QUESTIONS, said or ""):
            asked = True
    return out


def test_sections_equal_a_loop(spark):
    rng = random.Random(1)
    rows, want = [], []
    for t in range(60):
        turns = [(rng.choice(["Operator", "Analyst", "Executive", "Other"] + ["Executive", "Operator"] * 2), rng.choice(["hi", "open the line for questions", "Q&A session", None])) for _ in range(rng.randrange(1, 9))]
        rows += [(t, i, k, s) for i, (k, s) in enumerate(turns)]
        want += plain_sections(turns)
    df = spark.createDataFrame(rows, "transcript_id int, segment_order int, speaker_type string, segment_text string")
    assert [r.section for r in segment.label_sections(df).orderBy("transcript_id", "segment_order").collect()] == want
    assert set(want) == {"Prepared", "Q", "A", "O"}


def test_chunks():
    assert chunk.chunks("", 5) == chunk.chunks(None, 5) == chunk.chunks("  ", 5) == []
    assert chunk.chunks("One two. Three four. Five", 6) == [("One two. Three four.", 6), ("Five", 1)]
    assert chunk.chunks("a b c d e f g", 3) == [("a b c", 3), ("d e f", 3), ("g", 1)]
    assert chunk.chunks("x.y.z.w", 3) == [("x.y.z.w", 7)]  # one word over the limit stays whole
    rng = random.Random(2)
    for _ in range(200):
        t = " ".join(rng.choice(["Aa", "b", "c.", "D!", "e-f-g-h"]) for _ in range(rng.randrange(30)))
        got = chunk.chunks(t, 6)
        assert " ".join(c for c, _ in got).split() == t.split()
        assert all(n <= 6 or " " not in c for c, n in got)
        assert all(n == sum(map(chunk.count_tokens, c.split())) for c, n in got)


def test_chunk_frame(spark):
    df = spark.createDataFrame([("s1", "One. Two.", 3)], "segment_id string, segment_text string, x int")
    assert [(r.chunk_id, r.n_tokens, r.x) for r in chunk.chunk(df, 2).orderBy("chunk_id").collect()] == [("s1_c1", 2, 3), ("s1_c2", 2, 3)]
