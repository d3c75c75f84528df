import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parlance.functions import dates, text


def one(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select(F.col("i"), f(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def plain_clean(t):
    t = "" if t is None else t
    t = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ", t)
    t = re.sub(r"<[^>]+>", " ", t)
    for p in text.ARTEFACTS:
        t = re.sub(rf"\b{p}\b", " ", t, flags=re.I)
    out, prev = [], None
    for line in re.sub(r"\r\n?", "\n", t).split("\n"):
        line = re.sub(r"\s+", " ", line).strip()
        if line and line == prev and len(line) < 140:
            continue
        out.append(line)
        prev = line or None
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


def test_clean_text_cases(spark):
    long = "x" * 140
    cases = [None, "", "a\x00b\x07c", "<b>bold</b> text", "VIEW summary now", "a\r\nb\rc", "dup\ndup\ndup", f"{long}\n{long}", "y" * 139 + "\n" + "y" * 139, "a\n\na", "a  b", "\n\n\n\nx\n\n\n\ny\n\n"]
    assert one(spark, text.clean_text, *cases) == [plain_clean(c) for c in cases]


def test_clean_text_on_random_lines(spark):
    import random

    rng = random.Random(3)
    cases = ["".join(rng.choice(["a", "b", "\n", "\n", " ", "\t", "<i>", "View Summary", "\r\n"]) for _ in range(rng.randrange(40))) for _ in range(300)]
    assert one(spark, text.clean_text, *cases) == [plain_clean(c) for c in cases]


def test_sentences_and_tokens(spark):
    s = "One. Two!  three. \"Four\" five? 6 is a number.No break"
    want = [x for x in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9\"'])", re.sub(r"\s+", " ", s)) if x]
    assert one(spark, text.sentences, s, "", None) == [want, [], []]
    assert one(spark, text.n_tokens, "Hello, wörld_1!", "") == [4, 0]


def test_html_and_normalise(spark):
    assert one(spark, text.html_to_text, "<script>x\ny</script><p>a&nbsp;b</p><STYLE>q</style> c") == ["a&nbsp;b c"]
    assert one(spark, text.normalize_text, "a \t b\r\n\r\n c d \n") == ["a b\nc d"]


def test_small_helpers(spark):
    assert one(spark, text.ticker_in, "Acme (ABC.D) call", "symbol: xyz", "none") == ["ABC.D", "xyz", None]
    assert one(spark, text.company_key, " A &  B Co ", None) == ["a and b co", None]
    assert one(spark, text.capitalised, "JOHN o'neil McDonald", "") == ["John O'neil McDonald", ""]
    assert one(spark, text.participants, "b, a,,x, a ,cc") == [["cc"]]
    assert one(spark, text.source_of_path, "/x/Russell2K/", "/spark/", "/data/") == ["r2k", "sp", "r1000"]
    glued = ["Jon RavivExecutiveGood day", "x OperatorOperator y", "see Ann LeeAnalyst said", "plain"]
    # The second pass starts at the surname of what the first has put on a line of its own.
    assert one(spark, text.inline_markers, *glued) == ["Jon \nRavivExecutive\n\nGood day", "x \nOperator\n y", "see \nAnn LeeAnalyst\n said", "plain"]
    assert one(spark, lambda c: text.text_flags(c, 3)["ok"], "long enough", "a", "please log in", None) == [True, False, False, False]
    assert one(spark, lambda c: text.header_fields(F.split(c, ";"))["event_type"], "Acme;Q1 Earnings Call;x", "Acme", None) == ["Earnings Call", None, None]
    blocks = F.array(F.struct(F.lit(" A ").alias("speaker"), F.lit("").alias("role"), F.lit(" x  y ").alias("text")), F.struct(F.lit("B").alias("speaker"), F.lit("r").alias("role"), F.lit(" ").alias("text")))
    assert [r.asDict() for r in spark.range(1).select(text.speaker_blocks(blocks).alias("b")).first().b] == [{"speaker": "A", "role": None, "text": "x y"}]


def test_short_id_is_the_digest_of_joined_parts(spark):
    import hashlib

    got = spark.range(1).select(text.short_id(F.lit("s"), F.lit(None), F.lit(3))).first()[0]
    assert got == hashlib.sha1(b"s||3").hexdigest()[:16]


def test_dates(spark):
    written = ["2020-01-03", "1/3/2020", "Jan 3, 2020", "January 3, 2020", "Friday, January 3, 2020 11:00 AM", "2020-01-03T10:00:00Z", "garbage", None]
    got = one(spark, lambda c: F.date_format(dates.parse_date(c), "yyyy-MM-dd"), *written)
    assert got == ["2020-01-03"] * 6 + [None, None]
    assert one(spark, lambda c: F.date_format(dates.date_in(c), "yyyy-MM-dd"), "call of March 4, 2021 at noon", "on 2021-3-4.", "1999-01-01") == ["2021-03-04", "2021-03-04", None]
    assert one(spark, dates.quarter_in, "Q3 2020", "fq1", "x q2") == [3, None, 2]
    w = dates.date_windows(spark, "2020-01-01", "2020-01-10", 4).collect()
    assert [(str(a), str(b)) for a, b in w] == [("2020-01-01", "2020-01-04"), ("2020-01-05", "2020-01-08"), ("2020-01-09", "2020-01-10")]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n\t<>", max_size=60))
def test_plain_clean_is_idempotent(t):
    assert plain_clean(plain_clean(t)) == plain_clean(t) or "<" in plain_clean(t)


def test_nlp(spark):
    from parlance.functions import nlp

    assert one(spark, nlp.content_words, "The quick brown foxes, and a dog", None) == [["quick", "brown", "foxes", "dog"], []]
    assert one(spark, lambda c: nlp.normalised(c, nlp.stem), "They were walking quickly past classes") == ["walk quick past class"]
    assert one(spark, lambda c: nlp.from_json(c, "a int")["a"], '{"a": 1}', "no", None) == [1, None, None]
    assert spark.range(1).select(nlp.percent(F.lit(0.1234))).first()[0] == "12.34%"


def test_eda_and_checks(spark):
    from parlance.operators import eda

    d = spark.createDataFrame([("A & B", "t", "2020-01-03", "x y"), ("a and b", "t", "2020-05-03", "x y"), (None, None, None, None)], "company string, title string, date string, text string")
    out = {k: v.collect() for k, v in eda.run_eda(d).items()}
    assert out["duplicates"][0].dup_rows == 2 and out["variants"][0].variants == "A & B | a and b" and out["missing"][0].missing_text == 1
    assert out["coverage"][0].coverage == 1.0 and out["frequency"][0].upper_median == 2
