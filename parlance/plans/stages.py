"""Registered queries that run whole stages of the system: turns, scores, duplicates, exploration and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import text
from parlance.operators import dedup, eda, segment, sentiment
from parlance.plans.queries import _SENTS, _TOKENS, CLEANED, query, table

_quoted = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
_pattern = lambda x: x.replace("'", "''")
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"

_FRAME = r"""CASE doc_id % 3 WHEN 0 THEN 'Operator' || chr(10) || clean_text || chr(10) || 'Bob Ray:' || chr(10) || 'thanks to all of you.' WHEN 1 THEN replace(clean_text, '. ', '.' || chr(10) || 'Ann Lee - CFO' || chr(10)) ELSE clean_text END"""


def turn_sql(framed: str) -> str:
    """CTEs up to turn_rows, over documents whose cleaned text is put into an expression of clean_text."""
    return rf"""{CLEANED}, framed AS (SELECT doc_id, {framed} AS clean_text FROM cleaned), rl AS (SELECT doc_id, clean_text, string_split(clean_text, chr(10)) AS ls, list_position([regexp_matches(x, '{_pattern(segment.ROSTER_END)}') FOR x IN string_split(clean_text, chr(10))], true) AS since FROM framed),
cut AS (SELECT doc_id, clean_text, [{_STRIP.format('x')} FOR x IN CASE WHEN since > 0 THEN ls[since:] ELSE ls END] AS ls FROM rl), ln AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM cut),
wd AS (SELECT *, list_filter(regexp_split_to_array(replace(x, ':', ' '), '\s+'), lambda y: y <> '') AS ws FROM ln),
fl AS (SELECT doc_id, i, x, x <> '' AND length(x) <= {segment.LONGEST_LINE} AND NOT regexp_matches(x, '[.!?]$') AND (lower(x) IN ({_quoted(segment.SPEAKER_LINES)}) OR regexp_matches(x, '{_pattern(segment.LABEL)}')
  OR (len(ws) BETWEEN 1 AND {segment.MOST_WORDS} AND len(list_filter(ws, lambda y: regexp_matches(y, '{_pattern(segment.TITLE_CASE)}'))) >= {segment.TITLED_SHARE} * len(ws) AND (len(ws) <= {segment.SURE_WORDS} OR len(list_filter(ws, lambda y: regexp_matches(y, '(?i)^{segment._ROLE}$'))) > 0))) AS s FROM wd),
tn AS (SELECT *, sum(s::INT) OVER (PARTITION BY doc_id ORDER BY i) AS t FROM fl),
sd AS (SELECT doc_id, t, coalesce(max(x) FILTER (s), 'Unknown') AS speaker_raw, {_STRIP.format("coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT s), '')")} AS said FROM tn GROUP BY doc_id, t),
spoken AS (SELECT * FROM sd WHERE said <> '' UNION ALL SELECT doc_id, 0, 'Unknown', {_STRIP.format('clean_text')} FROM cut WHERE {_STRIP.format('clean_text')} <> '' AND doc_id NOT IN (SELECT doc_id FROM sd WHERE said <> '')),
turn_rows AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY t)::INT AS segment_order, speaker_raw, said AS segment_text FROM spoken)"""


TURN_ROWS = turn_sql(_FRAME)


def _turns(spark, sf_dir) -> DataFrame:
    """Turns of all documents, into two thirds of which lines that name speakers are put, so that there are some."""
    d = table(spark, sf_dir, "documents").select("doc_id", text.clean_text(F.col("text")).alias("t"))
    t, third = F.col("t"), F.col("doc_id") % 3
    framed = F.when(third == 0, F.concat(F.lit("Operator\n"), t, F.lit("\nBob Ray:\nthanks to all of you."))).when(third == 1, F.replace(t, F.lit(". "), F.lit(".\nAnn Lee - CFO\n"))).otherwise(t)
    return segment.segment(d.select(F.col("doc_id").cast("string").alias("transcript_id"), framed.alias("clean_text")))


@query(f"WITH {TURN_ROWS} SELECT doc_id AS transcript_id, segment_order, speaker_raw, length(segment_text)::BIGINT AS n_chars, {_TOKENS.format('segment_text')}::BIGINT AS n_tokens FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, segment_order, speaker_raw, segment_text FROM turn_rows)")
def speaker_turns(spark, sf_dir):
    """All turns of all documents (which hold no glued marks; those are in tests/test_segment.py)."""
    return _turns(spark, sf_dir).select("transcript_id", "segment_order", "speaker_raw", F.length("segment_text").cast("long").alias("n_chars"), text.n_tokens(F.col("segment_text")).cast("long").alias("n_tokens"))


_KINDS = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(low, {_quoted([m])})' for m in marks)} THEN '{kind}'" for kind, marks in segment.TYPES) + " ELSE 'Other' END"


@query(
    f"SELECT speaker_type, count(*) AS n FROM (SELECT {_KINDS} AS speaker_type FROM (SELECT lower(c_name || ' ' || CASE c_custkey % 5 WHEN 0 THEN 'Executive' WHEN 1 THEN '- Research' WHEN 2 THEN 'CFO' WHEN 3 THEN 'Operator' ELSE 'of Acme' END) AS low FROM customer)) GROUP BY speaker_type"
)
def speaker_types(spark, sf_dir):
    kind = F.col("c_custkey") % 5
    raw = F.concat_ws(" ", "c_name", F.when(kind == 0, "Executive").when(kind == 1, "- Research").when(kind == 2, "CFO").when(kind == 3, "Operator").otherwise("of Acme"))
    return table(spark, sf_dir, "customer").groupBy(segment.speaker_type(segment.speaker_line(raw)).alias("speaker_type")).agg(F.count(F.lit(1)).alias("n"))


_HITS = lambda words: f"len(list_filter(ws, lambda y: regexp_replace(y, '^[.,;:!?]+|[.,;:!?]+$', '', 'g') IN ({_quoted(sorted(words))})))"
SCORED_SENTENCES = f"""s AS (SELECT doc_id, unnest({_SENTS}) AS x FROM documents), w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(x || ' ' || CASE length(x) % 3 WHEN 0 THEN 'strong growth,' WHEN 1 THEN 'declined' ELSE '' END), '\\s+'), lambda y: y <> '') AS ws FROM s),
l AS (SELECT doc_id, {_HITS(sentiment.GOOD)} AS g, {_HITS(sentiment.BAD)} AS b FROM w), p AS (SELECT doc_id, exp(g) / (exp(g) + exp(1) + exp(b)) AS p, exp(1) / (exp(g) + exp(1) + exp(b)) AS u, exp(b) / (exp(g) + exp(1) + exp(b)) AS m FROM l)"""


@query(f"WITH {SCORED_SENTENCES} SELECT doc_id, count(*) AS n_chunks, round(avg(CASE WHEN p >= u AND p >= m THEN 1.0 WHEN u >= m THEN 0.0 ELSE -1.0 END), 6) AS mean_score, round(avg(p), 6) AS mean_positive, round(avg(m), 6) AS mean_negative FROM p GROUP BY doc_id")
def chunk_scores(spark, sf_dir):
    """Every sentence of every document as a chunk, scored by the word list, and the mean of each document."""
    said = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.sentences(F.col("text"))).alias("x"))
    tail = F.when(F.length("x") % 3 == 0, "strong growth,").when(F.length("x") % 3 == 1, "declined").otherwise("")
    scored = sentiment.score_chunks(said.select("doc_id", F.concat_ws(" ", "x", tail).alias("chunk_text")))
    return scored.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.round(F.avg("sentiment_score"), 6).alias("mean_score"), F.round(F.avg("prob_positive"), 6).alias("mean_positive"), F.round(F.avg("prob_negative"), 6).alias("mean_negative"))


@query(
    f"""WITH RECURSIVE {CLEANED}, d AS (SELECT doc_id, source, clean_text, '2024Q' || (doc_id % 4 + 1) AS q, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS exact FROM cleaned JOIN (SELECT doc_id, text FROM documents) USING (doc_id)),
keyed AS (SELECT doc_id, exact, source || '/' || q || '/' || md5(lower(left(clean_text, 250))) AS key, length(clean_text) AS n FROM d), u AS (SELECT key, n, min(doc_id) AS first FROM keyed WHERE NOT exact GROUP BY key, n),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY first) AS rn FROM u),
f AS (SELECT key, n, first, rn, false AS near, [n] AS kept FROM o WHERE rn = 1 UNION ALL SELECT key, n, first, rn, near, CASE WHEN near THEN kept ELSE list_append(kept, n) END FROM
  (SELECT o.key, o.n, o.first, o.rn, f.kept, len(list_filter(f.kept, lambda x: least(x, o.n) > 0 AND abs(x - o.n) <= {dedup.SIMILAR_LENGTH} * greatest(x, o.n))) > 0 AS near FROM f JOIN o ON o.key = f.key AND o.rn = f.rn + 1))
SELECT doc_id, CASE WHEN exact THEN 'exact_raw_text' WHEN near OR (doc_id > first AND n > 0) THEN 'same_company_quarter_similar_len_prefix' ELSE '' END AS duplicate_reason FROM keyed LEFT JOIN f USING (key, n)"""
)
def dedup_exact_and_length(spark, sf_dir):
    """The first and the third rule of deduplication; without titles the second does not speak."""
    d = table(spark, sf_dir, "documents")
    raw = d.select(F.col("doc_id").alias("ord"), F.col("text").alias("raw_text"), F.col("source").alias("company"), F.lit(None).cast("string").alias("event_date"), F.concat(F.lit("2024Q"), (F.col("doc_id") % 4 + 1).cast("string")).alias("year_quarter"), F.lit("").alias("title"), text.clean_text(F.col("text")).alias("clean_text"))
    return dedup.deduplicate(raw).select(F.col("ord").alias("doc_id"), "duplicate_reason")


_DAY = "(DATE '2019-11-03' + CAST(doc_id % 900 AS INT))"
_EMPTY = lambda c: f"count_if(trim(coalesce({c}, '')) = '')"


@query(
    f"""WITH d AS (SELECT CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE source END AS company, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 'Q' || (doc_id % 4 + 1) || ' call' END AS title, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE {_DAY} END AS day, text FROM documents)
SELECT 'company' AS frame, company AS item, count(*) AS n FROM d WHERE company IS NOT NULL GROUP BY company UNION ALL SELECT 'year', CAST(year(day) AS VARCHAR), count(*) FROM d GROUP BY year(day) UNION ALL SELECT 'month', strftime(day, '%Y-%m'), count(*) FROM d GROUP BY strftime(day, '%Y-%m')
UNION ALL SELECT 'weekday', strftime(day, '%A'), count(*) FROM d GROUP BY strftime(day, '%A') UNION ALL SELECT 'quarter', year(day) || 'Q' || quarter(day), count(*) FROM d WHERE day IS NOT NULL GROUP BY ALL UNION ALL SELECT 'title', title, count(*) FROM d WHERE title IS NOT NULL GROUP BY title
UNION ALL SELECT 'missing', 'missing_company', {_EMPTY('company')} FROM d UNION ALL SELECT 'missing', 'missing_title', {_EMPTY('title')} FROM d UNION ALL SELECT 'missing', 'missing_date', count_if(day IS NULL) FROM d UNION ALL SELECT 'missing', 'missing_text', {_EMPTY('text')} FROM d"""
)
def eda_frames(spark, sf_dir):
    """Corpus exploration: seven of its frames as one table of (frame, item, n)."""
    i = F.col("doc_id")
    day = F.when(i % 13 == 0, F.lit(None).cast("string")).otherwise(F.date_format(F.date_add(F.lit("2019-11-03").cast("date"), (i % 900).cast("int")), "yyyy-MM-dd"))
    title = F.when(i % 7 != 0, F.concat(F.lit("Q"), (i % 4 + 1).cast("string"), F.lit(" call")))
    f = eda.run_eda(table(spark, sf_dir, "documents").select(F.when(i % 11 == 0, " ").otherwise(F.col("source")).alias("company"), title.alias("title"), day.alias("date"), "text"))
    long = lambda name, df, item: df.select(F.lit(name).alias("frame"), F.col(item).cast("string").alias("item"), F.col("n").cast("long").alias("n"))
    m = f["missing"].select(F.explode(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).alias("n")) for c in f["missing"].columns])).alias("x")).select("x.*")
    parts = [long("company", f["companies"], "company"), long("year", f["years"], "year"), long("month", f["months"], "month"), long("weekday", f["weekdays"], "weekday"), long("quarter", f["quarters"].where("_quarter is not null"), "_quarter"), long("title", f["titles"].where("title is not null"), "title"), long("missing", m, "item")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    """WITH t AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END AS company FROM orders), s AS (SELECT CAST(l_orderkey AS VARCHAR) AS id, l_orderkey || '/' || l_linenumber AS seg, l_returnflag AS section, l_quantity::BIGINT AS n FROM lineitem WHERE l_orderkey % 3 > 0 OR l_linenumber < 3), c AS (SELECT * FROM s WHERE n > 3)
SELECT 'transcripts' AS item, count(*)::DOUBLE AS v FROM t UNION ALL SELECT 'segments', count(*) FROM s UNION ALL SELECT 'chunks', count(*) FROM c UNION ALL SELECT 'duplicates', count(*) FROM t WHERE company = 'F' UNION ALL SELECT 'null_company', count_if(company IS NULL) FROM t UNION ALL SELECT 'over', count_if(n > 40) FROM c UNION ALL SELECT 'tiny', count_if(n < 5) FROM c
UNION ALL SELECT 'section_' || section, count(*) FROM s GROUP BY section UNION ALL SELECT 'orphan_segments', count(*) FROM (SELECT DISTINCT id FROM s WHERE id NOT IN (SELECT id FROM t)) UNION ALL SELECT 'orphan_chunks', count(*) FROM (SELECT DISTINCT seg FROM c WHERE seg NOT IN (SELECT seg FROM s))
UNION ALL SELECT 'tokens', sum(n) FROM c UNION ALL SELECT 'mean_tokens', round(avg(n), 6) FROM c"""
)
def run_checks(spark, sf_dir):
    """The checks of the four tables in one call, on orders as transcripts and line items as segments and chunks."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    t = o.select(F.col("o_orderkey").cast("string").alias("transcript_id"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderstatus")).alias("company"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("event_date"), F.lit("x").alias("clean_text"), F.lit("2024Q1").alias("year_quarter"))
    s = li.where("l_orderkey % 3 > 0 or l_linenumber < 3").select(F.col("l_orderkey").cast("string").alias("transcript_id"), F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("segment_id"), F.col("l_returnflag").alias("section"), F.col("l_quantity").cast("long").alias("n_tokens"))
    c = s.where("n_tokens > 3").withColumn("chunk_id", F.col("segment_id")).withColumn("chunk_text", F.lit("x"))
    f = eda.run_checks(t, s, c, t.where("company = 'F'").withColumn("duplicate_reason", F.lit("exact_raw_text")), most_tokens=40)
    wide = lambda df, prefix="": df.select(F.explode(F.array(*[F.struct(F.lit(prefix + k).alias("item"), F.col(k).cast("double").alias("v")) for k in df.columns])).alias("x")).select("x.*")
    by = f["tokens_by_transcript"].agg(F.sum("n_tokens").alias("n"), F.sum("n_chunks").alias("c"))
    parts = [
        wide(f["rows"]), wide(f["over_limit"]), t.agg(F.count_if(F.col("company").isNull()).cast("double").alias("v")).select(F.lit("null_company").alias("item"), "v"),
        f["sections"].select(F.concat(F.lit("section_"), "section").alias("item"), F.col("n").cast("double").alias("v")),
        f["orphan_segments"].agg(F.count(F.lit(1)).cast("double").alias("v")).select(F.lit("orphan_segments").alias("item"), "v"), f["orphan_chunks"].agg(F.count(F.lit(1)).cast("double").alias("v")).select(F.lit("orphan_chunks").alias("item"), "v"),
        by.select(F.lit("tokens").alias("item"), F.col("n").cast("double").alias("v")), by.select(F.lit("mean_tokens").alias("item"), F.round(F.col("n") / F.col("c"), 6).alias("v")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
