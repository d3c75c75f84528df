"""Registered queries over chunks: texts cut by counts of words and signs, and by pieces of a given vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import text, wordpiece
from parlance.operators import segment
from parlance.operators.chunk import chunk
from parlance.plans.queries import _SENTS, _TOKENS, query, table
from parlance.plans.stages import turn_sql

MOST = 200


def packed_sql(sentences: str, count: str, most: int = MOST) -> str:
    """CTEs up to packed (id, chunk_order, chunk_text, n_tokens), out of a CTE of sentences (id, i, x, n): greedy packing as
    a recursion. count: the tokens of a word w; a sentence over the limit is packed by its words, apart from the others."""
    return rf"""longs AS (SELECT *, count_if(n > {most}) OVER (PARTITION BY id ORDER BY i) AS before FROM {sentences}),
units AS (SELECT id, 2 * before AS grp, i, 0 AS j, x, n FROM longs WHERE n <= {most} UNION ALL SELECT id, 2 * before - 1, i, j, w, {count} FROM (SELECT id, before, i, unnest(string_split(x, ' ')) AS w, generate_subscripts(string_split(x, ' '), 1) AS j FROM longs WHERE n > {most})),
numbered AS (SELECT *, row_number() OVER (PARTITION BY id, grp ORDER BY i, j) AS k FROM units),
filled AS (SELECT id, grp, k, x, 1 AS c, n AS held FROM numbered WHERE k = 1 UNION ALL SELECT u.id, u.grp, u.k, u.x, CASE WHEN f.held + u.n <= {most} THEN f.c ELSE f.c + 1 END, CASE WHEN f.held + u.n <= {most} THEN f.held + u.n ELSE u.n END FROM filled f JOIN numbered u ON u.id = f.id AND u.grp = f.grp AND u.k = f.k + 1),
packed AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY grp, c) AS chunk_order, string_agg(x, ' ' ORDER BY k) AS chunk_text, max(held) AS n_tokens FROM filled GROUP BY id, grp, c)"""


_SENT_ROWS = lambda rows, c: f"SELECT id, generate_subscripts(s, 1) AS i, unnest(s) AS x FROM (SELECT id, {_SENTS.replace('text', c)} AS s FROM {rows})"
_N = lambda c: _TOKENS.format(c)


@query(
    f"""WITH RECURSIVE {turn_sql('clean_text')}, own AS (SELECT doc_id || '/' || segment_order AS id, segment_text FROM turn_rows), said AS (SELECT *, {_N('x')} AS n FROM ({_SENT_ROWS('own', 'segment_text')})), {packed_sql('said', _N('w'))}
SELECT split_part(id, '/', 1) AS transcript_id, count(DISTINCT id) AS n_segments, count(*) AS n_chunks, sum(n_tokens)::BIGINT AS n_tokens, max(n_tokens)::INT AS longest FROM packed GROUP BY ALL"""
)
def segment_and_chunk(spark, sf_dir):
    """Turns and chunks of all documents; held against plain loops in tests/test_segment.py, too."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("transcript_id"), text.clean_text(F.col("text")).alias("clean_text"))
    c = chunk(segment.label_sections(segment.segment(d)))
    return c.groupBy("transcript_id").agg(F.count_distinct("segment_id").alias("n_segments"), F.count("chunk_id").alias("n_chunks"), F.sum("n_tokens").alias("n_tokens"), F.max("n_tokens").alias("longest"))


# The vocabulary of these queries is worked out from the table of benchmark items: their words, the first three letters
# and the last three letters of each. It has gaps, so words in pieces and unknown words occur.
_SPLIT = r"regexp_extract_all(lower(strip_accents({})), '[\p{{P}}$+<=>^`|~]|[^\s\p{{P}}$+<=>^`|~]+')"
VOCABULARY = f"""bw AS (SELECT DISTINCT unnest({_SPLIT.format('text')}) AS w FROM benchmark), pieces AS (SELECT DISTINCT true AS first, unnest([w, left(w, 1), left(w, 2), left(w, 3)]) AS p FROM bw UNION SELECT DISTINCT false, unnest([right(w, 1), right(w, 2), right(w, 3)]) FROM bw)"""
#: Word counts by the longest match: g walks each distinct word from its start.
MATCHED = f"""dw AS (SELECT DISTINCT unnest({_SPLIT.format('text')}) AS word FROM documents), lens AS (SELECT DISTINCT first, length(p) AS l FROM pieces),
g AS (SELECT word, 1::BIGINT AS pos, 0::BIGINT AS n FROM dw WHERE length(word) <= {wordpiece.LONGEST_WORD} UNION ALL SELECT g.word, g.pos + max(l), g.n + 1 FROM g JOIN lens ON lens.first = (g.pos = 1) JOIN pieces p ON p.p = substr(g.word, g.pos, l) AND p.first = lens.first WHERE g.pos + l - 1 <= length(g.word) GROUP BY g.word, g.pos, g.n),
counted AS (SELECT word, coalesce(max(n) FILTER (pos = length(word) + 1), 1) AS n_pieces FROM (SELECT * FROM g UNION ALL SELECT word, 0, 0 FROM dw) GROUP BY word)"""


def vocabulary_of(items: DataFrame) -> wordpiece.WordPieces:
    """The pieces of the words of a table's texts; a vocabulary that any reader of the table can work out."""
    w = items.select(F.explode(wordpiece.words(F.col("text"))).alias("w")).distinct()
    parts = [F.col("w"), *[F.substring("w", 1, k) for k in (1, 2, 3)], *[F.concat(F.lit(wordpiece.INSIDE), F.expr(f"right(w, {k})")) for k in (1, 2, 3)]]
    rows = w.select(F.explode(F.array(*parts)).alias("p")).distinct().limit(wordpiece.MOST_PIECES + 1).collect()
    return wordpiece.WordPieces(r.p for r in rows)


@query(f"WITH RECURSIVE {VOCABULARY}, {MATCHED} SELECT word, n_pieces FROM counted")
def wordpiece_words(spark, sf_dir):
    """Every distinct word of the documents with its number of pieces."""
    vocabulary = vocabulary_of(table(spark, sf_dir, "benchmark"))
    each = table(spark, sf_dir, "documents").select(F.explode(wordpiece.words(F.col("text"))).alias("word")).distinct()
    return each.select("word", wordpiece.n_pieces(F.col("word"), vocabulary).alias("n_pieces"))


_COUNT_OF = lambda rows, c: f"(SELECT id, i, sum(coalesce(n_pieces, 0)) AS n FROM (SELECT id, i, unnest({_SPLIT.format(c)}) AS word FROM {rows}) JOIN counted USING (word) GROUP BY id, i)"


@query(
    f"""WITH RECURSIVE {VOCABULARY}, {MATCHED}, own AS (SELECT doc_id AS id, text FROM documents), sents AS ({_SENT_ROWS('own', 'text')}), said AS (SELECT id, i, x, coalesce(n, 0)::BIGINT AS n FROM sents LEFT JOIN {_COUNT_OF('sents', 'x')} USING (id, i)),
words AS (SELECT DISTINCT unnest(string_split(x, ' ')) AS w FROM said WHERE n > {MOST}), sized AS (SELECT w, coalesce(sum(n_pieces), 0)::BIGINT AS size FROM (SELECT w, unnest({_SPLIT.format('w')}) AS word FROM words) JOIN counted USING (word) GROUP BY w),
{packed_sql('said', '0').replace("w, 0 FROM (SELECT", "w, coalesce(size, 0) FROM (SELECT", 1).replace("FROM longs WHERE n > " + str(MOST) + ")),", "FROM longs WHERE n > " + str(MOST) + ") LEFT JOIN sized USING (w)),", 1)}
SELECT id AS doc_id, chunk_order::BIGINT AS chunk_order, n_tokens::INT AS n_tokens, md5(chunk_text) AS chunk_md5 FROM packed"""
)
def wordpiece_chunks(spark, sf_dir):
    """All documents cut into chunks of 200 pieces at most."""
    vocabulary = vocabulary_of(table(spark, sf_dir, "benchmark"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("segment_id"), F.col("text").alias("segment_text"))
    c = chunk(d, MOST, vocabulary.count_texts)
    return c.select("doc_id", F.element_at(F.split("chunk_id", "_c"), -1).cast("long").alias("chunk_order"), "n_tokens", F.md5("chunk_text").alias("chunk_md5"))
