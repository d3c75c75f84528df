"""What five filters remove from each part of a corpus, in every order, from sums of signs.

A document's failures are a mask of five bits. One aggregate adds up, for each part and label, 32 signed parity sums:
sum s counts a document as +1 or -1 by the parity of its mask's bits in s. These sums are the Walsh-Hadamard transform
of the numbers of documents with each mask, and the transform is its own inverse but for a factor of 32, so the 32 cells
come back exactly, in integers. All orders follow from the cells: what passes a set of filters is a sum of cells, what a
filter removes behind others is a difference of two such sums, and over all 120 orders a filter is the first to remove a
document with k failures in 120 / k of them.

Equal texts: of each text the least doc_id is worked out by one aggregate over digests, and rows look themselves up by
digest and doc_id together, so a text that a third of all rows share is no hot key.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import BLANKS, cut

FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
SIGNS = "#$%&*|"
#: In how many of the 120 orders one of k failing filters comes before the others, for k from 0 to 5.
FIRST_IN = (0, 120, 60, 40, 30, 24)


def failures(text: Column) -> Column:
    """The bits of A to D; all four depend on the text alone."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    bare = F.btrim(text, F.lit(BLANKS))

    def bits(words: Column) -> Column:
        n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
        few = F.when(n < LEAST_WORDS, 1).otherwise(0)
        return few + F.when(100 * distinct < LEAST_DISTINCT * n, 2).otherwise(0)

    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    capitals = F.regexp_count(text, F.lit("[A-Z]")).cast("long")
    loud = F.when(100 * capitals > MOST_CAPITALS * F.length(text).cast("long"), 4).otherwise(0)
    marked = F.when(F.length(F.translate(text, SIGNS, "")) < F.length(text), 8).otherwise(0)
    return F.transform(F.array(words), bits)[0] + loud + marked


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document: part, mask (bits A to E), label (1: good, 2: toxic, 3: both, 0: neither or unlabelled)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), failures(F.col("text")).alias("four"), F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    slim = cut(slim)
    first = slim.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")) + 2 * F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int"))).alias("label"))
    repeated = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    return slim.join(first, ["doc_id", "digest"], "left").join(marks, "doc_id", "left").select("part", F.coalesce("label", F.lit(0)).alias("label"), (F.col("four") + F.when(repeated, 16).otherwise(0)).alias("mask"))


def _sign(bits: Column) -> Column:
    return 1 - 2 * F.bit_count(bits).bitwiseAND(F.lit(1))


def parity_sums(masked: DataFrame) -> DataFrame:
    """For each part and label: 32 sums of signs over its documents, in one aggregate that combines before its shuffle."""
    sums = [F.sum(_sign(F.col("mask").bitwiseAND(F.lit(s))).cast("long")).alias(f"s{s}") for s in range(CELLS)]
    return masked.groupBy("part", "label").agg(*sums).select("part", "label", F.array(*[f"s{s}" for s in range(CELLS)]).alias("sums"))


def cells(sums: Column) -> Column:
    """The inverse transform: the number of documents with each mask."""
    sets = F.sequence(F.lit(0), F.lit(CELLS - 1))
    return F.transform(sets, lambda m: F.shiftright(F.aggregate(sets, F.lit(0).cast("long"), lambda n, s: n + sums[s] * _sign(m.bitwiseAND(s))), len(FILTERS)))


def _total(counts: Column, where) -> Column:
    """The sum of the cells whose mask is wanted."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(CELLS - 1)), F.lit(0).cast("long"), lambda n, m: n + F.when(where(m), counts[m]).otherwise(F.lit(0).cast("long")))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley (long).

    A part is a value of source; null and the empty string are one part. Null texts count as empty: they fail A alone,
    and E where an empty text of a smaller doc_id stands before them. A document without a doc_id is never a repeat and
    makes none; rows of one doc_id and one text are repeats of smaller ids only, not of each other. A document is good
    or toxic if any of its label rows says so; unlabelled ones are neither. Repeated rows count as often as they stand.
    No documents give no rows. Only doc_id, text, source, quality and toxic are read.
    """
    found = parity_sums(masks(docs, labels)).select("part", "label", cells(F.col("sums")).alias("cells"))
    each = found.groupBy("part").agg(F.collect_list(F.struct("label", "cells")).alias("rows"))  # four rows at most
    added = lambda wanted: F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda m: F.aggregate("rows", F.lit(0).cast("long"), lambda n, r: n + F.when(wanted(r["label"]), r["cells"][m]).otherwise(F.lit(0).cast("long"))))
    each = each.select("part", added(lambda x: F.lit(True)).alias("all"), added(lambda x: x.bitwiseAND(F.lit(1)) > 0).alias("good"), added(lambda x: x >= 2).alias("toxic"))
    sets = F.sequence(F.lit(0), F.lit(CELLS - 1))
    passing = lambda counts: F.transform(sets, lambda s: _total(F.col(counts), lambda m: m.bitwiseAND(s) == 0))
    filters = F.sequence(F.lit(0), F.lit(len(FILTERS) - 1))
    bit, first_in = lambda f: F.call_function("shiftleft", F.lit(1), f), F.array(*[F.lit(x).cast("long") for x in FIRST_IN])
    shapley = F.transform(filters, lambda f: F.aggregate(sets, F.lit(0).cast("long"), lambda n, m: n + F.when(m.bitwiseAND(bit(f)) > 0, F.col("all")[m] * first_in[F.bit_count(m)]).otherwise(F.lit(0).cast("long"))))
    each = each.select("part", "all", passing("all").alias("left_all"), passing("good").alias("left_good"), passing("toxic").alias("left_toxic"), shapley.alias("shares"))
    orders = F.explode(F.split(F.lit(" ".join("".join(x) for x in permutations(FILTERS))), " "))
    steps = each.withColumn("o", orders).withColumn("fs", F.transform(F.split("o", ""), lambda x: F.ascii(x) - ord(FILTERS[0]))).select("*", F.posexplode("fs").alias("k", "f"))
    before = F.aggregate(F.slice("fs", 1, F.col("k")), F.lit(0), lambda s, x: s.bitwiseOR(bit(x)))
    rows = steps.withColumn("before", before).withColumn("after", F.col("before").bitwiseOR(bit(F.col("f"))))
    lost = lambda c: F.col(c)[F.col("before")] - F.col(c)[F.col("after")]
    failing = F.col("left_all")[0] - F.col("left_all")[bit(F.col("f"))]
    return rows.select(
        "part", F.col("o").alias("filter_order"), (F.col("k") + 1).alias("step"), F.col("left_all")[F.col("after")].alias("kept"), lost("left_all").alias("removed"), (failing - lost("left_all")).alias("redundant"),
        F.col("all")[bit(F.col("f"))].alias("unique_fails"), lost("left_good").alias("good_lost"), lost("left_toxic").alias("toxic_lost"), F.col("shares")[F.col("f")].alias("shapley"),
    )
