"""Duplicate transcripts, flagged with a reason and kept for audit."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import text
from parlance.session import shared_folder

SIMILAR_TITLE = 0.96
SIMILAR_LENGTH = 0.01
#: Characters of the grams by which similar titles meet.
GRAM = 3
#: Titles of a group and a range of lengths that are paired directly; more meet by grams, with the same result.
FEW = 64


def _ratio(a: str, b: str, least: float) -> float:
    """Ratcliff-Obershelp similarity; below least, an upper bound of it may stand in its place."""
    m = SequenceMatcher(None, a, b)
    bound = m.quick_ratio()  # from letter counts, in time proportional to the lengths
    return m.ratio() if bound >= least else bound


def title_ratio(a: Column, b: Column, least: float = 0.0) -> Column:
    """Similarity of titles, exact where it is `least` or more."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_ratio(s, t, least) for s, t in zip(x, y)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b)


def exact_repeats(df: DataFrame, columns: Sequence[str], order: str, flag: str = "is_duplicate") -> DataFrame:
    """Flags all but the first row (by order) of rows that agree in columns.

    The texts themselves are compared, by a 128-bit digest, so a hot text moves its key only once for each row; the
    first row is found by an aggregate, which combines before the shuffle, and not by a window over the group.
    """
    key = F.md5(F.to_json(F.struct(*columns)))
    keyed = df.withColumn("_key", key)
    first = keyed.groupBy("_key").agg(F.min(order).alias("_first"))
    return keyed.join(first, "_key").withColumn(flag, F.col(order) > F.col("_first")).drop("_key", "_first")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key: the first by order."""
    names = df.columns
    row = F.struct(*order, *[c for c in names if c not in order and c not in keys])
    return df.groupBy(*keys).agg(F.min(row).alias("_row")).select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in names])


def letter_bound(a: Column, b: Column) -> Column:
    """No less than the similarity of two strings: twice the characters that they share, in any order, by all of theirs."""
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    shared = F.aggregate(F.array_distinct(letters(a)), F.lit(0), lambda n, x: n + F.least(F.length(a) - F.length(F.replace(a, x, F.lit(""))), F.length(b) - F.length(F.replace(b, x, F.lit("")))))
    return 2 * shared / (F.length(a) + F.length(b))


def _first_of_alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows (key, first, n) sorted by key and first: whether n is within SIMILAR_LENGTH of one kept before. Kept
    lengths lie at least that share apart, so a key has few of them, in a sorted list."""
    last, kept = None, []
    for pdf in batches:
        flags = []
        for key, n in zip(pdf["key"], pdf["n"]):
            if key != last:
                last, kept = key, []
            near = near_length(n, kept)
            if not near:
                bisect.insort(kept, n)
            flags.append(near)
        yield pdf.assign(near=flags)


def _allowed(n: Column) -> Column:
    """How many insertions and deletions may lie between a title of n characters and any title similar to it."""
    longest = F.floor(n * ((2 - SIMILAR_TITLE) / SIMILAR_TITLE) + 1e-6)
    return F.floor((n + longest) * (1 - SIMILAR_TITLE) + 1e-6).cast("int")


def candidate_titles(titles: DataFrame) -> DataFrame:
    """Of distinct rows (group, title, seen): group, title, other and the other's seen, each once, for all ordered pairs
    of a group that may be similar to SIMILAR_TITLE.

    Titles of a group are laid into cells by length, so that similar ones are in one cell or in cells side by side; a
    title without neighbours goes no further. Pairs of cells of FEW titles at most are made directly, so a title has no
    more than 3 * FEW of them. Where one of both cells has more, pairs meet by grams, see _by_grams.
    """
    n = F.length("title")
    width = math.log((2 - SIMILAR_TITLE) / SIMILAR_TITLE) * 1.001
    t = titles.withColumn("k", _allowed(n) * GRAM).where("k > 0").withColumn("cell", F.floor(F.log(n) / width))  # shorter titles are similar to none but themselves
    sides = lambda df: df.withColumn("side", F.explode(F.array(*[F.lit(x).cast("long") for x in (-1, 0, 1)])))
    cells = sides(t.groupBy("group", "cell").agg(F.count(F.lit(1)).alias("n"))).groupBy("group", (F.col("cell") + F.col("side")).alias("cell"))
    t = t.join(cells.agg(F.sum("n").alias("around"), F.max("n").alias("most"), F.max(F.when(F.col("side") == 0, F.col("n"))).alias("n")), ["group", "cell"]).where("around > 1")
    small = t.where(F.col("n") <= FEW).select("group", "cell", "title", "seen")
    other = sides(small).select("group", (F.col("cell") + F.col("side")).alias("cell"), F.col("title").alias("other"), F.col("seen").alias("other_seen"))
    direct = small.join(other, ["group", "cell"]).where(_lengths_allow())
    return direct.select("group", "title", "other", "other_seen").unionByName(_by_grams(t.where(F.col("most") > FEW)))


def _lengths_allow() -> Column:
    na, nb = F.length("title"), F.length("other")
    return (F.col("title") != F.col("other")) & (2 * F.least(na, nb) >= SIMILAR_TITLE * (na + nb))


def _by_grams(t: DataFrame) -> DataFrame:
    """The pairs of candidate_titles in which one title at least is of a cell of more than FEW.

    Similar titles are k edits apart at most, and an edit destroys no more than GRAM distinct grams. So if each title
    lists its grams in one order, the first GRAM * k + 1 of both have one in common; titles that have no more grams than
    edits may destroy share one more key. Rare grams of a group come first, so what all its titles say is hardly a key.
    A pair is made once, at the least key that it shares.
    """
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("title") - GRAM + 1), lambda i: F.xxhash64(F.col("title").substr(i, F.lit(GRAM)))))
    t = t.withColumn("big", F.col("n") > FEW)
    each = t.select("group", "title", "seen", "big", "k", F.explode(grams).alias("gram"))
    common = each.groupBy("group", "gram").agg(F.count(F.lit(1)).alias("n"))
    listed = each.join(common, ["group", "gram"]).groupBy("group", "title", "seen", "big", "k").agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("grams"))
    first = F.filter(F.slice("grams", F.lit(1), F.col("k") + 1), lambda x: x.n > 1)
    few = F.when(F.size("grams") <= F.col("k"), F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<long>"))
    keyed = listed.select("group", "title", "seen", "big", F.array_distinct(F.concat(F.transform(first, lambda x: x.gram), few)).alias("keys"))
    laid = keyed.select("*", F.explode("keys").alias("key"))
    others = laid.select("group", "key", F.col("title").alias("other"), F.col("seen").alias("other_seen"), F.col("keys").alias("other_keys"), F.col("big").alias("other_big"))
    pairs = laid.join(others, ["group", "key"]).where(_lengths_allow() & (F.col("big") | F.col("other_big")))
    return pairs.where(F.array_min(F.array_intersect("keys", "other_keys")) == F.col("key")).select("group", "title", "other", "other_seen")


def narrow(df: DataFrame, order: str = "ord", scope: Sequence[str] = ()) -> DataFrame:
    """What the rules look at: ord, same_text, group, title, same_start and n (the length), digests in place of texts."""
    digest = lambda *columns: F.md5(F.to_json(F.struct(*columns, *scope)))
    return df.select(
        F.col(order).alias("ord"),
        digest("raw_text").alias("same_text"),
        digest("company", "event_date").alias("group"),
        text.title_key(F.col("title")).alias("title"),
        digest("company", "year_quarter", F.md5(text.prefix_key(F.col("clean_text"))).alias("prefix")).alias("same_start"),
        F.length(F.coalesce("clean_text", F.lit(""))).alias("n"),
    )


def near_length(n: int, kept: list[int]) -> bool:
    """Whether n is within SIMILAR_LENGTH of a length in the sorted list; 0 is near nothing."""
    at = bisect.bisect_left(kept, n)
    return n > 0 and any(m > 0 and abs(n - m) <= SIMILAR_LENGTH * max(n, m) for m in kept[max(0, at - 1) : at + 1])


def deduplicate(df: DataFrame, order: str = "ord", scope: Sequence[str] = ()) -> DataFrame:
    """df with is_duplicate and duplicate_reason by three rules, each over rows that no earlier rule has flagged.

    1. the same raw_text as an earlier row; 2. the same company and event_date (null equals null) as an earlier row,
    flagged or not, and a title similar to 96 % or more; 3. the same company, year_quarter and first 250 characters as
    an earlier kept row and a length within 1 %. order: a column without ties or nulls that says what is earlier;
    scope: further columns that must agree, for example a batch number.

    The rules work on a narrow table of digests, titles and lengths, written once to the shared folder; texts are read
    once for it and once for the result, to which only flagged rows are joined. Rule 2 compares titles, not rows, and
    only those of candidate_titles whose letters allow the ratio reach Python.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, "duplicates")
    narrow(df, order, scope).write.parquet(folder)
    d = spark.read.parquet(folder)

    d = d.join(d.groupBy("same_text").agg(F.min("ord").alias("first_text")), "same_text").withColumn("exact", F.col("ord") > F.col("first_text"))

    # Rule 2. Earliest row of each distinct title of a group; a later row is flagged if an earlier title is similar, or
    # the same: equal titles have a ratio of 1.
    titles = d.where("title <> ''").groupBy("group", "title").agg(F.min("ord").alias("seen"))
    pairs = candidate_titles(titles).where(letter_bound(F.col("title"), F.col("other")) >= SIMILAR_TITLE)
    similar = pairs.where(title_ratio(F.col("title"), F.col("other"), SIMILAR_TITLE) >= SIMILAR_TITLE)
    seen = titles.unionByName(similar.select("group", "title", F.col("other_seen").alias("seen")))
    d = d.join(seen.groupBy("group", "title").agg(F.min("seen").alias("first_title")), ["group", "title"], "left")
    d = d.withColumn("similar", F.coalesce(~F.col("exact") & (F.col("ord") > F.col("first_title")), F.lit(False)))

    # Rule 3. Of rows of one length and group only the first matters: if it stays, the others are near it, and if it is
    # near another, so are they. That is found before the shuffle, so a group sends its lengths, not its rows.
    still = ~F.col("exact") & ~F.col("similar")
    lengths = d.where(still).groupBy(F.col("same_start").alias("key"), "n").agg(F.min("ord").alias("first"))
    judged = lengths.repartition("key").sortWithinPartitions("key", "first").mapInPandas(_first_of_alike, f"key string, n int, first {lengths.schema['first'].dataType.simpleString()}, near boolean")
    d = d.join(judged.withColumnRenamed("key", "same_start"), ["same_start", "n"], "left")
    third = F.coalesce(still & (F.col("near") | ((F.col("ord") > F.col("first")) & (F.col("n") > 0))), F.lit(False))

    reason = F.when(F.col("exact"), "exact_raw_text").when(F.col("similar"), "same_company_date_similar_title").when(third, "same_company_quarter_similar_len_prefix")
    mark = "_"
    while any(c.lower().startswith(mark) for c in df.columns):
        mark += "_"
    at, why = mark + "ord", mark + "reason"
    flagged = d.select(F.col("ord").alias(at), reason.alias(why)).where(F.col(why).isNotNull())
    out = df.join(flagged, F.col(f"`{order}`") == F.col(at), "left")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.col(why).isNotNull().alias("is_duplicate"), F.coalesce(why, F.lit("")).alias("duplicate_reason"))


def split_audit(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept rows, flagged rows)."""
    return df.where(~F.col("is_duplicate")), df.where("is_duplicate")


def anti_existing(df: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose normalised keys do not exist yet; null keys exist nowhere."""
    norm = lambda c: text.squeeze(F.lower(F.col(c)))
    have = existing.select(*[norm(c).alias(f"_{c}") for c in keys]).distinct()
    on = F.lit(True)
    for c in keys:
        on &= norm(c) == F.col(f"_{c}")
    return df.join(have, on, "left_anti")
