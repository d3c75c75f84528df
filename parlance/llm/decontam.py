"""Benchmark decontamination with DataFrame functions only: SimHash of item-sized windows, Hamming blocks, exact check.

Texts are compared by their words in lower case, letters and digits only, as multisets of five-word shingles (64-bit
hashes). An item of m shingles is found in a document where a window of m shingles has a weighted Jaccard similarity
(sum of the lesser weights by sum of the greater ones, weights being counts) of 0.8 or more with it. A document of fewer shingles is one window.

1. A window that is similar shares most shingles with its item. Slid to the right until it starts at a shared one, or
   ends with the document, it loses none of them; so item-sized windows are laid from each shingle that an item has,
   and those stay that hold enough shared shingles at all. Documents that share none are done after this scan.
2. Each window and each item gets a 64-bit SimHash of its weighted shingles. The fingerprint is cut into 8 blocks of 8
   bits; two fingerprints within `RADIUS` = 23 bits agree in some block but for two bits at most, so items are indexed
   under all block values within two bits and each window looks up its own 8: no fingerprint within the radius is
   missed. At a similarity of 0.8 fingerprints differ in 9.7 bits on average with a deviation of 2.9.
3. What is left is compared exactly.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import cut, fresh

SHINGLE = 5
NUM, DEN = 4, 5
RADIUS = 23
BLOCKS, BITS, FLIPS = 8, 8, 2
#: Item shingles up to which the scan holds them as a literal set (about 60 bytes each); beyond, they are joined.
MOST_LITERALS = 60_000
#: Shingles (8 bytes each) up to which their set, or all items, are broadcast; beyond, adaptive joins split hot shingles.
MOST_SHINGLES = 2_000_000
#: Rows of the item index, of windows, of pairs or of found documents up to which they are broadcast (below 100 bytes each).
MOST_BROADCAST = 200_000


def _let(value: Column, body) -> Column:
    """body(value) with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(text: Column) -> Column:
    """The shingles of a text in order; none below five words."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")
    at = lambda w, i: F.xxhash64(*[w[i + k] for k in range(SHINGLE)])
    hashed = _let(words, lambda w: F.when(F.size(w) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: at(w, i))))
    return F.coalesce(hashed, F.array().cast("array<long>"))


def simhash(hashes: Column) -> Column:
    """For each of 64 bits, what most shingles have there, counted with their weights."""
    ones = lambda b: F.aggregate(hashes, F.lit(0), lambda n, x: n + F.call_function("shiftright", x, b).bitwiseAND(F.lit(1)).cast("int"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda fp, b: F.when(2 * ones(b) > F.size(hashes), fp.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))).otherwise(fp))


def shared_weight(a: Column, b: Column) -> Column:
    """The sum of the lesser counts of two multisets: half of what their sizes together exceed the sum of differences.

    One walk over both, sorted together, adds up the differences; no shingle is looked for among the others.
    """
    signed = lambda x, s: F.struct(x.alias("h"), F.lit(s).alias("net"))
    both = F.sort_array(F.concat(F.transform(a, lambda x: signed(x, 1)), F.transform(b, lambda x: signed(x, -1))))
    state = lambda h, net, apart: F.struct(h.alias("h"), net.alias("net"), apart.alias("apart"))
    step = lambda z, x: F.when(z["h"] == x["h"], state(z["h"], z["net"] + x["net"], z["apart"])).otherwise(state(x["h"], x["net"], z["apart"] + F.abs(z["net"])))
    apart = F.aggregate(both, state(F.lit(0).cast("long"), F.lit(0), F.lit(0)), step, lambda z: z["apart"] + F.abs(z["net"]))
    return ((F.size(a) + F.size(b) - apart) / 2).cast("int")


def block(fp: Column, b: int) -> Column:
    return F.shiftrightunsigned(fp, b * BITS).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def _near() -> list[int]:
    """What to flip in a block: nothing, one bit or two bits."""
    return [sum(1 << i for i in c) for n in range(FLIPS + 1) for c in combinations(range(BITS), n)]


def items(benchmark: DataFrame) -> DataFrame:
    """The items with five words or more: item_id, item (their shingles), m and fp; equal items of one id once."""
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), shingle_hashes(F.col("text").cast("string")).alias("item")).distinct()
    return own.where(F.size("item") > 0).withColumns({"m": F.size("item"), "fp": simhash(F.col("item"))})


def _small(df: DataFrame, most: int) -> DataFrame:
    """The frame with a broadcast hint if it has at most so many rows; else adaptive joins deal with it."""
    return F.broadcast(df) if df.count() <= most else df


def _meeting(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """n (a number of the row), doc_id, digest, shingles and hits (places in them) of the documents that share a shingle with an item."""
    text = F.col("text").cast("string")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("digest"), text.alias("text"))
    known = bench.select(F.explode("item").alias("h")).distinct()
    n = known.count()
    if n <= MOST_LITERALS:
        wanted = [r.h for r in known.collect()]
        places = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: s[i].isin(wanted))
        found = _let(shingle_hashes(F.col("text")), lambda s: F.when(F.size(s) > 0, F.struct(s.alias("shingles"), places(s).alias("hits"))))
        # The row number keeps the optimiser from working the struct out again for each use.
        seen = slim.select("doc_id", "digest", F.monotonically_increasing_id().alias("n"), found.alias("f"))
        return cut(seen.where(F.size("f.hits") > 0).select("n", "doc_id", "digest", "f.shingles", "f.hits"))
    places = slim.select("doc_id", "digest", F.posexplode(shingle_hashes(F.col("text"))).alias("at", "h")).join(_small(known, MOST_SHINGLES), "h")
    hits = places.groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).agg(F.array_sort(F.collect_set("at")).alias("hits"))
    met = slim.join(hits, (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    return cut(met.select(F.monotonically_increasing_id().alias("n"), "doc_id", "digest", shingle_hashes(F.col("text")).alias("shingles"), "hits"))


def _windows(met: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, digest, m, start and win (its shingles) of the item-sized windows that hold enough shared shingles.

    Only places are exploded. How many shared shingles a window holds is the difference of a running count of them at its
    end and at its start; one sort of a document's places gives both for all its windows. Shingles are sliced for the
    windows that are left.
    """
    spots = met.select("n", F.size("shingles").alias("size"), F.explode(F.transform("hits", lambda i: F.struct(i.alias("at"), F.col("shingles")[i].alias("h")))).alias("s")).select("n", "size", "s.at", "s.h")
    lengths = bench.select("m", F.explode("item").alias("h")).distinct()
    laid = spots.join(_small(lengths, MOST_BROADCAST), "h").select("n", "size", "m", F.greatest(F.lit(0), F.least("at", F.col("size") - F.col("m"))).alias("start"))
    ends = laid.select("*", F.explode(F.array("start", F.col("start") + F.col("m"))).alias("at"), F.lit(0).alias("hit"))
    marks = ends.unionByName(spots.select("n", "at", F.lit(1).alias("hit")), allowMissingColumns=True)
    # An end comes before a shared shingle at its place, so it counts those in front of it.
    before = F.sum("hit").over(Window.partitionBy("n").orderBy("at", "hit").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    held = marks.withColumn("before", before).where("hit = 0").groupBy("n", "size", "m", "start").agg((F.max("before") - F.min("before")).alias("held"))
    # Similar windows share NUM / DEN of the union, which is NUM / (NUM + DEN) of both sizes together, or more.
    enough = cut(held.where((NUM + DEN) * F.col("held") >= NUM * (F.least("m", "size") + F.col("m"))).select("n", "m", "start"))
    return met.join(_small(enough, MOST_BROADCAST), "n").select("doc_id", "digest", "m", "start", F.slice("shingles", F.col("start") + 1, F.col("m")).alias("win"))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs found: doc_id, digest (of the document's text), start (of the window, in words), item_id, similarity; rows of
    docs that are repeated have theirs each."""
    bench = cut(items(benchmark).withColumn("item_no", F.monotonically_increasing_id()))
    windows = _windows(_meeting(docs, bench), bench)
    printed = cut(windows.select("*", simhash(F.col("win")).alias("win_fp"), F.monotonically_increasing_id().alias("win_no")))
    # What is looked up by blocks are fingerprints with numbers; shingles join the pairs that are left.
    keyed = lambda fp: F.explode(F.array(*[F.struct(F.lit(b).alias("b"), block(F.col(fp), b).alias("v")) for b in range(BLOCKS)])).alias("k")
    index = bench.select("item_no", "m", "fp", keyed("fp")).withColumn("flip", F.explode(F.array(*[F.lit(x) for x in _near()])))
    index = index.select("item_no", "m", "fp", F.col("k.b").alias("b"), F.col("k.v").bitwiseXOR(F.col("flip")).alias("v"))
    asked = printed.select("win_no", "m", "win_fp", keyed("win_fp")).select("win_no", "m", "win_fp", "k.b", "k.v")
    # Of the blocks in which a pair meets only the first counts, so no pair comes twice.
    close = lambda b: F.bit_count(block(F.col("fp"), b).bitwiseXOR(block(F.col("win_fp"), b))) <= FLIPS
    first = F.coalesce(*[F.when(close(b), F.lit(b)) for b in range(BLOCKS)])
    near = asked.join(_small(index, MOST_BROADCAST), ["m", "b", "v"]).where((F.bit_count(F.col("fp").bitwiseXOR(F.col("win_fp"))) <= RADIUS) & (F.col("b") == first))
    pairs = _small(cut(near.select("win_no", "item_no")), MOST_BROADCAST)
    held = bench.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    texts = bench.select("item_no", "item_id", "item")
    both = printed.join(pairs, "win_no").join(F.broadcast(texts) if held <= MOST_SHINGLES else texts, "item_no")
    scored = both.select("doc_id", "digest", "start", "item_id", (F.size("win") + F.size("item")).alias("both"), shared_weight(F.col("win"), F.col("item")).alias("shared"))
    union = F.col("both") - F.col("shared")
    return scored.where(DEN * F.col("shared") >= NUM * union).select("doc_id", "digest", "start", "item_id", (F.col("shared") / union).alias("similarity"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document text that holds an item: doc_id, digest, n_items, items (ids in order), similarity (the best)."""
    return matches(docs, benchmark).groupBy("doc_id", "digest").agg(F.count_distinct(F.struct("item_id")).alias("n_items"), F.array_sort(F.collect_set("item_id")).alias("items"), F.max("similarity").alias("similarity"))


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, contaminated, n_items, items (ids joined by commas) and similarity.

    Null and empty texts, and texts and items of fewer than five words, have no shingles and match nothing. An item
    without an id counts in n_items and is left out of items; repeated items of one id count once; repeated rows of
    docs each get their own row. Only doc_id, text and item_id are read. Empty tables give an empty or an all-clean
    result.
    """
    found = cut(contaminated(docs, benchmark)).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "n_items", "items", "similarity")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0)).alias("digest"))
    on = (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    return slim.join(_small(found, MOST_BROADCAST), on, "left").select(
        "doc_id",
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.array_join(F.transform("items", lambda i: i.cast("string")), ","), F.lit("")).alias("items"),
        F.round(F.coalesce("similarity", F.lit(0.0)), 6).alias("similarity"),
    )


def clean_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, with the columns they had."""
    i, d, own = fresh(docs, "doc_id", "digest", "own")
    found = cut(contaminated(docs, benchmark)).select(F.col("doc_id").alias(i), F.col("digest").alias(d))
    keyed = docs.withColumn(own, F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0)))
    on = (F.col(own) == F.col(d)) & F.col("doc_id").cast("long").eqNullSafe(F.col(i))
    return keyed.join(_small(found, MOST_BROADCAST), on, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
