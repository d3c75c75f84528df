"""Mixing sources to target weights by balanced (cube-method) sampling.

Each source gets a share of the words of all rows by its weight, at most `most` times its own words. A source with
target T and W words takes each of its documents T/W times on average: the whole part of that ratio for sure, and the
fraction f by a sample. The sample is drawn by the cube method: all inclusion probabilities of a source start at f and
walk, three documents at a time, along the null space of the balancing constraints (number of documents and number of
words), until each is 0 or 1 but for at most two of a block, which are among its smallest, since units fly by size. What
is left of the blocks meets in further rounds, and the last two documents of a source at most are landed together: the
number of documents moves by less than one, and among those outcomes the words taken stay nearest to the target.
"""

from __future__ import annotations

import itertools
import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import WORD, cut, fresh, groups

#: Documents that one task walks through together.
BLOCK = 2_000


def n_words(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Shares of sum(sizes) by weight, none over `most` times its size; what is over is shared again by weight."""
    out, open_, rest = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if rest * weights[i] / total > most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = rest * weights[i] / total
            break
        for i in sorted(over):
            out[i] = most * sizes[i]
        rest -= sum(out[i] for i in over)
        open_ -= over
    return out


def flight(units: list[tuple[float, int]], rng: random.Random) -> list[float]:
    """The cube method's flight phase over units (probability, size), balancing the sum of the probabilities and of
    probability times size. All but at most two of the results are 0 or 1."""
    p = [x for x, _ in units]
    live: list[int] = []
    eps = 1e-9
    for nxt in range(len(units)):
        if p[nxt] <= eps or p[nxt] >= 1 - eps:
            p[nxt] = float(round(p[nxt]))
            continue
        live.append(nxt)
        if len(live) < 3:
            continue
        i, j, k = live
        a, b, c = units[i][1], units[j][1], units[k][1]
        u = (c - b, a - c, b - a) if not a == b == c else (1, -1, 0)
        # The largest steps either way that keep all three within 0 and 1.
        up = min((1 - p[x]) / v if v > 0 else p[x] / -v for x, v in zip(live, u) if v)
        down = min(p[x] / v if v > 0 else (1 - p[x]) / -v for x, v in zip(live, u) if v)
        step = up if rng.random() * (up + down) < down else -down
        for x, v in zip(live, u):
            p[x] += step * v
            if p[x] < eps or p[x] > 1 - eps:
                p[x] = float(p[x] > 0.5)
        live = [x for x in live if 0 < p[x] < 1]
    return p


def land(units: list[tuple[float, int]], gap: float) -> list[float]:
    """Rounds the few units that a flight leaves (two at most): of the outcomes that move the number of documents by less
    than one, the one that leaves the sum of sizes nearest to the balance; gap is what is taken beyond it so far."""
    expected = sum(p for p, _ in units)
    outcomes = [x for x in itertools.product((0.0, 1.0), repeat=len(units)) if abs(sum(x) - expected) < 1]
    return list(min(outcomes, key=lambda x: (abs(gap + sum((t - p) * s for t, (p, s) in zip(x, units))), x)))


def _round(units: DataFrame, turn: int, last: bool, seed: int) -> DataFrame:
    """One round of flights over blocks: units (source, block, key columns, size, p) with p moved to 0 or 1 if it can be."""

    def walk(batches):
        for g in groups(batches, "block_key"):
            rng = random.Random(f"{seed}:{turn}:{g['block_key'].iloc[0]}")
            pairs = list(zip(g["p"].tolist(), g["unit_size"].tolist()))
            p = flight(pairs, rng)
            left = [i for i, x in enumerate(p) if 0 < x < 1]
            if last and left:
                gap = sum((x - q) * s for (q, s), x in zip(pairs, p))  # what rounding has let slip
                for i, x in zip(left, land([(p[i], pairs[i][1]) for i in left], gap)):
                    p[i] = x
            yield g.assign(p=p)

    return units.repartition("block_key").sortWithinPartitions("block_key", F.col("unit_size").desc(), "doc_id", "digest").mapInPandas(walk, units.schema)


def mix(docs: DataFrame, weights: list[float] | None = None, most: float = 3.0, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """How often the mix takes each row: columns doc_id, source, size, source_size, target, copies (and key columns).

    weights: of the sources in code-point order, null last; None: 1, 2, 3, repeating. Only doc_id, text and source are
    read, so further columns cannot clash. A null or empty text has size 0 and is taken like any other row, adding no
    words. A null source is a source of its own. Rows that agree in doc_id, source and text are one unit: all get the
    same number of copies. An empty table gives an empty result. The sources are a short list of the mixture's own
    configuration: their totals (one row for each source) are the only thing the driver gathers.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size"), F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0)).alias("digest"))
    units = cut(rows.groupBy("doc_id", "source", "size", "digest").agg(F.count(F.lit(1)).alias("same")).withColumn("unit_size", F.col("size") * F.col("same")))
    totals = units.groupBy("source").agg(F.sum("unit_size").alias("w"), F.count(F.lit(1)).alias("n")).collect()
    totals.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-32-be")))
    weights = weights or [1.0 + i % 3 for i in range(len(totals))]
    goal = targets([r.w for r in totals], weights, most)
    ratio = [g / r.w if r.w else 0.0 for g, r in zip(goal, totals)]
    plan = spark.createDataFrame(
        [(r.source, r.w, g, int(x + 1e-12), max(0.0, x - int(x + 1e-12)), max(1, -(-r.n // block))) for r, g, x in zip(totals, goal, ratio)],
        "source string, source_size long, target double, sure int, p double, blocks int",
    )
    s = F.col("source").eqNullSafe(F.col("plan_source"))
    live = units.join(plan.withColumnRenamed("source", "plan_source"), s).drop("plan_source")
    key = F.concat_ws("/", F.coalesce(F.hex(F.col("source")), F.lit("-")), F.pmod(F.xxhash64("doc_id", "digest", "size"), F.col("blocks")).cast("string"))
    live = live.withColumn("block_key", key)
    settled, turn, most_blocks = [], 0, max((-(-r.n // block) for r in totals), default=1)
    while True:
        last = most_blocks <= 1
        moved = cut(_round(live, turn, last, seed))
        if last:
            settled.append(moved)
            break
        settled.append(moved.where("p = 0 or p = 1"))
        # At most two documents of each block are left; they meet in fewer blocks.
        most_blocks = -(-2 * most_blocks // block)
        live = moved.where("p > 0 and p < 1").withColumn("block_key", F.concat_ws("/", F.coalesce(F.hex(F.col("source")), F.lit("-")), F.pmod(F.xxhash64("digest", "doc_id"), F.lit(most_blocks)).cast("string")))
        turn += 1
    out = settled[0]
    for x in settled[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "source", "size", "digest", "same", "source_size", "target", (F.col("sure") + F.round("p").cast("int")).alias("copies"))


def taken_rows(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: each row of docs as often as the mix takes it, with the columns it had."""
    i, s, d, c, key, own, n = fresh(docs, "doc_id", "source", "digest", "copies", "key", "own", "n")
    m = mix(docs, **how).where("copies > 0").select(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("digest").alias(d), F.col("copies").alias(c))
    rows = docs.withColumns({own: F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0)), key: F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))})
    on = (F.col(key) == F.coalesce(F.col(i), F.lit(-1))) & (F.col(own) == F.col(d)) & F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & F.col("source").cast("string").eqNullSafe(F.col(s))
    return rows.join(m, on).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(c)))).select(*[F.col(f"`{x}`") for x in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target and the words taken of it, repeats counted."""
    return mix(docs).withColumn("_", F.explode(F.sequence(F.lit(1), F.col("same").cast("int")))).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
