"""A uniform shuffle into shards of exact sizes, with DataFrame functions only.

1. Rows are put into random order within the partition that holds them, by a sort of narrow rows, and get their place.
2. How many rows of each partition go to each shard is drawn from the multivariate hypergeometric distribution: that of
   a uniformly random assignment whose shards have exact sizes. Partitions form a tree of `FAN` children to a node. From
   the root down each node deals what its shards hold to its children, one after the other, so that a draw depends on
   what is left only; the nodes of a level are rows of a table and are worked on in parallel. A single draw inverts the
   distribution function, summed by the ratio of neighbouring terms over all values within 12 deviations of the mode.
3. In a partition of which shard 0 gets a rows and shard 1 gets b, the first a places go to shard 0, the next b to 1.
4. Within a shard rows are ordered by an independent random key: buckets of the key are sorted apart, and their sizes
   added up before them give each row its slot. Buckets grow in number with the rows, so none grows in size.

Every shard assignment with these sizes and every order within the shards is equally likely, up to the quality of the
hash that stands for randomness. The result is a function of the seed, the rows and how they lie in input partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import cut, fresh

SHARDS = 16
#: Children of a node in the tree of partitions.
FAN_BITS = 6
#: Rows of a bucket within a shard, on average.
BUCKET_ROWS = 50_000
#: Rows of the matrix, or of the table of buckets, up to which they are broadcast (about 200 bytes a row).
MOST_BROADCAST = 20_000


def _let(value: Column, body) -> Column:
    """body(value) with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def _uniform(*keys: Column) -> Column:
    """A number in (0, 1) that depends on the keys alone."""
    return (F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") + 0.5) / float(1 << 53)


def hypergeometric(u: Column, total: Column, marked: Column, drawn: Column) -> Column:
    """How many of `drawn` out of `total` are among the `marked`, at quantile u. All long; u between 0 and 1."""

    def bounds(_):
        low, high = F.greatest(F.lit(0).cast("long"), drawn - (total - marked)), F.least(drawn, marked)
        share = marked / F.greatest(total, F.lit(1).cast("long"))
        spread = F.sqrt(F.greatest(drawn * share * (1 - share) * (total - drawn) / F.greatest(total - 1, F.lit(1).cast("long")), F.lit(0.0)))
        mode = F.floor((drawn + 1.0) * (marked + 1.0) / (total + 2.0))
        reach = F.ceil(12 * spread).cast("long") + 20
        return F.struct(F.greatest(low, F.least(high, mode) - reach).alias("low"), F.least(high, F.greatest(low, mode) + reach).alias("high"))

    # The term of x + 1 by that of x; terms are relative to that of the least x in reach.
    ratio = lambda x: (marked - x).cast("double") * (drawn - x) / ((x + 1).cast("double") * (total - marked - drawn + x + 1))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))
    step = lambda s, x: F.struct((s["term"] * ratio(x)).alias("term"), (s["sum"] + s["term"]).alias("sum"))

    def chosen(b):
        values = F.sequence(b["low"], b["high"])
        # All terms but the last are summed in the fold, and the last is what the fold is left with.
        whole = F.aggregate(F.when(b["high"] > b["low"], F.sequence(b["low"], b["high"] - 1)).otherwise(F.array().cast("array<long>")), start, step, lambda s: s["sum"] + s["term"])

        def pick(goal):
            first = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"), b["low"].alias("x"))
            go = lambda s, x: F.struct(F.when(x < b["high"], s["term"] * ratio(x)).otherwise(F.lit(0.0)).alias("term"), (s["sum"] + s["term"]).alias("sum"), F.when((s["sum"] + s["term"] <= goal) & (x < b["high"]), x + 1).otherwise(s["x"]).alias("x"))
            return F.aggregate(values, first, go, lambda s: s["x"])

        return _let(u * whole, pick)

    return F.when(F.least(drawn, marked) == 0, F.lit(0).cast("long")).when(drawn == total, marked).otherwise(_let(_let(F.lit(0), bounds), chosen))


def _dealt(node: Column, room: Column, kids: Column, shards: int, seed: int) -> Column:
    """For each child (number k, size n) of a node: the rows that it sends to each shard, out of room (one for each shard)."""

    def child(state, kid):
        def one(s, j):
            """s: rows of the child yet to place, room of this shard and those behind it, what has been dealt."""
            x = lambda d: F.struct((s["left"] - d).alias("left"), (s["open"] - state["room"][j]).alias("open"), F.concat(s["row"], F.array(d)).alias("row"))
            return _let(hypergeometric(_uniform(F.lit(seed), node, kid["k"], j), s["open"], state["room"][j], s["left"]), x)

        all_open = F.aggregate(state["room"], F.lit(0).cast("long"), lambda n, x: n + x)
        begin = F.struct(kid["n"].alias("left"), all_open.alias("open"), F.array().cast("array<long>").alias("row"))
        row = F.aggregate(F.sequence(F.lit(0), F.lit(shards - 1)), begin, one, lambda s: s["row"])
        return _let(row, lambda r: F.struct(F.zip_with(state["room"], r, lambda a, b: a - b).alias("room"), F.concat(state["out"], F.array(F.struct(kid["k"].alias("k"), r.alias("row")))).alias("out")))

    nothing = F.array().cast("array<struct<k:long,row:array<long>>>")
    return F.aggregate(kids, F.struct(room.alias("room"), nothing.alias("out")), child, lambda s: s["out"])


def matrix(sizes: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """sizes (part, n) to rows (part, row): how many rows each partition sends to each shard.

    Parts are whole numbers from 0, each once. Shards get total // shards rows, the first total % shards one more.
    """
    whole = sizes.agg(F.max("part").alias("last"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    levels, last = 1, whole.last or 0
    while last >> (FAN_BITS * levels):
        levels += 1
    at_root = F.array(*[F.lit(whole.n // shards + (k < whole.n % shards)).cast("long") for k in range(shards)])
    out = None
    for level in range(1, levels + 1):
        at = F.shiftright(F.col("part").cast("long"), FAN_BITS * (levels - level))
        kids = sizes.groupBy(at.alias("k")).agg(F.sum("n").cast("long").alias("n"))
        kids = kids.groupBy(F.shiftright("k", FAN_BITS).alias("node")).agg(F.array_sort(F.collect_list(F.struct("k", "n"))).alias("kids"))  # 2**FAN_BITS at most
        dealt = F.explode(_dealt(F.col("node"), F.col("room"), F.col("kids"), shards, seed))
        rooms = kids.withColumn("room", at_root) if out is None else out.join(kids, "node")
        out = cut(rooms.select(dealt.alias("d")).select(F.col("d.k").alias("node"), F.col("d.row").alias("room")))
    return out.select(F.col("node").alias("part"), F.col("room").alias("row"))


def _bounded(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= MOST_BROADCAST else df


def shuffled(rows: DataFrame, key: list[Column], shards: int = SHARDS, seed: int = 0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows with shard (int) and slot (long, gapless from 0 in each shard) in columns of these names behind them.

    key: what tells rows apart; rows of equal keys stand next to each other before their partition's places are given,
    and which of them comes first is then left to the sort. The frame's columns travel through both exchanges, so give
    narrow rows and join wide ones by an id. Columns of rows must not be called shard or slot.
    """
    part, place, order, bucket, before = fresh(rows, "part", "place", "order", "bucket", "before")
    mixed = rows.withColumn(order, F.xxhash64(F.lit(seed), F.lit(1), *key)).sortWithinPartitions(order)
    # Spark's running id is the partition's number in its upper bits and the place within the partition in the lower 33.
    placed = cut(mixed.withColumn(place, F.monotonically_increasing_id()).withColumn(part, F.shiftright(place, 33)).drop(order))
    sizes = cut(placed.groupBy(part).agg(F.count(F.lit(1)).alias("n")).withColumnRenamed(part, "part"))
    drawn = matrix(sizes, shards, seed)
    ends = F.transform("row", lambda _, i: F.aggregate(F.slice("row", 1, i + 1), F.lit(0).cast("long"), lambda a, x: a + x))
    ends = drawn.select(F.col("part").alias(part), ends.alias(before))
    sent = placed.join(_bounded(ends, sizes.count()), part)
    within = F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    sent = sent.withColumn("shard", F.size(F.filter(before, lambda e: e <= within)).cast("int")).drop(before)
    n = placed.count()
    buckets = max(1, -(-n // (shards * bucket_rows)))
    lot = F.xxhash64(F.lit(seed), F.lit(2), F.col(place))
    sent = cut(sent.withColumn(order, lot).withColumn(bucket, F.pmod(order, F.lit(buckets))))
    counts = sent.groupBy("shard", bucket).agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", bucket, F.coalesce(F.sum("n").over(running), F.lit(0)).alias(before))
    own = Window.partitionBy("shard", bucket).orderBy(order, place)
    ranked = sent.withColumn("slot", F.row_number().over(own).cast("long") - 1)
    out = ranked.join(_bounded(starts, shards * buckets), ["shard", bucket])
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], "shard", (F.col("slot") + F.col(before)).alias("slot"))


def digest(docs: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, law (`rows`), shard, slot, grown_shard (null).

    size is the text's UTF-8 bytes and one more; a null text has size 1 and the checksum of nothing, 0. Shards hold
    equal numbers of rows, or one more in the first few. Equal texts are rows like others and may lie in several shards.
    Repeated rows and null ids each get a place of their own; an empty table gives no rows. Only doc_id and text are
    read; other columns, whatever they are called, are not.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shuffled(slim, [F.col("doc_id"), F.col("size"), F.col("text_crc32")], shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
