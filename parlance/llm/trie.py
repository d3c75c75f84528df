"""The trie of conversation prefixes, worked out from who owns which node.

A node belongs to its smallest member. Every longer prefix that this conversation passes has no smaller member either,
so each conversation owns a suffix of its own path, and each node has one owner. All sums over subtrees follow without
walking the tree: a conversation that passes a node passes just the nodes of its subtree that lie on its own path, so

    saved tokens below a node = sum over its members of the bytes from there on, all less those it owns itself,
    leaves below a node       = members that own the childless node where they end,
    children of a node        = members that own the next node on their path.

One aggregate by prefix gives the smallest members; they are joined to the prefixes, windows by conversation mark the
owned suffix and add up what lies from each prefix on, and one more aggregate by prefix adds up its members' rows.

Prefixes are named by their depth and two 64-bit values: the exclusive or of a hash of each turn's SHA-256 and its
place. A prefix that a third of all conversations share is no hot key: aggregates combine before they shuffle, and a
prefix joined back to its members is broadcast where it has over a thousandth of all of them, of which there are at
most a thousand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import cut

#: A base conversation for every so many ids, and the most turns taken from it, plus one.
STRIDE, MOST_HEAD = 5, 9
#: Keys with more than one in so many rows count as hot; there are fewer of them than this.
HOT_SHARE = 1_000
#: Ids of one string on its way to the digest of a node's last members.
IDS_OF_A_PIECE = 1 << 16

NODE = ["depth", "k1", "k2"]


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conversations (conv_id, n: turns), and their turns (conv_id, depth from 1, hash, bytes), as they are rebuilt.

    A conversation takes the first crc32(conv_id) % 9 turns of the one whose id is its own less its own modulo 5, then
    its own turns behind as many. Turns are ordered by turn (null first), role and text.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text")).where("conv_id IS NOT NULL")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    # The length before the role keeps (role, text) apart from another cut of the same characters.
    hashed = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    placed = cut(named.select("conv_id", F.row_number().over(order).alias("at"), hashed.alias("hash"), F.octet_length("text").cast("long").alias("bytes")))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_HEAD
    own = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).withColumn("h", head.cast("int"))
    heads = placed.where(F.col("at") < MOST_HEAD).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("at", "hash", "bytes"))).alias("head"))  # eight turns at most
    own = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % STRIDE).join(heads, "base", "left")
    taken = F.slice(F.coalesce("head", F.array().cast("array<struct<at:int,hash:string,bytes:bigint>>")), 1, F.col("h"))
    own = cut(own.select("conv_id", "h", taken.alias("head"), (F.size(taken) + F.greatest(F.col("own") - F.col("h"), F.lit(0))).cast("int").alias("n")))
    first = own.select("conv_id", F.explode("head").alias("t")).select("conv_id", F.col("t.at").alias("depth"), F.col("t.hash").alias("hash"), F.col("t.bytes").alias("bytes"))
    rest = placed.join(own.select("conv_id", "h", F.size("head").alias("from")), "conv_id").where(F.col("at") > F.col("h"))
    rest = rest.select("conv_id", (F.col("at") - F.col("h") + F.col("from")).alias("depth"), "hash", "bytes")
    return own.select("conv_id", "n"), first.unionByName(rest)


def prefixes(turns: DataFrame) -> DataFrame:
    """One row for each conversation and prefix of it, the empty one included: conv_id, depth, k1, k2, bytes (of the last text), n (turns of the whole)."""
    convs, told = rebuilt(turns)
    running = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    name = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "depth", "hash")).over(running)
    paths = told.select("conv_id", "depth", name(1).alias("k1"), name(2).alias("k2"), "bytes").join(convs, "conv_id")
    zero = F.lit(0).cast("long")
    return paths.unionByName(convs.select("conv_id", F.lit(0).alias("depth"), zero.alias("k1"), zero.alias("k2"), zero.alias("bytes"), "n"))


def joined(many: DataFrame, one: DataFrame, keys: list[str], size: Column, total: int) -> DataFrame:
    """many inner-joined with one (a row for each key); keys that `size` gives over total / HOT_SHARE rows are broadcast.

    Sizes of all keys sum up to at most total, so fewer than HOT_SHARE rows are broadcast.
    """
    hot = size > F.lit(max(1, total // HOT_SHARE))
    few, rest = one.where(hot), one.where(~hot)
    known = F.broadcast(few.select(*keys, F.lit(True).alias("is_hot")))
    apart = many.join(known, keys, "left")
    return apart.where("is_hot").drop("is_hot").join(F.broadcast(few), keys).unionByName(apart.where("is_hot IS NULL").drop("is_hot").join(rest, keys))


def end_digests(ends: DataFrame) -> DataFrame:
    """ends (NODE, conv_id) to NODE and ends_sha256: of the ids in ascending order, joined by commas.

    Ids are joined in pieces by ranges of ids, and a node's pieces go through the digest one after the other; a digest
    of one string can't be split further, but no task holds more than a piece.
    """
    piece = F.floor(F.col("conv_id") / F.lit(IDS_OF_A_PIECE)).cast("long")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = ends.withColumn("piece", piece).groupBy(*NODE, "piece").agg(ids.alias("ids"))

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, so_far, out = None, None, []
        for pdf in batches:
            for *node, ids in pdf[[*NODE, "ids"]].itertuples(index=False):
                if node == last:
                    so_far.update(b"," + ids.encode())
                else:
                    if last is not None:
                        out.append((*last, so_far.hexdigest()))
                    last, so_far = node, hashlib.sha256(ids.encode())
            yield pd.DataFrame(out, columns=[*NODE, "ends_sha256"])
            out = []
        if last is not None:
            yield pd.DataFrame([(*last, so_far.hexdigest())], columns=[*NODE, "ends_sha256"])

    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece").mapInPandas(digests, "depth int, k1 long, k2 long, ends_sha256 string")


def nodes(turns: DataFrame) -> DataFrame:
    """One row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty. Turns of one number are ordered by role and text, equal ones stay as often as they
    are; rows without a conv_id belong to no conversation and are left out. Without any conversation there is no node,
    not even a root. Only conv_id, turn, role and text are read.
    """
    passed = cut(prefixes(turns))
    owned = cut(passed.groupBy(*NODE).agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("members"), F.max("n").alias("longest")))
    total = passed.count()
    own = F.col("owner") == F.col("conv_id")
    marked = joined(passed, owned, NODE, F.col("members"), total)
    path, onward = Window.partitionBy("conv_id").orderBy("depth"), Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    told = marked.select(
        "conv_id", *NODE, "n", F.lag("owner").over(path).alias("above"), F.coalesce(F.lead(own).over(path), F.lit(False)).cast("long").alias("next"), F.sum(F.when(own, F.lit(0).cast("long")).otherwise(F.col("bytes"))).over(onward).alias("shared"),
        F.max(F.when((F.col("depth") == F.col("n")) & own & (F.col("longest") == F.col("depth")), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))).over(onward).alias("leaf"),
    )
    found = told.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.first("above").alias("parent_conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum("next").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("shared").alias("saved_tokens"))
    ends = end_digests(passed.where("depth = n").select(*NODE, "conv_id"))
    out = found.join(ends, NODE, "left")
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
