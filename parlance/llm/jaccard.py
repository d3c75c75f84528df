"""N-gram Jaccard join: a MinHash LSH forest finds candidates, exact verification keeps the links.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or more. Texts with one and
the same set are copies: they are folded into one representative, linked to each other, and never expanded into pairs.

The forest has `TREES` tries. In trie t a representative's label is its t-th group of `DEPTH` MinHash values; the labels
of all tries are sorted together (ranges of equal size, so a hot label is split), and the depth at which a row still
shares a prefix with a neighbour in that order is the deepest node of its trie that it does not have to itself. Rows that
share less than `SHALLOW` values with both neighbours are alone in their trie and go no further.

Candidates come level by level. At full depth all that share a label are tied, runs of equal labels to their first row,
and the connected groups are verified whole. Then the prefix is shortened by one value at a time: a node of that depth
is verified if it holds members of more than one group, and in it just those pairs that share no longer prefix in any
trie and for which it is the first trie with this one, so no pair is compared twice. The links found so far measure the
recall: a link of similarity s is found at depth k with the chance P = 1 - (1 - s^k)^TREES, so it stands for 1 / P links
(Horvitz-Thompson), and the prefixes are shortened until the links found are `RECALL` of those that they stand for, or
until `SHALLOW`, where a pair at the threshold meets with a chance of 0.99997.

Verification compares blocks with exact set sizes and intersections: a task gets at most two blocks, bounded in
members and in shingles, however large a node is, and returns one row for each member (its number of links and the root
it is tied to), not pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import Words, all_shingles, components, cut, fresh, groups, mix, parts_of

_U = np.uint64
SHINGLE = 5
#: Links are pairs of a similarity of NUM / DEN or more.
NUM, DEN = 4, 5
TREES, DEPTH, SHALLOW = 20, 7, 4
RECALL = 0.9999
#: Members and shingles of a block in verification (on average), and rows up to which a list of candidates is broadcast
#: (about 125 bytes each in memory).
BLOCK, BLOCK_SHINGLES = 1024, 1 << 19
MOST_BROADCAST = 200_000
#: Links are counted by similarity in as many bins from the threshold to 1.
BINS = 20
#: Bytes of a value in a label.
_WIDE = 2


def chance(similarity: float | np.ndarray, depth: int, trees: int = TREES):
    """How likely a pair of this similarity shares a prefix of this length in one of the tries."""
    return 1 - (1 - similarity**depth) ** trees


def recall_at(bins: np.ndarray, depth: int) -> float:
    """The share of links that prefixes of this length find, as measured by those found, counted by similarity; each bin
    counts as its lower end. 0 if there are none to measure it by."""
    found = float(bins.sum())
    low = NUM / DEN + np.arange(len(bins)) * (1 - NUM / DEN) / len(bins)
    return found / float((bins / chance(low, depth)).sum()) if found else 0.0


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.arange(1, n + 1, dtype=_U)
    return mix(r * _U(0x9E3779B97F4A7C15)) | _U(1), mix(r * _U(0xC2B2AE3D27D4EB4F))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; a text of one to four words is one shingle, one without words none."""
    words = Words(texts)
    return [np.unique(x) for x in all_shingles(words.hashes(), words.first, SHINGLE)]


def signature(shingle: np.ndarray, n: int) -> np.ndarray:
    """n MinHash values of a set that is not empty."""
    a, b = _factors(n)
    low = np.full(n, np.iinfo(_U).max, _U)
    for i in range(0, len(shingle), 512):
        np.minimum(low, (shingle[i : i + 512, None] * a + b).min(axis=0), out=low)
    return low


def labels_of(shingle: np.ndarray) -> bytes:
    """A set's labels in all tries, in a row."""
    return (mix(signature(shingle, TREES * DEPTH)) >> _U(64 - 8 * _WIDE)).astype(f">u{_WIDE}").tobytes()


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, n (shingles), set_key (null without words) and labels, those of all tries in a row."""

    def run(batches):
        for batch in batches:
            n, keys, labels = [], [], []
            for s in shingle_sets(batch.column("text")):
                n.append(len(s))
                if not len(s):
                    keys.append(None), labels.append(None)
                    continue
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                labels.append(labels_of(s))
            yield pa.record_batch([batch.column("doc_id"), batch.column("digest"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(labels, pa.binary())], names=["doc_id", "digest", "n", "set_key", "labels"])

    return _slim(docs).mapInArrow(run, "doc_id long, digest long, n long, set_key binary, labels binary")


def _slim(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("digest"))


# -- the forest ---------------------------------------------------------------------------------------------------------
def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values the labels (rows of bytes) have in common before the first difference."""
    same = (a == b).reshape(len(a), -1, _WIDE).all(axis=2)
    return np.cumprod(same, axis=1).sum(axis=1)


_ROW = "trie int, label binary, uid long, depth int, head long, edge int, part int"


def _depths(batches):
    """Of rows sorted by trie and label those that share SHALLOW values or more with a neighbour, with the number shared
    and the first row (head) of those with the same label; the first and the last row of a task come in any case."""
    part = TaskContext.get().partitionId()
    held = None  # the last row seen, whose next neighbour is still to come
    start = True

    def rows(trie, label, uid, depth, head, edge):
        keep = (depth >= SHALLOW) | (edge >= 0)
        cols = [trie[keep], None, uid[keep], depth[keep], head[keep], edge[keep]]
        flat = label[keep]
        cols[1] = pa.array([x.tobytes() for x in flat], pa.binary())
        kinds = (pa.int32(), None, pa.int64(), pa.int32(), pa.int64(), pa.int32())
        arrays = [c if k is None else pa.array(c, k) for c, k in zip(cols, kinds)]
        return pa.record_batch([*arrays, pa.array(np.full(len(flat), part), pa.int32())], names=["trie", "label", "uid", "depth", "head", "edge", "part"])

    for batch in batches:
        if not batch.num_rows:
            continue
        trie, uid = batch.column("trie").to_numpy(), batch.column("uid").to_numpy()
        label = np.frombuffer(b"".join(batch.column("label").to_pylist()), np.uint8).reshape(len(uid), -1)
        if held is not None:
            trie, label, uid = np.append(held[0], trie), np.concatenate([held[1], label]), np.append(held[2], uid)
            before, first = held[3], held[4]
        else:
            before, first = 0, uid[0]
        to_next = np.where(trie[1:] == trie[:-1], _shared(label[1:], label[:-1]), 0)
        new = np.append(True, to_next < DEPTH)  # another label than the row before
        head = uid[np.maximum.accumulate(np.where(new, np.arange(len(uid)), 0))]
        head[: int(np.argmax(new[1:])) + 1 if new[1:].any() else len(uid)] = first
        to_last = np.append(before, to_next)
        n = len(uid) - 1  # the last row waits
        edge = np.full(len(uid), -1)
        edge[0] = 0 if start else -1
        if n:
            yield rows(trie[:n], label[:n], uid[:n], np.maximum(to_last[:n], to_next), head[:n], edge[:n])
            start = False
        held = (trie[n:], label[n:], uid[n:], int(to_last[n]), head[n])
    if held is not None:
        trie, label, uid, before, first = held
        edges = [1] if not start else [0, 1]  # the only row is both
        again = np.zeros(len(edges), np.int64)
        yield rows(trie[again], label[again], uid[again], np.full(len(edges), before), np.full(len(edges), first), np.array(edges))


def forest(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(met, ties) of representatives (uid, labels): met has trie, label, uid and depth for rows that are not alone, ties
    pairs (a, b) that connect all rows with the same full label. One sort, by ranges; what neighbours across the ends of
    ranges share is settled from two rows a range."""
    spark = reps.sparkSession
    wide = DEPTH * _WIDE
    label = F.expr(f"substring(labels, trie * {wide} + 1, {wide})")
    laid = reps.select("uid", "labels", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("trie")).select("trie", label.alias("label"), "uid")
    found = cut(laid.repartitionByRange(parts_of(spark), "trie", "label", "uid").sortWithinPartitions("trie", "label", "uid").mapInArrow(_depths, _ROW))
    ends = sorted(found.where("edge >= 0").collect(), key=lambda r: (r.part, r.edge))  # two for each range
    depth = {(r.trie, r.uid): r.depth for r in ends}
    across = []
    for x, y in zip(ends, ends[1:]):
        if x.part != y.part and x.trie == y.trie:
            k = int(_shared(np.frombuffer(bytes(x.label), np.uint8)[None], np.frombuffer(bytes(y.label), np.uint8)[None])[0])
            for r in (x, y):
                depth[r.trie, r.uid] = max(depth[r.trie, r.uid], k)
            if k == DEPTH:
                across.append((x.head, y.head))
    once = {(r.trie, r.uid): (r.trie, bytes(r.label), r.uid, depth[r.trie, r.uid]) for r in ends}
    late = spark.createDataFrame([r for r in once.values() if r[3] >= SHALLOW], "trie int, label binary, uid long, depth int")
    met = found.where("edge < 0").select("trie", "label", "uid", "depth").unionByName(late)
    ties = found.where("uid <> head").select(F.col("uid").alias("a"), F.col("head").alias("b")).unionByName(spark.createDataFrame(across, "a long, b long"))
    return met, ties


# -- verification -------------------------------------------------------------------------------------------------------
def verify_block(sets: list[np.ndarray], same: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(linked documents, index of the root) for each set, and links by similarity; only allowed pairs are compared."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(n), sizes)
    _, column, counts = np.unique(flat, return_inverse=True, return_counts=True)
    common = counts > 1
    number = np.cumsum(common) - 1
    keep = common[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    inter = np.zeros((n, n), np.float32)
    wide = 2048
    m = int(common.sum())
    for a in range(0, m, wide):
        x, y = np.searchsorted(column, (a, min(a + wide, m)))
        part = np.zeros((n, min(wide, m - a)), np.float32)
        part[row[x:y], column[x:y] - a] = 1
        inter += part @ part.T
    linked = np.zeros((n, n), bool)
    bins = np.zeros(BINS, np.int64)
    for a in range(0, n, 256):  # some rows at a time: exact numbers take eight bytes
        both = inter[a : a + 256].astype(np.int64)
        either = sizes[a : a + 256, None] + sizes[None, :] - both
        linked[a : a + 256] = (DEN * both >= NUM * either) & allowed[a : a + 256]
        i, j = np.nonzero(linked[a : a + 256])
        at = ((both[i, j] * DEN - NUM * either[i, j]) * BINS) // ((DEN - NUM) * either[i, j])
        bins += np.bincount(np.minimum(at, BINS - 1), minlength=BINS)
    root = np.arange(n)
    seen = np.zeros(n, bool)
    for s in range(n):
        if seen[s]:
            continue
        seen[s], front = True, np.array([s])
        while len(front):
            root[front] = s
            front = np.flatnonzero(linked[front].any(axis=0) & ~seen)
            seen[front] = True
    return linked @ same, root, bins


def _allowed(g: pd.DataFrame, depth: int, trie: int) -> np.ndarray:
    """Which pairs of a node's members are to be compared there: of two groups, across the two blocks if there are two,
    without a longer prefix in common and without one of this length in an earlier trie."""
    group, side = g["comp"].to_numpy(), g["blk"].to_numpy()
    ok = group[:, None] != group[None, :] if trie >= 0 else ~np.eye(len(g), dtype=bool)
    if g["lo"].iloc[0] != g["hi"].iloc[0]:
        ok &= side[:, None] != side[None, :]
    if trie < 0 or not ok.any():
        return ok
    labels = np.frombuffer(b"".join(g["labels"]), np.uint8).reshape(len(g), TREES, DEPTH * _WIDE)
    for t in range(TREES):
        for k in (depth, depth + 1) if t < trie else (depth + 1,):
            _, number = np.unique(labels[:, t, : k * _WIDE].copy().view(f"V{k * _WIDE}")[:, 0], return_inverse=True)
            ok &= number[:, None] != number[None, :]
    return ok


def _verify(batches, depth: int):
    """Rows (uid, links, root, bins) of one pair of blocks; links counts linked documents, copies included."""
    for g in groups(batches, "pair"):
        g = g.drop_duplicates("uid").sort_values("uid", ignore_index=True)
        uid = g["uid"].to_numpy()
        links, roots, bins = verify_block([np.frombuffer(x, _U) for x in g["shingles"]], g["same"].to_numpy(), _allowed(g, depth, int(g["trie"].iloc[0])))
        yield pd.DataFrame({"uid": uid, "links": links, "root": uid[roots], "bins": [bins.tolist(), *[None] * (len(uid) - 1)]})


def _hinted(df: DataFrame) -> DataFrame:
    """The frame, to be broadcast if it is small."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def _compared(members: DataFrame, sets: DataFrame, depth: int) -> DataFrame:
    """Verifies the members (node, trie, uid, comp) of nodes against each other, in pairs of blocks."""
    spark = members.sparkSession
    sizes = members.join(sets.select("uid", "n"), "uid").groupBy("node").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")
    # Nodes of several blocks are few; the others need no look-up, and no node's members are brought together for one.
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = members.join(_hinted(cut(sizes.where("blocks > 1"))), "node", "left").withColumn("blocks", blocks).withColumn("blk", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"lo": F.least("blk", "other"), "hi": F.greatest("blk", "other")}).withColumn("pair", F.concat_ws("/", "node", "lo", "hi"))
    dealt = cut(dealt.select("pair", "lo", "hi", "blk", "uid", "comp", "trie"))
    have = sets.join(_hinted(dealt), "uid")
    have = have.select("pair", "lo", "hi", "blk", "uid", "same", "comp", "trie", *(["labels"] if depth < DEPTH else []), "shingles")
    return cut(have.repartition(parts_of(spark), "pair").sortWithinPartitions("pair").mapInPandas(lambda batches: _verify(batches, depth), "uid long, links long, root long, bins array<long>"))


def _with_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """uid, same, n, labels and shingles of the representatives wanted, from their texts; what is broadcast to find these
    has no labels, which are longer than all the rest and are made again."""
    texts = _slim(docs).join(_hinted(wanted), (F.col("digest") == F.col("at_digest")) & F.col("doc_id").eqNullSafe(F.col("at_id"))).select("uid", "same", "text")

    def sets(batches):
        for batch in batches:
            out = shingle_sets(batch.column("text"))
            labels = pa.array([labels_of(x) for x in out], pa.binary())
            yield pa.record_batch([*(batch.column(c) for c in ("uid", "same")), labels, pa.array([len(x) for x in out], pa.int64()), pa.array([x.tobytes() for x in out], pa.binary())], names=["uid", "same", "labels", "n", "shingles"])

    # Rows repeated as a whole have one representative, whose text may stand in several rows.
    return cut(texts.mapInArrow(sets, "uid long, same long, labels binary, n long, shingles binary"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, digest, class_root, class_id, n_copies, n_links.

    class_id is the least doc_id of the documents that links tie together, directly or through others; n_links is the
    number of other documents linked directly (copies included); n_copies that of rows with the same set of shingles.
    A document without words (null, empty, blanks) has no link and a class of its own. Rows of one doc_id count as
    documents of their own; null ids are passed over for class_id unless a class has no other. Only doc_id and text are
    read. An empty table gives an empty result.
    """
    rows = cut(sketch(docs))
    worded = rows.where("set_key is not null")
    reps = worded.groupBy("set_key").agg(F.count(F.lit(1)).alias("same"), F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "digest")).alias("at"), F.first("labels").alias("labels"))
    reps = cut(reps.withColumn("uid", F.monotonically_increasing_id()))
    met, ties = forest(reps)
    wanted = met.select("uid").distinct().join(reps, "uid").select("uid", "same", F.col("at.doc_id").alias("at_id"), F.col("at.digest").alias("at_digest"))
    sets = _with_sets(docs, cut(wanted))
    # At full depth: connected groups, verified whole.
    tied = cut(components(ties))
    whole = tied.select(F.col("comp").alias("node"), F.lit(-1).alias("trie"), F.col("node").alias("uid"), F.lit(0).cast("long").alias("comp"))
    found = [_compared(whole, sets, DEPTH)]
    bins = _bins(found[0])
    grouped = None
    for depth in range(DEPTH - 1, SHALLOW - 1, -1):
        if recall_at(bins, depth + 1) >= RECALL:
            break
        if grouped is None:
            grouped = cut(met.join(tied.withColumnRenamed("node", "uid"), "uid", "left").withColumn("comp", F.coalesce("comp", "uid")))
        below = grouped.where(F.col("depth") >= depth).select("trie", "uid", "comp", F.xxhash64("trie", F.expr(f"substring(label, 1, {depth * _WIDE})")).alias("node"))
        mixed = below.groupBy("node").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("node")
        found.append(_compared(below.join(_hinted(cut(mixed)), "node", "left_semi"), sets, depth))
        bins = bins + _bins(found[-1])
    verified = found[0]
    for more in found[1:]:
        verified = verified.unionByName(more)
    joined = components(verified.where("uid <> root").select(F.col("uid").alias("a"), F.col("root").alias("b")))
    links = verified.groupBy("uid").agg(F.sum("links").alias("links"))
    classed = (
        reps.join(joined, F.col("uid") == F.col("node"), "left").join(links, "uid", "left").select("set_key", "uid", "same", "least", F.coalesce("comp", "uid").alias("class_root"), (F.coalesce("links", F.lit(0)) + F.col("same") - 1).alias("n_links"))
    )
    # Only classes of several members are looked up, so a large class is not brought together for its least id.
    least = cut(classed.groupBy("class_root").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    classed = cut(classed.join(_hinted(least), "class_root", "left").select("set_key", "class_root", F.coalesce("class_id", "least").alias("class_id"), "same", "n_links"))
    alone = rows.where("set_key is null").select("doc_id", "digest", F.lit(None).cast("long").alias("class_root"), F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    return worded.join(classed, "set_key").select("doc_id", "digest", "class_root", "class_id", F.col("same").alias("n_copies"), "n_links").unionByName(alone)


def _bins(found: DataFrame) -> np.ndarray:
    """Links by similarity, each counted from both sides."""
    out = np.zeros(BINS)
    for r in found.where("bins is not null").select(F.posexplode("bins").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[r.k] = r.n
    return out


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each class the one with the least doc_id (then digest), with the columns it had."""
    spark = docs.sparkSession
    found = cut(near_duplicates(docs))
    dup = found.where("class_root is not null")
    # Rows with the class's id stay (one of them, where several documents share it), which each row knows by itself.
    has_id = F.col("doc_id").eqNullSafe(F.col("class_id"))
    shared = dup.where(has_id).groupBy("class_root").agg(F.min("digest").alias("least"), F.max("digest").alias("greatest")).where("least < greatest").select("class_root", "least")
    marked = dup.where(has_id).join(_hinted(cut(shared)), "class_root", "left")
    is_best = F.col("least").isNull() | (F.col("digest") == F.col("least"))
    i, d, own = fresh(docs, "doc_id", "digest", "own")
    named = (F.col("doc_id").alias(i), F.col("digest").alias(d))
    gone = cut(marked.where(~is_best).select(*named).unionByName(dup.where(~has_id).select(*named)).distinct())
    again = cut(marked.where(is_best).groupBy("doc_id", "digest").count().where("count > 1").select(*named))
    keyed = docs.withColumn(own, F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0)))
    on = (F.col(own) == F.col(d)) & F.col("doc_id").cast("long").eqNullSafe(F.col(i))
    kept = keyed.join(_hinted(gone), on, "left_anti")
    if not again.isEmpty():  # rows repeated as a whole: one of them stays
        repeated = kept.join(_hinted(again), on, "left_semi").dropDuplicates(["doc_id", own])
        kept = kept.join(_hinted(again), on, "left_anti").unionByName(repeated)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "class_id", "n_copies", "n_links")
