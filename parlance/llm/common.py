"""What several operators of this subpackage share: words, hashes, the shared folder and streamed groups."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that end a word.
BLANKS = " \t\n\x0b\x0c\r"
#: The same as a pattern of Java and of Python.
WORD = r"[^\x20\x09-\x0D]+"

_U = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; one of our own where that is unset and the
    master is local."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="parlance-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The frame with its lineage cut by a checkpoint in the shared folder, so that a lost executor costs one stage only."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names behind as many underscores as no column of df starts with, so that they clash with none."""
    mark = "_"
    while any(c.startswith(mark) for c in df.columns):
        mark += "_"
    return [mark + n for n in names]


#: Rows of an Arrow batch on its way to Python; the default of 10,000 is 35 MB of text where documents are of usual length.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS, which bounds what JVM and Python hold of them at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def parts_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8; bytes.split() cuts at just the characters of BLANKS."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the result depends on all bits of x."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_BLANK = np.zeros(256, bool)
_BLANK[[ord(c) for c in BLANKS]] = True
#: Odd bases of the word hashes, one for each set of hashes.
_WORD_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Bytes that are hashed at once.
_PIECE = 1 << 20
_tables: dict[tuple, np.ndarray] = {}


def _byte_values(which: int, lower: bool) -> np.ndarray:
    """A random 64-bit value for each byte; with lower, A-Z count as a-z."""
    if ("values", which, lower) not in _tables:
        of = np.arange(256)
        if lower:
            of[65:91] += 32
        _tables["values", which, lower] = mix(np.arange(1, 257, dtype=_U) * _U(_WORD_BASES[which]))[of]
    return _tables["values", which, lower]


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**i, or its inverse modulo 2**64, for i below n."""
    have = _tables.get(("powers", base, inverse))
    if have is None or len(have) < n:
        x = np.full(max(n, _PIECE + 4096), pow(base, -1, 1 << 64) if inverse else base, _U)
        x[0] = 1
        have = np.cumprod(x, dtype=_U)
        if len(have) > 4 * _PIECE:  # for one very long word: not kept
            return have
        _tables["powers", base, inverse] = have
    return have[:n]


class Words:
    """The words of a row of texts: `first` (where each text's words begin among all), and where each word stands.

    Nothing is done for each word in Python: words are runs of other bytes than blanks, which numpy finds in the bytes
    of an Arrow column, and hashes come from prefix sums over these bytes, so memory does not grow with the vocabulary.
    """

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary())
        n = len(texts)
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        if texts.null_count:  # what lies behind a null counts for nothing
            texts = texts.fill_null(b"")
            _, offsets, data = texts.buffers()
            at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
        self.data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
        at = at - at[0]
        word = ~_BLANK[self.data]
        edge = word.copy()
        edge[1:] &= ~word[:-1]
        full = at[:-1][at[1:] > at[:-1]]  # texts that are not empty
        edge[full] = word[full]
        self.begin = np.flatnonzero(edge)
        edge = word.copy()
        edge[:-1] &= ~word[1:]
        last = at[1:][at[1:] > at[:-1]] - 1
        edge[last] = ~_BLANK[self.data[last]]
        self.end = np.flatnonzero(edge) + 1
        self.first = np.searchsorted(self.begin, at)

    def __len__(self) -> int:
        return len(self.begin)

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, which: int = 0, lower: bool = False) -> np.ndarray:
        """64-bit hashes of the words; `which` chooses one of two independent sets."""
        values, base = _byte_values(which, lower), _WORD_BASES[1 - which]
        out = np.empty(len(self), _U)
        a = 0
        while a < len(self):
            b = max(a + 1, int(np.searchsorted(self.end, self.begin[a] + _PIECE, "right")))
            low, high = int(self.begin[a]), int(self.end[b - 1])
            sums = np.zeros(high - low + 1, _U)
            np.cumsum(values[self.data[low:high]] * powers(base, high - low), dtype=_U, out=sums[1:])
            x, y = self.begin[a:b] - low, self.end[a:b] - low
            out[a:b] = mix((sums[y] - sums[x]) * powers(base, high - low, True)[x] + (y - x).astype(_U))
            a = b
        return out


def all_shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """The shingles of each text, from the hashes of all texts' words in a row."""
    rolled = np.zeros(max(0, len(hashes) - k + 1), _U)
    for i in range(k):
        rolled = mix(rolled * _U(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - k + 1 + i]) if len(rolled) else rolled
    return [rolled[a : b - k + 1] if b - a >= k else shingles(hashes[a:b], k) for a, b in zip(first[:-1], first[1:])]


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; the whole text is the one run where it has 1 to k-1 words."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(k, n)
    out = np.zeros(n - k + 1, _U)
    for i in range(k):
        out = mix(out * _U(0x9E3779B97F4A7C15) + hashes[i : n - k + 1 + i])
    return out


def groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Consecutive rows of one key, from batches sorted by it; holds one group and one batch at a time."""
    held: list[pd.DataFrame] = []
    last = None
    for pdf in batches:
        if not len(pdf):
            continue
        k = pdf[key].to_numpy()
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1), len(pdf)]
        for a, b in zip(cuts, cuts[1:]):
            if held and k[a] != last:
                yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held = []
            held.append(pdf.iloc[a:b])
            last = k[a]
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b), both long: rows (node, comp), comp being the least node of the component.

    Alternates large-star and small-star steps, which keep the number of edges within a constant of the input's and
    need a number of rounds that grows with the logarithm of the longest path. No group is gathered: each step is an
    aggregate for each node and a join that adaptive execution may split.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("s")).select("s.*").where("a <> b").distinct()
        )
        e = cut(small)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    stars = e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp"))
    roots = stars.select(F.col("comp").alias("node"), "comp").distinct()
    return stars.unionByName(roots)


def release() -> None:
    """Gives memory that is free in this Python worker back to the system; workers outlive their tasks."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def drop_folder(spark: SparkSession, uri: str) -> None:
    """Deletes a folder that nothing reads any more, wherever it is stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def uri_fs(uri: str):
    """The file system and path of a URI, for Python workers; a plain path counts as local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri.removeprefix("file:")))
