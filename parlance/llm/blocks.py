"""Rounds over a corpus whose texts stay where they are stored.

A block is a range of rows of a stored file. A scan sends packed numbers to buckets by hash; what a bucket finds out is
written to the shared folder as a table by block, and the next scan's tasks read the answers for the blocks they hold.
So texts are never shuffled, and it does not matter how later scans are cut into tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import Words, new_folder, parts_of, uri_fs

_U = np.uint64
BLOCK_ROWS = 8_192
#: Bytes of stored documents whose numbers one bucket takes.
BUCKET_BYTES = 4 << 20


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as compressed bytes."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(x).tobytes() for x in arrays))


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    each = sum(np.dtype(k).itemsize for k in kinds)
    n, at, out = len(raw) // each, 0, []
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def stretches(batch: pa.RecordBatch, most: int) -> Iterator[tuple[int, slice, Words]]:
    """(block, rows of the batch, their words) for stretches of one block with about `most` bytes of text at most."""
    blocks = batch.column("block").to_numpy()
    texts = batch.column("text")
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    ends = np.append(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1, len(blocks)) if len(blocks) else []
    a = 0
    for end in ends:
        while a < end:
            b = max(a + 1, min(int(end), int(np.searchsorted(size, (size[a - 1] if a else 0) + most, "right"))))
            yield int(blocks[a]), slice(a, b), Words(texts.slice(a, b - a))
            a = b


class Answers:
    """What a round has answered for the block at hand, read from its table in the shared folder."""

    def __init__(self, folder: str, kinds: tuple[str, ...]):
        self.folder, self.kinds, self.block, self.found, self.homes = folder, kinds, None, None, None

    def of(self, block: int) -> list[np.ndarray] | None:
        if block != self.block:
            from pyarrow import fs as pafs

            fs, top = uri_fs(self.folder)
            where = f"{top}/home={home(block, self._homes(fs, top))}"
            parts = []
            if fs.get_file_info(where).type == pafs.FileType.Directory:
                for f in fs.get_file_info(pafs.FileSelector(where)):
                    if f.base_name.endswith(".parquet"):
                        with fs.open_input_file(f.path) as src:
                            file = pq.ParquetFile(src)
                            for k in self._groups(file, block):
                                t = file.read_row_group(k, columns=["block", "data"])
                                parts += [unpack(x.as_py(), *self.kinds) for b, x in zip(t["block"].to_pylist(), t["data"]) if b == block]
            self.block, self.found = block, None
            if parts:
                cols = [np.concatenate(x) for x in zip(*parts)]
                order = np.argsort(cols[0], kind="stable")
                self.found = [x[order] for x in cols]
        return self.found


    def _homes(self, fs, top: str) -> int:
        if self.homes is None:
            with fs.open_input_file(f"{top}/_homes") as f:
                self.homes = int(f.read())
        return self.homes

    @staticmethod
    def _groups(file: pq.ParquetFile, block: int) -> list[int]:
        """The row groups whose blocks span this one; the rows of a file are sorted by block."""
        at = file.schema_arrow.names.index("block")
        meta = [file.metadata.row_group(k).column(at).statistics for k in range(file.num_row_groups)]
        return [k for k, m in enumerate(meta) if m is None or not m.has_min_max or m.min <= block <= m.max]


def home(block: int, homes: int) -> int:
    """The folder among so many that holds a block's answers."""
    return (block & 0x7FFFFFFFFFFFFFFF) % homes


def is_in(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return known[at] == x


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What np.unique returns with return_index and return_inverse, by a hash table: only what is distinct is sorted."""
    found = pa.array(x).dictionary_encode()
    names, at = found.dictionary.to_numpy(), found.indices.to_numpy()
    order = np.argsort(names)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    first = np.empty(len(order), np.int64)
    first[at[::-1]] = np.arange(len(x) - 1, -1, -1)  # the last one written stays
    return names[order], first[order], rank[at]


def by_bucket(names: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its names) in rising order of places."""
    b = ((names >> _U(32)) % _U(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    there, cuts = np.unique(b[order], return_index=True)
    for k, a, e in zip(there.tolist(), cuts, [*cuts[1:], len(order)]):
        yield k, order[a:e]


SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("data", pa.binary())])


def sent_rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [(), (), ()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, SENT.types)], schema=SENT)


def stored(docs: DataFrame, **extra: Column) -> DataFrame:
    """doc_id and text with the block and row of each document; docs that no file holds are written first."""

    def placed(df: DataFrame) -> DataFrame:
        row, part = F.col("_metadata.row_index"), F.col("_metadata.file_path")
        return df.select(
            F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"),
            F.col("doc_id").isNull().alias("no_id"),
            F.col("text").cast("string").alias("text"),
            F.xxhash64(part, F.floor(row / BLOCK_ROWS)).alias("block"),
            row.alias("row"),
            *[c.alias(k) for k, c in extra.items()],
        )

    try:
        return placed(docs)
    except AnalysisException:  # no file scan below
        folder = new_folder(docs.sparkSession, "documents")
        docs.select("doc_id", "text").write.parquet(folder)
        return placed(docs.sparkSession.read.parquet(folder))


def buckets_of(rows: DataFrame) -> int:
    """Buckets for a frame of stored(): as many as keep each in one task's memory, however large the files below are."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    return min(max(2 * parts_of(rows.sparkSession), -(-size // BUCKET_BYTES)), np.iinfo(np.int32).max)


def answer(sent: DataFrame, share: Callable[[pa.Table], pa.Table], folder: str, more: str = "") -> str:
    """Lets each bucket answer (rows block, data and what `more` adds) and writes the answers, sorted by block, in as many
    folders as there are shuffle partitions: few files, however many blocks, each read in ranges."""
    homes = parts_of(sent.sparkSession)
    found = sent.groupBy("bucket").applyInArrow(share, "block long, data binary" + more)
    at = F.pmod(F.col("block").bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)), F.lit(homes)).alias("home")
    found.select("*", at).repartition(homes, "home").sortWithinPartitions("home", "block").write.option("parquet.block.size", 4 << 20).partitionBy("home").parquet(folder)
    fs, top = uri_fs(folder)
    with fs.open_output_stream(f"{top}/_homes") as f:
        f.write(str(homes).encode())
    return folder
