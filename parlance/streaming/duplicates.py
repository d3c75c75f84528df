"""Duplicates across micro-batches: the first and the third rule of deduplication with keyed state.

Two stateful steps in one streaming query. The first knows the digest of every text that it has seen; the second knows,
for each company, quarter and beginning of a text, the lengths that were kept, which lie at least a hundredth apart, so
there are few. Only digests and lengths travel and only they are state. State and offsets are in the query's checkpoint:
a run that is stopped, or dies, goes on where it was, with the flags that an uninterrupted run would have given.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parlance.operators.dedup import narrow, near_length
from parlance.streaming.ingest import run_to_end

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _SeenTexts(StatefulProcessor):
    """Rows of one text: all but the first ever are repeats."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)[["ord", "same_start", "n"]]  # of one micro-batch
        first = None if self.seen.exists() else new["ord"].min()
        if first is not None:
            self.seen.update((True,))
        yield new.assign(exact=new["ord"] != first)

    def close(self) -> None:
        pass


class _KeptLengths(StatefulProcessor):
    """Rows of one beginning, in order: those near a kept length are flagged, the others' lengths are kept."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True).sort_values("ord")
        kept, reasons = sorted(int(x[0]) for x in self.kept.get()), []
        for n, exact in zip(new["n"], new["exact"]):
            if exact:
                reasons.append("exact_raw_text")
            elif near_length(int(n), kept):
                reasons.append("same_company_quarter_similar_len_prefix")
            else:
                reasons.append("")
                if n not in kept:
                    bisect.insort(kept, int(n))
                    self.kept.appendValue((int(n),))
        yield pd.DataFrame({"ord": new["ord"].to_numpy(), "duplicate_reason": reasons})

    def close(self) -> None:
        pass


def flags(stream: DataFrame, order: str = "ord") -> DataFrame:
    """A stream of rows to a stream of (ord, duplicate_reason), one for each row, an empty reason for those that stay.

    What came in an earlier micro-batch is earlier; within one, the order column says, a long without ties or nulls.
    Where micro-batches follow that column the reasons are those of dedup.deduplicate over rows without titles. Rule 2
    compares titles with each other and is left to the batch plan.
    """
    told = narrow(stream, order).select(F.col("ord").cast("long").alias("ord"), "same_text", "same_start", F.col("n").cast("int").alias("n"))
    seen = told.groupBy("same_text").transformWithStateInPandas(_SeenTexts(), "ord long, same_start string, n int, exact boolean", "Append", "None")
    return seen.groupBy("same_start").transformWithStateInPandas(_KeptLengths(), "ord long, duplicate_reason string", "Append", "None")


def flag_new_rows(stream: DataFrame, out: str, checkpoint: str, order: str = "ord") -> int:
    """Flags all rows that are new since the last call with this checkpoint, adds them to the Parquet folder `out` and
    returns the number of micro-batches. The session's state store is RocksDB while the query runs."""
    spark = stream.sparkSession
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        return run_to_end(flags(stream, order), out, checkpoint)
    finally:
        spark.conf.set(_STORE, before) if before is not None else spark.conf.unset(_STORE)
