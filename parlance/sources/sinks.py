"""Sinks: tables with a fixed schema, partitioned JSON, CSV and text reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.schemas import conform
from parlance.sources.readers import read_if_there


def write_table(df: DataFrame, path: str, ddl: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """mode overwrite starts anew, append resumes; the committer makes either atomic for each job."""
    writer = conform(df, ddl).write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_new(df: DataFrame, path: str, keys: Sequence[str], ddl: str) -> None:
    """Appends the rows whose keys the table does not hold yet."""
    have = read_if_there(lambda: df.sparkSession.read.parquet(path))
    if have is not None:
        df = df.join(have.select(*keys).distinct(), list(keys), "left_anti")
    write_table(df, path, ddl, "append")


def write_dated_json(df: DataFrame, path: str, day: str, known_by: Sequence[str] = ()) -> None:
    """JSON by yyyy/mm/dd folders; rows whose known_by columns (an id, a hash) the folders hold already are skipped."""
    have = read_if_there(lambda: df.sparkSession.read.schema(df.schema).json(path)) if known_by else None
    if have is not None:
        df = df.join(have.select(*known_by).distinct(), list(known_by), "left_anti")
    d = F.col(day).cast("date")
    df.withColumns({"yyyy": F.date_format(d, "yyyy"), "mm": F.date_format(d, "MM"), "dd": F.date_format(d, "dd")}).write.mode("append").partitionBy("yyyy", "mm", "dd").json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True)


def bullets(df: DataFrame) -> list[str]:
    """A one-row frame of figures as Markdown lines."""
    row = df.first()
    show = lambda v: f"{v:,}" if isinstance(v, int) else f"{v:,.4f}" if isinstance(v, float) else str(v)
    return [f"- {k.replace('_', ' ')}: {show(v)}" for k, v in row.asDict().items()]
