"""Sources: JSON lines, Parquet, CSV and text folders, as one lazy frame each."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions.text import short_id
from parlance.session import shared_folder

# What the canonical columns are called in raw files, in order of preference.
NAMES = {
    "company": ("company", "company_name", "transcript_subheader"),
    "title": ("title",),
    "raw_text": ("transcript_text", "raw_text", "transcript", "text", "content", "body"),
    "date": ("derived_event_date", "datetime", "date", "event_date", "subheader"),
    "ticker": ("ticker", "symbol"),
}
#: A text column that no name gives away has this mean length at least.
LEAST_MEAN = 80
#: Splits of files whose counts are broadcast to the second scan of numbered_lines, about 200 bytes each.
MOST_SPLITS = 200_000


def column_name(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def detect(path: str) -> str:
    """parquet or jsonl, by the path alone."""
    end = path.rstrip("/").lower()
    return "jsonl" if re.search(r"\.(jsonl|json|ndjson)(\.gz)?$", end) else "parquet"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None, numbered: bool = False) -> tuple[DataFrame, DataFrame]:
    """(objects, bad lines): blank lines are skipped; lines that are no JSON object are bad. With a schema, one scan;
    numbered adds line_no, see numbered_lines."""
    own = ["source_file", "line_no"] if numbered else ["source_file"]
    lines = numbered_lines(spark, path) if numbered else spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("source_file"))
    lines = lines.where(F.trim("line") != "")
    is_object = _is_object(F.col("line"))
    good = lines.where(is_object)
    if schema is None:
        schema = _inferred(spark, path)
    return good.select(F.from_json("line", schema).alias("row"), *own).select("row.*", *own), lines.where(~F.coalesce(is_object, F.lit(False)))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines of text files, blank ones included: line, source_file, line_no (from 1 in each file).

    No line is sorted or moved: one scan counts the lines of each split, a prefix sum over the splits of a file says how
    many lines lie before each, and a second scan numbers its own lines from there. Within a split a line's place is
    Spark's running id less that of the split's first line. Both scans must cut the files alike, which they do unless the
    settings change in between; each split is looked up by task, start and length and its first line is compared, and
    where the two scans differ the job fails rather than giving other numbers.
    """
    at = ["source_file", "start", "length", "task"]
    lines = spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_block_length").alias("length"), F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("id"),
    )
    folder = shared_folder(spark, "splits")
    lines.groupBy(*at).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.min_by(F.xxhash64("line"), "id").alias("head")).write.parquet(folder)
    splits = spark.read.parquet(folder)
    earlier = Window.partitionBy("source_file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(*at, "first", "head", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    if splits.count() <= MOST_SPLITS:
        splits = F.broadcast(splits)
    met = lines.join(splits, at, "left")
    astray = F.col("first").isNull() | ((F.col("id") == F.col("first")) & (F.xxhash64("line") != F.col("head")))
    number = F.when(astray, F.raise_error(F.concat(F.lit("the splits of a file have changed between two scans: "), "source_file")).cast("long")).otherwise(F.col("before") + F.col("id") - F.col("first") + 1)
    return met.select("line", "source_file", number.alias("line_no"))


def rows_by_file(spark: SparkSession, path: str) -> DataFrame:
    """source_file and n_rows of Parquet files, out of what their footers say: no column is read. Files without rows are left out."""
    return spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("source_file")).agg(F.count(F.lit(1)).alias("n_rows"))


def first_rows(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first n rows of Parquet files, in order of file name and row, without reading more than they need.

    Footers say which files these rows are in; only those are opened, and of the last one no row group behind the last
    row is decoded. Unlike a limit, this does not bring all rows through one task.
    """
    names = Window.orderBy("source_file").rowsBetween(Window.unboundedPreceding, -1)
    files = rows_by_file(spark, path).withColumn("before", F.coalesce(F.sum("n_rows").over(names), F.lit(0)))  # one row a file
    wanted = files.where(F.col("before") < n).collect()
    df = read_parquet(spark, path)
    if not wanted or n <= 0:
        return df.where(F.lit(False))
    whole = [r.source_file for r in wanted if r.before + r.n_rows <= n]
    cut = [(r.source_file, n - r.before) for r in wanted if r.before + r.n_rows > n]
    chosen = spark.read.parquet(*[r.source_file for r in wanted]).select("*", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.row_index").alias("row_index"))
    keep = F.col("source_file").isin(whole)
    for name, rows in cut:
        keep |= (F.col("source_file") == name) & (F.col("row_index") < rows)
    return chosen.where(keep)


def folder_report(spark: SparkSession, path: str, kind: str, schema: str | None = None) -> DataFrame:
    """For each file below a folder: source_file, bytes, n_rows, n_failed (records that could not be read) and unreadable.

    kind: jsonl, csv (with a header and a schema) or parquet (with a schema, unless the first file is known to be sound). A Parquet file whose footer or pages are damaged is
    unreadable, and so is any file that holds bytes but neither a row nor a failed record. Files of no bytes are left out.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    files = reader.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("source_file"), F.col("length").alias("bytes"))
    if kind == "jsonl":
        lines = reader.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("source_file")).where(F.trim("line") != "")
        read = lines.select("source_file", F.coalesce(_is_object(F.col("line")), F.lit(False)).alias("good"))
    elif kind == "csv":
        bad = "_corrupt_record"
        rows = reader.csv(path, header=True, schema=f"{schema}, {bad} string", mode="PERMISSIVE", columnNameOfCorruptRecord=bad)
        # With the other columns, since Spark reads no file for the column of bad records alone.
        read = rows.select(F.col("_metadata.file_path").alias("source_file"), (F.col(bad).isNull() & _read([c for c in rows.columns if c != bad])).alias("good"))
    else:
        reader = reader.option("ignoreCorruptFiles", "true")
        whole = (reader.schema(schema) if schema else reader).parquet(path)
        # All columns are read, else damaged pages would pass unseen.
        read = whole.select(F.col("_metadata.file_path").alias("source_file"), _read(whole.columns).alias("good"))
    counts = read.groupBy("source_file").agg(F.count_if("good").alias("n_rows"), F.count_if(~F.col("good")).alias("n_failed"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = files.join(counts, "source_file", "left").select("source_file", "bytes", zero("n_rows"), zero("n_failed"))
    return out.withColumn("unreadable", (F.col("bytes") > 0) & (F.col("n_rows") + F.col("n_failed") == 0))


def _read(columns: Sequence[str]) -> Column:
    """True, for which all columns have to be read: no hash is below the least long, which the optimiser does not know."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in columns]) >= F.lit(-(1 << 63))


def _is_object(line: Column) -> Column:
    return F.get_json_object(line, "$").isNotNull() & F.trim(line).startswith("{")


def _inferred(spark: SparkSession, path: str) -> T.StructType:
    found = spark.read.option("mode", "DROPMALFORMED").json(path).schema
    return T.StructType([f for f in found if f.name != "_corrupt_record"])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select("*", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.row_index").alias("row_index"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A CSV file with a header; None if there is nothing to read."""
    return read_if_there(lambda: spark.read.csv(path, header=True, schema=schema))


def read_if_there(read: Callable[[], DataFrame]) -> DataFrame | None:
    """What read() gives, or None if its path does not exist or holds no file; all other errors are raised."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # the latter: a folder without files
            raise
        return None


def newest(spark: SparkSession, folder: str, pattern: str = "*") -> str | None:
    """The path below a folder that was changed last (the first by name of equals), CSV before Parquet; None without one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    ranked = [(not f.getPath().getName().endswith(".csv"), -f.getModificationTime(), f.getPath().toString()) for f in found]
    ranked = [x for x in ranked if x[2].endswith((".csv", ".parquet", ".jsonl", ".json"))]
    return min(ranked)[2] if ranked else None


def head_of_each_file(df: DataFrame, rows: int) -> DataFrame:
    """The first rows of each file of a frame from read_parquet; later row groups are never decoded, since the row index
    is a filter of the scan."""
    return df.where(F.col("row_index") < rows)


def read_folder(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """All files of one kind (csv, json, text, parquet) below a folder; files that cannot be read are skipped."""
    reader = spark.read.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true")
    if kind == "text":
        return reader.text(path, wholetext=True).withColumnRenamed("value", "text").withColumn("source_file", F.input_file_name())
    if kind == "json":
        return reader.option("multiLine", "true").json(path)
    return reader.option("header", "true").csv(path) if kind == "csv" else reader.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return read_parquet(spark, path) if detect(path) == "parquet" else read_jsonl(spark, path)[0]


def canonical(df: DataFrame) -> DataFrame:
    """df with normalised names and the canonical columns: the first candidate that exists, else null; a text column
    without a known name is the string column with the greatest mean length, if that is LEAST_MEAN or more (one scan)."""
    d = df.toDF(*[column_name(c) for c in df.columns])
    for name, candidates in NAMES.items():
        if name in d.columns:
            continue
        found = next((c for c in candidates if c in d.columns), None)
        if found is None and name == "raw_text":
            found = _longest(d)
        d = d.withColumn(name, F.col(found) if found else F.lit(None).cast("string"))
    return d


def _longest(d: DataFrame) -> str | None:
    texts = [f.name for f in d.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return None
    means = d.agg(*[F.avg(F.length(c)).alias(c) for c in texts]).first()
    best = max(texts, key=lambda c: means[c] or 0)
    return best if (means[best] or 0) >= LEAST_MEAN else None


def row_id(source: Column, raw: Column, index: Column) -> Column:
    """The stable id of a raw row."""
    return short_id(source, raw, index)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
