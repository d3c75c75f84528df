"""The run from raw rows to chunks that reports on itself: sixteen figures, counted while the stages are written.

Each stage is one write; what the report needs of it is observed on the way to the files, so no table is read again for
it. What concerns whole transcripts is told by the first turn and the first chunk of each, and by a window over turns
that the sections need anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from parlance import schemas
from parlance.functions import text
from parlance.operators.chunk import chunk, token_counts
from parlance.operators.dedup import deduplicate, split_audit
from parlance.operators.metadata import extract_metadata
from parlance.operators.segment import label_sections, segment

SECTIONS = ("A", "O", "Prepared", "Q")
# The bins of chunk lengths, each up to its number, the last one open.
BINS = (25, 50, 100, 150, 200, 400)
SHORT = 5


def _bin_names() -> list[str]:
    ends = [0, *BINS, "inf"]
    return [f"{'[' if not i else '('}{a}, {b}]" for i, (a, b) in enumerate(zip(ends, ends[1:]))]


def _in_bins(c: Column) -> list[Column]:
    ends = [None, *BINS, None]
    tests = [(F.lit(True) if a is None else c > a) & (F.lit(True) if b is None else c <= b) for a, b in zip(ends, ends[1:])]
    return [F.count_if(t).alias(f"bin{i}") for i, t in enumerate(tests)]


def _written(df: DataFrame, folder: str, *metrics: Column) -> tuple[DataFrame, dict]:
    """The frame as a table, and what was observed while it was written."""
    seen = Observation()
    df.observe(seen, *metrics).write.parquet(folder)
    return df.sparkSession.read.parquet(folder), seen.get


def run_and_validate(raw: DataFrame, folder: str, company_map: DataFrame | None = None, most_tokens: int = 200, counts=token_counts, files_seen: int = 1, files_failed: int = 0, clean=text.clean_text) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, report): transcripts, duplicates, segments and chunks below `folder`, and one row of sixteen figures.

    raw: transcript_id, ord, raw_text and any raw fields; counts of files come from readers.folder_report.
    clean: what makes clean_text of the column raw_text. Rates are rounded to four digits and 0 where there is nothing to
    divide by; the two distributions are JSON texts.
    """
    length = lambda c: F.sum(F.length(F.coalesce(c, F.lit(""))).cast("long"))
    d = extract_metadata(raw.withColumn("clean_text", clean(F.col("raw_text"))), company_map)
    known = F.col("company").isNotNull() & F.col("event_date").isNotNull() & F.col("year_quarter").isNotNull()
    stays = ~F.col("is_duplicate")
    flagged, one = _written(
        deduplicate(d), f"{folder}/flagged", F.count(F.lit(1)).alias("records"), length("raw_text").alias("raw"), length("clean_text").alias("cleaned"), F.count_if(~stays).alias("duplicates"), F.count_if(stays & known).alias("known"),
    )
    kept, audit = split_audit(flagged)
    meta = ["transcript_id", "company", "ticker", "event_date", "year", "quarter", "year_quarter"]
    whole = Window.partitionBy("transcript_id")
    turns = label_sections(segment(kept.select(*meta, "clean_text")))
    turns = turns.withColumn("_both", F.max((F.col("section") == "Q").cast("int")).over(whole) + F.max((F.col("section") == "A").cast("int")).over(whole) == 2)
    first = F.col("segment_order") == 1
    segments, two = _written(
        turns, f"{folder}/segments", length("segment_text").alias("said"), F.count_if(first).alias("with_turns"), F.count_if(first & F.col("_both")).alias("with_both"), *[F.count_if(F.col("section") == s).alias(s) for s in SECTIONS],
    )
    n = F.col("n_tokens")
    chunks, three = _written(chunk(segments.drop("_both"), most_tokens, counts), f"{folder}/chunks", F.count_if(first & F.endswith("chunk_id", F.lit("_s1_c1"))).alias("with_chunks"), F.count_if(n < SHORT).alias("short"), F.count_if(n > most_tokens).alias("over"), *_in_bins(n))
    number = lambda seen, name: int(seen.get(name) or 0)
    share = lambda a, b: round(a / b, 4) if b else 0.0
    records, n_kept = number(one, "records"), number(one, "records") - number(one, "duplicates")
    as_json = lambda pairs: "{" + ", ".join(f'"{k}": {v}' for k, v in pairs) + "}"
    report = {
        "transcript_parse_success_rate": share(files_seen - files_failed, files_seen), "metadata_extraction_success_rate": share(number(one, "known"), n_kept), "duplicate_count": number(one, "duplicates"),
        "cleaning_text_drop_rate": share(number(one, "raw") - number(one, "cleaned"), number(one, "raw")), "segmentation_text_drop_rate": share(number(one, "cleaned") - number(two, "said"), number(one, "cleaned")),
        "share_transcripts_with_detected_qa": share(number(two, "with_both"), number(two, "with_turns")), "section_distribution": as_json((s, number(two, s)) for s in SECTIONS),
        "chunk_token_distribution": as_json((b, number(three, f"bin{i}")) for i, b in enumerate(_bin_names())), "max_token_limit": most_tokens, "max_token_limit_violations": number(three, "over"), "suspiciously_short_chunks": number(three, "short"),
        "transcripts_with_zero_segments": n_kept - number(two, "with_turns"), "transcripts_with_zero_chunks": n_kept - number(three, "with_chunks"), "records_loaded": records, "files_seen": files_seen, "files_failed": files_failed,
    }
    kinds = {str: "string", int: "long", float: "double"}
    tables = {"transcripts": schemas.conform(kept, schemas.TRANSCRIPTS), "duplicates": schemas.conform(audit, schemas.DUPLICATES), "segments": schemas.conform(segments, schemas.SEGMENTS), "chunks": schemas.conform(chunks, schemas.CHUNKS)}
    return tables, raw.sparkSession.createDataFrame([tuple(report.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in report.items()))


def speaker_rankings(segments: DataFrame, top: int = 25, names: int = 50) -> DataFrame:
    """ranking, name, n: executives by turns and by transcripts, analysts by questions and by transcripts (`top` of each),
    and the most frequent raw and normalised names (`names` of each, null being empty). Ties break by name.

    segments: transcript_id, speaker_raw, speaker_name, speaker_type, section. A ranking's length is its feature.
    """
    asked = (F.col("speaker_type") == "Analyst") & (F.col("section") == "Q")
    lists = [("executives by segments", F.col("speaker_type") == "Executive", "speaker_name", False, top), ("executives by calls", F.col("speaker_type") == "Executive", "speaker_name", True, top), ("analysts by questions", asked, "speaker_name", False, top), ("analysts by calls", asked, "speaker_name", True, top), ("raw names", None, "speaker_raw", False, names), ("names", None, "speaker_name", False, names)]
    out = None
    for ranking, where, name, calls, most in lists:
        own = segments.withColumn("name", F.col(name))
        own = own.where(where & F.col("name").isNotNull()) if where is not None else own.withColumn("name", F.coalesce("name", F.lit("")))
        n = F.count_distinct("transcript_id") if calls else F.count(F.lit(1))
        best = own.groupBy("name").agg(n.alias("n")).orderBy(F.desc("n"), "name").limit(most).select(F.lit(ranking).alias("ranking"), "name", "n")
        out = best if out is None else out.unionByName(best)
    return out
