"""The plan from raw rows to transcripts, audit, segments and chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance import schemas
from parlance.functions import text
from parlance.operators.chunk import chunk
from parlance.operators.dedup import deduplicate, split_audit
from parlance.operators.metadata import extract_metadata
from parlance.operators.segment import label_sections, segment


@dataclass
class Tables:
    transcripts: DataFrame
    duplicates: DataFrame
    segments: DataFrame
    chunks: DataFrame


def preprocess(raw: DataFrame, company_map: DataFrame | None = None, most_tokens: int = 200) -> Tables:
    """raw: transcript_id, ord, raw_text and any raw fields. All four tables are lazy; the caller writes them."""
    d = raw.withColumn("clean_text", text.clean_text(F.col("raw_text")))
    flagged = deduplicate(extract_metadata(d, company_map))
    kept, audit = split_audit(flagged)
    meta = ["transcript_id", "company", "ticker", "event_date", "year", "quarter", "year_quarter"]
    turns = label_sections(segment(kept.select(*meta, "clean_text")))
    return Tables(schemas.conform(kept, schemas.TRANSCRIPTS), schemas.conform(audit, schemas.DUPLICATES), schemas.conform(turns, schemas.SEGMENTS), schemas.conform(chunk(turns, most_tokens), schemas.CHUNKS))


def check(t: Tables, most_tokens: int = 200) -> list[str]:
    """What is wrong with the tables: null keys, repeated ids, orphans, chunks over the limit that hold two words or more."""
    out = []
    for name, df, key in (("transcripts", t.transcripts, "transcript_id"), ("segments", t.segments, "segment_id"), ("chunks", t.chunks, "chunk_id")):
        n, keys, unknown = df.agg(F.count(F.lit(1)), F.count_distinct(key), F.count_if(F.col(key).isNull())).first()
        out += [f"{name}: {unknown} rows without {key}"] * (unknown > 0) + [f"{name}: {n - unknown - keys} repeated {key}"] * (n - unknown > keys)
    for name, df, parent, key in (("segments", t.segments, t.transcripts, "transcript_id"), ("chunks", t.chunks, t.segments, "segment_id")):
        if not df.join(parent, key, "left_anti").isEmpty():
            out.append(f"{name}: {key} unknown to the parent table")
    over = t.chunks.where((F.col("n_tokens") > most_tokens) & F.col("chunk_text").contains(" ")).count()
    return out + [f"chunks: {over} over {most_tokens} tokens"] * (over > 0)
