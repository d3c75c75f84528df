"""Fixed table schemas and the projection onto them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_META = "company string, ticker string, event_date string, year smallint, quarter tinyint, year_quarter string"
TRANSCRIPTS = f"transcript_id string, {_META}, title string, source_file string, clean_text string"
DUPLICATES = f"transcript_id string, {_META}, title string, is_duplicate boolean, duplicate_reason string"
SEGMENTS = f"transcript_id string, segment_id string, segment_order int, speaker_raw string, speaker_name string, speaker_type string, segment_text string, section string, {_META}"
CHUNKS = f"transcript_id string, segment_id string, chunk_id string, {_META}, speaker_name string, speaker_type string, section string, chunk_text string, n_tokens int"
SCORES = CHUNKS + ", sentiment_label string, sentiment_score double, prob_positive double, prob_neutral double, prob_negative double"
AGGREGATED = "transcript_id string, ticker string, event_date string, speaker_role string, mean_score double, median_score double, std_score double, n_chunks bigint"
PRICES = "ticker string, date date, adj_close double"
RETURNS = "transcript_id string, ticker string, event_date timestamp, ret_1d double, ret_3d double, ret_5d double, ret_10d double"
PANEL = (
    "transcript_id string, ticker string, company string, event_date timestamp, year int, quarter int, year_quarter string, source string, is_smallcap int, "
    "score_exec double, score_analyst double, divergence double, n_chunks_exec bigint, n_chunks_analyst bigint, ret_1d double, ret_3d double, ret_5d double, ret_10d double"
)
REGRESSION = "section string, model string, variable string, coef double, std_err double, t_stat double, p_value double, sig string, nobs int, r2 double, adj_r2 double"


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Exactly the schema's columns, in its order: missing ones are null, others go; what cannot be cast becomes null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in struct(ddl)])
