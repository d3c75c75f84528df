"""Sentiment of chunks and its aggregates by transcript and role."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = ("positive", "neutral", "negative")
ROLES = {"Executive": "exec", "Analyst": "analyst"}

# A small word list for the scorer that needs no model.
GOOD = frozenset("strong growth improve improved record exceed exceeded gain gains positive confident pleased momentum robust solid success profitable increase increased opportunity".split())
BAD = frozenset("weak decline declined loss losses miss missed negative risk risks challenge challenges headwind headwinds decrease decreased pressure difficult uncertain impairment lower".split())


def lexicon_logits(texts: Sequence[str]) -> np.ndarray:
    """Rows (positive, neutral, negative); a stand-in with the shape of a classifier."""
    out = np.zeros((len(texts), 3))
    for i, t in enumerate(texts):
        words = (t or "").lower().split()
        out[i] = sum(w.strip(".,;:!?") in GOOD for w in words), 1.0, sum(w.strip(".,;:!?") in BAD for w in words)
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def score_chunks(df: DataFrame, load: Callable[[], Callable[[Sequence[str]], np.ndarray]] = lambda: lexicon_logits, labels: Sequence[str] = LABELS, words: int | None = None) -> DataFrame:
    """Adds sentiment_label, sentiment_score (1, 0, -1) and the three probabilities.

    load gives a function from texts to logits and is called once for each task; labels says what its columns mean;
    words cuts each text off as a model with a bounded input would.
    """
    at = [list(labels).index(x) for x in LABELS]

    @F.pandas_udf("struct<prob_positive:double,prob_neutral:double,prob_negative:double>")
    def probabilities(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for texts in batches:
            clean = [" ".join((t or "").split()[:words]) for t in texts]
            p = softmax(np.asarray(model(clean), float))[:, at]
            yield pd.DataFrame(p, columns=["prob_positive", "prob_neutral", "prob_negative"])

    scored = df.withColumn("_p", probabilities("chunk_text")).select(*df.columns, "_p.*")
    return scored.withColumn("sentiment_label", best_label(F.col("prob_positive"), F.col("prob_neutral"), F.col("prob_negative"))).withColumn("sentiment_score", label_score(F.col("sentiment_label")))


def best_label(positive: Column, neutral: Column, negative: Column) -> Column:
    """The label with the greatest probability, the first of equals."""
    top = F.greatest(positive, neutral, negative)
    return F.when(positive == top, "positive").when(neutral == top, "neutral").when(negative == top, "negative")


def label_score(label: Column) -> Column:
    return F.when(label == "positive", 1.0).when(label == "negative", -1.0).when(label.isNotNull(), 0.0)


def role_of(speaker_type: Column) -> Column:
    out = F.lit("other")
    for kind, role in ROLES.items():
        out = F.when(speaker_type == kind, role).otherwise(out)
    return out


def by_role(df: DataFrame, keys: Sequence[str] = ("transcript_id", "ticker", "event_date", "speaker_role"), score: str = "sentiment_score") -> DataFrame:
    """mean, median, standard deviation and number of scores of each key; rows with a null in a key are left out."""
    return df.na.drop(subset=list(keys)).groupBy(*keys).agg(F.avg(score).alias("mean_score"), F.median(score).alias("median_score"), F.stddev_samp(score).alias("std_score"), F.count(score).alias("n_chunks"))


def quality(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """accuracy and macro_f1 over the labels that occur on either side, from one table of counts."""
    counts = df.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    each = counts.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0).alias("hit"), F.col("n").alias("is"), F.lit(0).cast("long").alias("said")), F.struct(F.col("g").alias("label"), F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("is"), F.col("n").alias("said")))).alias("x")).select("x.*")
    f1 = each.groupBy("label").agg(F.sum("hit").alias("hit"), F.sum("is").alias("is"), F.sum("said").alias("said"))
    return f1.agg((F.sum("hit") / F.sum("is")).alias("accuracy"), F.avg(2 * F.col("hit") / (F.col("is") + F.col("said"))).alias("macro_f1"))
