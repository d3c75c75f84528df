"""A sentiment scorer that is learnt: multinomial regression over hashed words, fitted and applied where the rows are."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.operators.sentiment import LABELS, best_label, label_score

#: Slots that words are hashed to; the model has one weight a slot and label, so this bounds what goes to the driver.
SLOTS = 1 << 15
ROUNDS, PENALTY = 60, 1e-3


def sentiment_of(quality: Column, toxic: Column) -> Column:
    """The label that a rated document stands for: toxic ones are negative, good ones positive, others neutral."""
    return F.when(toxic == 1, "negative").when(quality == 1, "positive").when(quality.isNotNull(), "neutral")


def fit_scorer(rows: DataFrame, text: str = "chunk_text", label: str = "label", slots: int = SLOTS, rounds: int = ROUNDS) -> PipelineModel:
    """Learns from all rows whose label is one of LABELS; null texts count as empty. Gradients are summed in the executors,
    `slots` numbers for each label, and no row is left out or brought to the driver."""
    at = F.coalesce(*[F.when(F.col(label) == name, float(i)) for i, name in enumerate(LABELS)])
    told = rows.select(F.coalesce(text, F.lit("")).alias("_text"), at.alias("_label")).where("_label is not null")
    words = RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"\P{L}+", gaps=True)
    counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=slots)
    model = LogisticRegression(featuresCol="_counts", labelCol="_label", family="multinomial", maxIter=rounds, regParam=PENALTY)
    return Pipeline(stages=[words, counts, model]).fit(told)


def score_learnt(df: DataFrame, model: PipelineModel, text: str = "chunk_text") -> DataFrame:
    """df with prob_positive, prob_neutral, prob_negative, sentiment_label and sentiment_score, by a model of fit_scorer.

    A label that no training row had gets probability 0."""
    names = [f"prob_{x}" for x in LABELS]
    told = model.transform(df.withColumn("_text", F.coalesce(text, F.lit(""))))
    p = vector_to_array("probability")
    out = told.select(*[F.col(f"`{c}`") for c in df.columns], *[F.coalesce(F.get(p, F.lit(i)), F.lit(0.0)).alias(n) for i, n in enumerate(names)])
    return out.withColumn("sentiment_label", best_label(*[F.col(n) for n in names])).withColumn("sentiment_score", label_score(F.col("sentiment_label")))
