"""Quality of probabilities, their ensemble, and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statera.functions.expressions import clip, col


def align_target(dataset: DataFrame, target: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """``dataset`` with its label by key, 0 where there is none."""
    return dataset.join(target.select(*keys, col(label).alias("label")), keys, "left").withColumn("label", F.coalesce("label", F.lit(0)))


def _truth(outcome: str) -> Column:
    return F.coalesce(col(outcome), F.lit(0))


def _brier(p: str, y: str) -> Column:
    return F.avg(F.pow(col(p) - _truth(y), F.lit(2)))


def _rates(p: str, y: str, threshold: float) -> list[Column]:
    said, true = F.coalesce(col(p) >= threshold, F.lit(False)), _truth(y) == 1
    hit, claimed, actual = F.count_if(said & true), F.count_if(said), F.count_if(true)
    share = lambda a, b, name: F.when(b > 0, a / b).otherwise(0.0).alias(name)
    return [share(hit, claimed, "precision"), share(hit, actual, "recall")]


def brier(df: DataFrame, p: str = "probability", y: str = "outcome") -> DataFrame:
    """Mean squared error of probabilities; a missing outcome is 0, a NULL probability is left out."""
    return df.agg(_brier(p, y).alias("brier"))


def precision_recall(df: DataFrame, threshold: float = 0.5, p: str = "probability", y: str = "outcome") -> DataFrame:
    """precision and recall at a threshold (inclusive), 0 where undefined; a NULL probability predicts nothing."""
    return df.agg(*_rates(p, y, threshold))


def summary_table(df: DataFrame, threshold: float = 0.5, model: str = "model", p: str = "probability", y: str = "outcome") -> DataFrame:
    """brier, precision and recall for each model."""
    return df.groupBy(model).agg(_brier(p, y).alias("brier"), *_rates(p, y, threshold))


def ensemble(df: DataFrame, keys: list[str], model: str = "model", p: str = "probability") -> DataFrame:
    """Mean over the models for each key; NULL where a model has no value."""
    models = df.agg(F.countDistinct(model).alias("__models"))
    rows = df.groupBy(*keys).agg(F.count(p).alias("__n"), F.avg(p).alias("__p")).join(F.broadcast(models))
    return rows.select(*keys, F.when(F.col("__n") == F.col("__models"), F.col("__p")).alias("probability"))


def build_evidence(df: DataFrame, entity: str = "country", date: str = "date", p: str = "probability") -> DataFrame:
    """country, signal_strength, posterior_odds, updated: the latest value against that of six rows before (with seven rows or fewer: the first)."""
    by_date = W.partitionBy(entity).orderBy(col(date).desc())
    seven = df.withColumn("__n", F.row_number().over(by_date)).where("__n <= 7")  # Spark keeps seven rows of an entity before it deals them out
    rows = seven.groupBy(entity).agg(F.min_by(col(p), "__n").alias("last"), F.max_by(col(p), "__n").alias("reference"), F.max(date).alias("updated"))
    signal = clip(F.abs(F.col("last") - F.col("reference")) * 4, 0.05, 0.95)
    odds = F.col("last") / F.greatest(F.lit(1e-3), 1 - F.col("last"))
    return rows.select(entity, F.bround(signal, 2).alias("signal_strength"), F.bround(odds, 2).alias("posterior_odds"), F.date_format("updated", "yyyy-MM-dd").alias("updated"))


def top_alerts(df: DataFrame, k: int = 2, min_p: float = 0.6, entity: str = "country", date: str = "date", p: str = "probability") -> DataFrame:
    """entity, probability, alert: 1 for the ``k`` highest latest probabilities if also above ``min_p``, else 0."""
    last = df.groupBy(entity).agg(F.max_by(p, date).alias("probability"))
    # top k without a window over all: the k-th place is found by a sort with a limit
    top = last.where("probability is not null").orderBy(F.desc("probability"), entity).limit(k).select(F.col(entity).alias("__e"))
    flagged = last.join(F.broadcast(top), col(entity) == F.col("__e"), "left")
    return flagged.select(entity, "probability", F.coalesce(F.col("__e").isNotNull() & (F.col("probability") > min_p), F.lit(False)).cast("int").alias("alert"))
