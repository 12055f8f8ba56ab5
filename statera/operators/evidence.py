"""Bayesian evidence of each feature's latest value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statera.functions.expressions import clip, col, number_of
from statera.operators.distribution import bin_of, quantile_edges

#: Names of likelihood ratios from above and from below, tested in this order. Fixed values.
RISES = ((10, "very strong increase"), (3, "strong increase"), (1.5, "moderate increase"), (1.1, "slight increase"))
FALLS = ((0.1, "very strong decrease"), (0.33, "strong decrease"), (0.66, "moderate decrease"), (0.9, "slight decrease"))


def strength(ratio: Column) -> Column:
    out = F.when(F.lit(False), "")
    for bound, name in RISES:
        out = out.when(ratio >= bound, name)
    for bound, name in FALLS:
        out = out.when(ratio <= bound, name)
    return out.otherwise("neutral")


def feature_edges(long: DataFrame, bins: int = 4) -> DataFrame:
    """(feature, edges): quantile edges of features with two or more distinct values, min(bins, distinct values) bins."""
    return quantile_edges(long, "value", bins, ["feature"], fewer=True).where(F.size("edges") > 1)


def binned(long: DataFrame, bins: int = 4) -> DataFrame:
    """Long rows (feature, order, value, label) with edges and bin; NULL values have no bin. One row of edges for each feature is joined."""
    return long.join(feature_edges(long, bins), "feature").withColumn("bin", bin_of(F.col("value"), F.col("edges")))


def bin_event_rates(long: DataFrame, bins: int = 4) -> DataFrame:
    """(feature, bin, events, rows) of quantile bins; a missing label is 0, labels are cut to integers."""
    rows = binned(long, bins).where("bin is not null")
    return rows.groupBy("feature", "bin").agg(F.sum(F.coalesce(F.col("label"), F.lit(0)).cast("int")).cast("long").alias("events"), F.count("*").alias("rows"))


def latest_bin(long: DataFrame, bins: int = 4) -> DataFrame:
    """(feature, bin) of the last row by order that has a value."""
    return binned(long, bins).where("bin is not null").groupBy("feature").agg(F.max_by("bin", "order").alias("bin"))


def to_long(dataset: DataFrame, features: list[str], order: str, label: str) -> DataFrame:
    """(feature, order, label, value) rows of wide features."""
    rows = dataset.select(col(order).alias("order"), col(label).alias("label"), *(number_of(dataset, f).alias(f) for f in features))
    return rows.unpivot(["order", "label"], features, "feature", "value")


def bayesian_evidence(long: DataFrame, prior: float = 0.05, smoothing: float = 1.0, bins: int = 4) -> DataFrame:
    """feature, bucket, posterior, likelihood_ratio, evidence_strength, samples for each feature with two or more values, highest posterior first."""
    if not 0 < prior < 1 or bins < 2:
        raise ValueError("the prior must lie between 0 and 1, and two bins are needed")
    rows = binned(long, bins).where("bin is not null")
    rates = rows.groupBy("feature", "bin").agg(F.sum(F.coalesce(F.col("label"), F.lit(0)).cast("int")).alias("events"), F.count("*").alias("samples"), F.first("edges").alias("edges"), F.max("order").alias("last"))
    # the bin that holds the last order value of all is the latest one
    at = rates.groupBy("feature").agg(F.max_by(F.struct("bin", "events", "samples", "edges"), "last").alias("r")).select("feature", "r.*")
    posterior = clip((F.col("events") + smoothing * prior) / (F.col("samples") + smoothing), 1e-6, 1 - 1e-6)
    out = at.withColumn("posterior", posterior)
    out = out.withColumn("likelihood_ratio", F.col("posterior") / (1 - F.col("posterior")) / F.lit(prior / (1 - prior)))
    number = lambda i: F.format_string("%.2f", F.get("edges", F.least(i, F.size("edges") - 1)))
    bucket = F.concat(F.lit("["), number(F.col("bin")), F.lit(", "), number(F.col("bin") + 1), F.lit(")"))
    return out.select("feature", bucket.alias("bucket"), "posterior", "likelihood_ratio", strength(F.col("likelihood_ratio")).alias("evidence_strength"), "samples").orderBy(F.desc("posterior"), "feature")
