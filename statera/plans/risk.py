"""Feature store and risk pipeline, composed from the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statera.functions.expressions import first_present
from statera.operators.clean import build_silver
from statera.operators.evaluate import build_evidence, ensemble
from statera.operators.ml import ModelConfig, has_model, load_model, predict, save_model, train_gbt, training_set
from statera.operators.timeseries import combine_features, country_series, daily_counts, economic_feature, rolling_mean, rolling_sum
from statera.sources.sinks import write_evidence, write_outcomes, write_predictions
from statera.sources.storage import materialise

#: Columns that a humanitarian table's value is taken from, the first that it has. Fixed values.
VALUE_COLUMNS = ("displaced_population", "access_constraint_score", "value", "count", "indicator")


@dataclass
class FeatureConfig:
    """A feature: its name, whose first part says its kind, the table it is made of, and its window in days."""

    name: str
    table: str
    window_days: int = 7


#: Features and models that the pipeline makes by default. Fixed values.
FEATURES = (
    FeatureConfig("events_coup_attempts", "events", 7),
    FeatureConfig("events_violence_against_civilians", "conflict", 7),
    FeatureConfig("economic_pressure", "economic", 14),
    FeatureConfig("humanitarian_displacement_pressure", "displacement", 14),
    FeatureConfig("humanitarian_operational_constraints", "access", 7),
)
MODELS = (ModelConfig("coup risk", trees=100, step=0.05, depth=3), ModelConfig("violence escalation", trees=120, step=0.04, depth=3))


def feature(df: DataFrame, config: FeatureConfig) -> DataFrame:
    """(date, entity, value) of one feature: events_ counts, economic_ means over days, humanitarian_ means over rows."""
    kind = config.name.partition("_")[0]
    when = first_present(df, "date", "event_date") if kind != "events" else first_present(df, "event_date", "date")
    if kind not in ("events", "economic", "humanitarian"):
        raise ValueError(f"unknown kind of feature: {config.name}")
    if when is None:
        raise ValueError(f"{config.table} has no date column")
    if kind == "events":
        return rolling_sum(daily_counts(df, when), config.window_days)
    if kind == "economic":
        return economic_feature(df, config.window_days, when)
    value = first_present(df, *VALUE_COLUMNS)
    if value is None:
        raise ValueError(f"{config.table} has none of the columns {VALUE_COLUMNS}")
    return rolling_mean(country_series(df, value, when), config.window_days)


def build_feature_store(tables: Mapping[str, DataFrame], configs: Sequence[FeatureConfig] = FEATURES) -> DataFrame:
    """(feature, date, entity, value) of all features, named <kind>__<name>."""
    missing = sorted({c.table for c in configs} - tables.keys())
    if missing:
        raise ValueError(f"missing tables: {missing}")
    groups: dict[str, dict[str, DataFrame]] = {}
    for c in configs:
        groups.setdefault(c.name.partition("_")[0], {})[c.name] = feature(tables[c.table], c)
    return combine_features(groups)


def risk_pipeline(tables: Mapping[str, DataFrame], target: DataFrame, out: str, features: Sequence[FeatureConfig] = FEATURES, models: Sequence[ModelConfig] = MODELS, model_root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Silver tables, features, models (kept ones are loaded), predictions and evidence; both are written below ``out`` and returned. The target's last outcomes are written beside them.

    ``target``: (date, entity, label).
    """
    silver = {name: build_silver(df, ordered=False) for name, df in tables.items()}
    names = [f"{c.name.partition('_')[0]}__{c.name}" for c in features]
    data = materialise(training_set(build_feature_store(silver, features), names, target), "training")
    trained = []
    for config in models:
        if model_root and has_model(model_root, config):
            trained.append(load_model(model_root, config))
            continue
        trained.append(train_gbt(data, config, names))
        if model_root and trained[-1].members:
            save_model(trained[-1], model_root)
    predictions = ensemble(predict(trained, data), ["date", "entity"]).withColumnRenamed("entity", "country")
    write_predictions(predictions, f"{out}/predictions")
    predictions = predictions.sparkSession.read.parquet(f"{out}/predictions").select("date", F.col("country").cast("string").alias("country"), "probability")
    evidence = build_evidence(predictions)
    write_evidence(evidence, f"{out}/evidence")
    write_outcomes(target, f"{out}/outcomes")
    return predictions, evidence
