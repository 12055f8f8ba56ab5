"""Risk models on feature tables: alignment, training, calibration, prediction, backtest, persistence."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial, reduce
from multiprocessing.pool import ThreadPool
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statera.functions.expressions import slug
from statera.functions.ranking import rank_in_group
from statera.operators.evaluate import align_target, summary_table
from statera.operators.timeseries import expanding_splits, forward_fill
from statera.sources.storage import listed, materialise, publish, remove

T = TypeVar("T")

#: Rows of a training table for each task of a fit.
TASK_ROWS = 1 << 16


@dataclass
class ModelConfig:
    """A model's name, its features (none: all), horizon and size."""

    name: str
    features: tuple[str, ...] = ()
    horizon_days: int = 30
    trees: int = 100
    step: float = 0.05
    depth: int = 3
    hidden: tuple[int, ...] = (64, 32)
    iterations: int = 200
    seed: int = 42


@dataclass
class TrainedModel:
    """A fitted pipeline, the calibrators of its folds (none: as it is) and what the fit left."""

    config: ModelConfig
    features: list[str]
    members: list[tuple[Model, IsotonicRegressionModel | None]]
    history: dict = field(default_factory=dict)


def align_features(store: DataFrame, names: Sequence[str]) -> DataFrame:
    """Long (feature, date, entity, value) to one row for each (date, entity) with a column for each name.

    One grouping with the names given, so the schema doesn't depend on data; values are carried forward for each entity, the
    rest is 0.
    """
    wide = store.groupBy("date", "entity").pivot("feature", list(names)).agg(F.first("value"))
    return forward_fill(wide, keys=("entity",), values=tuple(names))


def training_set(store: DataFrame, names: Sequence[str], target: DataFrame) -> DataFrame:
    """Aligned features with a 0/1 label from ``target`` (date, entity, label)."""
    return align_target(align_features(store, names), target, ["date", "entity"]).withColumn("label", F.col("label").cast("double"))


def _chosen(config: ModelConfig, names: Sequence[str]) -> list[str]:
    return [n for n in names if not config.features or n in config.features]


def _assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")


def _together(jobs: Sequence[Callable[[], T]], at_once: int) -> list[T]:
    """Results of ``jobs`` in their order. Up to ``at_once`` run at a time: each is a row of small Spark jobs that would leave most of a cluster idle."""
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPool(max(1, min(at_once, len(jobs)))) as pool:
        return [found.get() for found in [pool.apply_async(inherit(job)) for job in jobs]]


def _by_rows(data: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of ``data``, written in as many parts as they need tasks. A fit runs several jobs for each tree, and each job a task for each part, full or empty."""
    return materialise(data.repartition(-(-n // TASK_ROWS), "date", "entity"), "fit")


def _fits(ranked: DataFrame, counts: Mapping[float, int], config: ModelConfig, features: list[str], folds: int) -> list[Callable[[], tuple[Model, IsotonicRegressionModel | None]]]:
    """The members of one model, each still to be fitted, on rows with their ``__rank`` within their class; none where there is one class only."""
    if len(counts) < 2:
        return []
    trees = Pipeline(stages=[_assembler(features), GBTClassifier(maxIter=config.trees, stepSize=config.step, maxDepth=config.depth, seed=config.seed)])
    if min(counts.values()) < folds:
        return [lambda: (trees.fit(ranked), None)]
    n = reduce(lambda c, label: c.when(F.col("label") == label, counts[label]), counts, F)
    split = ranked.withColumn("__fold", F.floor((F.col("__rank") - 1) * folds / n).cast("int"))

    def fit(k: int) -> tuple[Model, IsotonicRegressionModel]:
        model = trees.fit(split.where(F.col("__fold") != k))
        held = model.transform(split.where(F.col("__fold") == k)).select("label", vector_to_array("probability")[1].alias("p"))
        return model, IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="calibrated").fit(held)

    return [partial(fit, k) for k in range(folds)]


def _constant(counts: Mapping[float, int]) -> dict:
    """What a model without members predicts: the one class that its rows have."""
    return {"constant": float(next(iter(counts), 0.0))} if len(counts) < 2 else {}


def train_gbt(data: DataFrame, config: ModelConfig, names: Sequence[str], folds: int = 3, at_once: int = 3) -> TrainedModel:
    """Gradient-boosted trees, calibrated by isotonic regression on contiguous folds of each class.

    For each fold trees are fitted on the others and calibrated on it; predictions are the mean of the folds, of which ``at_once`` are fitted at a
    time. With fewer rows of a class than folds there is one model and no calibration; with one class its constant. Order is (date, entity).
    """
    features = _chosen(config, names)
    counts = {r["label"]: r["n"] for r in data.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return TrainedModel(config, features, [], _constant(counts))
    ranked = _by_rows(rank_in_group(data, ["label"], [F.col("date"), F.col("entity")], "__rank"), sum(counts.values()))
    return TrainedModel(config, features, _together(_fits(ranked, counts, config, features, folds), at_once))


def train_mlp(data: DataFrame, config: ModelConfig, names: Sequence[str]) -> TrainedModel:
    """Standardised features into a multilayer perceptron; history has the loss curve, iterations and training accuracy."""
    features = _chosen(config, names)
    net = MultilayerPerceptronClassifier(layers=[len(features), *config.hidden, 2], featuresCol="scaled", maxIter=config.iterations, seed=config.seed)
    model = Pipeline(stages=[_assembler(features), StandardScaler(inputCol="features", outputCol="scaled", withMean=True), net]).fit(data)
    summary = model.stages[-1].summary()
    accuracy = MulticlassClassificationEvaluator(metricName="accuracy").evaluate(model.transform(data))
    return TrainedModel(config, features, [(model, None)], {"loss": list(summary.objectiveHistory), "iterations": summary.totalIterations, "accuracy": accuracy})


def predict(models: Sequence[TrainedModel], data: DataFrame) -> DataFrame:
    """(model, horizon_days, date, entity, probability, outcome) of every model for every row."""
    outs = []
    for m in models:
        rows = data.select("date", "entity", F.col("label").alias("outcome"), *m.features)
        probability: Column = F.lit(m.history.get("constant", 0.0))
        if m.members:
            scored, names = rows, []
            for i, (model, calibrator) in enumerate(m.members):
                drop = [c for c in ("features", "scaled", "rawPrediction", "probability", "prediction", "p", "calibrated") if c not in rows.columns]
                scored = model.transform(scored).withColumn("p", vector_to_array("probability")[1])
                scored = calibrator.transform(scored) if calibrator else scored.withColumn("calibrated", F.col("p"))
                scored = scored.withColumn(f"__p{i}", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("calibrated")))).drop(*drop)
                names.append(f"__p{i}")
            rows, probability = scored, reduce(lambda a, b: a + b, map(F.col, names)) / len(names)
        outs.append(rows.select(F.lit(m.config.name).alias("model"), F.lit(m.config.horizon_days).alias("horizon_days"), "date", "entity", probability.alias("probability"), "outcome"))
    return reduce(DataFrame.unionByName, outs)


def diagnostics(predictions: DataFrame) -> DataFrame:
    """(model, brier, precision, recall) of :func:`predict` rows at 0.5."""
    return summary_table(predictions, 0.5)


def rolling_backtest(data: DataFrame, config: ModelConfig, names: Sequence[str], folds: int = 5, at_once: int = 15) -> DataFrame:
    """Predictions on each fold by a model as of :func:`train_gbt`, trained on all rows before it, with the fold's number. Order is (date, entity).

    A row's rank within its class is the same among all rows as among those before a fold, so rows are ranked and written once for all folds, and the members of
    all folds' models are fitted side by side, ``at_once`` at a time.
    """
    features = _chosen(config, names)
    split = materialise(expanding_splits(data, folds, [F.col("date"), F.col("entity")]), "backtest")
    found = split.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()
    ranked = _by_rows(rank_in_group(split, ["label"], [F.col("row")], "__rank"), sum(r["n"] for r in found))
    models, jobs = [], []
    for k in range(1, folds + 1):
        counts = Counter()
        for r in found:
            if r["fold"] < k:
                counts[r["label"]] += r["n"]
        models.append(TrainedModel(config, features, [], _constant(counts)))
        jobs += [(models[-1], fit) for fit in _fits(ranked.where(F.col("fold") < k), counts, config, features, 3)]
    for (model, _), member in zip(jobs, _together([fit for _, fit in jobs], at_once), strict=True):
        model.members.append(member)
    outs = [predict([model], ranked.where(F.col("fold") == k)).withColumn("fold", F.lit(k)) for k, model in enumerate(models, 1)]
    return reduce(DataFrame.unionByName, outs)


def model_path(root: str, config: ModelConfig) -> str:
    return f"{root}/{slug(config.name).replace('/', '-')}"


def model_versions(root: str, config: ModelConfig) -> list[int]:
    """The versions kept of a model, oldest first; each is whole."""
    found = listed(SparkSession.active(), model_path(root, config))
    return sorted(int(n.partition("=")[2]) for n in found if n.startswith("version="))


def save_model(model: TrainedModel, root: str) -> str:
    """Write a model as the next version below ``root`` through Spark's writers, its settings and history as JSON text; the version's path.

    A version appears whole by one rename, so a save that stops half-way leaves the versions before it, and writers at once get a version each.
    """
    spark, path = SparkSession.active(), model_path(root, model.config)
    about = {"config": model.config.__dict__, "features": model.features, "history": model.history, "members": len(model.members), "calibrated": [c is not None for _, c in model.members]}

    def write(folder: str) -> None:
        for i, (m, c) in enumerate(model.members):
            m.save(f"{folder}/member{i}")
            if c is not None:
                c.save(f"{folder}/calibrator{i}")
        spark.range(1).select(F.lit(json.dumps(about)).alias("value")).coalesce(1).write.text(f"{folder}/about")

    while True:
        version = f"{path}/version={max(model_versions(root, model.config), default=0) + 1}"
        if publish(spark, version, write):
            return version


def has_model(root: str, config: ModelConfig) -> bool:
    """True if a version of that model is there."""
    return bool(model_versions(root, config))


def load_model(root: str, config: ModelConfig, version: int | None = None) -> TrainedModel:
    """A version of the model of that name, the last by default."""
    version = version or max(model_versions(root, config), default=None)
    if version is None:
        raise FileNotFoundError(f"no model {config.name} below {root}")
    path = f"{model_path(root, config)}/version={version}"
    about = json.loads(SparkSession.active().read.text(f"{path}/about").first()[0])
    own = ModelConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in about["config"].items()})
    members = [(PipelineModel.load(f"{path}/member{i}"), IsotonicRegressionModel.load(f"{path}/calibrator{i}") if about["calibrated"][i] else None) for i in range(about["members"])]
    return TrainedModel(own, about["features"], members, about["history"])


def drop_old_models(root: str, config: ModelConfig, keep: int = 2) -> int:
    """Delete all versions but the last ``keep``; their number. A reader of an older one would lose it, hence two by default."""
    old = model_versions(root, config)[: -max(1, keep)]
    for version in old:
        remove(SparkSession.active(), f"{model_path(root, config)}/version={version}")
    return len(old)
