"""Stores that several sessions write to: whole or not there at all."""

import threading
from multiprocessing.pool import ThreadPool

import pytest
from pyspark.sql import functions as F

from statera.operators import ml
from statera.sources import runs, storage
from tests.test_series_graphs_policies import people


def run_parts(spark):
    policy = people(spark, [(1, 1.0, 0, "x")]).select("policy", "brackets", "base_deduction", "child_subsidy", "unemployment_benefit")
    timeline = spark.createDataFrame([(2, 5.0), (0, 1.0), (1, 3.0)], "tick int, cpi double")
    return policy, timeline, spark.range(100).select(F.col("id").alias("agent_id"), F.lit(1.5).alias("average_disposable")).repartition(4)


def test_eight_threads_store_eight_runs(spark, tmp_path):
    tables, parts, gate = runs.RunTables(spark, str(tmp_path / "store")), run_parts(spark), threading.Barrier(8)
    assert tables.list_runs().collect() == []

    def store(k):
        gate.wait()
        return tables.store(f"run {k}", *parts)

    with ThreadPool(8) as pool:
        ids = pool.map(store, range(8), 1)
    assert sorted(r.run_id for r in tables.list_runs().collect()) == sorted(ids)
    for k, run_id in enumerate(ids):
        header, timeline, agents = tables.fetch(run_id)
        assert header.first().scenario == f"run {k}" and timeline.count() == 3 and agents.count() == 100


@pytest.mark.parametrize("dies", [False, True])
def test_a_failed_store_leaves_nothing_to_see(spark, tmp_path, monkeypatch, dies):
    """It fails while it writes the agents, after the timeline; or dies before it could clean up."""
    tables, (policy, timeline, agents) = runs.RunTables(spark, str(tmp_path)), run_parts(spark)
    kept = tables.store("kept", policy, timeline, agents)
    if dies:
        monkeypatch.setattr(storage, "remove", lambda *_: None)
    with pytest.raises(Exception, match="no agents"):
        tables.store("lost", policy, timeline, agents.withColumn("x", F.raise_error(F.lit("no agents"))))
    assert [(r.run_id, r.scenario) for r in tables.list_runs().collect()] == [(kept, "kept")]
    assert [n for n in storage.listed(spark, str(tmp_path)) if not n.startswith("_")] == [f"run_id={kept}"]
    assert bool(storage.listed(spark, f"{tmp_path}/_aside")) == dies
    assert tables.fetch(kept)[2].count() == 100


def test_publish_takes_a_name_once(spark, tmp_path):
    gate = threading.Barrier(6)

    def write(k):
        gate.wait()
        return storage.publish(spark, f"{tmp_path}/x", lambda folder: spark.range(k + 1).write.parquet(folder))

    with ThreadPool(6) as pool:
        won = pool.map(write, range(6), 1)
    assert sum(won) == 1
    assert spark.read.parquet(f"{tmp_path}/x").count() == won.index(True) + 1
    assert storage.listed(spark, f"{tmp_path}/_aside") == []


def small_model(spark, name="Daily risk"):
    data = spark.createDataFrame([(f"2024-01-{i + 1:02d}", "x", float(i), float(i > 5)) for i in range(12)], "date string, entity string, a double, label double")
    return data, ml.train_mlp(data, ml.ModelConfig(name, hidden=(2,), iterations=3), ["a"])


def scores(models, data):
    return [round(r.probability, 9) for r in ml.predict(models, data).orderBy("date").collect()]


def test_a_model_is_replaced_as_a_whole(spark, tmp_path, monkeypatch):
    data, model = small_model(spark)
    root = str(tmp_path)
    assert not ml.has_model(root, model.config)
    with pytest.raises(FileNotFoundError):
        ml.load_model(root, model.config)
    assert ml.save_model(model, root).endswith("version=1")
    before = scores([model], data)
    other = ml.TrainedModel(ml.ModelConfig("Daily risk", hidden=(2,)), ["a"], [model.members[0], (None, None)])  # its second member can't be written
    with pytest.raises(AttributeError):
        ml.save_model(other, root)
    assert ml.model_versions(root, model.config) == [1] and scores([ml.load_model(root, model.config)], data) == before
    constant = ml.TrainedModel(ml.ModelConfig("Daily risk"), ["a"], [], {"constant": 1.0})
    for n in (2, 3, 4):
        assert ml.save_model(constant, root).endswith(f"version={n}")
    assert scores([ml.load_model(root, model.config)], data) == [1.0] * 12
    assert scores([ml.load_model(root, model.config, 1)], data) == before
    assert ml.drop_old_models(root, model.config) == 2 and ml.model_versions(root, model.config) == [3, 4]


def test_models_saved_at_once_get_a_version_each(spark, tmp_path):
    gate = threading.Barrier(4)

    def save(k):
        gate.wait()
        return ml.save_model(ml.TrainedModel(ml.ModelConfig("m"), ["a"], [], {"constant": k / 4}), str(tmp_path))

    with ThreadPool(4) as pool:
        paths = pool.map(save, range(4), 1)
    assert ml.model_versions(str(tmp_path), ml.ModelConfig("m")) == [1, 2, 3, 4]
    for k, path in enumerate(paths):
        assert ml.load_model(str(tmp_path), ml.ModelConfig("m"), int(path.rpartition("=")[2])).history["constant"] == k / 4


def test_release_deletes_intermediate_tables(spark):
    kept = storage.materialise(spark.range(5), "kept")
    path = kept.inputFiles()[0].rpartition("/")[0]
    assert storage.exists(spark, path) and storage.release(spark) >= 1 and not storage.exists(spark, path)
    assert storage.release(spark) == 0
