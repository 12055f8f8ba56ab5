"""What a step costs follows its rows, not the session's settings."""

import datetime
import itertools

import pytest
from pyspark.sql import functions as F

from statera import bindings as B
from statera.operators import graph, ml, timeseries
from statera.operators.timeseries import expanding_splits
from statera.queries import QUERIES
from statera.sources import feeds


@pytest.fixture()
def wide(spark):
    """A session with many shuffle partitions, as on a cluster."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_trees_on_few_rows_take_few_tasks(wide):
    day = F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, cast(id as int))")
    data = wide.range(60).select(day.alias("date"), F.lit("a").alias("entity"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 2).cast("double").alias("label")).localCheckpoint()
    wide.sparkContext.setJobGroup("few-rows", "trees")
    model = ml.train_gbt(data, ml.ModelConfig("m", trees=3), ["x"], at_once=1)
    tracker = wide.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("few-rows") for s in tracker.getJobInfo(j).stageIds]
    wide.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tasks = [s.numTasks for s in stages if s is not None]
    assert len(model.members) == 3 and len(tasks) > 30
    assert sum(tasks) / len(tasks) < 5
    shown = ml.predict([model], data)
    assert shown.count() == 60 and shown.where("probability between 0 and 1").count() == 60
    assert shown.agg(F.min("date")).first()[0] == datetime.datetime(2024, 1, 1)


def test_equal_agents_share_a_cluster_whatever_the_order_of_their_orders(spark, tmp_path):
    rows, agent = [], 0
    for base in range(11):
        for prices in itertools.permutations([100.1 + base, 200.2 + 3 * base, 400.7 + 8 * base, 0.3]):
            agent += 1
            rows += [(agent, "F", p, datetime.datetime(1995, 1, 1)) for p in prices]
    orders = spark.createDataFrame(rows, "o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz")
    orders.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    # each quantile falls among 24 equal agents
    assert sorted((r["cluster"], r["count"]) for r in QUERIES["winners_losers"](spark, str(tmp_path)).collect()) == [(0, 72), (1, 48), (2, 48), (3, 48), (4, 48)]


def test_agents_without_a_price_that_fits_decimals(spark, tmp_path):
    rows = [(1, "F", 1e25), (1, "F", 3e25), (2, "F", float("nan")), (2, "F", 1.0), (3, "F", None), (4, "F", 2.0), (4, "F", None)]
    spark.createDataFrame(rows, "o_custkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    found = {r["agent_id"]: r["average_disposable"] for r in B.agents(spark, str(tmp_path)).collect()}
    assert found[1] == 2e25 and found[2] != found[2] and found[3] is None and found[4] == 2.0


def test_a_payload_is_parsed_once_in_a_pass(spark, tmp_path, capsys):
    lines = ['{"data":[{"a":1},{"a":2}]}', '[{"page":1},[{"a":3}]]', '{"results":[]}', '[]', "null", "broken", '{"data":[1,null]}', '{"a":4}']
    (tmp_path / "feed.json").write_text("\n".join(lines))
    rows = feeds.read_feed(spark, str(tmp_path), schema="a long", lines=True)
    unread = feeds.unread_payloads(spark, str(tmp_path), lines=True)
    assert sorted(r.a for r in rows.collect()) == [1, 2, 3, 4]
    assert sorted((r.value, r.records) for r in unread.collect() if r.records) == [("null", 1), ('{"data":[1,null]}', 2)]
    assert [r.value for r in unread.where("records is null").collect()] == ["broken"]
    for df in (rows, unread):
        capsys.readouterr()
        df.explain("simple")
        assert capsys.readouterr().out.count("parseJson(") == 1


def test_distinct_ids_are_found_in_tasks_of_few_rows(spark, capsys, monkeypatch):
    rows = [(i // 2 if i % 10 else None, "a", "b" if i % 3 else "c", 1.0, 0.5) for i in range(3000)] + [(None, "c", "d", 2.0, None)]
    events = spark.createDataFrame(rows, "event_id long, actor1_country string, actor2_country string, num_articles double, tone double")
    monkeypatch.setattr(graph, "TASK_ROWS", 100)
    edges = graph.graph_edges(events)
    edges.explain("simple")
    assert ", 31), REPARTITION_BY_NUM" in capsys.readouterr().out
    expected = {t: (len({r[0] for r in rows if r[2] == t and r[0] is not None}), sum(r[3] for r in rows if r[2] == t)) for t in ("b", "c", "d")}
    assert {r.target.lower(): (r.events, r.weight) for r in edges.collect()} == expected
    assert edges.columns == ["source", "target", "events", "weight", "avg_tone"]


def test_a_backtest_ranks_and_writes_rows_once_for_all_folds(spark, monkeypatch):
    day = F.expr("date_add(DATE'2024-01-01', cast(id div 2 as int))")
    # fold 1 is trained on one class, fold 2 with fewer rows of a class than calibration folds
    label = F.when(F.col("id") < 19, F.lit(0.0)).otherwise((F.col("id") % 9 < 3).cast("double"))
    rows = spark.range(60).select(day.alias("date"), F.concat(F.lit("e"), F.col("id") % 2).alias("entity"), (F.col("id") * 7 % 11).cast("double").alias("x"), label.alias("label")).localCheckpoint()
    written, write = [], ml.materialise
    monkeypatch.setattr(ml, "materialise", lambda df, name: written.append(name) or write(df, name))
    config = ml.ModelConfig("m", trees=2, depth=1)
    tested = ml.rolling_backtest(rows, config, ["x"], 4)
    assert written == ["backtest", "fit"]
    split = expanding_splits(rows, 4, [F.col("date"), F.col("entity")]).localCheckpoint()
    classes = []
    for k in range(1, 5):
        before = split.where(F.col("fold") < k).drop("row", "fold")
        classes.append(min(r["count"] for r in before.groupBy("label").count().collect()) if before.select("label").distinct().count() > 1 else 0)
        alone = ml.predict([ml.train_gbt(before, config, ["x"])], split.where(F.col("fold") == k))
        given = {(r.date, r.entity): (r.probability, r.outcome) for r in tested.where(F.col("fold") == k).collect()}
        expected = {(r.date, r.entity): (r.probability, r.outcome) for r in alone.collect()}
        assert len(given) == 12 and given.keys() == expected.keys()
        assert all(given[key] == pytest.approx(expected[key], abs=1e-9) for key in given)
    assert classes[0] == 0 and 0 < classes[1] < 3 <= classes[2]


@pytest.mark.parametrize("calendar", [False, True])
def test_trailing_values_read_their_input_once(spark, tmp_path, calendar):
    path = str(tmp_path / "cells")
    spark.range(40).selectExpr("date_add(DATE'2024-01-01', cast(id % 9 as int)) AS event_date", "cast(id % 3 as string) AS country", "id * 0.5D AS v").write.parquet(path)
    source = spark.read.parquet(path)
    for out in (timeseries.rolling_sum(timeseries.daily_counts(source), 3, calendar), timeseries.rolling_mean(timeseries.country_series(source, "v", "event_date"), 3, calendar)):
        assert out.inputFiles() and not any(path in f for f in out.inputFiles())
        assert out.count() == 27


def test_the_backtest_query_fits_models_of_the_default_size(spark, monkeypatch):
    asked = []

    def tested(data, config, names):
        asked.append((config.trees, config.depth, tuple(names)))
        return data.select(F.lit(1).alias("fold"), F.lit(0.5).alias("probability"), F.col("label").alias("outcome"))

    monkeypatch.setattr(ml, "rolling_backtest", tested)
    assert QUERIES["rolling_backtest"](spark, "/root/testdata/sf0.001").count() == 1
    default = ml.ModelConfig("m")
    assert asked == [(default.trees, default.depth, ("events__events_daily", "humanitarian__humanitarian_pressure"))] and default.trees == 100
