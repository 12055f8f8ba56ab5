from datetime import date, datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statera import queries
from statera.functions.expressions import number_of
from statera.functions.ranking import rank_global, running_total
from statera.operators import distribution, evaluate, evidence, fiscal, graph, ml, scenario, timeseries
from statera.plans import risk
from statera.sources import runs, sinks

SF = "/root/testdata/sf0.001"


def events(spark, rows):
    return spark.createDataFrame(rows, "event_id string, event_date timestamp_ntz, actor1_country string, actor2_country string, num_articles long, tone double, goldstein double")


X4 = [("1", datetime(2024, 3, 1), "ITA", "FRA", 4, -2.0, 1.5), ("2", datetime(2024, 3, 2), "FRA", "DEU", 2, -1.0, 3.0), ("3", datetime(2024, 3, 3), "ITA", "FRA", 1, -3.0, 2.0)]


def test_graph(spark):
    edges, nodes = graph.state_graph(events(spark, X4))
    e, n = edges.first(), {r.state: r for r in nodes.collect()}["ITA"]
    assert (e.source, e.target, e.events, e.weight, e.avg_tone, e.first_seen) == ("ITA", "FRA", 2, 5.0, -2.5, datetime(2024, 3, 1))
    assert (n.out_events, n.total_weight, n.in_degree) == (2, 5.0, 0)
    assert graph.graph_edges(events(spark, X4), min_events=2, min_weight=4.5).count() == 1


def test_self_loops_and_missing_parts(spark):
    loop = events(spark, [("4", datetime(2024, 3, 4), " ita ", "ITA", None, None, None), ("5", None, "", "FRA", 1, None, None)]).drop("tone", "goldstein")
    assert graph.graph_edges(loop).count() == 0
    e = graph.graph_edges(loop, self_loops=True).collect()
    assert len(e) == 1 and e[0].weight == 1.0 and "avg_tone" not in e[0].__fields__
    n = graph.graph_nodes(graph.graph_edges(loop, self_loops=True)).first()
    assert (n.in_degree, n.out_degree, n.total_events) == (1, 1, 2)


def test_daily_events_rolling(spark):
    df = spark.createDataFrame([("2023-01-01", "A"), ("2023-01-01", "A"), ("2023-01-02", "B"), ("2023-01-02", None)], "event_date string, country string")
    out = {(r.date.day, r.entity): r.value for r in timeseries.rolling_sum(timeseries.daily_counts(df), 3).collect()}
    assert out == {(1, "A"): 2, (1, "B"): 0, (2, "A"): 2, (2, "B"): 1}


def test_rows_are_not_days(spark):
    df = spark.createDataFrame([(date(2023, 1, d), "A", 1) for d in (1, 2, 9)], "date date, entity string, value int")
    at = lambda x: [r.value for r in x.orderBy("date").collect()]
    assert at(timeseries.rolling_sum(df, 2)) == [1, 2, 2] and at(timeseries.rolling_sum(df, 2, calendar=True)) == [1, 2, 1]


def test_humanitarian_cells(spark):
    df = spark.createDataFrame([("d1", "A", 100), ("d2", "B", 150), ("d2", "C", None)], "date string, country string, v long")
    out = {(r.date, r.entity): r.value for r in timeseries.rolling_mean(timeseries.country_series(df, "v"), 3).collect()}
    assert out[("d1", "A")] == 100 and out[("d2", "B")] == 150 and out[("d1", "B")] is None and out[("d2", "C")] == 0


def test_economic_feature_fills_days(spark):
    df = spark.createDataFrame([("2023-01-01", 5.0, "x"), ("2023-01-04", 8.0, "y")], "date string, inflation_rate double, country string")
    assert [r.value for r in timeseries.economic_feature(df, 2).orderBy("date").collect()] == [5.0, 5.0, 5.0, 6.5]


def test_forward_fill_keeps_entities_apart(spark):
    df = spark.createDataFrame([(1, "A", 1.0), (2, "A", None), (1, "B", None), (2, "B", 3.0)], "date int, entity string, value double")
    assert sorted(map(tuple, timeseries.forward_fill(df).collect())) == [(1, "A", 1.0), (1, "B", 0.0), (2, "A", 1.0), (2, "B", 3.0)]


def test_folds_and_their_plan(spark):
    df = spark.range(100).toDF("x")
    out = timeseries.expanding_splits(df, 3, [F.col("x")])
    assert {r.fold: r.n for r in out.groupBy("fold").agg(F.count("*").alias("n")).collect()} == {0: 25, 1: 25, 2: 25, 3: 25}
    assert out.where("fold = 1").agg(F.min("x")).first()[0] == 25
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()


@settings(max_examples=8, deadline=None)
@given(values=st.lists(st.integers(0, 50), min_size=1, max_size=60))
def test_global_ranks_and_gini(spark, values):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    ranked = rank_global(df, [F.col("v"), F.col("i")]).collect()
    assert [r.rank for r in sorted(ranked, key=lambda r: (r.v, r.i))] == list(range(1, len(values) + 1))
    total = running_total(df, [F.col("v"), F.col("i")], "v", "t").agg(F.max("t")).first()[0]
    assert total == sum(values)
    n, s = len(values), sum(values)
    want = 2 * sum((i + 1) * v for i, v in enumerate(sorted(values))) / (n * s) - (n + 1) / n if s else 0.0
    assert distribution.gini(df, "v").first().gini == pytest.approx(want)


def test_gini_edges(spark):
    df = lambda *v: spark.createDataFrame([(x,) for x in v], "v double")
    assert distribution.gini(df(0.0, 0.0), "v").first().gini == 0.0
    assert distribution.gini(df(-1.0, 1.0), "v").first().gini is None
    assert distribution.gini(df(1.0, 2.0, 3.0).where("v > 9"), "v").first().gini == 0.0
    assert "SinglePartition" not in distribution.gini(spark.range(50).selectExpr("cast(id as double) v"), "v")._jdf.queryExecution().executedPlan().toString().split("Window")[-1].split("HashAggregate")[0]


def test_quantile_bins(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 1.0, 1.0, 2.0, 3.0, None)], "v double")
    assert [r.bin for r in distribution.quantile_cut(df, "v", 4).orderBy("v").collect()] == [None, 0, 0, 0, 0, 1]
    same = spark.createDataFrame([(2.0,), (2.0,)], "delta_disposable double")
    assert distribution.winners_losers(same).count() == 0


POLICY = "policy string, brackets array<struct<threshold:double,rate:double>>, base_deduction double, child_subsidy double, unemployment_benefit double"


def people(spark, rows, brackets=((30000.0, 0.18), (75000.0, 0.28))):
    p = spark.createDataFrame([("p", [dict(threshold=t, rate=r) for t, r in brackets], 5000.0, 120.0, 900.0)], POLICY)
    return spark.createDataFrame(rows, "agent_id int, gross_income double, num_children int, employment_status string").crossJoin(p)


def test_fiscal_rules(spark):
    rows = fiscal.apply_policy(people(spark, [(1, 105000.0, 2, "employed"), (2, 4000.0, 0, "Unemployed"), (3, None, 1, None), (4, 35000.0, None, "employed")])).orderBy("agent_id").collect()
    assert rows[0].tax_paid == pytest.approx(30000 * 0.18 + 45000 * 0.28 + 25000 * 0.28) and rows[0].transfers == 240
    assert (rows[1].tax_paid, rows[1].disposable_income) == (0.0, 4900.0)
    assert (rows[2].tax_paid, rows[2].disposable_income, rows[2].transfers) == (None, None, 120)
    assert rows[3].tax_paid == pytest.approx(5400) and rows[3].transfers == 0
    assert fiscal.apply_policy(people(spark, [(1, 50000.0, 0, "x")], ())).first().tax_paid == 0.0
    with pytest.raises(ValueError):
        fiscal.apply_policy(spark.range(1).toDF("x"))


def test_higher_rates_tax_more_and_subsidies_level(spark):
    rows = [(i, 8000.0 + 1500 * i, (60 - i) // 20, "employed") for i in range(60)]
    low, high = people(spark, rows), people(spark, rows, ((30000.0, 0.25), (75000.0, 0.35)))
    tax = lambda df: fiscal.apply_policy(df).agg(F.sum("tax_paid")).first()[0]
    assert tax(high) > tax(low)
    after = lambda df: distribution.gini(fiscal.apply_policy(df), "disposable_income").first().gini
    assert after(low.withColumn("child_subsidy", F.lit(2000.0))) < after(low)
    spent = lambda df: fiscal.consumption(fiscal.apply_policy(df)).agg(F.sum("consumption")).first()[0]
    assert spent(high) < spent(low)


def test_policies_that_break_a_rule(spark):
    b = lambda *x: [dict(threshold=t, rate=r) for t, r in x]
    rows = [("ok", b((1.0, 0.1)), 0.0, 0.0, 0.0), ("rate", b((1.0, 1.1)), 0.0, 0.0, 0.0), ("zero", b((0.0, 0.1)), 0.0, 0.0, 0.0), ("none", [], 0.0, 0.0, 0.0), ("null", None, 0.0, 0.0, 0.0), ("amount", b((1.0, 0.1)), -1.0, 0.0, 0.0)]
    assert {r.policy for r in fiscal.validate_policy(spark.createDataFrame(rows, POLICY)).collect()} == {"rate", "zero", "none", "null", "amount"}


EVENTS = "name string, intensity double, start_tick int, end_tick int, economic_multiplier double, inflation_pressure double, deduction_delta double, subsidy_multiplier double, benefit_multiplier double"


def test_interval_events(spark, monkeypatch):
    ticks = spark.createDataFrame([(i,) for i in range(5)], "tick int")
    one = spark.createDataFrame([("Energy Crisis", 0.6, 1, 3, 0.8, 0.12, None, None, 1.5)], EVENTS)
    timeline = fiscal.event_timeline(ticks, one)
    assert "BroadcastNestedLoopJoin" in timeline._jdf.queryExecution().executedPlan().toString()
    out = {r.tick: r for r in fiscal.event_adjustment(timeline).collect()}
    assert out[1].economic_intensity == pytest.approx(0.48) and out[3].inflation_delta == pytest.approx(0.072) and out[2].benefit_multiplier == 1.5
    assert out[4].active == 0 and out[4].benefit_multiplier is None and out[4].event_names == ""
    assert "BroadcastNestedLoopJoin" in fiscal.policy_grid(people(spark, [(1, 1.0, 0, "x")]).drop("policy", "brackets", "base_deduction", "child_subsidy", "unemployment_benefit"), people(spark, []).select("policy", "brackets", "base_deduction", "child_subsidy", "unemployment_benefit"))._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(fiscal, "BROADCAST_EVENTS", 0)
    many = fiscal.event_timeline(ticks, one)
    assert sorted((r.tick, r["name"]) for r in many.collect()) == sorted((r.tick, r["name"]) for r in timeline.collect())


def test_shocks(spark):
    ticks = spark.createDataFrame([(0,), (1,), (2,)], "tick int")
    two = spark.createDataFrame([("a", 9.0, 1, 1, 1.0, 0.0, None, None, None), ("b", 1.0, 1, None, 1.0, 0.0, None, None, None)], EVENTS)
    adjusted = fiscal.event_adjustment(fiscal.event_timeline(ticks, two))
    own = {r.tick: r for r in fiscal.composite_shock(adjusted).collect()}
    assert own[0].shock is None and own[1].shock_intensity == 5.0 and own[1].shock_end is None
    base = {r.tick: r for r in fiscal.composite_shock(adjusted, ("base", -1.0, 2, 7)).collect()}
    assert (base[0].shock_intensity, base[0].shock_start) == (-1.0, 2) and (base[2].shock_intensity, base[2].shock_start, base[2].shock_end) == (0.0, 2, 7)


def test_balance_is_taxes_less_transfers(spark):
    panel = spark.createDataFrame([(1, 0, 10.0, 3.0, 5.0, "Employed", 9.0), (2, 0, 1.0, 4.0, 5.0, None, 9.0), (1, 1, 2.0, 3.0, 7.0, "x", 11.0)], "agent_id int, tick int, tax_paid double, transfers double, consumption double, employment_status string, disposable_income double")
    t = {r.tick: r for r in fiscal.fiscal_timeline(panel).collect()}
    assert t[0].budget_balance == 4.0 and t[0].employment_rate == 0.5 and t[1].unemployment_rate == 1.0
    a = {r.agent_id: r for r in fiscal.agent_metrics(panel).collect()}[1]
    assert (a.final_disposable, a.baseline_disposable, a.delta_disposable) == (11.0, 9.0, 1.0)


def test_quota_rounds_half_even(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", i) for i in range(15)], "g string, x int")
    out = fiscal.quota_top_k(df, ["g"], [F.col("x").desc()], 0.1)
    assert sorted(map(tuple, out.collect())) == [("b", 13), ("b", 14)]


def test_scenarios(spark):
    base, other = spark.createDataFrame([("x", 0.2), ("y", 0.3)], "k string, probability double"), spark.createDataFrame([("x", 0.5), ("z", 0.1)], "k string, probability double")
    assert {r.k: r.delta for r in scenario.scenario_delta(base, other, ["k"]).collect()} == {"x": pytest.approx(0.3), "y": None, "z": None}
    a, b = spark.createDataFrame([(1, 5.0), (2, 5.0)], "decile int, value double"), spark.createDataFrame([(1, 4.0), (3, 2.0)], "decile int, value double")
    assert {r.decile: (r.delta, r.sign) for r in scenario.decile_delta(a, b).collect()} == {1: (-1.0, "negative"), 2: (0.0, "positive"), 3: (2.0, "positive")}
    kpis = spark.createDataFrame([("b", 2, 7.0), ("a", 1, 7.0), ("c", 3, 1.0)], "run string, at int, k double")
    assert scenario.best_run(kpis, F.col("k"), "at").first().run == "a"


def test_quality_of_probabilities(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, None), (None, 1), (0.1, 0)], "probability double, outcome int")
    assert evaluate.brier(df).first().brier == pytest.approx((0.01 + 0.25 + 0.01) / 3)
    r = evaluate.precision_recall(df, 0.5).first()
    assert (r.precision, r.recall) == (0.5, 0.5)
    none = evaluate.precision_recall(df.where("probability < 0"), 0.5).first()
    assert (none.precision, none.recall) == (0.0, 0.0)


def test_evidence_of_predictions(spark):
    df = spark.createDataFrame([("A", date(2024, 1, d), d / 10) for d in range(1, 9)] + [("B", date(2024, 1, d), 0.5) for d in range(1, 8)], "country string, date date, probability double")
    out = {r.country: r for r in evaluate.build_evidence(df).collect()}
    assert out["A"].signal_strength == 0.95 and out["A"].posterior_odds == 4.0 and out["A"].updated == "2024-01-08"
    assert out["B"].signal_strength == 0.05
    alerts = {r.country: r.alert for r in evaluate.top_alerts(df, 2, 0.6).collect()}
    assert alerts == {"A": 1, "B": 0}


def test_bayesian_evidence(spark):
    wide = spark.createDataFrame([(1, 0, 0.1, 1.0, 7.0), (2, 0, 0.2, 1.1, 7.0), (3, 1, 0.4, 1.2, 7.0), (4, 1, 0.5, None, 7.0)], "n int, y int, a double, b double, c double")
    out = {r.feature: r for r in evidence.bayesian_evidence(evidence.to_long(wide, ["a", "b", "c"], "n", "y"), 0.2, 1.0, 3).collect()}
    assert set(out) == {"a", "b"} and all(r.posterior >= 0 for r in out.values())
    assert out["a"].samples == 1 and out["a"].posterior == pytest.approx(1.2 / 2)
    assert out["b"].evidence_strength == "strong increase" and out["b"].bucket.startswith("[")
    with pytest.raises(ValueError):
        evidence.bayesian_evidence(wide, prior=1.0)


def test_feature_store_names_and_errors(spark):
    df = spark.createDataFrame([("2023-01-01", "A", 5.0)], "date string, country string, inflation_rate double")
    store = risk.build_feature_store({"t": df}, [risk.FeatureConfig("economic_pressure", "t", 14), risk.FeatureConfig("events_x", "t", 3)])
    assert {r.feature for r in store.collect()} == {"economic__economic_pressure", "events__events_x"}
    for bad, error in ((risk.FeatureConfig("other_x", "t"), "unknown"), (risk.FeatureConfig("events_x", "missing"), "missing"), (risk.FeatureConfig("humanitarian_x", "t"), "none of")):
        with pytest.raises(ValueError, match=error):
            risk.build_feature_store({"t": df}, [bad])


def test_run_tables(spark, tmp_path):
    tables = runs.RunTables(spark, str(tmp_path))
    policy = people(spark, [(1, 1.0, 0, "x")]).select("policy", "brackets", "base_deduction", "child_subsidy", "unemployment_benefit")
    timeline = spark.createDataFrame([(2, 5.0), (0, 1.0), (1, 3.0)], "tick int, cpi double")
    agents = spark.createDataFrame([(2, 1.0), (1, 2.0)], "agent_id int, average_disposable double")
    first = tables.store("one", policy, timeline, agents, {"ticks": "3"}, created_at=datetime(2024, 1, 1))
    second = tables.store("two", policy, timeline, agents, created_at=datetime(2024, 1, 2))
    header, t, a = tables.fetch(first)
    assert [r.tick for r in t.collect()] == [0, 1, 2] and [r.agent_id for r in a.collect()] == [1, 2]
    assert header.first().policy.brackets[1].rate == 0.28
    assert [r.run_id for r in tables.list_runs().collect()] == [second, first]
    for fmt in ("csv", "parquet"):
        out = tables.export(first, str(tmp_path / "out"), fmt)
        assert spark.read.format(fmt).option("header", True).load(out["timeline"]).count() == 3
    with pytest.raises(ValueError):
        tables.export(first, str(tmp_path), "xls")
    with pytest.raises(KeyError):
        tables.fetch("unknown")


def test_ranks_do_not_rest_on_a_cache(spark):
    rows = spark.range(0, 200_000, 1, 8).selectExpr("xxhash64(id) % 1000 AS v", "id")
    ranked, summed = rank_global(rows, [F.col("v"), F.col("id")]), running_total(rows.selectExpr("v", "id", "1L AS one"), [F.col("v"), F.col("id")], "one", "r")
    spark.catalog.clearCache()
    n = 200_000
    for df, name in ((ranked, "rank"), (summed, "r")):
        assert df.agg(F.countDistinct(name), F.min(name), F.max(name)).first() == (n, 1, n)


def test_gini_of_groups_that_share_ranges(spark):
    rows = [(g, float(v)) for g in ("a", "b", None) for v in range(1, 40) for _ in range(1 + v % 3)] + [("c", 5.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.gini for r in distribution.gini(df, "v", ["g"]).collect()}
    for g in ("a", "b", None, "c"):
        alone = df.where(F.col("g").eqNullSafe(F.lit(g)))
        assert got[g] == pytest.approx(distribution.gini(alone, "v").first().gini)


def test_policies_beyond_one_broadcast(spark, monkeypatch):
    folk, rules = people(spark, [(1, 50_000.0, 1, "employed"), (2, 9_000.0, 0, "unemployed")]).drop("policy", "brackets", "base_deduction", "child_subsidy", "unemployment_benefit"), []
    for i in range(7):
        rules.append((f"p{i}", [(1000.0 * (i + 1), 0.1), (90_000.0, 0.2)], 100.0, 10.0, 20.0))
    policies = spark.createDataFrame(rules, fiscal.POLICY_SCHEMA)
    want = sorted(map(tuple, fiscal.policy_grid(folk, policies).collect()))
    monkeypatch.setattr(fiscal, "BROADCAST_POLICIES", 2)
    assert len(want) == 7 and sorted(map(tuple, fiscal.policy_grid(folk, policies).collect())) == want


def test_numbers_by_type(spark):
    df = spark.createDataFrame([(1.5, 2, "3.5"), (float("nan"), None, "x"), (float("inf"), -1, "1d")], "a double, b long, c string")
    got = df.select(*(number_of(df, c).alias(c) for c in df.columns)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1.5, 2.0, 3.5), (None, None, None), (None, -1.0, None)], key=str)
    assert "RLIKE" not in df.select(number_of(df, "a"), number_of(df, "b"))._jdf.queryExecution().toString()


def test_latest_outcomes_are_written(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 0), (2, "a", 1), (2, "b", 0)], "date int, entity string, label int")
    sinks.write_outcomes(rows, str(tmp_path / "o"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "o")).select("entity", "outcome").collect())) == [("a", 1), ("b", 0)]


def test_perceptron_and_backtest(spark):
    rows = [(date(2024, 1, 1) + timedelta(days=i), e, float(i % 7), float((3 * i) % 5), float(i % 7 > 3)) for i in range(40) for e in ("x", "y")]
    data, names = spark.createDataFrame(rows, "date date, entity string, f double, g double, label double"), ("f", "g")
    config = ml.ModelConfig("m", trees=5, depth=2, hidden=(4,), iterations=60)
    net = ml.train_mlp(data, config, names)
    assert net.history["iterations"] > 0 and net.history["loss"][-1] < net.history["loss"][0] and net.history["accuracy"] >= 0.9
    said = ml.predict([net], data)
    assert said.count() == 80 and said.where("probability between 0 and 1").count() == 80
    checked = ml.diagnostics(said).first()
    assert checked.brier < 0.1 and checked.precision >= 0.9 and checked.recall >= 0.9
    tested = ml.rolling_backtest(data, config, names, 2)
    first = {r.fold: r.first for r in tested.groupBy("fold").agg(F.min("date").alias("first")).collect()}
    assert tested.groupBy("fold").count().orderBy("fold").collect() == [(1, 26), (2, 26)] and first[1] < first[2]
    assert ml.diagnostics(tested).first().brier < 0.2


def test_rows_come_in_order(spark):
    edges, nodes = graph.state_graph(events(spark, X4))
    for rows, key in ((edges.collect(), lambda r: (-r.weight, -r.events, r.source, r.target)), (nodes.collect(), lambda r: (-r.total_weight, r.state))):
        assert list(map(key, rows)) == sorted(map(key, rows))
    assert all(r.degree == r.in_degree + r.out_degree for r in nodes.collect())


def test_results_come_in_order(spark):
    """The row hash of the SQL comparison ignores order."""
    rows = queries.QUERIES["combined_gold"](spark, SF).select("date").collect()
    assert [r.date for r in rows] == sorted(r.date for r in rows)
    posterior = [r.posterior for r in queries.QUERIES["bayesian_evidence"](spark, SF).collect()]
    assert posterior == sorted(posterior, reverse=True)
    alerts = evaluate.top_alerts(spark.createDataFrame([("B", date(2024, 1, 1), 0.9), ("A", date(2024, 1, 1), 0.9), ("C", date(2024, 1, 1), 0.95)], "country string, date date, probability double"), k=2)
    assert {r.country for r in alerts.where("alert = 1").collect()} == {"C", "A"}  # of equal ones the first by name


def test_risk_pipeline_writes_and_keeps_models(spark, tmp_path):
    """The files that it writes are what it returns; a second run loads the models of the first."""
    start = date(2024, 1, 1)
    days = [start + timedelta(days=i) for i in range(24)]
    events = spark.createDataFrame([(d, c) for i, d in enumerate(days) for c in ("A", "B") for _ in range(1 + (i * (2 if c == "A" else 1)) % 5)], "event_date date, country string")
    target = spark.createDataFrame([(d, c, int(i % 3 == 0)) for i, d in enumerate(days) for c in ("A", "B")], "date date, entity string, label int")
    features, models = (risk.FeatureConfig("events_count", "events", 3),), (ml.ModelConfig("small", trees=2, depth=1),)
    run = lambda n: risk.risk_pipeline({"events": events}, target, f"{tmp_path}/out{n}", features, models, f"{tmp_path}/models")
    predictions, evidence = run(1)
    rows = lambda df, *by: [tuple(r) for r in df.orderBy(*by).collect()]
    first = rows(predictions.select("date", "country", "probability"), "date", "country")
    assert len(first) == 48 and all(0 <= r[2] <= 1 for r in first)
    stored = spark.read.parquet(f"{tmp_path}/out1/predictions").select("date", F.col("country").cast("string").alias("country"), "probability")
    assert rows(stored, "date", "country") == first
    assert rows(spark.read.json(f"{tmp_path}/out1/evidence").select(*sorted(evidence.columns)), "country") == rows(evidence.select(*sorted(evidence.columns)), "country")
    outcomes = spark.read.parquet(f"{tmp_path}/out1/outcomes")
    assert rows(outcomes.select("entity", "outcome"), "entity") == [("A", int(23 % 3 == 0)), ("B", int(23 % 3 == 0))]
    assert ml.model_versions(f"{tmp_path}/models", models[0]) == [1]
    again, _ = run(2)
    assert rows(again.select("date", "country", "probability"), "date", "country") == first
    assert ml.model_versions(f"{tmp_path}/models", models[0]) == [1]
