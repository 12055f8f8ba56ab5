"""Groups that hold all rows: spread over ranges or blocks, with the rows that one window over the group gives."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statera.functions import ranking
from statera.operators import distribution, evaluate, fiscal, timeseries

START = date(2024, 1, 1)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df, digits=9):
    return sorted((tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


def series(spark, entities, n=300, seed=1):
    """Rows with ties, NULL values (heads among them), NULL dates and a NULL entity."""
    rng = random.Random(seed)
    rows = [(START + timedelta(days=rng.randrange(n // 2)) if rng.random() < 0.98 else None, rng.choice(entities), rng.randrange(50) / 4 if i > 40 and rng.random() < 0.3 else None, rng.randrange(9) if rng.random() < 0.5 else None) for i in range(n)]
    return spark.createDataFrame(rows, "date date, entity string, value double, other int").repartition(5)


@pytest.mark.parametrize("entities", [["one"], ["a", "b", None], [None]])
def test_carry_over_ranges_is_the_window(spark, monkeypatch, entities):
    df = series(spark, entities)
    own = W.partitionBy("entity").orderBy("date", "value", "other").rowsBetween(W.unboundedPreceding, 0)
    expected = df.withColumns({c: F.last(c, ignorenulls=True).over(own) for c in ("value", "other")})
    assert rows_of(ranking.carry_forward(df, ["entity"], "date", ["value", "other"])) == rows_of(expected)
    monkeypatch.setattr(ranking, "WINDOW_ROWS", 0)
    spread = ranking.carry_forward(df, ["entity"], "date", ["value", "other"])
    assert spread.columns == df.columns and rows_of(spread) == rows_of(expected)
    # the windows over the rows are cut by range; the other one holds a row for each range and group
    windows = [line for line in plan_of(spread).splitlines() if "Window [" in line]
    assert windows and all("__range" in line for line in windows)
    filled = timeseries.forward_fill(df.drop("other"))
    assert filled.where("value is null").count() == 0 and filled.count() == 300


def test_carry_without_rows(spark, monkeypatch):
    monkeypatch.setattr(ranking, "WINDOW_ROWS", -1)
    none = series(spark, ["a"]).where("entity = 'x'")
    assert ranking.carry_forward(none, ["entity"], "date", ["value"]).collect() == []


@pytest.mark.parametrize(("n", "block"), [(1, 4), (3, 4), (7, 4), (30, 8), (5, 1 << 16)])
def test_halo_windows_are_the_window(spark, n, block):
    df = series(spark, ["one", "one", "two"]).where("date is not null")
    at = F.unix_date("date").cast("long")
    near = W.partitionBy("entity").orderBy(F.unix_date("date")).rangeBetween(-(n - 1), 0)
    expected = df.withColumns({"s": F.sum("value").over(near), "m": F.avg("value").over(near)})
    found = ranking.trailing(df, ["entity"], at, n, {"s": lambda w: F.sum("value").over(w), "m": lambda w: F.avg("value").over(w)}, block)
    assert found.columns == expected.columns and rows_of(found) == rows_of(expected)


@pytest.mark.parametrize("calendar", [False, True])
@pytest.mark.parametrize("rows", [1 << 20, 0])
def test_rolling_on_the_grid(spark, monkeypatch, calendar, rows):
    monkeypatch.setattr(ranking, "WINDOW_ROWS", rows)
    df = series(spark, ["one", "two"]).where("date is not null").groupBy("date", "entity").agg(F.sum("value").alias("value"))
    own = W.partitionBy("entity")
    near = own.orderBy(F.unix_date("date")).rangeBetween(-4, 0) if calendar else own.orderBy("date").rowsBetween(-4, 0)
    total = timeseries.densify_grid(df, 0).withColumn("value", F.sum("value").over(near))
    mean = timeseries.densify_grid(df, None).withColumn("value", F.avg("value").over(near))
    assert rows_of(timeseries.rolling_sum(df, 5, calendar)) == rows_of(total)
    assert rows_of(timeseries.rolling_mean(df, 5, calendar)) == rows_of(mean)


@pytest.mark.parametrize("rows", [1 << 20, 0])
def test_quota_of_one_group(spark, monkeypatch, rows):
    monkeypatch.setattr(ranking, "WINDOW_ROWS", rows)
    df = spark.range(1000).selectExpr("'g' AS g", "CAST(NULL AS STRING) AS h", "pmod(xxhash64(id), 1000) AS v", "id")
    top = fiscal.quota_top_k(df, ["g", "h"], [F.desc("v"), F.col("id")], 0.0125)
    own = W.partitionBy("g", "h").orderBy(F.desc("v"), "id")
    assert top.columns == df.columns and rows_of(top) == rows_of(df.withColumn("n", F.row_number().over(own)).where("n <= 12").drop("n"))
    assert fiscal.quota_top_k(df, ["g"], [F.desc("v"), F.col("id")], 0.5, cap=3).count() == 3
    assert fiscal.quota_top_k(df.limit(0), ["g"], [F.col("id")], 0.5).count() == 0


def test_statistics_of_groups_without_windows(spark):
    df = series(spark, ["a", None])
    own = W.partitionBy("entity")
    last = df.withColumn("m", F.max("date").over(own)).where("date = m").drop("m")
    assert rows_of(timeseries.latest(df, ("entity",))) == rows_of(last)
    spread = F.stddev_pop("value").over(own)
    z = df.withColumn("z", F.when(spread < 1e-6, 0.0).otherwise((F.col("value") - F.avg("value").over(own)) / spread))
    assert rows_of(timeseries.zscore(df)) == rows_of(z)
    for frame in (timeseries.latest(df, ("entity",)), timeseries.zscore(df)):
        assert "Window [" not in plan_of(frame)


@pytest.mark.parametrize(("n", "reference"), [(1, 0), (3, 2), (7, 6), (8, 6), (20, 6)])
def test_evidence_looks_at_seven_rows(spark, n, reference):
    df = spark.createDataFrame([("A", START + timedelta(days=n - i), 0.5 - i / 100) for i in range(n)], "country string, date date, probability double")
    evidence = evaluate.build_evidence(df)
    assert evidence.first().signal_strength == max(0.05, round(reference / 100 * 4, 2))
    assert "WindowGroupLimit" in plan_of(evidence)


def test_dyadic_join_is_the_broadcast_join(spark, monkeypatch):
    rng = random.Random(4)
    spans = [(f"e{i}", a := rng.choice([None, *range(-5, 70)]), rng.choice([None, (a or 0) + rng.randrange(-2, 60)]), i / 10) for i in range(200)]
    events = spark.createDataFrame(spans, "name string, start_tick int, end_tick int, intensity double")
    for some in ([3, 4, 5, 5, 17, 64, 65], [None, 9], [7], [*range(-3, 40)], []):
        ticks = spark.createDataFrame([(t, "x") for t in some], "tick int, more string")
        monkeypatch.setattr(fiscal, "BROADCAST_EVENTS", 10_000)
        few = fiscal.event_timeline(ticks, events)
        monkeypatch.setattr(fiscal, "BROADCAST_EVENTS", 0)
        many = fiscal.event_timeline(ticks, events)
        assert many.columns == few.columns and rows_of(many) == rows_of(few)


def test_long_intervals_are_few_rows(spark, monkeypatch):
    """2,000 intervals of a million ticks each: 2 log2 T rows for each, not a row for every 64 ticks."""
    monkeypatch.setattr(fiscal, "BROADCAST_EVENTS", 0)
    events = spark.range(2000).selectExpr("concat('e', id) AS name", "id AS start_tick", "1000000 + id AS end_tick", "1.0D AS intensity")
    ticks = spark.createDataFrame([(0,), (1000,), (500_000,), (1_001_000,), (2_000_000,)], "tick long")
    timeline = fiscal.event_timeline(ticks, events)
    found = {r.tick: r.n for r in timeline.groupBy("tick").agg(F.count("name").alias("n")).collect()}
    assert found == {0: 1, 1000: 1001, 500_000: 2000, 1_001_000: 1000, 2_000_000: 0}


def interpolated(values, q):
    values, out = sorted(values), []
    for k in range(q + 1):
        at = k / q * (len(values) - 1)
        low = int(at)
        out.append(values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low))
    return out


@pytest.mark.parametrize("rows", [1 << 20, 0])
@pytest.mark.parametrize("accuracy", [10_000, 100])
def test_quantiles_by_brackets(spark, monkeypatch, rows, accuracy):
    """With a coarse sketch most values lie between brackets and are not sorted; points are those of all values."""
    monkeypatch.setattr(ranking, "WINDOW_ROWS", rows)
    monkeypatch.setattr(distribution, "ACCURACY", accuracy)
    rng = random.Random(7)
    groups = {"skew": [rng.expovariate(1) ** 4 for _ in range(3000)], "ties": [float(rng.randrange(5)) for _ in range(3000)], "one": [2.5], "two": [1.0, 4.0], None: [rng.gauss(0, 1) for _ in range(2000)]}
    data = [(g, v) for g, vs in groups.items() for v in vs] + [("skew", None), ("none", None), ("skew", float("nan"))]
    df = spark.createDataFrame(data, "g string, v double").repartition(6)
    for q in (1, 4, 10):
        found = {r.g: r.points for r in distribution.quantile_points(df, "v", q, ["g"]).collect()}
        assert found.keys() == groups.keys()
        for g, vs in groups.items():
            assert found[g] == pytest.approx(interpolated(vs, q), rel=1e-12, abs=1e-12)
    whole = distribution.quantile_points(df, "v", 10).collect()
    assert whole[0].points == pytest.approx(interpolated([v for vs in groups.values() for v in vs], 10), rel=1e-12, abs=1e-12)
    assert distribution.quantile_points(df.limit(0), "v", 3).collect() == []
    if accuracy == 100:
        _, ranked = distribution._bracketed(df, "v", 4, ["g"])
        assert ranked.where("g = 'skew' and __x is not null").count() < 1000


@pytest.mark.parametrize("rows", [1 << 20, 0])
def test_gini_of_large_groups(spark, monkeypatch, rows):
    monkeypatch.setattr(ranking, "WINDOW_ROWS", rows)
    values = [float(x) for x in range(1, 200)] + [7.0] * 50
    df = spark.createDataFrame([(g, v * (1 if g else 3)) for g in (0, 1) for v in values], "g int, v double").repartition(4)
    n, ordered = len(values), sorted(values)
    expected = 2 * sum(i * x for i, x in enumerate(ordered, 1)) / (n * sum(ordered)) - (n + 1) / n
    for r in distribution.gini(df, "v", ["g"]).collect():
        assert r.gini == pytest.approx(expected, rel=1e-12)
