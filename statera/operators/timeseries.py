"""Series by entity: daily counts, observed-date grids, trailing windows, carried values, scores."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statera.functions.expressions import col, logistic, numeric_columns
from statera.functions.ranking import carry_forward, rank_global, rank_in_group, trailing, with_group
from statera.sources.storage import materialise

#: Weights of the risk index. Fixed values.
WEIGHTS = {"coup": 0.6, "violence": 0.5, "displacement": 0.3, "economic": 0.2, "constraints": 0.2}


def daily_counts(df: DataFrame, date: str = "event_date", entity: str = "country", name: str = "value") -> DataFrame:
    """(date, entity, count) by calendar day; rows without a date or entity are left out, a missing entity column is GLOBAL."""
    if entity not in df.columns:
        df = df.withColumn(entity, F.lit("GLOBAL"))
    rows = df.select(F.to_date(col(date)).alias("date"), col(entity).alias("entity")).dropna()
    return rows.groupBy("date", "entity").agg(F.count("*").alias(name))


def country_series(df: DataFrame, value: str, date: str = "date", entity: str = "country") -> DataFrame:
    """(date, entity, value): sums of a value; an all-NULL cell is 0. Dates keep their time of day."""
    if entity not in df.columns:
        df = df.withColumn(entity, F.lit("GLOBAL"))
    rows = df.select(col(date).alias("date"), col(entity).alias("entity"), col(value).alias("v")).dropna(subset=["date", "entity"])
    return rows.groupBy("date", "entity").agg(F.coalesce(F.sum("v"), F.lit(0)).alias("value"))


def densify_grid(df: DataFrame, fill: float | None = 0) -> DataFrame:
    """(date, entity, value) for every observed date and every observed entity; a missing cell is ``fill``."""
    return _grid(df, df.select("date").distinct(), fill)


def _grid(df: DataFrame, days: DataFrame, fill: float | None) -> DataFrame:
    """The grid over ``days``, with the columns that these have beside the date."""
    cells = days.join(df.select("entity").distinct(), how="cross").join(df.select("date", "entity", "value"), ["date", "entity"], "left")
    out = cells.select("date", "entity", "value", *(c for c in days.columns if c != "date"))
    return out if fill is None else out.fillna(fill, subset=["value"])


def _rolling(df: DataFrame, n: int, calendar: bool, fill: float | None, of: Callable[[str], Column]) -> DataFrame:
    """A trailing aggregate on the grid. As all entities have a row for each date, the last ``n`` rows are the last ``n`` numbers of dates.

    The grid takes dates, entities and values of ``df``, which is written first: what it is made of is read once.
    """
    df = materialise(df.select("date", "entity", "value"), "series")
    if calendar:
        grid, at = densify_grid(df, fill), F.unix_date(F.to_date("date")).cast("long")
    else:
        days = rank_in_group(df.select("date").distinct().withColumn("__all", F.lit(0)), ["__all"], [F.col("date")], "__day").drop("__all")
        grid, at = _grid(df, days, fill), F.col("__day")
    return trailing(grid, ["entity"], at, n, {"value": lambda w: of("value").over(w)}).select("date", "entity", "value")


def rolling_sum(df: DataFrame, n: int, calendar: bool = False) -> DataFrame:
    """Sum of each entity's last ``n`` rows of the zero-filled grid; ``calendar``: of its last ``n`` days."""
    return _rolling(df, n, calendar, 0, F.sum)


def rolling_mean(df: DataFrame, n: int, calendar: bool = False) -> DataFrame:
    """Mean of each entity's last ``n`` rows of the grid, missing cells skipped; ``calendar``: of its last ``n`` days."""
    return _rolling(df, n, calendar, None, F.avg)


def economic_feature(df: DataFrame, n: int, date: str = "date") -> DataFrame:
    """(date, entity, value): each numeric column as an entity, its mean for each day, days between filled forward, trailing mean of ``n`` days."""
    values = numeric_columns(df, [date])
    if not values:
        raise ValueError("no numeric column beside the date")
    long = df.select(F.to_date(col(date)).alias("date"), *(col(c).cast("double").alias(c) for c in values)).dropna(subset=["date"]).unpivot("date", values, "entity", "value")
    daily = long.groupBy("date", "entity").agg(F.avg("value").alias("value"))
    # days without any value are those before the first one; from there on every day has one, so the last n rows are the last n days
    span = daily.agg(F.min(F.when(F.col("value").isNotNull(), F.col("date"))).alias("low"), F.max("date").alias("high")).where("low is not null")
    days = span.select(F.explode(F.sequence("low", "high", F.expr("interval 1 day"))).alias("date"))
    grid = days.join(daily.select("entity").distinct(), how="cross").join(daily, ["date", "entity"], "left")
    filled = forward_fill(grid, zero=False)
    return trailing(filled, ["entity"], F.unix_date("date").cast("long"), n, {"value": lambda w: F.avg("value").over(w)})


def forward_fill(df: DataFrame, zero: bool = True, date: str = "date", keys: tuple[str, ...] = ("entity",), values: tuple[str, ...] = ("value",)) -> DataFrame:
    """Values carried forward by date within ``keys`` (rows of one date by their values); what has none before it is 0 (``zero``) or stays NULL."""
    filled = carry_forward(df, keys, date, values)
    return filled.withColumns({v: F.coalesce(col(v), F.lit(0.0)) for v in values}) if zero else filled


def combine_features(groups: Mapping[str, Mapping[str, DataFrame]]) -> DataFrame:
    """(feature, date, entity, value): all tables as domain__key, values carried forward and zero-filled."""
    cast = lambda df: df.select(F.col("date").cast("timestamp_ntz").alias("date"), "entity", F.col("value").cast("double").alias("value"))
    parts = [cast(df).select(F.lit(f"{domain}__{key}").alias("feature"), "date", "entity", "value") for domain, tables in groups.items() for key, df in tables.items()]
    return forward_fill(reduce(DataFrame.unionByName, parts), keys=("feature", "entity"))


def latest(df: DataFrame, keys: tuple[str, ...] = ("feature",), order: str = "date") -> DataFrame:
    """Each group's rows at its last date."""
    last = df.groupBy(*map(col, keys)).agg(F.max(col(order)).alias("__last"))
    return with_group(df, last, keys).where(col(order) == F.col("__last")).drop("__last")


def latest_outcomes(df: DataFrame, date: str = "date") -> DataFrame:
    """Rows at the last date of all."""
    last = df.agg(F.max(date).alias("__last"))
    return df.join(F.broadcast(last), col(date) == F.col("__last")).drop("__last")


def last_tick(timeline: DataFrame, run: str = "run_id") -> DataFrame:
    """Each run's last row."""
    rest = [c for c in timeline.columns if c != run]
    return timeline.groupBy(run).agg(F.max_by(F.struct(*rest), "tick").alias("r")).select(run, "r.*")


def expanding_splits(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """``df`` with ``row`` (from 0) and ``fold``: fold k is tested on its rows and trained on all before it.

    A fold has N div (n + 1) rows; the first rows, never tested, are fold 0.
    """
    ranked = rank_global(df, order, "row").withColumn("row", F.col("row") - 1)
    total = df.count()
    size = total // (n + 1)
    if not size:
        raise ValueError(f"{n} folds need more than {total} rows")
    first = total - n * size
    return ranked.withColumn("fold", F.when(F.col("row") < first, 0).otherwise(F.floor((F.col("row") - first) / size) + 1).cast("int"))


def zscore(df: DataFrame, value: str = "value", entity: str = "entity", name: str = "z") -> DataFrame:
    """(x - mean) / population standard deviation for each entity, 0 where that is below 1e-6."""
    stats = df.groupBy(col(entity)).agg(F.avg(col(value)).alias("__mean"), F.stddev_pop(col(value)).alias("__spread"))
    spread = F.col("__spread")
    return with_group(df, stats, [entity]).withColumn(name, F.when(spread < 1e-6, 0.0).otherwise((col(value) - F.col("__mean")) / spread)).drop("__mean", "__spread")


def risk_index(df: DataFrame, weights: Mapping[str, float] = WEIGHTS, name: str = "risk") -> DataFrame:
    """Logistic of the weighted z-scores in columns z_<name>; a missing column or value counts 0."""
    parts = [F.lit(w) * F.coalesce(F.col(f"z_{k}"), F.lit(0.0)) for k, w in weights.items() if f"z_{k}" in df.columns]
    return df.withColumn(name, logistic(reduce(lambda a, b: a + b, parts, F.lit(0.0))))
