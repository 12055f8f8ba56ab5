"""Comparison of a baseline with scenarios and reforms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statera.functions.expressions import col
from statera.operators.distribution import gini, mean_by_quantile, sentiment_by_quantile, winners_losers
from statera.operators.timeseries import last_tick

HEADLINE = ("tax_revenue", "transfer_spending", "budget_balance", "unemployment_rate", "employment_rate", "cpi", "sentiment")
KPIS = (*HEADLINE, "gini_pre", "gini_post")


def scenario_delta(base: DataFrame, scenario: DataFrame, keys: Sequence[str], value: str = "probability") -> DataFrame:
    """keys, baseline, scenario, delta; a key on one side only has a NULL delta."""
    a = base.select(*keys, col(value).alias("baseline"))
    b = scenario.select(*keys, col(value).alias("scenario"))
    return a.join(b, list(keys), "full_outer").withColumn("delta", F.col("scenario") - F.col("baseline"))


def decile_delta(base: DataFrame, reform: DataFrame) -> DataFrame:
    """decile, base, reform, delta, sign of two tables (decile, value): a missing base is 0, a missing reform the base."""
    both = base.select("decile", F.col("value").alias("b")).join(reform.select("decile", F.col("value").alias("r")), "decile", "full_outer")
    out = both.select("decile", F.coalesce("b", F.lit(0.0)).alias("base"), F.coalesce("r", "b", F.lit(0.0)).alias("reform"))
    out = out.withColumn("delta", F.col("reform") - F.col("base"))
    return out.withColumn("sign", F.when(F.col("delta") >= 0, "positive").otherwise("negative"))


def ab_timeline(base: DataFrame, reform: DataFrame, metric: str) -> DataFrame:
    """tick, base, reform: a metric side by side on the base's ticks."""
    return base.select("tick", col(metric).alias("base")).join(reform.select("tick", col(metric).alias("reform")), "tick", "left")


def long_ab(base: DataFrame, reform: DataFrame | None, metrics: Sequence[str]) -> DataFrame:
    """(period, metric, value, scenario) of both timelines under each other."""

    def melted(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(F.col("tick").alias("period"), *(col(m).cast("double").alias(m) for m in metrics))
        return rows.unpivot("period", list(metrics), "metric", "value").withColumn("scenario", F.lit(name))

    out = melted(base, "base")
    return out if reform is None else out.unionByName(melted(reform, "reform"))


def decile_frame(df: DataFrame, map_column: str, scenario: str) -> DataFrame:
    """(decile, value, scenario) of a map decile_<n> to value, by n."""
    rows = df.select(F.explode(map_column).alias("decile", "value"))
    return rows.withColumn("scenario", F.lit(scenario)).orderBy(F.substring_index("decile", "_", -1).cast("int"))


def scenario_kpis(timeline: DataFrame, agents: DataFrame, run: str = "run_id") -> DataFrame:
    """One row for each run: the last tick's headline values, gini_pre and gini_post."""
    last = last_tick(timeline, run).select(run, *HEADLINE)
    incomes = agents.select(col(run), F.explode(F.array(*(F.struct(F.lit(name).alias("__kpi"), col(c).cast("double").alias("__income")) for name, c in (("gini_pre", "baseline_disposable"), ("gini_post", "average_disposable"))))).alias("__i"))
    both = gini(incomes.select(col(run), "__i.*"), "__income", [run, "__kpi"])  # one ranking for both
    sides = both.groupBy(run).agg(*(F.max(F.when(F.col("__kpi") == name, F.col("gini"))).alias(name) for name in ("gini_pre", "gini_post")))
    return last.join(sides, run, "left").fillna(0.0, ["gini_pre", "gini_post"])


def kpi_tables(agents: DataFrame) -> dict[str, DataFrame]:
    """One run's consumption and sentiment by decile, and its winners and losers."""
    return {"consumption_by_decile": mean_by_quantile(agents, "average_consumption"), "sentiment_by_decile": sentiment_by_quantile(agents, "average_disposable"), "winners_losers": winners_losers(agents)}


def kpi_delta(base: DataFrame, reform: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Reform minus base of each KPI, for each key (without keys: of two one-row tables)."""
    a, b = (df.select(*keys, *(col(k).cast("double").alias(f"{side}_{k}") for k in KPIS)) for df, side in ((base, "a"), (reform, "b")))
    both = a.join(b, list(keys)) if keys else a.join(F.broadcast(b))
    return both.select(*keys, *((F.col(f"b_{k}") - F.col(f"a_{k}")).alias(k) for k in KPIS))


def best_run(kpis: DataFrame, reward: Column, order: str) -> DataFrame:
    """The row of the largest reward with it as ``reward``; of equal ones the first by ``order``."""
    rows = kpis.withColumn("reward", reward).where("reward is not null")
    best = rows.agg(F.max_by(F.struct(*rows.columns), F.struct(F.col("reward"), (-col(order)).alias("o"))).alias("r"))
    return best.where("r is not null").select("r.*")


def apply_intervention(features: DataFrame, deltas: Mapping[str, float]) -> DataFrame:
    """Feature rows (feature, ..., value) with a constant added to the features named."""
    pairs = [F.lit(x) for k, v in deltas.items() for x in (k, float(v))]
    shift = F.coalesce(F.element_at(F.create_map(*pairs), F.col("feature")), F.lit(0.0)) if pairs else F.lit(0.0)
    return features.withColumn("value", F.col("value") + shift)
