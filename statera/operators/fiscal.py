"""Tax and transfer rules over population tables, interval events over ticks, and panel aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statera.functions.expressions import clip, col, floor_at_zero
from statera.functions.ranking import rank_in_group, with_group
from statera.operators.distribution import quantile_points

#: Largest number of interval events that a tick table is joined with by broadcast; more go through an equi-join on ticks.
BROADCAST_EVENTS = 10_000
#: Policies that are broadcast together.
BROADCAST_POLICIES = 10_000
POLICY_SCHEMA = "policy string, brackets array<struct<threshold:double,rate:double>>, base_deduction double, child_subsidy double, unemployment_benefit double"


def progressive_tax(taxable: Column, brackets: Column) -> Column:
    """Tax of an array of (threshold, rate): each rate holds from the threshold before up to its own, the last one also beyond.

    Income at or below 0 and an empty list give 0; NULL income gives NULL.
    """
    start = F.struct(F.lit(0.0).alias("low"), F.lit(0.0).alias("tax"), F.lit(0.0).alias("rate"))
    step = lambda acc, b: F.struct(b["threshold"].alias("low"), (acc["tax"] + F.greatest(F.least(taxable, b["threshold"]) - acc["low"], F.lit(0.0)) * b["rate"]).alias("tax"), b["rate"].alias("rate"))
    done = lambda acc: acc["tax"] + F.greatest(taxable - acc["low"], F.lit(0.0)) * acc["rate"]
    return F.when(taxable.isNotNull(), F.aggregate(F.array_sort(brackets), start, step, done))


def apply_policy(population: DataFrame) -> DataFrame:
    """``population`` (gross_income, employment_status, num_children if any, and a policy's columns) with taxable_income, tax_paid, transfers, net_income, disposable_income."""
    missing = {"gross_income", "employment_status", "brackets"} - set(population.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    children = F.coalesce(F.col("num_children"), F.lit(0)) if "num_children" in population.columns else F.lit(0)
    idle = F.coalesce(F.lower("employment_status") == "unemployed", F.lit(False)).cast("double")
    out = population.withColumn("taxable_income", floor_at_zero(F.col("gross_income") - F.col("base_deduction")))
    out = out.withColumns({"tax_paid": progressive_tax(F.col("taxable_income"), F.col("brackets")), "transfers": children * F.col("child_subsidy") + idle * F.col("unemployment_benefit")})
    out = out.withColumn("net_income", F.col("gross_income") - F.col("tax_paid") + F.col("transfers"))
    return out.withColumn("disposable_income", floor_at_zero(F.col("net_income")))


def adjust_policy(rows: DataFrame) -> DataFrame:
    """Policy columns after an adjustment (deduction_delta, subsidy_multiplier, benefit_multiplier; NULL: none), none below 0."""
    given = lambda c, default: F.coalesce(F.col(c), F.lit(default))
    return rows.withColumns({
        "base_deduction": floor_at_zero(F.col("base_deduction") + given("deduction_delta", 0.0)),
        "child_subsidy": floor_at_zero(F.col("child_subsidy") * given("subsidy_multiplier", 1.0)),
        "unemployment_benefit": floor_at_zero(F.col("unemployment_benefit") * given("benefit_multiplier", 1.0)),
    })


def policy_table(policies: DataFrame, keys: Sequence[str] = ("policy",)) -> DataFrame:
    """A policy's brackets as rows (threshold, rate), by threshold."""
    return policies.select(*keys, F.explode(F.array_sort("brackets")).alias("b")).select(*keys, "b.threshold", "b.rate").orderBy(*keys, "threshold")


def validate_policy(policies: DataFrame) -> DataFrame:
    """The policies that break a rule: a bracket without positive threshold or rate in [0, 1], no brackets, a negative amount, an end before the start."""
    amounts = [c for c in ("base_deduction", "child_subsidy", "unemployment_benefit") if c in policies.columns]
    bad = F.coalesce(F.size("brackets") == 0, F.lit(True)) | F.coalesce(F.exists("brackets", lambda b: ~((b["threshold"] > 0) & (b["rate"] >= 0) & (b["rate"] <= 1))), F.lit(True))
    for c in amounts:
        bad = bad | F.coalesce(F.col(c) < 0, F.lit(False))
    if {"start_tick", "end_tick"} <= set(policies.columns):
        bad = bad | F.coalesce(F.col("end_tick") < F.col("start_tick"), F.lit(False))
    return policies.where(bad)


def consumption(df: DataFrame, low: float = 0.85, high: float = 0.65, approx: bool = False) -> DataFrame:
    """``df`` with consumption: disposable_income times ``low`` up to the table's median, ``high`` above."""
    median = quantile_points(df, "disposable_income", 2, approx=approx).select(F.get("points", F.lit(1)).alias("__median"))
    share = F.when(F.col("disposable_income") <= F.col("__median"), low).otherwise(high)
    return df.join(F.broadcast(median), F.lit(True), "left").withColumn("consumption", F.col("disposable_income") * share).drop("__median")


def policy_grid(population: DataFrame, policies: DataFrame) -> DataFrame:
    """(policy, agents, tax, transfers, disposable, balance): every agent under every policy, summed at once.

    Policies are broadcast, in as many parts as keep each to about BROADCAST_POLICIES; agents are never stored once for each of them.
    """
    parts = max(1, -(-policies.count() // BROADCAST_POLICIES))
    if parts > 1:
        part = F.pmod(F.xxhash64("policy"), F.lit(parts))
        return reduce(DataFrame.unionByName, (_policy_sums(population, policies.where(part == i)) for i in range(parts)))
    return _policy_sums(population, policies)


def _policy_sums(population: DataFrame, policies: DataFrame) -> DataFrame:
    out = apply_policy(population.join(F.broadcast(policies), how="cross"))
    sums = out.groupBy("policy").agg(F.count("*").alias("agents"), F.sum("tax_paid").alias("tax"), F.sum("transfers").alias("transfers"), F.sum("disposable_income").alias("disposable"))
    return sums.withColumn("balance", F.col("tax") - F.col("transfers"))


def event_timeline(ticks: DataFrame, events: DataFrame) -> DataFrame:
    """Every tick with each event active then (start_tick to end_tick, both included; NULL end: open); a tick without any stays once.

    Few events are broadcast. Many are cut into dyadic ranges of ticks, aligned ones whose length is a power of two: an interval is the union of at
    most two for each power, and a tick lies in one of each, so an equi-join on them meets every active event once, whatever its length.
    """
    live = events.withColumn("__end", F.coalesce(F.col("end_tick").cast("long"), F.lit(2**62)))
    within = F.col("tick").between(F.col("start_tick"), F.col("__end"))
    if events.limit(BROADCAST_EVENTS + 1).count() <= BROADCAST_EVENTS:
        return ticks.join(F.broadcast(live), within, "left").drop("__end")
    low, high = ticks.agg(F.min("tick"), F.max("tick")).first()
    if low is None:
        return ticks.join(live.limit(0), within, "left").drop("__end")
    levels = F.sequence(F.lit(0), F.lit((int(high) - int(low) + 1).bit_length()))
    # from the first tick on: [start, stop) at level k is cut to whole ranges of 2^k ticks, and an odd one at an end is one of the interval's
    start, stop = F.greatest(F.col("start_tick"), F.lit(low)).cast("long") - low, F.least(F.col("__end"), F.lit(high)).cast("long") + 1 - low
    half = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)
    first, last = (lambda k: F.ceil(start / half(k)).cast("long")), (lambda k: F.floor(stop / half(k)).cast("long"))
    odd = lambda c: F.pmod(c, F.lit(2)) == 1
    node = lambda k, at, own: F.when((first(k) < last(k)) & own, F.struct(k.alias("level"), at.alias("at")))
    nodes = F.filter(F.flatten(F.transform(levels, lambda k: F.array(node(k, first(k), odd(first(k))), node(k, last(k) - 1, odd(last(k)))))), lambda x: x.isNotNull())
    cut = live.where(F.col("start_tick").isNotNull() & (start < stop)).withColumn("__node", F.explode(nodes)).drop("__end")
    own = ticks.withColumn("__node", F.explode(F.transform(levels, lambda k: F.struct(k.alias("level"), F.floor((F.col("tick").cast("long") - low) / half(k)).cast("long").alias("at")))))
    met = own.join(cut, "__node").drop("__node")
    idle = ticks.join(met.select(F.col("tick").alias("__tick")).distinct(), F.col("tick") == F.col("__tick"), "left_anti")
    return met.unionByName(idle.join(events.limit(0), F.lit(True), "left"))


def event_adjustment(timeline: DataFrame) -> DataFrame:
    """For each tick: event_names in order of start, economic_intensity, inflation_delta, and the combined adjustment (NULL if no event has one)."""
    active = F.col("name").isNotNull()
    term = lambda c: F.coalesce(F.sum(F.when(active, F.col("intensity") * F.col(c))), F.lit(0.0))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(active, F.struct("start_tick", "name")))), lambda x: x["name"]), ", ")
    return timeline.groupBy("tick").agg(
        F.count_if(active).alias("active"), names.alias("event_names"), term("economic_multiplier").alias("economic_intensity"), term("inflation_pressure").alias("inflation_delta"),
        F.sum("deduction_delta").alias("deduction_delta"), F.product("subsidy_multiplier").alias("subsidy_multiplier"), F.product("benefit_multiplier").alias("benefit_multiplier"),
        F.max(F.when(active & F.col("end_tick").isNull(), 1).otherwise(0)).alias("open_end"), F.max("end_tick").alias("last_end"),
    )


def composite_shock(adjusted: DataFrame, base: tuple[str, float, int, int | None] | None = None) -> DataFrame:
    """tick, shock, shock_intensity, shock_start, shock_end of :func:`event_adjustment` rows.

    Without active events the base shock (name, intensity, start, end) stands, or NULL. With them a base gets their intensity added, within
    -5 to 5, and starts no later than the tick; without a base the shock starts at the tick and ends with the last event, never if one is open.
    """
    busy = F.col("active") > 0
    if base:
        name, intensity, start, end = base
        level = F.when(busy, clip(F.lit(float(intensity)) + F.col("economic_intensity"), -5.0, 5.0)).otherwise(F.lit(float(intensity)))
        first = F.when(busy, F.least(F.lit(start).cast("long"), F.col("tick").cast("long"))).otherwise(F.lit(start).cast("long"))
        return adjusted.select("tick", F.lit(name).alias("shock"), level.alias("shock_intensity"), first.alias("shock_start"), F.lit(end).cast("long").alias("shock_end"))
    return adjusted.select(
        "tick", F.when(busy, "GlobalEvents").alias("shock"), F.when(busy, clip(F.col("economic_intensity"), -5.0, 5.0)).alias("shock_intensity"), F.when(busy, F.col("tick").cast("long")).alias("shock_start"),
        F.when(busy & (F.col("open_end") == 0), F.col("last_end").cast("long")).alias("shock_end"),
    )


def fiscal_timeline(panel: DataFrame) -> DataFrame:
    """For each tick: tax_revenue, transfer_spending, budget_balance, consumption, mean_consumption, employment_rate, unemployment_rate."""
    rate = F.avg(F.coalesce(F.lower("employment_status") == "employed", F.lit(False)).cast("double"))
    out = panel.groupBy("tick").agg(F.sum("tax_paid").alias("tax_revenue"), F.sum("transfers").alias("transfer_spending"), F.sum("consumption").alias("consumption"), F.avg("consumption").alias("mean_consumption"), rate.alias("employment_rate"))
    return out.withColumns({"budget_balance": F.col("tax_revenue") - F.col("transfer_spending"), "unemployment_rate": 1 - F.col("employment_rate")})


def agent_metrics(panel: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """For each agent over its ticks: average_disposable, final_disposable, average_consumption, total_tax, total_transfers, baseline_disposable, delta_disposable.

    The baseline (agent_id, baseline_disposable) defaults to the agent's first tick.
    """
    out = panel.groupBy("agent_id").agg(
        F.avg("disposable_income").alias("average_disposable"), F.max_by("disposable_income", "tick").alias("final_disposable"), F.avg("consumption").alias("average_consumption"), F.sum("tax_paid").alias("total_tax"), F.sum("transfers").alias("total_transfers"),
        F.min_by("disposable_income", "tick").alias("baseline_disposable"),
    )
    if baseline is not None:
        out = out.drop("baseline_disposable").join(baseline.select("agent_id", "baseline_disposable"), "agent_id", "left")
    return out.withColumn("delta_disposable", F.col("average_disposable") - F.col("baseline_disposable"))


def sentiment_index(timeline: DataFrame, run: str = "run_id") -> DataFrame:
    """``timeline`` (run, tick, mean_disposable, baseline_disposable, employment_rate, cpi) with sentiment in 0 to 100.

    55, plus 45 times the income's change against the baseline, plus 35 times the rise in employment, minus 20 times inflation; the first
    tick has no rise, and its inflation is against 100.
    """
    by_tick = W.partitionBy(run).orderBy("tick")
    before = lambda c: F.lag(c).over(by_tick)
    first = F.row_number().over(by_tick) == 1
    income = F.when(F.col("baseline_disposable") == 0, 0.0).otherwise((F.col("mean_disposable") - F.col("baseline_disposable")) / F.col("baseline_disposable"))
    rise = F.when(first, 0.0).otherwise(F.col("employment_rate") - before("employment_rate"))
    prices = F.when(first | (before("cpi") == 0), (F.col("cpi") - 100.0) / 100.0).otherwise((F.col("cpi") - before("cpi")) / before("cpi"))
    return timeline.withColumn("sentiment", clip(55 + 45 * income + 35 * rise - 20 * prices, 0.0, 100.0))


def quota_top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], rate: float, cap: int | None = None) -> DataFrame:
    """Of each group the first round(rows * rate) rows in the order (half-even, at most ``cap``)."""
    quota = F.bround(F.count("*") * rate, 0)
    quotas = df.groupBy(*map(col, group)).agg((quota if cap is None else F.least(quota, F.lit(float(cap)))).alias("__quota"))
    ranked = rank_in_group(df, group, order, "__n")
    return with_group(ranked, quotas, group).where("__n <= __quota").drop("__n", "__quota")
