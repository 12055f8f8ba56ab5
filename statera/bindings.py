"""The given tables in the shapes that the operators take, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from statera.sources.tables import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: A click stream as an event feed. Every seventh event has no country.
EVENTS = """
SELECT CAST(event_id AS VARCHAR(20)) AS event_id, ts AS event_date, CASE WHEN event_id % 7 = 0 THEN NULL ELSE upper(event_type) END AS country,
  concat('U', CAST(user_id % 20 AS VARCHAR(20))) AS actor1_country, concat('U', CAST(user_id % 7 AS VARCHAR(20))) AS actor2_country,
  CASE WHEN user_id % 5 = 0 THEN '' ELSE concat('user ', CAST(user_id AS VARCHAR(20))) END AS actor1, event_type AS actor2,
  concat(event_type, ';', props) AS themes, CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('http://host/', CAST(event_id AS VARCHAR(20))) END AS source_url,
  CAST(user_id % 9 AS DOUBLE) AS num_articles, value / 10 - 5 AS tone, value / 20 AS goldstein,
  CAST(user_id % 90 AS DOUBLE) AS latitude, CAST(user_id % 180 AS DOUBLE) AS longitude
FROM {events}
"""
#: Deliveries as interactions of the supplier's and the customer's nation.
TRADE = """
SELECT l_orderkey AS event_id, l_shipdate AS event_date, s.n_name AS actor1_country, c.n_name AS actor2_country, l_quantity AS num_articles, l_discount AS tone, l_tax * 10 AS goldstein
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON l_suppkey = s_suppkey
  JOIN {nation} s ON s_nationkey = s.n_nationkey JOIN {nation} c ON c_nationkey = c.n_nationkey
"""
#: Customers as a population with one policy.
POPULATION = """
SELECT c_custkey AS agent_id, c_acctbal * 5 + 10000 AS gross_income, CAST(c_custkey % 4 AS INT) AS num_children,
  CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_mktsegment = 'BUILDING' THEN 'Unemployed' ELSE 'employed' END AS employment_status, c_mktsegment AS sector
FROM {customer}
"""
#: Lines as a panel of suppliers over years.
PANEL = """
SELECT l_suppkey AS agent_id, CAST(year(l_shipdate) - 1995 AS INT) AS tick, l_extendedprice AS disposable_income, l_extendedprice * l_tax AS tax_paid, l_quantity * 10 AS transfers,
  l_extendedprice * 0.7 AS consumption, CASE WHEN l_returnflag = 'R' THEN 'unemployed' WHEN l_returnflag = 'A' THEN NULL ELSE 'Employed' END AS employment_status
FROM {lineitem}
"""
#: Events as predictions of two models.
PREDICTIONS = """
SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS model, event_type AS country, ts AS date, event_id,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE 1 / (1 + exp(-(value - 50) / 25)) END AS probability, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_type = 'error' THEN 1 ELSE 0 END AS outcome
FROM {events}
"""
#: Daily means by event type: one row for each day and entity.
DAILY = "SELECT CAST(ts AS DATE) AS date, event_type AS entity, avg(value) AS value FROM {events} GROUP BY CAST(ts AS DATE), event_type"
#: Order values by status as an indicator series; every fifth order has no value.
SERIES = "SELECT o_orderdate AS date, o_orderstatus AS country, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS value FROM {orders}"
#: Numeric features of customers in long form, to be explained by whether the customer's number is divisible by ten.
LONG = """
SELECT 'balance' AS feature, c_custkey AS "order", CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END AS label, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal END AS value FROM {customer}
UNION ALL SELECT 'nation', c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END, CAST(c_nationkey AS DOUBLE) FROM {customer}
UNION ALL SELECT 'parity', c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END, CAST(c_custkey % 2 AS DOUBLE) FROM {customer}
"""
#: Yearly timelines by order status, as runs.
RUNS = """
SELECT o_orderstatus AS run_id, CAST(year(o_orderdate) - 1995 AS INT) AS tick, sum(o_totalprice) AS tax_revenue, sum(o_totalprice) * 0.4 AS transfer_spending, sum(o_totalprice) * 0.6 AS budget_balance,
  CAST(count(*) % 7 AS DOUBLE) / 10 AS unemployment_rate, 1 - CAST(count(*) % 7 AS DOUBLE) / 10 AS employment_rate, 95 + CAST(count(*) % 11 AS DOUBLE) AS cpi, 40 + CAST(count(*) % 40 AS DOUBLE) AS sentiment,
  avg(o_totalprice) AS mean_disposable, 150000 + 0.0 AS baseline_disposable
FROM {orders} GROUP BY o_orderstatus, year(o_orderdate)
"""
#: Agents of those runs.
AGENTS = """
SELECT o_orderstatus AS run_id, o_custkey AS agent_id, min(o_totalprice) AS baseline_disposable, avg(o_totalprice) AS average_disposable, avg(o_totalprice) * 0.7 AS average_consumption, avg(o_totalprice) - min(o_totalprice) AS delta_disposable
FROM {orders} GROUP BY o_orderstatus, o_custkey
"""
#: Policies: base and reform. Fixed values.
POLICIES = (("base", ((30000.0, 0.18), (75000.0, 0.28)), 5000.0, 120.0, 900.0), ("reform", ((35000.0, 0.16), (80000.0, 0.26)), 5500.0, 180.0, 900.0))
#: Interval events: name, intensity, start, end, economic multiplier, inflation pressure, deduction change, subsidy and benefit multipliers. Fixed values.
INTERVALS = (("Energy Crisis", 0.6, 1, 3, 0.8, 0.12, 100.0, 1.1, 1.5), ("Drought", 0.4, 2, 2, 0.5, 0.3, None, None, None), ("Aid", 0.9, 3, None, 1.2, 0.05, -50.0, 1.2, 0.9))
INTERVAL_SCHEMA = "name string, intensity double, start_tick int, end_tick int, economic_multiplier double, inflation_pressure double, deduction_delta double, subsidy_multiplier double, benefit_multiplier double"


def bound(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A binding over the tables of a folder."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in sql}
    return spark.sql(sql.replace('"order"', "`order`"), **used)


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGENTS with means that no order of rows changes: sums go through decimals where the prices fit.

    Doubles summed in another order differ in their last bits, so equal agents would lie on both sides of a quantile that falls among them.
    """
    exact = "TRY_CAST(o_totalprice AS DECIMAL(28, 9))"
    mean = f"CASE WHEN count({exact}) = count(o_totalprice) THEN CAST(sum({exact}) AS DOUBLE) / count(o_totalprice) ELSE avg(o_totalprice) END"
    return bound(spark, sf_dir, AGENTS.replace("avg(o_totalprice)", mean))


def oracle(sql: str) -> str:
    """A binding for DuckDB."""
    return sql.format(**{t: t for t in TABLES})


def policies(spark: SparkSession) -> DataFrame:
    """The policies as rows."""
    rows = [f"SELECT '{p}' AS policy, array({', '.join(f'named_struct("threshold", {t}D, "rate", {r}D)' for t, r in b)}) AS brackets, {d}D AS base_deduction, {c}D AS child_subsidy, {u}D AS unemployment_benefit" for p, b, d, c, u in POLICIES]
    return spark.sql(" UNION ALL ".join(rows))


def _sql_value(x: object) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


def intervals(spark: SparkSession) -> DataFrame:
    """The interval events as rows."""
    values = ", ".join("(" + ", ".join(map(_sql_value, r)) + ")" for r in INTERVALS)
    names = [f.split()[0] for f in INTERVAL_SCHEMA.split(", ")]
    kinds = dict(f.split() for f in INTERVAL_SCHEMA.split(", "))
    casts = ", ".join(f"CAST({n} AS {kinds[n]}) AS {n}" for n in names)
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({', '.join(names)})")


INTERVALS_SQL = "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(_sql_value(x) for x in r) + ")" for r in INTERVALS) + ") AS t(" + ", ".join(f.split()[0] for f in INTERVAL_SCHEMA.split(", ")) + "))"
