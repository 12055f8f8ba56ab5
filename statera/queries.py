"""The registered queries on the given tables, each with the SQL of the same result where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statera import bindings as B
from statera.bindings import bound, oracle
from statera.operators import clean, distribution, evaluate, evidence, fiscal, graph, layers, ml, scenario, timeseries
from statera.plans import risk
from statera.sources import feeds, runs, sinks
from statera.sources.storage import fresh_path, materialise
from statera.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as sums of doubles differ in their last bits; no negative zero."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) + F.lit(0.0) for c in doubles}) if doubles else df


def query(name: str, sql: str | None = None, digits: int = 6) -> Callable[[Query], Query]:
    """Register a query under a name, with its SQL; doubles are rounded to ``digits``."""

    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share."""
    return fresh_path(spark, "query")


EV, TR, POP, PANEL, PRED, DAILY, SERIES, LONG, RUNS, AGENTS = map(oracle, (B.EVENTS, B.TRADE, B.POPULATION, B.PANEL, B.PREDICTIONS, B.DAILY, B.SERIES, B.LONG, B.RUNS, B.AGENTS))


# --- graphs ---------------------------------------------------------------------------------------------------------

EDGES = f"""SELECT actor1_country AS source, actor2_country AS target, count(DISTINCT event_id) AS events, sum(num_articles) AS weight, avg(tone) AS avg_tone, avg(goldstein) AS avg_goldstein, min(event_date) AS first_seen, max(event_date) AS last_seen
FROM ({TR}) WHERE actor1_country <> actor2_country GROUP BY ALL"""


@query("graph_edges", f"SELECT source, target, events, round(weight, 9) AS weight, round(avg_tone, 9) AS avg_tone, round(avg_goldstein, 9) AS avg_goldstein, first_seen, last_seen FROM ({EDGES})", digits=9)
def graph_edges(spark, d):
    return graph.graph_edges(bound(spark, d, B.TRADE))


@query("graph_nodes", f"""WITH e AS ({EDGES}), r AS (SELECT source AS state, 'out' AS role, events, weight FROM e UNION ALL SELECT target, 'in', events, weight FROM e)
SELECT state, count(*) AS degree, count(*) FILTER (role = 'out') AS out_degree, CAST(coalesce(sum(events) FILTER (role = 'out'), 0) AS BIGINT) AS out_events, round(coalesce(sum(weight) FILTER (role = 'out'), 0), 6) AS out_weight,
  count(*) FILTER (role = 'in') AS in_degree, CAST(coalesce(sum(events) FILTER (role = 'in'), 0) AS BIGINT) AS in_events, round(coalesce(sum(weight) FILTER (role = 'in'), 0), 6) AS in_weight,
  CAST(sum(events) AS BIGINT) AS total_events, round(sum(weight), 6) AS total_weight FROM r GROUP BY state""")
def graph_nodes(spark, d):
    return graph.graph_nodes(graph.graph_edges(bound(spark, d, B.TRADE)))


@query("state_graph_filtered", f"""WITH e AS (SELECT actor1_country AS source, actor2_country AS target, count(DISTINCT event_id) AS events, sum(num_articles) AS weight FROM ({TR}) GROUP BY ALL HAVING count(DISTINCT event_id) >= 5 AND sum(num_articles) >= 100)
SELECT state, count(*) AS ends, round(sum(weight), 6) AS total_weight FROM (SELECT source AS state, weight FROM e UNION ALL SELECT target, weight FROM e) GROUP BY state""")
def state_graph_filtered(spark, d):
    _, nodes = graph.state_graph(bound(spark, d, B.TRADE), min_events=5, min_weight=100, self_loops=True)
    return nodes.select("state", (F.col("out_degree") + F.col("in_degree")).alias("ends"), "total_weight")


@query("country_summary", f"""SELECT coalesce(country, 'GLOBAL') AS country, count(DISTINCT event_id) AS events, round(sum(num_articles), 6) AS articles, round(avg(tone), 6) AS avg_tone, count(*) FILTER (tone > 1) AS positive, count(*) FILTER (tone < -1) AS negative, round(avg(latitude), 6) AS latitude, round(avg(longitude), 6) AS longitude
FROM ({EV}) GROUP BY 1""")
def country_summary(spark, d):
    return graph.country_summary(bound(spark, d, B.EVENTS))


@query("headline", f"SELECT count(*) AS events, count(DISTINCT country) AS countries, round(avg(tone), 6) AS mean_tone FROM ({EV})")
def headline(spark, d):
    return graph.headline(bound(spark, d, B.EVENTS))


@query("edge_geo", f"""WITH e AS ({EDGES}), p AS (SELECT n_name AS country, n_nationkey * 1.5 AS latitude, CASE WHEN n_nationkey % 6 = 5 THEN NULL ELSE n_nationkey * 2.5 END AS longitude FROM nation)
SELECT source, target, events, round(weight, 6) AS weight, CAST(a.latitude AS DOUBLE) AS source_lat, CAST(a.longitude AS DOUBLE) AS source_lon, CAST(b.latitude AS DOUBLE) AS target_lat, CAST(b.longitude AS DOUBLE) AS target_lon
FROM e JOIN p a ON source = a.country JOIN p b ON target = b.country WHERE (source = 'NATION_3' OR target = 'NATION_3') AND a.longitude IS NOT NULL AND b.longitude IS NOT NULL""")
def edge_geo(spark, d):
    places = table(spark, d, "nation").select(F.col("n_name").alias("country"), (F.col("n_nationkey") * 1.5).alias("latitude"), F.when(F.col("n_nationkey") % 6 != 5, F.col("n_nationkey") * 2.5).alias("longitude"))
    out = graph.edge_geo(graph.graph_edges(bound(spark, d, B.TRADE)), places, "NATION_3")
    return out.select("source", "target", "events", "weight", "source_lat", "source_lon", "target_lat", "target_lon")


# --- events ---------------------------------------------------------------------------------------------------------

@query("event_filter", f"SELECT event_id, country, round(tone, 6) AS tone FROM ({EV}) WHERE (lower(themes) LIKE '%click%' OR lower(themes) LIKE '%error%') AND country IN ('CLICK', 'ERROR') AND list_contains(string_split(themes, ';'), 'error') AND tone > -4 AND tone < 3")
def event_filter(spark, d):
    keep = clean.event_filter(keywords=["Click", "error"], countries=["click", "error"], themes=["error"], tone_min=-4, tone_max=3)
    return bound(spark, d, B.EVENTS).where(keep).select("event_id", "country", "tone")


@query("recent_events", f"SELECT event_id, event_date, country, round(tone, 6) AS tone FROM ({EV}) WHERE event_date BETWEEN TIMESTAMP '2024-01-13' AND TIMESTAMP '2024-01-20' AND tone > 0 ORDER BY event_date DESC, event_id LIMIT 100")
def recent_events(spark, d):
    out = clean.recent_events(bound(spark, d, B.EVENTS), datetime(2024, 1, 20), 7, clean.event_filter(tone_min=0), limit=100)
    return out.select("event_id", "event_date", "country", "tone")


TABLE = f"""SELECT event_id, strftime(event_date, '%Y-%m-%d %H:%M') AS date, coalesce(country, 'GLOBAL') AS country, concat(CASE WHEN actor1 = '' THEN 'Unknown' ELSE actor1 END, ' ↔ ', actor2) AS interaction,
  trim(string_split(themes, ';')[1]) AS main_theme, CAST(num_articles AS BIGINT) AS articles, CAST(tone AS DOUBLE) AS mean_tone,
  CASE WHEN tone >= 3 THEN 'very positive' WHEN tone >= 1 THEN 'positive' WHEN tone <= -3 THEN 'very negative' WHEN tone <= -1 THEN 'negative' ELSE 'neutral' END AS sentiment,
  CAST(goldstein AS DOUBLE) AS goldstein, nullif(source_url, '') AS source_url, actor1_country, actor2_country
FROM (SELECT * REPLACE (round_even(CAST(round(tone, 6) AS DECIMAL(18, 6)), 2) AS tone, round_even(CAST(round(goldstein, 6) AS DECIMAL(18, 6)), 2) AS goldstein) FROM ({EV}))"""


def _shown(spark, d):
    """The event table. Tones are given to six digits, as a half cent is not exact in a double."""
    return clean.event_table(bound(spark, d, B.EVENTS).withColumns({c: F.round(c, 6) for c in ("tone", "goldstein")}))


@query("event_table", TABLE)
def event_table(spark, d):
    return _shown(spark, d)


@query("filter_event_table", f"""SELECT event_id, country, interaction, main_theme, mean_tone, sentiment FROM ({TABLE})
WHERE (country IN ('ERROR', 'U3') OR actor1_country IN ('ERROR', 'U3') OR actor2_country IN ('ERROR', 'U3')) AND sentiment IN ('positive', 'very positive', 'neutral') AND (contains(lower(interaction), 'user 1') OR contains(lower(main_theme), 'user 1')) AND mean_tone BETWEEN -0.5 AND 4""")
def filter_event_table(spark, d):
    out = clean.filter_event_table(_shown(spark, d), ["error", "u3"], ["positive", "very positive", "neutral"], " User 1", (-0.5, 4))
    return out.select("event_id", "country", "interaction", "main_theme", "mean_tone", "sentiment")


@query("serialise_columns", f"SELECT event_id, strftime(event_date, '%Y-%m-%dT%H:%M:%S') AS event_date, country FROM ({EV}) ORDER BY event_id LIMIT 500")
def serialise_columns(spark, d):
    out = clean.serialise_columns(bound(spark, d, B.EVENTS).select("event_id", "event_date", "country"), 500, [F.col("event_id")])
    return out.drop("record")


@query("drop_duplicates", "SELECT DISTINCT event_type, user_id FROM events")
def drop_duplicates(spark, d):
    return table(spark, d, "events").select("event_type", "user_id").dropDuplicates()


@query("first_of_each", "SELECT CAST(ts AS DATE) AS date, arg_min(event_id, struct_pack(t := ts, i := event_id)) AS event_id FROM events GROUP BY 1")
def first_of_each(spark, d):
    rows = table(spark, d, "events").select(F.to_date("ts").alias("date"), "ts", "event_id")
    return clean.first_of_each(rows, ["date"], [F.col("ts"), F.col("event_id")]).select("date", "event_id")


@query("distinct_values", f"SELECT DISTINCT country FROM ({EV}) WHERE country IS NOT NULL")
def distinct_values(spark, d):
    return clean.distinct_values(bound(spark, d, B.EVENTS), "country")


@query("head", "SELECT n_nationkey, n_name FROM nation ORDER BY n_name DESC LIMIT 7")
def head(spark, d):
    return clean.head(table(spark, d, "nation").select("n_nationkey", "n_name"), 7, [F.col("n_name").desc()])


# --- layers ---------------------------------------------------------------------------------------------------------

def _raw_orders(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias(" Order Date"), F.col("o_orderstatus").alias("Country"), F.format_string("%.2f", "o_totalprice").alias("Total Price"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey").cast("string")).alias("Customer"), F.col("o_orderpriority").alias("customer "))


SILVER = "SELECT DISTINCT CAST(strftime(o_orderdate, '%Y-%m-%d') AS TIMESTAMP) AS order_date, o_orderstatus AS country, o_totalprice AS total_price, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_custkey AS DOUBLE) END AS customer, o_orderpriority AS customer_1 FROM orders"


@query("silver", SILVER)
def silver(spark, d):
    return clean.build_silver(_raw_orders(spark, d))


GOLD = f"SELECT order_date, country, round(avg(total_price), 6) AS total_price, round(avg(customer), 6) AS customer FROM ({SILVER}) GROUP BY ALL"


@query("gold", GOLD)
def gold(spark, d):
    return layers.build_gold(clean.build_silver(_raw_orders(spark, d), ordered=False))


EV_GOLD = f"SELECT event_date, country, avg(num_articles) AS num_articles, avg(tone) AS tone FROM (SELECT date_trunc('day', event_date) AS event_date, country, num_articles, tone FROM ({EV})) GROUP BY ALL"


def _event_gold(spark, d):
    rows = bound(spark, d, B.EVENTS).select(F.date_trunc("day", F.col("event_date").cast("timestamp")).cast("timestamp_ntz").alias("event_date"), "country", "num_articles", "tone")
    return layers.build_gold(rows, ordered=False)


@query("gold_null_keys", f"SELECT event_date, country, round(num_articles, 6) AS num_articles, round(tone, 6) AS tone FROM ({EV_GOLD})")
def gold_null_keys(spark, d):
    return _event_gold(spark, d)


@query("combined_gold", f"SELECT order_date AS date, country, total_price, customer, CAST(NULL AS DOUBLE) AS num_articles, CAST(NULL AS DOUBLE) AS tone, 'orders' AS source FROM ({GOLD}) UNION ALL SELECT event_date, country, NULL, NULL, round(num_articles, 6), round(tone, 6), 'events' FROM ({EV_GOLD})")
def combined_gold(spark, d):
    return layers.combine_gold({"orders": layers.build_gold(clean.build_silver(_raw_orders(spark, d), ordered=False), ordered=False), "events": _event_gold(spark, d)}).select("date", "country", "total_price", "customer", "num_articles", "tone", "source")


@query("layer_counts", " UNION ALL ".join(f"SELECT '{layer}' AS layer, '{t}' AS \"table\", count(*) AS rows FROM {t}" for layer, t in (("bronze", "events"), ("bronze", "orders"), ("silver", "lineitem"), ("silver", "customer"), ("gold", "nation"))))
def layer_counts(spark, d):
    of = lambda *names: {n: table(spark, d, n) for n in names}
    return layers.layer_counts({"bronze": of("events", "orders"), "silver": of("lineitem", "customer"), "gold": of("nation")})


# --- time series ----------------------------------------------------------------------------------------------------

COUNTS = f"SELECT CAST(event_date AS DATE) AS date, country AS entity, count(*) AS value FROM ({EV}) WHERE country IS NOT NULL GROUP BY ALL"


@query("daily_counts", COUNTS)
def daily_counts(spark, d):
    return timeseries.daily_counts(bound(spark, d, B.EVENTS))


def _grid(series: str, fill: str) -> str:
    return f"SELECT a.date, b.entity, {fill} AS value FROM (SELECT DISTINCT date FROM ({series})) a CROSS JOIN (SELECT DISTINCT entity FROM ({series})) b LEFT JOIN ({series}) s ON s.date = a.date AND s.entity = b.entity"


@query("rolling_sum", f"SELECT date, entity, CAST(sum(value) OVER (PARTITION BY entity ORDER BY date ROWS 6 PRECEDING) AS BIGINT) AS value FROM ({_grid(COUNTS, 'coalesce(s.value, 0)')})")
def rolling_sum(spark, d):
    return timeseries.rolling_sum(timeseries.daily_counts(bound(spark, d, B.EVENTS)), 7)


@query("rolling_sum_calendar", f"SELECT date, entity, CAST(sum(value) OVER (PARTITION BY entity ORDER BY date RANGE INTERVAL 2 DAY PRECEDING) AS BIGINT) AS value FROM ({_grid(COUNTS, 'coalesce(s.value, 0)')})")
def rolling_sum_calendar(spark, d):
    return timeseries.rolling_sum(timeseries.daily_counts(bound(spark, d, B.EVENTS)), 3, calendar=True)


CELLS = f"SELECT date, country AS entity, coalesce(sum(value), 0) AS value FROM ({SERIES}) GROUP BY ALL"


@query("country_series", f"SELECT date, entity, round(value, 4) AS value FROM ({CELLS})")
def country_series(spark, d):
    return timeseries.country_series(bound(spark, d, B.SERIES), "value").withColumn("value", F.round("value", 4))


@query("densify_grid", f"SELECT date, entity, round(value, 4) AS value FROM ({_grid(CELLS, 's.value')})")
def densify_grid(spark, d):
    return timeseries.densify_grid(timeseries.country_series(bound(spark, d, B.SERIES), "value"), None).withColumn("value", F.round("value", 4))


@query("rolling_mean", f"SELECT date, entity, round(avg(value) OVER (PARTITION BY entity ORDER BY date ROWS 13 PRECEDING), 6) AS value FROM ({_grid(CELLS, 's.value')})")
def rolling_mean(spark, d):
    return timeseries.rolling_mean(timeseries.country_series(bound(spark, d, B.SERIES), "value"), 14)


@query("forward_fill", f"SELECT date, entity, round(coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY entity ORDER BY date ROWS UNBOUNDED PRECEDING), 0), 4) AS value FROM ({_grid(CELLS, 's.value')})")
def forward_fill(spark, d):
    grid = timeseries.densify_grid(timeseries.country_series(bound(spark, d, B.SERIES), "value"), None)
    return timeseries.forward_fill(grid).withColumn("value", F.round("value", 4))


def _daily_means(spark, d):
    o = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("order_value"))
    x = table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.avg("l_quantity").alias("quantity"))
    return [o, x]


MERGED = """SELECT date, order_value, quantity FROM (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS order_value FROM orders GROUP BY 1)
FULL JOIN (SELECT CAST(l_shipdate AS DATE) AS date, avg(l_quantity) AS quantity FROM lineitem GROUP BY 1) USING (date)"""


@query("merge_indicators", f"SELECT date, round(order_value, 4) AS order_value, round(quantity, 6) AS quantity FROM ({MERGED})")
def merge_indicators(spark, d):
    return feeds.merge_indicators(_daily_means(spark, d)).withColumn("order_value", F.round("order_value", 4))


DENSE = f"""SELECT CAST(day AS DATE) AS date, last_value(order_value IGNORE NULLS) OVER w AS order_value, last_value(quantity IGNORE NULLS) OVER w AS quantity
FROM (SELECT unnest(generate_series((SELECT min(date) FROM ({MERGED})), DATE '2001-12-31', INTERVAL 1 DAY)) AS day) LEFT JOIN ({MERGED}) ON CAST(day AS DATE) = date WINDOW w AS (ORDER BY day ROWS UNBOUNDED PRECEDING)"""


@query("densify_daily", f"SELECT date, round(order_value, 4) AS order_value, round(quantity, 6) AS quantity FROM ({DENSE}) WHERE (order_value IS NOT NULL OR quantity IS NOT NULL) AND date BETWEEN DATE '1996-01-01' AND DATE '2001-12-31'")
def densify_daily(spark, d):
    return feeds.densify_daily(feeds.merge_indicators(_daily_means(spark, d)), date(1996, 1, 1), date(2001, 12, 31)).withColumn("order_value", F.round("order_value", 4))


@query("economic_feature", f"""WITH g AS (SELECT CAST(day AS DATE) AS date, last_value(quantity IGNORE NULLS) OVER w AS quantity, last_value(order_value IGNORE NULLS) OVER w AS order_value
  FROM (SELECT unnest(generate_series((SELECT min(date) FROM ({MERGED})), (SELECT max(date) FROM ({MERGED})), INTERVAL 1 DAY)) AS day) LEFT JOIN ({MERGED}) ON CAST(day AS DATE) = date WINDOW w AS (ORDER BY day ROWS UNBOUNDED PRECEDING)),
k AS (SELECT * FROM g WHERE quantity IS NOT NULL OR order_value IS NOT NULL)
SELECT date, 'quantity' AS entity, round(avg(quantity) OVER (ORDER BY date ROWS 13 PRECEDING), 4) AS value FROM k UNION ALL SELECT date, 'order_value', round(avg(order_value) OVER (ORDER BY date ROWS 13 PRECEDING), 4) FROM k""")
def economic_feature(spark, d):
    return timeseries.economic_feature(feeds.merge_indicators(_daily_means(spark, d)), 14).withColumn("value", F.round("value", 4))


@query("combine_features", f"""SELECT 'events__counts' AS feature, CAST(date AS TIMESTAMP) AS date, entity, CAST(value AS DOUBLE) AS value FROM ({COUNTS})
UNION ALL SELECT 'humanitarian__orders', date, entity, round(coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY entity ORDER BY date ROWS UNBOUNDED PRECEDING), 0), 4) FROM ({_grid(CELLS, 's.value')})""")
def combine_features(spark, d):
    grid = timeseries.densify_grid(timeseries.country_series(bound(spark, d, B.SERIES), "value"), None)
    return timeseries.combine_features({"events": {"counts": timeseries.daily_counts(bound(spark, d, B.EVENTS))}, "humanitarian": {"orders": grid}}).withColumn("value", F.round("value", 4))


@query("latest", f"SELECT date, entity, round(value, 6) AS value FROM ({DAILY}) QUALIFY date = max(date) OVER (PARTITION BY entity)")
def latest(spark, d):
    return timeseries.latest(bound(spark, d, B.DAILY), ("entity",))


@query("latest_outcomes", f"SELECT date, entity, round(value, 6) AS value FROM ({DAILY}) WHERE date = (SELECT max(date) FROM ({DAILY}))")
def latest_outcomes(spark, d):
    return timeseries.latest_outcomes(bound(spark, d, B.DAILY))


Z = f"SELECT date, entity, CASE WHEN stddev_pop(value) OVER w < 1e-6 THEN 0 ELSE (value - avg(value) OVER w) / stddev_pop(value) OVER w END AS z FROM ({DAILY}) WINDOW w AS (PARTITION BY entity)"


@query("zscore", f"SELECT date, entity, round(z, 6) + 0.0 AS z FROM ({Z})")
def zscore(spark, d):
    return timeseries.zscore(bound(spark, d, B.DAILY)).drop("value")


@query("risk_index", f"SELECT date, entity, round(1 / (1 + exp(-(0.6 * z + 0.3 * CASE WHEN entity = 'error' THEN 0 ELSE z / 2 END))), 6) AS risk FROM ({Z})")
def risk_index(spark, d):
    z = timeseries.zscore(bound(spark, d, B.DAILY), name="z_coup").withColumn("z_displacement", F.when(F.col("entity") != "error", F.col("z_coup") / 2))
    return timeseries.risk_index(z).select("date", "entity", "risk")


@query("expanding_splits", """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row, count(*) OVER () AS n FROM orders), s AS (SELECT *, n // 6 AS size FROM r)
SELECT o_orderkey, row, CAST(CASE WHEN row < n - 5 * size THEN 0 ELSE (row - (n - 5 * size)) // size + 1 END AS INT) AS fold FROM s""")
def expanding_splits(spark, d):
    return timeseries.expanding_splits(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), 5, [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", "row", "fold")


# --- distributions --------------------------------------------------------------------------------------------------

def _cut(source: str, value: str, q: int) -> str:
    shares = ", ".join(str(i / q) for i in range(q + 1))
    return f"""(SELECT x.*, CASE WHEN {value} IS NULL THEN NULL ELSE CAST(greatest(len(list_filter(list_distinct(e), lambda y: y < {value})) - 1, 0) AS INT) END AS bin
FROM ({source}) x CROSS JOIN (SELECT quantile_cont({value}, [{shares}]) AS e FROM ({source})))"""


BALANCE = "SELECT c_custkey, c_acctbal FROM customer"


@query("quantile_cut", f"SELECT c_custkey, bin FROM {_cut(BALANCE, 'c_acctbal', 10)}")
def quantile_cut(spark, d):
    return distribution.quantile_cut(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 10).drop("c_acctbal")


@query("mean_by_quantile", f"SELECT bin, round(avg(c_acctbal), 6) AS mean, count(*) AS count FROM {_cut(BALANCE, 'c_acctbal', 10)} GROUP BY bin")
def mean_by_quantile(spark, d):
    return distribution.mean_by_quantile(table(spark, d, "customer"), "c_acctbal", 10)


def _sentiment_sql(weight: float) -> str:
    return f"SELECT bin, round(least(greatest(55 + {weight} * (avg(c_acctbal) - (SELECT avg(c_acctbal) FROM customer)) / (SELECT avg(c_acctbal) FROM customer), 0), 100), 6) AS sentiment FROM {_cut(BALANCE, 'c_acctbal', 10)} GROUP BY bin"


@query("sentiment_by_quantile", _sentiment_sql(40))
def sentiment_by_quantile(spark, d):
    return distribution.sentiment_by_quantile(table(spark, d, "customer"), "c_acctbal")


@query("sentiment_by_decile", _sentiment_sql(45))
def sentiment_by_decile(spark, d):
    return distribution.sentiment_by_decile(table(spark, d, "customer"), "c_acctbal")


@query("winners_losers", f"SELECT bin AS cluster, round(avg(delta_disposable), 4) AS mean_delta, count(*) AS count FROM {_cut(AGENTS, 'delta_disposable', 5)} GROUP BY bin")
def winners_losers(spark, d):
    return distribution.winners_losers(B.agents(spark, d)).withColumn("mean_delta", F.round("mean_delta", 4))


def _gini_sql(source: str, value: str, by: str = "") -> str:
    over = f"PARTITION BY {by} ORDER BY {value}" if by else f"ORDER BY {value}"
    return f"SELECT {by + ',' if by else ''} 2 * sum(i * {value}) / (count(*) * sum({value})) - (count(*) + 1) / count(*) AS gini FROM (SELECT {by + ',' if by else ''} {value}, row_number() OVER ({over}) AS i FROM ({source})) {'GROUP BY ' + by if by else ''}"


@query("gini", f"SELECT round(gini, 6) AS gini FROM ({_gini_sql('SELECT * FROM orders', 'o_totalprice')})")
def gini(spark, d):
    return distribution.gini(table(spark, d, "orders"), "o_totalprice")


@query("gini_by_group", f"SELECT o_orderstatus, round(gini, 6) AS gini FROM ({_gini_sql('SELECT * FROM orders', 'o_totalprice', 'o_orderstatus')})")
def gini_by_group(spark, d):
    return distribution.gini(table(spark, d, "orders"), "o_totalprice", ["o_orderstatus"])


@query("quota_top_k", "SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) WHERE r <= least(round_even(n * 0.1, 0), 40)")
def quota_top_k(spark, d):
    return fiscal.quota_top_k(table(spark, d, "customer"), ["c_mktsegment"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 0.1, 40).select("c_custkey", "c_mktsegment")


# --- fiscal ---------------------------------------------------------------------------------------------------------

def _fiscal_sql(policy: tuple, deduction: str = "", subsidy: str = "", benefit: str = "") -> str:
    _, brackets, d, c, u = policy
    d, c, u = deduction or d, subsidy or c, benefit or u
    parts, low = [], 0.0
    for t, r in brackets:
        parts.append(f"greatest(least(taxable_income, {t}) - {low}, 0) * {r}")
        low, top = t, r
    parts.append(f"greatest(taxable_income - {low}, 0) * {top}")
    return f"""(SELECT *, CASE WHEN net_income IS NULL THEN NULL ELSE greatest(net_income, 0) END AS disposable_income FROM (SELECT *, gross_income - tax_paid + transfers AS net_income FROM (SELECT *, {' + '.join(parts)} AS tax_paid, CAST(num_children * ({c}) + CASE WHEN lower(employment_status) = 'unemployed' THEN ({u}) ELSE 0 END AS DOUBLE) AS transfers
FROM (SELECT *, greatest(gross_income - ({d}), 0) AS taxable_income FROM ({POP}) p CROSS JOIN (SELECT CAST(5 AS DOUBLE) AS five)))))"""


def _taxed(spark, d, name="base"):
    return fiscal.apply_policy(bound(spark, d, B.POPULATION).join(F.broadcast(B.policies(spark).where(F.col("policy") == name)), how="cross"))


@query("apply_policy", f"SELECT agent_id, round(taxable_income, 4) AS taxable_income, round(tax_paid, 4) AS tax_paid, CAST(transfers AS DOUBLE) AS transfers, round(disposable_income, 4) AS disposable_income FROM {_fiscal_sql(B.POLICIES[0])}")
def apply_policy(spark, d):
    return rounded(_taxed(spark, d).select("agent_id", "taxable_income", "tax_paid", "transfers", "disposable_income"), 4)


@query("adjust_policy", f"SELECT agent_id, round(tax_paid, 4) AS tax_paid, round(transfers, 4) AS transfers FROM {_fiscal_sql(B.POLICIES[0], '5000 + agent_id % 3 * 100', '120 * 1.5', '900 * 0.5')}")
def adjust_policy(spark, d):
    rows = bound(spark, d, B.POPULATION).join(F.broadcast(B.policies(spark).where("policy = 'base'")), how="cross")
    rows = rows.withColumns({"deduction_delta": (F.col("agent_id") % 3 * 100).cast("double"), "subsidy_multiplier": F.lit(1.5), "benefit_multiplier": F.lit(0.5)})
    return rounded(fiscal.apply_policy(fiscal.adjust_policy(rows)).select("agent_id", "tax_paid", "transfers"), 4)


@query("consumption", f"WITH t AS (SELECT * FROM {_fiscal_sql(B.POLICIES[0])}) SELECT agent_id, round(disposable_income * CASE WHEN disposable_income <= (SELECT median(disposable_income) FROM t) THEN 0.85 ELSE 0.65 END, 6) AS consumption FROM t")
def consumption(spark, d):
    return fiscal.consumption(_taxed(spark, d)).select("agent_id", "consumption")


@query("policy_table", "SELECT * FROM (VALUES " + ", ".join(f"('{p[0]}', CAST({t} AS DOUBLE), CAST({r} AS DOUBLE), (SELECT count(*) FROM customer WHERE c_acctbal * 5 + 10000 > {t}))" for p in B.POLICIES for t, r in p[1]) + ") AS t(policy, threshold, rate, above)")
def policy_table(spark, d):
    steps = fiscal.policy_table(B.policies(spark))
    over = bound(spark, d, B.POPULATION).join(F.broadcast(steps), F.col("gross_income") > F.col("threshold"))
    above = over.groupBy("policy", "threshold").agg(F.count("*").alias("above"))
    return steps.join(above, ["policy", "threshold"], "left").select("policy", "threshold", "rate", F.coalesce("above", F.lit(0)).alias("above"))


@query("validate_policy", "SELECT c_custkey AS agent_id FROM customer WHERE c_acctbal <= 0 OR c_custkey % 3 > 1 OR c_custkey % 19 = 0")
def validate_policy(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("agent_id"), F.array(F.struct(F.col("c_acctbal").alias("threshold"), (F.col("c_custkey") % 3).cast("double").alias("rate"))).alias("brackets"), F.when(F.col("c_custkey") % 19 == 0, -1.0).otherwise(1.0).alias("base_deduction"))
    return fiscal.validate_policy(rows).select("agent_id")


@query("policy_grid", " UNION ALL ".join(f"SELECT '{p[0]}' AS policy, count(*) AS agents, round(sum(tax_paid), 2) AS tax, round(sum(transfers), 2) AS transfers, round(sum(disposable_income), 2) AS disposable, round(sum(tax_paid) - sum(transfers), 2) AS balance FROM {_fiscal_sql(p)}" for p in B.POLICIES))
def policy_grid(spark, d):
    return rounded(fiscal.policy_grid(bound(spark, d, B.POPULATION), B.policies(spark)), 2)


def _ticks(spark, d):
    return table(spark, d, "events").select((F.dayofmonth("ts") - 1).cast("int").alias("tick")).distinct()


TICKS = "SELECT DISTINCT CAST(day(ts) - 1 AS INT) AS tick FROM events"
TIMELINE = f"SELECT * FROM ({TICKS}) LEFT JOIN {B.INTERVALS_SQL} ON tick BETWEEN start_tick AND coalesce(end_tick, 1000000)"


@query("event_timeline", f"SELECT tick, name, CAST(intensity AS DOUBLE) AS intensity FROM ({TIMELINE})")
def event_timeline(spark, d):
    return fiscal.event_timeline(_ticks(spark, d), B.intervals(spark)).select("tick", "name", "intensity")


ADJUSTED = f"""SELECT tick, count(name) AS active, coalesce(string_agg(name, ', ' ORDER BY start_tick, name), '') AS event_names, round(coalesce(sum(intensity * economic_multiplier), 0), 6) AS economic_intensity, round(coalesce(sum(intensity * inflation_pressure), 0), 6) AS inflation_delta,
  CAST(sum(deduction_delta) AS DOUBLE) AS deduction_delta, round(product(subsidy_multiplier), 6) AS subsidy_multiplier, round(product(benefit_multiplier), 6) AS benefit_multiplier, bool_or(name IS NOT NULL AND end_tick IS NULL) AS open_end, max(end_tick) AS last_end FROM ({TIMELINE}) GROUP BY tick"""


@query("event_adjustment", f"SELECT * EXCLUDE (open_end, last_end) REPLACE (CAST(economic_intensity AS DOUBLE) AS economic_intensity, CAST(inflation_delta AS DOUBLE) AS inflation_delta) FROM ({ADJUSTED})")
def event_adjustment(spark, d):
    return fiscal.event_adjustment(fiscal.event_timeline(_ticks(spark, d), B.intervals(spark))).drop("open_end", "last_end")


@query("composite_shock", f"SELECT tick, CASE WHEN active > 0 THEN 'GlobalEvents' END AS shock, CASE WHEN active > 0 THEN CAST(least(greatest(economic_intensity, -5), 5) AS DOUBLE) END AS shock_intensity, CASE WHEN active > 0 THEN CAST(tick AS BIGINT) END AS shock_start, CASE WHEN active > 0 AND NOT open_end THEN CAST(last_end AS BIGINT) END AS shock_end FROM ({ADJUSTED})")
def composite_shock(spark, d):
    return fiscal.composite_shock(fiscal.event_adjustment(fiscal.event_timeline(_ticks(spark, d), B.intervals(spark))))


@query("composite_shock_base", f"SELECT tick, 'Recession' AS shock, CASE WHEN active > 0 THEN CAST(least(greatest(4.5 + economic_intensity, -5), 5) AS DOUBLE) ELSE 4.5 END AS shock_intensity, CASE WHEN active > 0 THEN least(2, tick) ELSE 2 END AS shock_start, CAST(9 AS BIGINT) AS shock_end FROM ({ADJUSTED})")
def composite_shock_base(spark, d):
    out = fiscal.composite_shock(fiscal.event_adjustment(fiscal.event_timeline(_ticks(spark, d), B.intervals(spark))), ("Recession", 4.5, 2, 9))
    return out.withColumn("shock_start", F.col("shock_start").cast("int"))


@query("fiscal_timeline", f"""SELECT tick, round(sum(tax_paid), 2) AS tax_revenue, round(sum(transfers), 2) AS transfer_spending, round(sum(consumption), 2) AS consumption, round(avg(consumption), 2) AS mean_consumption, round(avg(CASE WHEN lower(employment_status) = 'employed' THEN 1.0 ELSE 0.0 END), 6) AS employment_rate,
  round(sum(tax_paid) - sum(transfers), 2) AS budget_balance, round(1 - avg(CASE WHEN lower(employment_status) = 'employed' THEN 1.0 ELSE 0.0 END), 6) AS unemployment_rate FROM ({PANEL}) GROUP BY tick""")
def fiscal_timeline(spark, d):
    out = fiscal.fiscal_timeline(bound(spark, d, B.PANEL))
    return out.withColumns({c: F.round(c, 2) for c in ("tax_revenue", "transfer_spending", "consumption", "mean_consumption", "budget_balance")})


PANEL_YEARS = f"SELECT agent_id, tick, avg(disposable_income) AS disposable_income, sum(tax_paid) AS tax_paid, sum(transfers) AS transfers, avg(consumption) AS consumption FROM ({PANEL}) GROUP BY agent_id, tick"


@query("agent_metrics", f"""SELECT agent_id, round(avg(disposable_income), 2) AS average_disposable, round(arg_max(disposable_income, tick), 2) AS final_disposable, round(avg(consumption), 2) AS average_consumption, round(sum(tax_paid), 2) AS total_tax, round(sum(transfers), 2) AS total_transfers,
  round(arg_min(disposable_income, tick), 2) AS baseline_disposable, round(avg(disposable_income) - arg_min(disposable_income, tick), 2) AS delta_disposable FROM ({PANEL_YEARS}) GROUP BY agent_id""")
def agent_metrics(spark, d):
    years = bound(spark, d, B.PANEL).groupBy("agent_id", "tick").agg(F.avg("disposable_income").alias("disposable_income"), F.sum("tax_paid").alias("tax_paid"), F.sum("transfers").alias("transfers"), F.avg("consumption").alias("consumption"))
    return rounded(fiscal.agent_metrics(years), 2)


@query("sentiment_index", f"""SELECT run_id, tick, round(least(greatest(55 + 45 * (mean_disposable - baseline_disposable) / baseline_disposable + 35 * coalesce(employment_rate - lag(employment_rate) OVER w, 0) - 20 * coalesce((cpi - lag(cpi) OVER w) / lag(cpi) OVER w, (cpi - 100) / 100), 0), 100), 6) AS sentiment FROM ({RUNS}) WINDOW w AS (PARTITION BY run_id ORDER BY tick)""")
def sentiment_index(spark, d):
    return fiscal.sentiment_index(bound(spark, d, B.RUNS)).select("run_id", "tick", "sentiment")


@query("last_tick", f"SELECT run_id, tick, round(cpi, 6) AS cpi, round(sentiment, 6) AS sentiment FROM ({RUNS}) QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY tick DESC) = 1")
def last_tick(spark, d):
    return timeseries.last_tick(bound(spark, d, B.RUNS)).select("run_id", "tick", "cpi", "sentiment")


# --- scenarios ------------------------------------------------------------------------------------------------------

# days and states of orders and of deliveries: some are on one side only
BY_ORDER = "SELECT CAST(o_orderdate AS DATE) AS date, o_orderstatus AS entity, avg(o_totalprice) AS value FROM {orders} GROUP BY CAST(o_orderdate AS DATE), o_orderstatus"
BY_DELIVERY = "SELECT CAST(l_shipdate AS DATE) AS date, l_linestatus AS entity, avg(l_extendedprice) AS value FROM {lineitem} GROUP BY CAST(l_shipdate AS DATE), l_linestatus"


@query("scenario_delta", f"SELECT date, entity, round(a.value, 4) AS baseline, round(b.value, 4) AS scenario, round(b.value - a.value, 4) + 0.0 AS delta FROM ({oracle(BY_ORDER)}) a FULL JOIN ({oracle(BY_DELIVERY)}) b USING (date, entity)")
def scenario_delta(spark, d):
    return rounded(scenario.scenario_delta(bound(spark, d, BY_ORDER), bound(spark, d, BY_DELIVERY), ["date", "entity"], "value"), 4)


def _deciles(spark, d, least=0.0):
    rows = table(spark, d, "customer").where(F.col("c_acctbal") > least)
    return distribution.mean_by_quantile(rows, "c_acctbal", 10).select((F.col("bin") + 1).alias("decile"), F.col("mean").alias("value"))


def _deciles_sql(least: float) -> str:
    return f"SELECT bin + 1 AS decile, avg(c_acctbal) AS value FROM {_cut(f'SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > {least}', 'c_acctbal', 10)} GROUP BY bin"


@query("decile_delta", f"""SELECT decile, round(b, 6) AS base, round(r, 6) AS reform, round(r - b, 6) + 0.0 AS delta, CASE WHEN r - b >= 0 THEN 'positive' ELSE 'negative' END AS sign FROM (SELECT decile, coalesce(x.value, 0) AS b, coalesce(y.value, x.value, 0) AS r
FROM (SELECT decile, CASE WHEN decile <> 3 THEN value END AS value FROM ({_deciles_sql(0)})) x FULL JOIN (SELECT decile, CASE WHEN decile <> 7 THEN value END AS value FROM ({_deciles_sql(1000)})) y USING (decile))""")
def decile_delta(spark, d):
    without = lambda df, n: df.withColumn("value", F.when(F.col("decile") != n, F.col("value")))
    return scenario.decile_delta(without(_deciles(spark, d), 3), without(_deciles(spark, d, 1000.0), 7))


@query("ab_timeline", f"SELECT a.tick, round(a.cpi, 6) AS base, round(b.cpi, 6) AS reform FROM (SELECT * FROM ({RUNS}) WHERE run_id = 'F') a LEFT JOIN (SELECT * FROM ({RUNS}) WHERE run_id = 'P') b ON a.tick = b.tick")
def ab_timeline(spark, d):
    r = bound(spark, d, B.RUNS)
    return scenario.ab_timeline(r.where("run_id = 'F'"), r.where("run_id = 'P'"), "cpi")


@query("long_ab", " UNION ALL ".join(f"SELECT tick AS period, '{m}' AS metric, round({m}, 6) AS value, '{s}' AS scenario FROM ({RUNS}) WHERE run_id = '{k}'" for m in ("cpi", "sentiment") for s, k in (("base", "F"), ("reform", "O"))))
def long_ab(spark, d):
    r = bound(spark, d, B.RUNS)
    return scenario.long_ab(r.where("run_id = 'F'"), r.where("run_id = 'O'"), ["cpi", "sentiment"])


@query("decile_frame", f"SELECT concat('decile_', decile) AS decile, round(value, 6) AS value, 'base' AS scenario FROM ({_deciles_sql(0)})")
def decile_frame(spark, d):
    one = _deciles(spark, d).agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("decile_"), F.col("decile").cast("string")), "value"))).alias("m"))
    return scenario.decile_frame(one, "m", "base")


KPI = f"""SELECT l.*, a.gini AS gini_pre, b.gini AS gini_post FROM (SELECT run_id, {', '.join(scenario.HEADLINE)} FROM ({RUNS}) QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY tick DESC) = 1) l
LEFT JOIN ({_gini_sql(AGENTS, 'baseline_disposable', 'run_id')}) a USING (run_id) LEFT JOIN ({_gini_sql(AGENTS, 'average_disposable', 'run_id')}) b USING (run_id)"""


@query("scenario_kpis", f"SELECT run_id, {', '.join(f'round({k}, 4) AS {k}' for k in scenario.KPIS)} FROM ({KPI})")
def scenario_kpis(spark, d):
    return rounded(scenario.scenario_kpis(bound(spark, d, B.RUNS), B.agents(spark, d)), 4)


def _kpi_sql(value: str, q: int) -> str:
    return f"SELECT * FROM {_cut(f"SELECT * FROM ({AGENTS}) WHERE run_id = 'F'", value, q)}"


_MEAN = f"(SELECT avg(average_disposable) FROM ({AGENTS}) WHERE run_id = 'F')"


@query("kpi_tables", f"""SELECT 'consumption_by_decile' AS part, bin, round(avg(average_consumption), 4) AS value, count(*) AS count FROM ({_kpi_sql('average_consumption', 10)}) GROUP BY bin
UNION ALL SELECT 'sentiment_by_decile', bin, round(least(greatest(55 + 40 * (avg(average_disposable) - {_MEAN}) / {_MEAN}, 0), 100), 4), NULL FROM ({_kpi_sql('average_disposable', 10)}) GROUP BY bin
UNION ALL SELECT 'winners_losers', bin, round(avg(delta_disposable), 4), count(*) FROM ({_kpi_sql('delta_disposable', 5)}) WHERE bin IS NOT NULL GROUP BY bin""", digits=4)
def kpi_tables(spark, d):
    made = scenario.kpi_tables(B.agents(spark, d).where("run_id = 'F'"))
    none = F.lit(None).cast("long").alias("count")
    of = lambda name, key, value, n: made[name].select(F.lit(name).alias("part"), F.col(key).alias("bin"), F.col(value).alias("value"), n)
    return of("consumption_by_decile", "bin", "mean", F.col("count")).unionByName(of("sentiment_by_decile", "bin", "sentiment", none)).unionByName(of("winners_losers", "cluster", "mean_delta", F.col("count")))


@query("kpi_delta", f"SELECT {', '.join(f'round(b.{k} - a.{k}, 4) + 0.0 AS {k}' for k in scenario.KPIS)} FROM (SELECT * FROM ({KPI}) WHERE run_id = 'F') a CROSS JOIN (SELECT * FROM ({KPI}) WHERE run_id = 'O') b")
def kpi_delta(spark, d):
    k = scenario.scenario_kpis(bound(spark, d, B.RUNS), B.agents(spark, d))
    return rounded(scenario.kpi_delta(k.where("run_id = 'F'"), k.where("run_id = 'O'")), 4)


@query("best_run", f"SELECT run_id, round(sentiment - 100 * unemployment_rate, 6) AS reward FROM ({KPI}) ORDER BY 2 DESC, ascii(run_id) LIMIT 1")
def best_run(spark, d):
    k = scenario.scenario_kpis(bound(spark, d, B.RUNS), B.agents(spark, d)).withColumn("at", F.ascii("run_id"))
    return scenario.best_run(k, F.col("sentiment") - 100 * F.col("unemployment_rate"), "at").select("run_id", "reward")


def _ladder(value: str, edges: list[float]) -> str:
    return "CAST(" + " + ".join(f"CASE WHEN {value} >= {e} THEN 1 ELSE 0 END" for e in edges) + " AS INT)"


@query("kpi_state", f"SELECT unemployment_state, price_state, sentiment_state, count(*) AS runs FROM (SELECT {_ladder('unemployment_rate', [0.05, 0.08, 0.12, 0.2])} AS unemployment_state, {_ladder('cpi / 100', [0.9, 1.05, 1.2, 1.4])} AS price_state, {_ladder('sentiment / 100', [0.4, 0.6, 0.75, 0.85])} AS sentiment_state FROM ({RUNS})) GROUP BY ALL")
def kpi_state(spark, d):
    return clean.kpi_state(bound(spark, d, B.RUNS)).groupBy("unemployment_state", "price_state", "sentiment_state").agg(F.count("*").alias("runs"))


@query("apply_intervention", f"SELECT date, entity AS feature, round(value + CASE entity WHEN 'error' THEN 5 WHEN 'click' THEN -2 ELSE 0 END, 6) AS value FROM ({DAILY})")
def apply_intervention(spark, d):
    return scenario.apply_intervention(bound(spark, d, B.DAILY).withColumnRenamed("entity", "feature"), {"error": 5, "click": -2})


# --- quality of predictions -----------------------------------------------------------------------------------------

TRUTH = f"SELECT *, coalesce(outcome, 0) AS y FROM ({PRED})"
RATES = "CASE WHEN count(*) FILTER (probability >= 0.6) > 0 THEN round(count(*) FILTER (probability >= 0.6 AND y = 1) / count(*) FILTER (probability >= 0.6), 6) ELSE 0 END AS precision, CASE WHEN count(*) FILTER (y = 1) > 0 THEN round(count(*) FILTER (probability >= 0.6 AND y = 1) / count(*) FILTER (y = 1), 6) ELSE 0 END AS recall"


@query("brier", f"SELECT round(avg(pow(probability - y, 2)), 6) AS brier FROM ({TRUTH})")
def brier(spark, d):
    return evaluate.brier(bound(spark, d, B.PREDICTIONS))


@query("precision_recall", f"SELECT {RATES} FROM ({TRUTH})")
def precision_recall(spark, d):
    return evaluate.precision_recall(bound(spark, d, B.PREDICTIONS), 0.6)


@query("summary_table", f"SELECT model, round(avg(pow(probability - y, 2)), 6) AS brier, {RATES} FROM ({TRUTH}) GROUP BY model")
def summary_table(spark, d):
    return evaluate.summary_table(bound(spark, d, B.PREDICTIONS), 0.6)


MODELS = f"SELECT model, country, CAST(date AS DATE) AS date, avg(CASE WHEN model = 'even' OR day(date) % 9 <> 0 THEN probability END) AS probability FROM ({PRED}) GROUP BY ALL"
ENSEMBLE = f"SELECT country, date, CASE WHEN count(probability) = 2 THEN avg(probability) END AS probability FROM ({MODELS}) GROUP BY ALL"


def _ensemble(spark, d):
    # one model has no probabilities on some days
    given = (F.col("model") == "even") | (F.dayofmonth("date") % 9 != 0)
    p = bound(spark, d, B.PREDICTIONS).withColumn("probability", F.when(given, F.col("probability")))
    return evaluate.ensemble(p.groupBy("model", "country", F.to_date("date").alias("date")).agg(F.avg("probability").alias("probability")), ["country", "date"])


@query("ensemble", f"SELECT country, date, round(probability, 6) AS probability FROM ({ENSEMBLE})")
def ensemble(spark, d):
    return _ensemble(spark, d)


@query("align_target", f"SELECT d.date, d.entity, round(d.value, 6) AS value, coalesce(t.label, 0) AS label FROM ({DAILY}) d LEFT JOIN (SELECT date, entity, CAST(1 AS INT) AS label FROM ({DAILY}) WHERE value > 50) t ON d.date = t.date AND d.entity = t.entity")
def align_target(spark, d):
    daily = bound(spark, d, B.DAILY)
    return evaluate.align_target(daily, daily.where("value > 50").select("date", "entity", F.lit(1).alias("label")), ["date", "entity"])


ALL_DAYS = f"SELECT country, CAST(date AS DATE) AS date, avg(probability) AS probability FROM ({PRED}) GROUP BY ALL"


def _by_day(spark, d):
    return bound(spark, d, B.PREDICTIONS).groupBy("country", F.to_date("date").alias("date")).agg(F.avg("probability").alias("probability"))


@query("build_evidence", f"""SELECT country, round_even(least(greatest(abs(l - r) * 4, 0.05), 0.95), 2) AS signal_strength, round_even(l / greatest(0.001, 1 - l), 2) AS posterior_odds, updated
FROM (SELECT country, arg_max(probability, date) AS l, max(probability) FILTER (n = CASE WHEN rows > 7 THEN 7 ELSE rows END) AS r, strftime(max(date), '%Y-%m-%d') AS updated FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY date DESC) AS n, count(*) OVER (PARTITION BY country) AS rows FROM ({ALL_DAYS})) GROUP BY country)""")
def build_evidence(spark, d):
    return evaluate.build_evidence(_by_day(spark, d))


@query("top_alerts", f"SELECT country, round(p, 6) AS probability, CAST(row_number() OVER (ORDER BY p DESC, country) <= 2 AND p > 0.45 AS INT) AS alert FROM (SELECT country, arg_max(probability, date) AS p FROM ({ALL_DAYS}) GROUP BY country)")
def top_alerts(spark, d):
    return evaluate.top_alerts(_by_day(spark, d), 2, 0.45)


# --- evidence -------------------------------------------------------------------------------------------------------

BINNED = f"""SELECT l.*, e, CASE WHEN value IS NULL THEN NULL ELSE greatest(len(list_filter(e, lambda y: y < value)) - 1, 0) END AS bin FROM ({LONG}) l
JOIN (SELECT feature, list_sort(list_distinct(CASE WHEN count(DISTINCT value) = 2 THEN quantile_cont(value, [0, 0.5, 1]) WHEN count(DISTINCT value) = 3 THEN quantile_cont(value, [0, 0.3333333333333333, 0.6666666666666666, 1]) ELSE quantile_cont(value, [0, 0.25, 0.5, 0.75, 1]) END)) AS e FROM ({LONG}) GROUP BY feature HAVING count(DISTINCT value) >= 2) USING (feature)"""


@query("bin_event_rates", f"SELECT feature, CAST(bin AS INT) AS bin, CAST(sum(label) AS BIGINT) AS events, count(*) AS rows FROM ({BINNED}) WHERE bin IS NOT NULL GROUP BY ALL")
def bin_event_rates(spark, d):
    return evidence.bin_event_rates(bound(spark, d, B.LONG))


@query("latest_bin", f"SELECT feature, CAST(arg_max(bin, \"order\") AS INT) AS bin FROM ({BINNED}) WHERE bin IS NOT NULL GROUP BY feature")
def latest_bin(spark, d):
    return evidence.latest_bin(bound(spark, d, B.LONG))


STRENGTH = "CASE " + " ".join(f"WHEN ratio >= {b} THEN '{n}'" for b, n in evidence.RISES) + " " + " ".join(f"WHEN ratio <= {b} THEN '{n}'" for b, n in evidence.FALLS) + " ELSE 'neutral' END"


@query("bayesian_evidence", f"""WITH b AS (SELECT * FROM ({BINNED}) WHERE bin IS NOT NULL), r AS (SELECT feature, bin, sum(label) AS events, count(*) AS samples, any_value(e) AS e FROM b GROUP BY ALL), l AS (SELECT feature, arg_max(bin, "order") AS bin FROM b GROUP BY feature),
p AS (SELECT feature, bin, samples, e, least(greatest((events + 0.2) / (samples + 1), 1e-6), 1 - 1e-6) AS posterior FROM r JOIN l USING (feature, bin)), q AS (SELECT *, posterior / (1 - posterior) / 0.25 AS ratio FROM p)
SELECT feature, concat('[', printf('%.2f', e[bin + 1]), ', ', printf('%.2f', e[least(bin + 2, len(e))]), ')') AS bucket, round(posterior, 6) AS posterior, round(ratio, 6) AS likelihood_ratio, {STRENGTH} AS evidence_strength, samples FROM q""")
def bayesian_evidence(spark, d):
    return evidence.bayesian_evidence(bound(spark, d, B.LONG), prior=0.2)


# --- feeds ----------------------------------------------------------------------------------------------------------

def _landed(spark, d, rows: DataFrame, root: str) -> DataFrame:
    """Rows written as JSON payloads of one record each, and read as a feed: the payloads grow in number with the rows, not in size."""
    path = scratch(spark)
    rows.select(F.array(F.struct(*rows.columns)).alias(root)).write.json(path)
    return feeds.read_feed(spark, path, schema=rows.schema, lines=True)


def _raw_feed(spark, d):
    e = table(spark, d, "events")
    text = lambda c: c.cast("string")
    rows = e.select(
        text(F.col("event_id")).alias("GLOBALEVENTID"), F.when(F.col("event_id") % 11 != 0, F.date_format("ts", "yyyyMMdd")).otherwise(F.lit("unknown")).alias("SQLDATE"), F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("ActionGeo_CountryCode"),
        F.concat(F.lit(" "), F.when(F.col("user_id") % 3 != 0, F.col("event_type")).otherwise(F.lit(""))).alias("Actor1CountryCode"), text(F.col("user_id")).alias("Actor1Name"), F.format_string("%.2f", "value").alias("AvgTone"), F.when(F.col("event_id") % 5 != 0, text(F.col("user_id") % 9)).otherwise(F.lit("n/a")).alias("NumArticles"),
    )
    return _landed(spark, d, rows, "results")


@query("normalise_events", """SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN event_id % 11 <> 0 THEN date_trunc('day', ts) ELSE TIMESTAMP '2024-01-01' END AS event_date, CASE WHEN event_id % 7 <> 0 THEN upper(event_type) ELSE 'GLOBAL' END AS country, CASE WHEN user_id % 3 <> 0 THEN upper(event_type) END AS actor1_country, CAST(NULL AS VARCHAR) AS actor2_country,
  CAST(user_id AS VARCHAR) AS actor1, 'UNKNOWN' AS actor2, '' AS themes, '' AS source_url, CASE WHEN event_id % 5 <> 0 THEN CAST(user_id % 9 AS DOUBLE) ELSE 0.0 END AS num_articles, round(value, 2) AS tone, CAST(0 AS DOUBLE) AS goldstein, CAST(NULL AS DOUBLE) AS latitude, CAST(NULL AS DOUBLE) AS longitude FROM events""")
def normalise_events(spark, d):
    return feeds.normalise_events(_raw_feed(spark, d), datetime(2024, 1, 1)).withColumn("tone", F.round("tone", 2))


@query("normalise_conflict", "SELECT o_orderdate AS event_date, o_orderstatus AS country FROM orders")
def normalise_conflict(spark, d):
    rows = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderstatus").alias("admin1"))
    return feeds.normalise_conflict(_landed(spark, d, rows, "data"), datetime(1995, 1, 1))


@query("normalise_conflict_undated", "SELECT TIMESTAMP '1995-01-01' + INTERVAL 1 DAY * CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INT) AS event_date, n_name AS country FROM nation")
def normalise_conflict_undated(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    return feeds.normalise_conflict(rows, datetime(1995, 1, 1), ["n_nationkey"])


@query("normalise_displacement", "SELECT o_orderdate AS date, o_orderstatus AS country, CAST(CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE o_custkey END AS DOUBLE) AS displaced_population FROM orders")
def normalise_displacement(spark, d):
    rows = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("record_date"), F.col("o_orderstatus").alias("coo_name"), F.when(F.col("o_orderkey") % 6 != 0, F.col("o_custkey").cast("string")).otherwise(F.lit("none")).alias("people"))
    return feeds.normalise_displacement(_landed(spark, d, rows, "data"), datetime(1995, 1, 1))


@query("normalise_access", "SELECT o_orderdate AS date, coalesce(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END, 'GLOBAL') AS country, round(o_totalprice, 2) AS access_constraint_score FROM orders")
def normalise_access(spark, d):
    rows = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("report_date"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")).alias("iso3"), F.col("o_totalprice").alias("score"))
    return feeds.normalise_access(_landed(spark, d, rows, "data"), datetime(1995, 1, 1))


@query("normalise_indicator", "SELECT make_date(year(o_orderdate), 1, 1) AS date, round(avg(o_totalprice), 4) AS ny_gdp FROM orders WHERE o_orderkey % 8 <> 0 GROUP BY 1")
def normalise_indicator(spark, d):
    rows = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy").alias("date"), F.when(F.col("o_orderkey") % 8 != 0, F.col("o_totalprice").cast("string")).otherwise(F.lit("..")).alias("value"))
    return rounded(feeds.normalise_indicator(rows, "NY.GDP"), 4)


def _mixed_feed(spark, d) -> str:
    """Orders as payloads of one record in all shapes that feeds have, by order key, and a payload without records, a message and a broken one for each nation."""
    o = table(spark, d, "orders")
    record = F.to_json(F.struct(F.date_format("o_orderdate", "yyyy").alias("date"), F.col("o_totalprice").alias("value"), F.struct((F.col("o_orderkey") % 5).alias("kind")).alias("about")))
    shapes = [("{\"data\":[", "]}"), ("{\"results\":[", "]}"), ("[{\"page\":1},[", "]]"), ("[", "]"), ("", "")]
    at = F.col("o_orderkey") % 5
    text = reduce(lambda c, i: c.when(at == i, F.concat(F.lit(shapes[i][0]), record, F.lit(shapes[i][1]))), range(len(shapes)), F.when(F.lit(False), ""))
    empty = F.explode(F.array(F.lit('[{"page":1},null]'), F.lit('[{"message":"no such indicator"}]'), F.concat(F.lit('{"data": ['), F.col("n_name")), F.lit('{"data":[1,null]}')))
    path = scratch(spark)
    o.select(text.alias("value")).union(table(spark, d, "nation").select(empty)).write.text(path)
    return path


@query("mixed_payloads", """SELECT o_orderkey % 5 AS kind, count(*) AS records, round(sum(o_totalprice), 2) AS total, min(CAST(year(o_orderdate) AS VARCHAR)) AS first_year, CAST(0 AS BIGINT) AS messages FROM orders GROUP BY 1
  UNION ALL SELECT NULL, count(*), NULL, NULL, count(*) FROM nation""", digits=2)
def mixed_payloads(spark, d):
    rows = feeds.read_feed(spark, _mixed_feed(spark, d), lines=True)
    return rows.groupBy(F.col("`about.kind`").alias("kind")).agg(F.count("*").alias("records"), F.sum("value").alias("total"), F.min("date").alias("first_year"), F.count("message").alias("messages"))


@query("mixed_indicator", "SELECT make_date(year(o_orderdate), 1, 1) AS date, round(avg(o_totalprice), 4) AS ny_gdp FROM orders GROUP BY 1", digits=4)
def mixed_indicator(spark, d):
    return feeds.normalise_indicator(feeds.read_feed(spark, _mixed_feed(spark, d), lines=True), "NY.GDP")


@query("unread_payloads", "SELECT '{\"data\": [' || n_name AS value, CAST(NULL AS INT) AS records FROM nation UNION ALL SELECT '{\"data\":[1,null]}', 2 FROM nation")
def unread_payloads(spark, d):
    return feeds.unread_payloads(spark, _mixed_feed(spark, d), lines=True)


@query("provenance", "SELECT 'orders' AS source, 'file' AS endpoint, TIMESTAMP '2024-02-01' AS retrieved_at, TIMESTAMP '2024-01-01' AS \"start\", TIMESTAMP '2024-01-31' AS \"end\", 'all' AS query, CAST(30 AS INT) AS lookback_days, (SELECT count(*) FROM orders) AS rows, CAST(NULL AS VARCHAR) AS fallback, CAST(NULL AS VARCHAR) AS error")
def provenance(spark, d):
    return feeds.provenance(table(spark, d, "orders"), "orders", "file", datetime(2024, 1, 1), datetime(2024, 1, 31), "all", datetime(2024, 2, 1))


# --- sinks and run tables -------------------------------------------------------------------------------------------

@query("write_layer", f"SELECT * FROM ({GOLD})")
def write_layer(spark, d):
    path = scratch(spark)
    sinks.write_layer({"My Orders": layers.build_gold(clean.build_silver(_raw_orders(spark, d)))}, path, "bronze", {"My Orders": provenance(spark, d)})
    return spark.read.parquet(f"{path}/bronze/my_orders.parquet")


@query("write_predictions", f"SELECT country, date, round(probability, 6) AS probability FROM ({ENSEMBLE})")
def write_predictions(spark, d):
    path = scratch(spark)
    sinks.write_predictions(_ensemble(spark, d), path)
    return spark.read.parquet(path)


@query("write_evidence", ORACLES["build_evidence"])
def write_evidence(spark, d):
    path = scratch(spark)
    sinks.write_evidence(evaluate.build_evidence(_by_day(spark, d)), path)
    return spark.read.schema("country string, signal_strength double, posterior_odds double, updated string").json(path)


@query("export_csv", f"SELECT country, date, CAST(value AS BIGINT) AS value FROM (SELECT date, entity AS country, value FROM ({COUNTS}))")
def export_csv(spark, d):
    path = scratch(spark)
    rows = timeseries.daily_counts(bound(spark, d, B.EVENTS)).withColumnRenamed("entity", "country").withColumn("_hidden", F.lit(1))
    sinks.export_csv(rows, path)
    return spark.read.option("header", True).schema("date date, country string, value long").csv(path).select("country", "date", "value")


@query("run_tables", f"SELECT 'agents' AS part, CAST(agent_id AS BIGINT) AS key, round(average_disposable, 4) AS value FROM ({AGENTS}) WHERE run_id = 'F' UNION ALL SELECT 'timeline', tick, round(cpi, 4) FROM ({RUNS}) WHERE run_id = 'F' UNION ALL SELECT 'runs', 3, 30000.0")
def run_tables(spark, d):
    path = scratch(spark)
    tables = runs.RunTables(spark, path)
    timeline, agents = bound(spark, d, B.RUNS), B.agents(spark, d)
    ids = [tables.store(f"run {k}", B.policies(spark).where("policy = 'base'"), timeline.where(F.col("run_id") == k), agents.where(F.col("run_id") == k)) for k in ("O", "P", "F")]
    header, t, a = tables.fetch(ids[2])
    out = tables.export(ids[2], f"{path}/export")
    whole = tables.list_runs().agg(F.count("*").alias("key")).join(F.broadcast(header.select(F.col("policy.brackets")[0]["threshold"].alias("value"))))
    parts = a.select(F.lit("agents").alias("part"), F.col("agent_id").alias("key"), F.col("average_disposable").alias("value")).unionByName(spark.read.parquet(out["timeline"]).select(F.lit("timeline").alias("part"), F.col("tick").cast("long").alias("key"), F.col("cpi").alias("value")))
    return rounded(parts.unionByName(whole.select(F.lit("runs").alias("part"), "key", "value")), 4)


@query("metadata_kinds", "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN event_id % 4 = 0 THEN 'int' WHEN event_id % 4 = 1 THEN 'float' WHEN event_id % 4 = 2 THEN 'bool' ELSE 'text' END AS kind FROM events) GROUP BY kind")
def metadata_kinds(spark, d):
    k = F.col("event_id") % 4
    value = F.when(k == 0, F.col("user_id").cast("string")).when(k == 1, F.format_string("%.2f", "value")).when(k == 2, F.lit("True")).otherwise(F.col("event_type"))
    rows = table(spark, d, "events").select(F.create_map(F.lit("v"), value).alias("m"))
    return sinks.flags_from_text(rows, "m").groupBy("kind").agg(F.count("*").alias("n"))


# --- models ---------------------------------------------------------------------------------------------------------

def _model_tables(spark, d):
    e, o = table(spark, d, "events"), table(spark, d, "orders")
    day = F.date_add(F.lit(date(2024, 1, 1)), F.pmod(F.col("o_orderkey"), F.lit(30)).cast("int"))
    tables = {
        "events": e.select(F.col("ts").alias("event_date"), F.col("event_type").alias("country")),
        "displacement": o.select(day.alias("date"), F.element_at(F.array(*map(F.lit, ("click", "error", "view", "purchase", "login"))), F.pmod(F.col("o_custkey"), F.lit(5)).cast("int") + 1).alias("country"), F.col("o_totalprice").alias("displaced_population")),
    }
    target = bound(spark, d, B.DAILY).select("date", "entity", (F.col("value") > 50).cast("int").alias("label"))
    return tables, target


MODEL_FEATURES = (risk.FeatureConfig("events_daily", "events", 7), risk.FeatureConfig("humanitarian_pressure", "displacement", 7))
MODEL_NAMES = ("events__events_daily", "humanitarian__humanitarian_pressure")
DAILY_RISK = ml.ModelConfig("daily / risk")


def _training(spark, d):
    tables, target = _model_tables(spark, d)
    store = risk.build_feature_store(tables, MODEL_FEATURES)
    return ml.training_set(store, MODEL_NAMES, target.withColumn("date", F.col("date").cast("timestamp_ntz")))


_CLICKS = "SELECT CAST(ts AS DATE) AS date, event_type AS entity, count(*) AS value FROM events WHERE event_type IS NOT NULL GROUP BY ALL"
_MOVED = "SELECT DATE '2024-01-01' + CAST(o_orderkey % 30 AS INT) AS date, (['click', 'error', 'view', 'purchase', 'login'])[o_custkey % 5 + 1] AS entity, sum(o_totalprice) AS value FROM orders GROUP BY ALL"


def _days(source: str, name: str) -> str:
    """A daily series filled forward and averaged over two weeks."""
    return f"""(SELECT '{name}' AS entity, date, avg(value) OVER (ORDER BY date ROWS 13 PRECEDING) AS value FROM (SELECT CAST(day AS DATE) AS date, last_value(v IGNORE NULLS) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS value
  FROM (SELECT unnest(generate_series((SELECT min(date) FROM ({source})), (SELECT max(date) FROM ({source})), INTERVAL 1 DAY)) AS day) LEFT JOIN (SELECT date AS own, value AS v FROM ({source})) ON CAST(day AS DATE) = own))"""


_PRICES = "SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS value FROM orders GROUP BY 1"


@query("feature_store", f"""SELECT 'events__events_daily' AS feature, CAST(date AS TIMESTAMP) AS date, entity, CAST(sum(value) OVER (PARTITION BY entity ORDER BY date ROWS 6 PRECEDING) AS DOUBLE) AS value FROM ({_grid(_CLICKS, 'coalesce(s.value, 0)')})
UNION ALL SELECT 'economic__economic_pressure', CAST(date AS TIMESTAMP), entity, round(value, 4) FROM {_days(_PRICES, 'price')}
UNION ALL SELECT 'humanitarian__humanitarian_pressure', CAST(date AS TIMESTAMP), entity, round(coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY entity ORDER BY date ROWS UNBOUNDED PRECEDING), 0), 4) FROM (SELECT date, entity, avg(value) OVER (PARTITION BY entity ORDER BY date ROWS 6 PRECEDING) AS value FROM ({_grid(_MOVED, 's.value')}))""", digits=4)
def feature_store(spark, d):
    tables = _model_tables(spark, d)[0]
    tables["economic"] = table(spark, d, "orders").select(F.col("o_orderdate").alias("date"), F.col("o_totalprice").alias("price"))
    return risk.build_feature_store(tables, [*MODEL_FEATURES, risk.FeatureConfig("economic_pressure", "economic", 14)])


@query("align_features", f"""WITH s AS ({DAILY}), w AS (SELECT date, entity, max(value) FILTER (day(date) % 3 <> 0) AS a, max(value * 2) FILTER (day(date) % 4 <> 0) AS b FROM s GROUP BY ALL)
SELECT date, entity, round(coalesce(last_value(a IGNORE NULLS) OVER w1, 0), 6) AS a, round(coalesce(last_value(b IGNORE NULLS) OVER w1, 0), 6) AS b FROM w WINDOW w1 AS (PARTITION BY entity ORDER BY date ROWS UNBOUNDED PRECEDING)""")
def align_features(spark, d):
    daily = bound(spark, d, B.DAILY)
    # either feature has no value on some days
    a = daily.select(F.lit("a").alias("feature"), "date", "entity", F.when(F.dayofmonth("date") % 3 != 0, F.col("value")).alias("value"))
    b = daily.select(F.lit("b").alias("feature"), "date", "entity", F.when(F.dayofmonth("date") % 4 != 0, F.col("value") * 2).alias("value"))
    return ml.align_features(a.unionByName(b), ["a", "b"])


@query("train_gbt")
def train_gbt(spark, d):
    data = materialise(_training(spark, d), "training")
    return ml.predict([ml.train_gbt(data, DAILY_RISK, MODEL_NAMES)], data)


@query("rolling_backtest")
def rolling_backtest(spark, d):
    out = ml.rolling_backtest(materialise(_training(spark, d), "training"), DAILY_RISK, MODEL_NAMES)
    return evaluate.summary_table(out, model="fold")


@query("train_mlp")
def train_mlp(spark, d):
    data = materialise(_training(spark, d), "training")
    return ml.predict([ml.train_mlp(data, DAILY_RISK, MODEL_NAMES)], data)


@query("model_round_trip")
def model_round_trip(spark, d):
    data, root = materialise(_training(spark, d), "training"), scratch(spark)
    model = ml.train_gbt(data, DAILY_RISK, MODEL_NAMES)
    ml.save_model(model, root)
    assert ml.has_model(root, DAILY_RISK)
    again = ml.predict([ml.load_model(root, DAILY_RISK)], data).withColumnRenamed("probability", "loaded")
    return ml.predict([model], data).join(again.select("date", "entity", "loaded"), ["date", "entity"])


@query("risk_pipeline")
def risk_pipeline(spark, d):
    tables, target = _model_tables(spark, d)
    _, found = risk.risk_pipeline(tables, target.withColumn("date", F.col("date").cast("timestamp_ntz")), scratch(spark), MODEL_FEATURES, [DAILY_RISK], scratch(spark))
    return found


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
