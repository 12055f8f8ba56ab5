"""Interaction graphs between countries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statera.functions.expressions import finite, number_of
from statera.sources.storage import materialise

#: Rows for each task that finds distinct ids.
TASK_ROWS = 1 << 19


def _end(df: DataFrame, actor: str) -> Column:
    """Country of an actor, else of the event; upper case, blank as NULL."""
    tidy = lambda c: F.nullif(F.upper(F.trim(F.col(c).cast("string"))), F.lit(""))
    return F.coalesce(*(tidy(c) for c in (actor, "country") if c in df.columns))


def graph_edges(events: DataFrame, weight: str = "num_articles", min_events: int = 1, min_weight: float | None = None, self_loops: bool = False) -> DataFrame:
    """source, target, events, weight, and avg_tone, avg_goldstein, first_seen, last_seen of the columns that exist.

    Weights that are missing count 1; events are distinct ids if there are ids, else rows. Heaviest edges first. Rows with ids are written to
    the shared folder, so that the tasks that find the distinct ones are as many as the rows need, apart from what made the rows.
    """
    w = F.coalesce(number_of(events, weight), F.lit(1.0)) if weight in events.columns else F.lit(1.0)
    rows = events.withColumns({"__s": _end(events, "actor1_country"), "__t": _end(events, "actor2_country"), "__w": w}).where("__s is not null and __t is not null")
    if not self_loops:
        rows = rows.where("__s <> __t")
    number = lambda c: F.avg(number_of(events, c))
    out = [F.count("*").alias("events"), F.sum("__w").alias("weight")]
    out += [number(c).alias(f"avg_{c}") for c in ("tone", "goldstein") if c in events.columns]
    if "event_date" in events.columns:
        out += [F.min("event_date").alias("first_seen"), F.max("event_date").alias("last_seen")]
    ends = [F.col("__s").alias("source"), F.col("__t").alias("target")]
    if "event_id" in events.columns:
        rows = materialise(rows.select("__s", "__t", "__w", *(c for c in ("event_id", "tone", "goldstein", "event_date") if c in events.columns)), "interactions")
        named = rows.where("event_id is not null").select(*ends, "event_id")
        named = named.repartition(max(1, -(-rows.count() // TASK_ROWS)), "source", "target", "event_id").distinct()
        sums = rows.groupBy(*ends).agg(*out)
        counts = named.groupBy("source", "target").agg(F.count("*").alias("__events"))
        counted = sums.join(counts, ["source", "target"], "left").withColumn("events", F.coalesce("__events", F.lit(0)))
        edges = counted.select(*sums.columns)
    else:
        edges = rows.groupBy(*ends).agg(*out)
    if min_events > 1:
        edges = edges.where(F.col("events") >= min_events)
    if min_weight is not None:
        edges = edges.where(F.col("weight") >= min_weight)
    return edges.orderBy(F.desc("weight"), F.desc("events"), "source", "target")


def graph_nodes(edges: DataFrame) -> DataFrame:
    """state, degree, out_degree, in_degree, out_events, in_events, out_weight, in_weight, total_events, total_weight; heaviest first.

    Edges are stacked by role and grouped once. An edge is a pair of neighbours once, so degrees are counts of rows.
    """
    role = lambda state, name: edges.select(F.col(state).alias("state"), F.lit(name).alias("role"), "events", "weight")
    ends = role("source", "out").unionByName(role("target", "in"))
    of = lambda r, c: F.coalesce(F.sum(F.when(F.col("role") == r, F.col(c))), F.lit(0))
    nodes = ends.groupBy("state").agg(*(x for r in ("out", "in") for x in (F.count_if(F.col("role") == r).alias(f"{r}_degree"), of(r, "events").alias(f"{r}_events"), of(r, "weight").alias(f"{r}_weight"))))
    totals = {"degree": F.col("out_degree") + F.col("in_degree")} | {f"total_{c}": F.col(f"out_{c}") + F.col(f"in_{c}") for c in ("events", "weight")}
    return nodes.withColumns(totals).orderBy(F.desc("total_weight"), "state")


def state_graph(events: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Edges (written to the shared folder, as nodes use them too) and nodes."""
    edges = materialise(graph_edges(events, **options), "edges").orderBy(F.desc("weight"), F.desc("events"), "source", "target")
    return edges, graph_nodes(edges)


def country_summary(events: DataFrame, positive: float = 1.0, negative: float = -1.0) -> DataFrame:
    """country, events, articles, avg_tone, positive, negative, latitude, longitude; countries without a place are left out."""
    number = lambda c: number_of(events, c) if c in events.columns else F.lit(None).cast("double")
    rows = events.select(F.coalesce("country", F.lit("GLOBAL")).alias("country"), "event_id", number("tone").alias("tone"), F.coalesce(number("num_articles"), F.lit(0.0)).alias("articles"), number("latitude").alias("latitude"), number("longitude").alias("longitude"))
    out = rows.groupBy("country").agg(
        F.countDistinct("event_id").alias("events"), F.sum("articles").alias("articles"), F.avg("tone").alias("avg_tone"), F.count_if(F.col("tone") > positive).alias("positive"), F.count_if(F.col("tone") < negative).alias("negative"), F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude")
    )
    return out.withColumns({c: finite(F.col(c)) for c in ("articles", "avg_tone", "latitude", "longitude")}).dropna(subset=["latitude", "longitude"])


def headline(events: DataFrame) -> DataFrame:
    """One row: events, countries, mean_tone."""
    return events.agg(F.count("*").alias("events"), F.countDistinct("country").alias("countries"), F.avg("tone").alias("mean_tone"))


def edge_geo(edges: DataFrame, places: DataFrame, focus: str) -> DataFrame:
    """Edges at the node ``focus`` with the places (country, latitude, longitude) of both ends; without both they are left out.

    ``places`` has a row for each country; its size decides the join's kind.
    """
    end = lambda name: places.select(F.col("country").alias(name), F.col("latitude").alias(f"{name}_lat"), F.col("longitude").alias(f"{name}_lon"))
    near = edges.where((F.col("source") == focus) | (F.col("target") == focus))
    out = near.join(end("source"), "source", "left").join(end("target"), "target", "left")
    return out.dropna(subset=["source_lat", "source_lon", "target_lat", "target_lon"])
