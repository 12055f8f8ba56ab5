"""Gold tables and their union."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statera.functions.expressions import col, numeric_columns
from statera.operators.clean import find_date_column


def build_gold(df: DataFrame, ordered: bool = True) -> DataFrame:
    """Means of the numeric columns for each date and country (those that exist; NULL keys are groups), sorted unless more work follows.

    Without keys one row of means, without numbers the distinct keys, without either the table itself.
    """
    when = find_date_column(df)
    keys = [c for c in (when, "country") if c and c in df.columns]
    if when:
        df = df.withColumn(when, col(when).try_cast("timestamp_ntz")).dropna(subset=[when])
    numbers = numeric_columns(df, keys)
    means = [F.avg(F.nanvl(col(c).cast("double"), F.lit(None).cast("double"))).alias(c) for c in numbers]
    if numbers and keys:
        out = df.groupBy(*keys).agg(*means)
        return out.orderBy(*keys) if ordered else out
    if numbers:
        return df.agg(*means)
    return df.select(*keys).distinct().orderBy(*keys) if keys else df


def combine_gold(gold: Mapping[str, DataFrame]) -> DataFrame | None:
    """All dated tables under each other, their date as ``date`` and their name as ``source``; None if no table is dated."""
    parts = []
    for name, df in gold.items():
        when = find_date_column(df)
        if when:
            df = df if when == "date" else df.drop("date").withColumnRenamed(when, "date")
            parts.append(df.withColumn("date", F.col("date").try_cast("timestamp_ntz")).withColumn("source", F.lit(name)).dropna(subset=["date"]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).orderBy("date", "source") if parts else None


def layer_counts(layers: Mapping[str, Mapping[str, DataFrame]]) -> DataFrame | None:
    """(layer, table, rows) of every table; None without tables."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(layer).alias("layer"), F.lit(name).alias("table"), "rows") for layer, tables in layers.items() for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts) if parts else None
