"""Writers of layers, predictions, evidence and exports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statera.functions.expressions import slug
from statera.operators.timeseries import latest_outcomes


def write_layer(tables: Mapping[str, DataFrame], root: str, layer: str, metadata: Mapping[str, DataFrame] | None = None) -> None:
    """Each table as Parquet below root/layer; bronze also its metadata as JSON beside it."""
    for name, df in tables.items():
        path = f"{root}/{layer}/{slug(name)}"
        df.write.mode("overwrite").parquet(f"{path}.parquet")
        if layer == "bronze" and metadata and name in metadata:
            metadata[name].coalesce(1).write.mode("overwrite").json(f"{path}.meta.json")  # one row


def write_predictions(df: DataFrame, path: str, by: str = "country") -> None:
    """Parquet, a folder for each country."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def write_outcomes(target: DataFrame, path: str, date: str = "date", label: str = "label") -> None:
    """Parquet of the rows at the last date of all, their label as outcome."""
    latest_outcomes(target, date).drop(date).withColumnRenamed(label, "outcome").write.mode("overwrite").parquet(path)


def write_evidence(df: DataFrame, path: str) -> None:
    """JSON lines."""
    df.write.mode("overwrite").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; columns that begin with an underscore and actors' countries and ids kept for filters stay out."""
    hidden = [c for c in df.columns if c.startswith("_") or c in ("actor1_country", "actor2_country", "event_id")]
    df.drop(*hidden).write.mode("overwrite").option("header", True).csv(path)


def flags_from_text(df: DataFrame, column: str) -> DataFrame:
    """A map of text values with their kind: bool, int, float or text, as (key, value, kind)."""
    rows = df.select(F.explode(column).alias("key", "value"))
    low = F.lower(F.trim("value"))
    kind = F.when(low.isin("true", "false"), "bool").when(low.rlike(r"^[+-]?\d+$"), "int").when(low.rlike(r"^[+-]?(\d+\.\d*|\.\d+|\d+)(e[+-]?\d+)?$"), "float").otherwise("text")
    return rows.withColumn("kind", kind)
