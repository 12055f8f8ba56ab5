"""Run tables: headers, timelines and agents of scenario runs, a folder for each run."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statera.sources.storage import listed, publish

HEADER = "scenario string, created_at timestamp_ntz, policy string, config string, metadata string, run_id string"
POLICY = "brackets array<struct<threshold:double,rate:double>>, base_deduction double, child_subsidy double, unemployment_benefit double"


class RunTables:
    """Parquet tables runs, timeline and agents of each run in a folder ``run_id=<id>`` below ``root``, which appears whole or not at all.

    So any number of sessions may store at once: each writes into a folder of its own and renames it when it is whole (see :func:`publish`). A store that
    fails or dies leaves nothing that a reader sees.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def _run(self, name: str, run_id: str) -> DataFrame:
        """A run's rows, with the columns that it was stored with: only its own folder is read."""
        return self.spark.read.parquet(f"{self.root}/run_id={run_id}/{name}").withColumn("run_id", F.lit(run_id))

    def store(self, scenario: str, policy: DataFrame, timeline: DataFrame, agents: DataFrame, config: Mapping[str, str] | None = None, metadata: Mapping[str, str] | None = None, created_at: datetime | None = None) -> str:
        """Append a run (``policy``: one row) and return its new id. Columns go by name."""
        run_id = uuid.uuid4().hex
        text = lambda m: F.to_json(F.create_map(*(F.lit(x) for kv in (m or {}).items() for x in kv))) if m else F.lit("{}")
        stamp = F.lit(created_at).cast("timestamp_ntz") if created_at else F.localtimestamp()
        header = policy.limit(1).select(F.lit(scenario).alias("scenario"), stamp.alias("created_at"), F.to_json(F.struct("brackets", "base_deduction", "child_subsidy", "unemployment_benefit")).alias("policy"), text(config).alias("config"), text(metadata).alias("metadata"))

        def write(folder: str) -> None:
            for name, df in (("timeline", timeline), ("agents", agents), ("runs", header)):
                df.drop("run_id").write.parquet(f"{folder}/{name}")

        if not publish(self.spark, f"{self.root}/run_id={run_id}", write):
            raise FileExistsError(f"run {run_id} is stored already")
        return run_id

    def fetch(self, run_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Header (policy as a struct), timeline by tick and agents by id; an unknown id is an error."""
        try:
            header = self._run("runs", run_id).withColumn("policy", F.from_json("policy", POLICY))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            raise KeyError(run_id) from e
        return header, self._run("timeline", run_id).orderBy("tick"), self._run("agents", run_id).orderBy("agent_id")

    def list_runs(self) -> DataFrame:
        """run_id, scenario, created_at, newest first; no rows before the first store."""
        columns = ("run_id", "scenario", "created_at")
        if not any(n.startswith("run_id=") for n in listed(self.spark, self.root)):
            return self.spark.range(0).select(*(F.lit(None).cast("timestamp_ntz" if c == "created_at" else "string").alias(c) for c in columns))
        headers = self.spark.read.schema(HEADER).option("basePath", self.root).parquet(f"{self.root}/run_id=*/runs")
        return headers.select(*columns).orderBy(F.desc("created_at"), "run_id")

    def export(self, run_id: str, path: str, fmt: str = "parquet") -> dict[str, str]:
        """Write a run's timeline and agents as csv or parquet; their paths."""
        if fmt not in ("csv", "parquet"):
            raise ValueError(f"unknown format {fmt}")
        _, timeline, agents = self.fetch(run_id)
        out = {}
        for name, df in (("timeline", timeline), ("agents", agents)):
            out[name] = f"{path}/{run_id}_{name}.{fmt}"
            writer = df.write.mode("overwrite")
            writer.option("header", True).csv(out[name]) if fmt == "csv" else writer.parquet(out[name])
        return out
