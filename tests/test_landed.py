"""Landed payloads stay small whatever the number of rows."""

from pyspark.sql import functions as F

from statera import queries


def test_payloads_do_not_grow_with_the_rows(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/landed"
    monkeypatch.setattr(queries, "scratch", lambda _: path)
    rows = spark.range(100_000).select(F.col("id").cast("string").alias("people"), F.when(F.col("id") % 2 == 0, "x").alias("iso3"))
    found = queries._landed(spark, None, rows, "data")
    assert sorted(map(tuple, found.select("people", "iso3").collect())) == sorted(map(tuple, rows.collect()))
    assert spark.read.json(path).agg(F.max(F.size("data"))).first()[0] <= 1000
