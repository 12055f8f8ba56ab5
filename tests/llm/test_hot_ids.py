"""Ids that a third of the rows share, or lack: rows stay spread, and results are those of brute force."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
import xxhash
from pyspark.sql import functions as F

from statera.llm import order_minhash, token_store
from statera.llm.common import materialise
from statera.llm.components import components, large_star

SCHEMA = "doc_id long, text string"


def rows_with_hot_ids(n: int = 900) -> list[tuple[int | None, str]]:
    """A third of the rows without an id, a third with one id, a third with ids on both sides of that."""
    return [((None, 500, i)[i % 3], f"text {i} of {i * i} words") for i in range(n)]


def test_next_row_of_hot_ids(spark):
    rows = rows_with_hot_ids()
    signed = lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(t.encode(), 42))
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -signed(r[1]), r[1]))
    want = {(*r, order[(i + 1) % len(order)][1]) for i, r in enumerate(order)}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = order_minhash.with_next(spark.createDataFrame(rows, SCHEMA), "doc_id", ["text"])
        assert {(r.doc_id, r.text, r.next_text) for r in got.collect()} == want and got.count() == len(rows)
        assert max(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()) < len(rows) / 3
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_next_row_where_all_have_one_id(spark):
    for value in (None, 3):
        rows = [(value, f"text {i}") for i in range(400)]
        got = order_minhash.with_next(spark.createDataFrame(rows, SCHEMA), "doc_id", ["text"]).collect()
        after = {r.text: r.next_text for r in got}
        at, seen = "text 0", set()
        while at not in seen:  # one ring of all rows
            seen.add(at)
            at = after[at]
        assert len(got) == len(seen) == len(rows)


def test_recipes_of_hot_ids_stay_spread(spark, tmp_path: Path):
    rows = rows_with_hot_ids(600) + [(7, "the same text")] * 300
    path = str(tmp_path / "store")
    token_store.write_store(spark.createDataFrame(rows, SCHEMA).repartition(6), path, str(public_tokenizers.path("byte_bpe_50k.json")))
    got = sorted(token_store.read_store(spark, path).collect(), key=lambda r: r.start)
    assert all(r.verified for r in got) and len(got) == len(rows)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0)) and sorted(ids, key=str) == sorted((r[0] for r in rows), key=str)
    blocks = [r["count"] for r in spark.read.parquet(f"{path}/recipes").groupBy("block").count().collect()]
    assert max(blocks) < len(rows) / 5


def test_hub_of_a_star_is_split(spark):
    """The edges of a node that all others are tied to are joined in more tasks than one."""
    n = 100_000
    edges = spark.range(1, n).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b")).unionByName(spark.createDataFrame([(n, n - 1)], "a long, b long"))
    edges = materialise(edges, "star")
    small = ["spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes"]
    settings = {**dict.fromkeys(small, "16k"), "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        tied = large_star(edges)
        # n is tied to the smallest neighbour of n - 1, and so is n - 1
        assert len(tied.collect()) == n and tied.where("b <> 0").count() == 0
        assert "SortMergeJoin(skew=true)" in tied._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert components(edges).where("root <> 0").count() == 0
