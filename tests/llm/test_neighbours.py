"""Nearest neighbours against distances of all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from statera.llm import block_neighbours

SF = "/root/testdata/sf0.001"
ROW = "vec_id long, embedding array<double>, label int, code string, class_id int"


def brute_nearest(rows, every, k=10):
    known = {}
    for r in rows:
        x = r.embedding
        if r.vec_id is None or x is None or any(v is None or not math.isfinite(v) for v in x) or not any(x):
            continue
        x = np.array(x, np.float64)
        if r.vec_id not in known or block_neighbours.packed(x) < block_neighbours.packed(known[r.vec_id]):
            known[r.vec_id] = x
    width = max(map(len, known.values()), default=0)
    full = {i: np.pad(x, (0, width - len(x))) for i, x in known.items()}
    out = []
    with np.errstate(over="ignore"):
        for q in sorted(i for i in full if i % every == 0):
            found = sorted((float(np.sqrt(np.cumsum((full[q] - x) ** 2)[-1])), i) for i, x in full.items() if i != q)[:k]
            out += [(q, n, i, d) for n, (d, i) in enumerate(found, 1)]
    return out


def answer(df):
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in df.collect())


def test_given_embeddings(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert answer(block_neighbours.nearest(rows, F.col("vec_id") % 100 == 0)) == brute_nearest(rows.collect(), 100)


@pytest.mark.parametrize("row_block", [7, 16384])
def test_odd_vectors(spark, monkeypatch, row_block):
    """Nulls, zeros, huge and tiny components, ties, repeats, a vector that a third of the rows share, other lengths and columns."""
    monkeypatch.setattr(block_neighbours, "ROW_BLOCK", row_block)
    monkeypatch.setattr(block_neighbours, "QUERY_BLOCK", 3)
    monkeypatch.setattr(block_neighbours, "PRODUCTS_AT_ONCE", 40)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(i, [0.5] * 8) for i in range(60, 100)]
    rows += [(i, [float(i % 3), 1.0, 0.0]) for i in range(100, 112)]  # ties, shorter
    rows += [(200, None), (201, [None, 1.0]), (202, [float("nan")] * 8), (203, [float("inf")] * 8), (204, [0.0] * 8), (205, []), (None, [1.0] * 8)]
    rows += [(206, [1e300] * 8), (207, [-1e300] * 8), (208, [1e-300] * 8), (209, [5e-324, 0.0]), (210, [3e38] * 8), (3, [9.0] * 8), (3, [9.0] * 8)]
    table = spark.createDataFrame([(i, x, None, "x", 1) for i, x in rows], ROW).repartition(4)
    assert answer(block_neighbours.nearest(table, F.col("vec_id") % 2 == 0)) == brute_nearest(table.collect(), 2)


def test_few_and_no_rows(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0], 1, "x", 1), (1, [1.0, 2.5], None, None, None)], ROW)
    assert answer(block_neighbours.nearest(table, F.col("vec_id") % 100 == 0)) == [(0, 1, 1, 0.5)]
    assert answer(block_neighbours.nearest(table.where("vec_id < 0"), F.col("vec_id") % 100 == 0)) == []


def test_bounds_hold_and_prune():
    """The distance lies within its bounds, and on unlike vectors they leave few pairs."""
    import pandas as pd

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 64)) * rng.choice([1e-3, 1, 1e3], size=(400, 1))
    frame = pd.DataFrame([(i, *block_neighbours.quantised(v)) for i, v in enumerate(x)], columns=["class_id", "q8", "scale", "rest"])
    true = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for part, least, most in block_neighbours.bounds(frame, frame):
        some = part["class_id"].to_numpy()
        assert (least <= true[some]).all() and (true[some] <= most).all()
    unit = rng.normal(size=(2000, 64))
    frame = pd.DataFrame([(i, *block_neighbours.quantised(v)) for i, v in enumerate(unit)], columns=["class_id", "q8", "scale", "rest"])
    left = block_neighbours.survivors(frame, frame.iloc[:20], 11)
    assert len(left) < 20 * 40
