"""Each registered query with SQL gives the SQL's rows on the smallest data; the others run and have rows."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from statera.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v + 0.0:.6g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.6g}"
    return v.isoformat() if isinstance(v, datetime.date) else repr(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, SF)
    found = con.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    theirs = sorted(str([plain(r[i]) for i in order]) for r in found.fetchall())
    assert sorted(str([plain(v) for v in r]) for r in df.collect()) == theirs


@pytest.mark.parametrize("name", ["feature_store", "train_gbt", "model_round_trip", "risk_pipeline"])
def test_runs(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows
    for r in rows:
        if "probability" in r.__fields__:
            assert 0 <= r.probability <= 1
        if "loaded" in r.__fields__:
            assert r.loaded == pytest.approx(r.probability)
