"""Every catalogue query that has SQL gives the SQL's rows on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from airweave.operators import baseline, bootstrap, memd
from airweave.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM read_parquet('{SF}/{t}')")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return v.isoformat() if hasattr(v, "isoformat") else float(v) + 0.0 if not isinstance(v, str) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, SF)
    want = con.sql(SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert Counter(tuple(plain(r[c]) for c in cols) for r in df.collect()) == Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    n, *there = df.agg(F.count("*"), *[F.count(c) for c in df.columns]).collect()[0]
    assert n > 0 and all(there)  # rows, and no column without any value


def test_registered_with_the_operators_own_grids(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(bootstrap, "run", lambda spark, obs, sampler, grid, replicates=bootstrap.REPLICATES, **kw: seen.append((len(grid), replicates)))
    monkeypatch.setattr(bootstrap, "bounds", lambda df: df)
    monkeypatch.setattr(bootstrap, "with_grid", lambda df, grid: df)
    for name in ("bootstrap_bounds", "bootstrap_aggregation", "bootstrap_tradeoff"):
        QUERIES[name](spark, SF)
    assert seen == [(100, 1000), (336, 1000), (9801, 1000)]
    given = []
    monkeypatch.setattr(memd, "decompose", lambda df, **kw: given.append(kw) or df.withColumn("imf", F.lit(0)))
    QUERIES["memd_energies"](spark, SF)
    fit = baseline.sensitivity
    monkeypatch.setattr(baseline, "sensitivity", lambda df, value, grid=None: given.append(grid) or fit(df, value, grid))
    QUERIES["baseline_sensitivity"](spark, SF)
    assert given == [{}, None] and len(baseline.sensitivity_grid()) == 161
