"""Every query with SQL against DuckDB on the driver's tables; the others against invariants."""

import math

import pytest

import __spark_entry__
from priorframe import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canon(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return int(v) if isinstance(v, bool) else v


def rows(records, columns):
    return sorted((tuple(canon(x) for x in r) for r in records), key=str), columns


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(canon(r[c]) for c in columns) for r in df.collect()), key=str)
    r = duck.execute(queries.SQL[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == columns
    want = sorted((tuple(canon(x[names.index(c)]) for c in columns) for x in r.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["wf_linear", "wf_trees", "wf_neural", "wf_ensemble", "wf_baselines"])
def test_walk_forward_invariants(spark, name):
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.01").toPandas()
    assert len(got) and got["p_home"].between(0, 1).all() and got[["pred_spread", "pred_total"]].notna().all().all()
    assert not got.duplicated(["model", "game_id"]).any()
