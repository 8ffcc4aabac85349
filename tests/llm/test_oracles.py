"""The opN_ queries that have SQL, against DuckDB; and where intermediate tables go."""

import pytest

from priorframe.llm import oracles, queries, store

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    r = con.execute(oracles.SQL[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == columns
    want = sorted((tuple(x[names.index(c)] for c in columns) for x in r.fetchall()), key=str)
    assert sorted((tuple(x[c] for c in columns) for x in df.collect()), key=str) == want


class Context:
    def __init__(self, master):
        self.master, self.applicationId = master, f"app-{master}"


class Session:
    def __init__(self, master, value=None):
        self.sparkContext = Context(master)
        self.conf = {"spark.checkpoint.dir": value} if value else {}


def test_shared_folder():
    assert store.shared_dir(Session("spark://x", "hdfs://a/b/")) == "hdfs://a/b"
    assert store.shared_dir(Session("local[2]")) == store.shared_dir(Session("local[2]"))
    with pytest.raises(ValueError):
        store.shared_dir(Session("yarn"))
