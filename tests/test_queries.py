"""Every registered query with SQL, against DuckDB on the smallest tables."""

import math
import os

import pytest

from quarry import queries as Q

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    return sorted([tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in r) for r in rows], key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    want = con.sql(Q.SQL[name])
    cols = sorted(want.columns)
    got = Q.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert plain(tuple(r) for r in got.select(*[f"`{c}`" for c in cols]).collect()) == plain(tuple(r[i] for i in at) for r in want.fetchall())


def test_entry_without_training_operators(monkeypatch):
    """The entry module works where neither the training-data package nor the pipeline is there."""
    import importlib
    import sys

    import __spark_entry__

    for m in [m for m in sys.modules if m.startswith("quarry.llm")] + ["corpus_pipeline"]:
        monkeypatch.setitem(sys.modules, m, None)
    monkeypatch.setitem(sys.modules, "quarry.llm", None)
    monkeypatch.setitem(sys.modules, "quarry.llm.registry", None)
    try:
        e = importlib.reload(__spark_entry__)
        assert set(e.queries()) == set(Q.QUERIES) and set(e.oracle_sql()) == set(Q.SQL)
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)
