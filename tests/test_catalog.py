"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

from pairforge.queries.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("embeddings", "part", "customer", "documents"):
        c.sql(f"CREATE VIEW {t} AS FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(ORACLES[name])
    assert columns == sorted(want.columns)
    ours = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    theirs = sorted(want.select(*columns).fetchall(), key=repr)
    assert len(ours) == len(theirs)
    assert ours == theirs


@pytest.mark.parametrize("name", ["join_refpoint", "equality_join", "join_signature", "join_clone"])
def test_items_are_not_broadcast(spark, name):
    """However small their files look, items don't go through the driver."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
