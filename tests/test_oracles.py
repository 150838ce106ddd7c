"""Every registered query against its SQL definition, over the whole given tables."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


def ordered(frame):
    cols = sorted(frame.columns)
    exact = [c for c in cols if frame[c].dtype.kind != "f"]
    return frame[cols].sort_values(exact + [c for c in cols if c not in exact]).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sf, duck, name):
    got = entry.queries()[name](spark, sf).toPandas()
    assert len(got.columns) == len(set(got.columns))
    if name not in entry.oracle_sql():
        assert len(got) > 0
        return
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    a, b = ordered(got), ordered(want)
    for c in a.columns:
        if a[c].dtype.kind == "f" or b[c].dtype.kind == "f":
            np.testing.assert_array_equal(a[c].astype(float).values, b[c].astype(float).values, err_msg=c)
        else:
            assert a[c].astype(str).tolist() == b[c].astype(str).tolist(), c


def test_entry_is_the_search(spark):
    df = entry.entry(spark)
    assert df.columns == ["volume_id", "x", "y", "z", "sim"]
    assert df.count() == 32_000
