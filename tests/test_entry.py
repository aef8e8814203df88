"""Every query against its SQL form at the smallest scale."""

import os

import numpy as np
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
# run by the driver's own comparison; left out here for their many passes
SLOW = {"svm_naive_k64", "svm_cv_k64", "local_cv_svm_k64", "logistic_cv"}


@pytest.fixture(scope="module")
def db():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name[:-8]} as select * from '{DATA}/{name}'")
    return con


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert sorted(r["col"] for r in rows) == list(range(64))


def test_sql_forms_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - SLOW))
def test_query(spark, db, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    expected = db.sql(entry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert sorted(expected.columns) == cols and len(got) == len(expected) > 0
    a, b = (d[cols].sort_values(cols).reset_index(drop=True) for d in (got, expected))
    for c in cols:
        known = a[c].notna().to_numpy()
        assert np.array_equal(known, b[c].notna().to_numpy()), c  # nulls stand in the same rows
        assert np.array_equal(a[c].to_numpy()[known], b[c].to_numpy()[known]), c
