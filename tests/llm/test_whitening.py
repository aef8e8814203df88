"""Whitening against the eigenvectors of the full covariance matrix."""

import numpy as np
import pytest

from shardfit.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def whole(x):
    return np.floor(1024 * np.asarray(x, np.float32).astype(float)).astype(np.int64) + 100_000


def check(got, x, k):
    x = whole(x)
    n = len(x)
    a = x - x.mean(axis=0)
    e, q = np.linalg.eigh(a.T @ a / n)
    e, q = e[::-1], q[:, ::-1]
    got = got.sort_values(["vec_id", "component"])
    assert got["component"].tolist() == list(range(1, k + 1)) * n and set(got["n"]) == {n}
    z, w = got["whitened"].to_numpy().reshape(n, k), a @ q[:, :k] / np.sqrt(e[:k])
    assert np.abs(z * np.sign((z * w).sum(axis=0)) - w).max() < 1e-9
    assert np.allclose(got["explained"].to_numpy().reshape(n, k), e[:k] / e.sum(), rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iat[0] < 1e-9
    exact = ((n * x.astype(object) - x.astype(object).sum(axis=0)) ** 2).sum(axis=1)
    assert got["deviation"].to_numpy().reshape(n, k)[:, 0].tolist() == exact.tolist()


@pytest.mark.parametrize("width", [3, 8, 40])
def test_same_as_eigenvectors(spark, width):
    rng = np.random.default_rng(width)
    x = rng.normal(size=(300, width)) @ rng.normal(size=(width, width)) + 5
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(1000, None), (1001, [1.0] * (width - 1) + [None]), (1002, [float("nan")] * width), (1003, [float("inf")] + [0.0] * (width - 1)), (1004, []), (1005, [1.0])]
    df = spark.createDataFrame([(*r, 1, "a") for r in rows + bad], SCHEMA + ", component int, x string").repartition(4)
    check(whitening.whiten(df).toPandas(), x, min(8, width))


def test_equal_variances_and_few_rows(spark):
    x = np.vstack([np.eye(10), -np.eye(10)])  # nine directions would do; every value is there ten times
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    got = whitening.whiten(df).toPandas()
    assert set(got["component"]) == set(range(1, 9)) and got["identity_error"].max() < 1e-9
    few = spark.createDataFrame([(i, np.eye(12)[i].tolist()) for i in range(4)] * 2, SCHEMA)
    got = whitening.whiten(few).toPandas()
    assert set(got["component"]) == {1, 2, 3} and len(got) == 24  # four points span three directions
    assert got["identity_error"].max() < 1e-9 and abs(got["explained"].iloc[:3].sum() - 1) < 1e-9


def test_edges(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0])] * 3 + [(None, [1.0, 2.0])], SCHEMA)
    assert whitening.whiten(one).count() == 0 and whitening.whiten(one.limit(0)).count() == 0
    large = spark.createDataFrame([(i, [float(i) * 1e9, 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    got = whitening.whiten(large).toPandas()
    assert got["deviation"].isna().any() and set(got["component"]) == {1}  # beyond 64 bits


def test_passes_and_orthogonality(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 64))
    rows, width = whitening.scaled(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA), "vec_id", "embedding")
    found = whitening.bidiagonalise(rows, width, 8)
    assert found.steps <= 64
    assert np.abs(found.components.T @ found.components - np.eye(8)).max() < 1e-13
