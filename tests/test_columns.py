"""Fits from column-wise storage, tiles, and forms that are scattered by place."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F
from test_fits import beta_of

from shardfit.functions import sizes
from shardfit.operators import columns as K
from shardfit.operators import layout as L
from shardfit.operators import metrics as M
from shardfit.operators.design import block_design
from shardfit.operators.rows import as_rows, sparse_rows, to_dense, to_long, to_sparse
from shardfit.operators.scaling import center_scale, column_range, left_out_ranges
from shardfit.plans import crossval as C
from shardfit.plans.model import fit_columns, fit_model, fit_weights, joined_design, model_layout, model_shape


def test_column_designs_equal_those_of_rows(data, monkeypatch):
    """Dense and sparse columns, in tiles of a few positions that cross chunk borders."""
    rows = data["reg"].withColumn("row_id", F.col("row_id") * 3)
    for mode, q in (("add", 2), ("concatenate", 2), ("add", 0)):
        layout, _ = model_shape(rows.sparkSession, 7, 3, q, "sparse", mode, "random")
        want = {(r["row_id"] // 3, r["block"]): r for r in block_design(rows, layout).collect()}
        for limit in (4_000_000, 23):
            monkeypatch.setattr(L, "CHUNK_VALUES", limit)
            for cols in (L.transpose(rows, 7, 11), L.transpose(to_sparse(rows), chunk_rows=9)):
                got = K.column_design(cols, L.response(rows), layout).collect()
                assert len(got) == len(want)
                for r in got:
                    w = want[r["row_id"], r["block"]]
                    assert r["y"] == w["y"] and np.allclose(r["z"], w["z"])


@pytest.mark.parametrize("loss", ["squared", "logistic"])
@pytest.mark.parametrize("projection", ["SDCT", "sparse"])
def test_fits_of_columns_equal_those_of_rows(data, loss, projection, monkeypatch):
    rows = data["reg" if loss == "squared" else "cls"]
    args = dict(n_blocks=3, q=2, loss=loss, lam=0.3, projection=projection, partitioner="range")
    want = beta_of(fit_model(rows, **args))
    y = L.response(rows)
    for cols in (L.transpose(rows, 7), L.transpose(to_sparse(rows))):
        assert np.allclose(beta_of(fit_columns(cols, y, 7, **args)), want, atol=1e-6)
    monkeypatch.setattr(sizes, "MATRIX_VALUES", 1)
    assert np.allclose(beta_of(fit_columns(cols, y, 7, **args)), want, atol=1e-6)


def test_positions_must_fit(data):
    cols = L.transpose(data["reg"], 7)
    layout, _ = model_shape(data["reg"].sparkSession, 7, 2, 0)
    with pytest.raises(Exception, match="position"):
        K.column_design(cols, L.response(data["reg"]).where("pos <> 5"), layout).collect()
    noisy, _ = model_layout(data["reg"], 2, 2, "sparse", private=True)
    with pytest.raises(ValueError, match="noise"):
        K.column_design(cols, L.response(data["reg"]), noisy)


def test_wide_rows_are_tiled(spark, monkeypatch):
    """At 200 000 columns chunks still hold thousands of positions, and no group more than a tile."""
    p, n = 200_000, 12
    rows = spark.range(n).select(
        (F.col("id") * 7).alias("row_id"), F.lit(0.0).alias("y"),
        F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda c: (c * 10 + F.col("id")).cast("double")).alias("features"))
    cols = L.transpose(rows, p)
    found = cols.agg(F.count_distinct("col"), F.sum(F.size("obs")), F.max("chunk")).first()
    assert tuple(found)[:2] == (p, p * n) and found[2] < 4  # one chunk for each range of sorted rows
    whole = {}
    for r in cols.where("col % 39999 = 0").orderBy("col", "start").collect():
        whole.setdefault(r["col"], []).extend(r["obs"])
    assert len(whole) == 6 and all(x == [c * 10.0 + i for i in range(n)] for c, x in whole.items())
    monkeypatch.setattr(L, "CHUNK_VALUES", 40)
    monkeypatch.setattr(L, "LEAST_ROWS", 50)
    monkeypatch.setattr(L, "ROW_CHUNK", 8)
    small = rows.withColumn("features", F.slice("features", 1, 33)).repartition(5)
    cols = L.transpose(small, 33).orderBy("col", "start").collect()
    seen = {}
    for r in cols:
        assert len(r["obs"]) <= 8 and r["start"] == len(seen.setdefault(r["col"], []))
        seen[r["col"]] += r["obs"]
    assert seen == {c: [c * 10.0 + i for i in range(n)] for c in range(33)}


def test_null_ids_fail(spark):
    df = spark.createDataFrame([(1, 1.0), (None, 2.0)], "row_id bigint, y double")
    with pytest.raises(Exception, match="must not be null"):
        L.number_rows(df).collect()


def test_dense_rows_by_place(spark):
    rows = spark.createDataFrame(
        [(1, 1.0, "a", [(2, 5.0), (70_000, 1.0)]), (2, 0.0, "b", [])],
        "row_id bigint, y double, kind string, entries array<struct<col:int,x:double>>")
    found = to_dense(rows, 70_001).orderBy("row_id").collect()
    assert found[0]["kind"] == "a" and len(found[0]["features"]) == 70_001
    assert {c: x for c, x in enumerate(found[0]["features"]) if x} == {2: 5.0, 70_000: 1.0}
    assert set(found[1]["features"]) == {0.0}
    assert [r["features"] for r in to_dense(rows.where("row_id = 2"), 0).collect()] == [[]]
    with pytest.raises(Exception, match="outside"):
        to_dense(rows, 10).collect()


def test_vectors_sparse_and_dense(spark):
    rows = spark.createDataFrame([(i, float(i), 0.0, 0.0, float(i % 3), 0.0) for i in range(9)],
                                 "row_id bigint, y double, a double, b double, c double, d double")
    vectors = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(rows).repartition(2)
    kinds = {type(r["features"]).__name__ for r in vectors.collect()}
    assert "SparseVector" in kinds
    got = {(r["row_id"], r["col"]): r["x"] for r in to_long(sparse_rows(vectors.select("row_id", "y", "features"))).collect()}
    assert got == {(i, 2): float(i % 3) for i in range(9) if i % 3}
    both = vectors.select("row_id", "y", "features").unionByName(
        vectors.select((F.col("row_id") + 100).alias("row_id"), "y", F.expr("features")))
    assert as_rows(both).count() == sparse_rows(both).count() == 18


@pytest.mark.parametrize("loss", ["squared", "logistic", "hinge"])
def test_certificate_without_joins(data, loss):
    rows = data["reg" if loss == "squared" else "cls"]
    coef = rows.sparkSession.createDataFrame([(c, c / 10 - 0.3) for c in range(7)], "col int, beta double")
    pred = M.predict(rows, coef, 7)
    if loss == "hinge":
        column = F.col("y") * F.abs(F.sin(F.col("row_id").cast("double")))
        alpha = pred.select("row_id", column.alias("alpha"))
    else:
        column, alpha = None, M.dual_from_primal(pred, loss)
    want = M.duality_gap(rows, pred, coef, alpha, 0.2, loss).first()
    for form in (rows, to_sparse(rows)):
        got = M.certificate(form, coef, 7, 0.2, loss, column)
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
        got = got.first()
        assert all(np.isclose(got[c], want[c]) for c in ("primal", "dual", "gap"))
    assert M.certificate(rows, coef, 7, 0.2, loss).first()["gap"] >= 0


@pytest.mark.parametrize("loss", ["squared", "logistic", "hinge"])
def test_objectives_of_block_fits(data, loss):
    rows = data["reg" if loss == "squared" else "cls"]
    layout, _ = model_layout(rows, 2, 2, "sparse", "add", "range")
    weights = fit_weights(rows, layout, loss, [0.1, 1.0])
    w = {}
    for r in weights.orderBy("i").collect():
        w.setdefault((r["block"], r["lambda"]), []).append(r["beta"])
    z = {}
    for r in block_design(rows, layout).orderBy("row_id").collect():
        z.setdefault(r["block"], []).append((r["y"], r["z"]))
    for r in M.block_objectives(rows, layout, weights, loss).collect():
        y, x = (np.array(v) for v in zip(*z[r["block"]]))
        v = np.array(w[r["block"], r["lambda"]])
        s = x @ v
        value = {"squared": (y - s) ** 2, "hinge": np.maximum(1 - y * s, 0), "logistic": np.logaddexp(0, -y * s)}[loss]
        assert np.isclose(r["objective"], value.mean() + r["lambda"] / 2 * v @ v) and r["converged"] is not None


@pytest.mark.parametrize("mode", ["add", "concatenate"])
def test_joined_designs_of_rows_without_entries(spark, mode):
    rows = spark.createDataFrame([(1, 1.0, [(0, 2.0)]), (2, -1.0, [])], "row_id bigint, y double, entries array<struct<col:int,x:double>>")
    layout, blocks = model_layout(rows, 3, 2, "sparse", mode, "range", n_features=6)
    want = {(r["row_id"], r["block"]): r["z"] for r in block_design(rows, layout).collect()}
    got = joined_design(rows, 6, blocks, 3, 2, "sparse", mode, 1)
    assert got.columns[:4] == ["row_id", "y", "block", "z"]
    found = {(r["row_id"], r["block"]): r["z"] for r in got.collect()}
    assert found.keys() == want.keys() and all(np.allclose(found[k], want[k]) for k in want)


def test_private_validation_uses_the_training_ranges(data):
    folded = L.assign_folds(data["reg"], 3).cache()
    blocks = L.assign_blocks(folded.sparkSession, 7, 2, "range")
    for rows in (folded, to_sparse(folded)):
        found = {(r["fold"], r["block"]): r["range"] for r in left_out_ranges(rows, blocks, 3).collect()}
        for f in (1, 2, 3):
            train = rows.where(F.col("fold") != f)
            want = column_range(to_long(train), blocks, train.count() if "entries" in rows.columns else None)
            assert all(np.isclose(found[f, r["block"]], r["range"]) for r in want.collect())
    args = dict(n_blocks=2, q=2, projection="sparse", partitioner="range", private=True, noise_seed=5)
    for r in C.global_cv(folded, [0.5], 3, **args).collect():
        train = folded.where(F.col("fold") != r["fold"]).drop("fold")
        pred = M.predict(folded.where(F.col("fold") == r["fold"]).drop("fold"), fit_model(train, lam=0.5, **args), 7)
        assert np.isclose(r["error"], M.mse(pred).first()["mse"]) and r["converged"]


def test_scaling_by_expression_and_in_numpy(data, monkeypatch):
    def scaled():
        return np.array([r["features"] for r in center_scale(data["reg"]).orderBy("row_id").collect()])

    by_expression = scaled()
    bad = data["reg"].withColumn("features", F.when(F.col("row_id") == 3, F.array(F.lit(1.0))).otherwise(F.col("features")))
    with pytest.raises(Exception, match="7 values"):
        center_scale(data["reg"], bad)[1].collect()
    monkeypatch.setattr("shardfit.operators.scaling.EXPRESSION_WIDTH", 0)
    assert np.allclose(scaled(), by_expression, rtol=0, atol=1e-12)
