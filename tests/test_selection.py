import numpy as np
import pytest
from pyspark.sql import functions as F

from shardfit.functions.losses import logistic_label, logistic_loss, margin_error
from shardfit.operators import metrics as M
from shardfit.operators.layout import assign_folds
from shardfit.operators.rows import to_long, to_sparse
from shardfit.plans import crossval as C
from shardfit.plans.model import fit_model, fit_path, model_layout


def test_boundary_rules(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (1.0, 2.0), (-1.0, 2.0)], "y double, pred double")
    rows = df.select(margin_error(F.col("y"), F.col("pred")).alias("e"),
                     logistic_label(F.col("pred")).alias("l")).collect()
    assert [r.e for r in rows] == [1, 1, 0, 1]
    assert [r.l for r in rows] == [-1, -1, 1, 1]
    assert M.classification_error(df).first()[0] == 0.75
    assert M.classification_error(df, logistic=True).first()[0] == 0.5
    big = spark.createDataFrame([(1.0, -1000.0)], "y double, pred double")
    assert big.select(logistic_loss(F.col("y"), F.col("pred"))).first()[0] == 1000.0


def test_prediction_paths_agree(spark, data, monkeypatch):
    beta = np.arange(7) / 3 - 1
    coef = spark.createDataFrame([(c, float(beta[c])) for c in range(7)], "col int, beta double")
    expected = data["x"] @ beta
    rows = data["reg"]

    def check(df):
        assert np.allclose([r.pred for r in df.orderBy("row_id").collect()], expected)

    check(M.predict(rows, coef, 7))
    check(M.predict(to_sparse(rows), coef, 7))
    check(M.predict_long(to_long(rows), coef, 7))
    monkeypatch.setattr(M, "MATRIX_VALUES", 1)
    check(M.predict(rows, coef, 7))
    found = M.standardized_mse(M.predict(rows, coef, 7)).first()
    sse = ((data["y"] - expected) ** 2).sum()
    assert np.isclose(found["mse"], sse / 40)
    assert np.isclose(found["standardized_mse"], sse / ((data["y"] - data["y"].mean()) ** 2).sum())


def test_lambda_grid(spark):
    assert [r[0] for r in C.lambda_grid(spark).orderBy("lambda").collect()] == list(range(1, 11))
    assert [r[0] for r in C.lambda_grid(spark, 0.1, 0.5, 0.2).orderBy("lambda").collect()] == pytest.approx([0.1, 0.3, 0.5])
    with pytest.raises(ValueError):
        C.lambda_grid(spark, 1, 0)


@pytest.mark.parametrize("loss, lambdas", [
    ("squared", [0.05, 0.5]), ("logistic", [0.05, 0.5]), ("hinge", [2.0]),
])
def test_global_cv_equals_fits_without_the_fold(data, loss, lambdas):
    rows = assign_folds(data["reg" if loss == "squared" else "cls"], 3).cache()
    args = dict(n_blocks=2, q=2, projection="sparse", partitioner="range")
    options = {} if loss == "squared" else {"stopping_gap": 1e-8}
    cv = C.global_cv(rows, lambdas, loss=loss, k=3, fit=options, **args).collect()
    assert len(cv) == 3 * len(lambdas)
    for r in cv:
        train = rows.where(F.col("fold") != r["fold"]).drop("fold")
        coef = fit_model(train, loss=loss, lam=r["lambda"], **args, **options)
        pred = M.predict(rows.where(F.col("fold") == r["fold"]).drop("fold"), coef, 7)
        assert np.isclose(r["error"], M.prediction_error(pred, loss).first()["error"])


def test_cv_scores_joined_when_models_are_large(data, monkeypatch):
    args = dict(k=3, n_blocks=2, q=0, partitioner="range")
    a = C.global_cv(data["reg"], [0.1, 1.0], **args).orderBy("fold", "lambda").collect()
    monkeypatch.setattr(M, "MATRIX_VALUES", 1)
    b = C.global_cv(data["reg"], [0.1, 1.0], **args).orderBy("fold", "lambda").collect()
    assert np.allclose([r.error for r in a], [r.error for r in b])


def test_ties_go_to_the_smaller_penalty(spark):
    cv = spark.createDataFrame(
        [(1, 2.0, 0.5), (2, 2.0, 0.5), (1, 1.0, 0.4), (2, 1.0, 0.6), (1, 3.0, 0.9), (2, 3.0, 0.9)],
        "fold int, lambda double, error double",
    )
    best = C.select_lambda(cv).first()
    assert (best["lambda"], best["mean"]) == (1.0, 0.5)
    s = C.cv_summary(cv).where("lambda = 1").first()
    assert np.isclose(s["var"], 0.02) and np.isclose(s["sd"], np.sqrt(0.02))


def test_local_cv_of_ridge_against_numpy(data):
    from test_fits import designs

    layout, _ = model_layout(data["reg"], 2, 2, "sparse", "add", "range")
    rows = assign_folds(data["reg"], 3, mode="rank").cache()
    fold = np.array([r.fold for r in rows.orderBy("row_id").collect()])
    z_of, y = designs(data["reg"], layout), data["y"]
    for r in C.local_cv(rows, layout, [0.1, 1.0], 3).collect():
        z, at = z_of[r["block"]], fold == r["fold"]
        n = (~at).sum()
        w = np.linalg.solve(z[~at].T @ z[~at] + n * r["lambda"] / 2 * np.eye(z.shape[1]), z[~at].T @ y[~at])
        expected = ((y[at] - z[at] @ w) ** 2).sum() / ((y[at] - y[at].mean()) ** 2).sum()
        assert np.isclose(r["error"], expected)


def test_local_scores_by_pass_equal_those_from_grams(data, monkeypatch):
    layout, _ = model_layout(data["reg"], 2, 2, "sparse", "add", "range")
    rows = assign_folds(data["reg"], 3)
    a = C.local_cv(rows, layout, [0.1, 1.0], 3).orderBy("block", "fold", "lambda").collect()
    weights = C.cv_weights(rows, layout, 3, "squared", [0.1, 1.0])
    monkeypatch.setattr(M, "MATRIX_VALUES", 1)
    b = M.block_fold_errors(rows, layout, weights, "squared").orderBy("block", "fold", "lambda").collect()
    assert np.allclose([r.error for r in a], [r.error for r in b])


def test_local_penalties(data):
    layout, blocks = model_layout(data["cls"], 2, 2, "sparse", "add", "range")
    errors = C.local_cv(data["cls"], layout, [0.1, 1.0], 3, loss="hinge", stopping_gap=1e-3)
    chosen = {r["block"]: r["lambda"] for r in C.select_lambda(errors).collect()}
    coef = C.fit_local_lambda(data["cls"], layout, blocks, [0.1, 1.0], 3, loss="hinge",
                              stopping_gap=1e-3).collect()
    assert {r["block"]: r["lambda"] for r in coef} == chosen and len(coef) == 7
    ridge = C.fit_local_lambda(data["reg"], layout, blocks, C.lambda_grid(data["reg"].sparkSession), 3)
    assert ridge.count() == 7
    with pytest.raises(ValueError, match="logistic"):
        C.local_cv(data["cls"], layout, [0.1], 3, loss="logistic")


@pytest.mark.parametrize("loss", ["squared", "hinge"])
def test_fits_behind_errors_say_whether_they_converged(data, loss, monkeypatch):
    rows = data["reg" if loss == "squared" else "cls"]
    args = dict(loss=loss, k=3, n_blocks=2, q=2, projection="sparse", partitioner="range")
    good = C.global_cv(rows, [1.0], fit={} if loss == "squared" else {"stopping_gap": 1e-3}, **args).collect()
    assert len(good) == 3 and all(r["converged"] and r["gap"] <= 1e-3 for r in good)
    monkeypatch.setattr(M, "MATRIX_VALUES", 1)
    if loss == "hinge":
        bad = C.global_cv(rows, [1.0], fit={"max_iter": 1}, **args).collect()
        assert len(bad) == 3 and not any(r["converged"] for r in bad)
    layout, _ = model_layout(rows, 2, 2, "sparse", "add", "range")
    options = {} if loss == "squared" else {"stopping_gap": 1e-3}
    assert all(r["converged"] for r in C.local_cv(rows, layout, [1.0], 3, loss=loss, **options).collect())
    summary = C.cv_summary(C.local_cv(rows, layout, [1.0], 3, loss=loss, **options))
    assert {"gap", "converged"} <= set(summary.columns)


def test_paths_and_selection_without_a_matrix(data, monkeypatch):
    """Cross-validation, paths and local penalties are the same with every limit at one value."""
    args = dict(n_blocks=2, q=2, projection="SDCT", partitioner="range")

    def all_of():
        layout, blocks = model_layout(data["reg"], **args)
        tables = (C.global_cv(data["reg"], [0.1, 1.0], 3, **args), C.local_cv(data["reg"], layout, [0.1, 1.0], 3),
                  fit_path(data["reg"], layout, blocks, "squared", [0.1, 1.0]),
                  C.fit_local_lambda(data["reg"], layout, blocks, [0.1, 1.0], 3))
        out = []
        for t in tables:
            value = "error" if "error" in t.columns else "beta"
            keys = [c for c in ("col", "block", "fold", "lambda") if c in t.columns]
            out.append({tuple(r[k] for k in keys): r[value] for r in t.collect()})
        return out

    want = all_of()
    monkeypatch.setattr("shardfit.functions.sizes.MATRIX_VALUES", 1)
    monkeypatch.setattr(M, "MATRIX_VALUES", 1)
    for a, b in zip(want, all_of()):
        assert a.keys() == b.keys() and all(np.isclose(a[k], b[k]) for k in a)
