import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from shardfit.functions import sizes
from shardfit.operators import gram as G
from shardfit.operators import newton as N
from shardfit.operators.design import block_design
from shardfit.operators.metrics import dual_from_primal, duality_gap, predict
from shardfit.operators.ridge import assemble_coefficients, own_coefficients
from shardfit.operators.rows import to_sparse
from shardfit.plans.evaluate import evaluate, report
from shardfit.plans.model import fit_block, fit_model, fit_path, fit_weights, model_layout


def designs(rows, layout):
    found = block_design(rows, layout).orderBy("row_id").collect()
    return {
        k: np.array([r.z for r in found if r.block == k]) for k in range(layout.n_blocks)
    }


def by_block(weights):
    out = {}
    for r in weights.orderBy("i").collect():
        out.setdefault(r["block"], []).append(r["beta"])
    return {k: np.array(v) for k, v in out.items()}


def beta_of(coef, p=7):
    out = np.zeros(p)
    for r in coef.collect():
        out[r["col"]] = r["beta"]
    return out


@pytest.mark.parametrize("mode", ["add", "concatenate"])
def test_ridge_meets_its_optimality_condition(data, mode):
    layout, _ = model_layout(data["reg"], 3, 2, "sparse", mode, "range")
    weights = by_block(fit_weights(data["reg"], layout, "squared", 0.3))
    for k, z in designs(data["reg"], layout).items():
        w = weights[k]
        residual = 0.3 * w - 2 / 40 * z.T @ (data["y"] - z @ w)
        assert np.abs(residual).max() < 1e-9


def test_one_block_is_the_whole_ridge_model(data):
    coef = fit_model(data["reg"], 1, 5, lam=0.3, mode="concatenate")
    x, y = data["x"], data["y"]
    w = np.linalg.solve(x.T @ x + 40 * 0.15 * np.eye(7), x.T @ y)
    assert np.allclose(beta_of(coef), w)
    y_sd = float(np.std(y))
    table = data["reg"].select("y", array_to_vector("features").alias("x"))
    model = LinearRegression(
        featuresCol="x", labelCol="y", fitIntercept=False, standardization=False,
        regParam=0.15 * y_sd, solver="normal",
    ).fit(table)
    assert np.allclose(model.coefficients.toArray(), w)


def test_sparse_rows_give_the_same_model(data):
    args = dict(n_blocks=3, q=2, lam=0.3, projection="sparse", partitioner="range")
    assert np.allclose(beta_of(fit_model(data["reg"], **args)),
                       beta_of(fit_model(to_sparse(data["reg"]), n_features=7, **args)))


@pytest.mark.parametrize("projection", ["SDCT", "sparse"])
@pytest.mark.parametrize("mode", ["add", "concatenate"])
def test_no_matrix_gives_the_same_model(data, monkeypatch, projection, mode):
    args = dict(n_blocks=3, q=2, lam=0.3, projection=projection, mode=mode, partitioner="range")
    direct = beta_of(fit_model(data["reg"], **args))
    monkeypatch.setattr(sizes, "MATRIX_VALUES", 1)
    assert np.allclose(direct, beta_of(fit_model(data["reg"], **args)))
    assert np.allclose(direct, beta_of(fit_model(to_sparse(data["reg"]), n_features=7, **args)))


def test_gram_in_groups_of_blocks(data, monkeypatch):
    layout, _ = model_layout(data["reg"], 3, 2, "sparse", "add", "range")
    whole = G.gram_rows(data["reg"], layout).orderBy("block", "i", "j").collect()
    monkeypatch.setattr(G, "TASK_VALUES", 10)
    split = G.gram_rows(data["reg"], layout)
    assert split.count() == len(whole)
    assert np.allclose([r.v for r in whole], [r.v for r in split.orderBy("block", "i", "j").collect()])
    published = G.gram(block_design(data["reg"], layout)).orderBy("block", "i", "j").collect()
    assert np.allclose([r.v for r in whole], [r.v for r in published])


def test_zero_column_gets_zero(spark):
    rows = spark.createDataFrame(
        [(i, float(i), [float(i), 0.0]) for i in range(5)], "row_id bigint, y double, features array<double>"
    )
    coef = fit_model(rows, 2, 0, lam=0.1)
    assert beta_of(coef, 2)[1] == 0
    full = assemble_coefficients(coef.where("col = 0"), 3).orderBy("col").collect()
    assert [r.beta for r in full][1:] == [0.0, 0.0]


def hinge_optimum(z, y, lam):
    """Dual coordinate ascent, run long enough for a small fixture."""
    n, m = z.shape
    w, alpha = np.zeros(m), np.zeros(n)
    for _ in range(20000):
        for i in range(n):
            norm = z[i] @ z[i]
            new = np.clip(alpha[i] + (1 - y[i] * z[i] @ w) * lam * n / norm, 0, 1)
            w += z[i] * y[i] * (new - alpha[i]) / (lam * n)
            alpha[i] = new
        primal = np.maximum(1 - y * (z @ w), 0).mean() + lam / 2 * w @ w
        if primal - (alpha.mean() - lam / 2 * w @ w) < 1e-11:
            break
    return w


@pytest.mark.parametrize("lam", [0.05, 1.0])
def test_svm_is_the_optimum_and_certified(data, lam):
    layout, _ = model_layout(data["cls"], 2, 2, "sparse", "add", "range")
    weights = N.fit_margin_rows(data["cls"], layout, "hinge", [lam], stopping_gap=1e-9)
    assert weights.agg(F.max("gap")).first()[0] <= 1e-9
    found = by_block(weights)
    for k, z in designs(data["cls"], layout).items():
        assert np.allclose(found[k], hinge_optimum(z, data["s"], lam), atol=1e-4)


def test_logistic_gradient_vanishes(data):
    layout, _ = model_layout(data["cls"], 2, 2, "sparse", "add", "range")
    found = by_block(N.fit_margin_rows(data["cls"], layout, "logistic", [0.05], stopping_gap=1e-12))
    for k, z in designs(data["cls"], layout).items():
        w, s = found[k], data["s"]
        slope = 0.05 * w - z.T @ (s / (1 + np.exp(s * (z @ w)))) / 40
        assert np.abs(slope).max() < 1e-9


def test_published_designs_and_groups_give_the_same_fit(data, monkeypatch):
    layout, _ = model_layout(data["cls"], 2, 2, "sparse", "add", "range")
    direct = by_block(N.fit_margin_rows(data["cls"], layout, "logistic", [0.1]))
    design = block_design(data["cls"], layout)
    monkeypatch.setattr(N, "TASK_VALUES", 10)
    monkeypatch.setattr(N, "DRIVER_VALUES", 0)
    for weights in (N.fit_logistic(design, 0.1), fit_block(design, "logistic", 0.1)):
        found = by_block(weights)
        assert all(np.allclose(direct[k], found[k]) for k in direct)
    svm = by_block(N.fit_svm(design, 2.0))
    again = by_block(N.fit_margin_rows(data["cls"], layout, "hinge", [2.0]))
    assert all(np.allclose(svm[k], again[k], atol=2e-3) for k in svm)


@pytest.mark.parametrize("loss", ["squared", "hinge", "logistic"])
def test_one_contract_at_any_width(data, loss, monkeypatch):
    """With the limit lowered the same columns, options and weights come without m x m systems."""
    rows = data["reg"] if loss == "squared" else data["cls"]
    layout, _ = model_layout(rows, 2, 2, "sparse", "add", "range")
    gap = {"squared": 1e-14, "hinge": 1e-10, "logistic": 1e-14}[loss]
    want = fit_weights(rows, layout, loss, [0.1, 1.0], stopping_gap=gap)
    monkeypatch.setattr(sizes, "DENSE_WIDTH", 1)
    for got in (fit_weights(rows, layout, loss, [0.1, 1.0], stopping_gap=gap),
                fit_block(block_design(rows, layout), loss, [0.1, 1.0], stopping_gap=gap)):
        assert got.columns == want.columns
        a, b = ({tuple(r[:4]): r for r in t.collect()} for t in (want, got))
        assert a.keys() == b.keys()
        # a gap g lies within sqrt(2 g / lambda) of the optimum
        assert all(abs(a[k]["beta"] - b[k]["beta"]) < (1e-4 if loss == "hinge" else 1e-6) for k in a)
        assert all(r["converged"] and r["gap"] <= max(1e-12, gap) for r in b.values())


def test_unconverged_fits_say_so(data, monkeypatch):
    layout, _ = model_layout(data["cls"], 2, 0)
    for width in (4096, 1):
        monkeypatch.setattr(sizes, "DENSE_WIDTH", width)
        assert not any(r["converged"] for r in fit_weights(data["cls"], layout, "hinge", 0.1, max_iter=2).collect())


@pytest.mark.parametrize("loss", ["squared", "logistic"])
def test_gap_is_zero_at_the_optimum_and_positive_elsewhere(data, loss):
    rows = data["reg"] if loss == "squared" else data["cls"]
    options = {} if loss == "squared" else {"stopping_gap": 1e-13}
    coef = fit_model(rows, 1, 0, loss, 0.2, **options)
    pred = predict(rows, coef, 7)
    alpha = dual_from_primal(pred, loss)
    gap = duality_gap(rows, pred, coef, alpha, 0.2, loss).first()["gap"]
    assert abs(gap) < 1e-9
    worse = coef.withColumn("beta", F.col("beta") * 1.3)
    pred = predict(rows, worse, 7)
    assert duality_gap(rows, pred, worse, dual_from_primal(pred, loss), 0.2, loss).first()["gap"] > 1e-4
    with pytest.raises(ValueError, match="hinge"):
        dual_from_primal(pred, "hinge")


def test_path_equals_single_fits(data):
    layout, blocks = model_layout(data["cls"], 2, 1, "sparse", "add", "range")
    path = fit_path(data["cls"], layout, blocks, "logistic", [0.1, 1.0])
    for lam in (0.1, 1.0):
        one = fit_model(data["cls"], 2, 1, "logistic", lam, "sparse", partitioner="range")
        assert np.allclose(beta_of(path.where(F.col("lambda") == lam)), beta_of(one))


def test_refusals(data):
    for kwargs, text in (
        (dict(loss="absolute"), "loss"), (dict(lam=0.0), "penalties"),
        (dict(projection="dense"), "projection"), (dict(mode="other"), "mode"),
        (dict(q=4), "exceeds"), (dict(n_blocks=9), "cannot fill"),
    ):
        with pytest.raises(ValueError, match=text):
            fit_model(data["reg"], **{"n_blocks": 3, "q": 2, **kwargs}).collect()


def test_report(spark, tmp_path, data):
    coef = fit_model(data["cls"], 2, 2, "logistic", 0.1, "sparse")
    path = str(tmp_path / "run")
    metrics = report(data["cls"], data["cls"], coef, 7, "logistic", {"q": 2}, path).collect()
    assert {m["data"] for m in metrics} == {"train", "test"}
    assert spark.read.parquet(path + "/coef").count() == 7
    assert evaluate(data["reg"], coef, 7, "squared").first()["mse"] > 0
    assert own_coefficients(
        spark.createDataFrame([(0, 0, 0.5)], "block int, i int, beta double"),
        spark.createDataFrame([(3, 0)], "col int, block int"),
    ).first()["col"] == 3


@pytest.mark.parametrize("loss, most", [("squared", 12), ("logistic", 60), ("hinge", 300)])
def test_wide_fits_of_uneven_columns_take_few_passes(data, loss, most):
    """Columns whose squares differ by twelve orders; the preconditioner makes them alike."""
    from shardfit.functions.shared import Shared
    from shardfit.operators import wide
    from shardfit.operators.design import RowsFeed, feed_rows

    rows = data["reg" if loss == "squared" else "cls"]
    sizes_of = F.array(*[F.lit(10.0 ** (c - 3)) for c in range(7)])
    rows = rows.withColumn("features", F.transform("features", lambda x, i: x * F.get(sizes_of, i)))
    layout, _ = model_layout(rows, 1, 0)
    fits = [wide.Fit(0, 0, lam, np.zeros(7), loss, 1e-6) for lam in (0.01, 1.0)]
    wide.solve(feed_rows(rows, layout).drop("row_id"), RowsFeed(Shared(rows.sparkSession, layout)), fits, loss, 100)
    assert all(f.converged and f.gap <= 1e-6 and f.passes <= most for f in fits), [(f.gap, f.passes) for f in fits]


def test_sparse_rows_meet_wide_fits_as_entries(data, monkeypatch):
    """The same fit as from dense rows, without a dense matrix; slices of a few entries, and a column that comes twice."""
    from shardfit.operators import design

    layout, _ = model_layout(data["cls"], 2, 2, "sparse", "concatenate", "range")
    twice = F.flatten(F.transform("entries", lambda e: F.array(*[
        F.struct(e["col"].alias("col"), (e["x"] / 2).alias("x")) for _ in range(2)])))
    sparse = to_sparse(data["cls"]).withColumn("entries", twice)
    monkeypatch.setattr(sizes, "DENSE_WIDTH", 1)
    monkeypatch.setattr(design, "SLICE_ENTRIES", 20)
    for loss in ("squared", "logistic"):
        want = by_block(fit_weights(data["cls"], layout, loss, 0.3, stopping_gap=1e-13))
        found = by_block(fit_weights(sparse, layout, loss, 0.3, stopping_gap=1e-13))
        assert all(np.allclose(want[k], found[k], atol=1e-6) for k in want)
    rng = np.random.default_rng(3)
    at, x, others, a = rng.integers(0, 30, 50), rng.normal(size=50), rng.normal(size=(5, 2)), rng.normal(size=5)
    z = design.EntryMatrix(at // 6, at % 6, x, 5, 6)
    z.others = others
    dense = np.hstack([np.bincount(at, weights=x, minlength=30).reshape(5, 6), others])
    w = rng.normal(size=(8, 3))
    assert z.shape == dense.shape and np.allclose(z @ w, dense @ w)
    assert np.allclose(z.left(a), a @ dense) and np.allclose(z.left_squares(a), a @ dense ** 2)


def test_lengths_of_documents_are_summed_once(spark, tmp_path):
    """A text of 20 000 words: its length was summed anew for each of them."""
    import time

    from shardfit.catalog.many_columns import unit_documents

    texts = [(1, " ".join(f"w{i}" for i in range(20_000))), (2, "a b a"), (3, " "), (4, None)]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(1, 5)], "doc_id bigint, quality int").write.parquet(
        f"{tmp_path}/labels.parquet")
    start = time.time()
    rows = {r["row_id"]: [e["x"] for e in r["entries"]] for r in unit_documents(spark, str(tmp_path), 1 << 16).collect()}
    assert time.time() - start < 10
    assert abs(np.square(rows[1]).sum() - 1) < 1e-9 and sorted(rows[2]) == [5 ** -0.5, 2 / 5 ** 0.5] and rows[3] == rows[4] == []
