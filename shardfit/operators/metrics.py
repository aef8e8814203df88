"""Predictions, errors, objectives and duality gaps."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardfit.functions.arrow import entries_of, matrix_of, multiply
from shardfit.functions.losses import (
    check_loss, conjugate_column, logistic_error, loss_column, margin_error, squared_loss,
)
from shardfit.functions.shared import Shared, from_driver, to_driver
from shardfit.functions.sizes import MATRIX_VALUES, broadcast_if_small
from shardfit.operators.design import BlockLayout, RowsFeed, feed_rows
from shardfit.operators.gram import BATCH, in_groups, task_limit
from shardfit.operators.rows import is_sparse, to_long


def predict_long(long: DataFrame, coef: DataFrame, n_features: int,
                 rows: DataFrame | None = None) -> DataFrame:
    """x . beta per row from the long form: join on the feature, sum per row.

    A row without entries has no record in the long form; given ``rows`` it is
    predicted as 0.
    """
    beta = broadcast_if_small(coef.select("col", "beta"), n_features)
    sums = long.join(beta, "col").groupBy("row_id").agg(
        F.first("y").alias("y"), F.sum(F.col("x") * F.col("beta")).alias("pred")
    )
    if rows is None:
        return sums
    extra = [c for c in ("fold",) if c in rows.columns]
    return rows.select("row_id", "y", *extra).join(sums.drop("y"), "row_id", "left").withColumn(
        "pred", F.coalesce("pred", F.lit(0.0))
    )


def predict(rows: DataFrame, coef: DataFrame, n_features: int) -> DataFrame:
    """x . beta per row: ``row_id, y, pred`` (and ``fold``), without a shuffle.

    ``coef`` is one model. Coefficients that do not fit on every executor are
    joined to the long form instead.
    """
    extra = [c for c in ("fold",) if c in rows.columns]
    if n_features > MATRIX_VALUES:
        return predict_long(to_long(rows, keep_zeros=False), coef, n_features, rows)
    beta = np.zeros(n_features)
    found = to_driver(coef.select("col", "beta"))
    beta[found["col"].to_numpy()] = found["beta"].to_numpy()
    shared = Shared(rows.sparkSession, beta)
    data = "entries" if is_sparse(rows) else "features"

    def run(batches):
        for batch in batches:
            pred = multiply(batch, shared.value[:, None])[:, 0]
            kept = [batch.column(c) for c in ("row_id", "y", *extra)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(pred)],
                                             ["row_id", "y", *extra, "pred"])

    schema = "row_id bigint, y double, " + "".join(f"{c} int, " for c in extra) + "pred double"
    return rows.select("row_id", "y", *extra, data).mapInArrow(run, schema)


def _summary(pred: DataFrame, by, **columns: Column) -> DataFrame:
    return pred.groupBy(*by).agg(*[c.alias(name) for name, c in columns.items()])


def mse(pred: DataFrame, by=()) -> DataFrame:
    return _summary(pred, by, mse=F.avg(squared_loss(F.col("y"), F.col("pred"))))


def standardized_mse(pred: DataFrame, by=()) -> DataFrame:
    """Squared error over squared deviation of the response, and the plain mean."""
    sq = squared_loss(F.col("y"), F.col("pred"))
    return _summary(
        pred, by,
        standardized_mse=F.sum(sq) / (F.var_pop("y") * F.count("*")), mse=F.avg(sq),
    )


def classification_error(pred: DataFrame, logistic: bool = False, by=()) -> DataFrame:
    rule = logistic_error if logistic else margin_error
    return _summary(pred, by, error=F.avg(rule(F.col("y"), F.col("pred"))))


def prediction_error(pred: DataFrame, loss: str, by=()) -> DataFrame:
    """Mean squared error or misclassification rate, as fits the loss."""
    if check_loss(loss) == "squared":
        return mse(pred, by).withColumnRenamed("mse", "error")
    return classification_error(pred, loss == "logistic", by)


def average_loss(pred: DataFrame, loss: str, by=()) -> DataFrame:
    return _summary(pred, by, average_loss=F.avg(loss_column(loss, F.col("y"), F.col("pred"))))


def _squared_norm(coef: DataFrame) -> float:
    return coef.agg(F.coalesce(F.sum(F.col("beta") * F.col("beta")), F.lit(0.0))).first()[0]


def primal_objective(pred: DataFrame, coef: DataFrame, lam: float, loss: str) -> DataFrame:
    """Average loss + (lambda/2) |w|^2; pass all weights that made the prediction."""
    penalty = 0.5 * lam * _squared_norm(coef)
    return average_loss(pred, loss).select((F.col("average_loss") + penalty).alias("primal"))


def dual_from_primal(pred: DataFrame, loss: str) -> DataFrame:
    """Dual value of every row at the optimum, from its prediction."""
    y, z = F.col("y"), F.col("pred")
    if loss == "squared":
        alpha = 2 * (y - z)
    elif loss == "logistic":
        alpha = y / (1 + F.exp(y * z))
    else:
        raise ValueError("hinge dual values are not unique at margin 1; pass them in")
    return pred.select("row_id", alpha.alias("alpha"))


def dual_to_primal(rows: DataFrame, alpha: DataFrame, n: int, lam: float) -> DataFrame:
    """X' alpha / (n lambda) per column; alpha carries the sign of the response.

    Rows meet their dual values whole, before they are spread over columns; the
    sums per column are formed before the shuffle. `dual_sums` does without the join where the
    values follow from predictions or stand in the rows.
    """
    joined = rows.join(alpha.select("row_id", "alpha"), "row_id")
    long = joined if "col" in joined.columns else to_long(joined, keep_zeros=False)
    return long.groupBy("col").agg(
        (F.sum(F.col("x") * F.col("alpha")) / (n * lam)).alias("beta")
    )


def _box(y: Column, alpha: Column, loss: str) -> Column:
    """The variable of the conjugate: the hinge one lives in [0, 1] without the sign."""
    return y * alpha if loss == "hinge" else alpha


def dual_objective(alpha: DataFrame, dual_coef: DataFrame, lam: float, loss: str) -> DataFrame:
    """-(lambda/2) |v|^2 - average conjugate, with v = X' alpha / (n lambda).

    ``alpha`` holds ``row_id, y, alpha``, signed as ``dual_to_primal`` needs it.
    """
    check_loss(loss)
    y, a = F.col("y"), F.col("alpha")
    penalty = 0.5 * lam * _squared_norm(dual_coef)
    return alpha.agg(
        (-penalty - F.avg(conjugate_column(loss, y, _box(y, a, loss)))).alias("dual")
    )


def duality_gap(rows: DataFrame, pred: DataFrame, coef: DataFrame, alpha: DataFrame,
                lam: float, loss: str) -> DataFrame:
    """Primal minus dual objective of given weights and feasible dual values.

    Both averages come from one pass over the joined predictions and dual values.
    """
    check_loss(loss)
    both = pred.select("row_id", "y", "pred").join(alpha.select("row_id", "alpha"), "row_id")
    y, a = F.col("y"), F.col("alpha")
    sums = both.agg(
        F.count("*").alias("n"),
        F.avg(loss_column(loss, y, F.col("pred"))).alias("loss"),
        F.avg(conjugate_column(loss, y, _box(y, a, loss))).alias("conjugate"),
    ).first()
    norm = 0.5 * lam * _squared_norm(coef)
    v = dual_to_primal(rows, alpha, sums["n"], lam)
    return v.agg(
        F.lit(sums["loss"] + norm).alias("primal"),
        (-0.5 * lam * F.sum(F.col("beta") * F.col("beta")) - sums["conjugate"]).alias("dual"),
    ).withColumn("gap", F.col("primal") - F.col("dual"))


def certificate(rows: DataFrame, coef: DataFrame, n_features: int, lam: float, loss: str,
                alpha: Column | None = None) -> DataFrame:
    """Primal and dual objective and their gap in one pass over the rows, without a join: ``primal, dual, gap``.

    The dual values follow from the predictions, at margin 1 the hinge's lower one, or are a column
    of the rows, signed like the response. Tasks emit one vector of column sums each.
    """
    sums = dual_sums(rows, coef, n_features, loss, alpha)
    scalars = {r["i"]: r["v"] for r in sums.where("i < 0").collect()}  # three records
    n = scalars.get(-1, 0.0)
    norm = 0.5 * lam * _squared_norm(coef)
    v = sums.where("i >= 0").select((F.col("v") / (n * lam)).alias("v"))
    return v.agg(
        F.lit(scalars[-2] / n + norm).alias("primal"),
        (-0.5 * lam * F.sum(F.col("v") * F.col("v")) - scalars[-3] / n).alias("dual"),
    ).withColumn("gap", F.col("primal") - F.col("dual"))


def dual_sums(rows: DataFrame, coef: DataFrame, n_features: int, loss: str, alpha: Column | None = None) -> DataFrame:
    """X' alpha by column (``i, v``), with the row count, loss and conjugate sums at i = -1, -2, -3."""
    check_loss(loss)
    found = to_driver(coef.select("col", "beta"))
    beta = np.zeros(n_features)
    beta[found["col"].to_numpy()] = found["beta"].to_numpy()
    shared = Shared(rows.sparkSession, beta)
    data = "entries" if is_sparse(rows) else "features"
    given = alpha is not None
    source = rows.select("y", data, *([alpha.cast("double").alias("alpha")] if given else []))

    def run(batches):
        total = np.zeros(3 + n_features)
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False)
            pred = multiply(batch, shared.value[:, None])[:, 0]
            a = batch.column("alpha").to_numpy(zero_copy_only=False) if given else _dual_values(loss, y, pred)
            total[:3] += len(y), _losses(loss, y, pred).sum(), _conjugates(loss, y, a).sum()
            if data == "entries":
                row, col, x = entries_of(batch, n_features)
                total[3:] += np.bincount(col, weights=x * a[row], minlength=n_features)
            else:
                total[3:] += a @ matrix_of(batch.column("features"), n_features, "features")
        i = np.concatenate([[-1, -2, -3], np.arange(n_features)])
        for low in range(0, len(i), BATCH):
            s = slice(low, low + BATCH)
            yield pa.RecordBatch.from_arrays([pa.array(i[s].astype(np.int32)), pa.array(total[s])], ["i", "v"])

    source = source.coalesce(task_limit(rows.sparkSession, n_features))
    return source.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))


def _dual_values(loss: str, y: np.ndarray, pred: np.ndarray) -> np.ndarray:
    if loss == "squared":
        return 2 * (y - pred)
    if loss == "hinge":
        return np.where(y * pred < 1, y, 0.0)
    return y * np.exp(-np.logaddexp(0.0, y * pred))


def _conjugates(loss: str, y: np.ndarray, a: np.ndarray) -> np.ndarray:
    if loss == "squared":
        return 0.25 * a * a - y * a
    if loss == "hinge":
        return -y * a
    t = np.clip(y * a, 0.0, 1.0)
    return np.where(t > 0, t * np.log(np.maximum(t, 1e-300)), 0.0) + np.where(
        t < 1, (1 - t) * np.log(np.maximum(1 - t, 1e-300)), 0.0)


def _row_error(y: np.ndarray, pred: np.ndarray, loss: str) -> np.ndarray:
    if loss == "squared":
        return (y - pred) ** 2
    if loss == "hinge":
        return np.where(y * pred > 0, 0.0, 1.0)
    return 0.5 * np.abs(np.where(pred > 0, 1.0, -1.0) - y)


def _with_status(errors: DataFrame, found, keys: list) -> DataFrame:
    """Add the largest gap of a model's fits, and whether all of them converged.

    `found`: what the fits returned, as a table or already on the driver. One record per model.
    """
    if isinstance(found, DataFrame):
        status = found.groupBy(*keys).agg(F.max("gap").alias("gap"), F.min("converged").alias("converged"))
    else:
        status = found.groupby(keys, as_index=False).agg(gap=("gap", "max"), converged=("converged", "min"))
        types = {"fold": "int", "block": "int", "lambda": "double", "gap": "double", "converged": "boolean"}
        schema = ", ".join(f"{c} {types[c]}" for c in status.columns)
        status = from_driver(errors.sparkSession, status.astype({"converged": bool}), schema)
    return errors.join(F.broadcast(status), keys)


def fold_errors(rows: DataFrame, coef: DataFrame, n_features: int, loss: str,
                n_models: int) -> DataFrame:
    """Error of every (fold, lambda) model on the rows of its fold: ``fold, lambda, error``.

    With the gap and ``converged`` of its fits, if the coefficients carry them.

    One pass scores all models of a fold with one matrix product per batch and
    emits a sum per model. Model sets too large for the executors are joined to
    the long form instead.
    """
    check_loss(loss)
    certified = "gap" in coef.columns
    if n_models * n_features > MATRIX_VALUES:
        errors = _fold_errors_joined(rows, coef, loss)
        return _with_status(errors, coef, ["fold", "lambda"]) if certified else errors
    found = to_driver(coef.select("fold", "lambda", "col", "beta", *(["gap", "converged"] if certified else [])))
    shared = {}
    for fold, part in found.groupby("fold"):
        lams = np.sort(part["lambda"].unique())
        b = np.zeros((n_features, len(lams)))
        b[part["col"].to_numpy(), np.searchsorted(lams, part["lambda"].to_numpy())] = part["beta"]
        shared[int(fold)] = (lams, b)
    table = Shared(rows.sparkSession, shared)
    data = "entries" if is_sparse(rows) else "features"

    def run(batches):
        sums = {}
        for batch in batches:
            y, fold = batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            for f in np.unique(fold):
                at = fold == f
                pred = multiply(batch.filter(pa.array(at)), table.value[int(f)][1])
                errors = _row_error(y[at][:, None], pred, loss).sum(axis=0)
                n, s = sums.get(int(f), (0, 0.0))
                sums[int(f)] = (n + int(at.sum()), s + errors)
        for f, (n, s) in sums.items():
            lams = table.value[f][0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(lams), f, np.int32)), pa.array(lams),
                 pa.array(np.full(len(lams), float(n))), pa.array(s)],
                ["fold", "lambda", "n", "s"],
            )

    errors = (
        rows.select("y", "fold", data)
        .mapInArrow(run, "fold int, lambda double, n double, s double")
        .groupBy("fold", "lambda")
        .agg((F.sum("s") / F.sum("n")).alias("error"))
    )
    return _with_status(errors, found, ["fold", "lambda"]) if certified else errors


def block_fold_errors(rows: DataFrame, layout: BlockLayout, weights: DataFrame,
                      loss: str) -> DataFrame:
    """Error of every block's own model on its held-out fold: ``block, fold, lambda, error, gap, converged``.

    All columns of Z_k predict; squared error is standardised by the squared
    deviation of the held-out response. Blocks whose weights do not fit on an
    executor together are scored in further passes.
    """
    found = to_driver(weights.select("fold", "block", "lambda", "i", "beta", "gap", "converged"))
    models, sizes = {}, {}
    for (fold, block), part in found.groupby(["fold", "block"]):
        lams = np.sort(part["lambda"].unique())
        b = np.zeros((layout.width(int(block)), len(lams)))
        b[part["i"].to_numpy(), np.searchsorted(lams, part["lambda"].to_numpy())] = part["beta"]
        models[int(fold), int(block)] = (lams, b)
        sizes[int(block)] = sizes.get(int(block), 0) + b.size
    spark = rows.sparkSession
    source = feed_rows(rows, layout).drop("row_id")
    shape = Shared(spark, layout)
    parts = None
    for group in in_groups(sizes, MATRIX_VALUES):
        table = Shared(spark, {key: m for key, m in models.items() if key[1] in group})
        part = source.mapInArrow(
            _block_sums(RowsFeed(shape, group), table, loss),
            "block int, fold int, lambda double, n double, sy double, syy double, s double",
        )
        parts = part if parts is None else parts.unionByName(part)
    sums = parts.groupBy("block", "fold", "lambda").agg(
        *[F.sum(c).alias(c) for c in ("n", "sy", "syy", "s")]
    )
    scale = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n") if loss == "squared" else F.col("n")
    errors = sums.select("block", "fold", "lambda", (F.col("s") / scale).alias("error"))
    return _with_status(errors, found, ["block", "fold", "lambda"])


def _block_sums(feed, table, loss):
    def run(batches):
        sums = {}
        for batch in batches:
            for block, z, y, fold in feed(batch):
                for f in np.unique(fold):
                    at = fold == f
                    key = (int(f), block)
                    errors = _row_error(y[at][:, None], z[at] @ table.value[key][1], loss)
                    part = np.concatenate([
                        [at.sum(), y[at].sum(), (y[at] ** 2).sum()], errors.sum(axis=0)
                    ])
                    sums[key] = sums[key] + part if key in sums else part
        for (f, block), part in sums.items():
            lams = table.value[f, block][0]
            k = len(lams)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, block, np.int32)), pa.array(np.full(k, f, np.int32)),
                 pa.array(lams), *[pa.array(np.full(k, v)) for v in part[:3]], pa.array(part[3:])],
                ["block", "fold", "lambda", "n", "sy", "syy", "s"],
            )
    return run


def block_objectives(rows: DataFrame, layout: BlockLayout, weights: DataFrame, loss: str) -> DataFrame:
    """Average loss of every block's fit on its training rows plus (lambda/2) |w|^2.

    ``block, fold, lambda, objective, gap, converged``: the optimum lies at most ``gap`` below.
    """
    check_loss(loss)
    found = to_driver(weights.select("fold", "block", "lambda", "i", "beta", "gap", "converged"))
    models, sizes = {}, {}
    for (fold, block, lam), part in found.groupby(["fold", "block", "lambda"]):
        w = np.zeros(layout.width(int(block)))
        w[part["i"].to_numpy()] = part["beta"].to_numpy()
        models.setdefault(int(block), []).append((int(fold), float(lam), w))
        sizes[int(block)] = sizes.get(int(block), 0) + w.size
    spark = rows.sparkSession
    source = feed_rows(rows, layout).drop("row_id")
    shape = Shared(spark, layout)
    parts = None
    for group in in_groups(sizes, MATRIX_VALUES):
        table = Shared(spark, {k: models[k] for k in group})
        part = source.mapInArrow(_loss_sums(RowsFeed(shape, group), table, loss),
                                 "block int, fold int, lambda double, n double, s double")
        parts = part if parts is None else parts.unionByName(part)
    sums = parts.groupBy("block", "fold", "lambda").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    norms = found.assign(square=found["beta"] ** 2).groupby(["block", "fold", "lambda"], as_index=False)["square"].sum()
    norms = from_driver(spark, norms, "block int, fold int, lambda double, square double")
    value = F.col("s") / F.col("n") + 0.5 * F.col("lambda") * F.col("square")
    objectives = sums.join(F.broadcast(norms), ["block", "fold", "lambda"]).select(  # one record per fit
        "block", "fold", "lambda", value.alias("objective"))
    return _with_status(objectives, found, ["block", "fold", "lambda"])


def _losses(loss: str, y: np.ndarray, pred: np.ndarray) -> np.ndarray:
    if loss == "squared":
        return (y - pred) ** 2
    return np.maximum(1 - y * pred, 0.0) if loss == "hinge" else np.logaddexp(0.0, -y * pred)


def _loss_sums(feed, table, loss):
    def run(batches):
        sums = {}
        for batch in batches:
            for block, z, y, fold in feed(batch):
                for f, lam, w in table.value[block]:
                    train = fold != f if f else slice(None)
                    part = np.array([len(y[train]), _losses(loss, y[train], z[train] @ w).sum()])
                    sums[block, f, lam] = sums.get((block, f, lam), 0.0) + part
        for (block, f, lam), (n, s) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([f], pa.int32()), pa.array([lam]), pa.array([n]), pa.array([s])],
                ["block", "fold", "lambda", "n", "s"])
    return run


def _fold_errors_joined(rows: DataFrame, coef: DataFrame, loss: str) -> DataFrame:
    long = to_long(rows, keep_zeros=False)
    beta = coef.select("fold", "lambda", "col", "beta")
    sums = long.join(beta, ["fold", "col"]).groupBy("row_id", "fold", "lambda").agg(
        F.sum(F.col("x") * F.col("beta")).alias("pred")
    )
    grid = coef.select("fold", "lambda").distinct()
    pred = (
        rows.select("row_id", "y", "fold").join(F.broadcast(grid), "fold")  # folds x penalties
        .join(sums, ["row_id", "fold", "lambda"], "left")
        .withColumn("pred", F.coalesce("pred", F.lit(0.0)))
    )
    return prediction_error(pred, loss, ["fold", "lambda"])
