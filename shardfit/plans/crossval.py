"""Penalty selection by global and per-block cross-validation."""

from dataclasses import replace

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardfit.functions import sizes
from shardfit.functions.losses import check_loss
from shardfit.functions.shared import from_driver, to_driver
from shardfit.operators.design import BlockLayout, add_noise
from shardfit.operators.gram import gram_rows, total_gram, train_and_test_gram
from shardfit.operators.layout import assign_folds
from shardfit.operators.metrics import block_fold_errors, fold_errors
from shardfit.operators.ridge import (
    WEIGHTS, check_lambdas, fit_ridge, own_coefficients, ridge_fold_errors,
)
from shardfit.operators.scaling import left_out_ranges
from shardfit.plans.model import fit_weights, model_layout, widest


def lambda_grid(spark: SparkSession, start: float = 1.0, stop: float = 10.0,
                step: float = 1.0) -> DataFrame:
    """Penalties from start to stop, both included, as start + i * step."""
    if step <= 0 or stop < start:
        raise ValueError("the grid needs step > 0 and stop >= start")
    count = int(np.floor((stop - start) / step + 1e-9)) + 1
    return spark.range(count).select((F.lit(start) + F.col("id") * step).alias("lambda"))


def grid_values(grid) -> list[float]:
    if isinstance(grid, DataFrame):
        grid = [r[0] for r in grid.select("lambda").collect()]
    return check_lambdas(grid)


def _with_folds(rows: DataFrame, k: int, seed: int, fold_mode: str) -> DataFrame:
    if "fold" in rows.columns:
        return rows.withColumn("fold", F.col("fold").cast("int"))
    return assign_folds(rows, k, seed, fold_mode)


def cv_weights(folded: DataFrame, layout: BlockLayout, k: int, loss: str, lambdas,
               **options) -> DataFrame:
    """Weights of every Z_k with each fold left out, for all penalties."""
    if loss == "squared" and widest(layout) <= sizes.DENSE_WIDTH:
        # the Gram of the training rows is the total minus that of the fold
        return fit_ridge(train_and_test_gram(gram_rows(folded, layout, k)), lambdas, options.get("stopping_gap"))
    return fit_weights(folded, layout, loss, lambdas, tuple(range(1, k + 1)), **options)


def global_cv(rows: DataFrame, grid, k: int = 5, seed: int = 1, loss: str = "squared",
              fold_mode: str = "hash", fit: dict | None = None, **model) -> DataFrame:
    """Held-out error of the joint model: ``fold, lambda, error, gap, converged``.

    ``gap`` is the largest of the fits behind an error, ``converged`` whether all met theirs.

    ``model`` goes to ``model_layout``, ``fit`` to the solver. Rows that already
    carry a fold 1..k keep it. The noise of a private model follows the training rows of each fold.
    """
    check_loss(loss)
    lambdas = grid_values(grid)
    folded = _with_folds(rows, k, seed, fold_mode)
    if model.get("private"):
        weights, layout, blocks = _private_weights(folded, k, loss, lambdas, seed, fit or {}, model)
        return fold_errors(folded, own_coefficients(weights, blocks), layout.n_features, loss, k * len(lambdas))
    layout, blocks = model_layout(folded, seed=seed, **model)
    weights = cv_weights(folded, layout, k, loss, lambdas, **(fit or {}))
    coef = own_coefficients(weights, blocks)
    return fold_errors(folded, coef, layout.n_features, loss, k * len(lambdas))


def _private_weights(folded: DataFrame, k: int, loss: str, lambdas, seed: int, fit: dict, model: dict):
    """Weights with each fold left out, and with noise by the column ranges of the rows that are left.

    The extremes of all folds come from one pass; every fold's noise is its own, so its fits are too.
    """
    model = dict(model)
    eps, delta, noise_seed = model.pop("eps", 10.0), model.pop("delta", 0.05), model.pop("noise_seed", None)
    model.pop("private")
    layout, blocks = model_layout(folded, seed=seed, **model)
    ranges = to_driver(left_out_ranges(folded, blocks, k))
    weights = None
    for f in range(1, k + 1):
        own = from_driver(folded.sparkSession, ranges[ranges["fold"] == f], "fold int, block int, range double")
        noisy = add_noise(replace(layout), own, eps, delta, seed if noise_seed is None else noise_seed)
        train = folded.where(F.col("fold") != f).drop("fold")
        part = fit_weights(train, noisy, loss, lambdas, **fit).withColumn("fold", F.lit(f))
        weights = part if weights is None else weights.unionByName(part)
    return weights, layout, blocks


def cv_summary(cv: DataFrame) -> DataFrame:
    """Mean error per penalty, with standard deviation and variance over folds.

    Where the errors say so, also the largest gap, and whether all fits converged.
    """
    keys = [c for c in ("block", "lambda") if c in cv.columns]
    status = [F.max("gap").alias("gap"), F.min("converged").alias("converged")] if "gap" in cv.columns else []
    return cv.groupBy(*keys).agg(
        F.avg("error").alias("mean"), F.stddev_samp("error").alias("sd"),
        F.var_samp("error").alias("var"), *status,
    )


def select_lambda(cv: DataFrame) -> DataFrame:
    """Penalty of least mean error, overall or per block; ties go to the smaller one."""
    summary = cv if "mean" in cv.columns else cv_summary(cv)
    best = F.min_by(F.struct("lambda", "mean"), F.struct("mean", "lambda")).alias("best")
    keys = ["block"] if "block" in summary.columns else []
    return summary.groupBy(*keys).agg(best).select(*keys, "best.lambda", "best.mean")


def local_cv(rows: DataFrame, layout: BlockLayout, grid, k: int = 5, seed: int = 1,
             loss: str = "squared", fold_mode: str = "hash", **options) -> DataFrame:
    """Held-out error of every block on its own Z_k: ``block, fold, lambda, error, gap, converged``.

    All columns of Z_k predict. The ridge error is standardised by the squared
    deviation of the held-out response; logistic loss is refused.
    """
    if check_loss(loss) == "logistic":
        raise ValueError("per-block cross-validation is not defined for logistic loss")
    lambdas = grid_values(grid)
    folded = _with_folds(rows, k, seed, fold_mode)
    if loss == "squared" and widest(layout) <= sizes.DENSE_WIDTH:
        grams = train_and_test_gram(gram_rows(folded, layout, k))
        return ridge_fold_errors(grams, lambdas, options.get("stopping_gap"))
    weights = fit_weights(folded, layout, loss, lambdas, tuple(range(1, k + 1)), **options)
    return block_fold_errors(folded, layout, weights, loss)


def fit_local_lambda(rows: DataFrame, layout: BlockLayout, blocks: DataFrame, grid, k: int = 5,
                     seed: int = 1, loss: str = "squared", fold_mode: str = "hash",
                     **options) -> DataFrame:
    """Coefficients where every block uses the penalty that its own validation chose."""
    check_loss(loss)
    if loss == "squared" and widest(layout) <= sizes.DENSE_WIDTH:
        # one pass over the rows: the fold Grams give the errors and, summed, the final fits
        folded = _with_folds(rows, k, seed, fold_mode)
        grams = gram_rows(folded, layout, k).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            lambdas = grid_values(grid)
            wanted = select_lambda(ridge_fold_errors(train_and_test_gram(grams), lambdas))
            path = fit_ridge(total_gram(grams), lambdas, options.get("stopping_gap"))
            fitted = path.join(wanted.select("block", "lambda"), ["block", "lambda"])
            weights = from_driver(  # one record per column of Z
                rows.sparkSession,
                to_driver(fitted.select("fold", "block", "lambda", "i", "beta", "gap", "converged")), WEIGHTS,
            )
        finally:
            grams.unpersist()
    else:
        errors = local_cv(rows, layout, grid, k, seed, loss, fold_mode, **options)
        chosen = {r["block"]: [r["lambda"]] for r in select_lambda(errors).collect()}
        weights = fit_weights(rows.drop("fold"), layout, loss, chosen, **options)
    return own_coefficients(weights, blocks).drop("fold")
