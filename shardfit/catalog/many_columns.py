"""Queries whose fits have many columns: validation without a matrix, fits by products, certified optima."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardfit.catalog.fixtures import document_rows, embedding_classes, embedding_rows, r6
from shardfit.operators import metrics as M
from shardfit.operators.newton import fit_margin_rows
from shardfit.operators.ridge import own_coefficients
from shardfit.plans.crossval import global_cv, local_cv
from shardfit.plans.model import fit_path, fit_weights, model_layout

WIDE, WIDEST = 1 << 15, 1 << 16


def unit_documents(spark, d, n_columns: int) -> DataFrame:
    """Labelled documents as hashed word counts, scaled to length one."""
    rows = document_rows(spark, d, n_columns=n_columns)
    length = F.sqrt(F.aggregate("entries", F.lit(0.0), lambda a, e: a + e["x"] * e["x"]))
    lengths = F.array_repeat(length, F.size("entries"))  # inside a lambda it would be summed anew for every entry
    unit = F.zip_with("entries", lengths, lambda e, n: F.struct(e["col"].alias("col"), (e["x"] / n).alias("x")))
    return rows.withColumn("entries", unit)


def _wide_fit(spark, d, loss: str, **options):
    rows = unit_documents(spark, d, WIDE)
    layout, blocks = model_layout(rows, 2, 8, "sparse", "add", "range", n_features=WIDE)
    return rows, layout, blocks, fit_weights(rows, layout, loss, 0.1, **options)


def _sums(weights, blocks) -> DataFrame:
    """Checksums of a block's coefficients, which are too many to be told one by one."""
    beta = own_coefficients(weights, blocks)
    return beta.groupBy("block", "lambda").agg(
        r6(F.sum(F.col("beta") * (F.col("col") % 7 + 1)), 5).alias("s"),
        r6(F.sum(F.col("beta") * F.col("beta")), 5).alias("squares"), F.min("converged").alias("converged"))


def fit_ridge_wide(spark, d):
    """32 768 hashed words in two blocks, each wider than a square system is made for."""
    _, _, blocks, weights = _wide_fit(spark, d, "squared")
    return _sums(weights, blocks)


def fit_logistic_wide(spark, d):
    _, _, blocks, weights = _wide_fit(spark, d, "logistic", stopping_gap=1e-15)
    return _sums(weights, blocks)


def fit_svm_wide(spark, d):
    rows, layout, _, weights = _wide_fit(spark, d, "hinge", stopping_gap=1e-6)
    found = M.block_objectives(rows, layout, weights, "hinge")
    return found.select("block", "lambda", r6(F.col("objective"), 4).alias("objective"), "converged")


def ridge_cv_documents(spark, d):
    """Validation of models with 65 536 hashed words in four blocks."""
    cv = global_cv(unit_documents(spark, d, WIDEST), [0.1, 1.0], 3, n_blocks=4, q=8, projection="sparse",
                   partitioner="range", n_features=WIDEST)
    return cv.select("fold", "lambda", r6(F.col("error"), 5).alias("error"), "converged")


def ridge_cv_private(spark, d):
    """Noise by the column ranges of the training rows of each fold."""
    cv = global_cv(embedding_rows(spark, d), [0.5, 1.0], 5, n_blocks=4, q=8, partitioner="range",
                   private=True, noise_seed=7)
    return cv.select("fold", "lambda", r6(F.col("error")).alias("error"))


def fit_path_concatenate(spark, d):
    """Several penalties with the other blocks' features side by side."""
    rows = embedding_rows(spark, d)
    layout, blocks = model_layout(rows, 4, 4, "sparse", "concatenate", "range")
    path = fit_path(rows, layout, blocks, "squared", [0.1, 1.0, 4.4])
    return path.select("col", "block", "lambda", r6(F.col("beta")).alias("beta"))


def fit_svm(spark, d):
    """Shared features; the objective at a certified gap."""
    rows = embedding_classes(spark, d)
    layout, _ = model_layout(rows, 4, 8, "SDCT", "add", "range")
    weights = fit_margin_rows(rows, layout, "hinge", [0.1], stopping_gap=1e-8)
    found = M.block_objectives(rows, layout, weights, "hinge")
    return found.select("block", "lambda", r6(F.col("objective")).alias("objective"), "converged")


def fit_logistic(spark, d):
    rows = embedding_classes(spark, d)
    layout, blocks = model_layout(rows, 4, 8, "SDCT", "add", "range")
    weights = fit_margin_rows(rows, layout, "logistic", [0.1], stopping_gap=1e-12)
    return own_coefficients(weights, blocks).select("col", "block", "lambda", r6(F.col("beta")).alias("beta"), "converged")


def svm_cv(spark, d):
    """Shared features."""
    cv = global_cv(embedding_classes(spark, d), [0.1, 1.0], 5, loss="hinge", n_blocks=4, q=8,
                   partitioner="range", fit={"stopping_gap": 1e-9})
    return cv.select("fold", "lambda", r6(F.col("error")).alias("error"), "converged")


def local_cv_svm(spark, d):
    rows = embedding_classes(spark, d)
    layout, _ = model_layout(rows, 4, 8, "SDCT", "add", "range")
    cv = local_cv(rows, layout, [0.1, 1.0], 5, loss="hinge", stopping_gap=1e-9)
    return cv.select("block", "fold", "lambda", r6(F.col("error")).alias("error"), "converged")


MANY_COLUMNS = {f.__name__: f for f in (
    fit_ridge_wide, fit_logistic_wide, fit_svm_wide, ridge_cv_documents, ridge_cv_private, fit_path_concatenate,
    fit_svm, fit_logistic, svm_cv, local_cv_svm)}
