"""Ridge fits from Gram matrices: one small solve per block, fold and penalty."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardfit.operators.gram import ONES, RESPONSE

WEIGHTS = "fold int, block int, lambda double, i int, beta double, gap double, converged boolean"
GAP = 1e-9  # largest gap, relative to the mean square of y, that counts as converged unless told otherwise


def _square(pdf: pd.DataFrame, name: str) -> np.ndarray:
    i, j = pdf["i"].to_numpy() - ONES, pdf["j"].to_numpy() - ONES
    size = int(j.max()) + 1
    a = np.zeros((size, size))
    a[i, j] = pdf[name].to_numpy()
    a[j, i] = pdf[name].to_numpy()
    return a


def _solve(a: np.ndarray, lam: float) -> np.ndarray:
    z = slice(-ONES, None)
    n = a[0, 0]
    return np.linalg.solve(a[z, z] + 0.5 * n * lam * np.eye(len(a) + ONES), a[z, 1])


def _gap(a: np.ndarray, w: np.ndarray, lam: float) -> float:
    """Duality gap at w, from the Gram matrix; the dual values are twice the residuals."""
    z = slice(-ONES, None)
    n, yy, zy = a[0, 0], a[1, 1], a[z, 1]
    fitted = a[z, z] @ w
    squares = yy - 2 * w @ zy + w @ fitted
    dual = 2 * (zy - fitted) / (n * lam)
    return (2 * squares - 2 * (yy - w @ zy)) / n + 0.5 * lam * (w @ w + dual @ dual)


def gap_limit(mean_square: float, stopping_gap: float | None) -> float:
    """Gap of a squared-loss fit that counts as converged, however the fit is made."""
    return GAP * max(mean_square, 1e-300) if stopping_gap is None else stopping_gap


def _good(a: np.ndarray, gap: float, stopping_gap: float | None) -> bool:
    return bool(gap <= gap_limit(a[1, 1] / a[0, 0], stopping_gap))


def fit_ridge(gram: DataFrame, lambdas, stopping_gap: float | None = None) -> DataFrame:
    """Minimiser of (1/n) sum (y - z w)^2 + (lambda/2) |w|^2 per fold, block and lambda.

    Weights of all columns of Z, by position i, with the duality gap. A group is one Gram matrix.
    The systems are solved at once; ``converged`` says whether the gap is within the limit.
    """
    lambdas = check_lambdas(lambdas)

    def solve(pdf):
        a = _square(pdf, "v")
        frames = []
        for lam in lambdas:
            w = _solve(a, lam)
            gap = _gap(a, w, lam)
            frames.append(pd.DataFrame({"lambda": lam, "i": np.arange(len(w)), "beta": w,
                                        "gap": gap, "converged": _good(a, gap, stopping_gap)}))
        out = pd.concat(frames)
        out["fold"], out["block"] = pdf["fold"].iat[0], pdf["block"].iat[0]
        return out[["fold", "block", "lambda", "i", "beta", "gap", "converged"]]

    return gram.groupBy("fold", "block").applyInPandas(solve, WEIGHTS)


def ridge_fold_errors(train_and_test: DataFrame, lambdas, stopping_gap: float | None = None) -> DataFrame:
    """Standardised squared error of every block on its held-out fold, from Grams alone."""
    lambdas = check_lambdas(lambdas)

    def score(pdf):
        train, own = _square(pdf, "v"), _square(pdf, "own")
        z = slice(-ONES, None)
        n, sum_y, sum_yy = own[0, 0], own[0, 1], own[1, 1]
        errors, gaps = [], []
        for lam in lambdas:
            w = _solve(train, lam)
            gaps.append(_gap(train, w, lam))
            sse = sum_yy - 2 * w @ own[z, 1] + w @ own[z, z] @ w
            errors.append(sse / (sum_yy - sum_y * sum_y / n))
        return pd.DataFrame({
            "block": pdf["block"].iat[0], "fold": pdf["fold"].iat[0],
            "lambda": lambdas, "error": errors, "gap": gaps, "converged": [_good(train, g, stopping_gap) for g in gaps],
        })

    return train_and_test.groupBy("fold", "block").applyInPandas(
        score, "block int, fold int, lambda double, error double, gap double, converged boolean"
    )


def check_lambdas(lambdas) -> list[float]:
    values = [float(v) for v in (lambdas if np.iterable(lambdas) else [lambdas])]
    if not values or min(values) <= 0:
        raise ValueError("penalties must be positive")
    return values


def raw_positions(blocks: DataFrame) -> DataFrame:
    """Column behind position i of every block: ``block, i, col``."""
    return blocks.selectExpr(
        "block", "int(row_number() over (partition by block order by col) - 1) as i", "col"
    )


def own_coefficients(weights: DataFrame, blocks: DataFrame) -> DataFrame:
    """Keep the weights of the raw columns of every block, by column."""
    keep = [c for c in weights.columns if c not in ("block", "i", "beta")]
    return weights.join(raw_positions(blocks), ["block", "i"]).select(
        "col", "block", *keep, "beta"
    )


def assemble_coefficients(coef: DataFrame, n_features: int) -> DataFrame:
    """One record per feature; a feature without a coefficient gets 0."""
    features = coef.sparkSession.range(n_features).select(F.col("id").cast("int").alias("col"))
    return features.join(coef.select("col", "beta"), "col", "left").select(
        "col", F.coalesce("beta", F.lit(0.0)).alias("beta")
    )
