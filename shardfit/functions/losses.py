"""Losses, conjugates and decision rules as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

LOSSES = ("squared", "hinge", "logistic")


def check_loss(loss: str) -> str:
    if loss not in LOSSES:
        raise ValueError(f"loss must be one of {LOSSES}, got {loss!r}")
    return loss


def squared_loss(y: Column, pred: Column) -> Column:
    return (y - pred) * (y - pred)


def hinge_loss(y: Column, pred: Column) -> Column:
    return F.greatest(1 - y * pred, F.lit(0.0))


def logistic_loss(y: Column, pred: Column) -> Column:
    """log(1 + exp(-y pred)), written so that exp never overflows."""
    m = y * pred
    return F.greatest(-m, F.lit(0.0)) + F.log1p(F.exp(-F.abs(m)))


def loss_column(loss: str, y: Column, pred: Column) -> Column:
    return {"squared": squared_loss, "hinge": hinge_loss, "logistic": logistic_loss}[
        check_loss(loss)
    ](y, pred)


def hinge_conjugate(y: Column, alpha: Column) -> Column:
    """Per-row conjugate of the hinge loss; alpha is the box variable in [0, 1]."""
    return -alpha


def squared_conjugate(y: Column, alpha: Column) -> Column:
    return 0.25 * alpha * alpha - y * alpha


def logistic_conjugate(y: Column, alpha: Column) -> Column:
    """t log t + (1-t) log(1-t) with t = y alpha, zero at both ends."""
    t = y * alpha

    def xlogx(v: Column) -> Column:
        return F.when(v > 0, v * F.log(F.when(v > 0, v).otherwise(1.0))).otherwise(0.0)

    return xlogx(t) + xlogx(1 - t)


def conjugate_column(loss: str, y: Column, alpha: Column) -> Column:
    return {
        "squared": squared_conjugate,
        "hinge": hinge_conjugate,
        "logistic": logistic_conjugate,
    }[check_loss(loss)](y, alpha)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def margin_error(y: Column, pred: Column) -> Column:
    """1 unless y and the prediction have the same strict sign."""
    return F.when(y * pred > 0, 0.0).otherwise(1.0)


def logistic_label(pred: Column) -> Column:
    """+1 where the predicted probability exceeds one half, else -1."""
    return F.when(sigmoid(pred) > 0.5, 1.0).otherwise(-1.0)


def logistic_error(y: Column, pred: Column) -> Column:
    return 0.5 * F.abs(logistic_label(pred) - y)
