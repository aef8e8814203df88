"""Train and test errors of a fitted model, and the run report."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardfit.functions.losses import check_loss
from shardfit.operators.metrics import classification_error, predict, standardized_mse
from shardfit.sinks.tables import write_run_report


def evaluate(rows: DataFrame, coef: DataFrame, n_features: int, loss: str,
             name: str = "test") -> DataFrame:
    """One record: the error that fits the loss, and the plain mean squared error for ridge."""
    pred = predict(rows, coef, n_features)
    if check_loss(loss) == "squared":
        out = standardized_mse(pred).select(
            F.col("standardized_mse").alias("error"), F.col("mse").alias("mse")
        )
    else:
        out = classification_error(pred, loss == "logistic").select(
            "error", F.lit(None).cast("double").alias("mse")
        )
    return out.select(F.lit(name).alias("data"), "error", "mse")


def report(train: DataFrame, test: DataFrame, coef: DataFrame, n_features: int, loss: str,
           config: dict, path: str, mode: str = "errorifexists") -> DataFrame:
    """Evaluate on both sets and save coefficients, errors and options."""
    metrics = evaluate(train, coef, n_features, loss, "train").unionByName(
        evaluate(test, coef, n_features, loss, "test")
    )
    write_run_report(coef, metrics, {"loss": loss, **config}, path, mode)
    return metrics
