"""Saving rows, columns, responses and results."""

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardfit.operators.layout import response
from shardfit.operators.rows import is_sparse, to_flat_array

ROW_CLASSES = ("DataPoint", "LabeledPoint", "DoubleArray")


def save_rows(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def save_cols(cols: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Column-wise layout; records of one column lie together inside each file."""
    cols.sortWithinPartitions("col", "chunk").write.mode(mode).parquet(path)


def cast_rows(rows: DataFrame, kind: str) -> DataFrame:
    """Labelled rows, or flat arrays with the response first."""
    if kind not in ROW_CLASSES:
        raise ValueError(f"row class must be one of {ROW_CLASSES}, got {kind!r}")
    if kind != "DoubleArray":
        return rows
    if is_sparse(rows):
        raise ValueError("make sparse rows dense before saving them as flat arrays")
    return to_flat_array(rows)


def cast_and_save(train: DataFrame, test: DataFrame, kind: str, train_path: str,
                  test_path: str, mode: str = "errorifexists") -> None:
    """Train and test in one row class, whose name is appended to the paths."""
    for rows, path in ((train, train_path), (test, test_path)):
        save_rows(cast_rows(rows, kind), f"{path}-{kind}", mode)


def save_response(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Response values as text, one per line, by row id across the files in name order."""
    ordered = response(rows).orderBy("pos")
    ordered.select(F.col("y").cast("string").alias("value")).write.mode(mode).text(path)


def save_n_feats(spark, n_features: int, path: str, mode: str = "errorifexists") -> None:
    spark.range(1).select(F.lit(str(n_features)).alias("value")).write.mode(mode).text(path)


def save_cv(summary: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Mean and spread of the error per penalty (and block)."""
    summary.write.mode(mode).parquet(path)


def write_run_report(coef: DataFrame, metrics: DataFrame, config: dict, path: str,
                     mode: str = "errorifexists") -> None:
    """Coefficients, metrics and the options of a run, below one path."""
    coef.write.mode(mode).parquet(f"{path}/coef")
    metrics.write.mode(mode).parquet(f"{path}/metrics")
    text = json.dumps(config, sort_keys=True, default=str)
    line = coef.sparkSession.range(1).select(F.lit(text).alias("value"))
    line.write.mode(mode).text(f"{path}/config")
