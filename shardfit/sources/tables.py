"""Rows from typed tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_hot(name: str, values) -> list[Column]:
    """One 0/1 column per listed value."""
    return [F.when(F.col(name) == v, 1.0).otherwise(0.0) for v in values]


def from_tables(df: DataFrame, row_id, y, features) -> DataFrame:
    """Dense rows from a key, a response and a list of numeric columns or one array column."""

    def column(c):
        return F.col(c) if isinstance(c, str) else c

    if isinstance(features, (list, tuple)):
        array = F.array(*[column(c).cast("double") for c in features])
    else:
        array = column(features).cast("array<double>")
    return df.select(
        column(row_id).cast("bigint").alias("row_id"),
        column(y).cast("double").alias("y"),
        array.alias("features"),
    )
