"""Centring, scaling and column ranges."""

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardfit.functions.arrow import matrix_of
from shardfit.functions.shared import Shared
from shardfit.functions.sizes import broadcast_if_small
from shardfit.operators.rows import is_sparse, to_long


EXPRESSION_WIDTH = 64  # features up to which scaling is a column expression, else numpy in tasks


def column_stats(long: DataFrame) -> DataFrame:
    """Count, mean, sample deviation and range of every feature."""
    return long.groupBy("col").agg(
        F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"),
        F.min("x").alias("lo"), F.max("x").alias("hi"),
    )


def _statistics(rows: DataFrame, features, response):
    """Means and deviations of features and response in one pass; vectors of feature length."""
    parts = [F.avg("y").alias("y_mean"), F.coalesce(F.stddev_samp("y"), F.lit(0.0)).alias("y_sd")]
    if any(features):
        summary = Summarizer.metrics("mean", "std").summary(array_to_vector("features"))
        parts.append(summary.alias("s"))
    found = rows.agg(*parts).first()
    y_mean = found["y_mean"] if response[0] else None
    y_sd = found["y_sd"] if response[1] else None
    mean = found["s"]["mean"].toArray() if features[0] else None
    sd = found["s"]["std"].toArray() if features[1] else None
    return y_mean, y_sd, mean, sd


def _standardize(x: Column, mean, sd) -> Column:
    """A constant column, whose deviation is zero, becomes zero."""
    if mean is not None:
        x = x - mean
    if sd is not None:
        x = F.when(sd > 0, x / sd).otherwise(0.0)
    return x


def _as_expression(mean, sd) -> Column:
    """Standardised features without leaving the JVM; rows of another width or with nulls are refused."""
    width = len(sd if mean is None else mean)
    known = (F.size("features") == width) & F.forall("features", lambda x: x.isNotNull())

    def one(x, i):
        parts = [None if v is None else F.get(F.array(*[F.lit(float(e)) for e in v]), i) for v in (mean, sd)]
        return _standardize(x, *parts)

    refused = F.raise_error(F.lit(f"every row must have {width} values in features, without nulls"))
    return F.when(known, F.transform("features", one)).otherwise(refused)


def _apply(rows: DataFrame, statistics) -> DataFrame:
    """Rows with standardised response and features; two vectors of feature length are sent."""
    y_mean, y_sd, mean, sd = statistics
    y = _standardize(F.col("y"), *[None if v is None else F.lit(v) for v in (y_mean, y_sd)])
    out = rows.withColumn("y", y)
    if mean is None and sd is None:
        return out
    if len(sd if mean is None else mean) <= EXPRESSION_WIDTH:
        return out.withColumn("features", _as_expression(mean, sd))
    shared = Shared(rows.sparkSession, (mean, sd))
    at = out.columns.index("features")

    def run(batches):
        mean, sd = shared.value
        width = len(sd if mean is None else mean)
        for batch in batches:
            x = matrix_of(batch.column("features"), width, "features")
            if mean is not None:
                x = x - mean
            if sd is not None:
                x = np.divide(x, sd, out=np.zeros_like(x), where=sd > 0)
            ends = pa.array(np.arange(0, x.size + 1, max(width, 1), dtype=np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(x.ravel()))
            columns = [lists if i == at else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return out.mapInArrow(run, out.schema)


def center_scale(train: DataFrame, test: DataFrame | None = None,
                 features: tuple[bool, bool] = (True, True),
                 response: tuple[bool, bool] = (False, False),
                 fit_on: str = "train"):
    """Centre and scale by (centre, scale) switches; the deviation is the sample one.

    Returns the train rows, or (train, test) if test rows are given. ``fit_on``
    is ``train`` for the statistics of the train rows, or ``each`` for the own
    statistics of either set.
    """
    if fit_on not in ("train", "each"):
        raise ValueError(f"fit_on must be 'train' or 'each', got {fit_on!r}")
    sets = [train] if test is None else [train, test]
    if any(features) and any(is_sparse(s) for s in sets):
        raise ValueError("sparse rows cannot be centred or scaled by feature")
    if not any(features) and not any(response):
        out = sets
    elif fit_on == "train":
        statistics = _statistics(train, features, response)
        out = [_apply(s, statistics) for s in sets]
    else:
        out = [_apply(s, _statistics(s, features, response)) for s in sets]
    return out[0] if test is None else tuple(out)


def scale_long(long: DataFrame, n_features: int, center: bool = True,
               scale: bool = True) -> DataFrame:
    """The same for the long form: statistics by feature, joined back on the feature."""
    stats = column_stats(long).select("col", "mean", "sd")
    x = F.col("x")
    if center:
        x = x - F.col("mean")
    if scale:
        x = F.when(F.col("sd") > 0, x / F.col("sd")).otherwise(0.0)
    keep = [c for c in long.columns if c != "x"]
    joined = long.join(broadcast_if_small(stats, n_features), "col")
    return joined.select(*keep, x.alias("x"))


def column_range(long: DataFrame, blocks: DataFrame, n_rows: int | None = None) -> DataFrame:
    """Widest (max - min) of the columns of every block.

    The long form of sparse rows has no zeros: give the number of rows, and a
    column with fewer entries counts as holding a zero too.
    """
    stats = column_stats(long)
    lo, hi = F.col("lo"), F.col("hi")
    if n_rows is not None:
        lo = F.when(F.col("n") < n_rows, F.least(lo, F.lit(0.0))).otherwise(lo)
        hi = F.when(F.col("n") < n_rows, F.greatest(hi, F.lit(0.0))).otherwise(hi)
    return (
        blocks.join(stats, "col", "left")
        .groupBy("block")
        .agg(F.coalesce(F.max(hi - lo), F.lit(0.0)).alias("range"))
    )


def left_out_ranges(rows: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """`column_range` of the rows outside every fold 1..k, in one pass: ``fold, block, range``.

    Extremes by fold and column are combined for each fold that is left out. Where a column has
    fewer entries than there are rows, as in sparse rows, it holds a zero too.
    """
    by_fold = to_long(rows.select("row_id", "y", "fold", "entries" if is_sparse(rows) else "features")).groupBy(
        "fold", "col").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    sizes = {r["fold"]: r["n"] for r in rows.groupBy("fold").agg(F.count("*").alias("n")).collect()}  # one record per fold
    left = F.explode(F.array(*[F.lit(f) for f in range(1, k + 1)])).alias("left")
    outside = by_fold.select("*", left).where("left <> fold").groupBy("left", "col").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    total = F.create_map(*[F.lit(v) for f in range(1, k + 1) for v in (f, sum(n for g, n in sizes.items() if g != f))])
    short = F.col("n") < total[F.col("left")]
    lo = F.when(short, F.least("lo", F.lit(0.0))).otherwise(F.col("lo"))
    hi = F.when(short, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi"))
    found = outside.select("col", F.col("left").alias("fold"), (hi - lo).alias("width"))
    return found.join(blocks, "col").groupBy("fold", "block").agg(F.max("width").alias("range"))
