"""Gram matrices of the block designs, in one pass over the rows.

The augmented design [1 | y | Z] has index -2 for the ones and -1 for the
response, so one matrix holds the row count, sums of y, Z'y and Z'Z.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardfit.functions.shared import Shared
from shardfit.operators.design import (
    BlockLayout, DesignFeed, RowsFeed, design_widths, feed_rows,
)

ONES, RESPONSE = -2, -1
TASK_VALUES = 32_000_000        # doubles that one task may accumulate, 256 MB
PARTIAL_RECORDS = 2_000_000_000  # partial sums that are shuffled at most
MIN_TASKS = 4_096
BATCH = 100_000
SCHEMA = "fold int, block int, i int, j int, v double"


def task_limit(spark, values_per_task: int) -> int:
    """How many tasks may emit partial sums: many for small sums, fewer for large ones."""
    cores = spark.sparkContext.defaultParallelism
    return max(MIN_TASKS, 2 * cores, PARTIAL_RECORDS // max(values_per_task, 1))


def in_groups(sizes: dict, limit: int) -> list[list]:
    """Cut keys into groups whose sizes sum to at most the limit (or hold one key)."""
    groups, used = [], limit + 1
    for key, size in sizes.items():
        if used + size > limit:
            groups.append([])
            used = 0
        groups[-1].append(key)
        used += size
    return groups


def upper_triangle(matrix: np.ndarray, first: int):
    i, j = np.triu_indices(matrix.shape[0])
    return i + first, j + first, matrix[i, j]


def _partials(feed):
    def run(batches):
        sums = {}
        for batch in batches:
            for block, z, y, fold in feed(batch):
                a = np.empty((len(y), z.shape[1] + 2))
                a[:, 0], a[:, 1], a[:, 2:] = 1.0, y, z
                for f in np.unique(fold):
                    part = a[fold == f]
                    key = (int(f), block)
                    if key in sums:
                        sums[key] += part.T @ part
                    else:
                        sums[key] = part.T @ part
        for (f, block), matrix in sums.items():
            i, j, v = upper_triangle(matrix, ONES)
            for low in range(0, len(v), BATCH):
                s = slice(low, low + BATCH)
                n = len(v[s])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, f, np.int32)), pa.array(np.full(n, block, np.int32)),
                     pa.array(i[s].astype(np.int32)), pa.array(j[s].astype(np.int32)),
                     pa.array(v[s])],
                    ["fold", "block", "i", "j", "v"],
                )
    return run


def _aggregate(source: DataFrame, feed, widths: dict[int, int], n_folds: int) -> DataFrame:
    sizes = {b: n_folds * (m + 2) ** 2 for b, m in widths.items()}
    spark = source.sparkSession
    parts = None
    for group in in_groups(sizes, TASK_VALUES):
        tasks = task_limit(spark, sum(sizes[b] for b in group) // 2)
        part = source.coalesce(tasks).mapInArrow(_partials(feed.only(group)), SCHEMA)
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("fold", "block", "i", "j").agg(F.sum("v").alias("v"))


def gram(design: DataFrame, n_folds: int = 1, widths: dict | None = None) -> DataFrame:
    """Gram entries of a published design: ``fold, block, i, j, v`` with i <= j."""
    widths = widths or design_widths(design)
    keep = ["block", "y", "z"] + (["fold"] if "fold" in design.columns else [])
    return _aggregate(design.select(*keep), DesignFeed(widths), widths, n_folds)


def gram_rows(rows: DataFrame, layout: BlockLayout, n_folds: int = 1) -> DataFrame:
    """The same straight from rows; the design is never written out."""
    widths = {k: layout.width(k) for k in range(layout.n_blocks)}
    feed = RowsFeed(Shared(rows.sparkSession, layout))
    source = feed_rows(rows, layout).drop("row_id")
    return _aggregate(source, feed, widths, n_folds)


def total_gram(by_fold: DataFrame) -> DataFrame:
    """Sum over folds, as fold 0."""
    total = by_fold.groupBy("block", "i", "j").agg(F.sum("v").alias("v"))
    return total.select(F.lit(0).alias("fold"), "block", "i", "j", "v")


def train_and_test_gram(by_fold: DataFrame) -> DataFrame:
    """Per fold the Gram of all other folds (``v``) next to its own (``own``)."""
    total = F.sum("v").over(Window.partitionBy("block", "i", "j"))
    return by_fold.select(
        "fold", "block", "i", "j", (total - F.col("v")).alias("v"), F.col("v").alias("own")
    )
