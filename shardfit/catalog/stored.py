"""Queries whose rows go through the sinks into the shared folder and come back through the readers."""

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardfit.catalog.fixtures import (
    document_rows, embedding_rows, event_rows, lineitem_rows, r6,
)
from shardfit.functions.checkpoints import delete, keep, shared_folder
from shardfit.operators.layout import assign_blocks, split_train_test, transpose
from shardfit.operators.rows import to_long
from shardfit.plans.crossval import cv_summary, global_cv, lambda_grid
from shardfit.plans.evaluate import report
from shardfit.plans.model import fit_columns, fit_model
from shardfit.plans.preprocess import preprocess
from shardfit.sinks import tables as sinks
from shardfit.sources import stored, text


@contextmanager
def folder(spark):
    """A new folder that all machines see; deleted once the result has been written elsewhere."""
    path = f"{shared_folder(spark)}/shardfit-stored-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        delete(spark, path)


def _wide(rows: DataFrame, p: int) -> list:
    return [r6(F.get("features", F.lit(c))).alias(f"x{c}") for c in range(p)]


def _parts(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


def _named_events(spark, d) -> tuple[DataFrame, DataFrame]:
    """Train and test events with their id as a ninth feature, since text keeps no row ids."""
    rows = event_rows(spark, d)
    named = rows.withColumn("features", F.concat("features", F.array(F.col("row_id").cast("double"))))
    return split_train_test(named)


def _by_id(rows: DataFrame) -> DataFrame:
    return keep(rows.select(F.get("features", F.lit(8)).cast("long").alias("row_id"), r6(F.col("y")).alias("y"),
                            "part", *_wide(rows, 8)))


def dataset_of_spaces(spark, d):
    """Two files of ``label f1 f2 ...``."""
    with folder(spark) as path:
        for name, rows in zip(("train", "test"), _named_events(spark, d)):
            values = F.concat_ws(" ", F.col("y").cast("string"), F.array_join(F.col("features").cast("array<string>"), " "))
            rows.select(values.alias("value")).write.text(f"{path}/{name}")
        return _by_id(_parts(*stored.read_dataset(spark, "spaces", train=f"{path}/train", test=f"{path}/test")))


def dataset_of_commas(spark, d):
    """Two files of ``label,f1 f2 ...``."""
    with folder(spark) as path:
        for name, rows in zip(("train", "test"), _named_events(spark, d)):
            values = F.concat_ws(",", F.col("y").cast("string"), F.array_join(F.col("features").cast("array<string>"), " "))
            rows.select(values.alias("value")).write.text(f"{path}/{name}")
        return _by_id(_parts(*stored.read_dataset(spark, "comma", train=f"{path}/train", test=f"{path}/test")))


def dataset_of_libsvm(spark, d):
    """Two LIBSVM files of all documents, made dense at the width that they have together."""
    with folder(spark) as path:
        rows = document_rows(spark, d, labelled=False)
        name = F.concat(F.lit(" 1025:"), (F.col("row_id") + 1).cast("string"))  # the id as one more column
        words = F.array_join(F.transform("entries", lambda e: F.concat_ws(":", e["col"] + 1, e["x"])), " ")
        for part, rows in zip(("train", "test"), split_train_test(rows)):
            line = F.concat(F.col("y").cast("string"), F.lit(" "), words, name)
            rows.select(line.alias("value")).write.text(f"{path}/{part}")
        found = _parts(*stored.read_dataset(spark, "libsvm", train=f"{path}/train", test=f"{path}/test"))
        words = F.slice("features", 1, 1024)
        total = F.aggregate(F.transform(words, lambda x, i: (i + 1) * x), F.lit(0.0), lambda a, x: a + x)
        return keep(found.select(
            (F.get("features", F.lit(1024)) - 1).cast("long").alias("row_id"), "y", "part",
            F.size("features").alias("width"), r6(total).alias("s")))


def stored_rows(spark, d):
    """Saved labelled rows, split as they are read."""
    with folder(spark) as path:
        sinks.save_rows(lineitem_rows(spark, d), f"{path}/rows")
        found = _parts(*stored.read_stored_rows(spark, f"{path}/rows"))
        return keep(found.select("row_id", "y", "part", *_wide(found, 8)))


def stored_flat_arrays(spark, d):
    """Train and test saved as flat arrays under their class's name, and cast back."""
    with folder(spark) as path:
        train, test = split_train_test(lineitem_rows(spark, d))
        sinks.cast_and_save(train, test, "DoubleArray", f"{path}/train", f"{path}/test")
        found = _parts(*stored.read_and_cast(
            spark, train=f"{path}/train-DoubleArray", test=f"{path}/test-DoubleArray"))
        return keep(found.select("row_id", "y", "part", *_wide(found, 8)))


def stored_sparse_rows(spark, d):
    """Sparse rows saved and read as such: every entry of every document."""
    with folder(spark) as path:
        sinks.save_rows(document_rows(spark, d, labelled=False), f"{path}/rows")
        train, test = stored.read_and_cast(spark, f"{path}/rows", sparse=True)
        return keep(to_long(_parts(train, test)).select("row_id", "part", "col", "x"))


def response_file(spark, d):
    """Responses as text, by position."""
    with folder(spark) as path:
        sinks.save_response(lineitem_rows(spark, d), f"{path}/y")
        return keep(text.read_response(spark, f"{path}/y"))


def feature_count_file(spark, d):
    """The width of all documents as a file of one number."""
    with folder(spark) as path:
        rows = document_rows(spark, d, labelled=False)
        width = rows.agg(F.max(F.array_max(F.transform("entries", lambda e: e["col"]))) + 1).first()[0]
        sinks.save_n_feats(spark, width, f"{path}/n")
        return spark.createDataFrame([(text.read_n_feats(spark, f"{path}/n"),)], "n_features int")


def block_map_file(spark, d):
    """Blocks by the sign of a column's mean, as a text file, and the model's blocks from it."""
    with folder(spark) as path:
        means = to_long(embedding_rows(spark, d)).groupBy("col").agg(F.avg("x").alias("m"))
        lines = means.orderBy("col").select(F.when(F.col("m") < 0, "7").otherwise("9").alias("value"))
        lines.coalesce(1).write.text(f"{path}/blocks")  # one line per feature
        found = text.read_block_map(spark, f"{path}/blocks")
        return keep(assign_blocks(spark, 64, 2, "explicit", block_map=found).select("col", "block"))


def columns_file(spark, d):
    """The column-wise layout of line items."""
    with folder(spark) as path:
        sinks.save_cols(transpose(lineitem_rows(spark, d), 8), f"{path}/cols")
        found = spark.read.parquet(f"{path}/cols").select("col", "start", F.posexplode("obs").alias("i", "x"))
        return keep(found.groupBy("col").agg(
            F.count("*").alias("n"), r6(F.sum(F.col("x") * ((F.col("start") + F.col("i")) % 97))).alias("s")))


def _preprocessed(spark, d, path: str) -> None:
    train, test = split_train_test(event_rows(spark, d))
    sinks.save_rows(train, f"{path}/raw-train")
    sinks.save_rows(test, f"{path}/raw-test")
    preprocess(spark, f"{path}/train", f"{path}/test", "object", train=f"{path}/raw-train", test=f"{path}/raw-test",
               row_class="DataPoint", third_class="DoubleArray")


def preprocessed_rows(spark, d):
    """Test events scaled by the train events, from both row classes that were saved."""
    with folder(spark) as path:
        _preprocessed(spark, d, path)
        whole = spark.read.parquet(f"{path}/test-rowwise-DataPoint").select("row_id", "y", "features")
        flat = spark.read.parquet(f"{path}/test-DoubleArray").select("row_id", F.size("a").alias("n"))
        both = whole.join(flat, "row_id")
        return keep(both.select("row_id", r6(F.col("y")).alias("y"), "n", *_wide(both, 8)))


def preprocessed_columns(spark, d):
    """Products of the scaled train columns with the response, from column-wise files, and the width."""
    with folder(spark) as path:
        _preprocessed(spark, d, path)
        cols = spark.read.parquet(f"{path}/train-colwise")
        y = text.read_response(spark, f"{path}/train-response")
        cells = cols.select("col", "start", F.posexplode("obs").alias("i", "x"))
        # both sides are as long as the table, yet the exploded files look small enough to be broadcast
        joined = cells.withColumn("pos", F.col("start") + F.col("i")).hint("merge").join(y, "pos")
        width = text.read_n_feats(spark, f"{path}/train-nFeats")
        return keep(joined.groupBy("col").agg(
            F.count("*").alias("n"), r6(F.avg(F.col("x") * F.col("y"))).alias("m"), F.lit(width).alias("width")))


def fit_columns_ridge(spark, d):
    """The model from stored columns and responses alone."""
    with folder(spark) as path:
        rows = embedding_rows(spark, d)
        sinks.save_cols(transpose(rows, 64), f"{path}/cols")
        sinks.save_response(rows, f"{path}/y")
        coef = fit_columns(spark.read.parquet(f"{path}/cols"), text.read_response(spark, f"{path}/y"), 64,
                           4, 8, lam=0.1, partitioner="range")
        return keep(coef.select("col", "block", "lambda", r6(F.col("beta")).alias("beta")))


def fit_columns_documents(spark, d):
    """Sparse columns: the words of the labelled documents, by word."""
    with folder(spark) as path:
        rows = document_rows(spark, d)
        sinks.save_cols(transpose(rows), f"{path}/cols")
        sinks.save_response(rows, f"{path}/y")
        coef = fit_columns(spark.read.parquet(f"{path}/cols"), text.read_response(spark, f"{path}/y"), 1024,
                           64, 2, lam=0.5, projection="sparse", partitioner="range")
        return keep(coef.select("col", "block", "lambda", r6(F.col("beta")).alias("beta")))


def run_report(spark, d):
    """Errors and options of a run, as its report tells them."""
    with folder(spark) as path:
        train, test = split_train_test(embedding_rows(spark, d))
        coef = fit_model(train, 64, 0, lam=0.1, partitioner="range")
        report(train, test, coef, 64, "squared", {"blocks": 64}, path)
        config = F.lit(spark.read.text(f"{path}/config").first()["value"])
        n = spark.read.parquet(f"{path}/coef").count()
        metrics = spark.read.parquet(f"{path}/metrics")
        return keep(metrics.select(
            "data", r6(F.col("error")).alias("error"), r6(F.col("mse")).alias("mse"), F.lit(n).alias("n_coef"),
            F.get_json_object(config, "$.blocks").cast("int").alias("blocks")))


def cv_file(spark, d):
    """Mean and spread of the validation error by penalty."""
    with folder(spark) as path:
        cv = global_cv(embedding_rows(spark, d), lambda_grid(spark, 0.5, 2.0, 0.5), 5, n_blocks=4, q=8,
                       partitioner="range")
        sinks.save_cv(cv_summary(cv), f"{path}/cv")
        found = spark.read.parquet(f"{path}/cv")
        return keep(found.select("lambda", *[r6(F.col(c)).alias(c) for c in ("mean", "sd", "var")], "converged"))


STORED = {f.__name__: f for f in (
    dataset_of_spaces, dataset_of_commas, dataset_of_libsvm, stored_rows, stored_flat_arrays, stored_sparse_rows,
    response_file, feature_count_file, block_map_file, columns_file, preprocessed_rows, preprocessed_columns,
    fit_columns_ridge, fit_columns_documents, run_report, cv_file)}
