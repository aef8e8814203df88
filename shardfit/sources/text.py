"""Readers of labelled text, response files and block maps.

The parsers work on any DataFrame with a string column ``value``, so they also
serve text that is already in a table. A row id is taken from the table when it
has one; for files it is Spark's increasing id of the line.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardfit.operators.rows import to_dense


def _lines(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path).withColumn("row_id", F.monotonically_increasing_id())


def _data_lines(lines: DataFrame) -> DataFrame:
    text = F.trim("value")
    return lines.where((text != "") & ~text.startswith("#"))


def _numbers(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), " +"), lambda t: t != "").cast("array<double>")


def parse_libsvm(lines: DataFrame) -> DataFrame:
    """Sparse rows from ``label i:v i:v ...`` with 1-based indices in any order."""
    tokens = F.filter(F.split(F.trim("value"), r"\s+"), lambda t: t != "")

    def entry(parts):
        return F.struct(
            (parts[0].cast("int") - 1).alias("col"), parts[1].cast("double").alias("x")
        )

    tail = F.slice("__t", 2, F.greatest(F.size("__t") - 1, F.lit(0)))
    pairs = F.transform(F.transform(tail, lambda token: F.split(token, ":")), entry)  # a token is split once
    return (
        _data_lines(lines)
        .withColumn("__t", tokens)
        .select(
            "row_id",
            F.element_at("__t", 1).cast("double").alias("y"),
            F.sort_array(F.filter(pairs, lambda e: e["x"] != 0)).alias("entries"),
        )
    )


def parse_spaces(lines: DataFrame) -> DataFrame:
    """Dense rows from ``label f1 f2 ...``; repeated spaces count as one."""
    a = _numbers(F.col("value"))
    return (
        lines.where(F.trim("value") != "")
        .withColumn("__a", a)
        .select(
            "row_id",
            F.element_at("__a", 1).alias("y"),
            F.slice("__a", 2, F.size("__a") - 1).alias("features"),
        )
    )


def parse_comma(lines: DataFrame) -> DataFrame:
    """Dense rows from ``label,f1 f2 ...``."""
    parts = F.split("value", ",", 2)
    return lines.where(F.trim("value") != "").select(
        "row_id",
        F.trim(parts[0]).cast("double").alias("y"),
        _numbers(parts[1]).alias("features"),
    )


def read_libsvm(spark: SparkSession, path, sparse: bool = True,
                n_features: int | None = None) -> DataFrame:
    rows = parse_libsvm(_lines(spark, path))
    if sparse:
        return rows
    if n_features is None:
        n_features = libsvm_width(spark, path)
    return to_dense(rows, n_features)


def libsvm_width(spark: SparkSession, *paths) -> int:
    """Largest index in one or more files, counting indices whose value is zero."""
    tokens = F.split(F.trim("value"), r"\s+")
    index = F.transform(
        F.filter(tokens, lambda t: t.contains(":")),
        lambda t: F.split(t, ":")[0].cast("int"),
    )
    lines = _data_lines(spark.read.text(list(paths)))
    return int(lines.agg(F.max(F.array_max(index))).first()[0] or 0)


def read_spaces(spark: SparkSession, path) -> DataFrame:
    return parse_spaces(_lines(spark, path))


def read_comma(spark: SparkSession, path) -> DataFrame:
    return parse_comma(_lines(spark, path))


def _positions(spark: SparkSession, path) -> DataFrame:
    """Numbers of a text file with their 0-based position over all of its lines.

    Ids rise within one input split, so a position is the count of all earlier
    splits plus the offset in the own one. Only the table of splits is ordered.
    """
    tokens = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.explode(F.filter(F.split(F.trim("value"), r"\s+"), lambda t: t != "")).alias("token"),
    ).withColumn("id", F.monotonically_increasing_id())
    splits = tokens.groupBy("file", "start").agg(
        F.count("*").alias("n"), F.min("id").alias("first_id")
    )
    before = F.sum("n").over(Window.orderBy("file", "start")) - F.col("n")
    starts = splits.select("file", "start", "first_id", before.alias("offset"))
    return tokens.join(starts, ["file", "start"]).select(
        (F.col("offset") + F.col("id") - F.col("first_id")).alias("pos"), "token"
    )


def read_response(spark: SparkSession, path) -> DataFrame:
    """Response values by position from numbers separated by blanks or line ends."""
    return _positions(spark, path).select("pos", F.col("token").cast("double").alias("y"))


def read_block_map(spark: SparkSession, path) -> DataFrame:
    """Block id of every feature, by position."""
    return _positions(spark, path).select(
        F.col("pos").cast("int").alias("col"), F.col("token").cast("int").alias("block")
    )


def read_n_feats(spark: SparkSession, path) -> int:
    """Feature count from a file that holds one number."""
    return int(spark.read.text(path).select(F.trim("value").cast("int")).first()[0])
