"""Labelled rows from the test tables."""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardfit.functions.arrow import cuts
from shardfit.operators.rows import ENTRIES
from shardfit.sources.tables import from_tables, one_hot

FLAGS = ("A", "N", "R")
STATUSES = ("F", "O")
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
WORD_COLUMNS = 1024
TEXT_BYTES = 4 << 20       # text whose words are counted at once
REMEMBERED_WORDS = 250_000
WHITE = re.compile(r"\s+", re.ASCII)


def table(spark: SparkSession, sf_dir: str, name: str, partitions: int | None = None) -> DataFrame:
    """A table; spread it when it is one small file that a single task would read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.repartition(partitions, df.columns[0]) if partitions else df


def r6(c: Column, digits: int = 6) -> Column:
    """Round for comparison; negative zero becomes zero."""
    r = F.round(c, digits)
    return F.when(r == 0, 0.0).otherwise(r)


def sign_label() -> Column:
    return F.when(F.col("label") >= 5, 1.0).otherwise(-1.0)


def embedding_rows(spark, sf_dir) -> DataFrame:
    return from_tables(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")


def embedding_classes(spark, sf_dir) -> DataFrame:
    return from_tables(table(spark, sf_dir, "embeddings"), "vec_id", sign_label(), "embedding")


def lineitem_id() -> Column:
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date"))
    digest = F.md5(F.concat_ws("|", *[
        c.cast("string") for c in (F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), day)
    ]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def lineitem_rows(spark, sf_dir, partitions=None) -> DataFrame:
    """Price by quantity, discount, tax and one-hot flags: 8 features."""
    features = ["l_quantity", "l_discount", "l_tax",
                *one_hot("l_returnflag", FLAGS), *one_hot("l_linestatus", STATUSES)]
    lines = table(spark, sf_dir, "lineitem", partitions)
    return from_tables(lines, lineitem_id(), "l_extendedprice", features)


def lineitem_part_rows(spark, sf_dir) -> DataFrame:
    """Quantity, discount, tax, part size and retail price: 5 features."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    joined = table(spark, sf_dir, "lineitem").join(
        part, F.col("l_partkey") == F.col("p_partkey")
    )
    return from_tables(joined, lineitem_id(), "l_extendedprice",
                       ["l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice"])


def event_rows(spark, sf_dir) -> DataFrame:
    """Value by hour, weekday, one-hot event type and the number in props: 8 features."""
    features = [
        F.hour("ts"), F.weekday("ts"), *one_hot("event_type", EVENT_TYPES),
        F.get_json_object("props", "$.k").cast("double"),
    ]
    return from_tables(table(spark, sf_dir, "events"), "event_id", "value", features)


class _Columns(dict):
    """Column of a word by its hash; a bounded number of words is remembered."""

    def __init__(self, n_columns: int):
        self.n_columns = n_columns

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        col = self[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.n_columns
        return col


def _word_counts(texts: list, columns: _Columns) -> pa.ListArray:
    """Entries of a few texts, counted as numbers and not as Python objects."""
    found = []
    for row, text in enumerate(texts):
        cols = [columns[word] for word in WHITE.split(text or "") if word]
        found.append(np.array(cols, np.int64) + row * columns.n_columns)
    at, n = np.unique(np.concatenate(found), return_counts=True)
    row, col = np.divmod(at, columns.n_columns)
    ends = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(col.astype(np.int32)), pa.array(n.astype(float))], ["col", "x"])
    return pa.ListArray.from_arrays(pa.array(ends), pairs)


def count_words(n_columns: int):
    """Texts to entries, a few megabytes of text at a time however many rows a batch has."""

    def run(batches):
        columns = _Columns(n_columns)
        for batch in batches:
            for low, high in cuts(batch.column("text"), TEXT_BYTES):
                part = batch.slice(low, high - low)
                entries = _word_counts(part.column("text").to_pylist(), columns)
                yield pa.RecordBatch.from_arrays([part.column("row_id"), part.column("y"), entries],
                                                 ["row_id", "y", "entries"])

    return run


def document_rows(spark, sf_dir, partitions=None, labelled: bool = True,
                  n_columns: int = WORD_COLUMNS) -> DataFrame:
    """Sparse rows: hashed counts of all words of a document; y is its quality as +1 or -1.

    Without ``labelled`` all documents are rows, and y is 0 where there is no label.
    """
    labels = table(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, 1.0).otherwise(-1.0).alias("y")
    )
    docs = table(spark, sf_dir, "documents", partitions).select("doc_id", "text")
    docs = docs.join(labels, "doc_id", "inner" if labelled else "left")
    rows = docs.select(F.col("doc_id").alias("row_id"), F.coalesce("y", F.lit(0.0)).alias("y"), "text")

    return rows.mapInArrow(count_words(n_columns), f"row_id bigint, y double, entries {ENTRIES}")


def fixed_beta(spark, n_features: int) -> DataFrame:
    """A coefficient per column from a formula, to test what uses coefficients."""
    beta = (F.col("id") % 7 - 3) / F.lit(10.0)
    return spark.range(n_features).select(F.col("id").cast("int").alias("col"), beta.alias("beta"))
