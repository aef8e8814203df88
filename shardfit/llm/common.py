"""Helpers that several operators of this folder share."""

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardfit.functions.checkpoints import shared_folder

SLICE_BYTES = 4 << 20  # text handled at once inside a task; one longer text makes its own slice


def few_files(df: DataFrame) -> DataFrame:
    """At most two tasks per core, for narrow tables: many small files cost more than they hold."""
    return df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)


def keep(df: DataFrame, narrow: bool = False) -> DataFrame:
    """Cut the lineage: the rows are written to the shared folder once and read from there."""
    shared_folder(df.sparkSession)
    return (few_files(df) if narrow else df).checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The same as a Parquet table, whose plan knows nothing of what made it.

    For loops: a checkpoint hands constraints on to the next plan, where they multiply.
    """
    path = f"{shared_folder(df.sparkSession)}/shardfit-{uuid.uuid4().hex}"
    few_files(df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not use yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string")) % 4 == 2, F.lit(False))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Consecutive parts of a batch with at most `limit` bytes (or items) in a column."""
    size = batch.num_rows
    if not size:
        return
    col = batch.column(column)
    length = pa.compute.binary_length(col) if not pa.types.is_list(col.type) else col.value_lengths()
    ends = np.cumsum(length.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start, done = 0, 0
    while start < size:
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(start, stop - start)
        done, start = int(ends[stop - 1]), stop


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts as Python strings; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def list_array(flat: np.ndarray, lengths) -> pa.ListArray:
    """A flat array cut into lists of the given lengths."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def sample_rows(df: DataFrame, labels: str, per_label: int, key: str = "doc_id") -> DataFrame:
    """About `per_label` rows of every label, drawn by a hash of the key; the bound is a parameter.

    The share drawn from a label follows from the label's count, so the whole table is
    counted but only the drawn rows are moved. Rows with a null key or label are left out.
    """
    known = df.where(F.col(labels).isNotNull() & F.col(key).isNotNull())
    counts = known.groupBy(labels).count().collect()
    draw = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30)) / float(1 << 30)
    rule = F.lit(False)
    for row in counts:
        share = min(1.0, per_label / row["count"])
        rule = rule | ((F.col(labels) == F.lit(row[labels])) & (draw < F.lit(share)))
    return known.where(rule)


class Remembered(dict):
    """Word -> value, computed where missing, in two generations.

    Words not met since the last change of generation go. Only the time depends on what is
    remembered, never the result.
    """

    def __init__(self, compute, size: int):
        super().__init__()
        self.compute, self.size, self.old = compute, size, {}

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.compute(word)
        self[word] = value
        return value

    def turn(self) -> None:
        """Begin a new generation if this one is full; called between batches."""
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()

    def forget(self) -> None:
        self.clear()
        self.old = {}
