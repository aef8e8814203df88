"""Forms of the data and changes between them.

dense rows   row_id, y, features array<double>
sparse rows  row_id, y, entries array<struct<col int, x double>>  (no zeros, ascending col)
long         row_id, y, col int, x double
flat         row_id, a array<double>, response first
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT

from shardfit.functions.arrow import SLICE_VALUES, entries_of, scatter

ENTRIES = "array<struct<col:int,x:double>>"


def is_sparse(rows: DataFrame) -> bool:
    return "entries" in rows.columns


def _label_column(df: DataFrame) -> str:
    for name in ("y", "label"):
        if name in df.columns:
            return name
    raise ValueError(f"no label column 'y' or 'label' in {df.columns}")


def _with_id(df: DataFrame, row_id: str | None) -> tuple[DataFrame, Column]:
    """Use the given key, or a column called row_id, or number the rows."""
    if row_id or "row_id" in df.columns:
        return df, F.col(row_id or "row_id")
    return df.withColumn("__id", F.monotonically_increasing_id()), F.col("__id")


def as_rows(df: DataFrame, row_id: str | None = None, n_features: int | None = None) -> DataFrame:
    """Dense rows from any stored form: flat array, labelled row, ML vector, or sparse entries.

    Entries take the width of ``n_features``, or of the largest column among them.
    """
    df, key = _with_id(df, row_id)
    if is_sparse(df):
        rows = sparse_rows(df, row_id)
        return to_dense(rows, feature_count(rows) if n_features is None else n_features)
    types = {f.name: f.dataType for f in df.schema}
    if isinstance(types.get("a"), T.ArrayType):
        a = F.col("a").cast("array<double>")
        return df.select(
            key.alias("row_id"),
            F.element_at(a, 1).alias("y"),
            F.slice(a, 2, F.size(a) - 1).alias("features"),
        )
    feats = types.get("features")
    if isinstance(feats, VectorUDT):
        features = vector_to_array("features")
    elif isinstance(feats, T.ArrayType):
        features = F.col("features").cast("array<double>")
    else:
        raise ValueError(
            "stored rows must hold a flat array 'a', or 'features' as array or vector; "
            f"got {df.schema.simpleString()}"
        )
    return df.select(
        key.alias("row_id"), F.col(_label_column(df)).cast("double").alias("y"),
        features.alias("features"),
    )


def sparse_rows(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """Sparse rows from entries, or from ML vectors without a dense detour; else from dense rows."""
    source = df
    df, key = _with_id(df, row_id)
    if is_sparse(df):
        entries = F.col("entries").cast(ENTRIES)
    elif isinstance({f.name: f.dataType for f in df.schema}.get("features"), VectorUDT):
        found = df.select(key.alias("row_id"), F.col(_label_column(df)).cast("double").alias("y"), "features")
        return found.mapInArrow(_vector_entries, f"row_id {found.schema['row_id'].dataType.simpleString()}, y double, entries {ENTRIES}")
    else:
        return to_sparse(as_rows(source, row_id))
    return df.select(key.alias("row_id"), F.col(_label_column(df)).cast("double").alias("y"),
                     entries.alias("entries"))


def to_flat_array(rows: DataFrame) -> DataFrame:
    """Label in front of the features."""
    return rows.select("row_id", F.concat(F.array("y"), "features").alias("a"))


def to_sparse(rows: DataFrame) -> DataFrame:
    """Dense rows to sparse rows; a row of zeros keeps its label and an empty array."""
    pairs = F.transform(
        "features", lambda x, i: F.struct(i.cast("int").alias("col"), x.alias("x"))
    )
    entries = F.filter(pairs, lambda e: e["x"] != 0)
    keep = [c for c in rows.columns if c != "features"]
    return rows.select(*keep, entries.alias("entries"))


def _vector_entries(batches):
    """Non-zeros of ML vectors, read from their own struct: sparse ones hold indices, dense ones values by place."""
    for batch in batches:
        v = batch.column("features")
        if v.null_count:
            raise ValueError("features must not be null")
        values, indices = v.field("values"), v.field("indices")
        lengths = values.value_lengths().to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        col = (np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)).astype(np.int32)
        sparse = np.repeat(v.field("type").to_numpy() == 0, lengths)
        col[sparse] = indices.flatten().to_numpy(zero_copy_only=False)
        x = values.flatten().to_numpy(zero_copy_only=False)
        at = x != 0
        row = np.repeat(np.arange(len(lengths)), lengths)[at]
        offsets = np.zeros(len(lengths) + 1, np.int32)
        np.cumsum(np.bincount(row, minlength=len(lengths)), out=offsets[1:])
        pairs = pa.StructArray.from_arrays([pa.array(col[at]), pa.array(x[at])], ["col", "x"])
        yield pa.RecordBatch.from_arrays(
            [batch.column("row_id"), batch.column("y"), pa.ListArray.from_arrays(pa.array(offsets), pairs)],
            ["row_id", "y", "entries"])


def to_dense(rows: DataFrame, n_features: int) -> DataFrame:
    """Sparse rows to dense rows of a given width; an entry beyond it is refused. Linear in width and entries."""
    keep = [c for c in rows.columns if c != "entries"]
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("features", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                n = part.num_rows
                row, col, x = entries_of(part, n_features)
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * n_features)
                flat = scatter(row * n_features + col, x, (n, n_features)).ravel()
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in keep], pa.ListArray.from_arrays(ends, pa.array(flat, pa.float64()))],
                    [*keep, "features"])

    step = max(1, SLICE_VALUES // max(n_features, 1))
    return rows.select(*keep, "entries").mapInArrow(run, schema)


def to_long(rows: DataFrame, keep_zeros: bool = True) -> DataFrame:
    """One record per row and feature. Narrow; sparse rows give their non-zeros only."""
    keep = [c for c in rows.columns if c not in ("features", "entries")]
    if is_sparse(rows):
        return rows.select(*keep, F.inline("entries"))
    long = rows.select(*keep, F.posexplode("features").alias("col", "x"))
    return long if keep_zeros else long.where("x <> 0")


def feature_count(rows: DataFrame) -> int:
    """Width of the data: that of the first row, or the largest index seen.

    Dense rows are not scanned for it; the fits refuse a row of another width.
    """
    if "features" in rows.columns:
        found = rows.select(F.size("features")).first()
    elif is_sparse(rows):
        found = rows.agg(F.max(F.array_max(F.transform("entries", lambda e: e["col"]))) + 1).first()
    else:
        found = rows.agg(F.max("col") + 1).first()
    return int(found[0] or 0) if found else 0
