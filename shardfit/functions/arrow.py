"""Arrow batches of rows as numpy matrices, inside tasks."""

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

SLICE_VALUES = 4_000_000  # doubles of one dense slice, 32 MB


def matrix_of(lists: pa.ListArray, width: int, what: str) -> np.ndarray:
    """Equally long lists as a matrix, one row per list."""
    lengths = lists.value_lengths()
    if lists.null_count or not bool(np.all(lengths.to_numpy(zero_copy_only=False) == width)):
        raise ValueError(f"every row must have {width} values in {what}")
    values = lists.flatten()
    if values.null_count:
        raise ValueError(f"{what} must not contain nulls")
    return values.to_numpy(zero_copy_only=False).reshape(len(lists), width)


def cuts(lists: pa.Array, most: int, most_rows: int | None = None):
    """(low, high) of consecutive slices with at most `most` list items or text bytes, or of one row."""
    sizes = lists.value_lengths() if pa.types.is_nested(lists.type) else pa.compute.binary_length(lists)
    ends = np.concatenate([[0], np.cumsum(pa.compute.fill_null(sizes, 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    low = 0
    while low < len(lists):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + most, "right")) - 1)
        high = min(high, low + (most_rows or len(lists)))
        yield low, high
        low = high


def entries_of(batch: pa.RecordBatch, n_features: int):
    """Row, column and value of all entries of sparse rows."""
    entries = batch.column("entries")
    if entries.null_count:
        raise ValueError("entries must not be null")
    flat = entries.flatten()
    col = flat.field("col").to_numpy(zero_copy_only=False)
    val = flat.field("x").to_numpy(zero_copy_only=False)
    if len(col) and not 0 <= col.min() <= col.max() < n_features:
        raise ValueError(f"a column index lies outside 0..{n_features - 1}")
    lengths = entries.value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(batch.num_rows), lengths), col, val


def scatter(at: np.ndarray, val: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Dense matrix with the sum of the values at every flat position."""
    if not len(at):
        return np.zeros(shape)  # also of no columns
    return np.bincount(at, weights=val, minlength=shape[0] * shape[1]).reshape(shape)


def multiply(batch: pa.RecordBatch, matrix: np.ndarray) -> np.ndarray:
    """Rows of the batch times a matrix; sparse rows touch their own entries only."""
    p, width = matrix.shape
    if "features" in batch.schema.names:
        return matrix_of(batch.column("features"), p, "features") @ matrix
    row, col, val = entries_of(batch, p)
    n = batch.num_rows
    out = np.empty((n, width))
    for c in range(width):
        out[:, c] = np.bincount(row, weights=val * matrix[col, c], minlength=n)
    return out
