"""Rows of vectors inside tasks."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str | Column, width: int | None = None) -> Column:
    """True for vectors, of the given width if there is one, that are not zero and hold finite numbers alone."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    fits = F.lit(True) if width is None else F.size(v) == width
    return F.coalesce(fits & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def common_width(df, vector: str) -> int:
    """The commonest length of the vectors, the smaller one among equals; 0 without vectors."""
    sizes = df.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("width")).count()
    top = sizes.orderBy(F.desc("count"), "width").first()
    return top["width"] if top else 0


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Equally long lists as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; the largest entry is taken out first, so no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def by_width(column: pa.ListArray):
    """Rows of lists of one length: (length, places, matrix) for every length that is there."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    for width in np.unique(lengths):
        at = np.flatnonzero(lengths == width)
        yield int(width), at, matrix(column.take(pa.array(at)), int(width))
