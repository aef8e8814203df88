"""Design matrices from column-wise storage, as `transpose` writes it.

Columns are cut into tiles of consecutive positions. A group is one tile of one block, whose
columns give its share of the projections; the shares of a tile meet, small as they are, with
the tile's responses; then the same groups, next to what the other blocks projected, are Z_k.
No group holds more than a tile of the widest block, however long or wide the table.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardfit.functions.shared import Shared, from_driver
from shardfit.functions.sizes import broadcast_if_small
from shardfit.operators import layout as L
from shardfit.operators.design import BlockLayout


def tile_rows(layout: BlockLayout) -> int:
    """Positions of a tile, so that a group of its widest block or of all projections is bounded."""
    widest = max(*(layout.raw_width(k) for k in range(layout.n_blocks)), layout.n_blocks * layout.q, 1)
    return max(1, min(L.ROW_CHUNK, L.CHUNK_VALUES // widest))


def _cells(columns: DataFrame, layout: BlockLayout, step: int) -> DataFrame:
    """Pieces of columns by tile and block: ``tile, block, place, at, x``; `at` is the first row, x a list."""
    found = pd.concat([pd.DataFrame({"col": c, "block": k, "place": np.arange(len(c))}) for k, c in enumerate(layout.cols)])
    places = from_driver(columns.sparkSession, found, "col int, block int, place int")
    owned = columns.join(broadcast_if_small(places, layout.n_features), "col")
    if "pos" in columns.columns:
        cells = owned.select("block", "place", F.inline(F.arrays_zip("pos", "obs")))
        return cells.select(F.floor(F.col("pos") / step).alias("tile"), "block", "place",
                            (F.col("pos") % step).cast("int").alias("at"), F.array("obs").alias("x"))
    last = F.col("start") + F.size("obs") - 1
    tiles = F.explode(F.sequence(F.floor(F.col("start") / step), F.floor(last / step))).alias("tile")
    low = F.greatest(F.col("tile") * step - F.col("start"), F.lit(0))
    high = F.least((F.col("tile") + 1) * step - F.col("start"), F.size("obs"))
    return owned.where(F.size("obs") > 0).select("block", "place", "start", "obs", tiles).select(
        "tile", "block", "place", (F.col("start") + low - F.col("tile") * step).cast("int").alias("at"),
        F.slice("obs", (low + 1).cast("int"), (high - low).cast("int")).alias("x"))


def _matrix(cells: pa.Table, rows: int, width: int) -> np.ndarray:
    """A tile of one block; what no piece covers is zero."""
    out = np.zeros((rows, width))
    if cells.num_rows:
        x = cells["x"].combine_chunks()
        length = x.value_lengths().to_numpy(zero_copy_only=False)
        place = np.repeat(cells["place"].to_numpy(), length)
        first = np.repeat(cells["at"].to_numpy() - np.cumsum(length) + length, length)
        out[first + np.arange(len(first)), place] = x.flatten().to_numpy(zero_copy_only=False)
    return out


def column_design(columns: DataFrame, responses: DataFrame, layout: BlockLayout) -> DataFrame:
    """Z_k of every position and block: ``row_id, y, block, z``, as `block_design` gives it from rows.

    `columns`: dense or sparse result of `transpose`. `responses`: ``pos, y`` of all positions
    0..n-1; ``fold`` is passed on. Noise is drawn by row id, which columns have lost, so it is refused.
    """
    if layout.sigma is not None:
        raise ValueError("column-wise data has no row ids to draw noise by")
    step, q, n_blocks = tile_rows(layout), layout.q, layout.n_blocks
    folded = "fold" in responses.columns
    shape = Shared(columns.sparkSession, layout)
    cells = _cells(columns, layout, step)
    tiles = responses.select(F.floor(F.col("pos") / step).alias("tile"), "pos", F.col("y").cast("double").alias("y"),
                             *(["fold"] if folded else []))
    shared = "tile bigint, block int, y array<double>, fold array<int>, r array<double>"

    def project(key, table):
        k, lay = key[1].as_py(), shape.value
        r = lay.projection.block(_matrix(table, step, lay.raw_width(k)), k, lay.cols[k])
        return pa.table({"tile": [key[0].as_py()], "block": pa.array([k], pa.int32()), "r": [r.ravel()]})

    def meet(key, own, table):
        lay, tile = shape.value, key[0].as_py()
        order = np.argsort(table["pos"].to_numpy())
        n = len(order)
        if not np.array_equal(table["pos"].to_numpy()[order], tile * step + np.arange(n)):
            raise ValueError("responses must have every position 0..n-1 once, and columns no others")
        total = np.zeros((n_blocks, n, q))
        for k, r in zip(own["block"].to_pylist(), own["r"]):
            total[k] = r.values.to_numpy().reshape(step, q)[:n]
        rest = []
        for k in range(n_blocks):
            if lay.alone:
                rest.append(np.empty((n, 0)))
            elif lay.mode == "add":
                rest.append(total.sum(axis=0) - total[k])
            else:
                rest.append(np.hstack(np.delete(total, k, axis=0)))
        fold = table["fold"].to_numpy()[order] if folded else np.zeros(n, np.int32)
        return pa.table({
            "tile": pa.array([tile] * n_blocks), "block": pa.array(range(n_blocks), pa.int32()),
            "y": [table["y"].to_numpy()[order]] * n_blocks, "fold": pa.array([fold] * n_blocks, pa.list_(pa.int32())),
            "r": pa.array([r.ravel() for r in rest], pa.list_(pa.float64()))})

    def design(key, own, table):
        tile, k = key[0].as_py(), key[1].as_py()
        if not table.num_rows:
            raise ValueError("columns have positions without a response")
        y = table["y"][0].values.to_numpy()
        n = len(y)
        r = table["r"][0].values.to_numpy().reshape(n, -1)
        z = np.hstack([_matrix(own, step, shape.value.raw_width(k))[:n], r])
        ends = pa.array(np.arange(0, z.size + 1, max(z.shape[1], 1), dtype=np.int32)[:n + 1])
        return pa.table({
            "row_id": pa.array(tile * step + np.arange(n)), "y": y, "block": pa.array(np.full(n, k, np.int32)),
            "z": pa.ListArray.from_arrays(ends, pa.array(z.ravel())),
            **({"fold": table["fold"][0].values} if folded else {})})

    if layout.alone:
        projected = cells.select("tile", "block", F.array().cast("array<double>").alias("r")).limit(0)
    else:
        projected = cells.groupBy("tile", "block").applyInArrow(project, "tile bigint, block int, r array<double>")
    met = projected.groupBy("tile").cogroup(tiles.groupBy("tile")).applyInArrow(meet, shared)
    out = "row_id bigint, y double, block int, z array<double>" + (", fold int" if folded else "")
    return cells.groupBy("tile", "block").cogroup(met.groupBy("tile", "block")).applyInArrow(design, out)
