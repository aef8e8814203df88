"""Design matrices Z_k = [own raw columns | random features of the other blocks].

A row table holds all columns of a row together, so Z_k is computed row by row
without a shuffle. ``block_design`` publishes it; the fits read the same feed
inside their tasks and keep only sums.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardfit.functions.arrow import SLICE_VALUES, cuts, entries_of, matrix_of, scatter
from shardfit.functions.shared import Shared, from_driver, to_driver
from shardfit.functions.sizes import broadcast_if_small
from shardfit.operators.projection import check_privacy, noise_draw, noise_sd
from shardfit.operators.rows import is_sparse

MODES = ("add", "concatenate")
SLICE_ENTRIES = 500_000   # entries of sparse rows that are handled at once


class EntryMatrix:
    """Z_k of a slice of sparse rows: entries of the own columns beside a matrix of the shared features."""

    def __init__(self, row: np.ndarray, place: np.ndarray, val: np.ndarray, n: int, width: int):
        at = row * width + place
        if len(at) and (np.diff(at) <= 0).any():  # a column that comes twice counts once, with its sum
            at, to = np.unique(at, return_inverse=True)
            row, place, val = at // width, at % width, np.bincount(to, weights=val)
        self.row, self.place, self.val, self.own = row, place, val, width
        self.others = np.empty((n, 0))

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.others), self.own + self.others.shape[1]

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        out = self.others @ w[self.own:]
        for c in range(w.shape[1]):
            out[:, c] += np.bincount(self.row, weights=self.val * w[self.place, c], minlength=len(out))
        return out

    def left(self, a: np.ndarray) -> np.ndarray:
        """a Z, of one weight per row."""
        own = np.bincount(self.place, weights=self.val * a[self.row], minlength=self.own)
        return np.concatenate([own, a @ self.others])

    def left_squares(self, a: np.ndarray) -> np.ndarray:
        """a (Z * Z)."""
        own = np.bincount(self.place, weights=self.val * self.val * a[self.row], minlength=self.own)
        return np.concatenate([own, a @ (self.others * self.others)])


@dataclass
class BlockLayout:
    """Columns of every block, the projection matrix, and how the blocks share it."""

    n_features: int
    cols: list            # per block: ascending column indices
    q: int = 0            # 0: every block stands alone
    mode: str = "add"
    projection: object = None  # gives X_k Pi_k of all blocks inside a task; see draws.py
    sigma: object = None   # noise deviation per block, or None
    noise_seed: object = None
    places: object = None  # made by the tasks

    @property
    def n_blocks(self) -> int:
        return len(self.cols)

    @property
    def alone(self) -> bool:
        return self.q == 0 or self.n_blocks == 1

    def raw_width(self, k: int) -> int:
        return len(self.cols[k])

    def width(self, k: int) -> int:
        if self.alone:
            return self.raw_width(k)
        others = self.n_blocks - 1 if self.mode == "concatenate" else 1
        return self.raw_width(k) + others * self.q

    def slices(self, batch: pa.RecordBatch, wanted=None, entries: bool = False):
        """Yield (low, high, block, Z) for slices of a batch of dense or sparse rows.

        With ``entries`` Z of sparse rows is an `EntryMatrix`, so that work is per entry.
        """
        wanted = range(self.n_blocks) if wanted is None else wanted
        dense = "features" in batch.schema.names
        widest = 0 if entries else max(len(c) for c in self.cols)
        per_row = self.n_features if dense else max(widest, self.n_blocks * self.q)
        step = max(1, SLICE_VALUES // max(per_row, 1))
        lists = batch.column("features" if dense else "entries")
        for low, high in cuts(lists, SLICE_VALUES if dense else SLICE_ENTRIES, step):
            rows = batch.slice(low, high - low)
            raw, projected = self._dense(rows) if dense else self._sparse(rows, entries)
            if not self.alone and "noise" in batch.schema.names:
                noise = matrix_of(rows.column("noise"), self.n_blocks * self.q, "noise")
                projected = projected + noise * np.repeat(self.sigma, self.q)
            total = None
            if not self.alone and self.mode == "add":
                total = projected.reshape(-1, self.n_blocks, self.q).sum(axis=1)
            for k in wanted:
                own = slice(k * self.q, (k + 1) * self.q)
                z = raw(k)
                if not self.alone:
                    others = total - projected[:, own] if self.mode == "add" else np.delete(projected, own, axis=1)
                    if isinstance(z, EntryMatrix):
                        z.others = others
                    else:
                        z = np.hstack([z, others])
                yield low, low + rows.num_rows, k, z

    def _dense(self, rows: pa.RecordBatch):
        x = matrix_of(rows.column("features"), self.n_features, "features")
        projected = None
        if not self.alone:
            projected = self.projection.dense(x, self.cols)
        return lambda k: x[:, self.cols[k]], projected

    def _sparse(self, rows: pa.RecordBatch, as_entries: bool):
        """Work per entry: no matrix of all features is formed."""
        n, blocks = rows.num_rows, self.n_blocks
        row, col, val = entries_of(rows, self.n_features)
        block, place = self._places()
        by_block = np.argsort(block[col], kind="stable")
        row, col, val = row[by_block], col[by_block], val[by_block]
        ends = np.searchsorted(block[col], np.arange(blocks + 1))
        projected = None
        if not self.alone:
            widths = [self.raw_width(k) for k in range(blocks)]
            projected = self.projection.entries(row, col, val, block[col], place[col], n, widths)

        def raw(k):
            own = slice(ends[k], ends[k + 1])
            width = self.raw_width(k)
            if as_entries:
                return EntryMatrix(row[own], place[col[own]], val[own], n, width)
            return scatter(row[own] * width + place[col[own]], val[own], (n, width))

        return raw, projected

    def _places(self):
        """Block of every column, and its place in the block."""
        if self.places is None:
            block, place = np.empty(self.n_features, int), np.empty(self.n_features, int)
            for k, c in enumerate(self.cols):
                block[c], place[c] = k, np.arange(len(c))
            self.places = block, place
        return self.places


def block_layout(blocks: DataFrame, projection=None, mode: str = "add") -> BlockLayout:
    """The model's shape: one record per feature, and a projection of `draws.py` or none.

    The size depends on features, blocks and coordinates only, never on rows.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
    found = to_driver(blocks.select("block", "col")).sort_values(["block", "col"])
    names = np.unique(found["block"].to_numpy())
    if not np.array_equal(names, np.arange(len(names))):
        raise ValueError("blocks must be numbered 0..K-1")
    cols = [found["col"].to_numpy()[found["block"].to_numpy() == b] for b in names]
    return BlockLayout(len(found), cols, projection.q if projection else 0, mode, projection)


def add_noise(layout: BlockLayout, ranges: DataFrame, eps: float = 10.0, delta: float = 0.05,
              seed: int = 1) -> BlockLayout:
    """Switch on noise with one deviation per block, from the column range of the block."""
    check_privacy(eps, delta)
    if not layout.alone:
        sd = to_driver(ranges.select("block", noise_sd(F.col("range"), eps, delta).alias("sd")))
        layout.sigma = sd.set_index("block")["sd"].reindex(range(layout.n_blocks)).to_numpy()
        layout.noise_seed = seed
    return layout


def feed_rows(rows: DataFrame, layout: BlockLayout) -> DataFrame:
    """The columns that the tasks read, plus the noise draws if they are switched on."""
    keep = ["row_id", "y", "entries" if is_sparse(rows) else "features"]
    if "fold" in rows.columns:
        keep.append("fold")
    if layout.sigma is None:
        return rows.select(*keep)
    slots = F.sequence(F.lit(0), F.lit(layout.n_blocks * layout.q - 1))
    draws = F.transform(
        slots,
        lambda t: noise_draw(
            layout.noise_seed, F.col("row_id"),
            F.floor(t / layout.q).cast("int"), (t % layout.q).cast("int"),
        ),
    )
    return rows.select(*keep, draws.alias("noise"))


class RowsFeed:
    """Designs of all wanted blocks from batches of rows."""

    def __init__(self, layout, wanted=None, entries=False):
        self.layout, self.wanted, self.entries = layout, wanted, entries

    def only(self, wanted, entries=False):
        return RowsFeed(self.layout, wanted, entries)

    def __call__(self, batch):
        y = batch.column("y").to_numpy(zero_copy_only=False)
        names = batch.schema.names
        fold = batch.column("fold").to_numpy() if "fold" in names else np.zeros(len(y), int)
        for low, high, k, z in self.layout.value.slices(batch, self.wanted, self.entries):
            yield k, z, y[low:high], fold[low:high]


class DesignFeed:
    """The same from a published design table (row_id, y, block, z)."""

    def __init__(self, widths, wanted=None):
        self.widths, self.wanted = widths, wanted

    def only(self, wanted, entries=False):
        return DesignFeed(self.widths, wanted)

    def __call__(self, batch):
        block = batch.column("block").to_numpy()
        y = batch.column("y").to_numpy(zero_copy_only=False)
        names = batch.schema.names
        fold = batch.column("fold").to_numpy() if "fold" in names else np.zeros(len(y), int)
        for k in np.unique(block):
            if self.wanted is not None and k not in self.wanted:
                continue
            at = np.flatnonzero(block == k)
            z = matrix_of(batch.column("z").take(pa.array(at)), self.widths[int(k)], "z")
            yield int(k), z, y[at], fold[at]


def block_design(rows: DataFrame, layout: BlockLayout) -> DataFrame:
    """Z_k of every row and block: ``row_id, y, block, z`` (and ``fold``). Narrow."""
    shape = Shared(rows.sparkSession, layout)
    source = feed_rows(rows, layout)
    names = ["row_id", "y", "block", "z"] + (["fold"] if "fold" in source.columns else [])
    types = {"row_id": "bigint", "y": "double", "block": "int", "z": "array<double>", "fold": "int"}
    schema = ", ".join(f"{c} {types[c]}" for c in names)

    def run(batches):
        for batch in batches:
            for low, high, k, z in shape.value.slices(batch):
                n, m = z.shape
                ends = pa.array(np.arange(0, n * m + 1, m, dtype=np.int32))
                made = {
                    "block": pa.array(np.full(n, k, np.int32)),
                    "z": pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(z).ravel())),
                }
                kept = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [made[c] if c in made else kept.column(c) for c in names], names
                )

    return source.mapInArrow(run, schema)


def long_design(long: DataFrame, rows: DataFrame, blocks: DataFrame, projected: DataFrame | None,
                q: int, n_blocks: int, mode: str = "add") -> DataFrame:
    """Z_k from the long form and the blocks' projections, for matrices too large to broadcast.

    ``projected`` is the result of ``apply_projection`` (``row_id, block, proj, r``). A row's cells,
    its own and the projected ones, meet as one array, and every block reads its part of it: the
    shuffle holds each of them once, whatever the number of blocks and the mode. A group is one row.
    """
    spark = rows.sparkSession
    numbered = to_driver(blocks.select("block", "col")).sort_values(["block", "col"])  # one record per feature
    p, widths = len(numbered), numbered.groupby("block").size().to_numpy()
    slots = from_driver(spark, numbered.assign(slot=np.arange(p))[["col", "slot"]], "col int, slot int")
    cells = long.select("row_id", "col", "x").join(broadcast_if_small(slots, p), "col").select(
        "row_id", F.col("slot").cast("long").alias("slot"), F.col("x").alias("v"))
    if projected is not None:
        cells = cells.unionByName(projected.select(
            "row_id", (F.col("block").cast("long") * q + F.col("proj") + p).alias("slot"), F.col("r").alias("v")))
    own = cells.groupBy("row_id").agg(F.collect_list(F.struct("slot", "v")).alias("cells"))
    names = ["row_id", "y"] + (["fold"] if "fold" in rows.columns else [])
    joined = rows.select(*names).join(own, "row_id", "left")
    width = p + (n_blocks * q if projected is not None else 0)
    starts = np.concatenate([[0], np.cumsum(widths)])
    step = max(1, SLICE_VALUES // max(width, 1))
    types = {"row_id": "bigint", "y": "double", "fold": "int"}
    schema = "row_id bigint, y double, block int, z array<double>" + (", fold int" if len(names) > 2 else "")

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                n = part.num_rows
                found = part.column("cells")
                flat = found.flatten()
                row = np.repeat(np.arange(n), pa.compute.fill_null(found.value_lengths(), 0).to_numpy(zero_copy_only=False))
                slot, v = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("slot", "v"))
                x = scatter(row * width + slot, v, (n, width))
                shared = x[:, p:].reshape(n, -1, q) if width > p else np.empty((n, n_blocks, 0))
                for k in range(n_blocks):
                    if mode == "add":
                        others = shared.sum(axis=1) - shared[:, k]
                    else:
                        others = np.delete(shared, k, axis=1).reshape(n, -1)
                    z = np.hstack([x[:, starts[k]:starts[k + 1]], others])
                    ends = pa.array(np.arange(n + 1, dtype=np.int32) * z.shape[1])
                    made = {"block": pa.array(np.full(n, k, np.int32)),
                            "z": pa.ListArray.from_arrays(ends, pa.array(z.ravel()))}
                    order = ["row_id", "y", "block", "z", *names[2:]]
                    yield pa.RecordBatch.from_arrays([made[c] if c in made else part.column(c) for c in order], order)

    return joined.select(*[F.col(c).cast(types[c]).alias(c) for c in names], "cells").mapInArrow(run, schema)


def design_widths(design: DataFrame) -> dict[int, int]:
    """Width of Z_k per block; one record per block reaches the driver."""
    found = design.groupBy("block").agg(F.max(F.size("z")).alias("m")).collect()
    return {r["block"]: r["m"] for r in found}
