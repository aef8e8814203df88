"""Splits, folds, row numbers, column blocks and the column-wise layout."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardfit.functions.arrow import matrix_of
from shardfit.functions.checkpoints import keep
from shardfit.functions.hashing import WORD, hash_word
from shardfit.functions.shared import Shared
from shardfit.operators.rows import feature_count, is_sparse

RANK_BUCKETS = 65_536      # hash ranges that are ranked apart from each other
CHUNK_VALUES = 4_000_000   # doubles of one transposed chunk, 32 MB
ROW_CHUNK = 65_536         # most observations of one column in one chunk
LEAST_ROWS = 4_096         # rows of a chunk below which rows are cut by columns too


def split_train_test(df: DataFrame, fraction: float = 0.2, seed: int = 3,
                     key: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Two disjoint filters on a hash of the row id; nothing is shuffled."""
    if not 0 <= fraction <= 1:
        raise ValueError("the test fraction must lie in [0, 1]")
    helper = key not in df.columns
    if helper:
        df = df.withColumn(key, F.monotonically_increasing_id())
    is_test = hash_word(seed, "split", F.col(key)) < int(fraction * WORD)
    parts = df.where(~is_test), df.where(is_test)
    return tuple(p.drop(key) for p in parts) if helper else parts


def hash_rank(df: DataFrame, hashed: Column, key: str, name: str) -> DataFrame:
    """0-based rank of every row in the order of (hash, key), without a global sort.

    Equal ranges of an even hash hold about equally many rows. Each range is
    ranked on its own, and the counts of the ranges before it are added.
    """
    ranged = df.withColumn("__h", hashed).withColumn(
        "__b", F.floor(F.col("__h") / (WORD // RANK_BUCKETS))
    )
    counts = ranged.groupBy("__b").agg(F.count("*").alias("__n"))
    before = counts.select(
        "__b", (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).alias("__before")
    )
    within = F.row_number().over(Window.partitionBy("__b").orderBy("__h", key))
    return (
        ranged.withColumn("__r", within)
        .join(F.broadcast(before), "__b", "left")  # at most RANK_BUCKETS rows
        .withColumn(name, F.col("__before") + F.col("__r") - 1)
        .drop("__h", "__b", "__r", "__before")
    )


def assign_folds(df: DataFrame, k: int = 5, seed: int = 1, mode: str = "hash",
                 key: str = "row_id") -> DataFrame:
    """Add ``fold`` in 1..k.

    ``hash`` needs no shuffle and gives folds of about equal size. ``rank`` deals
    the rows out in hash order, so fold sizes differ by at most one.
    """
    if k < 2:
        raise ValueError("at least two folds are needed")
    h = hash_word(seed, "fold", F.col(key))
    if mode == "hash":
        return df.withColumn("fold", (h % k + 1).cast("int"))
    if mode == "rank":
        return hash_rank(df, h, key, "__rank").withColumn(
            "fold", (F.col("__rank") % k + 1).cast("int")
        ).drop("__rank")
    raise ValueError(f"fold mode must be 'hash' or 'rank', got {mode!r}")


def fold_rows(df: DataFrame, fold: int, held_out: bool) -> DataFrame:
    """Rows of one fold, or of all the others."""
    return df.where(F.col("fold") == fold) if held_out else df.where(F.col("fold") != fold)


def _in_order(df: DataFrame, key: str) -> DataFrame:
    """Rows sorted by key over ranges, with ``__id`` (range in its upper bits, row in the lower 33).

    Spark draws bounds from a sample of the keys, so the ranges are about equal whatever the
    distribution; there are as many as shuffle partitions. The rows are written once, as bounds
    drawn anew would differ. A null key fails the job.
    """
    known = F.assert_true(F.col(key).isNotNull(), F.lit(f"{key} must not be null"))
    placed = df.where(known.isNull()).repartitionByRange(key).sortWithinPartitions(key)
    return keep(placed.withColumn("__id", F.monotonically_increasing_id()))


def _range_sizes(placed: DataFrame) -> DataFrame:
    """Rows of every range and of all ranges before it: ``__part, __n, __before``."""
    counts = placed.groupBy(F.shiftright("__id", 33).alias("__part")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")  # one record per range
    return counts.select("__part", "__n", before.alias("__before"))


def number_rows(df: DataFrame, key: str = "row_id", name: str = "pos") -> DataFrame:
    """0-based position of every row in key order, without a one-task sort."""
    placed = _in_order(df, key)
    row = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("__part", F.shiftright("__id", 33)).join(
        F.broadcast(_range_sizes(placed).drop("__n")), "__part"  # one record per range
    ).withColumn(name, F.col("__before") + row).drop("__part", "__before", "__id")


def feature_index(spark: SparkSession, n_features: int) -> DataFrame:
    return spark.range(n_features).select(F.col("id").cast("int").alias("col"))


def assign_blocks(spark: SparkSession, n_features: int, n_blocks: int, mode: str = "random",
                  seed: int = 1, block_map: DataFrame | None = None) -> DataFrame:
    """Block of every feature: ``explicit`` map, contiguous ``range``, or ``random``."""
    if mode == "explicit":
        if block_map is None:
            raise ValueError("mode 'explicit' needs a block_map")
        found = block_map.agg(
            F.count_distinct("block"), F.count("*"), F.count_distinct("col"),
            F.min("col"), F.max("col"),
        ).first()
        if found[0] != n_blocks:
            raise ValueError(f"the block map names {found[0]} blocks, {n_blocks} are asked for")
        if tuple(found[1:]) != (n_features, n_features, 0, n_features - 1):
            raise ValueError(f"the block map must list every column 0..{n_features - 1} once")
        # blocks are numbered 0..K-1 in the order of their ids
        ids = block_map.select("block").distinct()
        numbered = ids.select(
            "block", (F.row_number().over(Window.orderBy("block")) - 1).alias("number")
        )
        return block_map.join(F.broadcast(numbered), "block").select(  # K records
            F.col("col").cast("int"), F.col("number").cast("int").alias("block")
        )
    if not 1 <= n_blocks <= n_features:
        raise ValueError(f"{n_features} features cannot fill {n_blocks} blocks")
    cols = feature_index(spark, n_features)
    if mode == "range":
        block = F.floor(F.col("col").cast("bigint") * n_blocks / n_features)
        return cols.select("col", block.cast("int").alias("block"))
    if mode == "random":
        dealt = hash_rank(cols, hash_word(seed, "block", F.col("col")), "col", "__rank")
        return dealt.select("col", (F.col("__rank") % n_blocks).cast("int").alias("block"))
    raise ValueError(f"partitioner must be 'explicit', 'range' or 'random', got {mode!r}")


def response(rows: DataFrame) -> DataFrame:
    """Response by position in row-id order."""
    return number_rows(rows.select("row_id", "y")).select("pos", "y")


def transpose(rows: DataFrame, n_features: int | None = None,
              chunk_rows: int | None = None) -> DataFrame:
    """Column-wise layout: ``col, chunk, start, obs`` (dense) or ``col, chunk, pos, obs`` (sparse).

    A column is cut into chunks of consecutive positions, so no group grows with the table;
    reading a column in chunk order gives its observations by row id. Dense chunks begin anew
    with every range of the sorted rows, so a chunk may be shorter than the others, and they are
    cut where the rows lie. Only rows too wide for that are cut by columns too, and their tiles,
    a bounded number of rows by a bounded number of columns, are put together by one shuffle.
    The sparse layout holds non-zeros with their positions, and all-zero columns have no record.
    """
    if is_sparse(rows):
        step = chunk_rows or ROW_CHUNK
        long = number_rows(rows.select("row_id", "entries")).select("pos", F.inline("entries"))
        cells = F.array_sort(F.collect_list(F.struct("pos", "x")))
        return (
            long.where("x <> 0")
            .groupBy("col", F.floor(F.col("pos") / step).alias("chunk"))
            .agg(cells.alias("__c"))
            .select("col", "chunk", F.col("__c.pos").alias("pos"), F.col("__c.x").alias("obs"))
        )
    if n_features is None:
        n_features = feature_count(rows)
    step = chunk_rows or min(ROW_CHUNK, CHUNK_VALUES // max(n_features, 1))
    if chunk_rows is None and step < LEAST_ROWS:
        step = ROW_CHUNK
    tile = max(1, CHUNK_VALUES // step)
    placed = _in_order(rows.select("row_id", "features"), "row_id")
    sizes, done = {}, 0
    for r in _range_sizes(placed).orderBy("__part").collect():  # one record per range
        sizes[r["__part"]] = (r["__before"], done)
        done += -(-r["__n"] // step)
    at = Shared(rows.sparkSession, sizes)
    cut = _Cutter(n_features, step, tile, at)
    if n_features <= tile:
        return placed.mapInArrow(cut.columns, COLUMNS)
    pieces = placed.mapInArrow(cut.tiles, "chunk bigint, tile int, start bigint, first int, x array<double>")

    def join(key, table):
        low = key[1].as_py() * tile
        width = min(tile, n_features - low)
        order = np.argsort(table["first"].to_numpy())
        x = np.concatenate([table["x"][int(i)].values.to_numpy().reshape(-1, width) for i in order])
        return pa.Table.from_batches([column_records(x, low, key[0].as_py(), table["start"][0].as_py())])

    return pieces.groupBy("chunk", "tile").applyInArrow(join, COLUMNS)


COLUMNS = "col int, chunk bigint, start bigint, obs array<double>"


def column_records(x: np.ndarray, first_col: int, chunk: int, start: int) -> pa.RecordBatch:
    """One record per column of a piece of consecutive rows."""
    n, width = x.shape
    ends = pa.array(np.arange(0, n * width + 1, n, dtype=np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(first_col, first_col + width, dtype=np.int32)), pa.array(np.full(width, chunk)),
         pa.array(np.full(width, start)),
         pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(x.T).ravel()))],
        ["col", "chunk", "start", "obs"])


class _Cutter:
    """Sorted rows of a task as pieces of consecutive positions."""

    def __init__(self, width: int, step: int, tile: int, at: Shared):
        self.width, self.step, self.tile, self.at = width, step, tile, at

    def _pieces(self, batches, most: int):
        """(chunk, start of the chunk, first row in it, rows) with at most `most` rows."""
        for batch in batches:
            ids = batch.column("__id").to_numpy()
            x = matrix_of(batch.column("features"), self.width, "features")
            low = 0
            while low < len(ids):
                part, row = int(ids[low]) >> 33, int(ids[low]) & ((1 << 33) - 1)
                before, chunks = self.at.value[part]
                end = (row // self.step + 1) * self.step - row  # rows up to the end of the chunk
                end = min(low + min(end, most), int(np.searchsorted(ids, (part + 1) << 33)))
                yield chunks + row // self.step, before + row - row % self.step, row % self.step, x[low:end]
                low = end

    def columns(self, batches):
        """Whole chunks of all columns."""
        held, last = [], None
        for chunk, start, _, x in self._pieces(batches, self.step):
            if last not in (None, (chunk, start)):
                yield column_records(np.concatenate(held), 0, *last)
                held = []
            held.append(x)
            last = (chunk, start)
        if held:
            yield column_records(np.concatenate(held), 0, *last)

    def tiles(self, batches):
        """Pieces of chunks, cut by columns."""
        for chunk, start, first, x in self._pieces(batches, max(1, CHUNK_VALUES // self.width)):
            for low in range(0, self.width, self.tile):
                part = np.ascontiguousarray(x[:, low:low + self.tile])
                ends = pa.array([0, part.size], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk]), pa.array([low // self.tile], pa.int32()), pa.array([start]),
                     pa.array([first], pa.int32()), pa.ListArray.from_arrays(ends, pa.array(part.ravel()))],
                    ["chunk", "tile", "start", "first", "x"])
