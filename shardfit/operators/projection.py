"""Random projections of the column blocks, in the long form.

``pi`` is a projection matrix (col, block, proj, v); ``rp`` holds projected rows
(row_id, block, proj, r).
"""

import math

import numpy as np
from pyspark.ml.feature import DCT
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardfit.functions.hashing import hash_normal, hash_word, random_sign, sparse_sign
from shardfit.functions import sizes
from shardfit.functions.shared import to_driver
from shardfit.functions.sizes import broadcast_if_small
from shardfit.operators.draws import CosineProjection, MatrixProjection, SignProjection

PROJECTIONS = ("SDCT", "sparse")


def sparse_projection_matrix(blocks: DataFrame, q: int, seed: int = 1,
                             keep_zeros: bool = False) -> DataFrame:
    """Entries sqrt(3/q) * {-1, 0, +1} with weights 1/6, 2/3, 1/6, drawn per column."""
    proj = F.explode(F.sequence(F.lit(0), F.lit(q - 1))).alias("proj")
    v = math.sqrt(3.0 / q) * sparse_sign(seed, F.col("col"), F.col("proj"))
    pi = blocks.select("col", "block", proj).withColumn("v", v)
    return pi if keep_zeros else pi.where("v <> 0")


def check_width(blocks: DataFrame, q: int) -> None:
    narrowest = blocks.groupBy("block").count().agg(F.min("count")).first()[0]
    if q > narrowest:
        raise ValueError(
            f"projection dimension {q} exceeds the narrowest block, which has "
            f"{narrowest} features"
        )


def column_signs(blocks: DataFrame, seed: int = 1) -> DataFrame:
    """Random sign of every column: ``col, sign``."""
    return blocks.select("col", random_sign(seed, "sign", F.col("col")).alias("sign"))


def sampled_coordinates(blocks: DataFrame, q: int, seed: int = 1) -> DataFrame:
    """The q coordinates that are kept of every block: ``block, d, t, proj``."""
    drawn = hash_word(seed, "coordinate", F.col("block"), F.col("t"))
    return (
        blocks.groupBy("block").agg(F.count("*").alias("d"))
        .select("block", "d", F.explode(F.sequence(F.lit(0), (F.col("d") - 1).cast("int"))).alias("t"))
        .withColumn("proj", F.row_number().over(Window.partitionBy("block").orderBy(drawn, "t")) - 1)
        .where(F.col("proj") < q)
    )


def sdct_matrix(blocks: DataFrame, q: int, seed: int = 1) -> DataFrame:
    """Random signs, orthonormal cosine transform and q sampled coordinates, as one matrix.

    Column j of a block with d columns meets coordinate t in
    sqrt(d/q) * sign_j * c_t * cos(pi (j + 1/2) t / d).
    """
    check_width(blocks, q)
    place = F.row_number().over(Window.partitionBy("block").orderBy("col")) - 1
    columns = blocks.select("block", "col", place.alias("j")).join(column_signs(blocks, seed), "col")
    c_t = F.when(F.col("t") == 0, F.sqrt(1 / F.col("d"))).otherwise(F.sqrt(2 / F.col("d")))
    wave = F.cos(F.pi() * (F.col("j") + 0.5) * F.col("t") / F.col("d"))
    v = F.sqrt(F.col("d") / F.lit(float(q))) * F.col("sign") * c_t * wave
    return columns.join(sampled_coordinates(blocks, q, seed), "block").select("col", "block", "proj", v.alias("v"))


def task_projection(blocks: DataFrame, n_features: int, q: int, projection: str = "SDCT", seed: int = 1):
    """The same projection for use inside tasks: a matrix, or what it is drawn from if that is too large.

    At most one record per feature and one per sampled coordinate reach the driver.
    """
    if n_features * q <= sizes.MATRIX_VALUES:
        entries = to_driver(projection_matrix(blocks, q, projection, seed).select("col", "proj", "v"))
        matrix = np.zeros((n_features, q))
        matrix[entries["col"].to_numpy(), entries["proj"].to_numpy()] = entries["v"].to_numpy()
        return MatrixProjection(q, matrix)
    if projection == "sparse":
        return SignProjection(q, seed)
    check_width(blocks, q)
    signs = to_driver(column_signs(blocks, seed)).sort_values("col")["sign"].to_numpy()
    drawn = to_driver(sampled_coordinates(blocks, q, seed)).sort_values(["block", "proj"])
    return CosineProjection(q, signs, [t["t"].to_numpy() for _, t in drawn.groupby("block")])


def projection_matrix(blocks: DataFrame, q: int, projection: str = "SDCT",
                      seed: int = 1) -> DataFrame:
    if projection == "SDCT":
        return sdct_matrix(blocks, q, seed)
    if projection == "sparse":
        return sparse_projection_matrix(blocks, q, seed)
    raise ValueError(f"projection must be one of {PROJECTIONS}, got {projection!r}")


def dct(rows: DataFrame) -> DataFrame:
    """Orthonormal cosine transform of every row."""
    vectors = rows.withColumn("__v", array_to_vector("features"))
    out = DCT(inputCol="__v", outputCol="__t").transform(vectors)
    return out.withColumn("features", vector_to_array("__t")).drop("__v", "__t")


def apply_projection(long: DataFrame, pi: DataFrame, n_values: int,
                     grid: tuple[DataFrame, int, int] | None = None) -> DataFrame:
    """X_k Pi_k for all blocks: join on the feature, sum by row, block and coordinate.

    ``n_values`` bounds the entries of ``pi`` and decides whether it is broadcast.
    ``grid = (rows, n_blocks, q)`` also gives the zeros: rows without entries in a
    block then have records too, which sparse data needs.
    """
    matrix = broadcast_if_small(pi, n_values)
    terms = long.select("row_id", "col", "x").join(matrix, "col").select(
        "row_id", "block", "proj", (F.col("x") * F.col("v")).alias("r")
    )
    if grid is not None:
        rows, n_blocks, q = grid
        zeros = (
            rows.select("row_id", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
            .select("row_id", "block", F.explode(F.sequence(F.lit(0), F.lit(q - 1))).alias("proj"))
            .withColumn("r", F.lit(0.0))
        )
        terms = terms.unionByName(zeros)
    return terms.groupBy("row_id", "block", "proj").agg(F.sum("r").alias("r"))


def noise_sd(value_range: Column, eps: float, delta: float) -> Column:
    """(range / eps) * sqrt(2 (log(1 / (2 delta)) + eps))."""
    return value_range / eps * math.sqrt(2 * (math.log(1 / (2 * delta)) + eps))


def check_privacy(eps: float, delta: float) -> None:
    if eps <= 0 or not 0 < delta < 0.5:
        raise ValueError("private noise needs eps > 0 and 0 < delta < 1/2")


def noise_draw(seed, row_id: Column, block: Column, proj: Column) -> Column:
    return hash_normal(seed, "noise", row_id, block, proj)


def add_private_noise(rp: DataFrame, ranges: DataFrame, eps: float = 10.0,
                      delta: float = 0.05, seed: int = 1) -> DataFrame:
    """Add normal noise whose deviation follows the column range of the block.

    The draw can be repeated by anyone who knows the seed; keep it secret. No
    privacy guarantee is claimed.
    """
    check_privacy(eps, delta)
    sigma = ranges.select("block", noise_sd(F.col("range"), eps, delta).alias("sigma"))
    z = noise_draw(seed, F.col("row_id"), F.col("block"), F.col("proj"))
    return rp.join(sigma, "block").select(
        "row_id", "block", "proj", (F.col("r") + F.col("sigma") * z).alias("r")
    )


def sum_projections(rp: DataFrame) -> DataFrame:
    """Sum of the projections of all blocks."""
    return rp.groupBy("row_id", "proj").agg(F.sum("r").alias("r"))


def leave_one_out(rp: DataFrame) -> DataFrame:
    """For every block the sum of the other blocks' projections."""
    total = F.sum("r").over(Window.partitionBy("row_id", "proj"))
    return rp.select("row_id", "block", "proj", (total - F.col("r")).alias("r"))


def concat_projections(rp: DataFrame, n_blocks: int) -> DataFrame:
    """For every block the other blocks' projections, side by side.

    The records of one row are one small array (blocks times q values), which is
    handed to every block; no row is joined with itself.
    """
    own = rp.groupBy("row_id").agg(
        F.collect_list(F.struct(F.col("block").alias("other"), "proj", "r")).alias("__o")
    )
    targets = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block")
    return (
        own.select("row_id", "__o", targets)
        .select("row_id", "block", F.inline(F.filter("__o", lambda o: o["other"] != F.col("block"))))
        .select("row_id", "block", F.col("other").alias("other_block"), "proj", "r")
    )
