"""Fitting a whole model: blocks, shared projections, block fits, coefficients."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardfit.functions.checkpoints import keep
from shardfit.functions.losses import check_loss
from shardfit.functions.shared import from_driver, to_driver
from shardfit.functions import sizes
from shardfit.operators.columns import column_design
from shardfit.operators.design import (
    BlockLayout, add_noise, block_design, block_layout, design_widths, long_design,
)
from shardfit.operators.gram import gram, gram_rows
from shardfit.operators.layout import assign_blocks
from shardfit.operators.newton import fit_margin_design, fit_margin_rows
from shardfit.operators.projection import (
    PROJECTIONS, add_private_noise, apply_projection, projection_matrix, task_projection,
)
from shardfit.operators.ridge import fit_ridge, own_coefficients
from shardfit.operators.rows import feature_count, is_sparse, to_long
from shardfit.operators.scaling import column_range


def model_shape(spark, n_features: int, n_blocks: int = 4, q: int = 200, projection: str = "SDCT",
                mode: str = "add", partitioner: str = "random", seed: int = 1,
                block_map: DataFrame | None = None) -> tuple[BlockLayout, DataFrame]:
    """Blocks and shared projection of a model; q = 0 lets every block stand alone."""
    if projection not in PROJECTIONS:
        raise ValueError(f"projection must be one of {PROJECTIONS}, got {projection!r}")
    blocks = assign_blocks(spark, n_features, n_blocks, partitioner, seed, block_map)
    # one record per feature: kept as a local table, which later joins read at no cost
    blocks = from_driver(spark, to_driver(blocks), "col int, block int")
    shared = None
    if q > 0 and n_blocks > 1:
        shared = task_projection(blocks, n_features, q, projection, seed)
    return block_layout(blocks, shared, mode), blocks


def model_layout(rows: DataFrame, n_blocks: int = 4, q: int = 200, projection: str = "SDCT",
                 mode: str = "add", partitioner: str = "random", seed: int = 1,
                 block_map: DataFrame | None = None, n_features: int | None = None,
                 private: bool = False, eps: float = 10.0, delta: float = 0.05,
                 noise_seed=None) -> tuple[BlockLayout, DataFrame]:
    """The shape of a model of these rows, with noise of their column ranges if it is private."""
    layout, blocks = model_shape(rows.sparkSession, n_features or feature_count(rows), n_blocks, q,
                                 projection, mode, partitioner, seed, block_map)
    if private and not layout.alone:
        n_rows = rows.count() if is_sparse(rows) else None
        ranges = column_range(to_long(rows), blocks, n_rows)
        add_noise(layout, ranges, eps, delta, seed if noise_seed is None else noise_seed)
    return layout, blocks


def widest(layout: BlockLayout) -> int:
    return max(layout.width(k) for k in range(layout.n_blocks))


def fit_weights(rows: DataFrame, layout: BlockLayout, loss: str, lambdas, folds=(0,),
                **options) -> DataFrame:
    """Weights of every Z_k with gap and ``converged``; the width changes only how they are found.

    ``stopping_gap`` is what ``converged`` is measured by, ``max_iter`` bounds the iterations
    where there are any.
    """
    check_loss(loss)
    if loss == "squared" and folds == (0,) and widest(layout) <= sizes.DENSE_WIDTH:
        return fit_ridge(gram_rows(rows.drop("fold"), layout), lambdas, options.get("stopping_gap"))
    return fit_margin_rows(rows, layout, loss, lambdas, folds, **options)


def fit_block(design: DataFrame, loss: str, lambdas, widths: dict | None = None, **options) -> DataFrame:
    """Weights of published block designs for a given loss."""
    check_loss(loss)
    widths = widths or design_widths(design)
    if loss == "squared" and max(widths.values()) <= sizes.DENSE_WIDTH:
        return fit_ridge(gram(design.drop("fold"), widths=widths), lambdas, options.get("stopping_gap"))
    return fit_margin_design(design, loss, lambdas, widths=widths, **options)


def fit_path(rows: DataFrame, layout: BlockLayout, blocks: DataFrame, loss: str, lambdas,
             **options) -> DataFrame:
    """Coefficients for many penalties: one Gram for ridge, shared passes otherwise."""
    return own_coefficients(fit_weights(rows, layout, loss, lambdas, **options), blocks)


def fit_model(rows: DataFrame, n_blocks: int = 4, q: int = 200, loss: str = "squared",
              lam: float = 4.4, projection: str = "SDCT", mode: str = "add",
              partitioner: str = "random", seed: int = 1, block_map: DataFrame | None = None,
              n_features: int | None = None, private: bool = False, eps: float = 10.0,
              delta: float = 0.05, noise_seed=None, **options) -> DataFrame:
    """Coefficients of the joint model: ``col, block, lambda, beta``."""
    p = n_features or feature_count(rows)
    layout, blocks = model_layout(rows, n_blocks, q, projection, mode, partitioner, seed,
                                  block_map, p, private, eps, delta, noise_seed)
    return fit_path(rows, layout, blocks, loss, lam, **options).drop("fold")


def fit_columns(columns: DataFrame, responses: DataFrame, n_features: int, n_blocks: int = 4,
                q: int = 200, loss: str = "squared", lam=4.4, projection: str = "SDCT",
                mode: str = "add", partitioner: str = "random", seed: int = 1,
                block_map: DataFrame | None = None, **options) -> DataFrame:
    """The joint model from column-wise data and ``pos, y``: as `fit_model` on the rows."""
    layout, blocks = model_shape(columns.sparkSession, n_features, n_blocks, q, projection, mode,
                                 partitioner, seed, block_map)
    widths = {k: layout.width(k) for k in range(layout.n_blocks)}
    design = column_design(columns, responses, layout)
    return own_coefficients(fit_block(design, loss, lam, widths, **options), blocks).drop("fold")


def joined_design(rows: DataFrame, n_features: int, blocks: DataFrame, n_blocks: int, q: int,
                  projection: str = "SDCT", mode: str = "add", seed: int = 1,
                  private: bool = False, eps: float = 10.0, delta: float = 0.05,
                  noise_seed=None) -> DataFrame:
    """Block designs by joins with the projection matrix, which is never collected."""
    rows = keep(rows)  # read several times below
    long = to_long(rows, keep_zeros=False)
    rp = None
    if q > 0 and n_blocks > 1:
        pi = projection_matrix(blocks, q, projection, seed)
        # noise is added to zeros too; else blocks without entries in a row need no records
        rp = apply_projection(long, pi, n_features * q, (rows, n_blocks, q) if private else None)
        if private:
            rp = add_private_noise(rp, column_range(long, blocks, rows.count()), eps, delta,
                                   seed if noise_seed is None else noise_seed)
    return long_design(long, rows, blocks, rp, q, n_blocks, mode)
