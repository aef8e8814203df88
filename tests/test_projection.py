import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardfit.operators import projection as P
from shardfit.operators.design import block_design, block_layout
from shardfit.operators.layout import assign_blocks
from shardfit.operators.rows import to_long, to_sparse
from shardfit.plans.model import joined_design, model_layout


def dense(pi, p, q):
    m = np.zeros((p, q))
    for r in pi.collect():
        m[r["col"], r["proj"]] = r["v"]
    return m


def test_sparse_matrix_moments(spark):
    pi = P.sparse_projection_matrix(assign_blocks(spark, 500, 2, "range"), 40, 1, keep_zeros=True)
    v = np.array([r.v for r in pi.collect()])
    assert len(v) == 20000
    assert abs(v.mean()) < 0.01
    assert abs((v ** 2).mean() * 40 - 1) < 0.05
    assert abs((v == 0).mean() - 2 / 3) < 0.02


def test_full_cosine_matrix_is_orthonormal(spark):
    blocks = assign_blocks(spark, 12, 2, "range")
    m = dense(P.sdct_matrix(blocks, 6, 3), 12, 6)
    for part in (m[:6], m[6:]):
        assert np.allclose(part @ part.T, np.eye(6))


def test_cosine_matrix_is_sign_transform_sample(spark, data):
    """X Pi equals the transform of the signed columns, up to the sampled order."""
    blocks = assign_blocks(spark, 7, 1, "range")
    m = dense(P.sdct_matrix(blocks, 7, 2), 7, 7)
    j, t = np.arange(7)[:, None], np.arange(7)[None, :]
    c = np.where(t == 0, math.sqrt(1 / 7), math.sqrt(2 / 7)) * np.cos(np.pi * (j + 0.5) * t / 7)
    signs = np.sign(m[:, [k for k in range(7) if np.ptp(np.abs(m[:, k])) < 1e-12][0]])
    order = [int(np.argmax(np.abs((signs[:, None] * c).T @ m[:, k]))) for k in range(7)]
    assert sorted(order) == list(range(7))
    assert np.allclose(m, signs[:, None] * c[:, order])


def test_dct_matches_matrix(data):
    found = np.array([r.features for r in P.dct(data["reg"]).orderBy("row_id").collect()])
    j, t = np.arange(7)[:, None], np.arange(7)[None, :]
    c = np.where(t == 0, math.sqrt(1 / 7), math.sqrt(2 / 7)) * np.cos(np.pi * (j + 0.5) * t / 7)
    assert np.allclose(found, data["x"] @ c)


def test_width_is_guarded(spark):
    with pytest.raises(ValueError, match="exceeds"):
        P.sdct_matrix(assign_blocks(spark, 7, 3, "range"), 3)
    with pytest.raises(ValueError, match="projection"):
        P.projection_matrix(assign_blocks(spark, 7, 3, "range"), 2, "other")


def test_leave_one_out_is_the_projection_of_the_others(spark, data):
    blocks = assign_blocks(spark, 7, 3, "range")
    pi = P.sparse_projection_matrix(blocks, 2, 1)
    m = dense(pi, 7, 2)
    rp = P.apply_projection(to_long(data["reg"]), pi, 14, (data["reg"], 3, 2))
    own = {r["col"]: r["block"] for r in blocks.collect()}
    for r in P.leave_one_out(rp).collect():
        others = [c for c in range(7) if own[c] != r["block"]]
        assert np.isclose(r["r"], data["x"][r["row_id"], others] @ m[others, r["proj"]])


@pytest.mark.parametrize("mode", ["add", "concatenate"])
@pytest.mark.parametrize("private", [False, True])
def test_designs_agree_between_rows_sparse_rows_and_joins(spark, data, mode, private):
    rows = data["reg"]
    layout, blocks = model_layout(rows, 3, 2, "sparse", mode, "range", private=private,
                                  noise_seed=9)
    a = block_design(rows, layout).orderBy("row_id", "block").collect()
    b = block_design(to_sparse(rows), layout).orderBy("row_id", "block").collect()
    c = joined_design(to_sparse(rows), 7, blocks, 3, 2, "sparse", mode, 1, private,
                      noise_seed=9).orderBy("row_id", "block").collect()
    assert len(a) == len(b) == len(c) == 120
    for u, v, w in zip(a, b, c):
        assert (u.row_id, u.block, u.y) == (v.row_id, v.block, v.y) == (w.row_id, w.block, w.y)
        assert np.allclose(u.z, v.z) and np.allclose(u.z, w.z)
    if private:
        plain, _ = model_layout(rows, 3, 2, "sparse", mode, "range")
        z = block_design(rows, plain).orderBy("row_id", "block").first().z
        assert not np.allclose(a[0].z, z)


def test_noise_is_reproducible_and_zero_for_constant_columns(spark):
    rows = spark.createDataFrame([(i, 1.0, [1.0, 1.0]) for i in range(5)],
                                 "row_id bigint, y double, features array<double>")
    layout, _ = model_layout(rows, 2, 1, "sparse", "add", "range", private=True)
    assert list(layout.sigma) == [0.0, 0.0]
    draws = spark.range(20000).select(P.noise_draw(1, F.col("id"), F.lit(0), F.lit(0)).alias("z"))
    mean, sd = draws.agg(F.avg("z"), F.stddev("z")).first()
    assert abs(mean) < 0.03 and abs(sd - 1) < 0.03
    assert draws.exceptAll(draws.repartition(3)).count() == 0
    with pytest.raises(ValueError, match="eps"):
        P.check_privacy(0, 0.05)


def test_rows_of_wrong_width_are_refused(spark, data):
    layout, _ = model_layout(data["reg"], 2, 0, n_features=7)
    bad = spark.createDataFrame([(1, 1.0, [1.0, 2.0])], data["reg"].schema)
    with pytest.raises(Exception, match="every row must have 7 values"):
        block_design(bad, layout).collect()
    with pytest.raises(ValueError, match="mode"):
        block_layout(assign_blocks(spark, 4, 2, "range"), None, "other")


def test_a_large_matrix_is_not_broadcast(spark, data):
    pi = P.sparse_projection_matrix(assign_blocks(spark, 7, 3, "range"), 2, 1)
    for n_values, join in ((14, "BroadcastHashJoin"), (10**9, "SortMergeJoin")):
        rp = P.apply_projection(to_long(data["reg"]), pi, n_values)
        assert join in rp._jdf.queryExecution().executedPlan().toString()


def test_slices_of_a_batch_join_up(data, monkeypatch):
    """Slices of one row give what whole batches give, for dense and sparse rows."""
    layout, _ = model_layout(data["reg"], 3, 2, "sparse", "add", "range")
    whole = block_design(data["reg"], layout).orderBy("row_id", "block").collect()
    monkeypatch.setattr("shardfit.operators.design.SLICE_VALUES", 7)
    for rows in (data["reg"], to_sparse(data["reg"])):
        cut = block_design(rows, layout).orderBy("row_id", "block").collect()
        assert all(np.allclose(a.z, b.z) for a, b in zip(whole, cut)) and len(cut) == len(whole)


@pytest.mark.parametrize("partitioner", ["range", "random"])
def test_projections_in_tasks_equal_the_matrix(spark, monkeypatch, partitioner):
    """Signs by entry and cosines by transform, from dense slices, full and thin sparse ones."""
    rng = np.random.default_rng(4)
    p, q, k = 301, 5, 3
    blocks = assign_blocks(spark, p, k, partitioner)
    found = blocks.toPandas().sort_values(["block", "col"])
    cols = [found["col"].to_numpy()[found["block"].to_numpy() == b] for b in range(k)]
    block, place = np.empty(p, int), np.empty(p, int)
    for b, c in enumerate(cols):
        block[c], place[c] = b, np.arange(len(c))
    for kind in P.PROJECTIONS:
        monkeypatch.setattr("shardfit.functions.sizes.MATRIX_VALUES", 1 << 20)
        matrix = P.task_projection(blocks, p, q, kind, 7)
        monkeypatch.setattr("shardfit.functions.sizes.MATRIX_VALUES", 1)
        drawn = P.task_projection(blocks, p, q, kind, 7)
        assert type(matrix) is not type(drawn)
        for density in (1.0, 0.5, 0.01):
            x = rng.normal(size=(20, p)) * (rng.random((20, p)) < density)
            want = np.hstack([x[:, c] @ matrix.matrix[c] for c in cols])
            row, col = np.nonzero(x)
            order = np.argsort(block[col], kind="stable")
            row, col = row[order], col[order]
            for projection in (matrix, drawn):
                assert np.allclose(projection.dense(x, cols), want)
                args = row, col, x[row, col], block[col], place[col], 20, [len(c) for c in cols]
                assert np.allclose(projection.entries(*args), want)


def test_signs_are_remembered_within_bounds(monkeypatch):
    from shardfit.operators import draws

    monkeypatch.setattr(draws, "SIGN_BYTES", 10_000)
    signs = draws.SignProjection(3, 1)
    first = signs.rows(np.arange(100)).copy()
    for low in range(0, 1000, 50):
        signs.rows(np.arange(low, low + 50))
        assert len(signs.seen) + len(signs.old) < 200
    assert np.array_equal(signs.rows(np.arange(100)), first)


def test_joined_designs_read_their_rows_once(spark, data):
    """Their source is costly where texts become words."""
    from shardfit.operators.layout import assign_blocks
    from shardfit.operators.rows import to_sparse
    from shardfit.plans.model import joined_design

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = to_sparse(data["reg"])
    counted = rows.mapInArrow(count, rows.schema)
    design = joined_design(counted, 7, assign_blocks(spark, 7, 2, "range"), 2, 2, "sparse", "concatenate", 1)
    assert len(design.collect()) == 80 and seen.value == 40
