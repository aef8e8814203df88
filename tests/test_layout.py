import numpy as np
import pytest
from pyspark.sql import functions as F

from shardfit.operators import layout as L
from shardfit.operators.rows import to_long, to_sparse
from shardfit.operators.scaling import center_scale, column_range, column_stats


def test_number_rows_is_exact_on_uneven_keys(spark):
    keys = [int(k) for k in np.random.default_rng(0).integers(0, 2**60, 3000)] + list(range(500))
    df = spark.createDataFrame([(k,) for k in set(keys)], "row_id bigint").repartition(5)
    found = L.number_rows(df).orderBy("row_id").collect()
    assert [r.pos for r in found] == list(range(len(set(keys))))


def test_ranked_folds_differ_by_at_most_one(spark):
    df = spark.range(1003).select(F.col("id").alias("row_id"))
    sizes = [r["count"] for r in L.assign_folds(df, 5, mode="rank").groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    again = L.assign_folds(df.repartition(7), 5, mode="rank")
    assert again.exceptAll(L.assign_folds(df, 5, mode="rank")).count() == 0


def test_hash_folds_and_split_need_no_shuffle(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"))
    folded = L.assign_folds(df, 5)
    train, test = L.split_train_test(folded, 0.2)
    for part in (folded, train, test):
        assert "Exchange" not in part._jdf.queryExecution().executedPlan().toString()
    assert train.count() + test.count() == 1000


def test_uneven_blocks(spark):
    for mode in ("range", "random"):
        sizes = L.assign_blocks(spark, 7, 3, mode).groupBy("block").count().orderBy("block").collect()
        assert [r["block"] for r in sizes] == [0, 1, 2]
        assert sorted(r["count"] for r in sizes) == [2, 2, 3]


def test_block_map_is_checked(spark):
    good = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "col int, block int")
    assert L.assign_blocks(spark, 3, 2, "explicit", block_map=good).count() == 3
    with pytest.raises(ValueError, match="2 blocks"):
        L.assign_blocks(spark, 3, 3, "explicit", block_map=good)
    with pytest.raises(ValueError, match="every column"):
        L.assign_blocks(spark, 4, 2, "explicit", block_map=good)
    with pytest.raises(ValueError, match="partitioner"):
        L.assign_blocks(spark, 4, 2, "other")


def test_explicit_blocks_may_have_any_ids(spark):
    named = spark.createDataFrame([(0, 70), (1, 5), (2, 70)], "col int, block int")
    found = L.assign_blocks(spark, 3, 2, "explicit", block_map=named).orderBy("col").collect()
    assert [r.block for r in found] == [1, 0, 1]


@pytest.mark.parametrize("chunk", [None, 7])
def test_transpose_dense(data, chunk):
    cols = L.transpose(data["reg"], 7, chunk).orderBy("col", "chunk").collect()
    for c in range(7):
        parts = [r for r in cols if r["col"] == c]
        assert [r.start for r in parts] == list(range(0, 40, chunk or 40))[:len(parts)]
        assert sum([r.obs for r in parts], []) == data["x"][:, c].tolist()


def test_transpose_sparse_drops_zero_columns(spark):
    rows = spark.createDataFrame(
        [(5, 1.0, [0.0, 1.0, 0.0]), (9, 2.0, [0.0, 0.0, 3.0]), (2, 3.0, [0.0, 4.0, 0.0])],
        "row_id bigint, y double, features array<double>",
    )
    cols = L.transpose(to_sparse(rows)).orderBy("col").collect()
    assert [(r["col"], r.pos, r.obs) for r in cols] == [(1, [0, 1], [4.0, 1.0]), (2, [2], [3.0])]
    assert [(r.pos, r.y) for r in L.response(rows).orderBy("pos").collect()] == [
        (0, 3.0), (1, 1.0), (2, 2.0)
    ]


def test_center_scale_tiny(spark):
    rows = spark.createDataFrame(
        [(i, float(i), [float(i), 5.0, float(i * i)]) for i in range(4)],
        "row_id bigint, y double, features array<double>",
    )
    x = np.array([[i, 5.0, i * i] for i in range(4)], float)
    found = np.array([r.features for r in center_scale(rows).orderBy("row_id").collect()])
    sd = x.std(axis=0, ddof=1)
    expected = np.where(sd > 0, (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1), 0)
    assert np.allclose(found, expected)
    y = [r.y for r in center_scale(rows, response=(True, True)).orderBy("row_id").collect()]
    assert np.allclose(y, (np.arange(4) - 1.5) / np.arange(4).std(ddof=1))
    test = rows.where("row_id > 1")
    by_train = center_scale(rows, test)[1].orderBy("row_id").first().features
    by_own = center_scale(rows, test, fit_on="each")[1].orderBy("row_id").first().features
    assert np.allclose(by_train, expected[2])
    assert np.isclose(by_own[0], -np.sqrt(0.5))


def test_sparse_rows_are_not_centred(data):
    with pytest.raises(ValueError, match="sparse"):
        center_scale(to_sparse(data["reg"]))
    assert center_scale(to_sparse(data["reg"]), features=(False, False)).count() == 40


def test_column_range_counts_missing_zeros(spark):
    rows = spark.createDataFrame(
        [(0, 1.0, [2.0, 1.0]), (1, 1.0, [3.0, 0.0])], "row_id bigint, y double, features array<double>"
    )
    blocks = L.assign_blocks(spark, 2, 2, "range")
    dense = column_range(to_long(rows), blocks).orderBy("block").collect()
    sparse = column_range(to_long(to_sparse(rows)), blocks, 2).orderBy("block").collect()
    assert [r["range"] for r in dense] == [r["range"] for r in sparse] == [1.0, 1.0]
    assert column_stats(to_long(rows)).count() == 2


def test_number_rows_on_heavy_tailed_keys(spark):
    """Ranges stay about equal where ids crowd together and a few lie far away."""
    df = spark.range(6000).selectExpr("case when id % 100 = 0 then id * id * 1000003 else id end as row_id")
    found = L.number_rows(df.distinct()).orderBy("row_id").collect()
    assert [r.pos for r in found] == list(range(len(found)))
    groups = df.distinct().repartitionByRange(8, "row_id").groupBy(F.spark_partition_id()).count()
    sizes = [r[1] for r in groups.collect()]
    assert max(sizes) <= 3 * len(found) / 8
    assert L.number_rows(df.where("row_id = 7")).first().pos == 0
    assert L.number_rows(df.where("row_id is null")).count() == 0
