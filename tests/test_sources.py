import pytest

from shardfit.operators.rows import as_rows, feature_count, to_dense, to_flat_array, to_long, to_sparse
from shardfit.plans.preprocess import preprocess
from shardfit.sinks.tables import cast_and_save, save_n_feats, save_response, write_run_report
from shardfit.sources.stored import read_and_cast, read_dataset, read_stored_rows
from shardfit.sources.text import (
    read_block_map, read_comma, read_libsvm, read_n_feats, read_response, read_spaces,
)


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


LIBSVM = "1 3:0.5 1:2\n\n# a comment\n-1 2:1.5 5:0\n 1 4:4 \n1\n"


def test_libsvm_unordered_blank_and_comment_lines(spark, tmp_path):
    path = write(tmp_path, "a.txt", LIBSVM)
    rows = read_libsvm(spark, path).orderBy("row_id").collect()
    assert [r.y for r in rows] == [1, -1, 1, 1]
    assert [[tuple(e) for e in r.entries] for r in rows] == [
        [(0, 2.0), (2, 0.5)], [(1, 1.5)], [(3, 4.0)], []
    ]
    dense = read_libsvm(spark, path, sparse=False).orderBy("row_id").collect()
    # index 5 is listed with a zero, and still counts for the width
    assert dense[0].features == [2.0, 0.0, 0.5, 0.0, 0.0]
    assert dense[3].features == [0.0] * 5


def test_spaces_and_comma(spark, tmp_path):
    a = read_spaces(spark, write(tmp_path, "s.txt", "1.5 2   3\n-1 0 4\n")).orderBy("row_id")
    b = read_comma(spark, write(tmp_path, "c.txt", "1.5,2 3\n-1, 0 4\n")).orderBy("row_id")
    expected = [(1.5, [2.0, 3.0]), (-1.0, [0.0, 4.0])]
    assert [(r.y, r.features) for r in a.collect()] == expected
    assert [(r.y, r.features) for r in b.collect()] == expected


def test_response_and_block_map_positions(spark, tmp_path):
    path = write(tmp_path, "r.txt", "1 2.5 3\n4\n\n5 6\n")
    found = read_response(spark, path).orderBy("pos").collect()
    assert [(r.pos, r.y) for r in found] == list(enumerate([1, 2.5, 3, 4, 5, 6]))
    blocks = read_block_map(spark, write(tmp_path, "b.txt", "0 1 1 0")).orderBy("col").collect()
    assert [(r.col, r.block) for r in blocks] == [(0, 0), (1, 1), (2, 1), (3, 0)]


def test_response_round_trip_over_many_files(spark, tmp_path, data):
    path = str(tmp_path / "resp")
    save_response(data["reg"], path)
    found = read_response(spark, path).orderBy("pos").collect()
    assert [r.y for r in found] == data["y"].tolist()


def test_read_dataset_shares_the_width_of_both_files(spark, tmp_path):
    train, test = write(tmp_path, "tr", "1 1:1 9:2\n"), write(tmp_path, "te", "1 2:1\n")
    sets = read_dataset(spark, "libsvm", train=train, test=test)
    assert [len(s.first().features) for s in sets] == [9, 9]


def test_read_dataset_split_is_disjoint_and_whole(spark, tmp_path):
    path = write(tmp_path, "s.txt", "\n".join(f"{i} {i} 1" for i in range(200)))
    train, test = read_dataset(spark, "spaces", path)
    a, b = [{r.y for r in s.collect()} for s in (train, test)]
    assert not a & b and len(a | b) == 200 and 15 < len(b) < 70


def test_refusals(spark, tmp_path, data):
    with pytest.raises(ValueError, match="text format"):
        read_dataset(spark, "csv", "x")
    with pytest.raises(ValueError, match="row class"):
        cast_and_save(data["reg"], data["reg"], "Other", "a", "b")
    with pytest.raises(ValueError, match="flat array"):
        as_rows(spark.createDataFrame([(1, "x")], "row_id bigint, name string"))
    with pytest.raises(ValueError, match="sparse"):
        preprocess(spark, "a", "b", path="x", sparse=True)
    with pytest.raises(ValueError, match="data format"):
        preprocess(spark, "a", "b", data_format="csv", path="x")


@pytest.mark.parametrize("kind", ["DataPoint", "LabeledPoint", "DoubleArray"])
def test_stored_rows_round_trip(spark, tmp_path, data, kind):
    out = str(tmp_path / "out")
    cast_and_save(data["reg"], data["reg"], kind, out + "a", out + "b")
    train, test = read_and_cast(spark, train=f"{out}a-{kind}", test=f"{out}b-{kind}")
    for part in (train, test):
        found = part.orderBy("row_id").collect()
        assert [r.y for r in found] == data["y"].tolist()
        assert [r.features for r in found] == data["x"].tolist()
    both = read_stored_rows(spark, f"{out}a-{kind}")
    assert sum(p.count() for p in both) == 40


def test_row_forms(data):
    rows = data["reg"]
    sparse = to_sparse(rows)
    assert feature_count(sparse) == feature_count(rows) == feature_count(to_long(rows)) == 7
    back = to_dense(sparse, 7).orderBy("row_id").collect()
    assert [r.features for r in back] == data["x"].tolist()
    flat = as_rows(to_flat_array(rows)).orderBy("row_id").collect()
    assert [(r.y, r.features) for r in flat] == list(zip(data["y"].tolist(), data["x"].tolist()))
    assert to_long(rows).count() == 280


def test_preprocess_writes_all_outputs(spark, tmp_path):
    path = write(tmp_path, "s.txt", "\n".join(f"{i} {i * 2} 1 {i % 3}" for i in range(60)))
    out = str(tmp_path / "train"), str(tmp_path / "test")
    train, test, p = preprocess(spark, *out, path=path, row_class="DoubleArray",
                                third_class="LabeledPoint")
    assert p == 3 and read_n_feats(spark, out[0] + "-nFeats") == 3
    assert train.count() + test.count() == 60
    cols = spark.read.parquet(out[0] + "-colwise")
    n = train.count()
    assert {r["col"]: r["n"] for r in cols.selectExpr("col", "size(obs) n").collect()} == {
        0: n, 1: n, 2: n
    }
    constant = cols.where("col = 1").first().obs
    assert set(constant) == {0.0}  # a constant column is zero after centring
    assert spark.read.parquet(out[0] + "-rowwise-DoubleArray").columns == ["row_id", "a"]
    assert spark.read.parquet(out[1] + "-LabeledPoint").count() == test.count()
    assert read_response(spark, out[1] + "-response").count() == test.count()


def test_run_report(spark, tmp_path):
    coef = spark.createDataFrame([(0, 1.0)], "col int, beta double")
    metrics = spark.createDataFrame([("test", 0.5)], "data string, error double")
    path = str(tmp_path / "report")
    write_run_report(coef, metrics, {"q": 8, "mode": "add"}, path)
    assert spark.read.parquet(path + "/coef").count() == 1
    assert spark.read.json(path + "/config").first().q == 8
    save_n_feats(spark, 12, str(tmp_path / "n"))
    assert read_n_feats(spark, str(tmp_path / "n")) == 12


def test_stored_forms_as_dense_and_sparse_rows(spark, tmp_path):
    from pyspark.ml.linalg import Vectors

    from shardfit.operators.rows import as_rows, sparse_rows
    from shardfit.sources.stored import read_and_cast

    vectors = spark.createDataFrame(
        [(1, 1.0, Vectors.sparse(5, [1, 4], [2.5, -1.0])), (2, -1.0, Vectors.dense([0.0, 3.0, 0.0, 0.0, 1e-17])),
         (3, 1.0, Vectors.sparse(5, [], []))], ["row_id", "label", "features"])
    want = {1: [(1, 2.5), (4, -1.0)], 2: [(1, 3.0), (4, 1e-17)], 3: []}
    sparse = sparse_rows(vectors)
    assert {r.row_id: [tuple(e) for e in r.entries] for r in sparse.collect()} == want
    dense = {r.row_id: r.features for r in as_rows(sparse, n_features=6).collect()}
    assert dense == {k: [dict(v).get(c, 0.0) for c in range(6)] for k, v in want.items()}
    train, test = str(tmp_path / "train"), str(tmp_path / "test")
    sparse.where("row_id <> 2").write.parquet(train)
    sparse.where("row_id = 3").write.parquet(test)
    for asked in (True, False):
        parts = read_and_cast(spark, train=train, test=test, sparse=asked)
        assert all(("entries" in p.columns) == asked for p in parts)
    assert [len(r.features) for p in parts for r in p.collect()] == [5, 5, 5]


def test_words_are_counted_in_bounded_memory():
    """Many texts of one batch: counts as a plain loop gives them, and no object per entry is held."""
    import hashlib
    import tracemalloc

    import pyarrow as pa

    from shardfit.catalog.fixtures import count_words

    texts = [" ".join(f"w{(i * 7 + j) % 900}" for j in range(300)) for i in range(2000)] + [None, "", " \t\n ", "a\u00a0b a"]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(texts))), pa.array([1.0] * len(texts)), pa.array(texts, pa.string())], ["row_id", "y", "text"])
    tracemalloc.start()
    found, ids = [], []
    for part in count_words(1024)(iter([batch])):
        found.append(part.column("entries"))
        ids += part.column("row_id").to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and ids == list(range(len(texts)))
    lists = [x for f in found for x in f.to_pylist()]
    for i in (0, 1, 999, 1999, 2000, 2001, 2002, 2003):
        want = {}
        for word in (texts[i] or "").replace("\t", " ").replace("\n", " ").split(" "):
            if word:
                col = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % 1024
                want[col] = want.get(col, 0.0) + 1.0
        assert lists[i] == [{"col": c, "x": want[c]} for c in sorted(want)]


def test_libsvm_tokens_are_split_once(spark):
    from shardfit.sources.text import parse_libsvm

    lines = spark.createDataFrame([(0, "1 3:2.5 1:0.5 2:0 10:-1"), (1, "# no data"), (2, "-1"), (3, "0.5 7:1e3 7:2")], "row_id long, value string")
    rows = parse_libsvm(lines)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2 and "lambda" in plan and "array_sort" not in plan
    found = {r["row_id"]: (r["y"], [tuple(e) for e in r["entries"]]) for r in rows.collect()}
    assert found == {0: (1.0, [(0, 0.5), (2, 2.5), (9, -1.0)]), 2: (-1.0, []), 3: (0.5, [(6, 2.0), (6, 1000.0)])}


def test_exploded_files_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Cells of the column-wise files meet the responses by a shuffle, however small the files look."""
    import datetime

    from shardfit.catalog import stored as queries

    kinds = ("click", "error", "purchase", "signup", "view")
    events = [(i, datetime.datetime(2024, 1, 1 + i % 9, i % 24), kinds[i % 5], float(i % 13), f'{{"k": {i % 7}}}') for i in range(60)]
    spark.createDataFrame(events, "event_id bigint, ts timestamp, event_type string, value double, props string").write.parquet(
        f"{tmp_path}/events.parquet")
    plans, keep = [], queries.keep

    def told(df):
        out = keep(df)
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return out

    monkeypatch.setattr(queries, "keep", told)
    found = queries.preprocessed_columns(spark, str(tmp_path)).collect()
    assert len(found) == 8 and {r["width"] for r in found} == {8} and len({r["n"] for r in found}) == 1
    cells = plans[0][:plans[0].index("posexplode")].splitlines()
    assert any("SortMergeJoin" in line for line in cells) and not any("BroadcastHashJoin" in line for line in cells)
