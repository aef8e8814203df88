"""Cosine links and one-bit codes against brute force."""

import numpy as np
import pytest

from shardfit.llm import cosine_links, onebit

NAN = float("nan")


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(8)
    x = draw.normal(size=(400, 16)).astype(np.float32)
    x[50:90] = x[0] + 0.02 * draw.normal(size=(40, 16))  # a group of near copies
    x[100:110] = x[1] + 0.09 * draw.normal(size=(10, 16))
    x[120:125] = 3 * x[2]                                # equal directions
    x[130:134] = x[3]                                    # exact copies
    out = [(i, v.tolist(), i % 3 if i not in range(50, 135) else 0, 1) for i, v in enumerate(x)]
    return out + [(400, None, 0, 1), (401, [0.0] * 16, 0, 1), (402, [NAN] + [1.0] * 15, 0, 1), (403, [None] + [1.0] * 15, 0, 1),
                  (404, [float("inf")] * 16, 0, 1), (405, x[0].tolist(), None, 1), (406, [1.0], 0, 1), (450, x[0].tolist(), 0, 1)]


def valid(rows):
    ok = [r for r in rows if r[1] is not None and len(r[1]) == 16 and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    x = np.array([r[1] for r in ok], np.float64)
    return ok, x / np.linalg.norm(x, axis=1)[:, None]


SCHEMA = "vec_id long, embedding array<float>, label int, n_links int"


@pytest.mark.parametrize("chunk", [512, 16])
def test_links(spark, rows, chunk, monkeypatch):
    monkeypatch.setattr(cosine_links, "CHUNK", chunk)
    got = {r["vec_id"]: r for r in cosine_links.link(spark.createDataFrame(rows, SCHEMA)).collect()}
    ok, x = valid(rows)
    label = [r[2] for r in ok]
    alike = x @ x.T >= 0.98
    alike &= np.array([[a is not None and a == b for b in label] for a in label])
    np.fill_diagonal(alike, False)
    low = np.array([r[0] for r in ok])
    for _ in range(len(ok)):
        low = np.minimum(low, np.where(alike, low, 10**9).min(axis=1))
    want = {r[0]: (0, r[0]) for r in rows} | {r[0]: (int(n), int(c)) for r, n, c in zip(ok, alike.sum(axis=1), low)}
    assert {k: (r["n_links"], r["component_id"]) for k, r in got.items()} == want
    assert all(r["kept"] == (k == r["component_id"]) for k, r in got.items()) and max(w[0] for w in want.values()) > 30


def test_links_at_the_threshold(spark):
    """64 dimensions, as the tables have: pairs planted just above and below 0.98 among strangers."""
    draw = np.random.default_rng(2)
    x = draw.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    cosines = np.r_[np.full(300, 0.9801), np.linspace(0.981, 0.999, 200), np.full(300, 0.9799)]
    for i, c in enumerate(cosines):
        side = draw.normal(size=64)
        side -= side @ x[2 * i] * x[2 * i]
        x[2 * i + 1] = c * x[2 * i] + np.sqrt(1 - c * c) * side / np.linalg.norm(side)
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in cosine_links.link(table).collect()}
    alike = x @ x.T >= 0.98
    np.fill_diagonal(alike, False)
    want = {i: (int(n), min([i, *np.flatnonzero(row)])) for i, (n, row) in enumerate(zip(alike.sum(axis=1), alike))}
    assert got == want and sum(n for n, _ in want.values()) == 1000


def test_vectors_of_other_lengths_link(spark):
    rows = [(i, [1.0, 2.0, 3.0], 0, 0) for i in range(5)] + [(10, [1.0, 0.0], 0, 0), (11, [2.0, 0.01], 0, 0), (12, [1.0], 0, 0),
            (13, [1.0, 0.0], 1, 0), (14, [0.0, 1.0], 0, 0), (15, [], 0, 0)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in cosine_links.link(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: (4, 0) for i in range(5)} | {10: (1, 10), 11: (1, 10), 12: (0, 12), 13: (0, 13), 14: (0, 14), 15: (0, 15)}


def test_link_edges(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0], 0, 1)] * 2 + [(None, [1.0, 2.0], 0, 1)], SCHEMA)
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in cosine_links.link(table).collect())
    assert got == [("1", 2, 1), ("1", 2, 1), ("None", 2, 1)]
    assert cosine_links.link(table.limit(0)).count() == 0


@pytest.mark.parametrize("block", [4096, 3])
def test_search(spark, rows, block):
    table = spark.createDataFrame(rows, SCHEMA)
    codes = onebit.index(table, 16, "vec_id", "embedding")
    asked = codes.where("key % 50 = 0").select("key", "vector")
    got = onebit.nearest(codes, asked, 16, block=block).collect()
    ok, x = valid(rows)
    found = total = 0
    for i, r in enumerate(ok):
        if r[0] % 50:
            continue
        score = x @ x[i]
        best = sorted((-s, o[0]) for s, o in zip(score, ok) if o[0] != r[0])[:5]
        mine = sorted((m["rank"], m["vec_id"], m["score"]) for m in got if m["query_id"] == r[0])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        assert all(abs(m[2] - score[[o[0] for o in ok].index(m[1])]) < 1e-9 for m in mine)
        found += len({m[1] for m in mine} & {b[1] for b in best})
        total += 5
    assert total > 30 and found >= 0.99 * total


def test_search_edges(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA)
    few = onebit.search(table.where("vec_id in (0, 7, 404)"), table.vec_id % 50 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in few] == [(0, 1, 7)]
    twice = table.where("vec_id in (0, 130)").unionByName(table.where("vec_id in (131, 131)"))
    ties = onebit.search(twice, twice.vec_id == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in ties] == [130, 131]
    assert onebit.search(table.limit(0), table.vec_id == 0).count() == 0


def test_search_at_many_dimensions_and_lengths(spark):
    """Recall at 64 dimensions; vectors of another length are searched among themselves."""
    draw = np.random.default_rng(6)
    x = draw.normal(size=(2000, 64)) + 2 * draw.normal(size=(20, 64))[np.arange(2000) % 20]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3000 + i, [1.0, float(i)]) for i in range(0, 60, 10)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in onebit.search(table, table.vec_id % 50 == 0).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    x /= np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    for i in range(0, 2000, 50):
        score = x @ x[i]
        score[i] = -2
        hits += len(set(np.argsort(-score)[:5]) & set(got[i]))
    assert hits >= 0.99 * 5 * 40
    assert got[3000] == [3010, 3020, 3030, 3040, 3050] and got[3050] == [3040, 3030, 3020, 3010, 3000]


def test_bounds_hold():
    draw = np.random.default_rng(1)
    turn = onebit.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    x = draw.normal(size=(500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    turned = x @ turn
    bits = turned.shape[1]
    scale = np.abs(turned).sum(axis=1) / np.sqrt(bits)
    estimate = turned @ np.where(turned >= 0, 1, -1).T / (np.sqrt(bits) * scale)
    error = onebit.SIGMAS * np.sqrt(1 - scale ** 2) / (scale * np.sqrt(bits - 1))
    assert (np.abs(estimate - x @ x.T) <= error).mean() > 0.999
