"""Line dedup against counts of all lines."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shardfit.llm import line_runs

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string"


def expected(rows):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))

    holders = defaultdict(list)
    for i, text in rows:
        for k in {key(line) for line in (text or "").split("\n")}:
            if len(k) >= 20:
                holders[k].append(-1 if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        own = -1 if i is None else i
        stay = [s for s in lines if len(holders.get(key(s), ())) < 3 or max(holders[key(s)]) == own]
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return out


def made(n):
    rng = random.Random(n)
    pool = [f"  Shared line number {i} of the pool" + " \t\r" * (i % 2) for i in range(30)] + ["short", "", "ÀÉÎÕÜ ÀÉÎÕÜ ÀÉÎÕÜ X", "é" * 19, "É" * 20]
    rows = []
    for i in range(n):
        lines = [rng.choice(pool) if rng.random() < 0.5 else f"line {rng.randrange(3 * n)} of its own kind" for _ in range(rng.randrange(12))]
        lines = [s.upper() if s.isascii() and rng.random() < 0.3 else s for s in lines]
        rows.append((i, "\n".join(["the hot line of every third document"] * (i % 3 == 0) + lines)))
    return rows


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_same_as_counts(spark, batches):
    rows = made(200) + [(7, "the hot line of every third document\nx"), (None, "the hot line of every third document"), (None, None), (500, ""), (501, "\n\n")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", n_lines int, key string").repartition(5)
    got = line_runs.drop_repeated_lines(docs, batches=batches).collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected(rows), key=str)


def test_edges(spark):
    docs = spark.createDataFrame([(i, "w" * 300_000 + "\n" + "same long line of text here") for i in range(4)], SCHEMA)
    assert [r["n_dropped"] for r in line_runs.drop_repeated_lines(docs).orderBy("doc_id").collect()] == [2, 2, 2, 0]
    assert line_runs.drop_repeated_lines(docs.limit(0)).count() == 0


@pytest.mark.parametrize("order", [range(6), range(5, -1, -1), (2, 5, 0, 3, 1, 4)])
def test_runs_in_any_order_of_batches(spark, order):
    rows = made(180)
    lines = line_runs.hashed_lines(spark.createDataFrame(rows, SCHEMA).repartition(2)).cache()
    runs = line_runs.LineRuns(spark, buckets=2)
    for b in order:
        runs.add(lines.where((F.col("key") >= 30 * b) & (F.col("key") < 30 * b + 30)))
    got = {(r["h1"], r["h2"], r["top"]) for r in runs.repeated().collect()}
    want = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("key").alias("top")).where("n >= 3").select("h1", "h2", "top")
    assert got == set(map(tuple, want.collect()))
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("shardfit_run")]


def test_merges_do_not_shuffle_runs(spark):
    lines = line_runs.hashed_lines(spark.createDataFrame(made(60), SCHEMA))
    runs = line_runs.LineRuns(spark)
    names = []
    for half in (F.col("key") < 30, F.col("key") >= 30):
        runs.levels = []
        runs.add(lines.where(half))
        names += runs.levels
    a, b = (spark.table(n) for n in names)
    plan = a.hint("merge").join(b, ["h1", "h2"], "full")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    runs.levels = names
    runs.close()
