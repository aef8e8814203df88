"""Near-duplicate vectors: random-hyperplane tables, exact cosine, connected components.

In each table a vector is known by the sides of BITS random planes on which it lies. Two
vectors at cosine 0.98 share a table's code with probability 0.157, so 64 tables miss such a
pair once in 50 000; closer pairs are missed less. Pairs that share a code and a label are
compared exactly. A pair counts in the first table that it shares, so links are counted once
although no pair leaves its task: tasks emit, per vector, its number of links and the
smallest vector of its connected part, and components are joined over those.

Equal vectors are one vector with a count. Codes with many vectors are cut into chunks of
about CHUNK by a hash, and every pair of chunks is a group of its own, so groups are bounded
whatever the skew; the number of exact comparisons among alike vectors is that of the links.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardfit.llm.common import keep
from shardfit.llm.components import components
from shardfit.llm.vectors import by_width, matrix, unit, usable

TABLES, BITS = 64, 28
CHUNK = 512
PAIRS = 1 << 16  # pairs whose codes are compared at once, 32 MB


def coded(rows: DataFrame, seed: int = 3) -> DataFrame:
    """Rows of `key, label, vector` with a row number and the codes of all tables (null if unusable).

    Every length of vectors has planes of its own.
    """

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        weights = (1 << np.arange(BITS)).astype(np.int64)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            fit = np.flatnonzero(batch.column("fit").to_numpy(zero_copy_only=False))
            codes = np.zeros((batch.num_rows, TABLES), np.int32)
            for width, at, x in by_width(batch.column("vector").take(pa.array(fit))):
                if width not in planes:
                    planes[width] = np.random.default_rng(seed).normal(size=(width, TABLES * BITS))
                codes[fit[at]] = (x @ planes[width] >= 0).reshape(-1, TABLES, BITS) @ weights
            lists = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, TABLES, dtype=np.int32), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + batch.num_rows))] + [batch.column(c) for c in ("key", "label", "vector", "fit")]
                + [lists], ["row", "key", "label", "vector", "fit", "codes"])
            row += batch.num_rows

    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("key", "label", "vector"))
    return rows.mapInArrow(run, f"row long, {fields}, fit boolean, codes array<int>")


def _local(x: np.ndarray, codes: np.ndarray, table: int, counts: np.ndarray, near: np.ndarray,
           first: np.ndarray, threshold: float):
    """Links of one group: number per vector, and the smallest row of its connected part.

    `first` tells the chunks apart: in a group of two chunks only pairs across count.
    """
    alike = unit(x) @ unit(x).T >= threshold
    np.fill_diagonal(alike, False)
    new = alike.copy()
    if first.min() != first.max():
        new &= first[:, None] != first[None, :]
    if table:  # a pair belongs to the first table it shares
        left, right = np.nonzero(np.triu(new))
        for low in range(0, len(left), PAIRS):
            a, b = left[low:low + PAIRS], right[low:low + PAIRS]
            before = (codes[a, :table] == codes[b, :table]).any(axis=1)
            new[a[before], b[before]] = new[b[before], a[before]] = False
    low = near.copy()
    while True:
        lower = np.minimum(low, np.where(alike, low[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (lower == low).all():
            return new @ counts, low
        low = lower


def _groups(rows: DataFrame, threshold: float) -> DataFrame:
    """`row, links, low` out of rows sorted by group; groups are bounded, so one is held at a time."""

    def flush(table: pa.Table):
        at = lambda c: table.column(c).combine_chunks()
        bucket, i, j = (at(c).to_numpy() for c in ("bucket", "i", "j"))
        cuts = np.flatnonzero((bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        vectors, codes = at("vector"), at("codes").flatten().to_numpy().reshape(-1, TABLES)
        row, n, chunk, number = (at(c).to_numpy() for c in ("row", "n", "chunk", "number"))
        out = [(row[a:b], *_local(matrix(vectors.slice(a, b - a), len(vectors[a])), codes[a:b], int(number[a]), n[a:b], row[a:b], chunk[a:b], threshold))
               for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(row)]) if b - a > 1]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["row", "links", "low"])

    def run(batches):
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            last = [held.column(c)[-1].as_py() for c in ("bucket", "i", "j")]
            same = np.ones(held.num_rows, bool)
            for c, value in zip(("bucket", "i", "j"), last):
                same &= held.column(c).to_numpy() == value
            cut = int(np.argmax(same))  # the last group may go on in the next batch
            if cut:
                yield from flush(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None:
            yield from flush(held)

    return rows.mapInArrow(run, "row long, links long, low long")


def link(vectors: DataFrame, threshold: float = 0.98, key="vec_id", vector="embedding", label="label") -> DataFrame:
    """`key, n_links, component_id, kept` of every row.

    Vectors that are null, zero, or hold null or non-finite components link with nothing, neither
    do rows without label; they are their own component. Only vectors of equal length link. Rows
    with equal keys are vectors of their own. An empty table gives an empty result. Other columns
    are not read.
    """
    rows = vectors.select(F.col(key).cast("bigint").alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    rows = rows.withColumn("fit", usable("vector") & F.col("label").isNotNull())
    rows = keep(coded(rows).withColumn("print", F.when(F.col("fit"), F.struct(
        "label", F.xxhash64("vector").alias("x"), F.hash("vector").alias("y")))))
    best = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row", "vector", "codes"))
    single = keep(rows.where("fit").groupBy("print").agg(best.alias("m"), F.count("*").alias("n")).select(
        "print", "n", F.size("m.vector").alias("width"), F.col("m.key").alias("key"), F.col("m.row").alias("row"), F.col("m.vector").alias("vector"),
        F.col("m.codes").alias("codes")))
    placed = single.select("row", "width", F.col("print.label").alias("label"), F.posexplode("codes").alias("number", "code")).select(
        "row", "number", F.xxhash64("label", "width", "number", "code").alias("bucket"))
    full = placed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    met = placed.join(full.hint("merge"), "bucket")
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    met = met.withColumn("chunk", F.pmod(F.xxhash64("row"), chunks).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    met = met.select("row", "bucket", "number", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    loaded = met.join(single.select("row", "n", "vector", "codes").hint("merge"), "row")
    grouped = loaded.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    parts = keep(_groups(grouped, threshold).groupBy("row", "low").agg(F.sum("links").alias("links")))
    counts = parts.groupBy("row").agg(F.sum("links").alias("links"))
    roots = components(parts.select(F.col("row").alias("a"), F.col("low").alias("b"))).withColumnRenamed("node", "row")
    named = single.join(counts, "row", "left").join(roots, "row", "left").select(
        "print", "n", "key", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "row").alias("component"))
    heads = named.groupBy("component").agg(F.min("key").alias("head"))
    named = named.join(heads, "component").select("print", (F.col("links") + F.col("n") - 1).alias("n_links"), "head")
    out = rows.select("key", "print").join(named.hint("merge"), "print", "left").select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("head", "key").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
