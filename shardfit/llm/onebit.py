"""Nearest neighbours by randomly rotated one-bit codes with error bounds.

A vector of length one is rotated at random into BITS_PER_DIMENSION times its dimensions;
its code is the packed signs, with one correction scalar, the inner product of the rotated
vector and its code. The code gives an unbiased estimate of the inner product with a query
and a bound of its error. Only vectors whose upper bound reaches a query's k-th lower bound
are compared exactly, in double precision.

Every row is indexed. Queries are sent out in blocks of bounded size; each block is one pass
over the codes, in which a task keeps k candidates per query. The table of the tasks' results
is ranked with a partial limit before its shuffle.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardfit.functions.shared import Shared, to_driver
from shardfit.llm.common import keep
from shardfit.llm.vectors import matrix, unit, usable

BITS_PER_DIMENSION = 4
SIGMAS = 4.0       # width of the error bound in standard deviations
BLOCK = 4_096      # queries sent out at once
ROWS = 2_048       # vectors estimated at once


def rotation(width: int, seed: int = 5) -> np.ndarray:
    """width x bits matrix with orthonormal rows: lengths and angles stay."""
    bits = -(-width * BITS_PER_DIMENSION // 8) * 8
    draw = np.random.default_rng(seed).normal(size=(bits, max(width, 1)))
    return np.linalg.qr(draw)[0].T[:width]


def index(vectors: DataFrame, width: int, key="vec_id", vector="embedding", seed: int = 5) -> DataFrame:
    """`key, vector, code, scale` of every usable row, written once to the shared folder."""
    rows = vectors.where(usable(vector, width)).select(F.col(key).cast("bigint").alias("key"), F.col(vector).alias("vector"))
    kind = rows.schema["vector"].dataType.simpleString()

    def run(batches):
        turn = rotation(width, seed)
        for batch in batches:
            turned = unit(matrix(batch.column("vector"), width)) @ turn
            scale = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
            code = [c.tobytes() for c in np.packbits(turned >= 0, axis=1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("vector"), pa.array(code, pa.binary()), pa.array(scale)],
                ["key", "vector", "code", "scale"])

    return keep(rows.where("key is not null").mapInArrow(run, f"key long, vector {kind}, code binary, scale double"))


class _Best:
    """The k nearest of each query so far, nearest first, ties to the smaller key."""

    def __init__(self, n_queries: int, k: int):
        self.score = np.full((n_queries, k), -np.inf)
        self.key = np.full((n_queries, k), np.iinfo(np.int64).max)

    def add(self, query: np.ndarray, key: np.ndarray, score: np.ndarray) -> None:
        k = self.score.shape[1]
        touched = np.unique(query)
        q = np.concatenate([np.repeat(touched, k), query])
        key = np.concatenate([self.key[touched].ravel(), key])
        score = np.concatenate([self.score[touched].ravel(), score])
        order = np.lexsort((key, -score, q))
        q, key, score = q[order], key[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = rank < k
        self.key[q[top], rank[top]], self.score[q[top], rank[top]] = key[top], score[top]


def _scan(codes: pa.RecordBatch, keys: np.ndarray, queries: np.ndarray, turned: np.ndarray, best: _Best) -> None:
    """Estimate all pairs of a batch and a query block; compare exactly where the bound allows."""
    width, k = queries.shape[1], best.score.shape[1]
    x, key = unit(matrix(codes.column("vector"), width)), codes.column("key").to_numpy()
    packed = np.frombuffer(b"".join(codes.column("code").to_pylist()), np.uint8).reshape(len(key), -1)
    scale = codes.column("scale").to_numpy()
    bits = turned.shape[1]
    signs = np.unpackbits(packed, axis=1).astype(np.float32) * 2 - 1
    estimate = (turned @ signs.T).astype(np.float64) / (np.sqrt(bits) * scale)
    error = SIGMAS * np.sqrt(np.maximum(0, 1 - scale ** 2)) / (scale * np.sqrt(max(bits - 1, 1))) + 1e-5
    own = keys[:, None] == key[None, :]
    lower = np.where(own, -np.inf, estimate - error)
    floor = best.score[:, -1]
    if len(key) >= k:
        floor = np.maximum(floor, np.partition(lower, len(key) - k, axis=1)[:, len(key) - k])
    q, c = np.nonzero((estimate + error >= floor[:, None]) & ~own)
    for start in range(0, len(q), 1 << 18):
        a, b = q[start:start + (1 << 18)], c[start:start + (1 << 18)]
        best.add(a, key[b], np.clip(np.einsum("ij,ij->i", queries[a], x[b]), -1.0, 1.0))


def nearest(codes: DataFrame, queries: DataFrame, width: int, k: int = 5, block: int = BLOCK, seed: int = 5) -> DataFrame:
    """`query_id, rank, vec_id, score`: the k nearest indexed rows of each row of `queries` (`key, vector`).

    Rows with the query's own key are left out; ties go to the smaller key. Repeated keys among
    the queries are searched once, with the first of their vectors.
    """
    spark, out = codes.sparkSession, None
    single = keep(queries.groupBy("key").agg(F.min("vector").alias("vector")))
    n_blocks = max(1, -(-single.count() // block))
    for b in range(n_blocks):
        part = to_driver(single.where(F.pmod(F.xxhash64("key"), F.lit(n_blocks)) == b)).sort_values("key")
        raw = np.array(part["vector"].tolist(), np.float64).reshape(len(part), width)
        exact = unit(raw) if len(part) else raw
        sent = Shared(spark, (part["key"].to_numpy(np.int64), exact, (exact @ rotation(width, seed)).astype(np.float32)))

        def run(batches, sent=sent):
            keys, exact, turned = sent.value
            best = _Best(len(keys), k)
            for batch in batches:
                for start in range(0, batch.num_rows if len(keys) else 0, ROWS):
                    _scan(batch.slice(start, ROWS), keys, exact, turned, best)
            q, rank = np.nonzero(np.isfinite(best.score))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[q], pa.int64()), pa.array(best.key[q, rank], pa.int64()), pa.array(best.score[q, rank])],
                ["query_id", "vec_id", "score"])

        found = codes.mapInArrow(run, "query_id long, vec_id long, score double")
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    ranked = out.withColumn("rank", rank)
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search(vectors: DataFrame, is_query, k: int = 5, key="vec_id", vector="embedding") -> DataFrame:
    """The k nearest other rows of every row that `is_query` selects.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
    without key. A query's candidates are the vectors of its length; every length that is there is
    searched by itself. Repeated rows are candidates of their own. An empty table gives no row.
    """
    widths = vectors.where(usable(vector)).select(F.size(vector).alias("n")).distinct().orderBy("n")
    out = None
    for width in [r["n"] for r in widths.collect()] or [0]:
        codes = index(vectors, width, key, vector)
        queries = vectors.where(is_query).select(F.col(key).alias(key)).distinct()
        asked = codes.join(queries.withColumnRenamed(key, "key"), "key", "left_semi").select("key", "vector")
        found = nearest(codes, asked, width, k)
        out = found if out is None else out.unionByName(found)
    return out
