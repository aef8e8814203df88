"""Whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

With A the centred rows, the recurrence A v_j = b_(j-1) u_(j-1) + a_j u_j and
A' u_j = a_j v_j + b_j v_(j+1) yields orthonormal u and v and a bidiagonal B = U' A V. The left
vectors are as long as the table, so they are never held: every u_j is A w_j for a vector w_j as
wide as a row, and its products with earlier ones are w_i' (A' u_j). Each step is one pass in
which a task forms its rows' part of A w and adds up its part of A' (A w); both v and u are
reorthogonalised in full, twice, on the driver, which holds vectors of row width alone.

The singular vectors of B give the components, its values the deviations.
"""

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardfit.functions.shared import Shared
from shardfit.llm.common import keep, list_array
from shardfit.llm.vectors import common_width

MIN_TASKS = 4_096   # most tasks of a pass that each send one vector of sums, if there are fewer cores
TASK_BYTES = 16 << 20
SETTLED = 1e-14     # residual of a singular triplet, relative to the largest value
EXACT = 2.0 ** 62


def scaled(df: DataFrame, key: str, vector: str, scale: float = 1024, shift: int = 100_000) -> tuple[DataFrame, int]:
    """`key, x` with x = floor(scale * entry) + shift as whole numbers, and the common width.

    Rows without a vector, with null or non-finite entries, or with an entry whose x is no 64-bit
    number are left out, and so are vectors of another length than the commonest.
    """
    v = F.transform(F.col(vector), lambda c: c.cast("double") * F.lit(float(scale)))
    rows = df.select(F.col(key).alias("key"), v.alias("v"))
    fits = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < EXACT), F.lit(False)))
    rows = rows.where(F.col("v").isNotNull() & fits & (F.size("v") > 0))
    width = common_width(rows, "v")
    x = F.transform("v", lambda c: F.floor(c) + F.lit(shift).cast("long"))
    return rows.where(F.size("v") == width).select("key", x.alias("x")), width


def _whole(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def column_sums(rows: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of every dimension."""
    def run(batches):
        n, sums = 0, np.zeros(width, object)
        for batch in batches:
            x = _whole(batch, width)
            n += len(x)
            safe = np.abs(x).max(initial=0) < EXACT / max(len(x), 1)
            sums += (x if safe else x.astype(object)).sum(axis=0)
        for i, v in enumerate([n, *sums]):
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int32()), pa.array([Decimal(int(v))], pa.decimal128(38, 0))], ["i", "v"])

    found = _few(rows).mapInArrow(run, "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v").alias("v")).collect()
    by = {r["i"]: int(r["v"]) for r in found}
    return by.get(0, 0), [by.get(i + 1, 0) for i in range(width)]


def _few(rows: DataFrame) -> DataFrame:
    """At most `MIN_TASKS` tasks or two a core, so that their sums may meet on the driver."""
    return rows.coalesce(max(MIN_TASKS, 2 * rows.sparkSession.sparkContext.defaultParallelism))


def _add(rows: DataFrame, width: int, mean: np.ndarray, compute, size: int) -> np.ndarray:
    """Sum over all rows of `compute(centred block)`, a vector of the given size."""
    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            total += compute(_whole(batch, width) - mean)
        yield pa.RecordBatch.from_arrays([list_array(total, [size])], ["sums"])

    parts = _few(rows).mapInArrow(run, "sums array<double>").toArrow()["sums"].combine_chunks()
    return parts.flatten().to_numpy().reshape(-1, size).sum(axis=0)


def _orthogonal(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for b in basis:
            v = v - (b @ v) * b
    return v


@dataclass
class Spectrum:
    """Unit components by falling singular value of the centred rows, and what went into them."""

    n: int
    sums: list[int]
    components: np.ndarray   # width x k
    values: np.ndarray       # singular values
    energy: float            # sum of squares of all centred entries
    steps: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])  # Python divides whole numbers exactly rounded

    @property
    def deviations(self) -> np.ndarray:
        return self.values / np.sqrt(self.n)


def bidiagonalise(rows: DataFrame, width: int, n_components: int, seed: int = 1) -> Spectrum:
    """The leading singular values and right vectors of the centred rows of `scaled`.

    A step is one pass. The passes end when the wanted values have settled and what is left of
    the sum of squares could not hold another one as large, or after `width` of them. Where the
    recurrence breaks down (few or repeated rows, equal values), it goes on with a new direction.
    Values below 1e-12 of the largest count as zero and are left out.
    """
    n, sums = column_sums(rows, width)
    empty = Spectrum(n, sums, np.zeros((width, 0)), np.zeros(0), 0.0, 0)
    if n == 0:
        return empty
    mean = empty.mean
    energy = float(_add(rows, width, mean, lambda a: np.array([np.einsum("ij,ij->", a, a)]), 1)[0])
    if energy == 0.0:
        return empty
    rng = np.random.default_rng(seed)
    floor = np.sqrt(energy) * 1e-13
    V, W, Z, alpha, beta = [], [], [], [], []

    def direction():
        while True:  # a random vector is in the span of fewer than `width` others with probability 0
            v = _orthogonal(rng.standard_normal(width), V)
            if np.linalg.norm(v) > 1e-6:
                return v / np.linalg.norm(v)

    v = direction()
    while True:
        w = v - beta[-1] * W[-1] if V else v
        V.append(v)
        # one pass: the tasks form t = A w and add up A' t
        z = _add(rows, width, mean, lambda a, w=w: (a @ w) @ a, width)
        for _ in range(2):  # products u_i' A w are w_i' A' A w
            for wi, zi in zip(W, Z):
                g = wi @ z
                w, z = w - g * wi, z - g * zi
        a = np.sqrt(max(w @ z, 0.0))
        if a <= floor:
            w, z, a, r = np.zeros(width), np.zeros(width), 0.0, np.zeros(width)
        else:
            w, z = w / a, z / a
            r = _orthogonal(z - a * v, V)
        b = np.linalg.norm(r)
        alpha.append(a)
        W.append(w)
        Z.append(z)
        left, values, right = np.linalg.svd(np.diag(alpha) + np.diag(beta, 1))
        top = values[:n_components]
        rest = max(energy - sum(x * x for x in alpha) - sum(x * x for x in beta), 0.0)
        settled = len(values) >= n_components and np.all(b * np.abs(left[-1, :len(top)]) <= SETTLED * values[0])
        if len(V) == width or (settled and rest < top[-1] ** 2) or rest <= 1e-14 * energy and b <= floor:
            break
        if b <= floor:
            b, v = 0.0, direction()
        else:
            v = r / b
        beta.append(b)
    good = top > 1e-12 * values[0]
    components = np.column_stack(V) @ right[:len(top)].T
    return Spectrum(n, sums, components[:, good], top[good], energy, len(V))


def whiten(df: DataFrame, n_components: int = 8, key: str = "vec_id", vector: str = "embedding",
           scale: float = 1024, shift: int = 100_000) -> DataFrame:
    """Rows projected on the leading components of all rows, each with unit variance.

    Columns: key, component (from 1), n, deviation, whitened, explained, identity_error; a row of
    `df` gives one per component. x, of which all is computed, is described at `scaled`.
    `deviation` is the sum over dimensions of (n x - S)^2, exactly, or null beyond 64 bits.
    `explained` is the component's share of the total variance, `identity_error` the largest
    entry of the covariance of `whitened` minus the identity.

    Rows with null keys and repeated rows count like any other. Components without variance are
    left out: fewer rows or dimensions than components give fewer; equal rows, a single row or an
    empty table give no row at all. Components of equal variance are any orthonormal choice.
    Other columns are not read. Rows are cut into Arrow batches; wide vectors make smaller ones.
    """
    spark = df.sparkSession
    rows, width = scaled(df, key, vector, scale, shift)
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = keep(rows)
    rows = rows.coalesce(1 + rows.count() * width * 8 // TASK_BYTES)
    found = bidiagonalise(rows, width, n_components)
    k = found.components.shape[1]
    if k == 0:
        return spark.createDataFrame([], schema).withColumnRenamed("key", key)
    mean, to = found.mean, found.components / found.deviations
    n, sums = found.n, np.array(found.sums, object)
    moments = _add(rows, width, mean, lambda a: np.concatenate([(a @ to).sum(axis=0), ((a @ to).T @ (a @ to)).ravel()]), k + k * k)
    first, second = moments[:k] / n, moments[k:].reshape(k, k) / n
    error = float(np.abs(second - np.outer(first, first) - np.eye(k)).max())
    explained = found.values ** 2 / found.energy
    shared = Shared(spark, (mean, to, explained, n, sums))

    def run(batches):
        mean, to, explained, n, sums = shared.value
        for batch in batches:
            x = _whole(batch, width)
            m = len(x)
            z = (x - mean) @ to
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(np.repeat(np.arange(m), k))),
                 pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                 _deviations(x, n, sums).take(pa.array(np.repeat(np.arange(m), k))), pa.array(z.ravel()),
                 pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Sum over dimensions of (n x - S)^2 as exact whole numbers; null beyond 64 bits."""
    most = max(n * int(np.abs(x).max(initial=0)), max(abs(int(s)) for s in sums))
    if most < EXACT and x.shape[1] * (2 * most) ** 2 < EXACT:
        return pa.array(((n * x - sums.astype(np.int64)) ** 2).sum(axis=1))
    if most < EXACT:  # the differences fit; only their squares may not
        d = n * x - sums.astype(np.int64)
        if x.shape[1] * int(np.abs(d).max(initial=0)) ** 2 < EXACT:
            return pa.array((d * d).sum(axis=1))
    d = n * x.astype(object) - sums
    exact = (d * d).sum(axis=1)
    return pa.array([int(v) if v < 1 << 63 else None for v in exact], pa.int64())
