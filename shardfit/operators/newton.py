"""Hinge and logistic fits of many blocks, folds and penalties in shared passes.

One pass over the rows gives loss, gradient and curvature sums of every open
problem; a step per problem is solved where its sums meet, and only weights
return to the driver. Each pass also yields feasible dual values, so every fit
carries its duality gap and stops on it.

The hinge is followed along (s + sqrt(s^2 + 4 d^2)) / 2 with s = 1 - margin and a
width d that shrinks once a fit is centred, each time with a step towards the
optimum of the next width. The gap is that of the hinge itself.
"""

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardfit.functions import sizes
from shardfit.functions.shared import Shared, from_driver, to_driver
from shardfit.operators import wide
from shardfit.operators.design import (
    BlockLayout, DesignFeed, RowsFeed, design_widths, feed_rows,
)
from shardfit.operators.gram import BATCH, TASK_VALUES, in_groups, task_limit, upper_triangle
from shardfit.operators.ridge import WEIGHTS, check_lambdas

# fixed values: step lengths that a pass tries along the last direction, besides 1
STEPS = np.concatenate([[0.0], 2.0 ** -np.arange(1, 25), [0.75, 0.9, 0.97]])
# fixed values: step lengths at which a pass also takes gradient and curvature
LENGTHS = {"hinge": (1.0, 0.3), "logistic": (1.0,)}
# duality gaps at which a fit stops unless told otherwise
STOPPING_GAPS = {"hinge": 1e-6, "logistic": 1e-12}
SCALARS, SLOPES = -3, (-2, -1)  # row index of the sums that are not curvature
N, SMOOTH, LOSS, CONJUGATE, TRIALS = 0, 1, 2, 3, 4
DRIVER_VALUES = 1_000_000       # sums that the driver takes itself; more are solved by tasks
FIRST_WIDTH, LAST_WIDTH, SHRINK = 2.0, 1e-9, 0.2


@dataclass
class Problem:
    """One fit: a block, a penalty, and the fold that is left out (0 for none)."""

    block: int
    fold: int
    lam: float
    w: np.ndarray
    step: np.ndarray
    width: float = FIRST_WIDTH
    gap: float = field(default=np.inf)
    passes: int = 0
    done: bool = False


def _hinge(margin, width):
    """Value, dual value, curvature, and change of the dual value with the width."""
    s = 1.0 - margin
    root = np.sqrt(s * s + 4 * width * width)
    bend = 2 * width / root ** 3
    return 0.5 * (s + root), 0.5 * (1 + s / root), width * bend, -s * bend


def _logistic(margin, width):
    value = np.logaddexp(0.0, -margin)
    t = np.exp(-np.logaddexp(0.0, margin))  # 1 / (1 + exp(margin)) without overflow
    return value, t, t * (1 - t), None


def _value(loss, margin, width):
    if loss == "hinge":
        s = 1.0 - margin
        return 0.5 * (s + np.sqrt(s * s + 4 * width * width))
    return np.logaddexp(0.0, -margin)


def _entropy(t):
    inside = np.clip(t, 1e-300, 1.0)
    rest = np.clip(1 - t, 1e-300, 1.0)
    return t * np.log(inside) + (1 - t) * np.log(rest)


def _partials(feed, open_problems, loss):
    smooth = _hinge if loss == "hinge" else _logistic

    def run(batches):
        problems = open_problems.value
        by_block = {}
        for pid, p in problems.items():
            by_block.setdefault(p.block, []).append(pid)
        found = {}
        for batch in batches:
            for block, z, y, fold in feed(batch):
                ids = by_block.get(block, ())
                if not ids:
                    continue
                # margins at the accepted weights and along the direction, for all problems
                both = z @ np.column_stack([problems[i].w for i in ids]
                                           + [problems[i].step for i in ids])
                both *= y[:, None]
                for at, pid in enumerate(ids):
                    p = problems[pid]
                    train = fold != p.fold if p.fold else slice(None)
                    zt, yt = z[train], y[train]
                    base, along = both[train, at], both[train, len(ids) + at]
                    moves = bool(p.step.any())
                    for c, length in enumerate(LENGTHS[loss] if moves else (1.0,)):
                        margin = base + length * along
                        value, t, curve, drift = smooth(margin, p.width)
                        if loss == "hinge":
                            true, conjugate = np.maximum(1 - margin, 0.0).sum(), -t.sum()
                        else:
                            true, conjugate = value.sum(), _entropy(t).sum()
                        sums = [len(yt), value.sum(), true, conjugate]
                        if c == 0:
                            ends = base[:, None] + along[:, None] * STEPS if moves else base[:, None]
                            sums += list(_value(loss, ends, p.width).sum(axis=0)
                                         + np.zeros(len(STEPS)))
                        slopes = [(t * yt) @ zt]
                        if drift is not None:
                            slopes.append((drift * yt) @ zt)
                        part = (np.array(sums), np.array(slopes),
                                (zt * curve[:, None]).T @ zt)
                        if (pid, c) in found:
                            for total, more in zip(found[pid, c], part):
                                total += more
                        else:
                            found[pid, c] = part
        for (pid, c), (sums, slopes, curvature) in found.items():
            i, j, v = upper_triangle(curvature, 0)
            i = np.concatenate([np.full(len(sums), SCALARS),
                                *[np.full(len(g), SLOPES[k]) for k, g in enumerate(slopes)], i])
            j = np.concatenate([np.arange(len(sums)), *[np.arange(len(g)) for g in slopes], j])
            v = np.concatenate([sums, *slopes, v])
            for low in range(0, len(v), BATCH):
                s = slice(low, low + BATCH)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(v[s]), pid, np.int32)),
                     pa.array(np.full(len(v[s]), c, np.int32)),
                     pa.array(i[s].astype(np.int32)), pa.array(j[s].astype(np.int32)),
                     pa.array(v[s])],
                    ["problem", "c", "i", "j", "v"],
                )
    return run


def _advance(open_problems, loss, stopping_gap):
    """One step of one problem from its sums."""

    def run(pdf):
        pid = int(pdf["problem"].iat[0])
        p = (open_problems.value if isinstance(open_problems, Shared) else open_problems)[pid]
        c, i, j, v = (pdf[name].to_numpy() for name in ("c", "i", "j", "v"))
        m = len(p.w)
        sums = np.zeros((c.max() + 1, TRIALS + len(STEPS)))
        at = i == SCALARS
        sums[c[at], j[at]] = v[at]
        n, lam = sums[0, N], p.lam

        def objective(length, total):
            w = p.w + length * p.step
            return total / n + 0.5 * lam * w @ w

        tried = np.array([objective(s, t) for s, t in zip(STEPS, sums[0, TRIALS:])])
        reached = [objective(s, t) for s, t in zip(LENGTHS[loss], sums[:, SMOOTH])]
        best = int(np.argmin(reached))
        here, least = reached[best], tried.min()

        slope, drift = np.zeros(m), np.zeros(m)
        for index, vector in zip(SLOPES, (slope, drift)):
            at = (i == index) & (c == best)
            vector[j[at]] = v[at]
        curve = np.zeros((m, m))
        at = (i >= 0) & (c == best)
        curve[i[at], j[at]] = v[at]
        curve[j[at], i[at]] = v[at]

        w = p.w + LENGTHS[loss][best] * p.step
        dual_w = slope / (n * lam)
        gap = (sums[best, LOSS] / n + 0.5 * lam * w @ w
               + 0.5 * lam * dual_w @ dual_w + sums[best, CONJUGATE] / n)
        gradient = lam * w - slope / n
        step, width, done = np.zeros(m), p.width, gap <= stopping_gap
        rounding = 1e-14 * max(1.0, abs(here))
        if done or here <= least + rounding or (best and here - least < 0.3 * (tried[0] - least)):
            system = curve / n + lam * np.eye(m)
            step = -np.linalg.solve(system, gradient)
            gain = -gradient @ step
            # rounding leaves nothing to win: keep the point, its gap is reported
            settled = gain <= 1e-16 * max(1.0, abs(here))
            if loss == "hinge":
                if gain <= (sums[best, SMOOTH] - sums[best, LOSS]) / n:
                    # centred for this width: aim at the optimum of a smaller one
                    width = max(SHRINK * p.width, LAST_WIDTH)
                    step = -np.linalg.solve(system, gradient - (width - p.width) * drift / n)
                settled = settled and p.width <= LAST_WIDTH
            elif gain < 1e-8 and (done or settled):
                w = w + step  # the last step squares the remaining error
            done = done or settled
        else:
            w = p.w + STEPS[int(np.argmin(tried))] * p.step
        return pd.DataFrame({
            "problem": [pid], "w": [w], "step": [step], "width": [width],
            "gap": [gap], "done": [bool(done)],
        })

    return run


STATE = ("problem int, w array<double>, step array<double>, width double, "
         "gap double, done boolean")


def _run(source: DataFrame, feed, widths, problems: list[Problem], loss, max_iter,
         stopping_gap) -> list[Problem]:
    spark = source.sparkSession
    for _ in range(max_iter):
        left = {k: p for k, p in enumerate(problems) if not p.done}
        if not left:
            break
        state = Shared(spark, left)
        parts, sent = None, [state]
        counts = {k: len(LENGTHS[loss]) * widths[p.block] ** 2 for k, p in left.items()}
        for group in in_groups(counts, TASK_VALUES):
            chosen = state
            if len(group) < len(left):
                chosen = Shared(spark, {k: left[k] for k in group})
                sent.append(chosen)
            blocks = sorted({left[k].block for k in group})
            tasks = task_limit(spark, sum(counts[k] for k in group) // 2)
            part = source.coalesce(tasks).mapInArrow(
                _partials(feed.only(blocks), chosen, loss), "problem int, c int, i int, j int, v double"
            )
            parts = part if parts is None else parts.unionByName(part)
        sums = parts.groupBy("problem", "c", "i", "j").agg(F.sum("v").alias("v"))
        if sum(counts.values()) <= DRIVER_VALUES:
            advance = _advance(left, loss, stopping_gap)
            groups = to_driver(sums).groupby("problem")
            moved = pd.concat([advance(g) for _, g in groups]) if len(groups) else pd.DataFrame()
        else:
            advance = _advance(state, loss, stopping_gap)
            moved = to_driver(sums.groupBy("problem").applyInPandas(advance, STATE))
        if len(moved) < len(left):
            raise ValueError("a block or a training fold has no rows")
        for r in moved.to_dict("records"):
            p = problems[r["problem"]]
            p.w, p.step = np.array(r["w"]), np.array(r["step"])
            p.width, p.gap, p.done = r["width"], r["gap"], bool(r["done"])
            p.passes += 1
        for value in sent:
            value.release()
    return problems


def _problems(widths, lambdas, folds) -> list[Problem]:
    """``lambdas`` is one list for all blocks, or a list per block."""
    per_block = lambdas if isinstance(lambdas, dict) else {b: lambdas for b in widths}
    return [
        Problem(b, f, lam, np.zeros(m), np.zeros(m))
        for b, m in sorted(widths.items())
        for f in folds
        for lam in check_lambdas(per_block[b])
    ]


def _weights(spark, problems: list[Problem], limit: float) -> DataFrame:
    frame = pd.concat([
        pd.DataFrame({
            "fold": p.fold, "block": p.block, "lambda": p.lam,
            "i": np.arange(len(p.w)), "beta": p.w, "gap": p.gap, "converged": bool(p.gap <= limit),
        })
        for p in problems
    ])
    return from_driver(spark, frame, WEIGHTS)


def _solved(source, feed, widths, loss, lambdas, folds, max_iter, stopping_gap) -> DataFrame:
    """By m x m systems where they fit into a task, else by products; with one contract."""
    spark = source.sparkSession
    problems = _problems(widths, lambdas, folds)
    if loss != "squared" and max(widths.values()) <= sizes.DENSE_WIDTH:
        limit = STOPPING_GAPS[loss] if stopping_gap is None else stopping_gap
        return _weights(spark, _run(source, feed, widths, problems, loss, max_iter, limit), limit)
    target = wide.STOPPING_GAPS.get(loss) if stopping_gap is None else stopping_gap
    fits = [wide.Fit(p.block, p.fold, p.lam, p.w, loss, target) for p in problems]
    return from_driver(spark, wide.frame_of(wide.solve(source, feed, fits, loss, max_iter)), WEIGHTS)


def fit_margin_rows(rows: DataFrame, layout: BlockLayout, loss: str, lambdas,
                    folds=(0,), max_iter: int = 100,
                    stopping_gap: float | None = None) -> DataFrame:
    """Weights of Z_k by shared passes, straight from rows; squared loss by products.

    A fit that reaches ``max_iter`` steps first says so in ``converged``. The rows are kept in
    memory or on local disk for the passes; a lost executor costs a read of its part of the
    source.
    """
    widths = {k: layout.width(k) for k in range(layout.n_blocks)}
    feed = RowsFeed(Shared(rows.sparkSession, layout))
    source = feed_rows(rows, layout).drop("row_id").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _solved(source, feed, widths, loss, lambdas, folds, max_iter, stopping_gap)
    finally:
        source.unpersist()


def fit_margin_design(design: DataFrame, loss: str, lambdas, folds=(0,), max_iter: int = 100,
                      stopping_gap: float | None = None, widths: dict | None = None) -> DataFrame:
    """The same from a published design table; ``widths`` of Z_k are looked up unless given."""
    keep = ["block", "y", "z"] + (["fold"] if "fold" in design.columns else [])
    source = design.select(*keep).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        widths = widths or design_widths(source)
        return _solved(source, DesignFeed(widths), widths, loss, lambdas, folds, max_iter, stopping_gap)
    finally:
        source.unpersist()


def fit_svm(design: DataFrame, lam, max_iter: int = 100,
            stopping_gap: float | None = None) -> DataFrame:
    """Minimiser of (1/n) sum max(0, 1 - y z w) + (lambda/2) |w|^2 per block."""
    return fit_margin_design(design, "hinge", lam, (0,), max_iter, stopping_gap)


def fit_logistic(design: DataFrame, lam, max_iter: int = 100,
                 stopping_gap: float | None = None) -> DataFrame:
    """Minimiser of (1/n) sum log(1 + exp(-y z w)) + (lambda/2) |w|^2 per block."""
    return fit_margin_design(design, "logistic", lam, (0,), max_iter, stopping_gap)
