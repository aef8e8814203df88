"""Fits of wide blocks without m x m systems: gradients and curvature products in shared passes.

Newton's method whose steps come from conjugate gradients, preconditioned by the diagonal of
the curvature, so that columns of very different size do not slow them down. A pass over the
rows serves every open (fold, penalty, block) problem at once: for some it yields loss, gradient,
curvature's diagonal and trial losses at the end of a step, for others the product of the
curvature with a direction. Tasks emit vectors as long as a block is wide, never its square.

Every fit carries its duality gap and stops on it; `converged` says whether it was met. The
squared loss takes one Newton step; for the others a step is left early and made anew, as its
directions need not be exact.
"""

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from shardfit.functions.losses import check_loss
from shardfit.functions.shared import Shared, to_driver
from shardfit.operators.ridge import gap_limit

CHUNK = 4_096         # values of a vector that are added up together, 32 KB
TASKS_PER_CORE = 4    # tasks of a pass; each emits a vector per open problem, whatever its rows
# fixed values: step lengths that a pass tries besides 0 and 1
STEPS = np.concatenate([[0.0, 1.0], 2.0 ** -np.arange(1, 25), [0.75, 0.9]])
STOPPING_GAPS = {"hinge": 1e-6, "logistic": 1e-12}  # that of the squared loss is relative, see `gap_limit`
FIRST_WIDTH, LAST_WIDTH, SHRINK = 2.0, 1e-12, 0.2
PRODUCTS = {"squared": 500, "hinge": 60, "logistic": 60}  # most products of one Newton step
N, LOSS, CONJUGATE, TRIALS = 0, 1, 2, 3


def _values(loss: str, y, f, width: float):
    """Smoothed loss of predictions; the hinge is (s + sqrt(s^2 + 4 width^2)) / 2, s = 1 - y f."""
    if loss == "squared":
        return (y - f) ** 2
    if loss == "hinge":
        s = 1.0 - y * f
        return 0.5 * (s + np.sqrt(s * s + 4 * width * width))
    return np.logaddexp(0.0, -y * f)


def _slopes(loss: str, y, f, width: float):
    """Minus the derivative by the prediction, which is a feasible dual value, and the curvature."""
    if loss == "squared":
        return 2 * (y - f), np.full(len(y), 2.0)
    if loss == "hinge":
        s = 1.0 - y * f
        root = np.sqrt(s * s + 4 * width * width)
        return y * 0.5 * (1 + s / root), 2 * width * width / root ** 3
    t = np.exp(-np.logaddexp(0.0, y * f))
    return y * t, t * (1 - t)


def _conjugate(loss: str, y, a):
    if loss == "squared":
        return 0.25 * a * a - y * a
    if loss == "hinge":
        return -y * a
    t = np.clip(y * a, 1e-300, 1.0)
    rest = np.clip(1 - y * a, 1e-300, 1.0)
    return t * np.log(t) + (1 - t) * np.log(rest)


@dataclass
class Fit:
    """One problem: where it stands, and what it asks of the next pass."""

    block: int
    fold: int
    lam: float
    w: np.ndarray
    loss: str
    stopping_gap: float | None  # none: `gap_limit` of the squared loss
    step: np.ndarray = None
    width: float = FIRST_WIDTH
    gap: float = field(default=np.inf)
    points: int = 0
    done: bool = False
    converged: bool = False
    passes: int = 0
    product: bool = False     # asks for curvature times `d`, else for the point w + step

    def __post_init__(self):
        self.step = np.zeros_like(self.w)

    def question(self):
        return self.block, self.fold, self.product, self.w, self.d if self.product else self.step, self.width

    def answer(self, sums: np.ndarray, vector: np.ndarray) -> None:
        self.passes += 1
        (self._multiplied if self.product else self._arrived)(sums, vector)

    def _arrived(self, sums, vector) -> None:
        n, lam = sums[N], self.lam
        slope, diagonal = np.split(vector, 2)
        tried = [t / n + 0.5 * lam * (v := self.w + s * self.step) @ v for s, t in zip(STEPS, sums[TRIALS:])]
        best = int(np.argmin(tried))
        rounding = 1e-14 * max(1.0, abs(tried[0]))
        if self.step.any() and tried[1] > tried[best] + rounding and tried[0] - tried[1] < 0.3 * (tried[0] - tried[best]):
            self.w = self.w + STEPS[best] * self.step  # slopes there are asked for anew
            self.step = np.zeros_like(self.w)
            return
        if self.stopping_gap is None:  # the first point is 0, where the loss is the mean square of y
            self.stopping_gap = gap_limit(sums[LOSS] / n, None)
        self.points += 1
        self.w = self.w + self.step
        self.step = np.zeros_like(self.w)
        dual = slope / (n * lam)
        self.gap = (sums[LOSS] + sums[CONJUGATE]) / n + 0.5 * lam * (self.w @ self.w + dual @ dual)
        gradient = lam * self.w - slope / n
        size = np.linalg.norm(gradient)
        settled = size <= 1e-15 * max(1.0, lam * np.linalg.norm(self.w))
        if self.gap <= self.stopping_gap or (settled and (self.loss != "hinge" or self.width <= LAST_WIDTH)):
            self.done, self.converged = True, bool(self.gap <= self.stopping_gap)
            return
        if self.loss == "hinge" and 0.5 * size * size / lam <= 0.1 * max(tried[1] - 0.5 * lam * self.w @ self.w - sums[LOSS] / n, 0):
            self.width = max(SHRINK * self.width, LAST_WIDTH)  # near the optimum of this width
            return
        self.product, self.s, self.r = True, np.zeros_like(self.w), -gradient
        self.scale = 1 / (diagonal / n + lam)
        self.d, self.tries = self.scale * self.r, 0
        self.goal = size * (1e-8 if self.loss == "squared" else min(0.1, size ** 0.5))

    def _multiplied(self, sums, vector) -> None:
        q = vector / sums[N] + self.lam * self.d
        square = self.r @ (self.scale * self.r)
        length = square / (self.d @ q)
        self.s = self.s + length * self.d
        self.r = self.r - length * q
        self.tries += 1
        if np.linalg.norm(self.r) <= self.goal or self.tries >= PRODUCTS[self.loss]:
            self.product, self.step = False, self.s
        else:
            ahead = self.scale * self.r
            self.d = ahead + self.r @ ahead / square * self.d


def _left(z, a: np.ndarray) -> np.ndarray:
    return a @ z if isinstance(z, np.ndarray) else z.left(a)


def _left_squares(z, a: np.ndarray) -> np.ndarray:
    return a @ (z * z) if isinstance(z, np.ndarray) else z.left_squares(a)


def _sums(feed, sent: Shared, loss: str):
    def run(batches):
        questions, found, by_block = sent.value, {}, {}
        for pid, (block, *_) in questions.items():
            by_block.setdefault(block, []).append(pid)
        for batch in batches:
            for block, z, y, fold in feed(batch):
                ids = by_block.get(block, ())
                if not ids:
                    continue
                both = z @ np.column_stack([questions[i][k] for k in (3, 4) for i in ids])
                for at, pid in enumerate(ids):
                    _, left_out, product, _, _, width = questions[pid]
                    train = fold != left_out if left_out else slice(None)
                    yt, f, along = y[train], both[train, at], both[train, len(ids) + at]
                    whole = np.zeros(len(y))  # rows of the fold that is left out weigh nothing
                    if product:
                        whole[train] = _slopes(loss, yt, f, width)[1] * along
                        part = np.array([len(yt)]), _left(z, whole)
                    else:
                        end = f + along
                        a, curve = _slopes(loss, yt, end, width)
                        trials = [_values(loss, yt, f + s * along, width).sum() for s in STEPS] if along.any() else \
                            [_values(loss, yt, f, width).sum()] * len(STEPS)
                        true = np.maximum(1 - yt * end, 0.0) if loss == "hinge" else _values(loss, yt, end, width)
                        whole[train] = a
                        slope = _left(z, whole)
                        whole[train] = curve
                        part = np.array([len(yt), true.sum(), _conjugate(loss, yt, a).sum(), *trials]), \
                            np.concatenate([slope, _left_squares(z, whole)])
                    if pid in found:
                        for total, more in zip(found[pid], part):
                            total += more
                    else:
                        found[pid] = [p.astype(float) for p in part]
        for pid, (sums, vector) in found.items():
            v = np.concatenate([sums, vector])
            for low in range(0, len(v), CHUNK):
                chunk = pa.array([v[low:low + CHUNK]], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([pid], pa.int32()), pa.array([low // CHUNK], pa.int32()), chunk], ["problem", "chunk", "v"])
    return run


def _add_up(key, table):
    """Sum of one chunk over the tasks of a pass."""
    total = sum(x.values.to_numpy() for x in table["v"])
    return pa.table({"problem": [key[0].as_py()], "chunk": [key[1].as_py()], "v": pa.array([total], pa.list_(pa.float64()))},
                    schema=pa.schema([("problem", pa.int32()), ("chunk", pa.int32()), ("v", pa.list_(pa.float64()))]))


def solve(source: DataFrame, feed, fits: list[Fit], loss: str, max_iter: int) -> list[Fit]:
    """Move all fits on until each has met its gap or `max_iter` points; those are not converged."""
    check_loss(loss)
    spark = source.sparkSession
    schema = "problem int, chunk int, v array<double>"
    source = source.coalesce(TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    while open_ := {k: p for k, p in enumerate(fits) if not p.done}:
        sent = Shared(spark, {k: p.question() for k, p in open_.items()})
        wanted = feed.only(sorted({p.block for p in open_.values()}), entries=True)
        parts = source.mapInArrow(_sums(wanted, sent, loss), schema)
        moved = to_driver(parts.groupBy("problem", "chunk").applyInArrow(_add_up, schema))
        sent.release()
        if moved["problem"].nunique() < len(open_):
            raise ValueError("a block or a training fold has no rows")
        for pid, rows in moved.sort_values("chunk").groupby("problem"):
            p, v = fits[pid], np.concatenate(rows["v"].to_list())
            first = 1 if p.product else TRIALS + len(STEPS)
            p.answer(v[:first], v[first:])
            if p.points >= max_iter and not p.product:
                p.done = True
    return fits


def frame_of(fits) -> pd.DataFrame:
    return pd.concat([pd.DataFrame({
        "fold": p.fold, "block": p.block, "lambda": p.lam, "i": np.arange(len(p.w)), "beta": p.w,
        "gap": p.gap, "converged": p.converged}) for p in fits])
