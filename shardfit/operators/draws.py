"""The shared projections inside tasks: as a matrix, drawn by entry, or by a fast transform.

All three give X_k Pi_k of every block. A matrix of features x q is sent where it is small. Else
nothing as large as it is ever held: signs are drawn for the columns that a slice of rows has,
and cosines need one sign per column and the q sampled coordinates per block.
"""

import hashlib
import math
from dataclasses import dataclass

import numpy as np

from shardfit.functions.arrow import scatter

SIGN_BYTES = 64 << 20     # drawn signs that a worker remembers
CHUNK_COLUMNS = 4_096     # columns whose signs are unpacked at once


@dataclass
class MatrixProjection:
    """Rows of a block are its own matrix."""

    q: int
    matrix: np.ndarray
    parts: list = None  # by block; cut once in a task

    def block(self, x: np.ndarray, k: int, cols: np.ndarray) -> np.ndarray:
        """n x q from the rows' own columns of block k."""
        return x @ self.matrix[cols]

    def dense(self, x: np.ndarray, cols: list) -> np.ndarray:
        """n x (blocks q) from whole rows."""
        if self.parts is None:
            self.parts = [self.matrix[c] for c in cols]
        return np.hstack([x[:, c] @ part for c, part in zip(cols, self.parts)])

    def entries(self, row, col, val, block, place, n: int, widths) -> np.ndarray:
        """The same from entries; work per entry."""
        out = np.empty((n, len(widths), self.q))
        at = row * len(widths) + block
        for t in range(self.q):
            out[:, :, t] = scatter(at, val * self.matrix[col, t], (n, len(widths)))
        return out.reshape(n, -1)


class SignProjection:
    """sqrt(3/q) times -1, 0, 1 by the md5 of seed, column and coordinate, as `sparse_sign` draws."""

    def __init__(self, q: int, seed):
        self.q, self.seed = q, seed
        self.seen: dict[int, bytes] = {}
        self.old: dict[int, bytes] = {}

    def __getstate__(self):
        return {"q": self.q, "seed": self.seed, "seen": {}, "old": {}}

    def _draw(self, col: int) -> bytes:
        signs = bytearray(self.q)
        head = f"{self.seed}|{col}|".encode()
        for t in range(self.q):
            word = int.from_bytes(hashlib.md5(head + b"%d" % t).digest()[:4], "big") % 6
            signs[t] = 255 if word == 0 else 1 if word == 5 else 0
        return bytes(signs)

    def rows(self, cols: np.ndarray) -> np.ndarray:
        """Signs of distinct columns, one row each; what was met of late is remembered."""
        if len(self.seen) * (self.q + 150) > SIGN_BYTES // 2:
            self.seen, self.old = {}, self.seen
        found = []
        for c in cols.tolist():
            signs = self.seen.get(c)
            if signs is None:
                signs = self.seen[c] = self.old.get(c) or self._draw(c)
            found.append(signs)
        return np.frombuffer(b"".join(found), np.int8).reshape(len(cols), self.q)

    def block(self, x: np.ndarray, k: int, cols: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.q))
        for low in range(0, len(cols), CHUNK_COLUMNS):
            part = slice(low, low + CHUNK_COLUMNS)
            out += x[:, part] @ self.rows(cols[part]).astype(float)
        return out * math.sqrt(3.0 / self.q)

    def dense(self, x: np.ndarray, cols: list) -> np.ndarray:
        return np.hstack([self.block(x[:, c], k, c) for k, c in enumerate(cols)])

    def entries(self, row, col, val, block, place, n: int, widths) -> np.ndarray:
        distinct, at = np.unique(col, return_inverse=True)
        signs = self.rows(distinct)
        out = np.empty((n, len(widths), self.q))
        to = row * len(widths) + block
        for t in range(self.q):
            out[:, :, t] = scatter(to, val * signs[at, t], (n, len(widths)))
        return out.reshape(n, -1) * math.sqrt(3.0 / self.q)


@dataclass
class CosineProjection:
    """Signed columns of a block, orthonormal cosine transform, q sampled coordinates."""

    q: int
    signs: np.ndarray     # per column of the table
    coordinates: list     # per block: the q sampled coordinates, in order

    def block(self, x: np.ndarray, k: int, cols: np.ndarray) -> np.ndarray:
        return self._transformed(x * self.signs[cols], k)

    def _transformed(self, x: np.ndarray, k: int) -> np.ndarray:
        """Cosine transform of a block's signed columns by one FFT, at its coordinates."""
        d, t = x.shape[1], self.coordinates[k]
        turned = np.fft.fft(np.hstack([x[:, ::2], x[:, 1::2][:, ::-1]]), axis=1)[:, t]
        wave = np.real(turned * np.exp(-0.5j * np.pi * t / d))
        return wave * np.where(t == 0, math.sqrt(1 / d), math.sqrt(2 / d)) * math.sqrt(d / self.q)

    def dense(self, x: np.ndarray, cols: list) -> np.ndarray:
        return np.hstack([self.block(x[:, c], k, c) for k, c in enumerate(cols)])

    def entries(self, row, col, val, block, place, n: int, widths) -> np.ndarray:
        """A block with many entries is transformed whole, one with few by its entries' cosines."""
        out = np.zeros((n, len(widths), self.q))
        ends = np.searchsorted(block, np.arange(len(widths) + 1))
        for k, d in enumerate(widths):
            own = slice(ends[k], ends[k + 1])
            r, j, v = row[own], place[own], val[own] * self.signs[col[own]]
            if len(v) * self.q > n * d * max(1.0, math.log2(d)):
                out[:, k] = self._transformed(scatter(r * d + j, v, (n, d)), k)
                continue
            for s, t in enumerate(self.coordinates[k]):
                scale = math.sqrt(d / self.q) * math.sqrt((1 if t == 0 else 2) / d)
                angle = (2 * j + 1) * int(t) % (4 * d)  # whole numbers, so large angles lose nothing
                wave = np.cos(angle * (np.pi / (2 * d)))
                out[:, k, s] = np.bincount(r, weights=v * wave * scale, minlength=n)
        return out.reshape(n, -1)
