"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A text is read as windows of WIDTH words, a new one every STEP words, so windows overlap and
the whole text is covered. Every position gets a word input (hashed embedding of the word)
and a character input (mean embedding of its hashed character n-grams). A gated recurrent
unit reads the window in each direction; attention weighs the positions and pools states and
inputs. The score of a text is the highest of its windows, so one passage is enough.

Labels belong to texts, not windows: training takes, in every epoch, the highest window of
each text and some others of clean texts. One dimension of each embedding starts as the
log-odds of its bucket in the sample, the others at random; all are trained on.

The fit takes a bounded sample, by default at most about 1 000 rows of each label. The work
that grows, scoring, is a function of the row.
"""

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardfit.functions.shared import Shared, give_back
from shardfit.llm.common import sample_rows

WIDTH, STEP = 24, 16
STATES = 8           # of each direction
EMBEDDED = 8         # dimensions of each of the two inputs
BUCKETS = 1 << 15    # of words, and of character n-grams
GRAMS = (3, 4)
SLICE_CHARS = 2_000_000
SLICE_WINDOWS = 4_096
AT_ONCE = 500_000    # n-grams looked up at once
WORDS_AT_ONCE = 30_000
_MARKS = re.compile(r"[\W_]+")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Words:
    """Distinct words of some texts, the windows over them, and the hashed inputs of each word."""

    def __init__(self, texts: list[str]):
        split = [t.lower().split() for t in texts]
        self.index = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(split)))}
        flat = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), np.int32)
        lengths = np.array([len(s) for s in split], np.int64)
        starts = np.cumsum(lengths) - lengths
        per_text = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - WIDTH) // STEP)), 0)
        self.text = np.repeat(np.arange(len(texts)), per_text)
        number = np.arange(len(self.text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        first = starts[self.text] + number * STEP
        size = np.minimum(WIDTH, starts[self.text] + lengths[self.text] - first)
        at = first[:, None] + np.arange(WIDTH)
        pad = np.arange(WIDTH) >= size[:, None]
        n = len(self.index)
        padded = np.append(flat, np.int32(n))
        self.windows = np.where(pad, n, padded[np.minimum(at, len(flat))]).astype(np.int32)
        plain = [_MARKS.sub("", w) or w for w in self.index]
        self.word = np.fromiter((zlib.crc32(w.encode()) & (BUCKETS - 1) for w in plain), np.int32, n)
        self._grams(plain)

    def _grams(self, words: list[str]) -> None:
        """Buckets of the n-grams of every marked word, and how many each word has."""
        buckets, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for first in range(0, len(words), WORDS_AT_ONCE):
            bucket, count = self._grams_of(words[first:first + WORDS_AT_ONCE])
            buckets.append(bucket)
            counts.append(count)
        self.gram, self.n_grams = np.concatenate(buckets), np.concatenate(counts)
        self.owner = np.repeat(np.arange(len(words), dtype=np.int32), self.n_grams)

    @staticmethod
    def _grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        marked = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), "<u4")
        owner = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) + 2 for w in words])
        found, whose = [], []
        with np.errstate(over="ignore"):
            for n in GRAMS:
                if len(marked) < n:
                    continue
                h = np.full(len(marked) - n + 1, n, np.uint32)
                for k in range(n):
                    h = h * np.uint32(0x01000193) ^ marked[k:k + len(h)]
                h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                inside = owner[:len(h)] == owner[n - 1:n - 1 + len(h)]
                found.append((h[inside] >> np.uint32(17)).astype(np.int32))
                whose.append(owner[:len(h)][inside])
        bucket = np.concatenate([np.zeros(0, np.int32), *found])
        owner = np.concatenate([np.zeros(0, np.int32), *whose])
        return bucket[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))


class Part:
    """The inputs of those words alone that some windows use, numbered anew."""

    def __init__(self, words: Words, windows: np.ndarray):
        n = len(words.word)
        used = np.unique(windows)
        used = used[used < n]
        number = np.full(n + 1, len(used), np.int32)
        number[used] = np.arange(len(used), dtype=np.int32)
        self.windows = number[windows]
        self.word, self.n_grams = words.word[used], words.n_grams[used]
        starts = np.cumsum(words.n_grams) - words.n_grams
        within = np.arange(self.n_grams.sum()) - np.repeat(np.cumsum(self.n_grams) - self.n_grams, self.n_grams)
        self.gram = words.gram[np.repeat(starts[used], self.n_grams) + within]
        self.owner = np.repeat(np.arange(len(used), dtype=np.int32), self.n_grams)


class ToxicityModel:
    """Parameters of the network. `fit` trains them, `score` applies them to whole texts."""

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        normal = lambda *shape, scale: (draw.normal(size=shape) * scale).astype(np.float32)
        inputs, gates = 2 * EMBEDDED, 3 * STATES
        self.p = {
            "word": normal(BUCKETS, EMBEDDED, scale=0.1), "gram": normal(BUCKETS, EMBEDDED, scale=0.1),
            "u": normal(2 * STATES, scale=0.3), "v": normal(inputs, scale=0.3),
            "out": normal(2 * STATES + inputs, scale=0.3), "bias": np.zeros(1, np.float32),
        }
        for d in "fb":
            self.p["in" + d] = normal(inputs, gates, scale=inputs ** -0.5)
            self.p["re" + d] = normal(STATES, gates, scale=STATES ** -0.5)
            self.p["b" + d] = np.zeros(gates, np.float32)
        self.trained = False

    # inputs ----------------------------------------------------------------

    def _inputs(self, words: "Words | Part") -> np.ndarray:
        """Word and character inputs of every distinct word; a last row of zeros for padding."""
        out = np.zeros((len(words.word) + 1, 2 * EMBEDDED), np.float32)
        out[:-1, :EMBEDDED] = self.p["word"][words.word]
        ends = np.cumsum(words.n_grams)
        first = 0
        while first < len(words.word):  # a bounded number of n-grams at a time
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + AT_ONCE, side="right")))
            counts = words.n_grams[first:last]
            has = counts > 0
            if has.any():
                starts = (ends[first:last] - counts - done)[has]
                sums = np.add.reduceat(self.p["gram"][words.gram[done:ends[last - 1]]], starts, axis=0)
                out[first:last, EMBEDDED:][has] = sums / counts[has, None]
            first = last
        return out

    def _projected(self, x: np.ndarray, d: str) -> np.ndarray:
        """Inputs of the gates; the padding row holds the update gate open, so states pass by."""
        out = x @ self.p["in" + d] + self.p["b" + d]
        out[-1] = 0
        out[-1, :STATES] = 30
        return out

    # network ---------------------------------------------------------------

    def _read(self, gates: np.ndarray, windows: np.ndarray, d: str, trace: list | None = None) -> np.ndarray:
        """States of one direction at every position, time first."""
        recur, h = self.p["re" + d], np.zeros((len(windows), STATES), np.float32)
        out = np.empty((WIDTH, len(windows), STATES), np.float32)
        for t in range(WIDTH) if d == "f" else range(WIDTH - 1, -1, -1):
            a, b = gates[windows[:, t]], h @ recur
            zr = _sigmoid(a[:, :2 * STATES] + b[:, :2 * STATES])
            z, r = zr[:, :STATES], zr[:, STATES:]
            n = np.tanh(a[:, 2 * STATES:] + r * b[:, 2 * STATES:])
            if trace is not None:
                trace.append((t, h, z, r, n, b[:, 2 * STATES:]))
            h = n + z * (h - n)
            out[t] = h
        return out

    def _logits(self, x, gates, windows, trace=None):
        fore = self._read(gates["f"], windows, "f", None if trace is None else trace.setdefault("f", []))
        back = self._read(gates["b"], windows, "b", None if trace is None else trace.setdefault("b", []))
        u, out = self.p["u"], self.p["out"]
        at = windows.T
        score = fore @ u[:STATES] + back @ u[STATES:] + (x @ self.p["v"])[at]
        score = np.where(at == len(x) - 1, -np.inf, score)
        weight = np.exp(score - score.max(axis=0))
        weight /= weight.sum(axis=0)
        value = fore @ out[:STATES] + back @ out[STATES:2 * STATES] + (x @ out[2 * STATES:])[at]
        if trace is not None:
            trace |= {"fore": fore, "back": back, "weight": weight, "value": value}
        return (weight * value).sum(axis=0) + self.p["bias"][0]

    def window_logits(self, words: Words) -> np.ndarray:
        x = self._inputs(words)
        gates = {d: self._projected(x, d) for d in "fb"}
        return np.concatenate([np.zeros(0, np.float32)] + [
            self._logits(x, gates, words.windows[i:i + SLICE_WINDOWS])
            for i in range(0, len(words.windows), SLICE_WINDOWS)])

    def score(self, texts: list[str]) -> np.ndarray:
        """Highest window probability of each text; 0 for a text without words, or before training."""
        out, start = np.zeros(len(texts)), 0
        while self.trained and start < len(texts):
            stop, chars = start, 0
            while stop < len(texts) and (stop == start or chars + len(texts[stop]) <= SLICE_CHARS):
                chars += len(texts[stop])
                stop += 1
            words = Words(texts[start:stop])
            best = np.full(stop - start, -np.inf)
            np.maximum.at(best, words.text, self.window_logits(words))
            out[start:stop] = 1 / (1 + np.exp(-np.clip(best, -700, 60)))
            out[start:stop][np.isneginf(best)] = 0
            start = stop
        return out

    # training --------------------------------------------------------------

    def _gradients(self, words: Part, labels: np.ndarray, weights: np.ndarray) -> dict:
        """Gradients of the weighted log-loss, by back-propagation through time."""
        p, x, windows = self.p, self._inputs(words), words.windows
        gates, trace = {d: self._projected(x, d) for d in "fb"}, {}
        logit = self._logits(x, gates, windows, trace)
        at, S = windows.T, STATES
        dlogit = ((_sigmoid(logit) - labels) * weights).astype(np.float32)
        w, value = trace["weight"], trace["value"]
        dvalue = w * dlogit
        dscore = w * (value - (w * value).sum(axis=0)) * dlogit
        g = {"bias": np.array([dlogit.sum()], np.float32)}
        dx = np.zeros_like(x)
        xs = x[at]
        g["v"] = np.einsum("tb,tbk->k", dscore, xs)
        dxs = dscore[..., None] * p["v"] + dvalue[..., None] * p["out"][2 * S:]
        gu, go = [], []
        for d, states in (("f", trace["fore"]), ("b", trace["back"])):
            half = slice(0, S) if d == "f" else slice(S, 2 * S)
            gu.append(np.einsum("tb,tbk->k", dscore, states))
            go.append(np.einsum("tb,tbk->k", dvalue, states))
            dstates = dscore[..., None] * p["u"][half] + dvalue[..., None] * p["out"][:2 * S][half]
            dgates = np.zeros((WIDTH, len(windows), 3 * S), np.float32)
            drecur, dh = np.zeros_like(p["re" + d]), np.zeros((len(windows), S), np.float32)
            for t, before, z, r, n, bn in reversed(trace[d]):
                dh = dh + dstates[t]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (before - n) * z * (1 - z)
                dr = dn * bn * r * (1 - r)
                dgates[t] = np.concatenate([dz, dr, dn], axis=1)
                db = np.concatenate([dz, dr, dn * r], axis=1)
                drecur += before.T @ db
                dh = dh * z + db @ p["re" + d].T
            dgates[at == len(x) - 1] = 0
            g["re" + d] = drecur
            flat = dgates.reshape(-1, 3 * S)
            g["b" + d] = flat.sum(axis=0)
            g["in" + d] = xs.reshape(-1, xs.shape[2]).T @ flat
            dxs = dxs + dgates @ p["in" + d].T
        g["u"] = np.concatenate(gu)
        g["out"] = np.concatenate([*go, np.einsum("tb,tbk->k", dvalue, xs)])
        np.add.at(dx, at.ravel(), dxs.reshape(-1, dxs.shape[2]))
        g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        np.add.at(g["word"], words.word, dx[:-1, :EMBEDDED])
        np.add.at(g["gram"], words.gram, (dx[:-1, EMBEDDED:] / np.maximum(words.n_grams, 1)[:, None])[words.owner])
        return g

    def fit(self, texts: list[str], labels: np.ndarray, share: float | None = None,
            epochs: int = 5, least_steps: int = 160, batch: int = 128, rate: float = 0.01, seed: int = 7) -> "ToxicityModel":
        """Train on labelled texts. `share`: part of label 1 in the whole, to set the bias by.

        Small samples are gone through more often, until about `least_steps` steps are made.
        """
        labels = np.asarray(labels, np.float32)
        known = np.array([bool(t.split()) for t in texts], bool)
        texts, labels = [t for t, k in zip(texts, known) if k], labels[known] if len(labels) else labels
        if not len(labels) or labels.min() == labels.max():
            return self
        draw, words = np.random.default_rng(seed), Words(texts)
        self._start_from_odds(words, labels)
        self.trained = True
        first = np.flatnonzero(np.r_[True, words.text[1:] != words.text[:-1]])
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        clean_windows = np.flatnonzero(labels[words.text] == 0)
        step, balance = 0, (1 - labels).sum() / labels.sum()
        highest = self._odds_of_windows(words)
        epochs = max(epochs, -(-least_steps * batch // (2 * len(labels) + int(labels.sum()))))
        for epoch in range(epochs):
            if epoch:
                highest = self.window_logits(words)
            top = np.maximum.reduceat(highest, first)
            ranked = np.lexsort((-highest, words.text))
            best = ranked[first]
            others = draw.choice(clean_windows, min(len(clean_windows), len(best)), replace=False)
            chosen = draw.permutation(np.concatenate([best, best[top > -np.inf][labels[words.text[best]] == 1], others]))
            for i in range(0, len(chosen), batch):
                ids = chosen[i:i + batch]
                y = labels[words.text[ids]]
                weight = np.where(y == 1, min(2.0, balance) / 2, 1.0) / len(ids)
                step += 1
                scale = rate * (0.3 if epoch >= epochs * 0.6 else 1.0)
                for name, g in self._gradients(Part(words, words.windows[ids]), y, weight).items():
                    m, v = moment[name]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    rise = scale * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)
                    self.p[name] -= rise.astype(np.float32)
        self._calibrate(words, labels, first, share)
        return self

    def _start_from_odds(self, words: Words, labels: np.ndarray) -> None:
        """First dimension of the embeddings: smoothed log-odds of a bucket over the sample's texts."""
        total = np.array([(labels == 0).sum(), (labels == 1).sum()], float)
        counts = {name: np.zeros((2, BUCKETS)) for name in ("word", "gram")}
        gram_start = np.cumsum(words.n_grams) - words.n_grams
        edges = np.searchsorted(words.text, np.arange(len(labels) + 1))
        for t, label in enumerate(labels.astype(int)):  # text by text, so that little is held at once
            own = np.unique(words.windows[edges[t]:edges[t + 1]])
            own = own[own < len(words.word)]
            counts["word"][label, np.unique(words.word[own])] += 1
            n = words.n_grams[own]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            counts["gram"][label, np.unique(words.gram[np.repeat(gram_start[own], n) + within])] += 1
        for name, (in_clean, in_toxic) in counts.items():
            odds = np.log((in_toxic + 0.5) / (total[1] + 1)) - np.log((in_clean + 0.5) / (total[0] + 1))
            odds *= (in_toxic + in_clean) / (in_toxic + in_clean + 2.0)
            self.p[name][:, 0] = 0.5 * np.clip(odds, -3, 3)
        x = self._inputs(words)
        self._odds = x[:-1, 0] + x[:-1, EMBEDDED]

    def _odds_of_windows(self, words: Words) -> np.ndarray:
        """Before the first epoch a window ranks by its most telling word."""
        return np.append(self._odds, -np.inf)[words.windows].max(axis=1)

    def _calibrate(self, words, labels, first, share) -> None:
        """Scale and shift of the logit of a text so that scores are rates among all rows."""
        top = np.maximum.reduceat(self.window_logits(words), first).astype(float)
        shift = 0.0
        if share is not None and 0 < share < 1:
            rate = labels.mean()
            shift = np.log(share / (1 - share)) - np.log(rate / (1 - rate))
        a, b = 1.0, 0.0
        x = np.stack([top, np.ones_like(top)], axis=1)
        for _ in range(30):  # Newton steps of a logistic fit with a small penalty
            q = 1 / (1 + np.exp(-np.clip(x @ [a, b], -30, 30)))
            grad = x.T @ (q - labels) + 1e-2 * np.array([a - 1, b])
            hess = (x * (q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(2)
            move = np.linalg.solve(hess, grad)
            a, b = a - np.clip(move[0], -0.5, 0.5), b - np.clip(move[1], -1, 1)
        a = max(a, 0.05)
        self.p["out"] = (self.p["out"] * a).astype(np.float32)
        self.p["bias"] = (self.p["bias"] * a + b + shift).astype(np.float32)


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_label: int = 1000, key="doc_id", text="text",
                 label="toxic") -> ToxicityModel:
    """Fit on a sample of at most about `per_label` labelled rows with label 1 and with label 0.

    Rows with null key, text or label teach nothing; labels other than 0 and 1 neither. The
    sample is drawn among the labels first, so only its texts are read out. With one label
    alone the model stays untrained and scores 0.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    marks = labels.select(F.col(key).alias("doc_id"), F.col(label).cast("int").alias("toxic")).where("toxic in (0, 1)")
    marks = marks.join(rows.select("doc_id"), "doc_id", "left_semi")
    counts = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    sample = sample_rows(marks, "toxic", per_label).dropDuplicates(["doc_id", "toxic"])
    drawn = rows.join(F.broadcast(sample), "doc_id").toPandas()  # the sample's size is bounded
    drawn = drawn.sort_values(["doc_id", "toxic", "text"])
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    return ToxicityModel().fit(drawn["text"].tolist(), drawn["toxic"].to_numpy(), share)


def toxicity_of(model: Shared, text: Column | str) -> Column:
    """Score from 0 to 1 of a column of texts; null counts as empty and scores 0."""

    @F.pandas_udf("double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.value.score([t or "" for t in batch]))
        give_back()

    return predict(F.col(text) if isinstance(text, str) else text)


def rate(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, key="doc_id", text="text") -> DataFrame:
    """`key, score, predicted` of every row, equal rows and null keys included."""
    shared = Shared(docs.sparkSession, model)
    scored = docs.select(key, toxicity_of(shared, F.col(text).cast("string")).alias("score"))
    return scored.select(key, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
