"""Language identification with string kernels.

Two texts are as alike as the share of character n-grams, of lengths 1 to 3, that occur in
both: the blended-spectrum presence kernel |x and y| / sqrt(|x| |y|) over a dictionary of
n-grams. Nystroem landmarks stand for the training texts, and one ridge regression per
language, against the rest, is fitted on their features. Scoring a batch is two matrix
products: presence times landmarks, kernel times weights. Texts are scored where they lie.

The fit takes a bounded sample, by default at most about 300 rows of each language; all
texts are scored whole.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardfit.functions.shared import Shared, give_back
from shardfit.llm.common import sample_rows

UNKNOWN = "und"
LENGTHS = (1, 2, 3)
SYMBOLS = 128        # letters told apart: the commonest of the sample; 0 stands for all else
DICTIONARY = 8_192   # n-grams of the dictionary at most
CHUNK_CHARS = 400_000


def _letters() -> np.ndarray:
    """True for the code points of letters."""
    known = np.zeros(0x110000, bool)
    known[[i for i in range(0x110000) if chr(i).isalpha()]] = True
    return known


class LanguageModel:
    """Dictionary, landmarks and weights; `score` takes whole texts."""

    def __init__(self, texts: list[str], labels: list[str], landmarks: int = 40, ridge: float = 1e-2):
        self.languages = sorted(set(labels))
        self._letter = _letters()
        points = [self._points(t) for t in texts]
        common = np.bincount(np.concatenate([*points, np.zeros(1, np.int64)]), minlength=1)
        common = common * self._letter[:len(common)]
        best = np.argsort(-common, kind="stable")[:SYMBOLS - 2]
        self.symbol = np.zeros(0x110000, np.int32)
        self.symbol[self._letter] = SYMBOLS - 1
        for k, point in enumerate(sorted(best[common[best] > 0].tolist())):
            self.symbol[point] = k + 1
        self._fit(texts, np.array([self.languages.index(x) for x in labels], np.int64), landmarks, ridge)

    @staticmethod
    def _points(text: str) -> np.ndarray:
        return np.frombuffer(text.lower().encode("utf-32-le"), "<u4").astype(np.int64)

    def __getstate__(self):
        keep = self.__dict__ | {"_letter": None}
        at = np.flatnonzero(self.symbol != np.where(self._letter, SYMBOLS - 1, 0))
        return keep | {"symbol": (at, self.symbol[at])}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._letter = _letters()
        at, value = state["symbol"]
        self.symbol = np.where(self._letter, SYMBOLS - 1, 0).astype(np.int32)
        self.symbol[at] = value

    def _codes(self, texts: list[str]):
        """Whether each text has a letter; row and code of every n-gram of the texts.

        Runs of other characters count as one space; n-grams do not cross texts.
        """
        points = [self._points(t) for t in texts]
        flat = np.concatenate([np.zeros(0, np.int64), *points])
        row = np.repeat(np.arange(len(texts), dtype=np.int32), [len(p) for p in points])
        lettered = np.zeros(len(texts), bool)
        lettered[row[self._letter[flat]]] = True
        code = self.symbol[flat]
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != 0) | (code[:-1] != 0) | (row[1:] != row[:-1])
        return lettered, row[new], code[new]

    @staticmethod
    def _grams(row: np.ndarray, code: np.ndarray):
        """Rows and dictionary keys of the n-grams of each length."""
        key = np.zeros(len(code), np.int32)
        for n in LENGTHS:
            if len(code) < n:
                return
            key = (key[:len(code) - n + 1] << 7) | code[n - 1:]
            inside = slice(None) if n == 1 else row[:len(key)] == row[n - 1:]
            yield n, row[:len(key)][inside], key[inside]

    def _presence(self, row: np.ndarray, code: np.ndarray, n_texts: int) -> np.ndarray:
        seen = np.zeros((n_texts, self.width + 1), np.float32)
        for n, at, key in self._grams(row, code):
            seen[at, self.place[n][key]] = 1.0
        return seen[:, :self.width]  # the last column takes what the dictionary lacks

    def _fit(self, texts, labels, landmarks, ridge):
        places = [(row, code) for _, row, code in (self._codes([t]) for t in texts)]
        counts = {n: np.zeros(1 << 7 * n, np.int32) for n in LENGTHS}
        for row, code in places:
            for n, _, key in self._grams(row, code):
                counts[n][np.unique(key)] += 1
        every = np.concatenate([counts[n] for n in LENGTHS])
        ranked = np.argsort(-every, kind="stable")[:DICTIONARY]
        ranked = np.sort(ranked[every[ranked] > (1 if len(texts) > 10 else 0)])
        self.width = len(ranked)
        self.place, start = {}, 0
        for n in LENGTHS:
            place = np.full(1 << 7 * n, self.width, np.int32)
            own = (ranked >= start) & (ranked < start + len(place))
            place[ranked[own] - start] = np.flatnonzero(own)
            self.place[n], start = place, start + len(place)
        seen = np.concatenate([np.zeros((0, self.width), np.float32)]
                              + [self._presence(row, code, 1) for row, code in places])
        chosen = np.concatenate([np.flatnonzero(labels == c)[:landmarks] for c in range(len(self.languages))]
                                + [np.zeros(0, np.int64)])
        self.landmarks = self._unit(seen[chosen]).T.copy()
        between = (self._unit(seen[chosen]) @ self.landmarks).astype(float)
        value, vector = np.linalg.eigh(between) if len(chosen) else (np.zeros(0), np.zeros((0, 0)))
        large = value > 1e-6 * max(1.0, value.max(initial=0))
        root = vector[:, large] / np.sqrt(value[large])  # kernel values -> Nystroem features
        feature = (self._unit(seen) @ self.landmarks).astype(float) @ root
        target = np.where(labels[:, None] == np.arange(len(self.languages)), 1.0, -1.0)
        gram = feature.T @ feature + ridge * max(1, len(texts)) * np.eye(feature.shape[1]) / 10
        self.weights = (root @ np.linalg.solve(gram, feature.T @ target)).astype(np.float32)

    @staticmethod
    def _unit(seen: np.ndarray) -> np.ndarray:
        return seen / np.sqrt(np.maximum(seen.sum(axis=1, keepdims=True), 1))

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and a value from 0 to 1 for each text.

        The value is (1 + f) / 2 of the best regression, cut to 0..1; it is 0 where the text
        has no letter, or none of its n-grams is known.
        """
        names, values, start = [], [], 0
        while start < len(texts):
            stop, chars = start, 0
            while stop < len(texts) and (stop == start or chars + len(texts[stop]) <= CHUNK_CHARS) and stop - start < 256:
                chars += len(texts[stop])
                stop += 1
            lettered, row, code = self._codes(texts[start:stop])
            start = stop
            if not self.languages:
                names += [UNKNOWN] * len(lettered)
                values.append(np.zeros(len(lettered)))
                continue
            seen = self._presence(row, code, len(lettered))
            f = (self._unit(seen) @ self.landmarks) @ self.weights
            best = f.argmax(axis=1)
            known = lettered & (seen.any(axis=1))
            values.append(np.where(known, np.clip((1.0 + f[np.arange(len(f)), best]) / 2, 0, 1), 0).astype(float))
            names += [self.languages[b] if k else UNKNOWN for b, k in zip(best, lettered)]
        return names, np.concatenate([*values, np.zeros(0)])


def fit_languages(docs: DataFrame, per_language: int = 300, key="doc_id", text="text", lang="lang") -> LanguageModel:
    """Fit on a sample of at most about `per_language` rows of each language.

    Rows with null key, text or language teach nothing. Without any row the model answers
    `und` with 0.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    drawn = sample_rows(rows.where(F.col("text").isNotNull()), "lang", per_language).toPandas()
    drawn = drawn.sort_values(["doc_id", "text", "lang"])
    return LanguageModel(drawn["text"].tolist(), drawn["lang"].astype(str).tolist())


def language_of(model: Shared, text: Column | str) -> Column:
    """Struct of `lang` and `score` for a column of texts; null counts as empty."""

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lang, score = model.value.score([t or "" for t in batch])
            yield pd.DataFrame({"lang": lang, "score": score})
        give_back()

    return predict(F.col(text) if isinstance(text, str) else text)


def identify(docs: DataFrame, model: LanguageModel, key="doc_id", text="text") -> DataFrame:
    """`key, lang_pred, score` of every row, equal rows and null keys included.

    `lang_pred` is `und` if the text is null or has no letter. Other columns are not read.
    """
    shared = Shared(docs.sparkSession, model)
    return docs.select(key, language_of(shared, F.col(text).cast("string")).alias("_found")).select(
        key, F.col("_found.lang").alias("lang_pred"), F.col("_found.score").alias("score"))
