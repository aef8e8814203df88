"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is itself a token
costs one hash and one comparison. Tier two, for the others, merges a linked list of bytes
in the order of a heap of pair ranks. Pre-tokens recur, so every worker remembers a bounded
number of them. All of it is a function of the row: no shuffle, and a lost task is run again.
"""

import base64
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardfit.functions.shared import Shared
from shardfit.llm.common import Remembered, list_array, slices, texts_of

REMEMBERED = 350_000  # pre-tokens in each of the two generations that a worker keeps
KEYS_PER_BUCKET = 4
_WORD = (1 << 64) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their rank from a file of `base64 rank` lines."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


def _slots(hashes: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
    """Slot of each key under a displacement: one multiply and xor-shift round."""
    with np.errstate(over="ignore"):
        x = (hashes ^ (shift.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(n)).astype(np.int64)


def _slot(h: int, shift: int, n: int) -> int:
    """The same for one key."""
    x = (h ^ (shift * 0x9E3779B97F4A7C15 & _WORD)) * 0xD6E8FEB86659FD93 & _WORD
    return (x ^ (x >> 32)) % n


class PerfectHash:
    """Minimal perfect hash: n keys fill n slots; a lookup confirms the key in its slot.

    Keys fall into buckets; a bucket stores the displacement under which all its keys find
    free slots. Buckets of one key store their slot itself, as a negative number.
    """

    def __init__(self, ranks: dict[bytes, int]):
        keys = list(ranks)
        self.n = n = len(keys)
        self.buckets = n // KEYS_PER_BUCKET + 1
        hashes = self._hashes(keys)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        starts = np.cumsum(sizes) - sizes
        self.shift = np.zeros(self.buckets, np.int64)
        free = np.ones(n, bool)
        at = np.zeros(n, np.int64)
        for b in np.argsort(-sizes, kind="stable"):
            own = order[starts[b]:starts[b] + sizes[b]]
            if len(own) < 2:
                break
            first = 0
            while True:
                tries = np.arange(first, first + 32)
                slots = _slots(hashes[own][None, :], tries[:, None], n)
                ranked = np.sort(slots, axis=1)
                fits = free[slots].all(axis=1) & (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
                if fits.any():
                    k = int(np.argmax(fits))
                    self.shift[b], at[own] = first + k, slots[k]
                    free[slots[k]] = False
                    break
                first += 32
        singles = np.flatnonzero(sizes == 1)
        left = np.flatnonzero(free)
        self.shift[singles] = -left[:len(singles)] - 1
        at[order[starts[singles]]] = left[:len(singles)]
        self.keys, self.values = [b""] * n, np.zeros(n, np.int64)
        for key, slot in zip(keys, at.tolist()):
            self.keys[slot], self.values[slot] = key, ranks[key]
        self.shift, self.values = self.shift.tolist(), self.values.tolist()

    @staticmethod
    def _hashes(keys) -> np.ndarray:
        digest = xxhash.xxh3_64_intdigest
        return np.fromiter((digest(k) for k in keys), np.uint64, len(keys))

    def find(self, key: bytes) -> int:
        """Rank of a key, -1 where it is not in the vocabulary."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        shift = self.shift[h % self.buckets]
        slot = -shift - 1 if shift < 0 else _slot(h, shift, self.n)
        return self.values[slot] if self.keys[slot] == key else -1


class Codec:
    """Vocabulary, perfect hash and pre-token pattern; travels to tasks as one broadcast."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, hash: PerfectHash | None = None):
        self.ranks, self.pattern = ranks, pattern
        self.hash = hash or PerfectHash(ranks)
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.pairs = [-1] * (1 << 16)  # rank of every two bytes
        for token, rank in ranks.items():
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = rank
        size = np.array([len(t) for t in self.bytes], np.int32)
        self._flat = np.frombuffer(b"".join(self.bytes), np.uint8), np.cumsum(size, dtype=np.int32) - size, size
        self._find = regex.compile(pattern).findall
        self._seen = Remembered(self._lookup, REMEMBERED)

    def __reduce__(self):
        return Codec, (self.ranks, self.pattern, self.hash)

    def _lookup(self, word: str) -> bytes:
        """Ids of a pre-token as little-endian 32-bit integers: first tier, else second."""
        raw = word.encode()
        rank = self.hash.find(raw)
        return pack("<i", rank) if rank >= 0 else self.merged(raw)

    def merged(self, word: bytes) -> bytes:
        """Merge the pair of lowest rank, the leftmost among equals, until none is left."""
        ranks, n = self.ranks, len(word)
        bits = n.bit_length()
        low = (1 << bits) - 1
        stop = list(range(1, n + 1))   # end of the part that starts here
        before = list(range(-1, n))    # start of the part to the left
        get = ranks.get
        first = self.pairs
        heap = [((r << bits | i) << bits) + i + 2
                for i, (a, b) in enumerate(zip(word, word[1:])) if (r := first[a << 8 | b]) >= 0]
        heapify(heap)                  # rank, start and end in one number
        while heap:
            top = heappop(heap)
            end, i = top & low, top >> bits & low
            middle = stop[i]
            if middle >= end or stop[middle] != end:
                continue  # one of the two parts has grown or gone
            stop[i], stop[middle] = end, n + 1
            if end < n:
                before[end] = i
                last = stop[end]
                if (r := get(word[i:last])) is not None:
                    heappush(heap, ((r << bits | i) << bits) + last)
            if i and (r := get(word[(j := before[i]):end])) is not None:
                heappush(heap, ((r << bits | j) << bits) + end)
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i:stop[i]]])
            i = stop[i]
        return pack(f"<{len(out)}i", *out)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        """Ids of all texts in one array, and the number of ids of each text."""
        find = regex.compile(self.pattern).findall
        self._seen.turn()
        seen, find = self._seen.__getitem__, self._find
        parts = [b"".join(map(seen, find(t))) for t in texts]
        return np.frombuffer(b"".join(parts), "<i4"), [len(p) // 4 for p in parts]

    def decode(self, ids: np.ndarray, lengths) -> list[bytes]:
        """Bytes of lists of ids that stand one after the other, with the given lengths."""
        flat, start, size = self._flat
        sizes = size[ids]
        ends = np.cumsum(sizes, dtype=np.int64)
        take = np.repeat((start[ids] - (ends - sizes)).astype(np.int32), sizes)
        take += np.arange(len(take), dtype=np.int32)
        raw = flat[take].tobytes()
        cuts = np.r_[0, ends][np.r_[0, np.cumsum(lengths)]].tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def encode(docs: DataFrame, code: Codec, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key, ids array<int>` of every row.

    Null and empty texts give an empty list. Every input row gives one output row, equal
    rows and null keys included. Other columns are not read, so their names cannot clash.
    """
    shared = Shared(docs.sparkSession, code)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                ids, lengths = shared.value.encode(texts_of(part))
                yield pa.RecordBatch.from_arrays([part.column("key"), list_array(ids, lengths)], ["key", "ids"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(coded: DataFrame, code: Codec, key: str = "doc_id") -> DataFrame:
    """`key, ids, bytes` of every row of `key, ids`; null ids count as none."""
    shared = Shared(coded.sparkSession, code)
    rows = coded.select(F.col(key).alias("key"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "ids", 1 << 20):
                ids = part.column("ids")
                raw = shared.value.decode(ids.flatten().to_numpy(), ids.value_lengths().to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("ids"), pa.array(raw, pa.binary())], ["key", "ids", "bytes"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, ids array<int>, bytes binary").withColumnRenamed("key", key)


def digests(coded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and SHA-256 of ids and decoded bytes."""
    return coded.select(
        key, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


