"""Near-duplicate documents by Order MinHash.

A document is the sequence of its lower-case words; its k-mers are runs of five words, each
labelled by its occurrence, so repeats count. A sketch keeps, under one hash function, the
few smallest labelled k-mers in the order of the text: two documents share it if they share
these k-mers in this order, which moved text does not. Several sketches make a document meet
its near copies in at least one bucket.

Short documents have too few k-mers for that. Up to SHORT of them a document has a bucket for
each of its first labelled k-mers in one order of hashes, as many as it can miss and one more:
two documents at the threshold share one of these for certain. Documents that are longer, but
may be alike a short one, have both kinds of buckets.

Candidates are verified by banded alignment of their k-mers: with L k-mers in the best
common order of sequences of n and m, the similarity is L / (n + m - L). At the threshold no
match can lie further off the diagonal than the band; only a window of bits about the diagonal
is held, so memory is linear in the texts. Before any words are moved, pairs are
told apart by one byte of the smallest value under each hash function. Documents with equal
words are one text; only distinct texts meet. In a bucket all texts are first compared with
its first one, and the links found so far are joined into components. Buckets that still hold
several components are cut into chunks, and every pair of chunks is a group of its own, in
which all pairs of different components are compared. So each pair that shares a bucket is
either compared or already joined; groups are bounded, and pairs never become rows.
"""

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardfit.functions.sizes import broadcast_if_small
from shardfit.functions.shared import give_back
from shardfit.llm.common import Remembered, fresh, keep, slices, texts_of, written
from shardfit.llm.components import components

K = 5             # words of a k-mer
TABLES = 48       # sketches of a document
KEPT = 8          # k-mers of a sketch; at similarity 0.8 all tables miss a long text once in 6 800
SHORT = 40        # k-mers; if either text has at most so many, no bucket is missed
CHUNK = 512       # texts of a bucket that are compared with as many others at once,
CHUNK_BYTES = 4 << 20  # or fewer, if they have more than so many bytes of words
THRESHOLD = 0.8
REMEMBERED = 200_000
FEW = 8           # places of a k-mer that are set one by one
_WORDS = re.compile(r"\w+")
_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SEEDS = np.random.default_rng(11).integers(1, 1 << 63, TABLES, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def kmers(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of K words; fewer words make one run."""
    x = words.astype(np.uint64)
    n = max(1, len(x) - K + 1)
    out = np.full(n, len(x) if len(x) < K else K, np.uint64)
    for i in range(min(K, len(x))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + x[i:i + n]
    return _mixed(out)


def sketches(words: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """One number for each bucket of a document."""
    return signed(words, threshold)[0]


def signed(words: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """The buckets, and one byte for each hash function: of its smallest value.

    A bucket is told by the smallest labelled k-mers under a hash function, in text order, or
    by one of a short text's first k-mers.
    """
    runs = kmers(words)
    n = len(runs)
    order = np.argsort(runs, kind="stable")
    ranked = runs[order]
    first = np.r_[True, ranked[1:] != ranked[:-1]]
    place = np.arange(n)
    label = np.empty(n, np.uint64)
    label[order] = place - np.maximum.accumulate(np.where(first, place, 0))
    labelled = _mixed(runs + label * _MIX[1])
    drawn = _mixed(labelled[None, :] ^ _SEEDS[:, None])
    found = []
    if n > SHORT:
        lowest = np.sort(np.argpartition(drawn, KEPT - 1, axis=1)[:, :KEPT], axis=1)
        out = _SEEDS.copy()
        for column in lowest.T:
            out = _mixed(out * np.uint64(31) + labelled[column])
        found.append(out)
    if n * threshold <= SHORT + 1e-6:  # may be alike a text of SHORT k-mers
        missing = n - int(np.ceil(n * threshold - 1e-6))
        found.append(np.sort(labelled)[:missing + 1])
    return np.concatenate(found).view(np.int64), (drawn.min(axis=1) >> np.uint64(16)).astype(np.uint8)


def aligned(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> bool:
    """Whether the banded alignment of the k-mers of two documents reaches the threshold."""
    return _alike(kmers(a), kmers(b), threshold)


def _alike(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """The same of two sequences of k-mers."""
    n, m = len(a), len(b)
    need = threshold / (1 + threshold) * (n + m)  # smallest L with L / (n + m - L) >= threshold
    need -= 1e-9 * (n + m)
    if min(n, m) < need:
        return False
    a, b = a.tolist(), b.tolist()
    if _common(a, b) < need:
        return False
    band = int(n + m - 2 * need)  # k-mers left out at most, so the farthest diagonal
    width = 2 * band + 1
    places: dict[int, list[int]] = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    # at most 64 k-mers are as common as this; only they have bits of the whole sequence
    common = {x: _bits(at, 0, n) for x, at in places.items() if len(at) > max(FEW, n / 64)}
    # bit k is place j - band + k; what leaves the window at its low end does not change any more
    full = row = (1 << width) - 1
    found = 0
    for j, y in enumerate(b):
        at = places.get(y)
        if at is not None:
            low = j - band
            if y in common:
                hits = (common[y] >> low if low >= 0 else common[y] << -low) & full
            else:
                hits = _bits(at[bisect_left(at, low):bisect_right(at, j + band)], low, width)
            taken = row & hits
            row = (row + taken | row - taken) & full
        found += not row & 1
        row = row >> 1 | 1 << width - 1
    return found + width - row.bit_count() >= need


def _bits(places: list[int], low: int, width: int) -> int:
    """Whole number with a bit for each place, counted from `low`."""
    if len(places) <= FEW:
        out = 0
        for i in places:
            out |= 1 << i - low
        return out
    marks = np.zeros(width, np.uint8)
    marks[np.array(places) - low] = 1
    return int.from_bytes(np.packbits(marks, bitorder="little").tobytes(), "little")


def _common(a: list, b: list) -> int:
    """Size of the intersection with repeats: no alignment can keep more."""
    left, right = set(a), set(b)
    if len(left) == len(a) or len(right) == len(b):
        return len(left & right)
    counts: dict = {}
    for x in a:
        counts[x] = counts.get(x, 0) + 1
    found = 0
    for y in b:
        if counts.get(y, 0):
            counts[y] -= 1
            found += 1
    return found


def sketched(docs: DataFrame, key="doc_id", text="text", threshold: float = THRESHOLD) -> DataFrame:
    """`row, key, mark, print, words, sketches, lowest` of every document, written once to the shared folder.

    `row` numbers the rows, `mark` is a hash of the text as it stands, `print` tells sequences
    of words apart and is null without words, `words` has 32-bit hashes.
    """
    body = F.col(text).cast("string")
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.xxhash64(body).alias("mark"), body.alias("text"))

    def run(batches):
        hashed = Remembered(lambda w: xxhash.xxh3_64_intdigest(w) >> 32, REMEMBERED)
        row, get = TaskContext.get().partitionId() << 40, hashed.__getitem__
        for batch in batches:
            for part in slices(batch, "text"):
                hashed.turn()
                raw, prints, found, marks = [], [], [], []
                for t in texts_of(part):
                    words = np.fromiter(map(get, _WORDS.findall(t.lower())), np.uint32)
                    raw.append(words.tobytes())
                    prints.append(xxhash.xxh3_128_digest(raw[-1]) if len(words) else None)
                    both = signed(words, threshold) if len(words) else (None, None)
                    found.append(both[0])
                    marks.append(both[1].tobytes() if len(words) else None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + len(raw))), part.column("key"), part.column("mark"),
                     pa.array(prints, pa.binary()), pa.array(raw, pa.binary()), pa.array(found, pa.list_(pa.int64())),
                     pa.array(marks, pa.binary())],
                    ["row", "key", "mark", "print", "words", "sketches", "lowest"])
                row += len(raw)
        hashed.forget()
        give_back()

    return keep(rows.mapInArrow(run, "row long, key long, mark long, print binary, words binary, sketches array<long>, "
                                      "lowest binary"))


def _beside(pairs: DataFrame, texts: DataFrame, column: str) -> DataFrame:
    """`row, first, a, b`: a column of both rows of every pair."""
    left = texts.select("row", F.col(column).alias("a"))
    right = texts.select(F.col("row").alias("first"), F.col(column).alias("b"))
    # both joins may be split where one row has very many partners
    loaded = pairs.join(left.hint("merge"), "row").join(right.hint("merge"), "first")
    return loaded.select("row", "first", "a", "b")


def _plausible(pairs: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """Pairs that share the smallest values of enough hash functions; tells unlike texts apart by 32 bytes."""

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, TABLES) for c in "ab")
            alike = pa.array((a == b).sum(axis=1) >= least)
            yield batch.select(["row", "first"]).filter(alike)

    return _beside(pairs, texts, "lowest").mapInArrow(run, "row long, first long")


def _verified(pairs: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """`row, first, alike` of pairs of rows."""
    loaded = _beside(pairs, words, "words")

    def run(batches):
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in "ab")
            alike = [aligned(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), threshold) for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("first"), pa.array(alike, pa.bool_())],
                                             ["row", "first", "alike"])

    return loaded.mapInArrow(run, "row long, first long, alike boolean")


def _groups(batches):
    """Tables of one group each out of batches sorted by group; a group is bounded, so one is held at a time."""
    held = None
    for batch in batches:
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        if not held.num_rows:
            continue
        keys = np.stack([held.column(c).to_numpy() for c in ("bucket", "i", "j")])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for start, stop in zip(np.r_[0, cuts[:-1]], cuts):
            yield held.slice(start, stop - start)
        held = held.slice(cuts[-1]) if len(cuts) else held  # the last group may go on in the next batch
    if held is not None and held.num_rows:
        yield held


def _candidates(group: pa.Table, least: int) -> list[tuple[int, int]]:
    """Places of pairs of a group that have to be compared, the likeliest first.

    These are pairs of different components and, in a group of two chunks, of different chunks,
    that share enough smallest values. Pairs with the bucket's first text have been compared
    before; a pair belongs to the smallest bucket that it shares.
    """
    bucket, i, j = (group.column(c)[0].as_py() for c in ("bucket", "i", "j"))
    chunk, part = group.column("chunk").to_numpy(), group.column("part").to_numpy()
    lowest = np.frombuffer(b"".join(group.column("lowest").to_pylist()), np.uint8).reshape(-1, TABLES)
    fit = group.column("row").to_numpy() != group.column("first").to_numpy()
    left, right = np.flatnonzero(fit & (chunk == i)), np.flatnonzero(fit & (chunk == j))
    agree = np.zeros((len(left), len(right)), np.uint8)
    for table in range(TABLES):
        agree += lowest[left, table][:, None] == lowest[right, table][None, :]
    near = (agree >= least) & (part[left][:, None] != part[right][None, :])
    if i == j:
        near = np.triu(near, 1)
    x, y = np.nonzero(near)
    order = np.argsort(-agree[x, y].astype(int), kind="stable")
    lists, before = group.column("sketches"), {}

    def earlier(place: int) -> set:
        if place not in before:
            before[place] = {c for c in lists[place].as_py() if c < bucket}
        return before[place]

    pairs = zip(left[x[order]].tolist(), right[y[order]].tolist())
    return [(a, b) for a, b in pairs if earlier(a).isdisjoint(earlier(b))]


def _joined(group: pa.Table, least: int, threshold: float) -> list[tuple[int, int]]:
    """Links of a group that join different components; what they join is not compared again."""
    row, part, words = group.column("row").to_pylist(), group.column("part").to_pylist(), group.column("words")
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    runs, found = {}, []
    for pair in _candidates(group, least):
        a, b = (root(part[place]) for place in pair)
        if a == b:
            continue
        for place in pair:
            if place not in runs:
                runs[place] = kmers(np.frombuffer(words[place].as_py(), np.uint32))
        if _alike(runs[pair[0]], runs[pair[1]], threshold):
            parent[a] = b
            found.append((row[pair[0]], row[pair[1]]))
    return found


def _rest(members: DataFrame, known: DataFrame, texts: DataFrame, least: int, threshold: float) -> DataFrame:
    """Links `a, b` between components of `known`, from all pairs in the buckets `row, bucket, first`."""
    parts = components(known).select(F.col("node").alias("row"), F.col("component").alias("part"))
    sizes = texts.select("row", F.length("words").alias("bytes")).join(parts.hint("merge"), "row", "left").select(
        "row", "bytes", F.coalesce("part", "row").alias("part"))
    placed = keep(members.join(sizes.hint("merge"), "row"), narrow=True)
    mixed = placed.groupBy("bucket").agg(
        F.count("*").alias("size"), F.sum("bytes").alias("bytes"),
        F.count_if(F.col("row") != F.col("first")).alias("others"),
        F.min(F.when(F.col("row") != F.col("first"), F.col("part"))).alias("low"),
        F.max(F.when(F.col("row") != F.col("first"), F.col("part"))).alias("high"),
    ).where("others > 1 and low != high")
    chunks = F.ceil(F.greatest(F.col("size") / CHUNK, F.col("bytes") / CHUNK_BYTES)).cast("int")
    met = placed.drop("bytes").join(mixed.select("bucket", chunks.alias("chunks")).hint("merge"), "bucket").withColumn(
        "chunk", F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select("row", "bucket", "first", "part", "chunk", F.least("chunk", "other").alias("i"),
                     F.greatest("chunk", "other").alias("j"))
    names = met.columns
    schema = "row long, bucket long, first long, part long, chunk int, i int, j int"

    def loaded(rows: DataFrame, *columns: str) -> DataFrame:
        joined = rows.join(texts.select("row", *columns).hint("merge"), "row")
        return joined.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def choose(batches):  # texts that have a partner: only their words are moved
        for group in _groups(batches):
            places = sorted({place for pair in _candidates(group, least) for place in pair})
            if places:
                yield from group.select(names).take(places).combine_chunks().to_batches()

    def compare(batches):
        for group in _groups(batches):
            found = _joined(group, least, threshold)
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    chosen = written(loaded(met, "lowest", "sketches").mapInArrow(choose, schema))
    return written(loaded(chosen, "lowest", "sketches", "words").mapInArrow(compare, "a long, b long"))


def links(texts: DataFrame, words: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Verified links `a, b` between distinct texts, which join all that share a bucket and are alike.

    `texts` has `row, sketches`; `words` has `row, words, lowest, sketches`.
    """
    placed = texts.select("row", F.explode("sketches").alias("bucket"))
    firsts = placed.groupBy("bucket").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1")
    members = keep(placed.hint("merge").join(firsts.select("bucket", "first").hint("merge"), "bucket").select(
        "row", "bucket", "first"), narrow=True)
    # the words of texts that share a bucket with another one
    rows = keep(members.select("row").distinct(), narrow=True)
    needed = keep(words.join(broadcast_if_small(rows, rows.count()), "row", "left_semi"), narrow=True)
    # texts at the threshold share so many smallest values but once in two million pairs
    least = max(0, int(TABLES * threshold - 5 * (TABLES * threshold * (1 - threshold)) ** 0.5))
    pairs = members.where("row != first").select("row", "first").distinct()
    checked = written(_verified(_plausible(pairs, needed, least), needed, threshold))
    known = checked.where("alike").select(F.col("row").alias("a"), F.col("first").alias("b"))
    return known.unionByName(_rest(members, known, needed, least, threshold))


def classes(docs: DataFrame, threshold: float = THRESHOLD, key="doc_id", text="text") -> DataFrame:
    """`row, key, mark, class_id, kept` of every document; `row` and `mark` as in `sketched`.

    A class holds documents that are connected by links; `class_id` is its smallest key, and
    exactly one row of each class is kept, the first one with that key. Rows without words
    (null, empty, signs only) are classes of their own. Null keys come after all others; rows
    with equal keys are documents of their own. Other columns are not read.
    """
    rows = sketched(docs, key, text, threshold)
    rank = F.struct(F.col("key").isNull().alias("none"), "key", "row")
    best = rows.where("print is not null").groupBy("print").agg(F.min(F.struct(rank.alias("best"), "sketches")).alias("m"))
    texts = keep(best.select("print", "m.best", F.col("m.best.row").alias("row"), "m.sketches"), narrow=True)
    joined = components(links(texts.select("row", "sketches"), rows.select("row", "words", "lowest", "sketches"), threshold))
    named = texts.join(joined.withColumnRenamed("node", "row"), "row", "left").select(
        "print", "best", F.coalesce("component", "row").alias("component"))
    heads = named.groupBy("component").agg(F.min("best").alias("head"))
    heads = named.join(heads, "component").select("print", "head")
    return rows.select("row", "key", "mark", "print").join(heads.hint("merge"), "print", "left").select(
        "row", "key", "mark", F.when(F.col("head").isNull(), F.col("key")).otherwise(F.col("head.key")).alias("class_id"),
        F.coalesce(F.col("head.row") == F.col("row"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD, key="doc_id", text="text") -> DataFrame:
    """The table with one document of each class, all columns as they were.

    Rows with equal key and text are one document of which the first met is kept.
    """
    mark = fresh(docs, "_mark")
    marked = docs.withColumn(mark, F.xxhash64(F.col(text).cast("string")))
    found = classes(docs, threshold, key, text).groupBy("key", "mark").agg(
        F.max("kept").alias("kept"), F.count("*").alias("n"))
    odd = keep(found.where("not kept or n > 1"), narrow=True)
    gone, repeated = (broadcast_if_small(part, part.count()) for part in (odd.where("not kept"), odd.where("kept and n > 1")))

    def same(other: DataFrame):
        return F.col(key).cast("bigint").eqNullSafe(other["key"]) & (F.col(mark) == other["mark"])

    left = marked.join(gone, same(gone), "left_anti")
    again = left.join(repeated, same(repeated), "left_semi").dropDuplicates([key, mark])
    return left.join(repeated, same(repeated), "left_anti").unionByName(again).drop(mark)
