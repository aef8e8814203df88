"""Mixture-controlled packing of token sequences.

Every source is a queue of documents. Windows of `length` tokens are filled by deficit round
robin: in each round a queue earns its share of the window, spends whole tokens and carries
the remainder, so after any number of rounds it is less than one token off its target. What
a queue has spent after r rounds has a closed form, so each task finds the windows of its own
documents alone: deficits carry across windows and partitions without a task that sees all.
Documents are cut where a share ends; only the last sequence needs padding.

Queues run in the order (partition, row) of the tokenised table, which is written once. Sums
per partition and source give every document its place in its queue. If targets are given,
a queue may run dry before the others; the rest then share on in a new phase.
"""

import json
import re
from array import array
from fractions import Fraction
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from shardfit.functions.shared import Shared, give_back, per_process
from shardfit.functions.sizes import broadcast_if_small
from shardfit.llm.common import Remembered, keep, slices, texts_of

REMEMBERED_BYTES = 32 << 20  # strings and ids in each of the two generations that a worker keeps
ENTRY_BYTES = 180            # of a short string, its ids and their places in a table, about
TAIL = "rest"         # queue of the sources that earn less than one token per window

#: White space other than blank, tab and line ends, and characters that only some tools count so.
_RARE_SPACE = (*"\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B)))
#: Texts and words whose lower case and pieces can be told without the tokenizer's own normaliser.
_PLAIN = re.compile("[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\t-\r a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
#: The settings under which plain text falls into pieces as above.
_LOWER_CASE = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_LETTERS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Words:
    """Ids of texts under a tokenizer that drops white space, so pieces or words are coded one by one.

    Plain texts fall into pieces, which the tokenizer's model codes; a word with rarer characters
    goes through the whole tokenizer. One table, bounded by bytes, remembers both.
    """

    def __init__(self, path: str, end_id: int):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.kind = "<u2" if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        self.code = "H" if self.kind == "<u2" else "I"
        self.end = np.array([end_id], self.kind).tobytes()
        self.pieces = Remembered(self._piece, REMEMBERED_BYTES // ENTRY_BYTES)
        settings = json.loads(self.tokenizer.to_str())
        splits = (settings["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.by_pieces = settings["normalizer"] == _LOWER_CASE and splits[0].get("pattern") == {"Regex": _LETTERS}
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.alphabet = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        """A piece of a plain text, or a word with other characters."""
        if not self.by_pieces:
            return self._whole(piece)
        if not piece.isascii():
            if not _PLAIN.fullmatch(piece):
                return self._whole(piece)
            piece = piece.translate(self.alphabet)
        return array(self.code, [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _text(self, text: str) -> bytes:
        self.pieces.turn()
        known = self.pieces.__getitem__
        if self.by_pieces and _PLAIN.fullmatch(text):
            return b"".join(map(known, _PIECES.findall(text.lower())))
        if not text.isascii() and any(c in text for c in _RARE_SPACE) or any(c in text for c in _RARE_SPACE[:4]):
            return self._whole(text)
        if not self.by_pieces:
            return b"".join(map(known, text.split()))
        return b"".join(self._text(word) if _PLAIN.fullmatch(word) else known(word) for word in text.split())

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [self._text(t) + self.end for t in texts]


def tokenised(docs: DataFrame, path: str, end_id: int, key="doc_id", text="text", source="source") -> DataFrame:
    """`key, queue, part, before, n, ids` of every row, written once to the shared folder.

    `before`: tokens of the same queue earlier in the partition. `ids`: little-endian, two
    bytes each if the vocabulary allows, else four. The number of tokens is at least one, as
    `end_id` closes every document. A null source is a queue of its own.
    """
    queue = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))
    rows = docs.select(F.col(key).alias("key"), queue.alias("queue"), F.col(text).cast("string").alias("text"))

    def run(batches):
        give_back()
        words, part, sums = _words(path, end_id), TaskContext.get().partitionId(), {}
        for batch in batches:
            width = np.dtype(words.kind).itemsize
            for piece in slices(batch, "text"):
                ids = words(texts_of(piece))
                counts = [len(i) // width for i in ids]
                before = []
                for q, n in zip(piece.column("queue").to_pylist(), counts):
                    before.append(sums.get(q, 0))
                    sums[q] = before[-1] + n
                yield pa.RecordBatch.from_arrays(
                    [piece.column("key"), piece.column("queue"), pa.array([part] * len(ids), pa.int32()),
                     pa.array(before, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                    ["key", "queue", "part", "before", "n", "ids"])
        give_back()

    kind = rows.schema["key"].dataType.simpleString()
    return keep(rows.mapInArrow(run, f"key {kind}, queue string, part int, before long, n long, ids binary"))


def _words(path: str, end_id: int) -> Words:
    """One tokenizer, with what it remembers, per worker process."""
    return per_process(("words", path, end_id), lambda: Words(path, end_id))


class Phase:
    """A stretch of the packed stream in which a fixed set of queues shares every round.

    Queues that would earn less than one token per round follow each other in one group, so
    that every group moves on in every round.
    """

    def __init__(self, start: int, taken: dict, counts: dict, length: int):
        self.start, self.length = start, length
        self.total = sum(counts.values())
        groups: list[list] = []
        for q in sorted((q for q in counts if counts[q]), key=lambda q: (-counts[q], q)):
            small = groups and groups[-1][1] * length < self.total
            if small:
                groups[-1][0].append(q)
                groups[-1][1] += counts[q]
            else:
                groups.append([[q], counts[q]])
        if len(groups) > 1 and groups[-1][1] * length < self.total:
            last = groups.pop()
            groups[-1][0] += last[0]
            groups[-1][1] += last[1]
        self.sums = [0, *accumulate(g[1] for g in groups)]
        self.at = {}  # queue -> group, place in the group, first and last token of the queue
        for g, (members, _) in enumerate(groups):
            place = 0
            for q in members:
                self.at[q] = (g, place, taken.get(q, 0), taken.get(q, 0) + counts[q])
                place += counts[q]

    def spent(self, edge: int, r: int) -> int:
        """Tokens that the groups before this edge have spent after r rounds."""
        return min(r * self.length, self.total) * self.sums[edge] // self.total

    def pieces(self, queue: str, first: int, last: int):
        """(token of the queue, place in the packed stream, count) of tokens first..last-1."""
        if queue not in self.at:
            return
        g, place, start, stop = self.at[queue]
        first, last = max(first, start), min(last, stop)
        if first >= last:
            return
        shift = place - start  # token of the queue -> token of the group
        x, end = first + shift, last + shift
        share = self.sums[g + 1] - self.sums[g]
        r = max(0, x * self.total // (self.length * share) - 2)
        while self.spent(g + 1, r + 1) - self.spent(g, r + 1) <= x:
            r += 1
        low, done = self.spent(g, r), self.spent(g + 1, r) - self.spent(g, r)
        before, after, total, length, start = self.sums[g], self.sums[g + 1], self.total, self.length, self.start
        while x < end:
            r += 1
            spent = min(r * length, total)
            low1 = spent * before // total
            done1 = spent * after // total - low1
            if done1 > x:
                stop = min(end, done1)
                yield x - shift, start + (r - 1) * length + (low1 - low) + (x - done), stop - x
                x = stop
            low, done = low1, done1


def phases(totals: dict[str, int], length: int, targets: dict[str, float] | None = None) -> list[Phase]:
    """Phases that use up all tokens. Without targets every queue keeps its share of the whole.

    `targets` gives weights by source (0 or absent: after all others). When the first queue of
    a phase runs dry, the others share on by their weights.
    """
    left = {q: n for q, n in totals.items() if n > 0}
    weight = {q: Fraction(n) if targets is None else Fraction(str(targets.get(q.removeprefix("="), 0)))
              for q, n in left.items()}
    taken: dict[str, int] = {}
    out, start = [], 0
    while left:
        active = {q: weight[q] for q in left if weight[q] > 0} or {q: Fraction(left[q]) for q in left}
        rounds = min(left[q] / w for q, w in active.items())
        counts = {q: min(left[q], int(w * rounds)) for q, w in active.items()}
        counts = {q: n for q, n in counts.items() if n}
        out.append(Phase(start, dict(taken), counts, length))
        for q, n in counts.items():
            taken[q] = taken.get(q, 0) + n
            left[q] -= n
        left = {q: n for q, n in left.items() if n}
        start += sum(counts.values())
    return out


def pack(docs: DataFrame, path: str, length: int = 2048, end_id: int = 1,
         targets: dict[str, float] | None = None, key="doc_id", text="text", source="source") -> DataFrame:
    """Cut all documents into pieces and place them in sequences of at most `length` tokens.

    Columns: key, source, start, length, ids (binary, unsigned little-endian 32-bit),
    doc_tokens, sequence_id, offset. A null or empty text is one piece that holds `end_id`;
    rows with equal or null keys are documents of their own; an empty table gives no piece.
    Other columns are not read. Sources that earn less than one token per window share the
    queue `rest` and follow each other there; so at most `length` sums reach the driver.
    """
    spark = docs.sparkSession
    rows = tokenised(docs, path, end_id, key, text, source)
    sums = keep(rows.groupBy("queue", "part").agg(F.sum("n").alias("n")))
    by_source = sums.groupBy("queue").agg(F.sum("n").alias("n"))
    total = sums.agg(F.sum("n")).first()[0] or 0
    named = by_source.where(F.col("n") * length >= F.lit(total)) if targets is None else \
        by_source.where(F.col("queue").isin([f"={s}" for s in targets]))
    totals = {r["queue"]: r["n"] for r in named.collect()}
    if total > sum(totals.values()):
        totals[TAIL] = total - sum(totals.values())
    plan = Shared(spark, phases(totals, length, targets))
    big = F.col("queue").isin([q for q in totals if q != TAIL])
    order = Window.partitionBy("lane").orderBy("queue", "part").rowsBetween(Window.unboundedPreceding, -1)
    places = sums.withColumn("lane", F.when(big, F.col("queue")).otherwise(F.lit(TAIL))).select(
        "queue", "part", "lane", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("place"))
    placed = rows.join(broadcast_if_small(places, sums.count()), ["queue", "part"])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "ids"):
                yield _cut(part, plan.value, length)

    kind = rows.schema["key"].dataType.simpleString()
    out = placed.select("key", "queue", "lane", (F.col("place") + F.col("before")).alias("place"), "n", "ids").mapInArrow(
        run, f"key {kind}, queue string, start long, length long, ids binary, doc_tokens long, "
             "sequence_id long, offset long")
    return out.select(
        F.col("key").alias(key), F.when(F.col("queue") != "null", F.expr("substr(queue, 2)")).alias("source"),
        "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


def _cut(rows: pa.RecordBatch, plan: list[Phase], length: int) -> pa.RecordBatch:
    row, start, count, ids, seq, offset = [], [], [], [], [], []
    columns = [rows.column(c).to_pylist() for c in ("lane", "place", "n", "ids")]
    for i, (lane, place, n, raw) in enumerate(zip(*columns)):
        wide = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4").tobytes()
        for phase in plan:
            for token, at, size in phase.pieces(lane, place, place + n):
                while size:  # a round may straddle two sequences after an uneven phase
                    sequence, inside = divmod(at, length)
                    take = size if inside + size <= length else length - inside
                    first = token - place
                    row.append(i)
                    start.append(first)
                    count.append(take)
                    ids.append(wide[4 * first:4 * (first + take)])
                    seq.append(sequence)
                    offset.append(inside)
                    token, at, size = token + take, at + take, size - take
    row = pa.array(row, pa.int64())
    return pa.RecordBatch.from_arrays(
        [rows.column("key").take(row), rows.column("queue").take(row), pa.array(start, pa.int64()),
         pa.array(count, pa.int64()), pa.array(ids, pa.binary()), rows.column("n").take(row),
         pa.array(seq, pa.int64()), pa.array(offset, pa.int64())],
        ["key", "queue", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def checksums(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """The pieces with a CRC-32 in place of their ids."""
    return pieces.select(key, "source", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")
