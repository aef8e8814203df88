"""Packing: every id once, gapless sequences, shares kept in every window."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shardfit.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def ids_of(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def test_words_match_the_library(tokenizer):
    texts = ["", "a\x1fb \x85x", "½² İI K 中文字 é don't DON'T 'S ªº ß ẞ Σς x’s", "<|endoftext|> a", "Å", "don't  stop\n\tnow 2048!!"]
    words = packing.Words(PATH, 1)
    for text, raw in zip(texts, words(texts)):
        assert np.frombuffer(raw, words.kind).tolist() == ids_of(tokenizer, text).tolist(), text


def check(pieces, docs, tokenizer, length):
    at, place = defaultdict(list), {}
    for p in pieces:
        at[p["doc_id"]].append(p)
        assert (p["sequence_id"], p["offset"]) not in place
        place[p["sequence_id"], p["offset"]] = p["length"]
        assert zlib.crc32(p["ids"]) >= 0 and len(p["ids"]) == 4 * p["length"]
    for key, text in docs.items():
        ids, own = ids_of(tokenizer, text), sorted(at[key], key=lambda p: p["start"])
        assert b"".join(bytes(p["ids"]) for p in own) == ids.tobytes()
        assert [p["start"] for p in own] == np.cumsum([0] + [p["length"] for p in own])[:-1].tolist()
        assert all(p["doc_tokens"] == len(ids) for p in own)
    total, sequence, offset = sum(place.values()), 0, 0
    for (s, o), n in sorted(place.items()):
        assert (s, o) == (sequence, offset)
        sequence, offset = (s + 1, 0) if o + n == length else (s, o + n)
        assert o + n <= length
    assert sequence * length + offset == total


@pytest.mark.parametrize("targets", [None, {"a": 3, "b": 1}])
def test_every_id_lies_in_one_piece(spark, tokenizer, targets):
    text = {i: " ".join(f"word{(i * j) % 97}" for j in range(3 + 7 * i % 60)) for i in range(40)} | {40: None, 41: "", 42: "long " * 3000}
    rows = [(i, t, "abc"[i % 3 if i < 30 else 0], 1) for i, t in text.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, ids int").repartition(5)
    got = packing.pack(docs, PATH, 64, 1, targets).collect()
    check(got, text, tokenizer, 64)
    if targets is None:
        total = sum(p["length"] for p in got)
        share = {s: sum(p["length"] for p in got if p["source"] == s) / total for s in "abc"}
        window = defaultdict(int)
        for p in got:
            window[p["sequence_id"], p["source"]] += p["length"]
        for w in range(total // 64):
            for s in "abc":
                assert abs(window[w, s] - 64 * share[s]) <= 2


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "one two", "a"), (1, "one two", "a"), (None, "x", None)], "doc_id long, text string, source string")
    got = packing.checksums(packing.pack(docs, PATH, 2048)).collect()
    assert sorted(str(p["doc_id"]) for p in got) == ["1", "1", "None"] and {p["sequence_id"] for p in got} == {0}
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_more_sources_than_tokens_of_a_window():
    totals = {f"={i}": 1 + i % 5 for i in range(300)} | {"=big": 5000}
    seen = defaultdict(int)
    for phase in packing.phases(totals, 16):
        for q, n in totals.items():
            for _, at, size in phase.pieces(q, 0, n):
                for k in range(at, at + size):
                    seen[k] += 1
    assert seen == {k: 1 for k in range(sum(totals.values()))}
