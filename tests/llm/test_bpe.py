"""Byte-level BPE against the tiktoken library."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from shardfit.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def code():
    return bpe.codec(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(code):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=code.ranks, special_tokens={})


def test_perfect_hash_is_minimal(code):
    assert sorted(code.hash.values) == sorted(code.ranks.values())
    assert all(code.hash.find(k) == r for k, r in code.ranks.items())
    assert code.hash.find(b"not in the vocabulary at all") == -1
    assert bpe.PerfectHash({}).find(b"a") == -1


def test_random_texts(code, library):
    draw = random.Random(3)
    signs = ["a", "B", "é", " ", "  ", "\n", "\t", "'s", "9", "!", "\x1c", "\xa0", "中", "\r\n", "the", "🎉"]
    texts = ["".join(draw.choices(signs, k=draw.randrange(14))) for _ in range(3000)]
    ids, lengths = code.encode(texts)
    at = 0
    for t, n in zip(texts, lengths):
        assert library.encode_ordinary(t) == ids[at:at + n].tolist(), t
        at += n
    assert code.decode(ids, lengths) == [t.encode() for t in texts]


def test_long_word(code, library):
    text = "ab" * 4000 + "x" * 5000
    assert library.encode_ordinary(text) == code.encode([text])[0].tolist()


def test_table(spark, code, library):
    rows = [(1, "Hello  world", 5), (1, "Hello  world", 6), (None, "x", 7), (2, None, 8), (3, "", 9), (4, "é " * 9000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = bpe.digests(bpe.decode(bpe.encode(docs, code), code)).collect()
    want = []
    for key, text, _ in rows:
        ids = library.encode_ordinary(text or "")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((key, len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.decode(bpe.encode(docs.limit(0), code), code).count() == 0
