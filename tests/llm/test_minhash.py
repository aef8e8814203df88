"""Order MinHash against alignment of all pairs; components against union-find."""

import random
import tracemalloc

import numpy as np

from shardfit.llm import ordered_minhash as om
from shardfit.llm.components import components


def longest_common(a, b):
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
    return best[-1, -1]


def test_alignment():
    draw = np.random.default_rng(0)
    alike = 0
    for t in range(150):
        a = draw.integers(0, [5, 1000][t % 2], draw.integers(1, 60)).astype(np.uint32)
        b = a.copy()
        for _ in range(draw.integers(0, 4)):
            i = draw.integers(0, len(b))
            b = np.insert(b, i, draw.integers(0, 1000)) if draw.integers(0, 2) else np.delete(b, i) if len(b) > 1 else b
        x, y = om.kmers(a), om.kmers(b)
        common = longest_common(x, y)
        want = common / (len(x) + len(y) - common) >= 0.8 - 1e-9
        assert om.aligned(a, b) == want
        alike += want
    assert 20 < alike < 140


def test_alignment_of_long_and_repetitive_texts():
    draw = np.random.default_rng(6)
    alike = 0
    for t in range(60):  # k-mers with few, many and very many places
        a = draw.integers(0, [2, 3, 4][t % 3], draw.integers(150, 400)).astype(np.uint32)
        b = a.copy()
        for _ in range(draw.integers(0, 12)):
            i = draw.integers(0, len(b))
            b = np.insert(b, i, draw.integers(0, 4)) if draw.integers(0, 2) else np.delete(b, i)
        x, y = om.kmers(a).tolist(), om.kmers(b).tolist()
        common = longest_common(x, y)
        want = common / (len(x) + len(y) - common) >= 0.8 - 1e-9
        assert om.aligned(a, b) == want
        alike += want
    assert 10 < alike < 60
    for n in (600, 1500):
        same = np.zeros(n, np.uint32)
        assert om.aligned(same, same[:int(n * 0.81)]) and not om.aligned(same, same[:int(n * 0.79)])


def test_memory_of_alignment_is_linear():
    a = np.arange(30_000, dtype=np.uint32)
    b = np.delete(a, [100, 20_000])
    tracemalloc.start()
    try:
        assert om.aligned(a, b)
        assert tracemalloc.get_traced_memory()[1] < 30 << 20
    finally:
        tracemalloc.stop()


def test_order_matters():
    a = np.arange(400, dtype=np.uint32)
    assert not om.aligned(a, np.roll(a, 200)) and om.aligned(a, a)


def words(draw, n):
    return [f"w{draw.randrange(10**6)}" for _ in range(n)]


def test_classes(spark):
    draw = random.Random(4)
    base = [words(draw, draw.randrange(60, 200)) for _ in range(30)]
    shared = words(draw, 70)
    rows, want = [], {}
    for i, w in enumerate(base):
        rows.append((i, " ".join(w)))
        want[i] = i
    for k in range(60):  # near copies of a few texts, one of them many times
        i = 0 if k < 40 else k % 7
        w = list(base[i])
        w[draw.randrange(len(w))] = "new" + str(k)
        rows.append((100 + k, " ".join(w)))
        want[100 + k] = i
    for k in range(20):  # a common passage does not make copies
        rows.append((200 + k, " ".join(words(draw, 60) + shared + words(draw, 60))))
        want[200 + k] = 200 + k
    rows += [(300, rows[0][1].upper() + "!"), (301, None), (302, ""), (303, "..."), (None, "a b c"), (1, rows[1][1])]
    want |= {300: 0, 301: 301, 302: 302, 303: 303, None: None}
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, row int").repartition(4)
    got = om.classes(docs).collect()
    assert len(got) == len(rows) and all(r["class_id"] == want[r["key"]] for r in got)
    kept = sorted(str(r["key"]) for r in got if r["kept"])
    assert kept == sorted(str(k) for k in {c for c in want.values()})
    left = om.deduplicated(docs)
    assert left.columns == docs.columns and sorted(str(r["doc_id"]) for r in left.collect()) == kept
    assert om.classes(docs.limit(0)).count() == 0


def test_many_unlike_texts_in_a_bucket(spark):
    draw = random.Random(9)
    passage = " ".join(words(draw, 200))
    rows = [(i, passage + " " + " ".join(words(draw, 60))) for i in range(25)]
    rows += [(100 + i, t + " end") for i, t in rows[:5]]
    got = {r["key"]: r["class_id"] for r in om.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(25)} | {100 + i: i for i in range(5)}


def closure(nodes, pairs):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def numbered(text):
    return np.array([om.xxhash.xxh3_64_intdigest(w) >> 32 for w in text.split()], np.uint32)


def test_large_group_about_the_threshold(spark, monkeypatch):
    """Every pair that shares a bucket and is alike is in one class, also beside a bucket's first text."""
    monkeypatch.setattr(om, "CHUNK", 16, raising=False)
    draw = random.Random(12)
    base, texts = words(draw, 120), []
    for k in range(160):
        w = list(base)
        for _ in range(2 + k % 2):
            w[draw.randrange(len(w))] = f"new{draw.randrange(10**6)}"
        texts.append(" ".join(w))
    x = [numbered(t) for t in texts]
    buckets = [set(om.sketches(w).tolist()) for w in x]
    links = [(a, b) for b in range(160) for a in range(b) if buckets[a] & buckets[b] and om.aligned(x[a], x[b])]
    want = closure(range(160), links)
    assert 20 < len(set(want.values())) < 140
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r["key"]: r["class_id"] for r in om.classes(docs).collect()} == want


def test_links_beside_the_first_text(spark):
    draw = random.Random(3)
    middle = words(draw, 120)
    first, last = list(middle), list(middle)
    first[20], first[40], last[60], last[80] = "x1", "x2", "x3", "x4"
    x = [numbered(" ".join(w)).astype(np.uint32) for w in (first, middle, last)]
    assert om.aligned(x[0], x[1]) and om.aligned(x[1], x[2]) and not om.aligned(x[0], x[2])
    rows = [(i, [7], bytearray(w.tobytes()), bytearray(om.signed(w)[1].tobytes())) for i, w in enumerate(x)]
    table = spark.createDataFrame(rows, "row long, sketches array<long>, words binary, lowest binary")
    found = {tuple(sorted(r)) for r in om.links(table.select("row", "sketches"), table).collect()}
    assert found == {(0, 1), (1, 2)}


def test_short_near_copies_share_a_bucket():
    draw = np.random.default_rng(8)
    alike = 0
    for n in [*range(1, 62)] * 8:
        a = draw.integers(0, [9, 10**6][n % 2], n).astype(np.uint32)
        b = np.insert(a, [0, n][draw.integers(0, 2)], draw.integers(0, 10**6)) if draw.integers(0, 3) else a.copy()
        if not draw.integers(0, 4):
            b[draw.integers(0, len(b))] = 10**6
        if len(om.kmers(a)) <= om.SHORT and om.aligned(a, b):
            alike += 1
            assert set(om.sketches(a)) & set(om.sketches(b)), (a, b)
    assert alike > 150


def test_short_near_copies(spark):
    """Against all pairs: texts of 4 to 27 words, some cut or longer by a word at an end."""
    draw = random.Random(21)
    texts = []
    for n in range(4, 26):
        w = words(draw, n)
        texts += [w, [*w, "more"], w[1:], ["so", *w, "more"]]
    x = [numbered(" ".join(t)).astype(np.uint32) for t in texts]
    want = closure(range(len(x)), [(a, b) for b in range(len(x)) for a in range(b) if om.aligned(x[a], x[b])])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r["key"]: r["class_id"] for r in om.classes(docs).collect()} == want


def test_components(spark):
    draw = random.Random(2)
    pairs = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    links = spark.createDataFrame([*pairs, (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    alone = {x for x in parent if find(x) == x and not any(find(y) == x for y in parent if y != x)}
    assert got == {x: find(x) for x in parent if x not in alone}
    assert components(links.limit(0)).count() == 0
