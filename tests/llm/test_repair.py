"""Conversation repair against a search over all edits, written apart from the operator."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from shardfit.llm import repair

GOOD = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    """Damaged rows of one conversation in their order, straight from the rules."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(turn, role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[1].encode() + b"\0" + r[2].encode()).digest()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Cheapest audit by uniform search over (row, initials so far reduced to their last two)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, roles, text = heapq.heappop(heap)
        if at == len(rows) and GOOD.fullmatch(roles):
            return cost, audit, "\n".join(text)
        state = (at, roles if len(roles) < 2 else roles[-1])
        if state in done:
            continue
        done.add(state)

        def go(price, letter, step, role=None, words=""):
            grown = roles + (role[:1] or "?") if role is not None else roles
            if re.fullmatch(r"s?(ua)*u?", grown):
                line = text + (f"{role}:{words}",) if role is not None else text
                heapq.heappush(heap, (cost + price, audit + letter, at + step, grown, line))

        for role in ("user", "assistant"):
            go(3, "I", 0, role)
        if at < len(rows):
            _, role, words = rows[at]
            go(4, "D", 1)
            if found[at] not in ("blank", "duplicate"):
                more = 3 if found[at] == "truncated" else 0
                go(more, "K", 1, role, words)
                for new in ("user", "assistant"):
                    go(3 + more, "R", 1, new, words)


def expected(conv, rows):
    rows = damage(rows)
    found = faults(rows)
    cost, audit, text = cheapest(rows, found)
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, found.count("blank"), found.count("duplicate"),
            found.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256(text.encode()).hexdigest())


def made(seed, n):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        turn = 0
        for i in range(rng.randrange(1, 9)):
            turn += rng.choice([1, 1, 1, 2, 0])
            role = rng.choice(["user", "assistant", ("user", "assistant")[i % 2], "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "cut off", " \t", None, "Is\x0b it?\n", "Ends. \x0c", "\xa0", f"n{i}."])
            rows.append((conv if rng.random() < 0.97 else None, rng.choice([turn, turn, turn, None]), role, text))
    return rows


def by_conv(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    return groups


@pytest.mark.parametrize("limit", [1024, 1, 3])
def test_same_as_search(spark, monkeypatch, limit):
    monkeypatch.setattr(repair.segments, "__defaults__", (limit,))
    rows = made(limit, 300)
    df = spark.createDataFrame([r + ("x", 1) for r in rows], SCHEMA + ", audit string, CONV string").repartition(3)
    got = {r["conv_id"]: tuple(r) for r in repair.report(repair.damaged(df), copies="copies").collect()}
    assert got == {conv: expected(conv, rs) for conv, rs in by_conv(rows).items()}


def test_repaired_rows_make_the_digest(spark):
    df = spark.createDataFrame(made(7, 60), SCHEMA)
    bad = repair.damaged(df)
    lines = {}
    for r in sorted(repair.repaired(bad, copies="copies").collect(), key=lambda r: r["place"]):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for r in repair.report(bad, copies="copies").collect():
        assert hashlib.sha256("\n".join(lines.get(r["conv_id"], [])).encode()).hexdigest() == r["repaired_sha256"]


def test_edges(spark):
    rows = [(1, 0, "user", "a."), (1, 0, "user", "a."), (2, None, None, None), (3, 5, "s", "x" * 100_000 + ".")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["conv_id"]: r for r in repair.report(df).collect()}
    assert (got[1]["duplicate"], got[1]["cost"], got[1]["audit"]) == (1, 7, "KDI")
    assert got[2]["blank"] == 1 and got[2]["audit"] == "D" and got[3]["audit"] == "D"
    assert repair.report(df.limit(0)).count() == 0 and repair.repaired(df.limit(0)).count() == 0
    gone = [(c, t, "user", "a.") for c in range(400) for t in range(1) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    out = repair.report(repair.damaged(spark.createDataFrame(gone, SCHEMA)), copies="copies").collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(out) == len(gone) > 3 and all(tuple(r)[1:] == (0,) * 6 + ("", empty) for r in out)


def test_long_conversation(spark):
    roles = ["user", "assistant"]
    rows = [(1, t, roles[t % 2] if t % 101 else "system", f"text {t}" + ("." if t % 7 else "")) for t in range(5000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    whole = repair.report(df).collect()[0]
    found = [""] * len(rows)
    for i, r in enumerate(rows):
        found[i] = "" if r[3].endswith(".") else "truncated"
    cost, audit, text = cheapest([r[1:] for r in rows], found)
    assert (whole["cost"], whole["audit"]) == (cost, audit)
    assert whole["repaired_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_nodes_are_shared():
    signatures = sorted(["ua", "sua", "uua", "Aua", "aua"], key=lambda s: s[::-1])
    nodes = dict(repair.automaton(signatures))
    alone = {s: next(repair.automaton([s]))[1] for s in signatures}
    for s in signatures:
        assert nodes[s].cost == alone[s].cost and nodes[s].audit == alone[s].audit
