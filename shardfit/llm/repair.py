"""Repair of conversation structure over a suffix-shared automaton of role/fault signatures.

Every row becomes one letter: its role's initial (small if the row is whole, capital if it is cut
off), `x`/`X` for another role, `D` if it must go. A conversation's letters, cut into segments of
a bounded number of rows, are its signatures. The distinct signatures of all conversations are
minimised from the end: sorted by their reversal, those that share a suffix stand together, and
each distinct suffix is one node, made from its first letter and the node of the rest. For every
node and pair of grammar states (before, after) the least cost and the best audit are computed
once, whatever number of conversations pass through it.

Grammar states: 0 nothing yet, 1 after a system row, 2 after a user row, 3 after an assistant row;
0 and 3 may end. As every step of an audit is some inserts and then one row, two ways never differ
only by one being longer, so the first in ASCII order is found step by step, and segments join.

A conversation's segments are chosen from the end in one streamed pass over their small tables
and walked from the front, beside the rows, in a second. Both are sorted by Spark, so a task holds
one segment, one row and the audit of one conversation.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardfit.llm.common import keep

SEGMENT = 1024   # most rows of one signature
SPACE = " \t\n\x0b\x0c\r"
# fixed values: costs of the edits, and of a cut-off row that stays
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
FAR = 1 << 40    # cost of what is impossible
STATES = range(4)
AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEXT = {0: "u", 1: "u", 2: "a", 3: "u"}            # role that an insert or a new role gives
END = {0: (0, ""), 1: (2 * INSERT, "II"), 2: (INSERT, "I"), 3: (0, "")}
NAMES = {"u": "user", "a": "assistant"}


def steps(letter: str, state: int) -> list[tuple[str, int, int]]:
    """(audit, cost, state after) of all ways to pass one row, in ASCII order of their audits."""
    found = []
    for inserts in range(3):  # a third insert never changes more than the first
        at = state
        for _ in range(inserts):
            at = AFTER[at, NEXT[at]]
        head, cost = "I" * inserts, INSERT * inserts
        found.append((head + "D", cost + DELETE, at))
        if letter != "D":
            stay = cost + (CUT if letter.isupper() else 0)
            if (at, letter.lower()) in AFTER:
                found.append((head + "K", stay, AFTER[at, letter.lower()]))
            found.append((head + "R", stay + REROLE, AFTER[at, NEXT[at]]))
    return sorted(found)


STEPS = {letter: [steps(letter, state) for state in STATES] for letter in "DsuaxSUAX"}


class Node:
    """Suffix of signatures: least cost and best audit from every state before it to every after."""

    __slots__ = ("cost", "audit")

    def __init__(self, letter: str = "", rest: "Node | None" = None):
        if rest is None:
            self.cost = [[0 if i == o else FAR for o in STATES] for i in STATES]
            self.audit = [[""] * 4 for _ in STATES]
            return
        self.cost, self.audit = [[FAR] * 4 for _ in STATES], [[""] * 4 for _ in STATES]
        for i in STATES:
            for audit, cost, at in STEPS[letter][i]:  # the first of equal cost is the least in ASCII
                for o in STATES:
                    total = cost + rest.cost[at][o]
                    if total < self.cost[i][o]:
                        self.cost[i][o], self.audit[i][o] = total, audit + rest.audit[at][o]


def automaton(signatures: Iterator[str]) -> Iterator[tuple[str, Node]]:
    """The node of every signature; signatures come in the order of their reversals.

    Only the nodes of the current signature are held: what it shares with the next one is the
    suffix they have in common.
    """
    path, last = [Node()], ""
    for signature in signatures:
        shared = 0
        while shared < min(len(last), len(signature)) and last[-1 - shared] == signature[-1 - shared]:
            shared += 1
        del path[shared + 1:]
        for letter in reversed(signature[:len(signature) - shared]):
            path.append(Node(letter, path[-1]))
        last = signature
        yield signature, path[-1]


def damaged(conversations: DataFrame, conv="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """The four columns after damage drawn from crc32 of "conv:turn" modulo 20, and `copies`.

    0 drops the row (no copies), 1 empties its text, 2 removes `.`, `!` and `?`, 3 repeats it
    (two copies), 4 makes it a user's. A null role, text, or part of the key counts as one blank.
    """
    known = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn, role, text)]
    draw = F.crc32(F.concat(known[0], F.lit(":"), known[1])) % 20
    return conversations.select(
        conv, turn, F.when(draw == 4, "user").otherwise(known[2]).alias(role),
        F.when(draw == 1, "").when(draw == 2, F.translate(known[3], ".!?", "")).otherwise(known[3]).alias(text),
        F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1).alias("copies"))


def _rows(df: DataFrame, conv: str, turn: str, role: str, text: str, copies: str | None) -> DataFrame:
    known = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role, text)]
    return df.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), known[0].alias("role"), known[1].alias("text"),
        (F.col(copies) if copies else F.lit(1)).cast("int").alias("copies"))


def _letters(rows: DataFrame) -> DataFrame:
    """`conv, turn, role, digest, copies, first, letter`: equal rows as one record.

    `first`: no equal text of that role stands earlier. `letter` is that of a row that is no
    duplicate. Records are counted before they are moved, so equal rows never meet as rows.
    """
    body = F.trim(F.col("text"), F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    whole = F.substring(body, -1, 1).isin(".", "!", "?")
    letter = F.when(body == "", "D").when(initial.isin("s", "u", "a"), initial).otherwise("x")
    letter = F.when(whole | (letter == "D"), letter).otherwise(F.upper(letter))
    rows = rows.where("copies > 0").select("conv", "turn", "role", _digest().alias("digest"), letter.alias("letter"), "copies")
    found = rows.groupBy("conv", "turn", "role", "digest", "letter").agg(F.sum("copies").alias("copies"))
    # a struct ranks a null turn first, as the order of rows does
    first = found.groupBy(F.col("conv").alias("c"), F.col("digest").alias("d")).agg(F.min(F.struct("turn")).alias("at"))
    same = found["conv"].eqNullSafe(first["c"]) & (found["digest"] == first["d"])
    return found.join(first, same).select(
        "conv", "turn", "role", "digest", "copies", "letter", F.struct("turn").eqNullSafe(F.col("at")).alias("first"))


def _digest() -> Column:
    """Tells texts and roles apart, and ranks rows of one turn and role."""
    return F.unhex(F.md5(F.to_binary(F.concat(F.hex("role"), F.lit("00"), F.hex("text")), F.lit("hex"))))


ORDER = ("turn", "role", "digest")


def segments(rows: DataFrame, limit: int = SEGMENT) -> DataFrame:
    """`conv, part, number, signature` of all conversations, at most `limit` rows to a segment.

    Rows are sorted over ranges that Spark draws, so that a long conversation is spread over
    tasks; (part, number) orders its segments. Written once.
    """
    placed = _letters(rows).repartitionByRange("conv", *ORDER).sortWithinPartitions("conv", *ORDER)

    def run(batches):
        part, number, owner, held, out = TaskContext.get().partitionId(), 0, None, [], []

        def close():
            nonlocal number, held
            if held:
                out.append((owner[0], number, "".join(held)))
                number, held = number + 1, []

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv", "copies", "first", "letter")]
            for conv, copies, first, letter in zip(*columns):
                if owner != (conv,):
                    close()
                    owner = (conv,)
                done = 0
                while done < copies:
                    if done == 0 and first:
                        held.append(letter)
                        done = 1
                    else:
                        more = min(copies - done, limit - len(held))
                        held.extend("D" * more)
                        done += more
                    if len(held) >= limit:
                        close()
                if len(out) >= 4096:
                    yield _frame(out, part, batch.schema.field("conv").type)
                    out = []
        close()
        if out:
            yield _frame(out, part, batch.schema.field("conv").type)

    def _frame(out, part, kind):
        conv, number, signature = zip(*out)
        return pa.RecordBatch.from_arrays(
            [pa.array(conv, kind), pa.array([part] * len(out), pa.int32()), pa.array(number, pa.int64()), pa.array(signature)],
            ["conv", "part", "number", "signature"])

    kind = rows.schema["conv"].dataType.simpleString()
    return keep(placed.select("conv", "copies", "first", "letter").mapInArrow(
        run, f"conv {kind}, part int, number long, signature string"))


def solved(found: DataFrame) -> DataFrame:
    """`signature, cost, audit`: 16 entries each, by state before and after, of all distinct signatures."""
    distinct = found.select("signature").distinct().withColumn("turned", F.reverse("signature"))
    placed = distinct.repartitionByRange("turned").sortWithinPartitions("turned").select("signature")

    def run(batches):
        signatures = (s for batch in batches for s in batch.column("signature").to_pylist())
        rows, size = [], 0
        for signature, node in automaton(signatures):
            rows.append((signature, [c for row in node.cost for c in row], [a for row in node.audit for a in row]))
            size += len(signature)
            if size > 1 << 18:
                yield _table(rows)
                rows, size = [], 0
        if rows:
            yield _table(rows)

    def _table(rows):
        kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["signature", "cost", "audit"])

    return placed.mapInArrow(run, "signature string, cost array<long>, audit array<string>")


def _chosen(found: DataFrame) -> DataFrame:
    """Per segment and state before it: the best state after it, the segment's audit and cost.

    Segments of a conversation stream from its end; a task holds four costs.
    """
    tables = found.join(solved(found), "signature")
    placed = tables.repartition("conv").sortWithinPartitions("conv", F.desc("part"), F.desc("number"))
    kind = found.schema["conv"].dataType.simpleString()
    names = ["conv", "part", "number", "signature", "to", "audit", "cost"]

    def run(batches):
        owner, ahead = None, None
        for batch in batches:
            convs, costs, audits = (batch.column(c).to_pylist() for c in ("conv", "cost", "audit"))
            to, best, paid = [], [], []
            for conv, cost, audit in zip(convs, costs, audits):
                if owner != (conv,):
                    owner, ahead = (conv,), [END[s][0] for s in STATES]
                    tail = [END[s][1] for s in STATES]
                # ways that cost the same differ within the segment, at the latest by what ends them
                pick = [min((cost[4 * i + o] + ahead[o], audit[4 * i + o] + tail[o], o) for o in STATES) for i in STATES]
                tail = [""] * 4
                ahead = [p[0] for p in pick]
                to.append([p[2] for p in pick])
                best.append([audit[4 * i + o] for i, o in enumerate(to[-1])])
                paid.append([cost[4 * i + o] for i, o in enumerate(to[-1])])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names[:4]]
                + [pa.array(to, pa.list_(pa.int32())), pa.array(best, pa.list_(pa.string())), pa.array(paid, pa.list_(pa.int64()))],
                names)

    return placed.select("conv", "part", "number", "signature", "cost", "audit").mapInArrow(
        run, f"conv {kind}, part int, number long, signature string, to array<int>, audit array<string>, cost array<long>")


class Walk:
    """One conversation as its plan and then its rows stream by, in order."""

    def __init__(self, conv):
        self.conv, self.state, self.cost, self.place = conv, 0, 0, 0
        self.kept, self.sha = 0, hashlib.sha256()
        self.audits, self.signatures = [], []
        self.audit = self.signature = None
        self.grammar = self.at = 0
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.last, self.low, self.high, self.turns = None, None, None, 0

    def plan(self, signature: str, to: list, audit: list, cost: list) -> None:
        self.signatures.append(signature)
        self.audits.append(audit[self.state])
        self.cost += cost[self.state]
        self.state = to[self.state]

    def start(self) -> None:
        if self.audit is None:
            cost, tail = END[self.state]
            self.cost += cost
            self.audit, self.signature = "".join(self.audits) + tail, "".join(self.signatures)
            self.audits = self.signatures = None

    def _insert(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            role = NEXT[self.grammar]
            self.grammar = AFTER[self.grammar, role]
            yield "I", NAMES[role], ""

    def row(self, turn, role: str, text: str):
        """Count the row's fault; yield the edits up to it as (edit, role, text)."""
        self.start()
        letter = self.signature[self.place]
        self.place += 1
        if letter == "D":
            self.counts["duplicate" if text.strip(SPACE) else "blank"] += 1
        elif letter.isupper():
            self.counts["truncated"] += 1
        if self.last is not None and self.last + role[:1] not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.last = role[:1]
        if turn is not None and (self.high is None or turn != self.high):
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        yield from self._insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            new = NEXT[self.grammar] if edit == "R" else role[:1]
            self.grammar = AFTER[self.grammar, new]
            yield edit, NAMES[new] if edit == "R" else role, text
        else:
            yield edit, role, text

    def end(self, make) -> list:
        """What `make` returns of the last inserts and of the conversation's end."""
        self.start()
        return [row for edit in [*self._insert(), (None, None, None)] for row in make(self, *edit)]

    @property
    def gaps(self) -> int:
        return 0 if self.high is None else self.high - self.low + 1 - self.turns


def _walked(rows: DataFrame, make, fields: dict) -> DataFrame:
    """Every conversation's plan and rows, in order, through `make` inside the tasks.

    `make(walk, edit, role, text)` gets every edit and `make(walk, None, None, None)` the end of
    a conversation; it returns output rows. `fields`: Spark and Arrow type of its columns.
    A conversation ends up in one task, as its digest needs its order, but only row by row.
    """
    plan = _chosen(segments(rows))
    parts = {"part": "int", "number": "long", "signature": "string", "to": "array<int>", "audit": "array<string>",
             "cost": "array<long>", "turn": "long", "role": "string", "digest": "binary", "text": "string", "copies": "int"}
    both = plan.select(F.lit(0).alias("kind"), "*").unionByName(
        rows.select(F.lit(1).alias("kind"), "*", _digest().alias("digest")), allowMissingColumns=True)
    both = both.select("kind", "conv", *[F.col(c).cast(t).alias(c) for c, t in parts.items()])
    placed = both.repartition("conv").sortWithinPartitions("conv", "kind", "part", "number", *ORDER)
    names = ["kind", "conv", "signature", "to", "audit", "cost", "turn", "role", "text", "copies"]
    arrow = [pa.field(name, kind) for name, (_, kind) in fields.items()]

    def run(batches):
        walk, out, size, target = None, [], 0, None

        def table():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), target)], schema=target)

        for batch in batches:
            target = pa.schema([pa.field("conv", batch.schema.field("conv").type), *arrow])
            for kind, conv, signature, to, audit, cost, turn, role, text, copies in zip(
                    *(batch.column(c).to_pylist() for c in names)):
                if walk is None or walk.conv != (conv,):
                    if walk:
                        out.extend(walk.end(make))
                    walk = Walk((conv,))
                if kind == 0:
                    walk.plan(signature, to, audit, cost)
                    continue
                for _ in range(copies):
                    for edit in walk.row(turn, role, text):
                        out.extend(make(walk, *edit))
                size += len(text)
                if out and size > 1 << 20:
                    yield table()
                    out, size = [], 0
        if walk:
            out.extend(walk.end(make))
        if out:
            yield table()

    kind = rows.schema["conv"].dataType.simpleString()
    columns = ", ".join(f"{name} {spark}" for name, (spark, _) in fields.items())
    return placed.select(*names).mapInArrow(run, f"conv {kind}, {columns}")


def repaired(conversations: DataFrame, conv="conv_id", turn="turn", role="role", text="text", copies=None) -> DataFrame:
    """The rows of the repaired conversations: conv, place (from 0), edit, role, text.

    Edits and ties are described at `report`; deleted rows are left out, inserted ones are empty.
    """
    def make(walk, edit, role, text):
        if edit in (None, "D"):
            return []
        walk.kept += 1
        return [(walk.conv[0], walk.kept - 1, edit, role, text)]

    fields = {"place": ("long", pa.int64()), "edit": ("string", pa.string()), "role": ("string", pa.string()),
              "text": ("string", pa.string())}
    out = _walked(_rows(conversations, conv, turn, role, text, copies), make, fields)
    return out.withColumnRenamed("conv", conv)


def report(conversations: DataFrame, conv="conv_id", turn="turn", role="role", text="text", copies=None) -> DataFrame:
    """Faults of every conversation, its cheapest edits, and the digest of what they make of it.

    Columns: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Rows
    run by turn, nulls first; rows of one turn by role and then by a digest of role and text.
    `copies`: column with the number of times that a row stands there; a conversation whose rows
    all have none is reported as empty: zeros, no audit, the digest of nothing.

    A row is blank (nothing but ASCII white space), else a duplicate (role and text stand
    earlier), else truncated (its last other character is no `.`, `!`, `?`). Keep costs 0, a new
    role (user or assistant) 3, Delete 4, Insert of an empty user or assistant row 3; blank and
    duplicate rows must go, a truncated one that stays costs 3 more. The roles' initials must then
    read `(s?(ua)+)?`. Of equally cheap audits the first in ASCII order holds.

    Null ids are one conversation; null roles and texts count as one blank. Equal rows are
    duplicates of each other. An empty table gives an empty result; other columns are not read.
    """
    def make(walk, edit, role, text):
        if edit is None:
            counts = [walk.counts[c] for c in ("blank", "duplicate", "truncated", "illegal")]
            return [(walk.conv[0], walk.gaps, *counts, walk.cost, walk.audit, walk.sha.hexdigest())]
        if edit != "D":
            walk.sha.update(f"\n{role}:{text}".encode()[0 if walk.kept else 1:])
            walk.kept += 1
        return []

    fields = {c: ("long", pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    fields |= {"audit": ("string", pa.string()), "repaired_sha256": ("string", pa.string())}
    out = _walked(_rows(conversations, conv, turn, role, text, copies), make, fields)
    return out.withColumnRenamed("conv", conv)
