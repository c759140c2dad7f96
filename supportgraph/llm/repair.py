"""Conversations brought into a legal order of roles at the least cost of edits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportgraph.llm.common import Own, join_groups
from supportgraph.workspace import materialize

#: Rows and bytes of a conversation that a task holds. A longer one is cut into chunks of that size.
CHUNK_ROWS, CHUNK_BYTES = 4096, 4 << 20

# Costs of the edits; a truncated row that stays costs one more.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

# What the kept rows so far end in.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where an inserted or reroled turn leads, and where a kept one does by its role's initial.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: What a legal conversation still lacks, by what it ends in.
TAIL = {START: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}

WHITE = " \t\n\x0b\x0c\r"


class Prefixes:
    """Sequences of letters that share their beginnings: a node is a sequence, its parent the
    sequence without the last letter.

    Every node knows its length, a rolling hash and its ancestors at distances 1, 2, 4, ... Two
    sequences are compared where they part: a search down the ancestors for the longest common
    prefix by equal hashes. Equal hashes of different nodes are verified letter by letter, up to
    the node that both share.
    """

    MODULUS, BASE = (1 << 61) - 1, 911_382_323

    def __init__(self) -> None:
        self.letter: list = [None]
        self.length, self.hash, self.up = [0], [0], [[]]

    def add(self, parent: int, letter) -> int:
        up, node = [parent], parent
        for step in range(64):
            above = self.up[node]
            if len(above) <= step:
                break
            node = above[step]
            up.append(node)
        self.letter.append(letter)
        self.length.append(self.length[parent] + 1)
        number = letter if isinstance(letter, int) else ord(letter)
        self.hash.append((self.hash[parent] * self.BASE + number + 1) % self.MODULUS)
        self.up.append(up)
        return len(self.letter) - 1

    def same(self, a: int, b: int) -> bool:
        """Whether two nodes of one length are the same sequence."""
        if self.hash[a] != self.hash[b]:
            return False
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def ancestor(self, node: int, length: int) -> int:
        while rest := self.length[node] - length:
            node = self.up[node][rest.bit_length() - 1]
        return node

    def less(self, a: int, b: int) -> bool:
        """Whether sequence ``a`` comes before ``b``; a beginning comes before what it begins."""
        short = min(self.length[a], self.length[b])
        x, y = self.ancestor(a, short), self.ancestor(b, short)
        if self.same(x, y):
            return self.length[a] < self.length[b]
        for step in range(len(self.up[x]) - 1, -1, -1):
            if step < len(self.up[x]) and not self.same(self.up[x][step], self.up[y][step]):
                x, y = self.up[x][step], self.up[y][step]
        return self.letter[x] < self.letter[y]

    def spell(self, node: int) -> list:
        letters = []
        while node:
            letters.append(self.letter[node])
            node = self.up[node][0]
        return letters[::-1]


class Choices:
    """The best way into each state: its cost and its node."""

    def __init__(self, prefixes: Prefixes) -> None:
        self.prefixes = prefixes
        self.best: list[tuple[int, int] | None] = [None] * 4

    def offer(self, state: int, cost: int, parent: int, letter=None) -> None:
        """Take a way where it is cheaper, or as cheap and earlier in order; without a letter it
        is the parent itself."""
        held = self.best[state]
        if held is None or cost <= held[0]:
            node = parent if letter is None else self.prefixes.add(parent, letter)
            if held is None or cost < held[0] or self.prefixes.less(node, held[1]):
                self.best[state] = cost, node


def walk(prefixes: Prefixes, rows: list[tuple[str, bool, bool]], entry: int) -> list[tuple[int, int] | None]:
    """The cheapest edits of ``rows`` (initial, must go, truncated) from one state to each.

    Turns are inserted before a row, never after the last one, so no way into a state is the
    beginning of another: which of two is first does not change with what follows.
    """
    now = Choices(prefixes)
    now.best[entry] = 0, 0
    for initial, must_go, truncated in rows:
        for into, sources in ((USER, (START, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
            for state in sources:
                if now.best[state]:
                    cost, node = now.best[state]
                    now.offer(into, cost + INSERT, node, "I")
        later = Choices(prefixes)
        for state, found in enumerate(now.best):
            if found is None:
                continue
            cost, node = found
            later.offer(state, cost + DELETE, node, "D")
            if not must_go:
                stay = cost + TRUNCATED * truncated
                if (state, initial) in KEPT:
                    later.offer(KEPT[state, initial], stay, node, "K")
                later.offer(NEXT[state], stay + REROLE, node, "R")
        now = later
    return now.best


def finish(prefixes: Prefixes, best: list[tuple[int, int] | None]) -> tuple[int, int, int]:
    """(cost, node, state) of the cheapest legal conversation, first in order of its edits."""
    chosen = None
    for state, tail in TAIL.items():
        if best[state]:
            cost, node = best[state][0] + INSERT * len(tail), best[state][1]
            if chosen is None or cost < chosen[0] or (cost == chosen[0] and prefixes.less(node, chosen[1])):
                chosen = cost, node, state
    return chosen


def replay(initials: list[str], audit: str, state: int) -> list[tuple[int | None, str | None]]:
    """The rows that edits leave: (number of the row or None, new role or None)."""
    left, at = [], 0
    for edit in audit:
        if edit == "K":
            state = KEPT[state, initials[at]]
            left.append((at, None))
        elif edit in "RI":
            state = NEXT[state]
            left.append((at if edit == "R" else None, ROLE[state]))
        at += edit != "I"
    return left


def faults(role: str, text: str) -> tuple[str, bool, bool]:
    """Initial, blank, and whether the text breaks off."""
    end = text.rstrip(WHITE)[-1:]
    return role[:1], not end, bool(end) and end not in ".!?"


def count(turns: list[int | None], initials: list[str]) -> tuple[int | None, int | None, int, int]:
    """First and last turn, different turns, and pairs of neighbours out of order."""
    known = [t for t in turns if t is not None]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (known[0] if known else None), (known[-1] if known else None), len(set(known)), illegal


REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_REPORT = ", ".join(f"{c} bigint" for c in REPORT)


def repair_whole(rows: list[tuple]) -> tuple[list[int], str, list[tuple[str, str]]]:
    """Report, audit and turns of a conversation whose rows (turn, role, text) are held."""
    seen, marked, sums = set(), [], [0, 0, 0]
    for _, role, text in rows:
        initial, blank, truncated = faults(role, text)
        duplicate = not blank and (role, text) in seen
        seen.add((role, text))
        truncated = truncated and not duplicate
        sums = [n + x for n, x in zip(sums, (blank, duplicate, truncated))]
        marked.append((initial, blank or duplicate, truncated))
    initials = [m[0] for m in marked]
    first, last, different, illegal = count([r[0] for r in rows], initials)
    prefixes = Prefixes()
    cost, node, state = finish(prefixes, walk(prefixes, marked, START))
    audit = "".join(prefixes.spell(node)) + TAIL[state]
    turns = [
        (role or rows[at][1], "" if at is None else rows[at][2]) for at, role in replay(initials, audit, START)
    ]
    gaps = 0 if first is None else last - first + 1 - different
    return [gaps, *sums, illegal, cost], audit, turns


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_ROW = "turn bigint, role string, text string, gone boolean, initial string, empty boolean, breaks boolean"
_ROW_TYPES = [
    ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("gone", pa.bool_()),
    ("initial", pa.string()), ("empty", pa.bool_()), ("breaks", pa.bool_()),
]


def _arrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of conversation and turn: conversations that lie in this part alone are
    repaired, rows of others are handed on with their place and chunk."""
    part, kind = TaskContext.get().partitionId(), None
    held, size, held_bytes, waiting = [], 0, 0, []
    place = chunk = 0
    current, began, handed = None, False, True  # the first conversation may have begun before

    def out(wholes: list, rows: list) -> pa.RecordBatch:
        """One batch of repaired conversations and of rows that are handed on."""
        n, m = len(wholes), len(rows)
        columns = [pa.array([w[0] for w in wholes] + [r[0] for r in rows], kind)]
        names = ["conv", "part", "place", "chunk"]
        for i, t in ((1, pa.int32()), (2, pa.int64()), (3, pa.int64())):
            columns.append(pa.array([None] * n + [r[i] for r in rows], t))
        for i, (name, t) in enumerate(_ROW_TYPES):
            names.append(name)
            columns.append(pa.array([None] * n + [r[4 + i] for r in rows], t))
        for i, name in enumerate(REPORT):
            names.append(name)
            columns.append(pa.array([w[1][i] for w in wholes] + [None] * m, pa.int64()))
        turns = [[{"role": r, "text": t} for r, t in w[3]] for w in wholes]
        columns += [pa.array([w[2] for w in wholes] + [None] * m, pa.string()), pa.array(turns + [None] * m, _TURNS)]
        return pa.RecordBatch.from_arrays(columns, names=[*names, "audit", "turns"])

    def hand_on() -> list:
        """The rows held, with places, as the next rows of their chunk."""
        nonlocal held, place
        rows = []
        for turn, role, text, gone in held:
            rows.append((current, part, place, chunk, turn, role, text, gone, *faults(role, text)))
            place += 1
        held = []
        return rows

    for batch in batches:
        kind = batch.schema.field(0).type
        wholes = []
        for start in range(0, batch.num_rows, 256):
            columns = [c.slice(start, 256).to_pylist() for c in batch.columns]
            for conv, *row in zip(*columns):
                if not began or conv != current:
                    if began and not handed:
                        kept = [r[:3] for r in held if not r[3]]
                        wholes.append((current, *repair_whole(kept)))
                        held = []
                    elif began:
                        waiting += hand_on()
                    handed = not began
                    current, began, size, held_bytes, chunk = conv, True, 0, 0, chunk + 1
                held.append(row)
                size += 1
                held_bytes += len(row[1]) + len(row[2])
                if size >= CHUNK_ROWS or held_bytes >= CHUNK_BYTES:
                    handed = True
                    waiting += hand_on()
                    size, held_bytes, chunk = 0, 0, chunk + 1
                    yield out(wholes, waiting)
                    wholes, waiting = [], []
        yield out(wholes, waiting)
        waiting = []
    if began:  # the last conversation may go on in the next part
        yield out([], hand_on())


def _summary(rows: pa.Table) -> pa.Table:
    """One chunk: its counts and, from each state to each, the cost and the order of its edits."""
    rows = rows.sort_by("place")
    here = rows.filter(pc.invert(rows.column("gone")))
    initials = here.column("initial").to_pylist()
    blank, breaks, again = (here.column(c).to_pylist() for c in ("empty", "breaks", "again"))
    marked = [(i, b or d, t and not d) for i, b, t, d in zip(initials, blank, breaks, again)]
    first, last, different, illegal = count(here.column("turn").to_pylist(), initials)
    costs, orders = [], []
    for entry in range(4):
        prefixes = Prefixes()
        best = walk(prefixes, marked, entry)
        ways = [s for s in range(4) if best[s]]
        before = [sum(prefixes.less(best[o][1], best[s][1]) for o in ways if o != s) for s in ways]
        rank = dict(zip(ways, before))
        costs += [best[s][0] if best[s] else -1 for s in range(4)]
        orders += [rank.get(s, -1) for s in range(4)]
    row = {
        "conv": rows.column("conv")[0].as_py(), "part": rows.column("part")[0].as_py(),
        "chunk": rows.column("chunk")[0].as_py(), "first": first, "last": last, "different": different,
        "illegal": illegal, "blank": sum(blank), "duplicate": sum(d and not b for b, d in zip(blank, again)),
        "truncated": sum(m[2] for m in marked), "rows": len(marked),
        "starts": initials[0] if initials else None, "ends": initials[-1] if initials else None,
        "costs": costs, "orders": orders,
    }
    types = [("conv", rows.schema.field("conv").type), ("part", pa.int32()), ("chunk", pa.int64())]
    types += [(c, pa.int64()) for c in _COUNTS]
    types += [("starts", pa.string()), ("ends", pa.string()), ("costs", pa.list_(pa.int64())), ("orders", pa.list_(pa.int64()))]
    return pa.Table.from_pylist([row], pa.schema(types))


_COUNTS = ["first", "last", "different", "illegal", "blank", "duplicate", "truncated", "rows"]
_SUMMARY = (
    "part int, chunk bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS)
    + ", starts string, ends string, costs array<bigint>, orders array<bigint>"
)


def _resolve(chunks: pa.Table) -> pa.Table:
    """One conversation from the summaries of its chunks: its report, and the states at which each
    chunk is entered and left. What it holds of a chunk is some 50 numbers."""
    chunks = chunks.sort_by([("part", "ascending"), ("chunk", "ascending")])
    parts = chunks.to_pylist()
    sums = {c: sum(p[c] for p in parts) for c in ("different", "illegal", "blank", "duplicate", "truncated")}
    ends = last = first = None
    for p in parts:
        if p["first"] is not None:
            sums["different"] -= p["first"] == last
            first, last = (p["first"] if first is None else first), p["last"]
        if p["rows"]:
            sums["illegal"] += ends is not None and ends + p["starts"] not in ("su", "ua", "au")
            ends = p["ends"]
    prefixes, now, leads = Prefixes(), Choices(Prefixes()), {}
    now.prefixes, now.best[START] = prefixes, (0, 0)
    for p in parts:
        later = Choices(prefixes)
        for entry, found in enumerate(now.best):
            for leave in range(4):
                if found and p["costs"][entry * 4 + leave] >= 0:
                    # Two ways part in a chunk that both enter in one state: its order tells.
                    letter = p["orders"][entry * 4 + leave]
                    leads[prefixes.length[found[1]], entry, letter] = leave
                    later.offer(leave, found[0] + p["costs"][entry * 4 + leave], found[1], letter)
        now = later
    cost, node, state = finish(prefixes, now.best)
    states = [START]
    for number, letter in enumerate(prefixes.spell(node)):
        states.append(leads[number, states[-1], letter])
    gaps = 0 if first is None else last - first + 1 - sums["different"]
    n = len(parts)
    report = [gaps, sums["blank"], sums["duplicate"], sums["truncated"], sums["illegal"], cost]
    columns = {
        "conv": chunks.column("conv"), "part": chunks.column("part"), "chunk": chunks.column("chunk"),
        "entry": pa.array(states[:-1], pa.int32()), "leave": pa.array(states[1:], pa.int32()),
        "tail": pa.array([""] * (n - 1) + [TAIL[state]]),
    }
    for name, value in zip(REPORT, report):
        columns[name] = pa.array([value] + [None] * (n - 1), pa.int64())
    return pa.table(columns)


_EDITS = pa.list_(pa.struct([("number", pa.int32()), ("role", pa.string())]))


def _edit(rows: pa.Table) -> pa.Table:
    """The edits of one chunk between the states at which it is entered and left."""
    rows = rows.sort_by("place")
    gone = rows.column("gone").to_pylist()
    numbers = [i for i, g in enumerate(gone) if not g]
    here = rows.filter(pc.invert(rows.column("gone")))
    initials = here.column("initial").to_pylist()
    flags = (here.column(c).to_pylist() for c in ("empty", "breaks", "again"))
    marked = [(i, b or d, t and not d) for i, b, t, d in zip(initials, *flags)]
    entry, leave, tail = (rows.column(c)[0].as_py() for c in ("entry", "leave", "tail"))
    prefixes = Prefixes()
    node = walk(prefixes, marked, entry)[leave][1]
    audit = "".join(prefixes.spell(node)) + tail
    left = [
        {"number": None if at is None else numbers[at] + 1, "role": role} for at, role in replay(initials, audit, entry)
    ]
    return pa.table(
        {
            "part": rows.column("part").slice(0, 1), "chunk": rows.column("chunk").slice(0, 1),
            "audit": pa.array([audit]), "edits": pa.array([left], _EDITS),
        }
    )


@dataclass(frozen=True)
class Repaired:
    """``whole``: a row per conversation that one task held, with report, audit and turns.
    ``long``: report and audit of the others, whose turns are in ``pieces``, to be read in the order
    of part and chunk."""

    whole: DataFrame
    long: DataFrame
    pieces: DataFrame


def repair(
    rows: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    gone: str | None = None,
) -> Repaired:
    """The cheapest edits that make conversations legal: nothing, or a system turn if any, then
    user and assistant in turns (judged by the initials of their roles).

    A row is blank (only white space), else duplicate (role and text seen earlier), else truncated
    (its last character does not end a sentence). Blank and duplicate rows must go. Keeping costs
    0, a new role 2, deleting 3, inserting an empty turn 2, a truncated row that stays 1 more.
    ``audit`` has the initials of the edits in order; of audits with the least cost the first in
    ASCII order is chosen. ``cost`` is its cost; gaps, blank, duplicate, truncated and illegal
    describe the rows as they came.

    Rows go by turn, null first; rows of one turn by the first 32 characters of role and text, then
    by a hash of both. A null role or text counts as one blank, a null conversation as one
    like others. Rows whose column ``gone`` is true only make their conversation known: one without
    other rows has zeros, an empty audit and no turns. Repeated rows are duplicates. An empty table
    gives empty results. Other columns are not read; they may have any name.

    Rows are sorted over range partitions. A conversation inside one partition is repaired there,
    held up to CHUNK_ROWS rows or CHUNK_BYTES. Of longer ones and those that cross a border, at any
    size, each chunk tells the cost and order of its edits from every state to every other; one
    task joins these few numbers per chunk, and the chunks then make their edits. No task holds the
    rows of such a conversation.
    """
    own = Own(rows, [])
    blank = F.lit(" ")
    plain = own.table.select(
        F.col(own[conversation]).alias("conv"), F.col(own[turn]).cast("bigint").alias("turn"),
        F.coalesce(F.col(own[role]), blank).alias("role"), F.coalesce(F.col(own[text]), blank).alias("text"),
        (F.coalesce(F.col(own[gone]), F.lit(False)) if gone else F.lit(False)).alias("gone"),
    )
    # Equal rows may change places, so they are spread by any number of their own.
    order = ["conv", "turn", F.left("role", F.lit(32)), F.left("text", F.lit(32)), F.xxhash64("role", "text"), "gone"]
    spread = plain.withColumn("any", F.monotonically_increasing_id())
    sorted_ = spread.repartitionByRange(*order, "any").sortWithinPartitions(*order, "any").drop("any")
    conv = f"conv {plain.schema['conv'].dataType.simpleString()}"
    stored = materialize(
        sorted_.mapInArrow(
            _arrange,
            f"{conv}, part int, place bigint, chunk bigint, {_ROW}, {_REPORT}, audit string, "
            "turns array<struct<role:string,text:string>>",
        ),
        "arranged",
    )
    whole = stored.filter("part IS NULL").select(F.col("conv").alias("conversation"), *REPORT, "audit", "turns")
    pending = stored.filter("part IS NOT NULL")

    key = F.when(~F.col("gone"), F.sha2(F.to_json(F.struct("conv", "role", "text")), 256))
    flags = materialize(
        pending.select("conv", "part", "place", "chunk", "turn", "gone", "initial", "empty", "breaks", key.alias("key")),
        "flags",
    )
    firsts = materialize(
        flags.filter("key IS NOT NULL")
        .groupBy("key")
        .agg(F.min(F.struct("part", "place")).alias("earliest"), F.count("*").alias("rows")),
        "firsts",
    )
    again = F.coalesce(F.col("earliest") != F.struct("part", "place"), F.lit(False))
    marked = materialize(
        join_groups(flags, firsts, "key", "rows", "place").withColumn("again", again).drop("key", "earliest", "rows"),
        "marked",
    )
    summaries = marked.groupBy("part", "chunk").applyInArrow(_summary, f"{conv}, {_SUMMARY}")
    path = materialize(
        summaries.groupBy("conv").applyInArrow(
            _resolve, f"{conv}, part int, chunk bigint, entry int, leave int, tail string, {_REPORT}"
        ),
        "path",
    )
    states = path.select("part", "chunk", "entry", "leave", "tail")
    edits = materialize(
        marked.join(states, ["part", "chunk"])
        .groupBy("part", "chunk")
        .applyInArrow(_edit, "part int, chunk bigint, audit string, edits array<struct<number:int,role:string>>"),
        "edits",
    )
    audits = (
        path.select("conv", "part", "chunk").join(edits.select("part", "chunk", "audit"), ["part", "chunk"])
        .groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "chunk", "audit"))).alias("audits"))
        .select(F.col("conv").alias("of"), F.array_join("audits.audit", "").alias("audit"))
    )
    long = (
        path.filter("cost IS NOT NULL")
        .join(audits, F.col("conv").eqNullSafe(F.col("of")))
        .select(F.col("conv").alias("conversation"), *REPORT, "audit")
    )
    texts = pending.groupBy("part", "chunk").agg(
        F.first("conv").alias("conv"), F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("rows")
    )

    def left(edit):
        row = F.get("rows", edit["number"] - 1)
        return F.struct(
            F.coalesce(edit["role"], row["role"]).alias("role"),
            F.when(edit["number"].isNull(), "").otherwise(row["text"]).alias("text"),
        )

    pieces = texts.join(edits.select("part", "chunk", "edits"), ["part", "chunk"]).select(
        F.col("conv").alias("conversation"), "part", "chunk", F.transform("edits", left).alias("turns")
    )
    return Repaired(whole, long, pieces)


def lines(turns) -> F.Column:
    """Turns as ``role:text``, a line each."""
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")


def digest_in_order(pieces: DataFrame) -> DataFrame:
    """SHA-256 of the lines of each long conversation: ``conversation, digest``.

    A digest is a chain, so one task reads the pieces of a conversation, in order; it holds one.
    """
    kind = pieces.schema["conversation"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current, began, lines_before, types = None, None, False, False, None

        def out() -> pa.RecordBatch:
            columns = [pa.array([current], types), pa.array([state.hexdigest()])]
            return pa.RecordBatch.from_arrays(columns, names=["conversation", "digest"])

        for batch in batches:
            types = batch.schema.field(0).type
            for at in range(batch.num_rows):
                conversation = batch.column(0)[at].as_py()
                if not began or conversation != current:
                    if began:
                        yield out()
                    state, current, began, lines_before = hashlib.sha256(), conversation, True, False
                if batch.column(1)[at].as_py():
                    state.update(b"\n" * lines_before + batch.column(2)[at].as_py().encode())
                    lines_before = True
        if began:
            yield out()

    ordered = pieces.select("conversation", F.size("turns").alias("n"), lines(F.col("turns")).alias("text"), "part", "chunk")
    return (
        ordered.repartition("conversation")
        .sortWithinPartitions("conversation", "part", "chunk")
        .select("conversation", "n", "text")
        .mapInArrow(run, f"conversation {kind}, digest string")
    )
