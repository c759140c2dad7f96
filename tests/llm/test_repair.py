"""Audits against every possible script of edits, and whole tables against conversations one by one."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from supportgraph.llm import repair
from supportgraph.llm.queries import damaged, op12_conversation_repair

WORDS = "Good. So? well then No! end".split()


def scripts(rows, most):
    """Every script of edits up to a cost whose result is legal: (cost, audit, turns)."""
    out = []

    def go(at, cost, audit, turns):
        if cost > most:
            return
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in turns)):
            out.append((cost, audit, turns))
        for role in ("user", "assistant"):
            go(at, cost + 2, audit + "I", [*turns, (role, "")])
        if at < len(rows):
            role, text, must_go, truncated = rows[at]
            go(at + 1, cost + 3, audit + "D", turns)
            if not must_go:
                go(at + 1, cost + truncated, audit + "K", [*turns, (role, text)])
                for other in ("user", "assistant"):
                    go(at + 1, cost + 2 + truncated, audit + "R", [*turns, (other, text)])

    go(0, 0, "", [])
    return out


def marked(rows):
    seen, out = set(), []
    for _, role, text in rows:
        end = text.rstrip(" \t\n\v\f\r")[-1:]
        blank, duplicate = not end, bool(end) and (role, text) in seen
        seen.add((role, text))
        out.append((role, text, blank or duplicate, bool(end) and not duplicate and end not in ".!?", blank, duplicate))
    return out


def plain(rows):
    """Report, audit and turns of rows (turn, role, text) in order, by strings of edits."""
    marks = marked(rows)
    best = {"": (0, "", [])}  # by what the kept initials are: "", "s", "u" or "a"
    nexts = {"": "u", "s": "u", "a": "u", "u": "a"}
    names = {"u": "user", "a": "assistant"}

    def offer(table, state, way):
        if state not in table or way[:2] < table[state][:2]:
            table[state] = way

    def insert(table):
        for _ in range(3):
            for state, (cost, audit, turns) in list(table.items()):
                offer(table, nexts[state], (cost + 2, audit + "I", [*turns, (names[nexts[state]], "")]))

    for role, text, must_go, truncated, *_ in marks:
        insert(best)
        later = {}
        for state, (cost, audit, turns) in best.items():
            offer(later, state, (cost + 3, audit + "D", turns))
            if not must_go:
                if (state, role[:1]) == ("", "s") or (role[:1] in "ua" and role[:1] == nexts[state]):
                    offer(later, role[:1], (cost + truncated, audit + "K", [*turns, (role, text)]))
                offer(later, nexts[state], (cost + 2 + truncated, audit + "R", [*turns, (names[nexts[state]], text)]))
        best = later
    insert(best)
    cost, audit, turns = min(w for s, w in best.items() if s in ("", "a"))
    known = [t for t, *_ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return [
        max(known) - min(known) + 1 - len(set(known)) if known else 0,
        sum(m[4] for m in marks), sum(m[5] for m in marks), sum(m[3] for m in marks),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost,
    ], audit, turns


def some_rows(n, roles=("user", "assistant", "system", "tool", " ")):
    return [(i, random.choice(roles), random.choice([*WORDS, "", " \t", "again", "x y "])) for i in range(n)]


def test_every_script():
    random.seed(1)
    for _ in range(60):
        rows = some_rows(random.randrange(5))
        report, audit, turns = repair.repair_whole(rows)
        all_ = scripts([m[:4] for m in marked(rows)], report[5])
        assert min((cost, script) for cost, script, _ in all_) == (report[5], audit)
        assert turns in [t for c, s, t in all_ if (c, s) == (report[5], audit)]
        assert (report, audit, turns) == plain(rows)


def test_longer_conversations():
    random.seed(2)
    for _ in range(200):
        rows = some_rows(random.randrange(40), random.choice([("user", "assistant"), ("user", "assistant", "system", "")]))
        assert repair.repair_whole(rows) == plain(rows)


def test_equal_hashes_are_verified(monkeypatch):
    monkeypatch.setattr(repair.Prefixes, "MODULUS", 3)
    random.seed(3)
    for _ in range(100):
        rows = some_rows(random.randrange(30))
        assert repair.repair_whole(rows) == plain(rows)


def test_prefixes_compare_like_strings():
    random.seed(4)
    shared = repair.Prefixes()
    nodes = {0: ""}
    for _ in range(300):
        parent, letter = random.choice(list(nodes)), random.choice("DIKR")
        nodes[shared.add(parent, letter)] = nodes[parent] + letter
    for a, b in (random.sample(list(nodes), 2) for _ in range(5000)):
        assert shared.less(a, b) == (nodes[a] < nodes[b])


def by_conversation(rows):
    out = {}
    for conv, turn, role, text, gone in rows:
        out.setdefault(conv, [])
        if not gone:
            out[conv].append((turn, " " if role is None else role, " " if text is None else text))
    for held in out.values():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return out


def results(found):
    turns = {r.conversation: [tuple(t) for t in r.turns] for r in found.whole.collect()}
    for r in sorted(found.pieces.collect(), key=lambda r: (r.part, r.chunk)):
        turns.setdefault(r.conversation, []).extend(tuple(t) for t in r.turns)
    out = {}
    for r in [*found.whole.collect(), *found.long.collect()]:
        assert r.conversation not in out
        out[r.conversation] = ([r[c] for c in repair.REPORT], r.audit, turns[r.conversation])
    return out


@pytest.mark.parametrize("chunk", [2, 4096])
def test_conversations_of_any_length(spark, monkeypatch, chunk):
    monkeypatch.setattr(repair, "CHUNK_ROWS", chunk)
    random.seed(chunk)
    rows = []
    for conv in [*range(25), None, 900, 901]:
        for turn, role, text in some_rows(120 if conv == 900 else random.randrange(1, 9)):
            rows.append((conv, random.choice([turn, turn, None, 3]), random.choice([role, role, role, None]), text, conv == 901))
    rows += rows[:9] + [(902, 1, "user", None, True), (903, None, None, None, None), (904, None, "user", "Same.", False)]
    rows += [(905, 1, "user", "Same.", False)] * 30
    schema = "conv_id long, turn long, role string, text string, gone boolean"
    df = spark.createDataFrame(rows, schema).withColumn("key", F.lit("own")).withColumn("a.b", F.lit(1))
    df = df.withColumn("part", F.lit("own"))
    got = results(repair.repair(df, gone="gone"))
    assert got == {conv: plain(held) for conv, held in by_conversation(rows).items()}
    empty = repair.repair(spark.createDataFrame([], schema))
    assert [x.collect() for x in (empty.whole, empty.long, empty.pieces)] == [[], [], []]


def test_long_texts_are_cut_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(repair, "CHUNK_BYTES", 100_000)
    rows = [("c", i, "ua"[i % 2], "long text. " * 20_000, False) for i in range(5)] + [("d", 0, "user", "x" * 300_000, False)]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string, gone boolean")
    assert results(repair.repair(df)) == {c: plain(held) for c, held in by_conversation(rows).items()}


def plain_damage(conv, turn, role, text):
    key, role, text = ":".join(" " if x is None else str(x) for x in (conv, turn)), role or " ", text or " "
    fault = zlib.crc32(key.encode()) % 20
    text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
    return [(conv, turn, "user" if fault == 4 else role, text, fault == 0)] * (2 if fault == 3 else 1)


def test_query_against_conversations_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(repair, "CHUNK_ROWS", 3)
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    faulty = [x for r in rows for x in plain_damage(*r)]
    want = Counter()
    for conv, held in by_conversation(faulty).items():
        report, audit, turns = plain(held)
        text = "\n".join(f"{r}:{t}" for r, t in turns)
        want[(conv, *report, audit, hashlib.sha256(text.encode()).hexdigest())] += 1
    got = Counter(tuple(r) for r in op12_conversation_repair(spark, sf).collect())
    assert got == want


def test_damage_takes_nulls_for_blanks(spark):
    rows = [(None, None, None, None), (None, 1, "user", "a.b!c?"), *[(i, i, "system", "a. b? c!") for i in range(60)]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = Counter(tuple(r) for r in damaged(df).collect())
    assert got == Counter(x for r in rows for x in plain_damage(*r))
