"""Hit words against a comparison of every window with every window."""

import random
import re
import time

import pytest

from supportgraph.llm import decontaminate
from supportgraph.workspace import materialize
from supportgraph.llm.decontaminate import Matcher, find_passages, remove_contaminated, words


def plain_words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [m for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)]


def plain(text, items, window):
    own, hit, names = plain_words(text), set(), set()
    line = [m[0] for m in own]
    for name, item in items:
        other = [m[0] for m in plain_words(item)]
        n = min(window, len(other))
        for at in range(len(other) - n + 1 if n else 0):
            for p in range(len(line) - n + 1):
                if line[p : p + n] == other[at : at + n]:
                    hit.update(range(p, p + n))
                    names.add(name)
    return len(line), hit, sorted(names), own


def cases():
    random.seed(11)
    vocabulary = ["a", "b", "é", "Ä1", "c"]

    def some(n):
        return random.choice([" ", ", ", "\n"]).join(random.choices(vocabulary, k=n))

    items = [(str(i), some(random.choice([0, 1, 3, 4, 5, 9, 12, 30]))) for i in range(14)]
    items += [("7", items[7][1]), ("99", None), ("100", "— ... !"), ("101", items[3][1])]
    texts = [some(random.choice([0, 1, 5, 40])) for _ in range(60)] + [None, "", "…", "😀 " + (items[2][1] or "").upper() + "😀"]
    texts += [some(30) + " " + t + " " + some(20) for _, t in items if t]
    return items, texts


@pytest.mark.parametrize("window", [1, 2, 4, 10])
def test_matcher_equals_brute_force(window):
    items, texts = cases()
    matcher = Matcher([(n, (t or "").encode()) for n, t in items], window)
    for text in texts:
        count, hit, names, _ = plain(text, items, window)
        own = words((text or "").encode())
        runs, found = matcher.match(own)
        assert (len(own), {i for a, b in runs for i in range(a, b)}, sorted(found)) == (count, hit, names)


@pytest.mark.parametrize("part_bytes", [60, 1 << 20])
def test_rows_and_offsets(spark, part_bytes):
    items, texts = cases()
    docs = spark.createDataFrame([(i % 50, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    out = find_passages(docs, bench, window=4, part_bytes=part_bytes, keep=["doc_id", "text"]).collect()
    assert len(out) == len(texts)
    for r in out:
        count, hit, names, own = plain(r.text, items, 4)
        assert (r.n_words, list(r["items"])) == (count, names)
        assert {i for s in r.ranges for i in range(s.first, s.end)} == hit
        for s in r.ranges:
            assert (s.start, s.stop) == (own[s.first].start(), own[s.end - 1].end())
    clean = remove_contaminated(docs, bench, window=4, part_bytes=part_bytes)
    assert clean.columns == docs.columns
    assert sorted(r.text or "" for r in clean.collect()) == sorted(t or "" for t in texts if not plain(t, items, 4)[1])


@pytest.mark.parametrize("text,item", [("a", "a"), ("a b", "a b"), ("a a b", "a a a b a")])
def test_repetitive_texts_take_linear_time(text, item):
    own, other = text.split() * (1_000_000 // len(text.split())), " ".join(item.split() * (1200 // len(item.split())))
    matcher = Matcher([("1", other.encode()), ("2", b"a a a a")], 10)
    began = time.time()
    runs, names = matcher.match([w.encode() for w in own])
    assert time.time() - began < 30
    few = " ".join(own[:200])
    count, hit, found, _ = plain(few, [("1", " ".join(other.split()[:60])), ("2", "a a a a")], 10)
    assert sorted(names) == found
    if text == "a":
        assert runs == [(0, len(own))]


def test_equal_hashes_are_compared(monkeypatch):
    monkeypatch.setattr(Matcher, "MODULUS", 7)
    test_matcher_equals_brute_force(4)


def test_further_parts_store_hits_alone(spark, monkeypatch):
    items, texts = cases()
    stored = []
    monkeypatch.setattr(decontaminate, "materialize", lambda df, name: stored.append(materialize(df, name)) or stored[-1])
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *["clean z"] * 500])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    out = find_passages(docs, bench, window=4, part_bytes=60)
    assert out.count() == len(texts) + 500 and len(stored) > 2
    assert all("text" not in df.columns and df.count() <= len(texts) for df in stored)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c"), (None, "x " * 300_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.ranges) for r in find_passages(docs, none).collect()] == [(3, []), (300_000, [])]
    assert find_passages(docs.limit(0), none).collect() == []
    assert remove_contaminated(docs, none).count() == 2
