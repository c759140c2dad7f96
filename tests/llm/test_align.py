"""Alignments against shared ends and pairs found by sets."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from supportgraph.llm import align
from supportgraph.llm.queries import op13_alignment


@pytest.fixture(scope="module")
def plain_tokenizers():
    a = tokenizers.Tokenizer.from_file(align.FIRST)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=align.SECOND)


SYMBOLS = {c: b for c, b in align.byte_symbols().items()}


def plain(text, tools):
    """(groups, links) of one text, whole."""
    a, b = tools
    if not text:
        return [], []
    raw, ids_a, ids_b = (" " + text).encode(), a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(SYMBOLS[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return [], []
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
    groups, links, at_a, at_b = [], [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        to_a, to_b = int(np.sum(ends_a <= end)), int(np.sum(ends_b <= end))
        groups.append((ids_a[at_a:to_a], ids_b[at_b:to_b]))
        at_a, at_b = to_a, to_b
    for i, x in enumerate(ends_a):
        for j in np.flatnonzero(ends_b == x):
            links.append((ids_a[i], ids_b[j]))
    return groups, links


def spelled(groups):
    return ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)


def plain_table(texts, tools):
    found = [plain(t, tools) for t in texts]
    counts = Counter(pair for _, links in found for pair in links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    rows = []
    for groups, links in found:
        text = spelled(groups)
        rows.append((
            sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
            sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links),
            hashlib.sha256(text.encode()).hexdigest() if text else "",
        ))
    return rows


def test_shared_ends_of_random_sequences():
    random.seed(1)
    for size in (1, 3, 17, 40, 400, 3000):
        for share in (0.0, 0.02, 0.3, 1.0):
            first, second, starts, stops, at = [], [], [], [], 0
            for _ in range(4):
                length = random.randrange(size, size * 3 + 2)
                a = {at + x for x in random.sample(range(1, length), min(size, length - 1) - 1 if size > 1 else 0)}
                b = {x for x in a if random.random() < share} | {at + x for x in random.sample(range(1, length), length // 5)}
                a, b, at = a | {at + length}, b | {at + length}, at + length
                starts.append(len(first))
                first += sorted(a)
                second += sorted(b)
                stops.append(len(first))
            shared = align.shared_ends(*map(np.array, (first, second, starts, stops)))
            assert [x for x, s in zip(first, shared) if s] == sorted(set(first) & set(second))


def test_long_text_without_shared_ends():
    n = 100_000
    first, second = np.arange(1, n) * 2, np.r_[np.arange(1, n - 1) * 2 - 1, (n - 1) * 2]
    assert align.shared_ends(first, second, np.array([0]), np.array([n - 1])).sum() == 1


TEXTS = [
    None, "", " ", "a", "Hello world!", "  two  blanks ", "line\nbreak\t\ttab", "<|endoftext|> <s> </s> <unk> <0x41>", "é̀ 😀 日本語 ﬁ ½",
    "▁▁ under", "\x00\x01", "aaaa" * 2000, "the cat the dog " * 300, "don't DON'T we'll", "​﻿ x", "1234567890 " * 50,
]


def test_rows(spark, plain_tokenizers, monkeypatch):
    monkeypatch.setattr(align, "TEXTS_AT_ONCE", 5)
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(TEXTS)], "doc_id long, text string, `a.b` string")
    docs = docs.withColumn("Groups", F.lit(1)).withColumn("row", F.lit(2)).withColumn("pair", F.lit(3))
    out = align.align(docs)
    assert out.columns == ["doc_id", "text", "a.b", "row", "pair", *align.ADDED]
    for r in out.collect():
        groups, links = plain(r.text, plain_tokenizers)
        assert (r.groups, list(zip(r.link_a, r.link_b)), r.n_groups) == (spelled(groups), links, len(groups))
        assert (r["a.b"], r["row"], r["pair"]) == ("own", 2, 3)


@pytest.mark.parametrize("frequent", [0, 5, 1 << 18])
def test_counts(spark, plain_tokenizers, frequent):
    texts = [*TEXTS, *TEXTS[4:8], "the cat sat", "the cats sat"]
    docs = spark.createDataFrame([(None if i % 5 == 0 else i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_best int")
    out = align.align_and_count(docs, frequent=frequent)
    want = Counter(zip([r[0] for r in docs.collect()], plain_table(texts, plain_tokenizers)))
    assert Counter((r.doc_id, tuple(r)[2:]) for r in out.collect()) == want
    assert out.columns == ["doc_id", "text", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert align.align_and_count(docs.limit(0), frequent=frequent).collect() == []


def test_long_texts_are_cut_at_blanks(spark, plain_tokenizers, monkeypatch):
    random.seed(5)
    words = ["the", "cheapest", "é", "日本", "x9", "", "\n", "don't", "  ", "AKIA"]
    texts = [" ".join(random.choices(words, k=4000)) for _ in range(3)]
    from supportgraph.llm import packing

    monkeypatch.setattr(packing, "PIECE", 50)
    got = align.align(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert Counter(r.groups for r in got) == Counter(spelled(plain(t, plain_tokenizers)[0]) for t in texts)


def test_query_against_sets(spark, plain_tokenizers):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = Counter((r.doc_id, *x) for r, x in zip(rows, plain_table([r.text for r in rows], plain_tokenizers)))
    got = op13_alignment(spark, sf)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == want
