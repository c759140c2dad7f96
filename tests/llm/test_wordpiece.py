"""Counts against a longest match that builds its pieces."""

import base64
import random

import pytest

from supportgraph.llm import wordpiece
from supportgraph.llm.packing import VOCABULARY, read_vocabulary


def plain(word, vocabulary):
    pieces, at = [], 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in vocabulary), None)
        if end is None:
            return 1
        pieces.append(word[at:end])
        at = end
    return len(pieces)


@pytest.mark.parametrize("single", [True, False])
def test_random_vocabularies(single):
    random.seed(single)
    for _ in range(200):
        vocabulary = {bytes(random.choices(b"abc", k=random.randrange(1, 6))) for _ in range(random.randrange(12))}
        vocabulary |= {b"a", b"b", b"c"} if single else set()
        automaton = wordpiece.build(sorted(vocabulary))
        for _ in range(60):
            word = bytes(random.choices(b"abc", k=random.randrange(14)))
            assert automaton.count(word) == plain(word, vocabulary)


def test_public_vocabulary():
    pieces = wordpiece.vocabulary_pieces(read_vocabulary(VOCABULARY))
    automaton, known = wordpiece.build(pieces), set(pieces)
    random.seed(2)
    words = ["unbelievably", "thanedble", "éèç", "12345678", "😀😀", "a" * 300, "https://example.com/x?y=1"]
    words += ["".join(random.choices("ethanoisrdluéß", k=random.randrange(1, 20))) for _ in range(500)]
    for word in words:
        raw = b" " + word.encode()
        assert automaton.count(raw) == plain(raw, known)


def test_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(wordpiece, "REMEMBERED", 2)
    path = tmp_path / "small.tiktoken"
    known = [b" ", b" a", b"b", b"a", b"bb", b" ab"]
    path.write_bytes(b"\n".join(base64.b64encode(p) + b" %d" % i for i, p in enumerate(known)))
    rows = [(1, None), (2, ""), (None, "a abb  bbb\nab"), (3, "x ab"), (3, "x ab"), (4, "ab " * 200_000)]
    docs = spark.createDataFrame([(*r, "y") for r in rows], "doc_id long, text string, n_words string")
    out = wordpiece.count_tokens(docs, vocabulary=str(path)).collect()
    for r in out:
        words = (r.text or "").split()
        assert (r.n_words, r.n_tokens) == (len(words), sum(plain(b" " + w.encode(), set(known)) for w in words))
    assert len(out) == len(rows)
    assert wordpiece.count_tokens(docs.limit(0), vocabulary=str(path)).collect() == []
