"""Best fit against a search of all bins, exact round trip of every text."""

import random

import numpy as np
import pytest

from supportgraph.llm import packing


def plain_best_fit(lengths, length):
    bins, rooms = [], []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [r for r in rooms if r >= lengths[item]]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - lengths[item])
        else:
            rooms.append(length - lengths[item])
            bins.append(item)
    return sorted(rooms)


@pytest.mark.parametrize("length", [1, 7, 8, 100])
def test_best_fit_equals_a_search_of_all_bins(length):
    random.seed(length)
    for _ in range(60):
        lengths = [random.randrange(1, length + 1) for _ in range(random.randrange(60))]
        bins = packing.best_fit(lengths, length)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert sorted(length - sum(lengths[i] for i in b) for b in bins) == plain_best_fit(lengths, length)


def test_cut_texts_have_the_tokens_of_the_whole(monkeypatch):
    encode = packing.encoder(packing.read_vocabulary(packing.VOCABULARY)).encode_ordinary
    random.seed(1)
    parts = ["a", " ", "  ", "\n", "é", "12", "'s", "!", "word", " ", "\t", " the"]
    monkeypatch.setattr(packing, "PIECE", 5)
    for _ in range(300):
        text = "".join(random.choices(parts, k=random.randrange(40)))
        assert "".join(packing.pieces(text)) == text
        assert [t for p in packing.pieces(text) for t in encode(p)] == encode(text)


def table():
    random.seed(6)
    rows = [(i, " ".join(random.choices(["über", "the", "zzqx", "1 2", "\n"], k=random.choice([1, 5, 40, 300])))) for i in range(80)]
    return rows + [(None, "null id"), (200, None), (201, ""), (3, "again"), (3, "again"), (202, "long " * 60_000), (203, "x" * 50_000)]


@pytest.mark.parametrize("length,shard", [(64, 1000), (2048, 1 << 22)])
def test_round_trip(spark, tmp_path, length, shard):
    rows = table()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string").repartition(3)
    packed = packing.pack(docs, length=length, shard_tokens=shard)
    packing.write(packed, str(tmp_path / "packed"))
    found = spark.read.parquet(str(tmp_path / "packed")).collect()
    table_of_ids = packing.matrix(found, length)
    decode = packing.encoder(packing.read_vocabulary(packing.VOCABULARY)).decode
    parts = {}
    for r, ids in zip(found, table_of_ids):
        edges = list(r.cu_seqlens)
        assert edges[0] == 0 and edges[-1] == r.n_tokens <= length and edges == sorted(set(edges))
        assert (ids[r.n_tokens :] == 50256).all()
        bits = np.unpackbits(np.frombuffer(bytes(r.resets), np.uint8))[:length]
        positions = packing.position_ids(edges, length)
        assert (np.flatnonzero(bits) == np.flatnonzero(positions == 0)).all()
        assert len(r.doc_ids) == len(r.offsets) == len(edges) - 1
        for doc, offset, a, b in zip(r.doc_ids, r.offsets, edges, edges[1:]):
            parts.setdefault((doc, offset // length), []).append(ids[a:b].tolist())
    texts = []
    for (doc, number), segments in parts.items():
        if number:
            continue
        for first in segments:
            tokens, n = list(first), 1
            while tokens[-1] != 50256:
                tokens += parts[doc, n][0]
                n += 1
            texts.append((doc, decode(tokens[:-1])))
    assert sorted(texts, key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    again = packing.pack(docs, length=length, shard_tokens=shard).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_large_vocabularies_are_refused(monkeypatch):
    monkeypatch.setattr(packing, "MOST_VOCABULARY", 10)
    with pytest.raises(ValueError):
        packing.read_vocabulary(packing.VOCABULARY)
