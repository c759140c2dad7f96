"""Fingerprints against a plain count of bits, components against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from supportgraph.llm import simhash


def plain_fingerprint(text, shingle):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\v\f\r":
        lower = lower.replace(blank, " ")
    words = [w for w in lower.split(" ") if w]
    if not words:
        return 0
    width = min(shingle, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), 42) for i in range(len(words) - width + 1)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(prints, distance):
    """Smallest id by spreading over all pairs; rows are (id, fingerprint)."""
    label = [i if i is not None else float("inf") for i, _ in prints]
    changed = True
    while changed:
        changed = False
        for a, (_, x) in enumerate(prints):
            for b, (_, y) in enumerate(prints):
                if label[b] < label[a] and (x ^ y).bit_count() <= distance:
                    label[a], changed = label[b], True
    return [None if v == float("inf") else v for v in label]


def test_fingerprints_equal_a_plain_count(monkeypatch):
    monkeypatch.setattr(simhash, "SHINGLES", 7)
    for text in ["", "one", "One two", "a b c", "a b\x1cc D e f\tg " * 9, "É é E e " * 20, "x " * 50]:
        assert simhash.fingerprint(text.encode(), 3) == plain_fingerprint(text, 3)


@pytest.mark.parametrize("distance,groups", [(0, 3), (1, 2), (2, 3), (3, 1), (3, 2), (3, 3), (3, 4)])
def test_near_numbers_share_a_variant(distance, groups):
    random.seed(distance)
    sets = simhash.variant_masks(distance, groups)

    def ball(x):
        return {(int(f) ^ (x & kept | mark)) for kept, mark, flips in sets for f in flips}

    for _ in range(150):
        x, y = random.getrandbits(64), 0
        for b in random.sample(range(64), random.randrange(distance + 1)):
            y |= 1 << b
        assert ball(x) & ball(x ^ y)


@pytest.mark.parametrize("distance", [2, 3])
def test_components_equal_all_pairs(spark, distance):
    random.seed(5)
    prints = []
    for c in range(12):
        x = random.getrandbits(64)
        for _ in range(random.choice([1, 2, 5, 25])):
            prints.append(x)
            for b in random.sample(range(64), random.randrange(distance + 2)):
                x ^= 1 << b
    x = random.getrandbits(64)
    prints += [x ^ (1 << a) ^ (1 << b) for a in range(8) for b in range(8)] + [0, 0, 1, 1 << 63]
    rows = [(None if i % 17 == 3 else int(i * 7919 % 1009), p) for i, p in enumerate(prints)]
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in set(prints)], "fingerprint long")
    found = simhash.components(simhash.links(simhash.variants(frame, distance, 3), distance))
    root = {r.node: r.root for r in found.collect()}
    groups = {}
    for i, (id, p) in enumerate(rows):
        signed = int(np.uint64(p).view(np.int64))
        groups.setdefault(root.get(signed, signed), []).append(i)
    got = [None] * len(rows)
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            got[i] = min(ids, default=None)
    assert got == plain_components(rows, distance)


def corpus():
    random.seed(3)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(random.choices(words, k=300)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(60):
        own = base[i % 2].split()
        own[random.randrange(300)] = f"new{i}"
        rows.append((100 + i, " ".join(own)))
    rows += [(200 + i, base[0].upper()) for i in range(40)] + [(300, None), (301, ""), (None, "alone of all"), (None, base[0])]
    return rows + [(5, base[5]), (None, "alone of all"), (400, "one two"), (401, "ONE  two"), (402, "y " * 200_000)]


def test_whole_operator_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    prints = [(id, plain_fingerprint(t, 3)) for id, t in rows]
    want = sorted(((id, p, c) for (id, p), c in zip(prints, plain_components(prints, 3))), key=str)
    got = [(r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == want
    kept = simhash.keep_one(docs.withColumn("fingerprint", docs.text)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({c for _, _, c in want if c is not None})
    assert [r.text for r in kept if r.doc_id is None] == ["alone of all"]


def test_one_row_stays_of_each_group_with_shared_ids(spark):
    one, two = "a b c d e f g h", "q r s t u v w x y"
    rows = [(5, one), (5, two), (5, two), (2, one), (9, "z z z z"), (9, "z z z z"), (None, two), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text or "") for r in simhash.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted([(2, one), (5, two), (9, "z z z z"), (None, "")], key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == [] and simhash.keep_one(docs).collect() == []
