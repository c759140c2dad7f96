"""Targets against repeated sharing, thresholds against sorted hashes."""

import hashlib
import random
from fractions import Fraction

import pytest

from supportgraph.llm.mixing import mix, mixed


def share_out(sizes, weights, share, most):
    """Sources in order; shares by weight, full ones stop, the excess goes round again."""
    total, full = Fraction(share) * sum(sizes), {}
    while True:
        left = [i for i in range(len(sizes)) if i not in full]
        rest, weight = total - sum(full.values()), sum(weights[i % len(weights)] for i in left)
        shares = {i: rest * weights[i % len(weights)] / weight for i in left}
        over = [i for i in left if shares[i] > most * sizes[i]]
        if not over:
            return [float(full[i] if i in full else shares[i]) for i in range(len(sizes))]
        full |= {i: Fraction(most * sizes[i]) for i in over}


def count(text):
    for blank in "\t\n\v\f\r":
        text = (text or "").replace(blank, " ")
    return len([w for w in text.split(" ") if w])


def brute(rows, weights, share, most):
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(count(t) for _, t, s in rows if s == n) for n in names]
    out = {}
    for n, size, target in zip(names, sizes, share_out(sizes, weights, share, most)):
        target = round(target, 6)
        whole = min(int(target // size), most) if size else 0
        missing, upto, sums, total = target - whole * size, "", {}, 0
        hashes = {i: hashlib.md5(f"{'' if id is None else id}:{t or ''}".encode()).hexdigest() for i, (id, t, s) in enumerate(rows) if s == n}
        for i, h in hashes.items():
            sums[h] = sums.get(h, 0) + count(rows[i][1])
        for h in sorted(sums) if missing > 0 else []:
            if total + sums[h] >= missing:
                upto = h + "~" if total + sums[h] - missing < missing - total else h
                break
            total += sums[h]
        for i, h in hashes.items():
            out[i] = (size, target, whole + (h < upto))
    return out


def table(seed):
    random.seed(seed)
    rows = [(i, "w " * random.randrange(60), random.choice(["a", "b", "b", "b", "é", "Z", "", None])) for i in range(400)]
    rows += [(None, None, "nothing"), (1, " \t\x0b", "nothing"), (None, "x  y z", None), (5, "same", "ties"), (5, "same", "ties")]
    return rows + [(900, "long " * 100_000, "b"), (7, "w w", "single")]


@pytest.mark.parametrize("weights,share,most", [((5, 2, 1), 1.5, 2), ((1,), 0.25, 2), ((3, 1), 2.75, 3)])
def test_equals_brute_force(spark, weights, share, most):
    rows = table(len(weights))
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, source string, size long")
    out = mix(docs.withColumn("row", docs.size).repartition(3), weights, share, most).collect()
    want = brute(rows, weights, Fraction(share), most)
    assert len(out) == len(rows)
    for r in out:
        size, target, copies = want[r.row]
        assert (r.size, r.source_size, r.copies, r.taken) == (count(r.text), size, copies, copies * count(r.text))
        assert r.target == pytest.approx(target, abs=1e-5) and r.copies <= most


def test_rows_are_repeated_and_reruns_agree(spark):
    rows = table(9)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumnRenamed("doc_id", "taken")
    docs = docs.withColumnRenamed("taken", "doc_id")
    want = brute(rows, (5, 2, 1), Fraction(3, 2), 2)
    expected = sorted(str(rows[i]) for i, (_, _, n) in want.items() for _ in range(n))
    for parts in (1, 5):
        out = mixed(docs.repartition(parts))
        assert out.columns == docs.columns
        assert sorted(str(tuple(r)) for r in out.collect()) == expected


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(docs).collect() == [] and mixed(docs).collect() == []
    blank = spark.createDataFrame([(1, "", None), (2, None, "a")], docs.schema)
    assert [(r.target, r.taken) for r in mix(blank).collect()] == [(0.0, 0)] * 2
