"""Sums against one matrix, calibration against a brute-force fit, held-out ranking, odd inputs."""

import random

import numpy as np
from pyspark.sql import functions as F

from supportgraph.llm import quality


def table(n=600):
    rng = random.Random(2)
    words = ["alpha", "of", "beta", "and", "gamma", "rather", "delta"]
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        own = rng.choices(words, k=rng.randrange(3, 80))
        text = " ".join(own) + "." if good else " ".join(w + rng.choice(["$$$", "###", "%"]) for w in own)
        rows.append((i, text))
        labels.append((i, int(good if rng.random() < 0.97 else not good)))
    return rows, labels


def test_normal_equations_are_those_of_the_whole_matrix(spark):
    rows, labels = table(120)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    stats = quality.document_statistics(docs, "text", ["doc_id"])
    known = stats.join(spark.createDataFrame(labels, "doc_id long, quality int"), "doc_id")
    part = known.select((F.col("doc_id") % 2).cast("int").alias("_half"), F.col("quality").cast("double").alias("_label"), *quality.STATISTICS)
    kernel = quality._kernel(part, 16, 4.0, 1)
    sums = quality._equations(part, kernel)
    whole = part.toArrow().combine_chunks().to_batches()[0]
    for h in (0, 1):
        own = np.array(whole.column(0)) == h
        x = kernel.map(whole, 2)[own]
        assert np.allclose(sums[h][:, :-1], x.T @ x) and np.allclose(sums[h][:, -1], x.T @ np.array(whole.column(1))[own])


def test_features_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(1)
    n = len(quality.STATISTICS)
    kernel = quality.Kernel(np.zeros(n), np.ones(n), rng.normal(0, 1 / 4.0, (n, 4096)), rng.uniform(0, 2 * np.pi, 4096))
    points = rng.normal(0, 1, (6, n))
    batch = quality.pa.RecordBatch.from_arrays([quality.pa.array(c) for c in points.T], names=quality.STATISTICS)
    x = kernel.map(batch, 0)[:, :-1]
    distance = ((points[:, None] - points[None]) ** 2).sum(axis=2)
    assert np.abs(x @ x.T - np.exp(-distance / 32)).max() < 0.08


def test_isotonic_is_the_nearest_rising_sequence():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = rng.integers(1, 8)
        y, w = rng.integers(0, 4, n).astype(float), rng.integers(1, 4, n).astype(float)
        fit = quality.isotonic(y, w)
        # The largest of the smallest means over ranges around a point.
        want = [max(min(np.average(y[a:b], weights=w[a:b]) for b in range(i + 1, n + 1)) for a in range(i + 1)) for i in range(n)]
        assert np.allclose(fit, want)


def test_held_out_ranking(spark):
    rows, labels = table()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.classify(docs, known, F.col("doc_id") % 3 != 1).collect()}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    held = [(out[i].predicted, label) for i, label in labels if i % 3 == 1]
    assert np.mean([a == b for a, b in held]) > 0.93
    share = np.mean([out[i].score for i, _ in labels if i % 3 == 1])
    assert abs(share - np.mean([label for _, label in held])) < 0.08


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x"), (4, "\n" * 50), (5, "long " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(1, 1), (1, 0), (3, 1), (None, 1), (4, None)], "doc_id long, quality int")
    for labels in (known, known.limit(0), known.filter("doc_id = 1")):
        out = quality.classify(docs, labels, F.lit(True)).collect()
        assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert quality.classify(docs.limit(0), known, F.lit(True)).collect() == []
