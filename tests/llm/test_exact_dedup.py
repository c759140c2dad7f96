"""Exact duplicates against a dictionary, with filters of every size."""

import hashlib
import random

import pytest

from pyspark.sql import functions as F

from supportgraph.llm import exact_dedup as exact_dedup_module
from supportgraph.llm.common import join_groups
from supportgraph.llm.exact_dedup import digest_ranges, exact_dedup, filter_bits


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = {}
    for id, text in rows:
        groups.setdefault(lower(text), []).append(id)
    out = []
    for id, text in rows:
        ids = groups[lower(text)]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((id, keep, len(ids), id == keep, hashlib.sha256(lower(text).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bound", [1, 8192, 64 << 20])
def test_equals_brute_force(spark, bound):
    random.seed(1)
    words = ["Á", "á", "A", "a", "B", "", " "]
    rows = [(i, "".join(random.choices(words, k=random.randrange(5)))) for i in range(300)]
    rows += [(1000 + i, f"alone {i}") for i in range(300)] + [(2000 + i, "HOT") for i in range(400)]
    rows += [(None, None), (None, "only null id"), (7, "tie"), (7, "TIE"), (9000, "x" * 500_000), (9001, "X" * 500_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = exact_dedup(docs, max_filter_bytes=bound)
    assert sorted((tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in out.collect()), key=str) == brute(rows)


def test_empty_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, kept string, lang string")
    assert exact_dedup(docs).collect() == []
    docs = spark.createDataFrame([(1, "a", "x", None), (2, "A", None, "en")], docs.schema)
    out = exact_dedup(docs)
    assert out.columns == ["doc_id", "lang", "keep_id", "group_size", "kept", "text_sha256"]
    assert [(r.doc_id, r.kept) for r in out.orderBy("doc_id").collect()] == [(1, False), (2, True)]


def test_only_the_repeated_rows_are_shuffled(spark, monkeypatch):
    """A bound far too small for all rows: ranges of digests, each with a filter that tells them apart."""
    shuffled, columns = [], set()

    def counted(rows, *rest):
        shuffled.append(rows.count())
        columns.update(rows.columns)
        return join_groups(rows, *rest)

    monkeypatch.setattr(exact_dedup_module, "join_groups", counted)
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text "), F.when(F.col("id") < 2000, F.col("id") % 500).otherwise(F.col("id"))).alias("text"))
    out = exact_dedup(rows, max_filter_bytes=8192)
    assert len(shuffled) > 3 and 2000 <= sum(shuffled) < 4500
    assert "text" not in out.columns and not any(rows.schema[i].dataType.simpleString() == "string" and f"own{i}" in columns for i in range(2))
    assert out.filter("kept").count() == 38_500 and out.count() == 40_000


def test_ranges_cover_every_digest_once():
    for rows in (0, 5, 8192, 10**5, 10**7):
        ranges = digest_ranges(rows, 1)
        assert ranges[0][0] is None and ranges[-1][1] is None
        assert [end for _, end in ranges[:-1]] == [first for first, _ in ranges[1:]] == sorted(first for first, _ in ranges[1:])
        assert rows / len(ranges) <= 8192
    assert len(digest_ranges(10**10, 64 << 20)) == 256


def test_filter_never_exceeds_its_bound():
    assert filter_bits(0, 1) == 1 << 16
    assert filter_bits(10**12, 64 << 20) == 64 << 23
    assert filter_bits(10**6, 64 << 20) >= 8 * 10**6


def test_join_groups_keeps_every_row(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(900)] + [(901, None)], "i long, k string")
    groups = rows.filter("k IS NOT NULL").groupBy("k").count()
    out = {r.i: r["count"] for r in join_groups(rows, groups, "k", "count", "i").collect()}
    assert len(out) == 901 and out[901] is None and out[1] == 600 and out[3] == 1
