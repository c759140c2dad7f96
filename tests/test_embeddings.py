"""Vectors by content: which texts a model is asked for, and that rows get their own vectors."""

from __future__ import annotations

import os
import uuid

import pytest
from pyspark.sql import functions as F

from supportgraph.plans.build import embed_csv
from supportgraph.plans.embeddings import embed_by_content, stored_vectors
from supportgraph.sources.tables import CSV_OPTIONS, read_csv_vectors


def counting(folder):
    """A client that leaves a file for each text it is asked for."""
    folder = str(folder)

    def factory():
        class Client:
            def embed(self, texts):
                for text in texts:
                    with open(os.path.join(folder, uuid.uuid4().hex), "w") as file:
                        file.write(text)
                return [[float(len(t)), float(sum(map(ord, t)) % 97)] for t in texts]

        return Client()

    return factory


def asked(folder):
    return sorted(file.read_text() for file in folder.iterdir())


def vector(text):
    return [float(len(text or "")), float(sum(map(ord, text or "")) % 97)]


@pytest.fixture
def seen(tmp_path):
    folder = tmp_path / "asked"
    folder.mkdir()
    return folder


def test_each_text_once_and_only_unseen(spark, tmp_path, seen):
    store, factory = str(tmp_path / "store"), counting(seen)
    first = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "")]
    rows = spark.createDataFrame(first * 2, "id int, text string").repartition(3)
    found = embed_by_content(rows, F.col("text"), store, 2, factory).collect()
    assert sorted((r.id, r.embedding) for r in found) == sorted((i, vector(t)) for i, t in first * 2)
    assert asked(seen) == ["", "a", "b"]
    more = spark.createDataFrame([(6, "c"), (7, "a")], "id int, text string")
    again = embed_by_content(rows.unionByName(more), F.col("text"), store, 2, factory).collect()
    assert {r.id: r.embedding for r in again} == {i: vector(t) for i, t in [*first, (6, "c"), (7, "a")]}
    assert asked(seen) == ["", "a", "b", "c"]
    assert stored_vectors(spark, store).count() == 4


def test_second_run_over_a_csv_asks_for_nothing(spark, tmp_path, seen):
    store, factory, source = str(tmp_path / "store"), counting(seen), str(tmp_path / "in")
    rows = [(f"t{i}", f"title {i % 7}", "line\nbreak" if i % 2 else None) for i in range(40)]
    spark.createDataFrame(rows, "ticketId string, title string, description string").write.options(**CSV_OPTIONS).csv(source)
    embed_csv(spark, source, str(tmp_path / "one"), 2, factory, store=store)
    once = asked(seen)
    assert len(once) == len(set(once)) == 14
    embed_csv(spark, source, str(tmp_path / "two"), 2, factory, store=store)
    assert asked(seen) == once
    one, two = ({r.ticketId: r.embedding for r in read_csv_vectors(spark, str(tmp_path / p)).collect()} for p in ("one", "two"))
    assert one == two and len(one) == 40


def test_hot_text_clashing_names_and_empty_table(spark, tmp_path, seen):
    store, factory = str(tmp_path / "store"), counting(seen)
    rows = spark.range(300).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("text"),
        F.col("id").alias("digest"), F.lit("own").alias("row"), F.lit(1).alias("a.b"), F.lit(0).alias("embedding"),
    )
    found = embed_by_content(rows, F.col("text"), store, 2, factory)
    assert found.columns == ["text", "digest", "row", "a.b", "embedding"]
    got = found.collect()
    assert sorted(r.digest for r in got) == list(range(300))
    assert all(r.embedding == vector(r.text) and r.row == "own" and r["a.b"] == 1 for r in got)
    assert len(asked(seen)) == 101
    none = embed_by_content(rows.limit(0), F.col("text"), str(tmp_path / "other"), 2, factory)
    assert none.collect() == [] and len(asked(seen)) == 101


def test_vectors_held_twice_give_one_row(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = spark.createDataFrame([(1, "a"), (2, "")], "id int, text string")
    embed_by_content(rows, F.col("text"), store, 4)
    stored_vectors(spark, store).write.mode("append").parquet(store)
    found = embed_by_content(rows, F.col("text"), store, 4).collect()
    assert sorted(r.id for r in found) == [1, 2]
    assert {r.id: r.embedding is None for r in found} == {1: False, 2: True}
