"""An index kept up by changes holds what a new one over the same table would hold."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from supportgraph.operators import ivf, upkeep
from supportgraph.operators.search import exact_topk
from supportgraph.workspace import children

DIM = 8
TYPE = "ticketId long, embedding array<double>"


def table(spark, rows):
    return spark.createDataFrame([(i, None if r is None else [float(x) for x in r]) for i, r in rows.items()], TYPE)


def state(spark, path):
    rows = upkeep.read(spark, path).entries.collect()
    assert len(rows) == len({r.ticketId for r in rows})
    return {r.ticketId: (r["list"], bytes(r.code), tuple(np.round(r.embedding, 12))) for r in rows}


@pytest.fixture(scope="module")
def data(spark):
    random = np.random.default_rng(4)
    rows = dict(enumerate(random.normal(size=(400, DIM))))
    return rows, ivf.train(table(spark, rows), DIM, lists=20)


def test_updates_and_compaction_equal_a_new_index(spark, tmp_path, data):
    rows, quantizer = data
    rows, random, path = dict(rows), np.random.default_rng(9), str(tmp_path / "index")
    assert upkeep.create(table(spark, rows), quantizer, path) == upkeep.Upkeep(400, 0, 0)
    for step in range(3):
        gone, moved = (random.choice(sorted(rows), n, replace=False).tolist() for n in (12, 30))
        for key in moved:
            rows[key] = random.normal(size=DIM)
        for key in gone:
            del rows[key]
        for key in [1000 + step, *([gone[0]] if step else [])]:  # one goes and comes back
            rows[key] = random.normal(size=DIM)
        done = upkeep.update(table(spark, rows), path)
        assert done.inserted - done.deleted == len(rows) - (400 if step == 0 else before)
        before = len(rows)
        new = str(tmp_path / f"new{step}")
        upkeep.create(table(spark, rows), quantizer, new)
        assert state(spark, path) == state(spark, new)
        if step == 1:
            assert upkeep.compact(spark, path, share=0.2)
            assert state(spark, path) == state(spark, new)
    assert upkeep.compact(spark, path, share=0.0) and state(spark, path) == state(spark, new)
    assert upkeep.compact(spark, path, share=0.0) == []
    queries = table(spark, {i: random.normal(size=DIM) for i in range(20)}).withColumnRenamed("ticketId", "query_id")
    found = ivf.ivf_topk(queries, upkeep.read(spark, path), 3, probes=10**6, refine=10**6)
    exact = exact_topk(queries, table(spark, rows), 3, DIM)
    as_rows = lambda df: sorted((r.query_id, r["rank"], r.ticketId) for r in df.collect())
    assert as_rows(found) == as_rows(exact)


def test_only_what_changed_is_written(spark, tmp_path, data):
    rows, quantizer = data
    path = str(tmp_path / "index")
    upkeep.create(table(spark, rows), quantizer, path)
    assert upkeep.update(table(spark, rows), path) == upkeep.Upkeep(0, 0, 0)
    assert children(spark, f"{path}/manifest") == ["0"]
    changed = dict(rows) | {3: -rows[3], 500: rows[4]}
    del changed[7]
    assert upkeep.update(table(spark, changed), path) == upkeep.Upkeep(1, 1, 1)
    written = spark.read.parquet(f"{path}/entries/generation=1")
    assert sorted(r.ticketId for r in written.collect()) == [3, 500]
    assert sorted(r.ticketId for r in spark.read.parquet(f"{path}/gone/generation=1").collect()) == [3, 7]
    parts = upkeep.compact(spark, path, share=0.0)
    assert 0 < len(parts) <= 4
    assert spark.read.parquet(f"{path}/entries/generation=2").select("part").distinct().count() <= len(parts)


def test_a_run_that_fails_leaves_the_index(spark, tmp_path, data, monkeypatch):
    rows, quantizer = data
    path = str(tmp_path / "index")
    upkeep.create(table(spark, rows), quantizer, path)
    held = state(spark, path)
    with monkeypatch.context() as patch:
        patch.setattr(upkeep, "_publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            upkeep.update(table(spark, {1: rows[1], 2: -rows[2]}), path)
    assert state(spark, path) == held
    assert upkeep.update(table(spark, {1: rows[1], 2: rows[3]}), path) == upkeep.Upkeep(0, 1, 398)
    assert sorted(state(spark, path)) == [1, 2]


def test_unfit_repeated_and_no_rows(spark, tmp_path, data):
    rows, quantizer = data
    path = str(tmp_path / "index")
    odd = [(1, list(rows[1])), (1, list(rows[1])), (2, list(rows[2])), (2, list(rows[3])), (3, None), (None, list(rows[4])),
           (5, [0.0] * DIM), (6, [float("nan")] * DIM), (7, [1.0]), (8, [1e-200] * DIM)]
    vectors = spark.createDataFrame([(k, None if v is None else [float(x) for x in v]) for k, v in odd], TYPE)
    assert upkeep.create(vectors, quantizer, path) == upkeep.Upkeep(2, 0, 0)
    assert sorted(state(spark, path)) == [1, 2]
    assert upkeep.update(vectors.orderBy(F.desc("ticketId")), path) == upkeep.Upkeep(0, 0, 0)
    assert upkeep.update(vectors.limit(0), path) == upkeep.Upkeep(0, 0, 2)
    assert state(spark, path) == {}
    empty = str(tmp_path / "empty")
    assert upkeep.create(vectors.limit(0), quantizer, empty) == upkeep.Upkeep(0, 0, 0)
    assert upkeep.update(vectors, empty) == upkeep.Upkeep(2, 0, 0)
    assert sorted(state(spark, empty)) == [1, 2]
