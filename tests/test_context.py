import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from supportgraph.operators.context import context_rows, solution_cards, with_author_role
from supportgraph.operators.ranking import rank_in_group

COMMENT = "ticketId int, commentId string, creationDate timestamp, isSolution boolean"


def random_comments(seed, n=400, step=dt.timedelta(minutes=15)):
    """One ticket with a third of all comments, times that repeat, some missing."""
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        ticket = 0 if rng.random() < 0.34 else rng.randrange(1, 25)
        at = start + step * rng.randrange(60)
        if rng.random() < 0.2:
            at = start
        rows.append((ticket, f"c{i:04d}", None if rng.random() < 0.05 else at, rng.random() < 0.4))
    return rows


def brute_force(rows, limit):
    expected = set()
    for ticket, solution, at, is_solution in rows:
        if not is_solution or at is None:
            continue
        before = [r for r in rows if r[0] == ticket and r[2] is not None and r[2] < at]
        before.sort(key=lambda r: r[1])
        before.sort(key=lambda r: r[2], reverse=True)
        expected |= {(solution, place, r[1]) for place, r in enumerate(before[:limit], 1)}
    return expected


@pytest.mark.parametrize("large_ticket", [100_000, 20, 0], ids=["whole", "mixed", "pieces"])
@pytest.mark.parametrize("limit", [1, 3, 0])
def test_context_equals_brute_force(spark, large_ticket, limit):
    rows = random_comments(limit)
    found = context_rows(spark.createDataFrame(rows, COMMENT), limit, large_ticket)
    got = {(r.solutionId, r.position, r.commentId) for r in found.collect()}
    assert got == brute_force(rows, limit)


def test_pieces_of_fractional_seconds(spark):
    rows = random_comments(7, step=dt.timedelta(microseconds=137))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    try:
        found = context_rows(spark.createDataFrame(rows, COMMENT), 3, 0)
        got = {(r.solutionId, r.position, r.commentId) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == brute_force(rows, 3)


@pytest.mark.parametrize("large_ticket", [100_000, 0], ids=["whole", "pieces"])
def test_every_solution_gets_a_card(spark, large_ticket):
    rows = random_comments(9, 120)
    comments = (
        spark.createDataFrame(rows, COMMENT)
        .withColumn("content", F.col("commentId"))
        .withColumn("known", F.lit(True))
        .withColumn("role", F.lit("agent"))
    )
    cards = solution_cards(comments, 2, large_ticket=large_ticket).collect()
    assert sorted(r.solutionId for r in cards) == sorted(r[1] for r in rows if r[3])
    for r in cards:
        assert len(r.context) <= 2
        assert all(c.creationDate < r.solutionDate for c in r.context)


def test_cards(graph):
    comments = with_author_role(graph.comment, graph.user)
    cards = {r.solutionId: r for r in solution_cards(comments, 3).collect()}
    assert set(cards) == {"m4", "m6", "m10", "m11"}
    assert [c.commentId for c in cards["m4"].context] == ["m2", "m3", "m1"]
    assert [c.commentId for c in cards["m6"].context] == ["m4", "m2", "m3"]
    assert [(c.known, c.role) for c in cards["m4"].context] == [
        (True, "agent"), (False, None), (True, "employee"),
    ]
    assert cards["m10"].context == [] and cards["m11"].context == []
    oldest = {r.solutionId: r for r in solution_cards(comments, 3, "oldest").collect()}
    assert [c.commentId for c in oldest["m4"].context] == ["m1", "m3", "m2"]
    none = solution_cards(comments, 0).collect()
    assert len(none) == 4 and all(r.context == [] for r in none)


def test_rank_in_a_large_group(spark):
    rows = [("big", i) for i in range(500)] + [("a", 3), ("a", 1), ("z", 7)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v int").repartition(6)
    ranked = rank_in_group(df, "g", [F.desc("v")]).collect()
    got = {(r.g, r.v): r["rank"] for r in ranked}
    assert len(ranked) == 503
    assert all(got["big", i] == 500 - i for i in range(500))
    assert (got["a", 3], got["a", 1], got["z", 7]) == (1, 2, 1)
