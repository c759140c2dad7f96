import datetime as dt
import hashlib
import math
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from supportgraph.functions import rules, text
from supportgraph.functions.embedding import (
    ask,
    embed_columns,
    hashed_embedding,
    model_embedding,
)
from supportgraph.functions.parsing import as_utc, parse_bool, parse_datetime, parse_int
from supportgraph.functions.similarity import cosine_score
from supportgraph.operators.quality import validate_analysis


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    df = spark.createDataFrame([tuple(values.values())], schema)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "value,expected",
    [("true", True), ("YES", True), ("1", True), ("no", False), ("", False), (None, False)],
)
def test_bool(spark, value, expected):
    assert one(spark, parse_bool(F.col("a")), a=value) is expected


@pytest.mark.parametrize(
    "value,expected", [("3", 3), ("2.7", 2), ("-2.7", -2), ("x", None), ("", None), (None, None)]
)
def test_int(spark, value, expected):
    assert one(spark, parse_int(F.col("a")), a=value) == expected


@pytest.mark.parametrize(
    "value,expected",
    [
        ("2024-02-03 04:05:06", dt.datetime(2024, 2, 3, 4, 5, 6)),
        ("2024-02-03T04:05:06+02:00", dt.datetime(2024, 2, 3, 2, 5, 6)),
        ("soon", None),
        ("", None),
    ],
)
def test_datetime(spark, value, expected):
    assert one(spark, parse_datetime(F.col("a")), a=value) == expected


@pytest.mark.parametrize(
    "value,expected",
    [
        ("2024-02-03 04:05:06", "2024-02-03T04:05:06+00:00"),
        ("2024-02-03 04:05:06.120", "2024-02-03T04:05:06.120000+00:00"),
        (None, None),
    ],
)
def test_iso(spark, value, expected):
    assert one(spark, text.iso_datetime(F.col("a").cast("timestamp")), a=value) == expected


def test_times_without_a_zone_are_utc_in_any_session(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # The second time does not exist on a clock in New York, the third exists twice.
        for plain in ("2024-01-01 08:00:00", "2024-03-10 02:30:00", "2024-11-03 01:30:00", "2024-02-03"):
            at = parse_datetime(F.col("a"))
            clock = plain if " " in plain else f"{plain} 00:00:00"
            assert one(spark, text.stamp(at), a=plain) == clock
            assert one(spark, text.iso_datetime(at), a=plain) == clock.replace(" ", "T") + "+00:00"
            assert one(spark, text.stamp(as_utc(F.col("a").cast("timestamp_ntz"))), a=plain) == clock
        zoned = parse_datetime(F.col("a"))
        assert one(spark, text.stamp(zoned), a="2024-01-01T08:00:00-05:00") == "2024-01-01 13:00:00"
        assert one(spark, text.stamp(zoned), a="2024-01-01 08:00:00Z") == "2024-01-01 08:00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_iso_outside_utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        at = F.col("a").cast("timestamp")
        assert one(spark, text.iso_datetime(at), a="2024-02-03 09:00:00") == (
            "2024-02-03T00:00:00+00:00"
        )
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_small_texts(spark):
    assert one(spark, text.or_default(F.col("a"), "None given"), a="") == "None given"
    assert one(spark, text.or_default(F.col("a"), "None given"), a=None) == "None given"
    assert one(spark, text.label_of(F.col("a")), a="x.y.json") == "x"
    assert one(spark, text.percent_text(F.col("a").cast("double")), a="0.8349") == "83.5%"
    assert one(spark, text.score_text(F.col("a").cast("double")), a="0.91349") == "0.913"
    joined = text.join_text(F.col("a"), F.col("b"))
    assert one(spark, joined, a="x", b=None) == "x"
    assert one(spark, text.join_text(F.col("a"), F.col("b"), null_text="nan"), a="x", b=None) == (
        "x nan"
    )


def test_search_gate(spark):
    cases = {
        "Hello, how are you today?": False,
        "I can't access the tool from my account, it says 'access denied'.": True,
        "What is this tool?": False,
        "It is giving me error code 500 when I try to upload a file": True,
        "How do I reset my password?": True,
        "Thank you for your help!": False,
        "Hello, the page crashed": True,
        "Where are last year's reports?": True,
        "  ": False,
    }
    df = spark.createDataFrame([(q,) for q in cases], "q string")
    found = {r.q: r.x for r in df.select("q", rules.needs_search(F.col("q")).alias("x")).collect()}
    assert found == cases


def test_analysis_rules(spark):
    rows = [
        ("ok", True, "cat_001", " Short title ", " text\n"),
        ("no category", None, None, "Title", "text"),
        ("unrelated", False, None, "Title", "text"),
        ("bad category", True, "cat_010", "Title", "text"),
        ("long", True, None, "x" * 101, "text"),
        ("wordy", True, None, "a b c d e f g h i j k", "text"),
        ("ten words", True, None, "a b c d e f g h i j", "text"),
        ("blank", True, None, "Title", "   "),
        ("null title", True, None, None, "text"),
        ("null description", True, None, "Title", None),
    ]
    df = spark.createDataFrame(
        rows, "id string, is_related boolean, category string, title string, description string"
    )
    got = {r.id: tuple(r)[1:] for r in validate_analysis(df).collect()}
    assert got == {
        "ok": (True, "cat_001", "Short title", "text"),
        "no category": (True, None, "Title", "text"),
        "unrelated": (False, None, "Title", "text"),
        "bad category": (False, None, "Error", rules.CATEGORY_UNKNOWN),
        "long": (False, None, "Error", rules.TITLE_TOO_LONG),
        "wordy": (False, None, "Error", rules.TITLE_TOO_MANY_WORDS),
        "ten words": (True, None, "a b c d e f g h i j", "text"),
        "blank": (False, None, "Error", rules.DESCRIPTION_EMPTY),
        "null title": (False, None, "Error", rules.TITLE_MISSING),
        "null description": (False, None, "Error", rules.DESCRIPTION_EMPTY),
    }


def plain_embedding(value, dim):
    counts = [0] * dim
    for word in re.findall(r"[^\W_]+", (value or "").lower()):
        counts[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dim] += 1
    length = math.sqrt(sum(n * n for n in counts))
    return [n / length for n in counts] if length else None


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("aAbB zé9_-\n", max_size=40), min_size=1, max_size=6), st.sampled_from([3, 64]))
def test_hashed_embedding(spark, texts, dim):
    df = spark.createDataFrame(list(enumerate([*texts, None])), "id int, t string")
    rows = hashed_embedding(df, F.col("t"), dim).collect()
    for row in rows:
        expected = plain_embedding(row.t, dim)
        assert row.embedding == (None if expected is None else pytest.approx(expected))
        if expected:
            assert math.fsum(x * x for x in row.embedding) == pytest.approx(1)


def client_factory():
    class Client:
        calls = 0

        def embed(self, texts):
            self.calls += 1
            return [[float(len(t)), float(self.calls)] for t in texts]

    return Client


def test_model_embedding_makes_one_client_per_partition(spark):
    df = spark.range(0, 25, 1, 1).select(F.repeat(F.lit("x"), F.col("id").cast("int")).alias("t"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        rows = model_embedding(df, F.col("t"), client_factory()).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r.embedding[0] for r in rows] == [len(r.t) for r in rows]
    assert sorted({r.embedding[1] for r in rows}) == [1.0, 2.0, 3.0]


def test_embed_columns(spark):
    df = spark.createDataFrame([("a b", None)], "title string, description string")
    row = embed_columns(df, ["title", "description"], 16).first()
    assert row.embedding == pytest.approx(plain_embedding("a b", 16))
    with_word = embed_columns(df, ["title", "description"], 16, null_text="nan").first()
    assert with_word.embedding == pytest.approx(plain_embedding("a b nan", 16))
    assert set(row.asDict()) == {"title", "description", "embedding"}


def test_cosine(spark):
    df = spark.createDataFrame(
        [([1.0, 2.0], [2.0, 4.0]), ([1.0, 0.0], [0.0, 3.0]), ([1.0, 0.0], [-2.0, 0.0]),
         ([0.0, 0.0], [1.0, 0.0])],
        "a array<double>, b array<double>",
    )
    a, b = F.col("a"), F.col("b")
    rows = df.select(
        cosine_score(a, b).alias("n"), cosine_score(a, b, "raw").alias("r"),
        cosine_score(b, a).alias("s"),
    ).collect()
    assert [r.n for r in rows] == [1.0, 0.5, 0.0, None]
    assert [r.r for r in rows] == [1.0, 0.0, -1.0, None]
    assert [r.s for r in rows] == [r.n for r in rows]


def test_model_requests_are_small_and_tried_again(spark):
    def factory():
        class Client:
            calls = 0

            def embed(self, texts):
                Client.calls += 1
                if Client.calls % 2:
                    raise ConnectionError("busy")
                assert len(texts) <= 3
                return [[float(len(t))] for t in texts]

        return Client()

    df = spark.createDataFrame([(i, "x" * i) for i in range(10)], "i int, t string").coalesce(1)
    found = model_embedding(df, F.col("t"), factory, rows=3, attempts=2, pause=0.0)
    assert all(r.embedding == [float(r.i)] for r in found.collect())
    with pytest.raises(Exception, match="busy"):
        model_embedding(df, F.col("t"), factory, rows=3, attempts=1, pause=0.0).collect()


def test_answers_must_match_their_texts():
    with pytest.raises(ValueError, match="1 answers to 2 texts"):
        ask(lambda texts: [0], ["a", "b"], 5, 1, 0.0)
