import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from supportgraph.functions.embedding import hashed_embedding, text_vector
from supportgraph.operators.triage import topics_of, triage, triage_with_model
from supportgraph.options import HANDLER, PAGE, RETRIEVER, RetrievalOptions
from supportgraph.plans import retrieve as plans
from supportgraph.plans.build import embed_tickets, with_vectors
from supportgraph.streaming.questions import answer_stream

OPTIONS = RetrievalOptions(top_k=5, context_limit=2, min_score=0.0, dim=3)


@pytest.fixture(scope="module")
def vector_graph(spark, graph):
    vectors = spark.createDataFrame(
        [("t1", [1.0, 0.0, 0.0]), ("t2", [0.9, 0.1, 0.0]), ("t3", [0.8, 0.2, 0.0]),
         ("t4", [1.0, 0.1, 0.0]), ("t5", [0.0, 1.0, 0.0]), ("t9", [1.0, 0.0, 0.0])],
        "ticketId string, embedding array<double>",
    )
    return with_vectors(graph, vectors, 3)


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame(
        [("q1", [1.0, 0.0, 0.0]), ("q2", [0.0, 1.0, 0.0]), ("q3", [0.0, 0.0, 0.0])],
        "query_id string, embedding array<double>",
    )


def keys(results):
    return [
        (r.query_id, r.ticketId, r.solutionComment.commentId)
        for r in plans.ordered(results).collect()
    ]


def test_results(questions, vector_graph):
    results = plans.retrieve(questions, vector_graph, OPTIONS)
    assert keys(results) == [
        ("q1", "t1", "m4"), ("q1", "t1", "m6"), ("q1", "t5", "m11"),
        ("q2", "t5", "m11"), ("q2", "t1", "m4"), ("q2", "t1", "m6"),
    ]
    first = plans.ordered(results).first()
    assert first.similarityScore == 1.0
    assert first.solutionComment.asDict(recursive=True) == {
        "commentId": "m4", "content": "First fix",
        "creationDate": "2024-01-01T11:00:00+00:00", "author": {"role": "agent"},
    }
    assert [c.asDict(recursive=True) for c in first.contextComments] == [
        {"commentId": "m2", "content": "line one\nline two",
         "creationDate": "2024-01-01T10:00:00+00:00", "author": {"role": "agent"}},
        {"commentId": "m3", "content": "Same time",
         "creationDate": "2024-01-01T10:00:00+00:00", "author": None},
    ]


def test_filter_modes(questions, vector_graph):
    two = OPTIONS.updated(top_k=2)
    # The two closest tickets of q1 are t1 and the open t4.
    assert keys(plans.retrieve(questions, vector_graph, two))[:2] == [
        ("q1", "t1", "m4"), ("q1", "t1", "m6"),
    ]
    hits = plans.find_tickets(questions, vector_graph, two).where("query_id = 'q1'")
    assert {r.ticketId for r in hits.collect()} == {"t1", "t4"}
    pre = plans.find_tickets(questions, vector_graph, two.updated(filter_mode="pre"))
    assert {r.ticketId for r in pre.where("query_id = 'q1'").collect()} == {"t1", "t2"}


def test_limits(questions, vector_graph):
    assert plans.retrieve(questions, vector_graph, OPTIONS.updated(top_k=0)).count() == 0
    none = plans.retrieve(questions, vector_graph, OPTIONS.updated(context_limit=0)).collect()
    assert len(none) == 6 and all(r.contextComments == [] for r in none)
    strict = plans.retrieve(questions, vector_graph, OPTIONS.updated(min_score=1.0))
    assert keys(strict) == [("q1", "t1", "m4"), ("q1", "t1", "m6"), ("q2", "t5", "m11")]


def test_text_metadata_and_json(questions, vector_graph):
    results = plans.with_text(plans.retrieve(questions, vector_graph, OPTIONS))
    rows = {(r.query_id, r.solutionComment.commentId): r for r in results.collect()}
    assert rows["q1", "m4"].text == (
        "TICKET: Printer jams\nTicket ID: t1\nDescription: Paper stuck in tray\n"
        "Resolution: Cleaned rollers\n\nCONTEXT COMMENTS:\n- agent: line one\nline two\n"
        "- Unknown: Same time\n\nSOLUTION by agent:\nFirst fix\n\nSimilarity Score: 1.000"
    )
    assert rows["q2", "m11"].text == (
        "TICKET: No title\nTicket ID: t5\nDescription: No description\nResolution: Replaced\n\n"
        "SOLUTION by agent:\nUndated fix\n\nSimilarity Score: 1.000"
    )
    assert tuple(rows["q1", "m4"].metadata) == ("t1", 1.0, "m4", 2)
    assert "SOLUTION by Unknown:" in rows["q1", "m6"].text
    as_json = plans.with_json(results).where("solutionComment.commentId = 'm11'").first()
    assert as_json.result_json == (
        '{"ticketId":"t5","title":null,"description":null,"resolutionSummary":"Replaced",'
        '"solutionComment":{"commentId":"m11","content":"Undated fix","creationDate":null,'
        '"author":{"role":"agent"}},"contextComments":[],"similarityScore":%s}'
        % as_json.similarityScore
    )


def test_sources_and_counts(questions, vector_graph):
    results = plans.retrieve(questions, vector_graph, OPTIONS)
    rows = plans.source_listing(results).where("query_id = 'q1'").collect()
    got = sorted((r["rank"], r.solutionId, r.contextPosition, r.contextId, r.contextRole) for r in rows if r.contextId)
    assert got == [
        (1, "m4", 1, "m2", "agent"), (1, "m4", 2, "m3", "Unknown"),
        (2, "m6", 1, "m4", "agent"), (2, "m6", 2, "m2", "agent"),
    ]
    bare = [r for r in rows if r.contextId is None]
    assert [(r["rank"], r.solutionId, r.contextRole) for r in bare] == [(3, "m11", None)]
    assert {r.similarity for r in rows if r["rank"] < 3} == {"100.0%"}
    counts = plans.hit_counts(questions, results).collect()
    assert {r.query_id: r.n_results for r in counts} == {"q1": 3, "q2": 3, "q3": 0}


def test_options():
    assert (RETRIEVER.top_k, RETRIEVER.context_limit, RETRIEVER.min_score) == (5, 2, 0.9)
    assert (HANDLER.min_score, HANDLER.history_length) == (0.85, 10)
    assert (PAGE.top_k, PAGE.context_limit, PAGE.min_score, PAGE.history_length) == (2, 0, 0.8, 2)
    assert HANDLER.updated(top_k=None, min_score=0.0).min_score == 0.0
    assert HANDLER.updated(top_k=None).top_k == 5 and HANDLER.updated(top_k=0).top_k == 0
    assert [RetrievalOptions.context_limit_from(n) for n in (0, 1, 3)] == [0, 0, 2]
    for bad in ({"filter_mode": "x"}, {"score_mode": "x"}, {"top_k": -1}, {"dim": 0}):
        with pytest.raises(ValueError):
            RetrievalOptions(**bad)
    with pytest.raises(TypeError):
        HANDLER.updated(colour="red")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(
        [("q1", "Paper stuck in tray of the printer: performance and reliability issues?"),
         ("q2", "zzz"), ("q3", "   "), ("q4", "login permissions " + "very " * 30)],
        "query_id string, question string",
    )


def test_triage(asked):
    rows = {r.query_id: r for r in triage(asked, 4096, 0.2).collect()}
    assert (rows["q1"].is_related, rows["q1"].category) == (True, "cat_006")
    assert rows["q1"].title == "Paper stuck in tray of the printer: performance and reliability"
    assert (rows["q2"].is_related, rows["q2"].category) == (False, None)
    assert (rows["q3"].is_related, rows["q3"].title) == (False, "Error")
    assert rows["q3"].description == "Description cannot be empty"
    assert len(rows["q4"].title.split()) == 10


def test_triage_over_a_table(spark, asked, graph):
    topics = topics_of(graph.category)
    assert topics == [("c1", "Printing Paper and ink"), ("c2", "Access Badges")]
    rows = {r.query_id: r for r in triage(asked, 4096, 0.2, topics).collect()}
    assert (rows["q1"].is_related, rows["q1"].category) == (True, "c1")
    assert (rows["q2"].is_related, rows["q2"].category) == (False, None)
    assert triage(asked, 64, 0.2, []).where("category IS NOT NULL").count() == 0
    with pytest.raises(ValueError, match="more than 1"):
        topics_of(graph.category, 1)


def test_text_vector_is_the_default_vector(spark):
    texts = ["Login, permissions, and ÄCCESS 42 login", "", "!"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in hashed_embedding(df, F.col("t"), 16).collect():
        assert text_vector(row.t, 16) == pytest.approx(list(row.embedding or [0.0] * 16))


def test_triage_with_model(spark, asked):
    def factory():
        class Client:
            def analyze(self, questions):
                return [
                    {"is_related": q != "zzz", "category": "cat_001" if "login" in q else "bad",
                     "title": "T", "description": q}
                    for q in questions
                ]

        return Client()

    rows = {r.query_id: r for r in triage_with_model(asked, factory).collect()}
    assert (rows["q4"].is_related, rows["q4"].category, rows["q4"].title) == (True, "cat_001", "T")
    assert (rows["q1"].is_related, rows["q1"].title) == (False, "Error")


def test_text_search(asked, graph):
    options = RetrievalOptions(top_k=1, context_limit=1, min_score=0.6, dim=256)
    full = embed_tickets(graph, 256)
    results = plans.retrieve_by_text(asked, full, options)
    assert keys(results) == [("q1", "t1", "m4"), ("q1", "t1", "m6")]
    assert results.first().text.startswith("TICKET: Printer jams")
    gated = plans.gated_search(asked, full, options, related_from=0.2)
    assert keys(gated) == keys(results)
    assert plans.gated_search(asked, full, options, related_from=0.99).count() == 0


def test_same_category(spark, graph):
    options = RetrievalOptions(top_k=3, min_score=0.0, dim=64, same_category=True)
    full = embed_tickets(graph, 64)
    coded = replace(
        full,
        ticket=full.ticket.withColumn(
            "categoryId", F.when(F.col("categoryId") == "c1", "cat_006").otherwise("cat_001")
        ),
    )
    analysis = spark.createDataFrame(
        [("a", "x", True, "cat_006", "Printer", "paper"), ("b", "x", True, "cat_001", "Printer", "paper"),
         ("c", "x", True, None, "Printer", "paper"), ("d", "x", False, None, "Printer", "paper")],
        "query_id string, question string, is_related boolean, category string, title string, "
        "description string",
    )
    results = plans.gated_search(None, coded, options, analysis=analysis)
    found = {r.query_id for r in results.where("ticketId = 't1'").collect()}
    assert found == {"a", "c"}
    assert "category" not in results.columns


def test_stream(spark, questions, vector_graph, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = questions.schema

    def run():
        arriving = spark.readStream.schema(schema).parquet(source)
        job = answer_stream(
            arriving, lambda batch: plans.retrieve(batch, vector_graph, OPTIONS), out, state
        )
        job.awaitTermination()
        return keys(spark.read.parquet(out))

    questions.where("query_id = 'q1'").write.mode("append").parquet(source)
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    assert len(run()) == 3
    assert set(os.listdir(shared)) == before  # nothing of a stored batch stays
    assert len(run()) == 3
    questions.where("query_id = 'q2'").write.mode("append").parquet(source)
    assert run() == keys(plans.retrieve(questions, vector_graph, OPTIONS))
