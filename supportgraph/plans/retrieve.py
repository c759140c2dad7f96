"""From questions to past solutions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportgraph.functions.embedding import ClientFactory, embed_columns
from supportgraph.functions.rules import CATEGORIES, needs_search
from supportgraph.functions.text import (
    UNKNOWN_AUTHOR,
    iso_datetime,
    or_default,
    percent_text,
    result_metadata,
    result_text,
)
from supportgraph.operators.context import LARGE_TICKET, solution_cards, with_author_role
from supportgraph.operators.ivf import ListIndex, ivf_topk
from supportgraph.operators.ranking import rank_in_group
from supportgraph.operators.search import TicketIndex, approx_topk, exact_topk
from supportgraph.operators.triage import triage
from supportgraph.options import HANDLER, RETRIEVER, RetrievalOptions
from supportgraph.schemas import SupportGraph
from supportgraph.workspace import materialize


def closed_tickets(graph: SupportGraph) -> DataFrame:
    closed = graph.status.where("isClosed").select("statusId")
    return graph.ticket.join(closed, "statusId", "left_semi")


def find_tickets(
    questions: DataFrame,
    graph: SupportGraph,
    options: RetrievalOptions,
    index: TicketIndex | ListIndex | None = None,
) -> DataFrame:
    """Hits ``query_id, ticketId, score, rank`` above the threshold, written to the shared folder:
    of all tickets, or of those that ``index`` finds near the question."""
    tickets = graph.ticket
    if options.filter_mode == "pre":
        tickets = closed_tickets(graph)
    if index is None:
        return exact_topk(
            questions, tickets, options.top_k, options.dim, options.min_score, options.score_mode
        )
    if isinstance(index, ListIndex):
        some = tickets if options.filter_mode == "pre" else None
        return ivf_topk(
            questions, index, options.top_k, options.min_score, options.score_mode, tickets=some
        )
    return approx_topk(
        questions, index, tickets, options.top_k, options.min_score, options.score_mode
    )


def _author(role: F.Column) -> F.Column:
    return F.struct(role.alias("role"))


def _context_comment(c: F.Column) -> F.Column:
    return F.struct(
        c["commentId"].alias("commentId"),
        c["content"].alias("content"),
        iso_datetime(c["creationDate"]).alias("creationDate"),
        F.when(c["known"], _author(c["role"])).alias("author"),
    )


def answer_hits(hits: DataFrame, graph: SupportGraph, options: RetrievalOptions) -> DataFrame:
    """Nested results for ``hits (query_id, ticketId, score)``.

    Open tickets, tickets without a solution and solutions without a known author drop out; a
    ticket with several solutions gives several rows. The large tables are joined with the few
    hits first, and the comments of those tickets are written once for the reads that follow.
    """
    columns = ["ticketId", "title", "description", "resolutionSummary"]
    if options.same_category:
        columns.append("categoryId")
    wanted = hits.select("ticketId")
    tickets = closed_tickets(graph).join(wanted, "ticketId", "left_semi").select(*columns)
    found = hits.join(tickets, "ticketId")
    if options.same_category:
        found = found.where(F.col("category").isNull() | (F.col("category") == F.col("categoryId")))
    found = materialize(found, "closed-hits")
    comments = graph.comment.join(found.select("ticketId"), "ticketId", "left_semi").select(
        "ticketId", "commentId", "content", "creationDate", "isSolution", "authorUserId"
    )
    comments = materialize(with_author_role(comments, graph.user), "hit-comments")
    # The stored copy counts itself; with few comments in all, no ticket can be large.
    large = None if comments.count() <= LARGE_TICKET else LARGE_TICKET
    cards = solution_cards(comments, options.context_limit, options.context_order, large)
    carried = [c for c in hits.columns if c not in ("ticketId", "score", "rank")]
    return found.join(cards, "ticketId").select(
        *carried,
        "ticketId",
        "title",
        "description",
        "resolutionSummary",
        F.struct(
            F.col("solutionId").alias("commentId"),
            F.col("solutionContent").alias("content"),
            iso_datetime(F.col("solutionDate")).alias("creationDate"),
            _author(F.col("solutionRole")).alias("author"),
        ).alias("solutionComment"),
        F.transform("context", _context_comment).alias("contextComments"),
        F.col("score").alias("similarityScore"),
    )


def retrieve(
    questions: DataFrame,
    graph: SupportGraph,
    options: RetrievalOptions = RETRIEVER,
    index: TicketIndex | ListIndex | None = None,
) -> DataFrame:
    """Past solutions for ``questions (query_id, embedding)``, by exact search or through a stored
    index; see ``answer_hits``."""
    return answer_hits(find_tickets(questions, graph, options, index), graph, options)


def ordered(results: DataFrame) -> DataFrame:
    """Results by question, best score first."""
    return results.orderBy(
        "query_id", F.desc("similarityScore"), "ticketId", "solutionComment.commentId"
    )


def with_text(results: DataFrame) -> DataFrame:
    """Add the text form of each result and its metadata."""
    return results.withColumns({"text": result_text(), "metadata": result_metadata()})


def with_json(results: DataFrame) -> DataFrame:
    """Add ``result_json``, one JSON object per result. A list per question would have to gather
    all solutions of a ticket in one task."""
    fields = [c for c in results.columns if c not in ("query_id", "text", "metadata")]
    return results.withColumn(
        "result_json", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    )


def hit_counts(questions: DataFrame, results: DataFrame) -> DataFrame:
    """Results per question, zero for questions that found nothing."""
    counts = results.groupBy("query_id").agg(F.count("*").alias("n"))
    return questions.select("query_id").join(counts, "query_id", "left").withColumn(
        "n_results", F.coalesce("n", F.lit(0))
    ).drop("n")


def retrieve_by_text(
    questions: DataFrame,
    graph: SupportGraph,
    options: RetrievalOptions = RETRIEVER,
    client_factory: ClientFactory | None = None,
    text_columns: tuple[str, ...] = ("question",),
    index: TicketIndex | ListIndex | None = None,
) -> DataFrame:
    """Past solutions for ``questions (query_id, question)`` with text, metadata and score."""
    vectors = embed_columns(questions, list(text_columns), options.dim, client_factory)
    vectors = materialize(vectors.select("query_id", "embedding"), "question-vectors")
    return with_text(retrieve(vectors, graph, options, index))


def gated_search(
    questions: DataFrame,
    graph: SupportGraph,
    options: RetrievalOptions = HANDLER,
    related_from: float = 0.1,
    client_factory: ClientFactory | None = None,
    analysis: DataFrame | None = None,
    topics: list[tuple[str, str]] = CATEGORIES,
    index: TicketIndex | ListIndex | None = None,
) -> DataFrame:
    """Triage, then retrieval for related questions only.

    The searched text is the title and description of the analysis. ``analysis`` replaces the
    default triage, with the columns of ``questions`` and of an analysis record.
    """
    analyzed = analysis
    if analyzed is None:
        analyzed = triage(questions, options.dim, related_from, topics)
    related = analyzed.where("is_related")
    if options.same_category:
        related = materialize(related, "related")
    vectors = embed_columns(related, ["title", "description"], options.dim, client_factory)
    vectors = materialize(vectors.select("query_id", "embedding"), "question-vectors")
    hits = find_tickets(vectors, graph, options, index)
    if options.same_category:
        hits = hits.join(related.select("query_id", "category"), "query_id")
    return answer_hits(hits, graph, options).drop("category")


def search_gate(questions: DataFrame) -> DataFrame:
    """Questions that call for a search; the rest are small talk or blank."""
    return questions.where(needs_search(F.col("question")))


def source_listing(results: DataFrame) -> DataFrame:
    """Flat rows for display: each result with its place among the sources of its question, once
    per context comment, or once with nulls when there is none."""
    flat = results.select(
        "query_id",
        "ticketId",
        "title",
        "description",
        "resolutionSummary",
        "similarityScore",
        F.col("solutionComment.commentId").alias("solutionId"),
        F.col("solutionComment.content").alias("solutionContent"),
        F.col("solutionComment.creationDate").alias("solutionDate"),
        F.coalesce("solutionComment.author.role", F.lit("")).alias("solutionRole"),
        "contextComments",
    )
    ranked = rank_in_group(
        flat, "query_id", [F.desc("similarityScore"), F.col("ticketId"), F.col("solutionId")]
    )
    return ranked.withColumn("similarity", percent_text(F.col("similarityScore"))).select(
        *[c for c in ranked.columns if c != "contextComments"],
        "similarity",
        F.posexplode_outer("contextComments"),
    ).select(
        *[c for c in ranked.columns if c != "contextComments"],
        "similarity",
        (F.col("pos") + 1).alias("contextPosition"),
        F.col("col.commentId").alias("contextId"),
        F.col("col.content").alias("contextContent"),
        F.col("col.creationDate").alias("contextDate"),
        F.when(
            F.col("col").isNotNull(), or_default(F.col("col.author.role"), UNKNOWN_AUTHOR)
        ).alias("contextRole"),
    )
