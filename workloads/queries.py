"""One function per registered query: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supportgraph.functions.embedding import bucket, hashed_embedding, tokens
from supportgraph.functions.parsing import as_utc, parse_bool, parse_datetime, parse_int
from supportgraph.functions.similarity import cosine_score
from supportgraph.functions.text import (
    iso_datetime,
    join_text,
    label_of,
    percent_text,
    score_text,
    stamp,
)
from supportgraph.operators import messages as talk
from supportgraph.operators import quality, upkeep
from supportgraph.operators.context import context_rows, solution_cards, with_author_role
from supportgraph.operators.edges import (
    attach_vectors,
    build_edges,
    edge_counts,
    expand,
    walk,
    without_foreign_keys,
)
from supportgraph.operators.ivf import ListIndex, build_lists, ivf_topk, looked_at, read_lists, train, write_lists
from supportgraph.operators.quality import (
    dangling_references,
    duplicate_keys,
    split_duplicates,
    validate_analysis,
    vector_errors,
)
from supportgraph.operators.search import (
    Planes,
    TicketIndex,
    approx_topk,
    build_index,
    exact_topk,
    recall,
    write_index,
)
from supportgraph.operators.triage import topics_of, triage
from supportgraph.plans import build, retrieve
from supportgraph.plans.embeddings import embed_by_content, unseen_texts
from supportgraph.schemas import KEYS
from supportgraph.sources import conversations as logs
from supportgraph.sources import tables as stored
from supportgraph.streaming.questions import answer_stream
from supportgraph.streaming.conversations import STATE_STORE, prompt_stream
from supportgraph.workspace import fresh_path, materialize
from workloads import tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _flat(results: DataFrame) -> DataFrame:
    """Nested results as plain columns."""
    context = F.col("contextComments")
    return results.select(
        "query_id",
        "ticketId",
        "title",
        "description",
        "resolutionSummary",
        "similarityScore",
        F.col("solutionComment.commentId").alias("solutionId"),
        F.col("solutionComment.content").alias("solutionContent"),
        F.col("solutionComment.creationDate").alias("solutionDate"),
        F.col("solutionComment.author.role").alias("solutionRole"),
        F.array_join(F.transform(context, lambda c: c["commentId"]), ",").alias("contextIds"),
        F.array_join(F.transform(context, lambda c: c["content"]), ",").alias("contextTexts"),
        F.array_join(F.transform(context, lambda c: c["creationDate"]), ",").alias("contextDates"),
        F.array_join(F.transform(context, lambda c: c["author"]["role"]), ",").alias(
            "contextRoles"
        ),
        F.size(context).cast("bigint").alias("contextCount"),
    )


# --- search and retrieval -----------------------------------------------------------------------


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.retrieve(
        t.vector_questions(spark, sf_dir), t.search_graph(spark, sf_dir), t.OPTIONS
    )


@query
def retrieve_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_results(spark, sf_dir))


@query
def retrieve_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(
        retrieve.retrieve(
            t.vector_questions(spark, sf_dir),
            t.search_graph(spark, sf_dir),
            t.OPTIONS.updated(filter_mode="pre"),
        )
    )


@query
def results_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = retrieve.ordered(_results(spark, sf_dir))
    return results.select(
        "query_id",
        "similarityScore",
        "ticketId",
        F.col("solutionComment.commentId").alias("solutionId"),
    )


def _ticket_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.vector_questions(spark, sf_dir).withColumnRenamed("query_id", "ticketId")


def _topk(spark: SparkSession, sf_dir: str, **settings) -> DataFrame:
    hits = exact_topk(
        t.vector_questions(spark, sf_dir), _ticket_vectors(spark, sf_dir), 5, t.DIM, **settings
    )
    return hits.select("query_id", "ticketId", "score", "rank")


@query
def topk_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topk(spark, sf_dir)


@query
def topk_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search with queries cut into many groups, as where they don't fit one task."""
    return _topk(spark, sf_dir, group_bytes=256 * 8 * t.DIM)


@query
def topk_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the words for their language and source: few different vectors, many ties."""
    kinds = t.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("query_id"), F.concat_ws(" ", "lang", "source").alias("kind")
    )
    vectors = hashed_embedding(kinds, F.col("kind"), t.DIM).select("query_id", "embedding")
    vectors = materialize(vectors, "kinds")
    hits = exact_topk(vectors, vectors.withColumnRenamed("query_id", "ticketId"), 5, t.DIM)
    return hits.select("query_id", "ticketId", "score", "rank")


@query
def topk_raw_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topk(spark, sf_dir, score_mode="raw", min_score=0.25)


@query
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_rows(t.comments(spark, sf_dir, spread=True), 3).select(
        "ticketId", "solutionId", F.col("position").cast("bigint").alias("position"), "commentId"
    )


@query
def context_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    comments = with_author_role(
        t.comments(spark, sf_dir, spread=True), t.users(spark, sf_dir)
    )
    cards = solution_cards(comments, 3)
    context = F.col("context")
    return cards.select(
        "ticketId",
        "solutionId",
        "solutionRole",
        F.array_join(F.transform(context, lambda c: c["commentId"]), ",").alias("contextIds"),
        F.array_join(F.transform(context, lambda c: c["role"]), ",").alias("contextRoles"),
        F.size(context).cast("bigint").alias("contextCount"),
    )


@query
def result_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from supportgraph.functions import text

    results = _results(spark, sf_dir)
    return results.withColumn("text", text.result_text()).withColumn(
        "m", text.result_metadata()
    ).select(
        "query_id",
        "text",
        "m.ticket_id",
        "m.similarity_score",
        "m.solution_comment_id",
        F.col("m.context_comment_count").cast("bigint").alias("context_comment_count"),
    )


@query
def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON object of each result, read back field by field: number forms differ in SQL."""
    results = retrieve.with_json(_results(spark, sf_dir))
    comment = "struct<commentId:string,content:string,creationDate:string,author:struct<role:string>>"
    fields = (
        "ticketId bigint, title string, description string, resolutionSummary string, "
        f"solutionComment {comment}, contextComments array<{comment}>, similarityScore double"
    )
    parsed = results.select("query_id", F.from_json("result_json", fields).alias("r"))
    return _flat(parsed.select("query_id", "r.*"))


@query
def result_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = retrieve.source_listing(_results(spark, sf_dir))
    return listing.select(
        "query_id",
        F.col("rank").cast("bigint").alias("rank"),
        "ticketId",
        "title",
        "description",
        "resolutionSummary",
        "similarityScore",
        "solutionId",
        "solutionContent",
        "solutionDate",
        "solutionRole",
        F.col("contextPosition").cast("bigint").alias("contextPosition"),
        "contextId",
        "contextContent",
        "contextDate",
        "contextRole",
    )


@query
def hit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.hit_counts(t.vector_questions(spark, sf_dir), _results(spark, sf_dir))


@query
def retrieve_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = t.text_questions(spark, sf_dir)
    results = retrieve.retrieve_by_text(questions, t.text_graph(spark, sf_dir), t.TEXT_OPTIONS)
    return _with_text_columns(results)


def _with_text_columns(results: DataFrame) -> DataFrame:
    return results.select(
        "query_id",
        "text",
        F.col("metadata.ticket_id").alias("ticket_id"),
        F.col("metadata.similarity_score").alias("similarity_score"),
        F.col("metadata.solution_comment_id").alias("solution_comment_id"),
        F.col("metadata.context_comment_count").cast("bigint").alias("context_comment_count"),
    )


def _text_index(spark: SparkSession, graph) -> TicketIndex:
    return _stored_index(spark, graph.ticket.select("ticketId", "embedding"))


def _stored_index(spark: SparkSession, vectors: DataFrame) -> TicketIndex:
    planes, path = Planes(t.DIM), fresh_path(spark, "index")
    write_index(build_index(vectors, planes), path)
    return TicketIndex(spark.read.parquet(path), planes)


@query
def retrieve_by_text_with_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = t.text_graph(spark, sf_dir)
    results = retrieve.retrieve_by_text(
        t.text_questions(spark, sf_dir), graph, t.TEXT_OPTIONS, index=_text_index(spark, graph)
    )
    return _with_text_columns(results)


@query
def gated_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = t.text_questions(spark, sf_dir)
    results = retrieve.gated_search(
        questions, t.text_graph(spark, sf_dir), t.TEXT_OPTIONS, t.RELATED_FROM
    )
    return _flat(results)


def _approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _ticket_vectors(spark, sf_dir)
    index = _stored_index(spark, vectors)
    hits = approx_topk(t.vector_questions(spark, sf_dir), index, vectors, 5)
    return hits.select("query_id", "ticketId", "score", "rank")


@query
def approx_topk_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _approx(spark, sf_dir)


@query
def approx_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = exact_topk(t.vector_questions(spark, sf_dir), _ticket_vectors(spark, sf_dir), 5, t.DIM)
    return recall(_approx(spark, sf_dir), exact)


def _text_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ListIndex]:
    """The vectors of all documents by their texts, which form clusters, and their inverted lists."""
    vectors = materialize(t.text_graph(spark, sf_dir).ticket.select("ticketId", "embedding").where("embedding IS NOT NULL"), "vectors")
    quantizer, path = train(vectors, t.DIM), fresh_path(spark, "lists")
    write_lists(build_lists(vectors, quantizer), quantizer, path)
    return vectors, read_lists(spark, path)


@query
def ivf_topk_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar documents through inverted lists; trained, so without SQL."""
    vectors, index = _text_lists(spark, sf_dir)
    return ivf_topk(vectors.withColumnRenamed("ticketId", "query_id"), index, 5)


@query
def ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the share of the exact hits that are found, and of the documents looked at."""
    vectors, index = _text_lists(spark, sf_dir)
    queries = vectors.withColumnRenamed("ticketId", "query_id")
    rates = recall(ivf_topk(queries, index, 5), exact_topk(queries, vectors, 5, t.DIM))
    return rates.join(looked_at(queries, index), "query_id")


@query
def retrieve_with_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _stored_index(spark, _ticket_vectors(spark, sf_dir))
    questions, graph = t.vector_questions(spark, sf_dir), t.search_graph(spark, sf_dir)
    return _flat(retrieve.retrieve(questions, graph, t.OPTIONS, index))


def _streamed(spark: SparkSession, sf_dir: str, index: TicketIndex | None = None) -> DataFrame:
    schema = t.table(spark, sf_dir, "embeddings").schema
    arriving = spark.readStream.schema(schema).parquet(f"{sf_dir}/embeddings*.parquet")
    questions = arriving.select(
        F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>")
    )
    found = t.search_graph(spark, sf_dir)
    out = fresh_path(spark, "answers")
    job = answer_stream(
        questions,
        lambda batch: retrieve.retrieve(batch, found, t.OPTIONS, index),
        out,
        fresh_path(spark, "stream"),
    )
    job.awaitTermination()
    return _flat(spark.read.parquet(out))


@query
def stream_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir)


@query
def stream_with_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, _stored_index(spark, _ticket_vectors(spark, sf_dir)))


@query
def stream_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as they arrive, through triage and search."""
    schema = t.table(spark, sf_dir, "conversations").schema
    arriving = spark.readStream.schema(schema).parquet(f"{sf_dir}/conversations*.parquet")
    found = t.text_graph(spark, sf_dir)
    out = fresh_path(spark, "answers")
    job = answer_stream(
        t.as_questions(arriving),
        lambda batch: retrieve.gated_search(batch, found, t.TEXT_OPTIONS, t.RELATED_FROM),
        out,
        fresh_path(spark, "stream"),
    )
    job.awaitTermination()
    return _flat(spark.read.parquet(out))


@query
def stream_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt for every user turn as it arrives, with the turns before it kept as state."""
    schema = t.table(spark, sf_dir, "conversations").schema
    arriving = spark.readStream.schema(schema).parquet(f"{sf_dir}/conversations*.parquet")
    turns = arriving.select("conv_id", "turn", "role", F.col("text").alias("content"))
    out, key = fresh_path(spark, "prompts"), STATE_STORE[0]
    before = spark.conf.get(key, None)
    spark.conf.set(*STATE_STORE)
    try:
        prompts = prompt_stream(turns, 3, NEW_PROMPT, " Search first.")
        writer = prompts.writeStream.option("checkpointLocation", fresh_path(spark, "stream"))
        writer.trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    finally:
        if before is not None:
            spark.conf.set(key, before)
    lines = F.transform("messages", lambda m: F.concat_ws(": ", m["role"], m["content"]))
    return spark.read.schema(prompts.schema).parquet(out).select(
        "conv_id", "turn", F.array_join(lines, "\n").alias("prompt"), F.size("messages").cast("bigint").alias("n_messages")
    )


# --- typing, checks, edges ----------------------------------------------------------------------


@query
def iso_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        iso_datetime(as_utc(F.col("o_orderdate"))).alias("iso"),
        stamp(as_utc(F.col("o_orderdate"))).alias("stamp"),
    )


@query
def iso_event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "events").select("event_id", iso_datetime(as_utc(F.col("ts"))).alias("iso"))


@query
def parsed_datetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times written as text and parsed back; every other text is not a time."""
    orders = t.table(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    )
    return orders.select("o_orderkey", stamp(parse_datetime(text)).alias("parsed"))


@query
def score_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = t.table(spark, sf_dir, "lineitem")
    return line.groupBy("l_discount").agg(F.count("*").alias("n")).select(
        score_text(F.col("l_discount")).alias("score"),
        percent_text(F.col("l_discount")).alias("percent"),
        "n",
    )


@query
def name_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "pages").select("page_id", label_of(F.col("url")).alias("label"))


@query
def rows_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments that name an article, and the side table of those that do not."""
    rows = t.comments(spark, sf_dir)
    kept = stored.with_key(rows, "articleId").withColumn("kept", F.lit(True))
    held = stored.without_key(rows, "articleId").withColumn("kept", F.lit(False))
    return kept.unionByName(held).select("commentId", "articleId", "kept")


@query
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against the next one."""
    a = t.vector_questions(spark, sf_dir)
    b = a.select((F.col("query_id") - 1).alias("query_id"), F.col("embedding").alias("other"))
    return a.join(b, "query_id").select(
        "query_id",
        cosine_score(F.col("embedding"), F.col("other")).alias("score"),
        cosine_score(F.col("other"), F.col("embedding"), "raw").alias("cosine"),
    )


@query
def typed_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = t.table(spark, sf_dir, "orders")
    return orders.select(
        "o_orderkey",
        parse_int(F.split_part("o_orderpriority", F.lit("-"), F.lit(1))).alias("level"),
        parse_int(F.col("o_totalprice").cast("string")).alias("whole_price"),
        parse_int(F.col("o_orderpriority")).alias("bad_level"),
    )


@query
def typed_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = t.table(spark, sf_dir, "lineitem")
    text = (
        F.when(F.col("l_returnflag") == "R", "Yes")
        .when(F.col("l_returnflag") == "A", "no")
        .when(F.col("l_linestatus") == "O", "TRUE")
    )
    return line.groupBy("l_returnflag", "l_linestatus", parse_bool(text).alias("flag")).agg(
        F.count("*").alias("n")
    )


@query
def joined_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = t.tickets(spark, sf_dir)
    title, summary = F.col("title"), F.col("resolutionSummary")
    return found.select(
        "ticketId",
        join_text(title, summary).alias("joined"),
        join_text(title, summary, null_text="nan").alias("joined_with_nan"),
    )


@query
def edges_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_edges(t.graph(spark, sf_dir))


@query
def edge_counts_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_counts(build_edges(t.graph(spark, sf_dir)))


@query
def expand_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers to their tickets, to comments, and, where there is one, to the article."""
    found = t.graph(spark, sf_dir)
    edges = build_edges(found)
    start = found.user.select("userId")
    step = expand(start, edges, "userId", "SUBMITS", "ticketId")
    step = expand(step, edges, "ticketId", "CONTAINS", "commentId")
    return expand(
        step, edges, "commentId", "REFERENCED_BY", "articleId", direction="in", optional=True
    ).select("userId", "ticketId", "commentId", "articleId")


@query
def walk_from_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be reached from every status in one to three steps, in either direction."""
    found = t.graph(spark, sf_dir)
    starts = found.status.select(F.lit("status").alias("label"), F.col("statusId").alias("node"))
    return walk(starts, build_edges(found), 3, direction="both").select("start", "label", "node", "depth")


@query
def refreshed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per node table after two full refreshes."""
    root = fresh_path(spark, "graph")
    found = t.graph(spark, sf_dir)
    stored.refresh_graph(found, root)
    stored.refresh_graph(found, root)
    counts = [
        df.agg(F.lit(label).alias("label"), F.count("*").alias("n"))
        for label, df in stored.read_graph(spark, root).tables().items()
    ]
    return reduce(DataFrame.unionByName, counts)


@query
def ticket_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticket nodes after their foreign keys have become edges."""
    rows = without_foreign_keys(t.tickets(spark, sf_dir), "ticket")
    return rows.select(
        "ticketId", "title", "resolutionSummary", stamp(F.col("resolvedDate")).alias("resolved")
    )


@query
def duplicate_line_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_keys(t.table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query
def quarantined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = t.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"
    )
    kept, held = split_duplicates(line, "l_orderkey", "l_linenumber")
    return kept.withColumn("quarantined", F.lit(False)).unionByName(
        held.withColumn("quarantined", F.lit(True))
    )


@query
def key_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys used twice, in tables keyed by columns that repeat."""
    found = t.graph(spark, sf_dir)
    line = t.table(spark, sf_dir, "lineitem")
    repeated = replace(
        found,
        comment=line.select(
            F.concat_ws("-", F.col("l_orderkey").cast("string"), "l_returnflag").alias("commentId")
        ),
        article=found.article.withColumn("articleId", F.col("categoryId")),
    )
    return build.key_violations(repeated)


def _odd_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored vectors, some made unfit: none, too short, with a hole, without length."""
    v, key = F.col("embedding"), F.col("ticketId")
    odd = (
        F.when(key % 7 == 1, F.lit(None).cast("array<double>"))
        .when(key % 7 == 2, F.slice(v, 1, t.DIM - 1))
        .when(key % 7 == 3, F.transform(v, lambda x, i: F.when(i == 5, F.lit(float("nan"))).otherwise(x)))
        .when(key % 7 == 4, F.transform(v, lambda x: x * 0.0))
        .otherwise(v)
    )
    return _ticket_vectors(spark, sf_dir).withColumn("embedding", odd)


@query
def vector_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.vector_rejects(_odd_vectors(spark, sf_dir), t.DIM).select("ticketId", "error")


@query
def load_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a load from CSV finds, by label and reason: rows without a key, keys used twice,
    references to no row, unfit vectors."""
    found = t.graph(spark, sf_dir)
    key = F.when(F.col("ticketId") % 5 != 0, F.concat_ws("-", F.col("ticketId").cast("string"), "authorUserId"))
    found = replace(found, comment=found.comment.withColumn("commentId", key))
    paths = {label: fresh_path(spark, f"{label}-csv") for label in found.tables()}
    for label, df in found.tables().items():
        times = {f.name: stamp(F.col(f.name)) for f in df.schema if f.dataType.typeName() == "timestamp"}
        df.withColumns(times).write.options(**stored.CSV_OPTIONS).csv(paths[label])
    loaded = stored.load_graph(spark, paths, multi_line=False)
    keyless = stored.load_rejects(spark, paths, multi_line=False)
    rejects = keyless.unionByName(build.quality_rejects(loaded, _odd_vectors(spark, sf_dir), t.DIM))
    return rejects.groupBy("label", "reason").agg(F.count("*").alias("n"))


@query
def reference_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.reference_report(t.graph(spark, sf_dir))


@query
def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = t.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("vec_id"))
    return dangling_references(orders, "vec_id", t.table(spark, sf_dir, "embeddings"), "vec_id")


@query
def attach_vectors_to_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = t.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ticketId"))
    joined = attach_vectors(orders, _ticket_vectors(spark, sf_dir))
    checked = vector_errors(joined, t.DIM)
    return checked.select(
        "ticketId",
        "error",
        F.array_join(F.transform("embedding", lambda x: F.round(x * 1e6).cast("bigint").cast("string")), ",").alias("millionths"),
    )


@query
def attached_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = t.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ticketId"))
    joined = attach_vectors(orders, _ticket_vectors(spark, sf_dir))
    return joined.where(F.col("embedding").isNotNull()).agg(F.count("*").alias("n"))


@query
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments written as CSV text and loaded as a node table."""
    path = fresh_path(spark, "comments-csv")
    comments = t.comments(spark, sf_dir).withColumn("creationDate", stamp(F.col("creationDate")))
    comments.write.options(**stored.CSV_OPTIONS).csv(path)
    loaded = stored.load_node_table(spark, "comment", path, multi_line=False)
    return loaded.select(
        KEYS["comment"],
        "content",
        stamp(F.col("creationDate")).alias("created"),
        "isSolution",
        F.col("ticketId").cast("bigint").alias("ticketId"),
        "authorUserId",
        "articleId",
    )


@query
def csv_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with line breaks and quotes written as CSV and read back whole."""
    return _csv_texts(spark, sf_dir, F.col("text"))


@query
def csv_edges_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with blanks and tabs at both ends."""
    return _csv_texts(spark, sf_dir, F.concat(F.lit(" \t "), F.col("text"), F.lit("\t  ")))


def _csv_texts(spark: SparkSession, sf_dir: str, text) -> DataFrame:
    path = fresh_path(spark, "documents-csv")
    documents = t.table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    documents.write.options(**stored.CSV_OPTIONS).csv(path)
    rows = stored.read_csv(spark, path)
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


@query
def vectors_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "vectors-csv")
    stored.write_csv_with_vectors(_ticket_vectors(spark, sf_dir), path)
    loaded = stored.read_csv_vectors(spark, path)
    return loaded.select(
        F.col("ticketId").cast("bigint").alias("ticketId"), F.posexplode("embedding")
    ).select(
        "ticketId", F.col("pos").cast("bigint").alias("pos"), F.round("col", 9).alias("value")
    )


def _kept_up(spark: SparkSession, sf_dir: str) -> tuple[upkeep.Upkeep, str]:
    """An index of an earlier state of all vectors, some not there yet, some other than now and some
    that are gone now, brought to the present state and compacted."""
    now = _ticket_vectors(spark, sf_dir)
    kind, key, vector = F.pmod("ticketId", F.lit(10)), F.col("ticketId"), F.col("embedding")
    before = now.where(kind != 0).select("ticketId", F.when(kind == 1, F.reverse(vector)).otherwise(vector).alias("embedding"))
    before = before.unionByName(now.where(kind == 2).select((-1 - key).alias("ticketId"), "embedding"))
    path = fresh_path(spark, "kept-index")
    upkeep.create(before, train(now, t.DIM), path)
    done = upkeep.update(now, path)
    upkeep.compact(spark, path)
    return done, path


@query
def index_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, _ = _kept_up(spark, sf_dir)
    return spark.createDataFrame(
        [("inserted", done.inserted), ("changed", done.changed), ("deleted", done.deleted)], "change string, n long"
    )


@query
def index_after_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unit vectors that the index holds in the end."""
    entries = upkeep.read(spark, _kept_up(spark, sf_dir)[1]).entries
    return entries.select("ticketId", F.posexplode("embedding")).select(
        "ticketId", F.col("pos").cast("bigint").alias("pos"), F.round("col", 6).alias("value")
    )


# --- embedding and triage -----------------------------------------------------------------------


@query
def embed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = t.documents(spark, sf_dir).select("doc_id", F.explode(tokens(F.col("text"))).alias("token"))
    return words.groupBy("doc_id", bucket(F.col("token"), t.DIM).cast("bigint").alias("bucket")).agg(
        F.count("*").alias("n")
    )


@query
def embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = hashed_embedding(t.documents(spark, sf_dir), F.col("text"), t.DIM)
    return (
        vectors.select("doc_id", F.posexplode("embedding").alias("bucket", "weight"))
        .where("weight > 0")
        .select(
            "doc_id",
            F.col("bucket").cast("bigint").alias("bucket"),
            F.round("weight", 9).alias("weight"),
        )
    )


@query
def embed_csv_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a CSV file, embedded into a second one, which is read back."""
    source, target = fresh_path(spark, "plain-csv"), fresh_path(spark, "embedded-csv")
    rows = t.documents(spark, sf_dir).select(F.col("doc_id").alias("ticketId"), "text")
    rows.write.options(**stored.CSV_OPTIONS).csv(source)
    build.embed_csv(spark, source, target, t.DIM, text_columns=("text",))
    loaded = stored.read_csv_vectors(spark, target).select(
        F.col("ticketId").cast("bigint").alias("doc_id"),
        F.posexplode("embedding").alias("bucket", "weight"),
    )
    return loaded.where("weight > 0").select(
        "doc_id",
        F.col("bucket").cast("bigint").alias("bucket"),
        F.round("weight", 9).alias("weight"),
    )


@query
def embedded_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents embedded through a store that an earlier run over the same documents filled."""
    store, rows = fresh_path(spark, "vector-store"), t.documents(spark, sf_dir)
    embed_by_content(rows, F.col("text"), store, t.DIM)
    vectors = embed_by_content(rows, F.col("text"), store, t.DIM)
    return (
        vectors.select("doc_id", F.posexplode("embedding").alias("bucket", "weight"))
        .where("weight > 0")
        .select("doc_id", F.col("bucket").cast("bigint").alias("bucket"), F.round("weight", 9).alias("weight"))
    )


@query
def texts_to_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts go to the model when the languages of the documents arrive one after the other,
    and when all documents arrive once more."""
    store, rows = fresh_path(spark, "vector-store"), t.table(spark, sf_dir, "documents")
    counts = []
    for lang in ["en", "de", "fr", "es", None]:
        arrived = rows if lang is None else rows.where(F.col("lang") == lang)
        unseen = unseen_texts(arrived, F.col("text"), store)
        counts.append(materialize(unseen.agg(F.lit(lang or "all").alias("arrived"), F.count("*").alias("n_texts")), "counts"))
        embed_by_content(arrived, F.col("text"), store, t.DIM)
    return reduce(DataFrame.unionByName, counts)


@query
def title_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document sentences as titles and whole texts as descriptions, some with bad categories."""
    documents = t.table(spark, sf_dir, "documents")
    code = (F.col("doc_id") % 12).cast("string")
    records = documents.select(
        "doc_id",
        F.lit(True).alias("is_related"),
        F.when(F.col("doc_id") % 12 != 11, F.concat(F.lit("cat_00"), code)).alias("category"),
        F.split_part("text", F.lit("."), F.lit(1)).alias("title"),
        F.when(F.col("lang") != "es", F.col("text")).otherwise(F.lit("  ")).alias("description"),
    )
    return validate_analysis(records)


@query
def triage_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    analyzed = triage(t.text_questions(spark, sf_dir), t.DIM, t.RELATED_FROM)
    return analyzed.select(
        "query_id",
        "is_related",
        "category",
        "title",
        "description",
        "category_score",
    )


@query
def triage_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the categories of the graph instead of the fixed ones."""
    topics = topics_of(t.category(spark, sf_dir))
    analyzed = triage(t.text_questions(spark, sf_dir), t.DIM, 0.05, topics)
    return analyzed.select(
        "query_id", "is_related", "category", "title", "description", "category_score"
    )


@query
def search_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.search_gate(t.text_questions(spark, sf_dir)).select("query_id")


# --- conversations ------------------------------------------------------------------------------

NEW_PROMPT = "Answer in one paragraph."


@query
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talk.history_window(t.messages(spark, sf_dir), 3)


@query
def prompt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = talk.prompt_table(
        t.messages(spark, sf_dir), t.prompt_questions(spark, sf_dir), 3, NEW_PROMPT, " Search first."
    )
    lines = F.transform("messages", lambda m: F.concat_ws(": ", m["role"], m["content"]))
    return prompts.select(
        "conv_id",
        "question_id",
        F.array_join(lines, "\n").alias("prompt"),
        F.size("messages").cast("bigint").alias("n_messages"),
    )


@query
def system_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talk.upsert_system_prompt(t.messages(spark, sf_dir), NEW_PROMPT)


@query
def last_system_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talk.recovered_system_prompt(t.messages(spark, sf_dir), NEW_PROMPT)


@query
def display_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talk.for_display(t.messages(spark, sf_dir))


@query
def append_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn asked and answered again: several answers per conversation."""
    asked = t.messages(spark, sf_dir).where("role = 'user'")
    answers = asked.select(
        "conv_id",
        "turn",
        F.col("content").alias("question"),
        F.concat(F.lit("Re: "), F.col("content")).alias("answer"),
    )
    return talk.append_turns(t.messages(spark, sf_dir), answers, NEW_PROMPT, "turn")


@query
def conversation_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log stored, extended by new turns and loaded again."""
    path = fresh_path(spark, "conversations")
    messages = t.messages(spark, sf_dir)
    answers = t.prompt_questions(spark, sf_dir).select(
        "conv_id", "question", F.lit("Done.").alias("answer")
    )
    logs.append_conversations(messages, path)
    logs.append_conversations(talk.new_turns(messages, answers), path)
    schema = "conv_id bigint, turn bigint, role string, content string"
    return logs.load_conversations(spark, path, schema)


@query
def conversation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations stored in files and loaded again; the turn is the place in the conversation."""
    path = fresh_path(spark, "conversation-files")
    logs.write_conversation_files(t.messages(spark, sf_dir), path)
    return logs.load_conversation_files(spark, path).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("place"), "role", "content"
    )


@query
def conversation_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON list per conversation, under names that look like numbers, dates and paths."""
    path, messages = fresh_path(spark, "conversation-lists"), t.messages(spark, sf_dir)
    number = F.col("conv_id").cast("string")
    names = F.array(
        F.lpad(number, 8, "0"), F.concat(number, F.lit(".50")), F.concat(F.lit("2024-01-01 "), number),
        F.concat(F.lit("a+b/"), number, F.lit("%20")),
    )
    named = messages.withColumn("conv_id", F.element_at(names, (F.col("conv_id") % 4 + 1).cast("int")))
    logs.export_conversation_lists(named, path)
    lists = logs.load_conversation_lists(spark, path)
    return lists.select("conv_id", F.col("turn").cast("bigint").alias("place"), "role", "content")


@query
def recent_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of all lists, counted by folder; their times and names differ from run to run."""
    path = fresh_path(spark, "conversation-lists")
    logs.export_conversation_lists(t.messages(spark, sf_dir), path)
    files = logs.list_conversation_files(spark, path, pattern="*", recursive=True)
    dated = F.col("last_update") == stamp(F.col("modified"))
    return files.groupBy(F.substring("label", 1, 5).alias("kind"), dated.alias("dated")).agg(
        F.countDistinct("folder").alias("n")
    )
