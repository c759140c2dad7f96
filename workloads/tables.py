"""The test tables in the roles of a support graph.

orders are tickets, lineitem rows are comments, customers and suppliers are users, parts are
articles, embeddings are ticket vectors, documents are ticket descriptions, conversations are
conversations. Every table is used whole.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from supportgraph.functions.embedding import hashed_embedding
from supportgraph.functions.parsing import as_utc, parse_int
from supportgraph.operators.edges import attach_vectors
from supportgraph.options import RetrievalOptions
from supportgraph.schemas import SupportGraph
from supportgraph.workspace import materialize, spread_small

DIM = 64
# Stand-in vectors are close to random, so scores lie around 0.5.
OPTIONS = RetrievalOptions(top_k=5, context_limit=2, min_score=0.6, dim=DIM)
# Stand-in texts share most of their short words, so scores lie close to 1.
TEXT_OPTIONS = OPTIONS.updated(min_score=0.8)
RELATED_FROM = 0.3


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; its schema is read from the file once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key and text of every document, dealt out to all cores for the costly text work."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spread_small(rows, "doc_id")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customer = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("userId"),
        F.col("c_name").alias("username"),
        F.col("c_mktsegment").alias("role"),
        (F.col("c_acctbal") >= 0).alias("isActive"),
    )
    supplier = (
        table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("userId"),
            F.col("s_name").alias("username"),
            F.col("n_name").alias("role"),
            (F.col("s_acctbal") >= 0).alias("isActive"),
        )
    )
    return customer.unionByName(supplier)


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.col("o_orderstatus")
    found = table(spark, sf_dir, "orders").select(code.alias("statusId")).distinct()
    return found.select(
        "statusId", F.col("statusId").alias("name"), (F.col("statusId") == "F").alias("isClosed")
    )


def priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priorityId"))
    return found.distinct().select(
        "priorityId",
        F.split_part("priorityId", F.lit("-"), F.lit(2)).alias("name"),
        parse_int(F.split_part("priorityId", F.lit("-"), F.lit(1))).alias("level"),
    )


def category(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "part").select(F.col("p_brand").alias("categoryId")).distinct()
    return found.select(
        "categoryId",
        F.col("categoryId").alias("name"),
        F.concat(F.lit("Parts of "), F.col("categoryId")).alias("description"),
    )


def tickets(
    spark: SparkSession, sf_dir: str, texts: bool = False, vectors: bool = False
) -> DataFrame:
    """Orders, if asked with document texts as descriptions and with a vector where there is one."""
    orders = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    rows = orders.select(
        key.alias("ticketId"),
        F.concat_ws(" ", F.lit("Order"), key.cast("string"), F.col("o_orderpriority")).alias(
            "title"
        ),
        as_utc(F.col("o_orderdate")).alias("creationDate"),
        F.when(F.col("o_orderstatus") == "F", as_utc(F.col("o_orderdate"))).alias(
            "resolvedDate"
        ),
        F.when(
            F.col("o_orderpriority") != "5-LOW",
            F.concat_ws(" ", F.lit("Filled for customer"), cust.cast("string")),
        ).alias("resolutionSummary"),
        F.concat(F.lit("c"), cust.cast("string")).alias("createdByUserId"),
        F.when(
            F.col("o_orderstatus") != "O",
            F.concat(F.lit("s"), (cust % 100).cast("string")),
        ).alias("assignedToUserId"),
        F.col("o_orderstatus").alias("statusId"),
        F.col("o_orderpriority").alias("priorityId"),
        F.concat(F.lit("Brand#"), (key % 28).cast("string")).alias("categoryId"),
    )
    if texts:
        found = table(spark, sf_dir, "documents").select(
            F.col("doc_id").alias("ticketId"), F.col("text").alias("description")
        )
        rows = rows.join(found, "ticketId", "left")
    if vectors:
        found = vector_questions(spark, sf_dir).withColumnRenamed("query_id", "ticketId")
        rows = rows.join(found, "ticketId", "left")
    return rows


def comments(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Line items. ``spread`` is for queries that work on all of them."""
    parts = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    line = table(spark, sf_dir, "lineitem")
    if spread:
        line = spread_small(line, "l_orderkey")
    return line.select(
        # The keys alone repeat once in the smallest test set.
        F.concat_ws(
            "-",
            *(F.col(c).cast("string") for c in parts),
            F.date_format("l_shipdate", "yyyyMMdd"),
        ).alias("commentId"),
        F.concat_ws(
            " ",
            F.lit("part"),
            F.col("l_partkey").cast("string"),
            F.lit("quantity"),
            F.col("l_quantity").cast("int").cast("string"),
        ).alias("content"),
        as_utc(F.col("l_shipdate")).alias("creationDate"),
        (F.col("l_returnflag") == "R").alias("isSolution"),
        F.col("l_orderkey").alias("ticketId"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("authorUserId"),
        F.when(
            F.col("l_linestatus") == "O", F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
        ).alias("articleId"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("articleId"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("summary"),
        F.concat(F.lit("/parts/"), F.col("p_partkey").cast("string")).alias("referenceUrl"),
        F.col("p_brand").alias("categoryId"),
    )


def graph(spark: SparkSession, sf_dir: str) -> SupportGraph:
    """All node tables. Derived dimensions are written first, so that Spark knows their size."""
    return SupportGraph(
        user=users(spark, sf_dir),
        status=materialize(status(spark, sf_dir), "status"),
        priority=materialize(priority(spark, sf_dir), "priority"),
        category=materialize(category(spark, sf_dir), "category"),
        ticket=tickets(spark, sf_dir),
        comment=comments(spark, sf_dir),
        article=articles(spark, sf_dir),
    )


def _retrieval_graph(spark: SparkSession, sf_dir: str, vectors: bool) -> SupportGraph:
    return SupportGraph(
        user=users(spark, sf_dir),
        status=materialize(status(spark, sf_dir), "status"),
        ticket=tickets(spark, sf_dir, texts=True, vectors=vectors),
        comment=comments(spark, sf_dir),
    )


def search_graph(spark: SparkSession, sf_dir: str) -> SupportGraph:
    """The tables that retrieval reads, with the stored vectors."""
    return _retrieval_graph(spark, sf_dir, vectors=True)


def text_graph(spark: SparkSession, sf_dir: str) -> SupportGraph:
    """Like ``search_graph``, with the default vectors of the document texts on the tickets."""
    texts = documents(spark, sf_dir).withColumnRenamed("doc_id", "ticketId")
    vectors = hashed_embedding(texts, F.col("text"), DIM).select("ticketId", "embedding")
    # Stored once: neither a search nor a batch of a stream computes them again.
    vectors = materialize(vectors, "ticket-vectors")
    found = _retrieval_graph(spark, sf_dir, vectors=False)
    return replace(found, ticket=attach_vectors(found.ticket, vectors))


def vector_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>")
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", F.col("text").alias("content")
    )


def as_questions(turns: DataFrame) -> DataFrame:
    """Every user turn is a question."""
    return turns.where("role = 'user'").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias(
            "query_id"
        ),
        F.col("text").alias("question"),
    )


def text_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_questions(table(spark, sf_dir, "conversations"))


def prompt_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last user turn of each conversation, asked again."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    return turns.groupBy("conv_id").agg(
        F.max("turn").alias("question_id"), F.max_by("text", "turn").alias("question")
    )
