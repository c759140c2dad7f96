"""The offline build: typed node tables, checks, edges, vectors and index."""

from __future__ import annotations

import uuid
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supportgraph.functions.embedding import ClientFactory, embed_columns
from supportgraph.operators.edges import attach_vectors, dangling_of, edges_of, resolve_references
from supportgraph.operators.quality import (
    duplicate_keys,
    valid_vectors,
    vector_rejects,
)
from supportgraph.operators.search import Planes, TicketIndex, build_index, write_index
from supportgraph.plans.embeddings import embed_columns_by_content
from supportgraph.schemas import KEYS, SupportGraph
from supportgraph.sources.tables import (
    read_csv,
    read_graph,
    refresh_graph,
    refresh_table,
    write_csv_with_vectors,
)
from supportgraph.workspace import materialize


def key_violations(graph: SupportGraph) -> DataFrame:
    """Keys used twice in any node table: ``label, key, n``."""
    parts = [
        duplicate_keys(df, KEYS[label]).select(
            F.lit(label).alias("label"), F.col(KEYS[label]).cast("string").alias("key"), "n"
        )
        for label, df in graph.tables().items()
    ]
    return reduce(DataFrame.unionByName, parts)


def reference_report(graph: SupportGraph) -> DataFrame:
    """References to no row: ``label, key, column, value``. A row without a key cannot be named and is
    among those of ``load_rejects``."""
    return dangling_of(resolve_references(graph))


def embed_tickets(
    graph: SupportGraph,
    dim: int,
    client_factory: ClientFactory | None = None,
    null_text: str | None = None,
    store: str | None = None,
) -> SupportGraph:
    """The graph with a vector of title and description on every ticket. With ``store``, a folder of
    vectors by content, only texts that it does not hold are embedded."""
    plain, columns = graph.ticket.drop("embedding"), ["title", "description"]
    if store is None:
        return replace(graph, ticket=embed_columns(plain, columns, dim, client_factory, null_text))
    return replace(graph, ticket=embed_columns_by_content(plain, columns, store, dim, client_factory, null_text))


def embed_csv(
    spark: SparkSession,
    source: str,
    target: str,
    dim: int,
    client_factory: ClientFactory | None = None,
    text_columns: tuple[str, ...] = ("title", "description"),
    multi_line: bool = True,
    store: str | None = None,
) -> None:
    """Read a CSV of tickets and write it with a vector column, as a JSON list. With ``store``, a
    folder of vectors by content, only texts that it does not hold are embedded."""
    rows, columns = read_csv(spark, source, multi_line), list(text_columns)
    if store is None:
        vectors = embed_columns(rows, columns, dim, client_factory)
    else:
        vectors = embed_columns_by_content(rows, columns, store, dim, client_factory)
    write_csv_with_vectors(vectors, target)


def with_vectors(graph: SupportGraph, vectors: DataFrame, dim: int) -> SupportGraph:
    """The graph with stored vectors put on its tickets; vectors that cannot be searched are left
    out."""
    return replace(graph, ticket=attach_vectors(graph.ticket, valid_vectors(vectors, dim)))


def quality_rejects(
    graph: SupportGraph,
    vectors: DataFrame | None = None,
    dim: int = 0,
    resolved: DataFrame | None = None,
) -> DataFrame:
    """What is wrong with a graph, in one table: ``label, key, reason, detail``.

    Keys used twice with their number, references to no row with column and value, and, for
    ``vectors (ticketId, embedding)``, those that cannot be searched with the reason. ``resolved``:
    the graph's references where they have been looked up already.
    """
    repeated = key_violations(graph).select(
        "label", "key", F.lit("duplicate key").alias("reason"), F.col("n").cast("string").alias("detail")
    )
    missing = reference_report(graph) if resolved is None else dangling_of(resolved)
    dangling = missing.select(
        "label",
        "key",
        F.lit("dangling reference").alias("reason"),
        F.concat_ws("=", "column", "value").alias("detail"),
    )
    found = repeated.unionByName(dangling)
    if vectors is None:
        return found
    return found.unionByName(
        vector_rejects(vectors, dim).select(
            F.lit("ticket").alias("label"),
            F.col("ticketId").cast("string").alias("key"),
            F.lit("vector").alias("reason"),
            F.col("error").alias("detail"),
        )
    )


def current_version(spark: SparkSession, root: str) -> str:
    """The folder of the build that was finished last."""
    return f"{root}/{spark.read.text(f'{root}/current').first().value}"


def build(
    spark: SparkSession,
    graph: SupportGraph,
    root: str,
    dim: int,
    client_factory: ClientFactory | None = None,
    rejects: DataFrame | None = None,
    store: str | None = None,
    **index_settings: int,
) -> SupportGraph:
    """Write node tables, edges, vectors, rejects and the vector index, and read the tables back.

    Every build goes to a folder of its own under ``root``; only when all is written does
    ``root/current`` name it, so a failed build leaves the last one as it was, and ``graph`` may
    have been read from it. Earlier versions stay until they are deleted. Raises when a key is
    used twice. Edges are stored by type, so a walk reads one type only. ``rejects`` (see
    ``load_rejects``) are stored together with what ``quality_rejects`` finds. ``store``: see
    ``embed_tickets``; a build after a few changes then embeds the changed texts only.
    """
    repeated = key_violations(graph).limit(5).collect()
    if repeated:
        raise ValueError(f"duplicate keys: {[(r.label, r.key) for r in repeated]}")
    version, top = uuid.uuid4().hex, root
    root = f"{top}/{version}"
    refresh_graph(graph, f"{root}/nodes")
    stored = read_graph(spark, f"{root}/nodes")
    resolved = materialize(resolve_references(stored), "references")
    edges_of(resolved).write.mode("overwrite").partitionBy("edge_type").parquet(f"{root}/edges")
    refresh_table(embed_tickets(stored, dim, client_factory, store=store).ticket, f"{root}/tickets_embedded")
    full = replace(stored, ticket=spark.read.parquet(f"{root}/tickets_embedded"))
    planes = Planes(dim, **index_settings)
    write_index(build_index(full.ticket, planes), f"{root}/index")
    settings = spark.createDataFrame([(dim, planes.bands, planes.bits)], "dim int, bands int, bits int")
    refresh_table(settings.coalesce(1), f"{root}/index_settings")
    found = quality_rejects(stored, full.ticket.select("ticketId", "embedding"), dim, resolved)
    refresh_table(found if rejects is None else rejects.unionByName(found), f"{root}/rejects")
    spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(
        f"{top}/current"
    )
    return full


def load_index(spark: SparkSession, root: str) -> TicketIndex:
    """The stored index with the planes to look questions up with."""
    root = current_version(spark, root)
    planes = Planes(*spark.read.parquet(f"{root}/index_settings").first())
    return TicketIndex(spark.read.parquet(f"{root}/index"), planes)
