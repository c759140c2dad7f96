"""Vectors stored by the content of their texts: a text goes to the model once, whatever rows hold it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from supportgraph.functions.embedding import ClientFactory, hashed_embedding, model_embedding
from supportgraph.functions.text import join_text
from supportgraph.schemas import VECTOR
from supportgraph.workspace import exists, materialize


def _digest(text: Column) -> Column:
    """Of the text in UTF-8; null counts as the empty text, as it does for a model."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def stored_vectors(spark: SparkSession, store: str) -> DataFrame:
    """What a store holds, ``digest, embedding``; nothing before its first run."""
    schema = f"digest string, embedding {VECTOR.simpleString()}"
    return spark.read.schema(schema).parquet(store) if exists(spark, store) else spark.createDataFrame([], schema)


def unseen_texts(df: DataFrame, text: Column, store: str) -> DataFrame:
    """The different texts of ``df`` that the store has no vector of: ``digest, text``.

    Digests alone are shuffled to tell them; their texts follow, each once per map task at most.
    """
    texts = df.select(_digest(text).alias("digest"), F.coalesce(text, F.lit("")).alias("text"))
    held = stored_vectors(df.sparkSession, store).select("digest")
    missing = materialize(texts.select("digest").distinct().join(held, "digest", "left_anti"), "unseen")
    return texts.join(missing, "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))


def embed_by_content(
    df: DataFrame,
    text: Column,
    store: str,
    dim: int,
    client_factory: ClientFactory | None = None,
    out: str = "embedding",
    **requests,
) -> DataFrame:
    """Add the vector of ``text``, asking for texts that ``store`` does not know only.

    ``store`` is a folder for one model and one ``dim``. New vectors are written there first, so a
    run that fails later does not ask for them again, and a second run over the same texts asks for
    none. Two runs at once may both add a text: the reader takes one of its vectors, which are equal
    where the model repeats itself. Rows then meet the vectors they need by digest; a text that a
    third of the rows hold is a skewed key of that join, which adaptive execution splits.
    ``requests`` go to ``model_embedding``. A column named ``out`` is replaced, all others are kept.
    """
    spark = df.sparkSession
    fresh = unseen_texts(df, text, store)
    if client_factory is None:
        fresh = hashed_embedding(fresh, F.col("text"), dim, "embedding")
    else:
        fresh = model_embedding(fresh, F.col("text"), client_factory, "embedding", **requests)
    fresh.select("digest", "embedding").write.mode("append").parquet(store)
    wanted = df.select(_digest(text).alias("digest")).distinct()
    vectors = stored_vectors(spark, store).join(wanted, "digest", "left_semi")
    known = materialize(vectors.groupBy("digest").agg(F.first("embedding").alias("embedding")), "vectors")
    joined = df.select(F.struct("*").alias("row"), _digest(text).alias("digest")).join(known, "digest", "left")
    kept = [F.col("row").getField(name).alias(name) for name in df.columns if name != out]
    return joined.select(*kept, F.col("embedding").alias(out))


def embed_columns_by_content(
    df: DataFrame,
    columns: list[str],
    store: str,
    dim: int,
    client_factory: ClientFactory | None = None,
    null_text: str | None = None,
    out: str = "embedding",
) -> DataFrame:
    """``embed_columns`` through a store of vectors."""
    text = join_text(*(F.col(c) for c in columns), null_text=null_text)
    return embed_by_content(df, text, store, dim, client_factory, out)
