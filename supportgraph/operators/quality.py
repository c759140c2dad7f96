"""Key, reference, vector and record checks."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportgraph.functions.rules import CATEGORY_CODES, FALLBACK_TITLE, analysis_error, strip
from supportgraph.functions.similarity import norm


#: Rows whose keys a task counts; tasks that share the rows of one key.
ROWS_OF_A_TASK, SHARES = 1 << 19, 32


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their counts.

    A table that all cores can hold the keys of is counted before the shuffle, so a key that fills a
    third of it is one row per task. Of a larger one, rows are dealt to as many tasks as its size asks
    for, so what a task holds does not grow with the table; a key's rows are dealt in SHARES.
    """
    rows, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    if rows <= cores * ROWS_OF_A_TASK:
        return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    tasks = ceil(rows / ROWS_OF_A_TASK)
    share = F.pmod(F.monotonically_increasing_id(), F.lit(SHARES)).alias("__share")
    dealt = df.select(*keys, share).repartition(tasks, *keys, "__share")
    counts = dealt.groupBy(*keys, "__share").agg(F.count("*").alias("n")).drop("__share")
    total = F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("n")  # never null, like a count
    return counts.repartition(tasks, *keys).groupBy(*keys).agg(total).where("n > 1")


def split_duplicates(df: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a key of their own, and the quarantined rest."""
    repeated = duplicate_keys(df, *keys).select(*keys)
    return df.join(repeated, list(keys), "left_anti"), df.join(repeated, list(keys), "left_semi")


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` itself; raises when a key occurs twice."""
    sample = duplicate_keys(df, *keys).limit(5).collect()
    if sample:
        raise ValueError(f"duplicate keys {list(keys)}: {[tuple(r)[:-1] for r in sample]}")
    return df


def dangling_references(df: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is set but names no row of ``target``."""
    known = target.select(F.col(key).alias(column))
    return df.where(F.col(column).isNotNull()).join(known, column, "left_anti")


def vector_errors(df: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """Add ``error``: why a vector cannot be searched, null when it can."""
    v = F.col(vector)
    reason = (
        F.when(v.isNull(), "missing")
        .when(F.size(v) != dim, "dimension")
        .when(F.exists(v, lambda x: x.isNull() | F.isnan(x)), "element")
        .when(norm(v) == 0, "zero")
    )
    return df.withColumn("error", reason)


def valid_vectors(df: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    return vector_errors(df, dim, vector).where(F.col("error").isNull()).drop("error")


def vector_rejects(df: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    return vector_errors(df, dim, vector).where(F.col("error").isNotNull())


def validate_analysis(df: DataFrame, codes: list[str] = CATEGORY_CODES) -> DataFrame:
    """Strip the texts of valid analysis records and replace invalid ones by the fallback record,
    whose description is the message of the rule that failed. ``codes``: the known categories."""
    error = "__error"
    ok = F.col(error).isNull()
    return (
        df.withColumn(
            error, analysis_error(F.col("title"), F.col("description"), F.col("category"), codes)
        )
        .withColumns(
            {
                "is_related": F.coalesce("is_related", F.lit(True)) & ok,
                "category": F.when(ok, F.col("category")),
                "title": F.when(ok, strip(F.col("title"))).otherwise(FALLBACK_TITLE),
                "description": F.when(ok, strip(F.col("description"))).otherwise(F.col(error)),
            }
        )
        .drop(error)
    )
