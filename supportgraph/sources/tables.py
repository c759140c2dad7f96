"""Node tables: CSV in, typed rows out, full refresh to Parquet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from supportgraph.functions.parsing import parse_vector, typed
from supportgraph.schemas import KEYS, SCHEMAS, SupportGraph

# The writer would strip blanks at the ends of a text. An empty text and null are the same in these
# files: both are read as null.
CSV_OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Header CSV with every column as text and empty fields as null.

    Texts with line breaks need ``multi_line``, and such a file is read by one task: convert large
    exports to Parquet once, or split them into many files.
    """
    return spark.read.options(**CSV_OPTIONS).option("multiLine", multi_line).csv(path)


def apply_schema(rows: DataFrame, schema: StructType) -> DataFrame:
    """Pick the columns of ``schema`` by name and type them; a missing column is null."""
    present = set(rows.columns)
    return rows.select(
        *(
            typed(
                F.col(f.name) if f.name in present else F.lit(None).cast("string"), f.dataType
            ).alias(f.name)
            for f in schema.fields
        )
    )


def with_key(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull())


def without_key(rows: DataFrame, key: str) -> DataFrame:
    """The rows that a load leaves out, for a side table."""
    return rows.where(F.col(key).isNull())


def load_node_table(spark: SparkSession, label: str, path: str, multi_line: bool = True):
    """One node table from CSV: rows with a key, typed."""
    rows = read_csv(spark, path, multi_line)
    return with_key(apply_schema(rows, SCHEMAS[label]), KEYS[label])


def load_rejects(
    spark: SparkSession, paths: dict[str, str], multi_line: bool = True
) -> DataFrame:
    """The rows that ``load_graph`` leaves out, for they have no key: ``label, key, reason, detail``
    with the row as it was read, as JSON, for the detail."""
    parts = []
    for label in SCHEMAS:
        rows = read_csv(spark, paths[label], multi_line)
        key = F.col(KEYS[label]) if KEYS[label] in rows.columns else F.lit(None)
        parts.append(
            rows.where(key.isNull()).select(
                F.lit(label).alias("label"),
                F.lit(None).cast("string").alias("key"),
                F.lit("no key").alias("reason"),
                F.to_json(F.struct("*")).alias("detail"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def load_graph(spark: SparkSession, paths: dict[str, str], multi_line: bool = True) -> SupportGraph:
    """The seven node tables, from one CSV path per label. Rows without a key are not among them:
    see ``load_rejects``."""
    return SupportGraph(
        **{label: load_node_table(spark, label, paths[label], multi_line) for label in SCHEMAS}
    )


def refresh_table(df: DataFrame, path: str) -> None:
    """Replace a stored table as a whole."""
    df.write.mode("overwrite").parquet(path)


def refresh_graph(graph: SupportGraph, root: str) -> None:
    for label, df in graph.tables().items():
        refresh_table(df, f"{root}/{label}")


def read_graph(spark: SparkSession, root: str) -> SupportGraph:
    return SupportGraph(**{label: spark.read.parquet(f"{root}/{label}") for label in SCHEMAS})


def write_csv_with_vectors(df: DataFrame, path: str, vector: str = "embedding") -> None:
    """CSV with the vector column as a JSON list. Parquet is the better choice for large tables."""
    (
        df.withColumn(vector, F.to_json(vector))
        .write.mode("overwrite")
        .options(**CSV_OPTIONS)
        .csv(path)
    )


def read_csv_vectors(
    spark: SparkSession, path: str, key: str = "ticketId", vector: str = "embedding"
) -> DataFrame:
    """Key and vector from a CSV written with a JSON list column."""
    rows = read_csv(spark, path)
    return rows.select(key, parse_vector(F.col(vector)).alias(vector)).where(F.col(key).isNotNull())
