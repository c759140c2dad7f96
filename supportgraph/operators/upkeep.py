"""Inverted lists kept up with a changing table: only what changed is encoded and written.

A stored index is a sequence of generations. Each has the rows that came or changed (``entries``) and
the keys that went or changed (``gone``), which hide their entries in earlier generations. Compaction
writes the groups of lists where much is hidden or scattered anew, and leaves the others alone. A
manifest, a row per group, tells which generations count; it is written last, so a run that fails
leaves the index as it was.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from supportgraph.operators.ivf import ListIndex, Quantizer, build_lists, read_quantizer, write_quantizer
from supportgraph.operators.search import TICKET_ID, VECTOR, _searchable
from supportgraph.workspace import children, exists, materialize

#: Groups of lists, at most: the manifest has a row for each.
MOST_GROUPS = 1024


def row_digest(columns: list[str]) -> Column:
    """Of the values of columns, names and nulls included."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """What became of each key, ``key, digest, change``, between tables ``(key, digest)`` with one row
    per key: "inserted", "changed" or "deleted". Keys that stayed the same have no row, nor has null."""
    before = old.where(F.col(key).isNotNull()).select(key, F.col("digest").alias("before"))
    after = new.where(F.col(key).isNotNull()).select(key, F.col("digest").alias("digest"))
    change = (
        F.when(F.col("before").isNull(), "inserted").when(F.col("digest").isNull(), "deleted").otherwise("changed")
    )
    return before.join(after, key, "full").where(~F.col("before").eqNullSafe(F.col("digest"))).select(
        key, "digest", change.alias("change")
    )


@dataclass(frozen=True)
class Upkeep:
    """What an update did: rows that came, changed and went."""

    inserted: int
    changed: int
    deleted: int


def _groups(quantizer: Quantizer) -> tuple[int, int]:
    """Groups of lists, and lists in each."""
    lists = len(quantizer.centroids)
    width = ceil(lists / MOST_GROUPS)
    return ceil(lists / width), width


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict[int, int]]:
    """The last generation and, for each group, the generation it was last written whole in."""
    done = [int(name) for name in children(spark, f"{path}/manifest") if exists(spark, f"{path}/manifest/{name}/_SUCCESS")]
    rows = spark.read.parquet(f"{path}/manifest/{max(done)}").collect()  # MOST_GROUPS rows at most
    return rows[0]["last"], {r["part"]: r["whole"] for r in rows}


def _publish(spark: SparkSession, path: str, last: int, whole: dict[int, int]) -> None:
    names = [int(name) for name in children(spark, f"{path}/manifest")] if exists(spark, f"{path}/manifest") else []
    rows = [(last, part, generation) for part, generation in whole.items()]
    table = spark.createDataFrame(rows, "last int, part int, whole int").coalesce(1)
    table.write.parquet(f"{path}/manifest/{max(names, default=-1) + 1}")


def _schemas(spark: SparkSession, path: str) -> tuple[str, str]:
    kind = spark.read.parquet(f"{path}/keys").schema[TICKET_ID].dataType.simpleString()
    entries = f"list int, `{TICKET_ID}` {kind}, code binary, {VECTOR} array<double>, digest string, generation int, part int"
    return entries, f"`{TICKET_ID}` {kind}, generation int"


def _live(spark: SparkSession, path: str) -> DataFrame:
    """Entries that no later generation hides, with their digest, generation and part."""
    last, whole = _manifest(spark, path)
    entry_schema, gone_schema = _schemas(spark, path)
    starts = spark.createDataFrame(list(whole.items()), "part int, whole int")
    entries = spark.read.schema(entry_schema).parquet(f"{path}/entries").where(F.col("generation") <= last)
    entries = entries.join(F.broadcast(starts), "part").where("generation >= whole").drop("whole")
    gone = spark.read.schema(gone_schema).parquet(f"{path}/gone").where(F.col("generation") <= last)
    hidden = gone.groupBy(TICKET_ID).agg(F.max("generation").alias("hidden_by"))
    # A generation hides what is older than itself: its own entries are the new state of its keys.
    return entries.join(hidden, TICKET_ID, "left").where("hidden_by IS NULL OR generation >= hidden_by").drop("hidden_by")


def _write(entries: DataFrame, gone: DataFrame, quantizer: Quantizer, path: str, generation: int) -> None:
    part = F.floor(F.col("list") / _groups(quantizer)[1]).cast("int")
    (
        entries.withColumn("part", part)
        .repartitionByRange("part", "list", TICKET_ID)
        .sortWithinPartitions("part", "list")
        .write.mode("overwrite")
        .partitionBy("part")
        .parquet(f"{path}/entries/generation={generation}")
    )
    gone.select(TICKET_ID).write.mode("overwrite").parquet(f"{path}/gone/generation={generation}")


def _usable(vectors: DataFrame, dim: int) -> DataFrame:
    """Rows that an index can hold, with their digest."""
    square = F.aggregate(VECTOR, F.lit(0.0), lambda sum_, x: sum_ + x.cast("double") * x.cast("double"))
    rows = _searchable(vectors, TICKET_ID, dim).where((square > 0) & (square < float("inf")))
    return rows.withColumn("digest", row_digest([VECTOR]))


def _digests(rows: DataFrame) -> DataFrame:
    """Of several rows with one key the one with the least digest counts: an index has one vector a key."""
    return rows.groupBy(TICKET_ID).agg(F.min("digest").alias("digest"))


def _encoded(rows: DataFrame, keys: DataFrame, quantizer: Quantizer) -> DataFrame:
    """Entries of the rows that ``keys (ticketId, digest)`` names; repeated rows give one."""
    wanted = rows.join(keys.select(TICKET_ID, "digest"), [TICKET_ID, "digest"], "left_semi")
    once = wanted.groupBy(TICKET_ID, "digest").agg(F.first(VECTOR).alias(VECTOR))
    named = once.select(F.struct(TICKET_ID, "digest").alias("row"), VECTOR)
    entries = build_lists(named, quantizer, "row").select("list", f"row.{TICKET_ID}", "code", VECTOR, "row.digest")
    return materialize(entries, "entries")  # cutting ranges reads them twice


def create(vectors: DataFrame, quantizer: Quantizer, path: str) -> Upkeep:
    """Store the first generation of an index under ``path``, which must be new."""
    spark = vectors.sparkSession
    write_quantizer(spark, quantizer, f"{path}/quantizer")
    nothing = vectors.select(TICKET_ID).limit(0)
    nothing.write.parquet(f"{path}/keys")
    rows = _usable(vectors, quantizer.dim)
    _write(_encoded(rows, _digests(rows), quantizer), nothing, quantizer, path, 0)
    _publish(spark, path, 0, {part: 0 for part in range(_groups(quantizer)[0])})
    return Upkeep(_live(spark, path).count(), 0, 0)


def update(vectors: DataFrame, path: str) -> Upkeep:
    """Bring a stored index to the state of ``vectors``, the whole table as it is now.

    Keys and digests of both are compared by a join; vectors of rows that stayed the same are not
    shuffled, encoded or written. What changed becomes a generation of its own. The quantiser stays as
    it was trained; when the table has drifted far from it, train and create anew.
    """
    spark, quantizer = vectors.sparkSession, read_quantizer(vectors.sparkSession, f"{path}/quantizer")
    last, whole = _manifest(spark, path)
    rows = _usable(vectors, quantizer.dim)
    found = materialize(changes(_live(spark, path).select(TICKET_ID, "digest"), _digests(rows), TICKET_ID), "changes")
    counts = {r["change"]: r["n"] for r in found.groupBy("change").agg(F.count("*").alias("n")).collect()}
    done = Upkeep(*(counts.get(name, 0) for name in ("inserted", "changed", "deleted")))
    if not counts:
        return done
    fresh = _encoded(rows, found.where("change <> 'deleted'"), quantizer)
    _write(fresh, found.where("change <> 'inserted'"), quantizer, path, last + 1)
    _publish(spark, path, last + 1, whole)
    return done


def compact(spark: SparkSession, path: str, share: float = 0.1) -> list[int]:
    """Write the groups anew in which more than ``share`` of the entries are hidden or lie outside the
    group's whole generation, and return them. Others are neither read beyond their keys nor written."""
    quantizer = read_quantizer(spark, f"{path}/quantizer")
    last, whole = _manifest(spark, path)
    starts = spark.createDataFrame(list(whole.items()), "part int, whole int")
    stored = spark.read.schema(_schemas(spark, path)[0]).parquet(f"{path}/entries").where(F.col("generation") <= last)
    stored = stored.join(F.broadcast(starts), "part").where("generation >= whole").groupBy("part").agg(F.count("*").alias("stored"))
    live = _live(spark, path).join(F.broadcast(starts), "part")
    kept = live.groupBy("part").agg(F.count_if(F.col("generation") == F.col("whole")).alias("kept"))
    loose = stored.join(kept, "part", "left").where(F.col("stored") - F.coalesce("kept", F.lit(0)) > share * F.col("stored"))
    touched = sorted(r["part"] for r in loose.collect())  # MOST_GROUPS numbers at most
    if not touched:
        return []
    again = _live(spark, path).where(F.col("part").isin(touched)).drop("generation", "part")
    nothing = spark.read.parquet(f"{path}/keys")
    _write(again, nothing, quantizer, path, last + 1)
    _publish(spark, path, last + 1, whole | {part: last + 1 for part in touched})
    return touched


def read(spark: SparkSession, path: str) -> ListIndex:
    """The index in its present state, for ``ivf_topk``."""
    quantizer = read_quantizer(spark, f"{path}/quantizer")
    return ListIndex(_live(spark, path).select("list", TICKET_ID, "code", VECTOR), quantizer)
