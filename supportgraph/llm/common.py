"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys with more than one in so many of all rows are joined by broadcast: fewer than this many
#: keys can be so large, which bounds the broadcast side whatever the input.
HOT = 1000

#: Bytes that are white space in the word rules: blank, tab, line feed, vertical tab, form feed,
#: carriage return. ``bytes.split()`` cuts at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of the Arrow batches in which rows reach Python.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, size: str = "4m") -> None:
    """Cut Arrow batches by their bytes: ten thousand rows, Spark's other bound, may be very long
    texts. A setting of the session's own is left alone."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, size)


def texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of a batch of texts, a few copied at a time; null is the empty text."""
    for start in range(0, len(column), 256):
        for raw in column.slice(start, 256).cast(pa.binary()).to_pylist():
            yield raw or b""


class Own:
    """The columns of a table under names that no operator uses, and back under their own.

    Inside an operator the i-th column is called ``own<i>``; names that operators make for
    themselves never begin so. Columns with the name of a result, in letters of any case, give way
    to it: they are known to the operator and left out of the result.
    """

    def __init__(self, df: DataFrame, added: list[str], keep: list[str] | None = None) -> None:
        self.names = df.columns
        gone = {name.lower() for name in added}
        self.kept = [
            i for i, c in enumerate(self.names) if c.lower() not in gone and (keep is None or c in keep)
        ]
        self.table = df.toDF(*[f"own{i}" for i in range(len(self.names))])

    def __getitem__(self, name: str) -> str:
        """What the column called ``name`` is called inside; letters in that case go first."""
        same = [i for i, c in enumerate(self.names) if c == name]
        same = same or [i for i, c in enumerate(self.names) if c.lower() == name.lower()]
        if not same:
            raise ValueError(f"there is no column {name!r} among {self.names}")
        return f"own{same[0]}"

    @property
    def columns(self) -> list[str]:
        """The inside names of the columns that stay."""
        return [f"own{i}" for i in self.kept]

    def types(self) -> str:
        """The columns that stay, as the beginning of a schema text."""
        schema = self.table.schema
        return "".join(f"own{i} {schema[i].dataType.simpleString()}, " for i in self.kept)

    def restore(self, df: DataFrame, *added: str | Column) -> DataFrame:
        """The columns that stay, under their own names, and the results."""
        # Named at the end: a name given in the same step could be taken for a column of ``df``.
        out = df.select(*self.columns, *added)
        return out.toDF(*[self.names[i] for i in self.kept], *out.columns[len(self.kept) :])


def crc32(column: Column) -> Column:
    """CRC-32 of the decimal text of a document id; null for a null id."""
    return F.crc32(column.cast("string").cast("binary"))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: str) -> DataFrame:
    """``rows`` with the columns of ``groups``, a stored table with one row per key (left join).

    ``size`` is the column of ``groups`` that counts a key's rows. Keys with more than a thousandth
    of all counted rows are fewer than a thousand, so they are broadcast and their rows are dealt
    out by ``spread``; every other key is joined by a shuffle in which no key holds more than a
    thousandth. A null key finds nothing and is dealt out likewise.
    """
    values = [c for c in groups.columns if c != key]
    total = groups.agg(F.sum(size)).first()[0] or 0
    large = F.col(size) * HOT > total
    hot = groups.filter(large).select(F.col(key), F.struct(*values).alias("_hot"))
    cold = groups.filter(~large).select(
        F.col(key), F.lit(0).cast("bigint").alias("_salt"), F.struct(*values).alias("_cold")
    )
    alone = F.col("_hot").isNotNull() | F.col(key).isNull()
    marked = rows.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.when(alone, F.pmod(F.xxhash64(spread), F.lit(9973)) + 1).otherwise(F.lit(0).cast("bigint"))
    )
    found = F.coalesce(F.col("_hot"), F.col("_cold"))
    return marked.join(cold, [key, "_salt"], "left").select(
        *rows.columns, *[found[c].alias(c) for c in values]
    )
