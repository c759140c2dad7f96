"""CSV with line breaks in its fields, read by as many tasks as the file has splits.

Whether a split begins inside a quoted field depends on all that comes before it in its file, but
only through one bit: the parity of the quotes. So a first scan counts the quotes of every split, and
a running sum of the parities tells each split how it begins; then every split finds its records by
itself, and what lies on a border is put together from its pieces.
"""

from __future__ import annotations

import csv
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from supportgraph.sources.tables import read_csv
from supportgraph.workspace import materialize

QUOTE = '"'
#: Why a record cannot be trusted.
OPEN_QUOTE, STRAY_QUOTE, FIELDS = "quote is never closed", "quote inside a field without quotes", "number of fields"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, start, value``: the lines of every split (by the byte it begins at), in order."""
    place = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(place["file_path"].alias("file"), place["file_block_start"].alias("start"), "value")


def _inside(lines: DataFrame) -> set[tuple[str, int]]:
    """The splits that begin inside a quoted field. A row per split reaches the driver at most."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit(QUOTE), F.lit("")))
    odd = lines.groupBy("file", "start").agg((F.sum(quotes) % 2).cast("int").alias("odd"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    begun = odd.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    return {(r.file, r.start) for r in begun.where("inside = 1").select("file", "start").toLocalIterator()}


def _pieces(lines: DataFrame, inside: set[tuple[str, int]]) -> DataFrame:
    """``file, start, number, text, whole``: whole records, and the pieces that lie on borders.

    A piece that begins a record has a number; one that goes on with an earlier record has none and
    comes before all numbers. A quoted field that spans whole splits is one piece for each.
    """
    shared = lines.sparkSession.sparkContext.broadcast(inside)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun_inside, split, number, going, odd, rows = shared.value, None, 0, [], False, []

        def close(whole: bool) -> None:
            """The lines held so far are one record or one piece of it."""
            nonlocal number, going
            if going:
                first = number is None
                rows.append((*split, number, "\n".join(going), whole and not first))
                number = 0 if first else number + 1
                going = []

        def out() -> pa.RecordBatch:
            nonlocal rows
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            rows = []
            return pa.RecordBatch.from_arrays(columns, names=["file", "start", "number", "text", "whole"])

        for batch in batches:
            for key in zip(*(c.to_pylist() for c in batch.columns)):
                file, start, line = key
                if (file, start) != split:
                    close(not odd)
                    split, odd = (file, start), (file, start) in begun_inside
                    number = None if odd else 0
                going.append(line)
                odd ^= line.count(QUOTE) % 2 == 1
                if not odd:
                    close(True)
            yield out()
        close(not odd)
        yield out()

    schema = "file string, start bigint, number bigint, text string, whole boolean"
    return lines.mapInArrow(cut, schema)


def _records(spark: SparkSession, path: str) -> DataFrame:
    """``file, start, number, text, closed``: every record of every file, the header among them."""
    lines = _lines(spark, path)
    pieces = materialize(_pieces(lines, _inside(lines)), "pieces")
    whole = pieces.where("whole").select("file", "start", "number", "text", F.lit(True).alias("closed"))
    order = Window.partitionBy("file").orderBy("start", F.col("number").asc_nulls_first())
    # No more than two pieces a split: the last record of a split and what follows in the next ones.
    parts = pieces.where("NOT whole").withColumn("record", F.count("number").over(order))
    joined = (
        parts.groupBy("file", "record")
        .agg(F.sort_array(F.collect_list(F.struct("start", F.coalesce("number", F.lit(-1)).alias("number"), "text"))).alias("parts"))
        .select(
            "file", F.col("parts")[0]["start"].alias("start"), F.col("parts")[0]["number"].alias("number"),
            F.array_join(F.col("parts.text"), "\n").alias("text"),
        )
    )
    quotes = F.length("text") - F.length(F.replace("text", F.lit(QUOTE), F.lit("")))
    return whole.unionByName(joined.withColumn("closed", quotes % 2 == 0))


def _parsed(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """The names of the header, and ``file, start, number, fields, reason`` of every other record.
    Blank lines are no records."""
    names = read_csv(spark, path).columns
    width = len(names)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        for batch in batches:
            fields, reasons = [], []
            for text, closed in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                text = text[:-1] if text.endswith("\r") else text
                row, reason = [], None if closed else OPEN_QUOTE
                if closed and text:
                    try:
                        row = next(csv.reader([text], strict=True))
                    except csv.Error:
                        row, reason = next(csv.reader([text])), STRAY_QUOTE
                    # A quote that opens nothing stands inside a field without quotes.
                    if reason is None and text.count(QUOTE) != 2 * _quoted(text) + 2 * sum(f.count(QUOTE) for f in row):
                        reason = STRAY_QUOTE
                    if reason is None and len(row) != width:
                        reason = FIELDS
                fields.append([f or None for f in row] if closed else [text])
                reasons.append(reason)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(fields, pa.list_(pa.string())), pa.array(reasons, pa.string())],
                names=["file", "start", "number", "fields", "reason"],
            )

    schema = "file string, start bigint, number bigint, fields array<string>, reason string"
    parsed = _records(spark, path).mapInArrow(parse, schema)
    return names, parsed.where("NOT (start = 0 AND number = 0) AND size(fields) > 0")


def _quoted(text: str) -> int:
    """How many fields of a record are in quotes."""
    found, at, size = 0, 0, len(text)
    while at <= size:
        if at < size and text[at] == QUOTE:
            found += 1
            at += 1
            while True:
                at = text.find(QUOTE, at)
                if at < 0:
                    return found
                if text[at + 1 : at + 2] != QUOTE:
                    break
                at += 2
        end = text.find(",", at)
        if end < 0:
            return found
        at = end + 1
    return found


def read_csv_splits(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV like ``read_csv`` with line breaks in fields, read by a task per split.

    Every column is text, an empty field null. The header is that of the first file; every file has
    one. A record with too few fields is filled up with nulls, one with too many is cut, as Spark
    does; ``csv_split_rejects`` tells both, and records whose quotes are broken. A quote is only
    special at the start of a field; one inside a field without quotes throws off all that follows
    in its file up to the next, so look at the rejects before using a file from elsewhere.
    """
    names, rows = _parsed(spark, path)
    fields = [F.get("fields", F.lit(i)).alias(name) for i, name in enumerate(names)]
    return rows.where(F.col("reason").isNull() | (F.col("reason") != OPEN_QUOTE)).select(*fields)


def csv_split_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Records that cannot be trusted: ``file, start, number, reason, fields``, where start is the
    byte at which the split begins and number counts the records that begin in it."""
    _, rows = _parsed(spark, path)
    return rows.where("reason IS NOT NULL").select("file", "start", "number", "reason", "fields")
