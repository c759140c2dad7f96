"""Exact duplicates by two passes with a Bloom filter."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supportgraph.llm.common import Own, join_groups
from supportgraph.workspace import materialize

#: Positions a digest sets in the filter, and bits of the filter per row.
PROBES, BITS_PER_ROW = 3, 8
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The filter is merged and stored in segments of so many bits.
SEGMENT = 1 << 16
#: Positions a task gathers before it hands a part of the filter on.
FLUSH = 1 << 21


def digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 text with A-Z in lower case; null counts as the empty text."""
    lower = F.translate(F.coalesce(text, F.lit("")), LETTERS, LETTERS.lower())
    return F.unhex(F.sha2(lower.cast("binary"), 256))


def _positions(digests: pa.Array, bits: int) -> np.ndarray:
    """One row of filter positions per digest."""
    words = np.frombuffer(b"".join(digests.to_pylist()), "<u8").reshape(-1, 4)
    step = np.arange(PROBES, dtype=np.uint64)
    return (words[:, :1] + step * (words[:, 1:2] | np.uint64(1))) & np.uint64(bits - 1)


def filter_bits(rows: int, max_filter_bytes: int) -> int:
    """Bits of the filter: a power of two, eight or more a row, never above the bound."""
    wanted = max(SEGMENT, 1 << (rows * BITS_PER_ROW - 1).bit_length() if rows else SEGMENT)
    largest = max(SEGMENT, 1 << ((max_filter_bytes * 8).bit_length() - 1))
    return min(wanted, largest)


def digest_ranges(rows: int, max_filter_bytes: int) -> list[tuple[bytes | None, bytes | None]]:
    """Ranges of digests, each of so few rows that its filter has eight bits a row within the bound:
    (first, end) by their first two bytes, null where a range is open."""
    fit = max(max_filter_bytes * 8, SEGMENT) // BITS_PER_ROW
    # A tenth more: digests are spread evenly, but not exactly.
    n = min(1 << 16, 1 << max(0, (rows * 11 // 10 - 1) // fit).bit_length())
    edges = [None, *((i * (1 << 16) // n).to_bytes(2, "big") for i in range(1, n)), None]
    return list(zip(edges, edges[1:]))


def repeated_filter(digests: DataFrame, column: str, bits: int) -> DataFrame:
    """First pass: the positions of a Bloom filter that two or more rows set.

    Each task hands on, by segment, the positions that its rows set once and those they set more
    often, so a text with any number of copies counts once or twice per task. Segments are merged
    by adding these counts up to two. Returns (segment, bits): eight kilobytes a segment.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hand_on(waiting: list[np.ndarray]) -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(waiting), return_counts=True)
            segments = found // np.uint64(SEGMENT)
            starts = np.flatnonzero(np.r_[True, segments[1:] != segments[:-1]])
            low, once = (found % np.uint64(SEGMENT)).astype("<u2"), times == 1
            rows = [
                (int(segments[a]), low[a:b][once[a:b]].tobytes(), low[a:b][~once[a:b]].tobytes())
                for a, b in zip(starts, np.r_[starts[1:], len(found)])
            ]
            return pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))],
                names=["segment", "once", "often"],
            )

        waiting, held = [], 0
        for batch in batches:
            if batch.num_rows:
                waiting.append(_positions(batch.column(0), bits).ravel())
                held += len(waiting[-1])
            if held >= FLUSH:
                yield hand_on(waiting)
                waiting, held = [], 0
        if held:
            yield hand_on(waiting)

    def merge(part: pa.Table) -> pa.Table:
        times = np.zeros(SEGMENT, np.uint8)
        for once, often in zip(part.column("once"), part.column("often")):
            at = np.frombuffer(once.as_py(), "<u2")
            times[at] = np.minimum(times[at] + 1, 2)
            times[np.frombuffer(often.as_py(), "<u2")] = 2
        kept = np.packbits(times == 2).tobytes()
        return pa.table(
            {"segment": part.column("segment").slice(0, 1), "bits": pa.array([kept], pa.binary())}
        )

    partial = digests.select(column).mapInArrow(parts, "segment bigint, once binary, often binary")
    return partial.groupBy("segment").applyInArrow(merge, "segment bigint, bits binary")


def maybe_repeated(digests: DataFrame, column: str, rows: int, max_filter_bytes: int) -> Column:
    """Second pass: whether another row may have the digest. Never false for one that is repeated."""
    bits = filter_bits(rows, max_filter_bytes)
    stored = materialize(repeated_filter(digests, column, bits), "repeated")
    # At most max_filter_bytes: one bitmap of SEGMENT bits per segment.
    shared = digests.sparkSession.sparkContext.broadcast(
        {"segments": {r.segment: bytes(r.bits) for r in stored.toLocalIterator()}}
    )

    @F.arrow_udf("boolean")
    def test(digests: pa.Array) -> pa.Array:
        known = shared.value
        if "all" not in known:  # once per Python worker
            whole = np.zeros(bits // 8, np.uint8)
            for segment, part in known["segments"].items():
                start = segment * SEGMENT // 8
                whole[start : start + SEGMENT // 8] = np.frombuffer(part, np.uint8)
            known["all"] = whole
        at = _positions(digests, bits)
        hit = known["all"][at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8) & 1
        return pa.array(hit.all(axis=1))

    return test(F.col(column))


def exact_dedup(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    max_filter_bytes: int = 64 << 20,
    keep: list[str] | None = None,
) -> DataFrame:
    """Every row of ``docs`` with keep_id, group_size, kept and text_sha256.

    Texts are equal when they are identical after lower-casing A-Z; a null text counts as empty.
    The largest id of equal texts stays. Texts are read and hashed once; the columns ``keep``, all
    but the text if not given, are stored with their digests, and all that follows works on these.
    The first pass fills a Bloom filter that tells positions set by two or more rows; the second
    tests every row. Only rows that may be repeated are shuffled, by digest; all others go straight
    through. A false hit costs its own shuffle and is found to be alone there.

    A filter has eight bits or more a row and at most ``max_filter_bytes``, the bound of the
    broadcast. Where that is too small for all rows, the digests are worked on range by range, each
    with a filter of its own, so the share of rows that are shuffled is the same at any size. Files
    are sorted by digest, so a range reads its own part of them.

    Rows that have both id and text in common are one document: all are kept or none. A null id
    is smaller than any other and kept only where its text has no other id. An empty table gives
    an empty result. Columns of ``docs`` that have the result's names give way to it, others may
    have any name.
    """
    added = ["keep_id", "group_size", "kept", "text_sha256"]
    own = Own(docs, added, [c for c in docs.columns if c != text] if keep is None else keep)
    narrow = own.table.select(*own.columns, F.col(own[id]).alias("id"), digest(F.col(own[text])).alias("digest"))
    stored = materialize(narrow.sortWithinPartitions("digest"), "digests")
    ranges = digest_ranges(stored.count(), max_filter_bytes)
    found = []
    for first, end in ranges:
        rows = stored
        if first is not None:
            rows = rows.filter(F.col("digest") >= F.lit(first))
        if end is not None:
            rows = rows.filter(F.col("digest") < F.lit(end))
        marked = rows.withColumn("maybe", maybe_repeated(rows, "digest", rows.count(), max_filter_bytes))
        suspects = marked.filter("maybe").drop("maybe")
        groups = materialize(
            suspects.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")),
            "groups",
        )
        found.append(join_groups(suspects, groups, "digest", "group_size", "id"))
        alone = [F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size")]
        found.append(marked.filter(~F.col("maybe")).drop("maybe").select("*", *alone))
    done = (
        reduce(DataFrame.unionByName, found)
        .withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))
        .withColumn("text_sha256", F.lower(F.hex("digest")))
    )
    return own.restore(done, *added)
