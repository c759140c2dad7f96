"""Near duplicates by SimHash fingerprints that differ in few bits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportgraph.llm.common import Own, join_groups, texts
from supportgraph.workspace import materialize

SEED = 42
#: Shingles whose bits are counted, and fingerprints whose variants are made, at a time.
SHINGLES, FINGERPRINTS = 1 << 15, 1 << 12
#: Bytes of variants that a task writes or reads, about.
VARIANT_BYTES = 32 << 20


def fingerprint(raw: bytes, shingle: int) -> int:
    """The 64-bit SimHash of a text over its word shingles; zero where there is no word."""
    words = raw.lower().split()
    if not words:
        return 0
    width, joined = min(shingle, len(words)), b" ".join(words)
    ends = [0, *accumulate(len(w) + 1 for w in words)]
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    total = len(words) - width + 1
    for low in range(0, total, SHINGLES):
        high = min(low + SHINGLES, total)
        block = b"".join(
            [digest(joined[a : b - 1], SEED) for a, b in zip(ends[low:high], ends[low + width : high + width])]
        )
        bits = np.unpackbits(np.frombuffer(block, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame, id: str, text: str, shingle: int) -> DataFrame:
    """(id, fingerprint as a signed 64-bit number) of every row; null texts have no words."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x, shingle) for x in texts(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints.view(np.int64))], names=["id", "fingerprint"]
            )

    own = Own(docs, [])
    source = own.table.select(F.col(own[id]).alias("id"), F.col(own[text]).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(compute, f"id {kind}, fingerprint bigint")


def variant_masks(distance: int, groups: int) -> list[tuple[int, int, np.ndarray]]:
    """(bits left out, mark, flips): what a fingerprint's variants are made of.

    Two numbers at an even distance of 2h or less have a variant in common that is h flips or less
    from either. At an odd distance of 2h + 1 one differing bit is left over: the bits are cut into
    groups, and the group that holds that bit is left out of the comparison. So for an odd distance
    there is one set of variants per group, marked by its number in the place of the bits left out.
    """
    left_out = [0]
    if distance % 2:
        edges = [64 * g // groups for g in range(groups + 1)]
        left_out = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    sets = []
    for number, mask in enumerate(left_out):
        free = [i for i in range(64) if not mask >> i & 1]
        flips = [sum(1 << i for i in c) for n in range(distance // 2 + 1) for c in combinations(free, n)]
        mark = number << ((mask & -mask).bit_length() - 1) if mask else 0
        sets.append((~mask & (1 << 64) - 1, mark, np.array(flips, np.uint64)))
    return sets


def variants(prints: DataFrame, distance: int, groups: int) -> DataFrame:
    """(variant, fingerprint) for each of the given fingerprints, a stored table.

    The rows are dealt out first: a task gets as many as make VARIANT_BYTES of variants.
    """
    masks = variant_masks(distance, groups)
    parts = ceil(prints.count() * sum(len(flips) for *_, flips in masks) * 16 / VARIANT_BYTES)
    dealt = prints.select("fingerprint").repartition(max(parts, 1), "fingerprint")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for low in range(0, len(numbers), FINGERPRINTS):
                some = numbers[low : low + FINGERPRINTS]
                for kept, mark, flips in masks:
                    ball = (some & np.uint64(kept) | np.uint64(mark))[:, None] ^ flips
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ball.ravel().view(np.int64)),
                            pa.array(np.repeat(some, len(flips)).view(np.int64)),
                        ],
                        names=["variant", "fingerprint"],
                    )

    return dealt.mapInArrow(emit, "variant bigint, fingerprint bigint").repartition(max(parts, 1), "variant")


def _forest(prints: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Links that connect whatever is linked among these fingerprints, one fewer than they are."""
    left = prints
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            one = reached.pop()
            near = np.bitwise_count(left ^ one) <= distance
            for other in left[near]:
                yield one, other
            reached.extend(left[near])
            left = left[~near]


def links(pairs: DataFrame, distance: int) -> DataFrame:
    """Links (a > b) that connect all fingerprints within ``distance`` that share a variant.

    ``pairs`` has the rows of a variant in one part. Rows of a variant lie together in a sorted part. Each variant's fingerprints are compared among
    themselves and leave a spanning forest of the true links, never all pairs.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints = np.empty(0, np.int64), np.empty(0, np.uint64)

        def found(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[starts, len(keys)])
            two = starts[sizes == 2]
            a, b = prints[two], prints[two + 1]
            near = np.bitwise_count(a ^ b) <= distance
            edges = [np.stack([a[near], b[near]], axis=1)]
            for start, size in zip(starts[sizes > 2], sizes[sizes > 2]):
                forest = list(_forest(prints[start : start + size], distance))
                if forest:
                    edges.append(np.array(forest, np.uint64))
            both = np.sort(np.concatenate(edges).view(np.int64), axis=1)
            both = np.unique(both, axis=0) if len(both) else both
            return pa.RecordBatch.from_arrays([pa.array(both[:, 1]), pa.array(both[:, 0])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
            prints = np.concatenate([prints, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            last = int(np.searchsorted(keys, keys[-1]))  # the last variant may go on
            if last:
                yield found(keys[:last], prints[:last])
                keys, prints = keys[last:], prints[last:]
        if len(keys):
            yield found(keys, prints)

    together = pairs.sortWithinPartitions("variant")
    return together.mapInArrow(find, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the links (a > b) can reach.

    Alternates two steps until nothing changes: every larger neighbour of a node is linked to the
    node's smallest neighbour, then every smaller one is. The number of rounds grows with the
    logarithm of the component's size. Smallest neighbours are combined before they are shuffled,
    and Spark splits the rows of a node with very many links in the join with them.
    """

    def state(table: DataFrame) -> tuple:
        return tuple(table.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = materialize(edges, "links")
    seen = state(now)
    while seen[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("least")), "least")
        large = materialize(
            both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct(),
            "large",
        )
        least = materialize(large.groupBy("a").agg(F.min("b").alias("least")), "least")
        small = (
            large.join(least, "a")
            .select(F.explode(F.array("a", "b")).alias("a"), F.col("least").alias("b"))
            .filter("a <> b")
            .distinct()
        )
        now, before = materialize(small, "links"), seen
        seen = state(now)
        if seen == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    shingle: int = 3,
    distance: int = 3,
    groups: int = 3,
) -> DataFrame:
    """(id, fingerprint, component_id) of every row: who is linked with whom, through any number.

    Fingerprints link at ``distance`` or fewer differing bits. Every different fingerprint emits
    its variants within half that distance; those that share one are compared (see
    ``variant_masks``). component_id is the smallest id that can be reached, the own one included.

    Equal fingerprints are one node, however many rows have them, so a text with very many copies
    is worked on once; its rows meet their component by broadcast. ``groups`` sets the number of
    variants (131 at distance 3 and three groups) against the bits that must agree (42), which
    decides how many unrelated fingerprints meet by chance.

    Null and empty texts have the fingerprint zero and are linked like others. A null id is larger
    than any other: component_id is null only where no row of the component has an id. Repeated
    rows give repeated rows. An empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, id, text, shingle), "fingerprints")
    nodes = materialize(
        prints.groupBy("fingerprint").agg(F.min("id").alias("first"), F.count("*").alias("rows")), "nodes"
    )
    found = components(links(variants(nodes, distance, groups), distance))
    rooted = materialize(
        nodes.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn(
            "root", F.coalesce("root", "fingerprint")
        ),
        "rooted",
    )
    named = materialize(
        rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("members")), "named"
    )
    known = materialize(
        join_groups(rooted, named, "root", "members", "fingerprint").select(
            "fingerprint", "rows", "component_id", F.col("root").alias("component")
        ),
        "known",
    )
    out = join_groups(prints, known, "fingerprint", "rows", "id")
    return out.select(F.col("id").alias(id), "fingerprint", "component_id", "component")


def keep_one(
    docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 3
) -> DataFrame:
    """The rows of ``docs``, one of each group of near duplicates: that with the smallest id.

    Rows whose id is their own are told by it: their texts are shuffled once, to meet the kept ids.
    Rows that share an id, or have none, are told by their fingerprint, computed again for them
    alone: of the rows of a group that have its smallest id (or none, where the whole group has
    none) the first one by text, then by all its columns, stays. Columns may have any name.
    """
    own = Own(docs, [])
    table, key = own.table, own[id]
    marks = materialize(near_duplicates(table, key, own[text], shingle, distance), "marks")
    ids = materialize(
        marks.groupBy(key).agg(F.count("*").alias("rows"), F.min("component_id").alias("least")), "ids"
    )
    single = (F.col("rows") == 1) & (F.col(key) == F.col("least"))
    # The kept ids grow with the documents: a broadcast would only ever suit small tables.
    named = table.join(ids.filter(single).select(key).hint("merge"), key, "left_semi").select(*own.columns)
    shared = ids.filter(F.col(key).isNull() | (F.col("rows") > 1)).select(F.col(key).alias("shared"))
    if shared.isEmpty():
        return own.restore(named)

    @F.arrow_udf("bigint")
    def compute(column: pa.Array) -> pa.Array:
        prints = np.array([fingerprint(x, shingle) for x in texts(column)], np.uint64)
        return pa.array(prints.view(np.int64))

    first = marks.filter(F.col(key).eqNullSafe(F.col("component_id"))).select(
        F.col("fingerprint").alias("print"), "component", F.col("component_id").alias("first")
    )
    unclear = materialize(table.join(shared, F.col(key).eqNullSafe(F.col("shared")), "left_semi"), "unclear")
    whole = F.struct(*own.columns)
    told = (
        unclear.withColumn("print", compute(F.col(own[text])))
        .join(first.distinct(), "print")
        .filter(F.col(key).eqNullSafe(F.col("first")))
        .groupBy("component")
        .agg(F.min_by(whole, F.struct(F.col(own[text]), F.to_json(whole))).alias("row"))
    )
    return own.restore(named.unionByName(told.select("row.*")))
