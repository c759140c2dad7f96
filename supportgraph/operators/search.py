"""Most similar tickets for tables of query vectors, exact or through an index.

No pair of a query and a ticket ever becomes a row. Equal vectors are searched once. Tasks multiply
blocks of vectors and hand on at most k rows per query, and the last step ranks those.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from supportgraph.llm.common import bound_batches
from supportgraph.operators.blocks import Tickets, TopK, unit_rows
from supportgraph.workspace import materialize

QUERY_ID, TICKET_ID, VECTOR = "query_id", "ticketId", "embedding"

# Rows of a stored block; bytes of the queries a task works on at once; about the most bytes of the
# tickets it holds and of the queries that stream past them; pairs that are worth a task, and the most
# of a task; bytes of the tickets that give the first floors.
BLOCK_ROWS = 256
GROUP_BYTES = 8 << 20
SLICE_BYTES = 48 << 20
STREAM_BYTES = 64 << 20
TASK_PAIRS = 1 << 26
MOST_PAIRS = 1 << 34
SEED_BYTES = 16 << 20
# Rows whose products with all planes are held at once.
CODE_ROWS = 2048

# Columns of this module: the number of a vector among the different ones; its hash.
_KIND, _HASH = "__kind", "__hash"


def _searchable(df: DataFrame, key: str, dim: int) -> DataFrame:
    """Key and vector of the rows that can be compared; zero vectors are left out in the tasks.
    ``vector_rejects`` tells which are not."""
    return df.select(key, VECTOR).where(
        F.col(key).isNotNull()
        & F.col(VECTOR).isNotNull()
        & (F.size(VECTOR) == dim)
        & ~F.exists(VECTOR, lambda x: x.isNull())
    )


def _hit_schema(queries: DataFrame, tickets: DataFrame) -> StructType:
    return StructType(
        [
            StructField(QUERY_ID, queries.schema[QUERY_ID].dataType),
            StructField(TICKET_ID, tickets.schema[TICKET_ID].dataType),
            StructField("score", DoubleType()),
        ]
    )


def best_per_query(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of each query with their ``rank``."""
    order = Window.partitionBy(QUERY_ID).orderBy(F.desc("score"), TICKET_ID)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(queries: DataFrame, tickets: DataFrame, dim: int) -> DataFrame:
    """Both tables as stored blocks of unit vectors: ``side`` (0: queries), ``block`` (a number),
    ``rows``, the ids of the side and the ``matrix``."""
    kinds = queries.schema[QUERY_ID].dataType, tickets.schema[TICKET_ID].dataType
    sides = [
        _searchable(table, key, dim).select(
            F.lit(side).alias("side"),
            *[(F.col(key) if i == side else F.lit(None).cast(kind)).alias(f"id{i}") for i, kind in enumerate(kinds)],
            F.col(VECTOR).cast("array<double>").alias(VECTOR),
        )
        for side, (table, key) in enumerate([(queries, QUERY_ID), (tickets, TICKET_ID)])
    ]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        number, current, ids, rows, types = 0, None, [], [], None

        def out() -> pa.RecordBatch:
            nonlocal number
            number += 1
            matrix = np.concatenate(rows)
            held = pa.concat_arrays(ids)
            offsets = pa.array([0, len(held)], pa.int32())
            lists = [
                pa.ListArray.from_arrays(offsets, held) if i == current else pa.nulls(1, pa.list_(kind))
                for i, kind in enumerate(types)
            ]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([current], pa.int32()), pa.array([part + number], pa.int64()),
                    pa.array([len(held)], pa.int64()), *lists, pa.array([matrix.tobytes()], pa.binary()),
                ],
                names=["side", "block", "rows", "ids0", "ids1", "matrix"],
            )

        for batch in batches:
            types = [batch.schema.field(i).type for i in (1, 2)]
            side = batch.column(0).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(side)) + 1), len(side)]
            for start, stop in zip(edges, edges[1:]):
                if start == stop:
                    continue
                if ids and side[start] != current:
                    yield out()
                    ids, rows = [], []
                current = int(side[start])
                own = batch.slice(start, stop - start)
                names, units = unit_rows(own.column(1 + current), own.column(3), dim)
                for at in range(0, len(units), BLOCK_ROWS):
                    ids.append(names.slice(at, BLOCK_ROWS))
                    rows.append(units[at : at + BLOCK_ROWS])
                    if sum(map(len, rows)) >= BLOCK_ROWS:
                        yield out()
                        ids, rows = [], []
        if ids:
            yield out()

    names = [f"ids{i} array<{kind.simpleString()}>" for i, kind in enumerate(kinds)]
    schema = f"side int, block bigint, rows bigint, {', '.join(names)}, matrix binary"
    return materialize(sides[0].unionByName(sides[1]).mapInArrow(pack, schema), "blocks")


def query_kinds(queries: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """The different vectors among the queries, numbered, and the number of each query's vector.

    Vectors are compared whole; their hash goes first because it sorts and splits well. Copies are
    made one in the map tasks, and the skew join splits a vector that very many queries have.
    """
    rows = _searchable(queries, QUERY_ID, dim).select(QUERY_ID, F.col(VECTOR).cast("array<double>").alias(VECTOR))
    hashed = rows.withColumn(_HASH, F.xxhash64(VECTOR))
    kinds = hashed.select(_HASH, VECTOR).distinct().withColumn(_KIND, F.monotonically_increasing_id())
    kinds = materialize(kinds, "kinds")
    asked = materialize(hashed.join(kinds, [_HASH, VECTOR]).select(QUERY_ID, _KIND), "asked")
    return kinds.select(F.col(_KIND).alias(QUERY_ID), VECTOR), asked


def best_of_copies(asked: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """The k best of each query from the hits of its vector's number, written to the shared folder."""
    own = asked.join(hits.withColumnRenamed(QUERY_ID, _KIND), _KIND).select(QUERY_ID, TICKET_ID, "score")
    return materialize(best_per_query(own, k), "hits")


def first_copies(rows: DataFrame, k: int) -> DataFrame:
    """The first k tickets by id of each vector: equal scores go by id, so no other copy can be among
    the k best. Spark applies the limit in the map tasks."""
    same = Window.partitionBy(F.xxhash64(VECTOR), VECTOR).orderBy(TICKET_ID)
    return rows.withColumn("__copy", F.row_number().over(same)).where(F.col("__copy") <= k).drop("__copy")


def _grid(queries: int, tickets: int, dim: int, cores: int) -> tuple[int, int]:
    """Groups of queries and slices of tickets: as square as memory allows, so that few copies are
    shuffled, and enough cells for all cores. A cell has a bounded number of pairs, so more of them
    make more tasks and not longer ones."""
    sizes = [max(n, 1) * dim * 8 for n in (queries, tickets)]
    pairs = queries * tickets
    cells = max(1, min(3 * cores, ceil(pairs / TASK_PAIRS)), ceil(pairs / MOST_PAIRS))
    slices = max(ceil(sizes[1] / SLICE_BYTES), min(cells, round(sqrt(cells * sizes[1] / sizes[0]))), 1)
    return max(ceil(sizes[0] / STREAM_BYTES), ceil(cells / slices)), slices


def _search(
    queries: DataFrame, tickets: DataFrame, k, dim, min_score, score_mode, group_bytes, planes=None
) -> DataFrame:
    """The k best of each query, written to the shared folder.

    Streams of query blocks and slices of ticket blocks make a grid; a shuffle brings the blocks of
    a cell into one task, which holds its tickets and works on one group of its queries at a time.
    Of a grid with several slices a few tickets are searched first: the last score that a query finds
    there is its floor in every cell, which would otherwise begin without one.
    """
    bound_batches(queries.sparkSession, "8m")
    kinds, asked = query_kinds(queries, dim)
    usable = _searchable(tickets, TICKET_ID, dim).select(TICKET_ID, F.col(VECTOR).cast("array<double>").alias(VECTOR))
    blocks = _blocks(kinds, first_copies(usable, k), dim)
    sizes = {r.side: r.n for r in blocks.groupBy("side").agg(F.sum("rows").alias("n")).collect()}
    sizes = [sizes.get(side, 0) for side in (0, 1)]
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    streams, slices = _grid(*sizes, dim, cores)

    def dealt(rows: DataFrame, streams: int, slices: int) -> DataFrame:
        """The blocks of each cell in a task, its tickets first."""
        stream, slice_ = F.pmod("block", F.lit(streams)), F.pmod("block", F.lit(slices))
        cells = F.when(
            F.col("side") == 0, F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda s: stream * slices + s)
        ).otherwise(F.transform(F.sequence(F.lit(0), F.lit(streams - 1)), lambda g: g * slices + slice_))
        shares = rows.withColumn("cell", F.explode(cells.cast("array<int>"))).repartitionById(streams * slices, "cell")
        return shares.sortWithinPartitions(F.desc("side")).select("side", "ids0", "ids1", "matrix", "floors", "block")

    normalized, group_rows = score_mode == "normalized", max(group_bytes // (8 * dim), 1)

    def codes_of(rows: np.ndarray) -> np.ndarray | None:
        if planes is None:
            return None
        codes = np.empty((len(rows), planes.bands), np.uint8 if planes.bits <= 8 else np.int32)
        for low in range(0, len(rows), CODE_ROWS):
            codes[low : low + CODE_ROWS] = planes.codes(rows[low : low + CODE_ROWS])
        return codes

    def scan(batches: Iterator[pa.RecordBatch], seed: bool = False) -> Iterator[pa.RecordBatch]:
        held, tickets, group, waiting, ticket_type = [], None, [], 0, None

        def answers() -> pa.RecordBatch:
            ids, rows = pa.concat_arrays([g[0] for g in group]), np.concatenate([g[1] for g in group])
            floors = np.concatenate([g[2] for g in group]) if group[0][2] is not None else None
            best = TopK(rows, k, min_score, normalized, codes_of(rows), floors)
            best.push_sorted(tickets)
            position, score, name = best.result()
            if seed:
                ends = np.cumsum([0, *(len(g[0]) for g in group)])
                return pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids),
                        pa.array([g[1].tobytes() for g in group], pa.binary()),
                        pa.array([best.floor[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary()),
                        pa.array([g[3] for g in group], pa.int64()),
                    ],
                    names=["ids0", "matrix", "floors", "block"],
                )
            return pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(position, pa.int64())), pa.array(name.tolist(), ticket_type),
                    pa.array(score, pa.float64()),
                ],
                names=[QUERY_ID, TICKET_ID, "score"],
            )

        for batch in batches:
            ticket_type = batch.schema.field(2).type.value_type
            for i in range(batch.num_rows):
                side = batch.column(0)[i].as_py()
                rows = np.frombuffer(batch.column(3)[i].as_buffer(), np.float64).reshape(-1, dim)
                ids = batch.column(1 + side)[i].values
                if side == 1:
                    # Copies: a view would keep the whole batch.
                    held.append((pa.array(ids.to_pylist(), ids.type), rows.copy()))
                    continue
                if tickets is None:  # tickets come first
                    if not held:
                        if not seed:
                            return
                        held = [(pa.array([], batch.schema.field(2).type.value_type), np.zeros((0, dim)))]
                    names, all_rows = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held])
                    held = None
                    tickets = Tickets(names, all_rows, codes_of(all_rows))
                    names = all_rows = None
                raw = batch.column(4)[i]
                known = np.frombuffer(raw.as_buffer(), np.float64) if raw.is_valid else None
                for low in range(0, len(rows), group_rows):
                    part = rows[low : low + group_rows]
                    if group and waiting + len(part) > group_rows:
                        yield answers()
                        group, waiting = [], 0
                    floors = known[low : low + group_rows].copy() if known is not None else None
                    names = pa.array(ids.slice(low, group_rows).to_pylist(), ids.type)
                    group.append((names, part.copy(), floors, batch.column(5)[i].as_py()))
                    waiting += len(part)
        if group:
            yield answers()

    blocks = blocks.withColumn("floors", F.lit(None).cast("binary"))
    # Blocks of tickets lie in no order, so any share of them will do.
    parts = max(slices, ceil(sizes[1] * dim * 8 / SEED_BYTES))
    if k and slices > 2:
        first = blocks.where((F.col("side") == 0) | (F.pmod(F.xxhash64("block"), F.lit(parts)) == 0))
        kept = f"ids0 array<{kinds.schema[QUERY_ID].dataType.simpleString()}>, matrix binary, floors binary, block bigint"
        many = max(ceil(sizes[0] * dim * 8 / STREAM_BYTES), min(3 * cores, ceil(sizes[0] / BLOCK_ROWS)))
        seeded = dealt(first, many, 1).mapInArrow(lambda batches: scan(batches, True), kept)
        seeded = materialize(
            seeded.select(
                F.lit(0).alias("side"), "block", F.size("ids0").cast("bigint").alias("rows"), "ids0",
                F.lit(None).cast(blocks.schema["ids1"].dataType).alias("ids1"), "matrix", "floors",
            ),
            "floors",
        )
        blocks = seeded.unionByName(blocks.where("side = 1"))
    schema = _hit_schema(kinds, tickets)
    # A ranking of each vector first: with several slices it leaves few rows for the join.
    found = dealt(blocks, streams, slices).mapInArrow(scan, schema)
    hits = materialize(best_per_query(found, k).drop("rank"), "kind-hits")
    return best_of_copies(asked, hits, k)


def exact_topk(
    queries: DataFrame,
    tickets: DataFrame,
    k: int,
    dim: int,
    min_score: float | None = None,
    score_mode: str = "normalized",
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """The k most similar tickets of every query: ``query_id, ticketId, score, rank``, written to
    the shared folder.

    ``queries`` has ``query_id`` and ``embedding``, ``tickets`` has ``ticketId`` and
    ``embedding``. A threshold is applied in the tasks: a ticket below it cannot push a ticket
    above it out of the k best, so this gives what filtering the k best afterwards gives.

    Equal query vectors are searched once, and of tickets with equal vectors only the first k by id
    can be among the best. Both tables are written out once as blocks of vectors. Queries are cut into
    streams, tickets into slices, and a shuffle brings each stream and slice together: no row passes
    the driver, nothing is broadcast, and all cells are worked on at once. A cell holds its slice,
    takes its queries in groups of about ``group_bytes`` past it and hands on k rows per query. The
    size of the groups has no part in what is shuffled.
    """
    return _search(queries, tickets, k, dim, min_score, score_mode, group_bytes)


# --- index and approximate search ---------------------------------------------------------------


@dataclass(frozen=True)
class Planes:
    """Signed projections that cut vectors into buckets: ``bands`` times ``bits`` planes.

    The sign of a plane in a dimension comes from the MD5 of their numbers, so any two runs, and SQL,
    agree. Vectors at an angle a share a band with probability (1 - a / 180°) ** bits: more bands
    find more, more bits look at fewer tickets.
    """

    dim: int
    bands: int = 40
    bits: int = 6

    def signs(self) -> np.ndarray:
        def sign(plane: int, dimension: int) -> int:
            return 1 if hashlib.md5(f"{plane}:{dimension}".encode()).hexdigest()[0] < "8" else -1

        return np.array(
            [[sign(p, d) for d in range(self.dim)] for p in range(self.bands * self.bits)], np.float64
        )

    def codes(self, rows: np.ndarray) -> np.ndarray:
        """The bucket of each row in each band."""
        if not hasattr(self, "_signs"):
            object.__setattr__(self, "_signs", self.signs())
        # Sums that should be zero may differ from it by the order of adding: they count as above.
        above = (rows @ self._signs.T >= -1e-9).reshape(len(rows), self.bands, self.bits)
        return above @ (1 << np.arange(self.bits))


@dataclass(frozen=True)
class TicketIndex:
    """The stored entries of an index (see ``build_index``) and the planes it was built with."""

    entries: DataFrame
    planes: Planes


def build_index(df: DataFrame, planes: Planes, key: str = TICKET_ID) -> DataFrame:
    """One row per vector and band, without the vector: ``band, bucket, key``."""
    kind = df.schema[key].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = unit_rows(batch.column(0), batch.column(1), planes.dim)
            codes = planes.codes(rows) if len(rows) else np.zeros((0, planes.bands), int)
            for band in range(planes.bands):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(rows), band, np.int32)),
                        pa.array(codes[:, band].astype(np.int32)),
                        ids,
                    ],
                    names=["band", "bucket", key],
                )

    schema = f"band int, bucket int, `{key}` {kind}"
    return _searchable(df, key, planes.dim).mapInArrow(hashed, schema)


def write_index(index: DataFrame, path: str) -> None:
    """Store an index by band, sorted by bucket: a lookup reads the bands and row groups it needs."""
    spread = index.repartitionByRange("band", "bucket", index.columns[2])
    ordered = spread.sortWithinPartitions("band", "bucket")
    ordered.write.mode("overwrite").partitionBy("band").parquet(path)


def add_to_index(df: DataFrame, planes: Planes, path: str, key: str = TICKET_ID) -> None:
    """Index new tickets beside those stored. Changed tickets need no removal: a ticket is compared
    by its present vector, and an entry under an old bucket only makes it a candidate there."""
    build_index(df, planes, key).write.mode("append").partitionBy("band").parquet(path)


def candidates(queries: DataFrame, index: TicketIndex) -> DataFrame:
    """The tickets that share a bucket with any query. The buckets wanted are broadcast: there are
    no more than ``bands << bits`` of them, whatever the number of queries."""
    wanted = build_index(queries, index.planes, QUERY_ID).select("band", "bucket").distinct()
    near = index.entries.join(F.broadcast(wanted), ["band", "bucket"], "left_semi")
    return near.select(TICKET_ID).distinct()


def approx_topk(
    queries: DataFrame,
    index: TicketIndex,
    tickets: DataFrame,
    k: int,
    min_score: float | None = None,
    score_mode: str = "normalized",
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """The k most similar tickets among those that share a band with the query.

    The index names the tickets in the queries' buckets; only their vectors are read, once, however
    many buckets they share. These are searched like in ``exact_topk``, except that a query meets
    only tickets that lie in one of its buckets. So a bucket may hold any share of the tickets and
    loses nothing.
    """
    planes = index.planes
    queries = materialize(_searchable(queries, QUERY_ID, planes.dim), "questions")
    near = materialize(tickets.join(candidates(queries, index), TICKET_ID, "left_semi").select(TICKET_ID, VECTOR), "near")
    return _search(queries, near, k, planes.dim, min_score, score_mode, group_bytes, planes)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Per query: how many of the exact hits were found, and their share."""
    truth = exact.select(QUERY_ID, TICKET_ID)
    hit = found.select(QUERY_ID, TICKET_ID, F.lit(1).alias("hit"))
    return (
        truth.join(hit, [QUERY_ID, TICKET_ID], "left")
        .groupBy(QUERY_ID)
        .agg(F.count("*").alias("expected"), F.count("hit").alias("found"))
        .withColumn("recall", F.col("found") / F.col("expected"))
    )
