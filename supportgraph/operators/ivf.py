"""Search in inverted lists: trained centroids, quantised residuals, exact scores of a short list.

The bucket index of ``search`` needs no training and agrees with SQL; this one is fitted to the
vectors and looks at few of them where they form clusters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supportgraph.functions.similarity import SCORE_DECIMALS
from supportgraph.llm.common import bound_batches
from supportgraph.operators.blocks import sortable, unit_rows
from supportgraph.operators.search import (
    GROUP_BYTES,
    QUERY_ID,
    TASK_PAIRS,
    TICKET_ID,
    VECTOR,
    _hit_schema,
    _searchable,
    best_of_copies,
    best_per_query,
    first_copies,
    query_kinds,
)
from supportgraph.workspace import materialize

#: Bytes of the sample the quantiser is fitted on, at most; lists, at most; values of a code.
SAMPLE_BYTES, MOST_LISTS, CODES = 64 << 20, 1 << 15, 256
#: Bytes of the vectors of one list that are kept together: a larger list is cut into segments.
SEGMENT_BYTES = 32 << 20
#: Bytes of the vectors of the neighbouring lists that a task holds, unless one segment has more.
SHELF_BYTES = 64 << 20
#: Products that are made at once, which stay in the cache of a core; queries, and pairs of a query and
#: a cell, that a task works on at once.
TILE, QUERIES_AT_ONCE, PAIRS_AT_ONCE = 1 << 18, 1 << 14, 1 << 21
#: Pairs of a row and a centre beyond which a round of training is dealt to tasks.
DRIVER_PAIRS = 1 << 25


def kmeans(
    rows: np.ndarray, k: int, unit: bool, seed: int, rounds: int = 12, find: Callable[[np.ndarray], np.ndarray] | None = None
) -> np.ndarray:
    """Lloyd's algorithm; ``unit`` keeps the centres at length one. A centre without rows moves to
    the row that is farthest from its own. ``find``: gives the nearest centre of each row, if not
    ``nearest``."""
    random = np.random.default_rng(seed)
    k = min(k, len(rows))
    centres = rows[random.choice(len(rows), k, replace=False)].copy()
    for _ in range(rounds):
        near = find(centres) if find else nearest(rows, centres)
        counts = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(near[order]) != 0])
        centres[near[order][starts]] = np.add.reduceat(rows[order], starts, axis=0) / counts[near[order][starts], None]
        empty = np.flatnonzero(counts == 0)
        if len(empty):
            away = ((rows - centres[near]) ** 2).sum(axis=1)
            centres[empty] = rows[np.argsort(-away, kind="stable")[: len(empty)]]
        if unit:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row. Products in single precision find it; where another centre is as
    near within their error, products in double precision tell."""
    out, half = np.empty(len(rows), np.int64), (centres**2).sum(axis=1) / 2
    single, single_half = np.ascontiguousarray(centres.T, np.float32), half.astype(np.float32)
    error, longest = (rows.shape[1] + 4) * 2.0**-23, np.sqrt(2 * half.max(initial=0))
    step = max(1, TILE // max(len(centres), 1))
    for low in range(0, len(rows), step):
        part = rows[low : low + step]
        close = part.astype(np.float32) @ single
        close -= single_half
        own = close.argmax(axis=1)
        least = close[np.arange(len(part)), own] - error * longest * (np.linalg.norm(part, axis=1) + longest)
        unsure = np.flatnonzero(np.count_nonzero(close >= least[:, None].astype(np.float32), axis=1) != 1)
        own[unsure] = (part[unsure] @ centres.T - half).argmax(axis=1)
        out[low : low + step] = own
    return out


def _nearest_in_tasks(spark: SparkSession, rows: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """``nearest`` of the rows, which a task for each core works on."""
    context = spark.sparkContext
    shared, many = context.broadcast(rows), context.defaultParallelism
    edges = np.linspace(0, len(rows), many + 1).astype(int)

    def find(centres: np.ndarray) -> np.ndarray:
        parts = context.parallelize(range(many), many)
        return np.concatenate(parts.map(lambda i: nearest(shared.value[edges[i] : edges[i + 1]], centres)).collect())

    return find


@dataclass(frozen=True)
class Quantizer:
    """``centroids``: a unit row per list. ``books``: for each part of the dimensions the values that
    a code stands for, which approximate what is left of a vector without its centroid."""

    centroids: np.ndarray
    books: np.ndarray  # parts x codes x width

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    def _parts(self, rows: np.ndarray) -> np.ndarray:
        """Rows cut into parts of equal width, filled up with zeros."""
        parts, _, width = self.books.shape
        return np.pad(rows, ((0, 0), (0, parts * width - rows.shape[1]))).reshape(-1, parts, width)

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each unit row and the codes of its residual."""
        lists = nearest(rows, self.centroids)
        left = self._parts(rows - self.centroids[lists])
        codes = [nearest(left[:, j], book) for j, book in enumerate(self.books)]
        return lists, np.stack(codes, axis=1).astype(np.uint8)

    def decode(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What the list and the codes of each row say of it, in single precision."""
        left = np.concatenate([book[codes[:, j]] for j, book in enumerate(self.books)], axis=1)[:, : self.dim]
        return (self.centroids[lists] + left).astype(np.float32)

    def probe(self, rows: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` lists nearest to each unit row."""
        lists = len(self.centroids)
        probes = min(probes, lists)
        out, step = np.empty((len(rows), probes), np.int64), max(1, TILE // lists)
        for low in range(0, len(rows) if probes else 0, step):
            away = rows[low : low + step] @ -self.centroids.T
            out[low : low + step] = np.argpartition(away, probes - 1, axis=1)[:, :probes]
        return out

    def tables(self, rows: np.ndarray) -> np.ndarray:
        """Per row, part and code the product of the row's part with the code's value."""
        products = self._parts(rows).transpose(1, 0, 2) @ self.books.transpose(0, 2, 1)
        return products.transpose(1, 0, 2).astype(np.float32)


def train(
    vectors: DataFrame, dim: int, lists: int | None = None, parts: int | None = None, key: str = TICKET_ID, seed: int = 5
) -> Quantizer:
    """A quantiser fitted on a sample of the vectors, taken by a hash of the key, so reruns agree.

    The sample has SAMPLE_BYTES at most; everything else is the same for all rows. Tasks find the
    centres of a large sample's rows and fit the codes; the result is the same. ``lists``: four
    times the root of their number if not given. ``parts``: codes of a vector, one for eight
    dimensions if not given.
    """
    usable = _searchable(vectors, key, dim)
    total = usable.count()
    wanted = SAMPLE_BYTES // (8 * dim)
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)
    sample = usable.where(place < wanted / max(total, 1)).orderBy(F.xxhash64(key), key).limit(wanted).toArrow()
    _, rows = unit_rows(sample.column(0), sample.column(1), dim)
    parts = parts or max(1, dim // 8)
    width = ceil(dim / parts)
    if not len(rows):
        return Quantizer(np.zeros((1, dim)), np.zeros((parts, 1, width)))
    lists = min(lists or ceil(4 * sqrt(total)), MOST_LISTS, max(1, len(rows) // 8))
    spark = vectors.sparkSession
    find = _nearest_in_tasks(spark, rows) if len(rows) * lists > DRIVER_PAIRS else None
    centroids = kmeans(rows, lists, True, seed, find=find)
    near = find(centroids) if find else nearest(rows, centroids)
    left = np.pad(rows - centroids[near], ((0, 0), (0, parts * width - dim)))

    def book(j: int, left: np.ndarray) -> np.ndarray:
        return kmeans(left[:, j * width : (j + 1) * width], CODES, False, seed + j)

    if find is None:
        books = [book(j, left) for j in range(parts)]
    else:
        shared = spark.sparkContext.broadcast(left)
        books = spark.sparkContext.parallelize(range(parts), parts).map(lambda j: book(j, shared.value)).collect()
    return Quantizer(centroids, np.stack(books))


@dataclass(frozen=True)
class ListIndex:
    """``entries``: list, key, code and vector of every row, sorted by list; and their quantiser."""

    entries: DataFrame
    quantizer: Quantizer


def build_lists(vectors: DataFrame, quantizer: Quantizer, key: str = TICKET_ID) -> DataFrame:
    """Every searchable row with its list and code: ``list, key, code, embedding``."""
    shared = vectors.sparkSession.sparkContext.broadcast(quantizer)
    kind = vectors.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            ids, rows = unit_rows(batch.column(0), batch.column(1), own.dim)
            if not len(rows):
                continue
            lists, codes = own.encode(rows)
            offsets = pa.array(np.arange(len(rows) + 1) * own.dim, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(lists.astype(np.int32)), ids,
                    pa.FixedSizeBinaryArray.from_buffers(
                        pa.binary(codes.shape[1]), len(rows), [None, pa.py_buffer(codes.tobytes())]
                    ).cast(pa.binary()),
                    pa.ListArray.from_arrays(offsets, pa.array(rows.ravel())),
                ],
                names=["list", key, "code", VECTOR],
            )

    schema = f"list int, `{key}` {kind}, code binary, {VECTOR} array<double>"
    return _searchable(vectors, key, quantizer.dim).mapInArrow(encode, schema)


def write_quantizer(spark: SparkSession, quantizer: Quantizer, path: str) -> None:
    row = (*quantizer.centroids.shape, *quantizer.books.shape, quantizer.centroids.tobytes(), quantizer.books.tobytes())
    names = "lists int, dim int, parts int, codes int, width int, centroids binary, books binary"
    spark.createDataFrame([row], names).coalesce(1).write.parquet(path)


def read_quantizer(spark: SparkSession, path: str) -> Quantizer:
    r = spark.read.parquet(path).first()
    centroids = np.frombuffer(r.centroids).reshape(r.lists, r.dim)
    return Quantizer(centroids, np.frombuffer(r.books).reshape(r.parts, r.codes, r.width))


def write_lists(entries: DataFrame, quantizer: Quantizer, path: str) -> None:
    """Store an index: entries sorted by list, so that a lookup reads the row groups of its lists, and
    the quantiser in one row."""
    key = entries.columns[1]
    entries.repartitionByRange("list", key).sortWithinPartitions("list").write.parquet(f"{path}/entries")
    write_quantizer(entries.sparkSession, quantizer, f"{path}/quantizer")


def read_lists(spark: SparkSession, path: str) -> ListIndex:
    return ListIndex(spark.read.parquet(f"{path}/entries"), read_quantizer(spark, f"{path}/quantizer"))


def _packed(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The bytes of the rows of an array from each edge to the next: Spark handles them as one value,
    a list number by number."""
    raw = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * raw.strides[0]).astype(np.int32)), pa.py_buffer(raw)])


def _unpacked(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """All numbers of a column that ``_packed`` made."""
    raw = b"".join(memoryview(part.buffers()[2])[slice(*_ends(part))] for part in column.chunks if len(part))
    return np.frombuffer(raw, kind)


def _ends(part: pa.Array) -> tuple[int, int]:
    """Where the bytes of a binary array begin and end in its buffer."""
    offsets = np.frombuffer(part.buffers()[1], np.int32)
    return int(offsets[part.offset]), int(offsets[part.offset + len(part)])


def _sizes(entries: DataFrame, lists: int) -> np.ndarray:
    """Rows of each list; there are no more lists than MOST_LISTS."""
    sizes = np.zeros(lists, np.int64)
    for r in entries.groupBy("list").agg(F.count("*").alias("n")).collect():
        sizes[r["list"]] = r["n"]
    return sizes


def _probes(lists: int, probes: int | None) -> int:
    return probes if probes is not None else max(1, ceil(lists / 25))


def looked_at(queries: DataFrame, index: ListIndex, probes: int | None = None) -> DataFrame:
    """Per query, the share of the indexed tickets that lie in the lists it looks into."""
    own = index.quantizer
    sizes, probes = _sizes(index.entries, len(own.centroids)), _probes(len(own.centroids), probes)
    shared = queries.sparkSession.sparkContext.broadcast((own, sizes))
    kind = queries.schema[QUERY_ID].dataType.simpleString()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sizes = shared.value
        for batch in batches:
            ids, rows = unit_rows(batch.column(0), batch.column(1), own.dim)
            share = sizes[own.probe(rows, probes)].sum(axis=1) / max(sizes.sum(), 1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(share, pa.float64())], names=[QUERY_ID, "share"])

    return _searchable(queries, QUERY_ID, own.dim).mapInArrow(look, f"{QUERY_ID} {kind}, share double")


def shelves(centres: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """A shelf for every cell, with ``most`` of their sizes on one: cells are halved along the axis on
    which they lie farthest apart, so neighbours stay together."""
    shelf, waiting, number = np.zeros(len(centres), np.int32), [np.arange(len(centres))], 0
    while waiting:
        cells = waiting.pop()
        if len(cells) <= 1 or sizes[cells].sum() <= most:
            shelf[cells] = number
            number += 1
            continue
        away = centres[cells] - centres[cells].mean(axis=0)
        order = np.argsort(away @ np.linalg.eigh(away.T @ away)[1][:, -1], kind="stable")
        filled = np.cumsum(sizes[cells[order]])
        half = min(int(np.searchsorted(filled, filled[-1] / 2)) + 1, len(cells) - 1)
        waiting += [cells[order[half:]], cells[order[:half]]]
    return shelf


class Shelf:
    """The tickets of some cells, in a task: vectors and codes by cell, names by their order."""

    def __init__(self, cells: np.ndarray, lists: np.ndarray, ids: pa.Array, rows: np.ndarray, codes: np.ndarray, own: Quantizer):
        names, by_cell = sortable(ids), np.argsort(cells, kind="stable")
        order = np.argsort(names, kind="stable")
        self.names, places = names[order], np.empty(len(names), np.int64)
        places[order] = np.arange(len(names))
        self.rows, self.places = rows[by_cell], places[by_cell]
        self.single = self.rows.astype(np.float32)
        self.cells, starts = np.unique(cells[by_cell], return_index=True)
        self.edges = np.r_[starts, len(cells)]
        self.centres = own.centroids[lists[by_cell][starts]]
        away = np.linalg.norm(self.rows - np.repeat(self.centres, np.diff(self.edges), axis=0), axis=1)
        self.radius = np.maximum.reduceat(away, starts)
        self.decoded = own.decode(lists[by_cell], codes[by_cell])

    def best(
        self, rows: np.ndarray, who: np.ndarray, cells: np.ndarray, k: int, short: int, min_score: float | None, normalized: bool
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position, score and ticket of the k best of each query row; query ``who[i]`` looks into
        ``cells[i]``, by query. Of a cell, only the ``short`` tickets that rank first by code count.

        Each query begins with its nearest cell, then come three more and then the rest; in each turn
        a cell is looked at by all its queries at once. No ticket is nearer to a query than the distance
        of a cell's centre less the cell's radius, so later cells that cannot reach its k best are
        passed over. Products in single precision, with a margin above their error, tell which of the
        others need a short list.
        """
        at = np.searchsorted(self.cells, cells)
        known = (at < len(self.cells)) & (self.cells[np.minimum(at, len(self.cells) - 1)] == cells)
        who, at = who[known], at[known].astype(np.int32)
        gap, squares = np.empty(len(who)), 1 + (self.centres**2).sum(axis=1)
        step = max(1, TILE // len(self.cells))
        for low in range(0, len(rows), step):
            some = slice(*np.searchsorted(who, (low, low + step)))
            away = squares - 2 * (rows[low : low + step] @ self.centres.T)
            gap[some] = np.sqrt(np.maximum(away[who[some] - low, at[some]], 0))
        reach = 1 - np.maximum(gap - self.radius[at], 0) ** 2 / 2
        order = np.lexsort((gap, who))
        turn, found = np.empty(len(who), np.int64), _Best(rows, k, min_score, normalized)
        turn[order] = np.arange(len(who)) - np.searchsorted(who, who)
        for low, high in ((0, 1), (1, 4), (4, len(self.cells))):
            some = np.flatnonzero((turn >= low) & (turn < high))
            some = some[reach[some] >= found.least[who[some]]]
            some = some[np.argsort(at[some], kind="stable")]
            for part in np.split(some, np.flatnonzero(np.diff(at[some])) + 1) if len(some) else []:
                self._look(at[part[0]], who[part][reach[part] >= found.least[who[part]]], found, short)
            found.settle()
        return found.result(self.names)

    def _look(self, cell: int, who: np.ndarray, found: _Best, short: int) -> None:
        """Add the best of a cell for the queries ``who``."""
        span = slice(self.edges[cell], self.edges[cell + 1])
        tickets, step = self.single[span].T, max(1, TILE // (span.stop - span.start))
        for low in range(0, len(who), step):
            some = who[low : low + step]
            queries, least = found.single[some], found.least[some].astype(np.float32)
            products = queries @ tickets
            part = np.flatnonzero(products.max(axis=1) >= least)
            if not len(part):
                continue
            near = products[part] >= least[part][:, None]
            if near.shape[1] > short:
                near &= self._short_list(span, queries[part], short)
            row, ticket = np.nonzero(near)
            found.add(some[part][row], span.start + ticket, self)

    def _short_list(self, span: slice, queries: np.ndarray, short: int) -> np.ndarray:
        """Which tickets of a cell are the first ``short`` of each query by their codes, with all that
        tie with the last of them: equal codes may give products that differ by their error."""
        rough = queries @ self.decoded[span].T
        least = np.partition(rough, -short, axis=1)[:, -short] - (queries.shape[1] + 4) * 2.0**-22
        return rough >= least[:, None].astype(np.float32)


class _Best:
    """The k best tickets so far of some queries, the least cosine that can still be among them, and
    pairs that wait to be ranked."""

    def __init__(self, rows: np.ndarray, k: int, min_score: float | None, normalized: bool):
        self.rows, self.single, self.normalized = rows, rows.astype(np.float32), normalized
        self.scores, self.places = np.full((len(rows), k), -np.inf), np.zeros((len(rows), k), np.int64)
        self.floor = np.full(len(rows), -np.inf if min_score is None else min_score)
        self.waiting, self.held = [], 0
        # A sum of n products of single precision errs by less than (n + 2) / 2**24 for unit rows.
        self.margin = (rows.shape[1] + 4) * 2.0**-23 + 10.0**-SCORE_DECIMALS
        self.least = self._cosine(self.floor)

    def _cosine(self, floor: np.ndarray) -> np.ndarray:
        return (2 * floor - 1 if self.normalized else floor) - self.margin

    def add(self, who: np.ndarray, rows: np.ndarray, shelf: Shelf) -> None:
        """Pairs of a query and a row of the shelf. They wait until there are as many as queries."""
        cosine = np.einsum("ij,ij->i", self.rows[who], shelf.rows[rows])
        scores = np.round((1 + cosine) / 2 if self.normalized else cosine, SCORE_DECIMALS)
        good = scores >= self.floor[who]
        self.waiting.append((who[good], scores[good], shelf.places[rows[good]]))
        self.held += len(self.waiting[-1][0])
        if self.held > len(self.rows):
            self.settle()

    def settle(self) -> None:
        """The k best of each query from what waits and what it has."""
        if not self.held:
            return
        who, scores, places = (np.concatenate(column) for column in zip(*self.waiting))
        self.waiting, self.held = [], 0
        changed, k = np.unique(who), self.scores.shape[1]
        held = self.scores[changed] > -np.inf
        who = np.r_[np.repeat(changed, k)[held.ravel()], who]
        scores, places = np.r_[self.scores[changed][held], scores], np.r_[self.places[changed][held], places]
        order = np.lexsort((places, -scores, who))
        who, scores, places = who[order], scores[order], places[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        best = rank < k
        self.scores[who[best], rank[best]], self.places[who[best], rank[best]] = scores[best], places[best]
        self.floor[changed] = np.maximum(self.floor[changed], self.scores[changed, k - 1])
        self.least[changed] = self._cosine(self.floor[changed])

    def result(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        who, rank = np.nonzero(self.scores > -np.inf)
        return who, self.scores[who, rank], names[self.places[who, rank]]


def ivf_topk(
    queries: DataFrame,
    index: ListIndex,
    k: int,
    min_score: float | None = None,
    score_mode: str = "normalized",
    probes: int | None = None,
    refine: int = 8,
    tickets: DataFrame | None = None,
) -> DataFrame:
    """The k most similar tickets in the lists nearest to each query: ``query_id, ticketId, score,
    rank``, written to the shared folder.

    A query looks into ``probes`` lists, one in 25 if not given. In each, products with what the codes
    stand for rank all tickets, and the ``refine * k`` best, with those that tie with the last of them,
    are scored by their vectors, like in ``exact_topk``; so scores are exact, and what is missed are tickets in other lists or beyond
    the short list. ``tickets``, if given, are the only ones that count. Equal query vectors are
    searched once, and of equal tickets the first k by id count.

    Neighbouring lists share a shelf of SHELF_BYTES. A list above SEGMENT_BYTES is cut into segments,
    so one that holds any share of the tickets is spread over shelves. Queries and shelves meet by a
    shuffle: a query goes to each shelf once, whatever the number of its lists there, and a shelf that
    many look into goes to several tasks. A task holds its shelf, takes groups of queries past it and
    hands on k rows per query.
    """
    own, dim = index.quantizer, index.quantizer.dim
    entries, spark = index.entries, queries.sparkSession
    schema = _hit_schema(queries, entries)
    if k == 0:
        return materialize(best_per_query(spark.createDataFrame([], schema), 0), "hits")
    bound_batches(spark, "8m")
    if tickets is not None:
        entries = entries.join(tickets.select(TICKET_ID).distinct(), TICKET_ID, "left_semi").select(*entries.columns)
    entries = materialize(first_copies(entries, k), "entries")
    n_lists, probes = len(own.centroids), _probes(len(own.centroids), probes)
    sizes = _sizes(entries, n_lists)
    segments = np.maximum(-(-sizes * dim * 8 // SEGMENT_BYTES), 1)
    first = np.cumsum(segments) - segments
    share = np.repeat(sizes / segments, segments)  # tickets of a cell, about
    shelf_of = shelves(np.repeat(own.centroids, segments, axis=0), share * dim * 8, SHELF_BYTES)
    shared = spark.sparkContext.broadcast((own, segments, first, sizes, share, shelf_of))
    kinds, asked = query_kinds(queries, dim)
    ticket_kind = entries.schema[TICKET_ID].dataType.simpleString()

    def wanted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query row and a cell it looks into, by query and shelf."""
        own, segments, first, sizes, _, shelf_of = shared.value
        near = own.probe(rows, probes)
        who, lists = np.repeat(np.arange(len(rows)), near.shape[1]), near.ravel()
        who, lists = who[sizes[lists] > 0], lists[sizes[lists] > 0]
        times = segments[lists]
        cells = np.repeat(first[lists] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        who = np.repeat(who, times)
        order = np.lexsort((shelf_of[cells], who))
        return who[order], cells[order]

    def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
        for batch in batches:
            ids, rows = unit_rows(batch.column(0), batch.column(1), shared.value[0].dim)
            for low in range(0, len(rows), 1024):
                yield ids.slice(low, 1024), rows[low : low + 1024]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, shelf_of = shared.value[4:]
        pairs = np.zeros(shelf_of.max() + 1)
        for _, rows in parts_of(batches):
            _, cells = wanted(rows)
            pairs += np.bincount(shelf_of[cells], share[cells], minlength=len(pairs))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pairs))), pa.array(pairs)], names=["shelf", "pairs"])

    # A row per shelf. A shelf with many pairs goes to several tasks, which share its queries.
    weights = kinds.mapInArrow(weigh, "shelf long, pairs double").groupBy("shelf").agg(F.sum("pairs").alias("pairs"))
    pairs = np.zeros(int(shelf_of.max()) + 1)
    for r in weights.collect():
        pairs[r["shelf"]] = r["pairs"]
    cores = spark.sparkContext.defaultParallelism
    streams = np.maximum(np.ceil(pairs / max(TASK_PAIRS, pairs.sum() / (4 * cores))), 1).astype(int)
    starts = np.cumsum(streams) - streams

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf_of = shared.value[5]
        for ids, rows in parts_of(batches):
            who, cells = wanted(rows)
            shelf = shelf_of[cells]
            edges = np.flatnonzero(np.r_[True, (np.diff(who) != 0) | (np.diff(shelf) != 0)][: len(who)])
            one, shelf = who[edges], shelf[edges]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(starts[shelf] + sortable(ids.take(pa.array(one))) % streams[shelf], pa.int32()),
                    pa.array(cells[edges], pa.int32()), ids.take(pa.array(one)),
                    _packed(cells.astype(np.int32), np.r_[edges, len(cells)]), _packed(rows[one], np.arange(len(one) + 1)),
                ],
                names=["task", "cell", QUERY_ID, "cells", VECTOR],
            )

    sent = kinds.mapInArrow(ask, f"task int, cell int, {QUERY_ID} bigint, cells binary, {VECTOR} binary")
    places = spark.createDataFrame(
        [(i, int(f), int(s)) for i, (f, s) in enumerate(zip(first, segments))], "list int, first int, segments int"
    )  # a row per list, MOST_LISTS at most
    tasks = spark.createDataFrame(
        [(i, int(starts[s]), int(streams[s])) for i, s in enumerate(shelf_of)], "cell int, start int, streams int"
    )
    cell = F.col("first") + F.pmod(F.xxhash64(TICKET_ID), F.col("segments")).cast("int")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = pa.array(np.arange(batch.num_rows))
            place, rows = unit_rows(place, batch.column(3), shared.value[0].dim)
            columns = [batch.column(i).take(place) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, _packed(rows, np.arange(len(rows) + 1))], names=["list", TICKET_ID, "code", VECTOR])

    rows = entries.select("list", TICKET_ID, "code", VECTOR).mapInArrow(
        pack, f"list int, {TICKET_ID} {ticket_kind}, code binary, {VECTOR} binary"
    )
    stored = rows.join(F.broadcast(places), "list").withColumn("cell", cell).join(F.broadcast(tasks), "cell").select(
        F.explode(F.sequence(F.col("start"), F.col("start") + F.col("streams") - 1)).alias("task"), F.lit(0).alias("side"),
        "cell", "list", F.lit(None).cast("bigint").alias(QUERY_ID), F.lit(None).cast("binary").alias("cells"),
        TICKET_ID, "code", VECTOR,
    )
    coming = sent.select(
        "task", F.lit(1).alias("side"), "cell", F.lit(None).cast("int").alias("list"), QUERY_ID, "cells",
        F.lit(None).cast(ticket_kind).alias(TICKET_ID), F.lit(None).cast("binary").alias("code"), VECTOR,
    )
    together = stored.unionByName(coming).repartitionById(int(streams.sum()), "task").sortWithinPartitions("side", "cell").drop("task")
    normalized = score_mode == "normalized"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, shelf, group, waiting, pairs, group_rows = shared.value[0], [], None, [], 0, 0, 0

        def answers() -> pa.RecordBatch:
            table = pa.Table.from_batches(group)
            ids, rows = table.column(3).combine_chunks(), _unpacked(table.column(7), np.float64).reshape(-1, own.dim)
            times = pc.binary_length(table.column(4)).to_numpy() // 4
            who, cells = np.repeat(np.arange(len(rows)), times), _unpacked(table.column(4), np.int32)
            who, scores, names = shelf.best(rows, who, cells, k, refine * k, min_score, normalized)
            kind = table.schema.field(5).type
            return pa.RecordBatch.from_arrays(
                [ids.take(pa.array(who)), pa.array(names.tolist(), kind), pa.array(scores, pa.float64())],
                names=[QUERY_ID, TICKET_ID, "score"],
            )

        for batch in batches:
            tickets = int(np.searchsorted(batch.column(0).to_numpy(), 1))
            if tickets:  # they come before the queries
                held.append(batch.slice(0, tickets))
            if tickets == batch.num_rows:
                continue
            if shelf is None:
                if not held:
                    return
                table = pa.Table.from_batches(held)
                ids, rows = table.column(5).combine_chunks(), _unpacked(table.column(7), np.float64).reshape(-1, own.dim)
                codes = _unpacked(table.column(6), np.uint8).reshape(len(ids), -1)
                shelf = Shelf(table.column(1).to_numpy(), table.column(2).to_numpy(), ids, rows, codes, own)
                held = table = ids = rows = codes = None
                group_rows = max(min(GROUP_BYTES // (8 * own.dim), QUERIES_AT_ONCE), 1)
            for low in range(tickets, batch.num_rows, group_rows):
                part = batch.slice(low, group_rows)
                more = pc.sum(pc.binary_length(part.column(4))).as_py() // 4
                if group and (waiting + part.num_rows > group_rows or pairs + more > PAIRS_AT_ONCE):
                    yield answers()
                    group, waiting, pairs = [], 0, 0
                group.append(part)
                waiting, pairs = waiting + part.num_rows, pairs + more
        if group:
            yield answers()

    found = best_per_query(together.mapInArrow(score, _hit_schema(kinds, entries)), k).drop("rank")
    return best_of_copies(asked, materialize(found, "kind-hits"), k)
