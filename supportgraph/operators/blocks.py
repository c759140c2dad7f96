"""Top-k over one block of queries and any number of ticket blocks: the part inside a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from supportgraph.functions.similarity import SCORE_DECIMALS

# A tile of scores stays in the cache of a core; a fuller tile than one in DENSE is scored whole.
QUERY_STEP = 512
TICKET_STEP = 1024
FIRST_STEP = 64
DENSE = 32


def unit_rows(ids: pa.Array, vectors: pa.Array, dim: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and unit-length rows; vectors without a length are left out."""
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    rows = flat.reshape(-1, dim)
    lengths = np.linalg.norm(rows, axis=1)
    ok = np.isfinite(lengths) & (lengths > 0)
    if not ok.all():
        ids, rows, lengths = ids.filter(pa.array(ok)), rows[ok], lengths[ok]
    return ids, rows / lengths[:, None]


def sortable(ids: pa.Array) -> np.ndarray:
    values = ids.to_numpy(zero_copy_only=False)
    return values.astype(str) if values.dtype == object else values


class Tickets:
    """Ticket vectors in the order of their ids, ready for any number of ``TopK``."""

    def __init__(self, ids: pa.Array, rows: np.ndarray, codes: np.ndarray | None = None):
        names = sortable(ids)
        order = np.argsort(names, kind="stable")
        self.names, self.rows = names[order], rows[order]
        self.single = self.rows.astype(np.float32)
        self.codes = codes[order] if codes is not None else None


class TopK:
    """The k best tickets of every query, over any number of ticket blocks.

    Equal scores are ordered by ticket id, so the result does not depend on the order of blocks.
    With ``codes``, rows of numbers, a query only meets tickets that have the same number in the
    same place. ``floors`` are scores that k tickets of each query are known to reach. No more than
    ``pending_most`` rows are ever held, whatever the number of tickets.

    Tiles of products in single precision tell which pairs may reach a query's floor, with a margin
    above their error; only those are compared by code and scored in double precision.
    """

    def __init__(
        self,
        queries: np.ndarray,
        k: int,
        min_score: float | None,
        normalized: bool,
        codes: np.ndarray | None = None,
        floors: np.ndarray | None = None,
    ):
        self.queries = queries
        self.single = queries.astype(np.float32)
        self.codes = codes
        self.k = k
        self.normalized = normalized
        # Lowest score that can still enter the result of each query.
        self.floor = np.full(len(queries), -np.inf if min_score is None else min_score)
        self.seeded = floors is not None
        if floors is not None:
            # In another tile the same pair may be rounded to the other side.
            self.floor = np.maximum(self.floor, floors - 2 * 10.0**-SCORE_DECIMALS)
        # A sum of n products of single precision errs by less than (n + 2) / 2**24 for unit rows.
        self.margin = (queries.shape[1] + 4) * 2.0**-23 + 10.0**-SCORE_DECIMALS
        # What is held of the queries of each tile; their numbers.
        self.pending: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        self.rows_of: dict[int, int] = {}
        self.pending_rows = 0
        self.pending_most = 2 * k * len(queries) + QUERY_STEP + QUERY_STEP * k

    def push(self, ids: pa.Array, rows: np.ndarray, codes: np.ndarray | None = None) -> None:
        if self.k and len(rows):
            self.push_sorted(Tickets(ids, rows, codes))

    def push_sorted(self, tickets: Tickets) -> None:
        if self.k == 0:
            return
        for start in range(0, len(self.queries), QUERY_STEP):
            most = 2 * self.k * len(self.queries[start : start + QUERY_STEP])
            # Floors rise most with the first tickets: these come in small tiles.
            known = start in self.pending or self.seeded
            at, step = 0, TICKET_STEP if known else FIRST_STEP
            while at < len(tickets.names):
                self._score(start, at, at + step, tickets)
                if self.rows_of.get(start, 0) > most:
                    self._compact(start)
                at, step = at + step, min(2 * step, TICKET_STEP)

    def _rounded(self, cosine: np.ndarray) -> np.ndarray:
        return np.round((1 + cosine) / 2 if self.normalized else cosine, SCORE_DECIMALS)

    def _score(self, start: int, at: int, end: int, tickets: Tickets) -> None:
        """Add the best of a tile, at most k per query."""
        q, t = slice(start, start + QUERY_STEP), slice(at, end)
        floor = self.floor[q]
        least = (2 * floor - 1 if self.normalized else floor) - self.margin
        products, least = self.single[q] @ tickets.single[t].T, least.astype(np.float32)
        # In most tiles few queries have such a pair.
        some = np.flatnonzero(products.max(axis=1) >= least)
        if not len(some):
            return
        found = np.flatnonzero(products[some] >= least[some, None])
        row, column = np.divmod(found, products.shape[1])
        row, whole = some[row], len(found) * DENSE > products.size
        if tickets.codes is not None:
            meet = np.zeros(len(row), bool)
            for low in range(0, len(row), 1 << 16):
                part = slice(low, low + (1 << 16))
                meet[part] = (self.codes[q][row[part]] == tickets.codes[t][column[part]]).any(axis=1)
            row, column = row[meet], column[meet]
        if whole:
            cosine = (self.queries[q] @ tickets.rows[t].T)[row, column]
        else:
            cosine = np.einsum("ij,ij->i", self.queries[q][row], tickets.rows[t][column])
        scores = self._rounded(cosine)
        good = scores >= floor[row]
        row, column, scores = row[good], column[good], scores[good]
        if not len(row):
            return
        counts = np.bincount(row, minlength=len(floor))
        if counts.max() >= self.k:  # no more than k of a query; of equal ones the first by name
            order = np.lexsort((column, -scores, row))
            row, column, scores = row[order], column[order], scores[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            full = place == self.k - 1
            np.maximum.at(floor, row[full], scores[full])
            few = place < self.k
            row, column, scores = row[few], column[few], scores[few]
        self._hold(start, [*self.pending.get(start, []), (row + start, scores, tickets.names[t][column])])

    def _hold(self, start: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.pending[start], before = parts, self.rows_of.get(start, 0)
        self.rows_of[start] = sum(len(part[0]) for part in parts)
        self.pending_rows += self.rows_of[start] - before

    def _compact(self, start: int) -> None:
        query, score, name = (np.concatenate(parts) for parts in zip(*self.pending[start]))
        order = np.lexsort((name, -score, query))
        query, score, name = query[order], score[order], name[order]
        place = np.arange(len(query)) - np.searchsorted(query, query, side="left")
        keep = place < self.k
        full = place == self.k - 1
        self.floor[query[full]] = np.maximum(self.floor[query[full]], score[full])
        self._hold(start, [(query[keep], score[keep], name[keep])])

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query positions, scores and ticket ids."""
        for start in self.pending:
            self._compact(start)
        if not self.pending:
            empty = np.empty(0)
            return empty.astype(np.int64), empty, empty
        return tuple(np.concatenate(parts) for parts in zip(*(held[0] for held in self.pending.values())))
