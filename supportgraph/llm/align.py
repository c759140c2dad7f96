"""Tokens of two vocabularies over the same bytes: groups between shared ends, and linked ids."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportgraph.llm.common import Own
from supportgraph.llm.packing import PATTERN, pieces, read_vocabulary
from supportgraph.workspace import materialize

FIRST = "/opt/tokenizers/byte_bpe_50k.json"
SECOND = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text whose tokens a task holds at once, and texts at most.
AT_ONCE, TEXTS_AT_ONCE = 1 << 19, 256
#: Intervals of at most so many ends are looked through at once.
SMALL = 16
#: The most frequent pairs, whose counts go to all tasks. All others are looked up by a join.
FREQUENT = 1 << 18
#: Different pairs a task counts before it hands them on.
HELD = 1 << 20


def byte_symbols() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 characters
    for themselves, the other bytes in order from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokenizers:
    """Both tokenizers, read from their files' bytes, and the bytes of every token."""

    def __init__(self, first: bytes, second: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        model = json.loads(first)["model"]
        symbols, vocabulary = byte_symbols(), model["vocab"]
        self.first_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            known = all(c in symbols for c in token)
            self.first_bytes[number] = bytes(symbols[c] for c in token) if known else token.encode()
        self.first, self.first_ids = self._ranked(model)
        self.second = SentencePieceProcessor(model_proto=second)
        self.second_bytes = [self._piece(i) for i in range(self.second.get_piece_size())]
        # A text is cut at blanks for encoding; no piece may go on over one.
        self.cuts = not any(
            " " in x.lstrip(b" ").decode("utf-8", "replace") for x in self.second_bytes if len(x) > 1
        )
        self.first_sizes, self.second_sizes = (
            np.array([len(x) for x in table]) for table in (self.first_bytes, self.second_bytes)
        )
        self.spelled = [f"{i}{end}" for i in range(len(self.first_bytes)) for end in ",|"]
        self.spelled += [f"{i}{end}" for i in range(len(self.second_bytes)) for end in ",;"]

    def _ranked(self, model: dict) -> tuple[tiktoken.Encoding, np.ndarray | None]:
        """An encoder by ranks for a byte-level vocabulary: single bytes first, then what merges make,
        in their order. Also the id of each rank, unless these are the ranks themselves."""
        made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        tokens = [c for c in byte_symbols() if c in model["vocab"]]
        tokens = sorted(tokens, key=model["vocab"].__getitem__) + list(dict.fromkeys(made))
        ids = [model["vocab"][token] for token in tokens]
        ranks = {self.first_bytes[number]: rank for rank, number in enumerate(ids)}
        encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return encoding, None if ids == list(range(len(ids))) else np.array(ids)

    def _piece(self, number: int) -> bytes:
        piece = self.second.id_to_piece(number)
        if self.second.is_byte(number):
            return bytes([int(piece[3:-1], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both for a blank and each text; None where their bytes are not those of the text.

        The tokens of the first side are cut from the text's own bytes: where they are as many bytes,
        they are the same. Those of the second are compared.
        """
        cut = [list(pieces(" " + text)) if self.cuts else [" " + text] for text in texts]
        second = iter(self.second.encode([part[1:] for parts in cut for part in parts], num_threads=1))
        found, table = [], self.second_bytes
        for text, parts in zip(texts, cut):
            raw = (" " + text).encode()
            a = np.concatenate([np.array(self.first.encode_ordinary(part), np.int64) for part in parts])
            a = a if self.first_ids is None else self.first_ids[a]
            ids = [next(second) for _ in parts]
            same = self.first_sizes[a].sum() == len(raw) and b"".join([table[i] for b in ids for i in b]) == raw
            found.append((a, np.concatenate([np.array(b, np.int64) for b in ids])) if same else None)
        return found


def shared_ends(first: np.ndarray, second: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Which ends of ``first`` are ends of ``second`` too. Both rise; texts lie one behind the other,
    from ``starts`` to ``stops`` in ``first``, and end together.

    Divide and conquer, all intervals of a level at once. In each, the shared end nearest to the
    middle is looked for outwards by bisecting ``second``, and both sides of it are intervals of
    the next level, without the ends already seen. One where no end is shared is done.
    """
    shared = np.zeros(len(first), bool)
    shared[stops - 1] = True

    def meets(places: np.ndarray) -> np.ndarray:
        ends = first[places]
        return second[np.searchsorted(second, ends)] == ends

    low, high = starts, stops - 1
    while True:
        some = high > low
        low, high = low[some], high[some]
        if not len(low):
            return shared
        few = high - low <= SMALL
        sizes = (high - low)[few]
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        places = np.repeat(low[few], sizes) + within
        shared[places] = meets(places)
        low, high = low[~few], high[~few]
        middle = (low + high) // 2
        # The ends between left and right are seen; found: the shared one among them, or -1.
        left, right, found = middle.copy(), middle.copy(), np.full(len(low), -1)
        going = np.arange(len(low))
        for step in range(SMALL // 2):
            for side in (0, 1) if step else (1,):
                places = middle[going] + (step if side else -step)
                hit = meets(places)
                found[going[hit]] = places[hit]
                if side:
                    right[going] = places + 1
                else:
                    left[going] = places
                going = going[~hit]
        for i in going:  # no shared end near: outwards, one by one, to the borders
            while found[i] < 0 and (left[i] > low[i] or right[i] < high[i]):
                if right[i] < high[i]:
                    end = first[right[i]]
                    if second[np.searchsorted(second, end)] == end:
                        found[i] = right[i]
                    right[i] += 1
                if found[i] < 0 and left[i] > low[i]:
                    left[i] -= 1
                    end = first[left[i]]
                    if second[np.searchsorted(second, end)] == end:
                        found[i] = left[i]
        shared[found[found >= 0]] = True
        low, high = np.r_[low, right], np.r_[left, high]


class Aligned:
    """The alignment of some texts, worked out together."""

    def __init__(self, tools: Tokenizers, ids: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.sizes = [np.array([len(pair[side]) for pair in ids], np.int64) for side in (0, 1)]
        none = np.empty(0, np.int64)
        first, second = (np.concatenate([none, *(pair[side] for pair in ids)]) for side in (0, 1))
        ends_first, ends_second = np.cumsum(tools.first_sizes[first]), np.cumsum(tools.second_sizes[second])
        stops = np.cumsum(self.sizes[0])
        shared = shared_ends(ends_first, ends_second, stops - self.sizes[0], stops)
        cut_first = np.flatnonzero(shared)
        cut_second = np.searchsorted(ends_second, ends_first[cut_first])
        self.link_first, self.link_second = first[cut_first], second[cut_second]
        # Groups that end in each text, and where a text's tokens stand among all, side by side.
        self.groups = np.diff(np.searchsorted(cut_first, np.r_[0, stops]))
        group_first = np.cumsum(shared) - shared
        group_second = np.searchsorted(cut_second, np.arange(len(second)))
        before = np.r_[0, cut_second[:-1] + 1] if len(cut_second) else cut_second
        codes = np.empty(len(first) + len(second), np.int64)
        codes[np.arange(len(first)) + before[group_first]] = first * 2 + shared
        ending = np.zeros(len(second), np.int64)
        ending[cut_second] = 1
        offset = 2 * len(tools.first_bytes)
        codes[np.arange(len(second)) + cut_first[group_second] + 1] = second * 2 + ending + offset
        self.codes, self.spelled = codes.tolist(), tools.spelled

    def texts(self) -> list[str]:
        """The groups of each text: ids of both sides with commas, a bar between them, a semicolon
        between groups."""
        out, at = [], 0
        for size in self.sizes[0] + self.sizes[1]:
            out.append("".join(map(self.spelled.__getitem__, self.codes[at : at + size]))[:-1])
            at += size
        return out


ADDED = ["n_a", "n_b", "n_groups", "groups", "link_a", "link_b"]
_TYPES = "n_a bigint, n_b bigint, n_groups bigint, groups string, link_a array<int>, link_b array<int>"


def align(
    docs: DataFrame, text: str = "text", keep: list[str] | None = None, first: str = FIRST, second: str = SECOND
) -> DataFrame:
    """The columns ``keep`` of ``docs`` with the alignment of two vocabularies over every text.

    ``first`` is a byte-level vocabulary (JSON), ``second`` a piece vocabulary; the text is encoded
    with a blank before it, without special tokens. Offsets where tokens of both end cut them into
    groups. n_a, n_b, n_groups: tokens and groups; groups: their ids, ``a1,a2|b1;a3|b2,b3``; link_a
    and link_b: the ids of the last tokens of each group, which are the pairs that end together.

    Null and empty texts, and texts whose tokens of either side don't have the text's bytes, have no
    tokens: zeros, an empty ``groups`` and no links. Rows are neither changed, repeated nor dropped.
    Columns with the result's names give way to it, others may have any name. The files are read on
    the driver, up to 64 MB each, and broadcast.
    """
    own = Own(docs, ADDED, keep)
    n, names = len(own.kept), [*own.columns, *ADDED]
    shared = docs.sparkSession.sparkContext.broadcast(
        {"first": read_vocabulary(first), "second": read_vocabulary(second)}
    )

    def some(texts: pa.Array) -> Iterator[tuple[int, int]]:
        """Ranges of rows with a bounded sum of bytes."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and (held + size > AT_ONCE or i - start >= TEXTS_AT_ONCE):
                yield start, i
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield start, len(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        if "tools" not in known:  # once per Python worker
            known["tools"] = Tokenizers(known["first"], known["second"])
        tools = known["tools"]
        for batch in batches:
            for start, stop in some(batch.column(n)):
                texts = batch.column(n).slice(start, stop - start).to_pylist()
                ids = dict(zip([i for i, t in enumerate(texts) if t], tools.encode([t for t in texts if t])))
                done = [i for i, pair in ids.items() if pair]
                found = Aligned(tools, [ids[i] for i in done])
                counts = np.zeros((3, len(texts)), np.int64)
                counts[:, done] = [*found.sizes, found.groups]
                groups = [""] * len(texts)
                for i, spelled in zip(done, found.texts()):
                    groups[i] = spelled
                offsets = pa.array(np.r_[0, np.cumsum(counts[2])], pa.int32())
                links = [
                    pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32)))
                    for x in (found.link_first, found.link_second)
                ]
                kept = [c.slice(start, stop - start) for c in batch.columns[:n]]
                yield pa.RecordBatch.from_arrays(
                    [*kept, *map(pa.array, counts), pa.array(groups, pa.string()), *links], names=names
                )

    source = own.table.select(*own.columns, F.col(own[text]).alias("text"))
    return own.restore(source.mapInArrow(run, own.types() + _TYPES), *ADDED)


def pair_counts(links: DataFrame) -> DataFrame:
    """How many links of all rows hold each pair of ids: ``pair, n``, a pair being a << 32 | b."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, times = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(times)], names=["pair", "n"])

        for batch in batches:
            a, b = (c.flatten().to_numpy().astype(np.int64) for c in batch.columns)
            more, count = np.unique(a << 32 | b, return_counts=True)
            joined, where = np.unique(np.r_[pairs, more], return_inverse=True)
            pairs, times = joined, np.bincount(where, np.r_[times, count], len(joined)).astype(np.int64)
            if len(pairs) > HELD:
                yield out()
                pairs, times = pairs[:0], times[:0]
        yield out()

    parts = links.select("link_a", "link_b").mapInArrow(partial, "pair bigint, n bigint")
    return parts.groupBy("pair").agg(F.sum("n").alias("n"))


def link_statistics(aligned: DataFrame, row: str, frequent: int = FREQUENT) -> DataFrame:
    """Per ``row`` of a stored alignment: n_best and count_sum.

    A pair's count is the number of links of the whole table that hold it. count_sum adds up the
    counts of a row's links; n_best is how many of them have the highest count of their second id.
    Counts of the ``frequent`` most frequent pairs are known in every task, and the highest count of
    every second id, no more than that vocabulary has. Rarer pairs are joined with all counts: one
    of them holds less than one in ``frequent`` of all links, so no key is large.
    """
    spark = aligned.sparkSession
    counts = materialize(pair_counts(aligned), "pairs")
    top = counts.orderBy(F.desc("n"), "pair").limit(frequent).toArrow().sort_by("pair")
    second = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    best = materialize(counts.groupBy(second.alias("b")).agg(F.max("n").alias("most")), "best")
    highest = best.toArrow()
    most = np.zeros(max(highest.column("b").to_pylist(), default=0) + 1, np.int64)
    most[highest.column("b").to_numpy()] = highest.column("most").to_numpy()
    shared = spark.sparkContext.broadcast((top.column("pair").to_numpy(), top.column("n").to_numpy(), most))
    kind = aligned.schema[row].dataType.simpleString()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, times, most = shared.value

        def out(rows: pa.Array, pair, *values) -> pa.RecordBatch:
            columns = [rows, pa.array([None] * len(rows) if pair is None else pair, pa.int64()), *map(pa.array, values)]
            return pa.RecordBatch.from_arrays(columns, names=[row, "pair", "links", "n_best", "count_sum"])

        for batch in batches:
            a, b = (c.flatten().to_numpy().astype(np.int64) for c in batch.columns[1:])
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            owner, wanted = np.repeat(np.arange(batch.num_rows), sizes), a << 32 | b
            at = np.minimum(np.searchsorted(pairs, wanted), max(len(pairs) - 1, 0))
            hit = pairs[at] == wanted if len(pairs) else np.zeros(len(wanted), bool)
            count = np.where(hit, times[at], 0) if len(pairs) else np.zeros(len(wanted), np.int64)
            sums = np.r_[0, np.cumsum(count)], np.r_[0, np.cumsum(hit & (count == most[b]))]
            ends = np.r_[0, np.cumsum(sizes)]
            total, best_here = (x[ends[1:]] - x[ends[:-1]] for x in sums)
            yield out(batch.column(0), None, np.zeros(batch.num_rows, np.int64), best_here, total)
            if not hit.all():
                rest = owner[~hit].astype(np.int64), wanted[~hit]
                order = np.lexsort((rest[1], rest[0]))
                rows, codes = rest[0][order], rest[1][order]
                new = np.flatnonzero(np.r_[True, (np.diff(rows) != 0) | (np.diff(codes) != 0)])
                zero = np.zeros(len(new), np.int64)
                yield out(batch.column(0).take(pa.array(rows[new])), codes[new], np.diff(np.r_[new, len(rows)]), zero, zero)

    parts = materialize(
        aligned.select(row, "link_a", "link_b").mapInArrow(
            look, f"`{row}` {kind}, pair bigint, links bigint, n_best bigint, count_sum bigint"
        ),
        "links",
    )
    rare = (
        parts.filter("pair IS NOT NULL").join(counts, "pair").withColumn("b", second)
        .join(F.broadcast(best), "b")  # at most a row per id of the second vocabulary
        .select(
            row, F.when(F.col("n") == F.col("most"), F.col("links")).otherwise(0).alias("n_best"),
            (F.col("n") * F.col("links")).alias("count_sum"),
        )
    )
    known = parts.filter("pair IS NULL").select(row, "n_best", "count_sum")
    return known.unionByName(rare).groupBy(row).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align_and_count(
    docs: DataFrame,
    text: str = "text",
    keep: list[str] | None = None,
    first: str = FIRST,
    second: str = SECOND,
    frequent: int = FREQUENT,
) -> DataFrame:
    """The columns ``keep`` of ``docs`` with n_a, n_b, n_groups, n_links, n_best, count_sum and the
    SHA-256 of the groups, see ``align`` and ``link_statistics``. Texts are encoded once: what is
    stored between the steps are the links, not the tokens. A text without tokens has zeros and an
    empty groups_sha256.
    """
    added = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    own = Own(docs, added, keep)
    plain = align(own.table.select(*own.columns, F.col(own[text]).alias("text")), "text", own.columns, first, second)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    stored = materialize(
        plain.withColumn("groups_sha256", digest).drop("groups").withColumn("row", F.monotonically_increasing_id()),
        "aligned",
    )
    sums = link_statistics(stored, "row", frequent)
    rows = stored.select(
        "row", *own.columns, "n_a", "n_b", "n_groups", F.size("link_a").cast("bigint").alias("n_links"), "groups_sha256"
    )
    return own.restore(rows.join(sums, "row"), *added)
