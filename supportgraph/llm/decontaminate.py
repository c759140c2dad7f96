"""Passages of benchmark items in documents, by one automaton over the items."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportgraph.llm.common import Own, texts
from supportgraph.workspace import materialize

#: Bytes of item texts in one automaton; it takes about sixty times as much memory.
PART_BYTES = 1 << 20

#: Normalising keeps every byte in place: A-Z in lower case, what is no part of a word a blank.
NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() and c < 128 or c > 127 else 32 for c in range(256)
)


def words(raw: bytes) -> list[bytes]:
    return raw.translate(NORMAL).split()


class Matcher:
    """Runs of ``window`` or more words that a text has in common with an item.

    Any window holds a whole block of ``window // 2`` words that starts at a multiple of that
    number, or, in an item shorter than the window, the whole item. The automaton has these blocks
    only. The windows around a hit are looked up by a rolling hash among those of the items, each
    once however many hits it holds, and compared word by word. So the work grows with the text
    alone, also where text and items repeat themselves.
    """

    MODULUS, BASE = (1 << 61) - 1, 1_000_003

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.window, self.block = window, max(1, window // 2)
        self.numbers: dict[bytes, int] = {}  # the words of the items
        self.windows: dict[int, list[tuple[list[int], set[str]]]] = {}
        self.lead = pow(self.BASE, window, self.MODULUS)
        anchors: dict[bytes, set[str]] = {}
        for name, raw in items:
            own = words(raw)
            if 0 < len(own) < window:
                anchors.setdefault(b" ".join(own), set()).add(name)
                continue
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in own]
            for at in range(0, len(own) - self.block + 1, self.block):
                anchors.setdefault(b" ".join(own[at : at + self.block]), set())
            for at, key in enumerate(self._rolling(ids)):
                self._entry(key, ids[at : at + window], add=True)[1].add(name)
        self.words = ahocorasick.Automaton()
        for key, names in anchors.items():
            padded = b" " + key + b" "
            self.words.add_word(padded.decode("latin-1"), (len(padded), key.count(b" ") + 1, names))
        self.words.make_automaton()

    def _rolling(self, ids: list[int]) -> Iterator[int]:
        """The hash of each window."""
        key = 0
        for i, number in enumerate(ids):
            key = (key * self.BASE + number) % self.MODULUS
            if i >= self.window:
                key = (key - ids[i - self.window] * self.lead) % self.MODULUS
            if i >= self.window - 1:
                yield key

    def _entry(self, key: int, ids: list[int], add: bool = False) -> tuple[list[int], set[str]] | None:
        """The window of these words, and the items that have it."""
        for entry in self.windows.get(key, ()):
            if entry[0] == ids:
                return entry
        if not add:
            return None
        self.windows.setdefault(key, []).append((ids, set()))
        return self.windows[key][-1]

    def match(self, own: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Ranges of hit words, in order and apart, and the names of the items they come from."""
        if not own or not len(self.words):
            return [], set()
        line = (b" " + b" ".join(own) + b" ").decode("latin-1")
        starts, runs, names, known = None, [], set(), set()
        near: list[tuple[int, int]] = []  # where windows may begin, in order and apart
        for end, (length, size, short) in self.words.iter(line):
            starts = starts or [0, *accumulate(len(w) + 1 for w in own)]
            here = bisect_left(starts, end - length + 1)
            if short:
                names |= short
                runs.append((here, here + size))
            if size == self.block:
                low, high = max(0, here + size - self.window), min(here, len(own) - self.window) + 1
                if near and low <= near[-1][1]:
                    near[-1] = near[-1][0], max(high, near[-1][1])
                elif low < high:
                    near.append((low, high))
        for low, high in near:
            ids = [self.numbers.get(w, 0) for w in own[low : high + self.window - 1]]
            for at, key in enumerate(self._rolling(ids)):
                if key in self.windows:
                    found = self._entry(key, ids[at : at + self.window])
                    if found:
                        if id(found) not in known:
                            known.add(id(found))
                            names |= found[1]
                        start = low + at
                        if runs and runs[-1][0] <= start <= runs[-1][1]:
                            runs[-1] = runs[-1][0], max(runs[-1][1], start + self.window)
                        else:
                            runs.append((start, start + self.window))
        return merged(runs), names


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that touch or overlap made one, in order."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(runs):
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], max(high, out[-1][1])
        else:
            out.append((low, high))
    return out


def offsets(raw: bytes, ranges: list[tuple[int, int]]) -> list[dict]:
    """Ranges of words with their places in the original text, in code points, end exclusive."""
    if not ranges:
        return []
    spans = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(NORMAL))]
    out, at, points = [], 0, 0
    for low, high in ranges:
        ends = []
        for byte in (spans[low][0], spans[high - 1][1]):
            points += len(raw[at:byte].decode("utf-8", "replace"))
            at = byte
            ends.append(points)
        out.append({"first": low, "end": high, "start": ends[0], "stop": ends[1]})
    return out


def _parts(benchmark: DataFrame, item: str, text: str, part_bytes: int) -> Iterator[list]:
    """The items in lists of bounded size; a part is never empty but for an empty benchmark."""
    part, held = [], 0
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    for name, raw in rows.toLocalIterator():
        if part and held + len(raw) > part_bytes:
            yield part
            part, held = [], 0
        part.append((name, raw.encode()))
        held += len(part[-1][1])
    yield part


_SPANS = "array<struct<first:int,end:int,start:int,stop:int>>"


def _scan(rows: DataFrame, kept: int, types: str, part: list, window: int, hits_only: bool) -> DataFrame:
    """``rows`` (their first ``kept`` columns, the text last) with n_words, ranges and items of one
    part of the benchmark; the text is left out, and so are rows without a hit if asked for."""
    shared = rows.sparkSession.sparkContext.broadcast({"items": part})
    names = [*rows.columns[:kept], "n_words", "ranges", "items"]
    spans = pa.list_(pa.struct([(n, pa.int32()) for n in ("first", "end", "start", "stop")]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        if "matcher" not in known:  # once per Python worker
            known["matcher"] = Matcher(known["items"], window)
        matcher = known["matcher"]
        for batch in batches:
            counts, ranges, items = [], [], []
            for raw in texts(batch.column(kept)):
                own = words(raw)
                hits, found = matcher.match(own)
                counts.append(len(own))
                ranges.append(offsets(raw, hits))
                items.append(sorted(found))
            out = pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:kept],
                    pa.array(counts, pa.int64()),
                    pa.array(ranges, spans),
                    pa.array(items, pa.list_(pa.string())),
                ],
                names=names,
            )
            yield out.filter(pa.array([bool(r) for r in ranges])) if hits_only else out

    return rows.mapInArrow(scan, f"{types}n_words bigint, ranges {_SPANS}, items array<string>")


def _joined_ranges(ranges):
    """Ranges of several parts, in order, those that touch or overlap made one."""

    def add(done, one):
        last = F.element_at(done, -1)
        longer = F.struct(
            last["first"].alias("first"), F.greatest(last["end"], one["end"]).alias("end"),
            last["start"].alias("start"), F.greatest(last["stop"], one["stop"]).alias("stop"),
        )
        touches = (F.size(done) > 0) & (one["first"] <= last["end"])
        return F.when(touches, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(
            F.concat(done, F.array(one))
        )

    return F.aggregate(F.array_sort(ranges), F.array().cast(_SPANS), add)


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    keep: list[str] | None = None,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """The columns ``keep`` of ``docs`` with n_words, ranges and items.

    ranges: (first, end) in words and (start, stop) in code points of the original text, ends
    exclusive, of the words inside any occurrence of ``window`` consecutive words of an item, or
    of the whole item where it has fewer. items: the sorted ids, as text, of the items concerned.

    Both sides are brought to lower case (A-Z) and cut into words of letters, digits and
    characters beyond ASCII. Whole texts are read once, without a shuffle. The benchmark is read
    in parts of ``part_bytes`` of text, each with an automaton of its own that is broadcast, so
    neither the driver nor a task ever holds more than one part. Each further part is one more scan
    of the texts, which stores the hits alone, under the SHA-256 of the text; these meet the rows in
    one join.

    Null texts have no words, items without words never occur, items with the same id are one, and
    a null id counts as the empty text. Columns of ``docs`` with the result's names give way to it,
    others may have any name.
    """
    added = ["n_words", "ranges", "items"]
    own, other = Own(docs, added, keep), Own(benchmark, [])
    listed = other.table.select(F.col(other[item]).alias("item"), F.col(other[item_text]).alias("text"))
    source = own.table.select(*own.columns, F.coalesce(F.col(own[text]), F.lit("")).alias("text"))
    digest = F.sha2(F.col("text").cast("binary"), 256)
    rows, hits = None, []
    for part in _parts(listed, "item", "text", part_bytes):
        if rows is None:
            rows = part
        else:
            named = source.select(digest.alias("digest"), "text")
            hits.append(materialize(_scan(named, 1, "digest string, ", part, window, True).drop("n_words"), "hits"))
    if not hits:
        return own.restore(_scan(source, len(own.kept), own.types(), rows, window, False), *added)
    first = source.select(*own.columns, digest.alias("digest"), "text")
    scanned = _scan(first, len(own.kept) + 1, own.types() + "digest string, ", rows, window, False)
    # Equal texts have equal hits, so one of them counts for each part.
    more = materialize(
        reduce(DataFrame.unionByName, [h.dropDuplicates(["digest"]) for h in hits])
        .groupBy("digest")
        .agg(F.flatten(F.collect_list("ranges")).alias("more"), F.flatten(F.collect_list("items")).alias("names")),
        "passages",
    )
    none, no_names = F.array().cast(_SPANS), F.array().cast("array<string>")
    joined = scanned.join(more, "digest", "left").withColumns(
        {
            "ranges": _joined_ranges(F.concat("ranges", F.coalesce("more", none))),
            "items": F.array_sort(F.array_distinct(F.concat("items", F.coalesce("names", no_names)))),
        }
    )
    return own.restore(joined, *added)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that have no passage of the benchmark."""
    own = Own(docs, [])
    found = find_passages(own.table, benchmark, text=own[text], **options)
    return own.restore(found.filter(F.size("ranges") == 0))
