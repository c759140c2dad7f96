"""Token ids of texts, packed into rows of equal length by best fit."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportgraph.llm.common import Own, texts

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A vocabulary file is broadcast; it may be this large at most.
MOST_VOCABULARY = 64 << 20
#: Fixed value: how the public byte-level vocabulary cuts a text before it merges bytes.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters after which a text is cut for encoding, at a place where no token can span the cut.
PIECE = 1 << 20
_CUT = re.compile(r"(?<=[^\s]) (?=[^\s])")


def read_vocabulary(path: str) -> bytes:
    size = os.path.getsize(path)
    if size > MOST_VOCABULARY:
        raise ValueError(f"{path} has {size} bytes; a vocabulary may have {MOST_VOCABULARY}")
    with open(path, "rb") as file:
        return file.read()


def encoder(vocabulary: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str) -> Iterator[str]:
    """A long text cut before single blanks between other characters, where tokens never span."""
    low = 0
    while len(text) - low > PIECE:
        cut = _CUT.search(text, low + PIECE)
        if not cut:
            break
        yield text[low : cut.start()]
        low = cut.start()
    yield text[low:] if low else text


class Capacities:
    """Open bins by the room they have left; a segment tree finds the least room that is enough."""

    def __init__(self, length: int) -> None:
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]

    def _add(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, room: int, bin: int) -> None:
        self.bins[room].append(bin)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, bin) with the least room of ``need`` or more, taken out; None if there is none."""
        node, count = need + self.leaves, self.count
        while not count[node]:  # up to the first subtree on the right that has a bin
            while node & 1:
                node >>= 1
                if node <= 1:
                    return None
            if node <= 1:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return room, self.bins[room].pop()


def best_fit(lengths: list[int], length: int) -> list[list[int]]:
    """Bins of item numbers: longest items first, each into the fullest bin that it fits in."""
    bins: list[list[int]] = []
    open_bins = Capacities(length)
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = open_bins.take(lengths[item])
        room, bin = found if found else (length, len(bins))
        if not found:
            bins.append([])
        bins[bin].append(item)
        if room > lengths[item]:
            open_bins.put(room - lengths[item], bin)
    return bins


def position_ids(cu_seqlens: list[int], length: int) -> np.ndarray:
    """The position of each token of a row; it begins again with every segment and the padding."""
    starts = np.zeros(length, np.int64)
    edges = [x for x in cu_seqlens if x < length]
    starts[edges] = edges
    return np.arange(length) - np.maximum.accumulate(starts)


def pack(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    length: int = 2048,
    vocabulary: str = VOCABULARY,
    end: int = 50256,
    shard_tokens: int = 1 << 21,
) -> DataFrame:
    """Packed rows: shard, row, n_tokens, ids, cu_seqlens, resets, doc_ids, offsets.

    Every row of ``docs`` becomes the token ids of its whole text and ``end``. A document longer
    than ``length`` is cut into full rows and a rest; rests and short documents are packed by best
    fit decreasing, so every token lies in exactly one row. ids: ``length`` little-endian numbers
    (16 bits each, 32 for larger vocabularies), filled up with ``end``; rows one below another are
    the id matrix. cu_seqlens: where segments begin, and the end of the last. resets: one bit per
    token, set where the position begins again at zero. doc_ids, offsets: whose segment it is, and
    the token of the document it begins with; sorting by these restores every text.

    A task packs what it reads, in shards of about ``shard_tokens`` tokens: no shuffle, memory
    bounded by a shard and the longest document, and the same rows again if a task is repeated.

    Null and empty texts have the token ``end`` alone. Repeated rows and ids are packed as often as
    they occur; a null id stays null. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast({"file": read_vocabulary(vocabulary)})
    own = Own(docs, [])
    source = own.table.select(F.col(own[id]).alias("id"), F.col(own[text]).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        if "encoder" not in known:  # once per Python worker
            known["encoder"] = encoder(known["file"])
        encode, part = known["encoder"].encode_ordinary, TaskContext.get().partitionId()
        number = np.dtype("<u2") if max(known["encoder"].n_vocab, end) < 1 << 16 else np.dtype("<u4")
        names: list = []
        tokens: list[np.ndarray] = []
        held, shard, id_type = 0, 0, None

        def packed() -> pa.RecordBatch:
            segments = [
                (doc, low, min(low + length, len(own)))
                for doc, own in enumerate(tokens)
                for low in range(0, len(own), length)
            ]
            bins = best_fit([high - low for _, low, high in segments], length)
            ids, lengths, resets = [], [], []
            for members in bins:
                row, mark = np.full(length, end, number), np.zeros(length, bool)
                edges = [0, *accumulate(segments[m][2] - segments[m][1] for m in members)]
                for at, m in zip(edges, members):
                    doc, low, high = segments[m]
                    row[at : at + high - low] = tokens[doc][low:high]
                mark[[x for x in edges if x < length]] = True
                ids.append(row.tobytes())
                lengths.append(edges)
                resets.append(np.packbits(mark).tobytes())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) + shard] * len(bins), pa.int64()),
                    pa.array(range(len(bins)), pa.int32()),
                    pa.array([x[-1] for x in lengths], pa.int32()),
                    pa.array(ids, pa.binary()),
                    pa.array(lengths, pa.list_(pa.int32())),
                    pa.array(resets, pa.binary()),
                    pa.array([[names[segments[m][0]] for m in b] for b in bins], pa.list_(id_type)),
                    pa.array([[segments[m][1] for m in b] for b in bins], pa.list_(pa.int64())),
                ],
                names=["shard", "row", "n_tokens", "ids", "cu_seqlens", "resets", "doc_ids", "offsets"],
            )

        for batch in batches:
            id_type = batch.schema.field(0).type
            for name, raw in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                found = [np.array(encode(p), number) for p in pieces(raw.decode("utf-8", "replace"))]
                tokens.append(np.concatenate([*found, np.array([end], number)]))
                names.append(name)
                held += len(tokens[-1])
                if held >= shard_tokens:
                    yield packed()
                    names, tokens, held, shard = [], [], 0, shard + 1
        if tokens:
            yield packed()

    schema = (
        "shard bigint, row int, n_tokens int, ids binary, cu_seqlens array<int>, resets binary, "
        f"doc_ids array<{kind}>, offsets array<bigint>"
    )
    return source.mapInArrow(run, schema)


def write(packed: DataFrame, path: str) -> None:
    """Packed rows as Parquet files, a row per row of the matrix, each shard within one file."""
    packed.write.parquet(path)


def matrix(rows: list, length: int) -> np.ndarray:
    """The id matrix of packed rows."""
    if not rows:
        return np.zeros((0, length), np.uint16)
    kind = "<u2" if len(rows[0].ids) == 2 * length else "<u4"
    return np.frombuffer(b"".join(bytes(r.ids) for r in rows), kind).reshape(-1, length)
