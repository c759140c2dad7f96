"""Token counts of greedy word pieces by a linear longest-match automaton."""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportgraph.llm.common import Own, texts
from supportgraph.llm.packing import VOCABULARY, read_vocabulary

#: Different words whose counts a task remembers, and the longest of them in bytes: what it holds
#: is bounded, and a longer word is counted each time.
REMEMBERED, LONGEST = 1 << 17, 64
FAILS = -1


@dataclass
class Automaton:
    """A trie of the vocabulary in which every node knows where to go on when no child fits.

    ``link``: the node that stands for what is left of the node's string once its longest pieces
    are split off; ``pops``: how many pieces that are. A piece itself leaves nothing: its link is
    the root, with one piece. FAILS: what is left cannot be made of pieces.
    """

    child: dict[int, int]  # node * 256 + byte
    link: list[int]
    pops: list[int]

    def count(self, word: bytes) -> int:
        """Pieces of the greedy longest match; one for a word that pieces don't make."""
        child, link, pops, node, total = self.child, self.link, self.pops, 0, 0
        for byte in word:
            following = child.get(node << 8 | byte)
            while following is None:
                total += pops[node]
                node = link[node]
                if node == FAILS:
                    return 1
                following = child.get(node << 8 | byte)
            node = following
        while node:
            total += pops[node]
            node = link[node]
            if node == FAILS:
                return 1
        return total


def build(pieces: list[bytes]) -> Automaton:
    child, ends, children = {}, [False], [[]]
    for piece in pieces:
        node = 0
        for byte in piece:
            key = node << 8 | byte
            if key not in child:
                child[key] = len(ends)
                children[node].append((byte, len(ends)))
                ends.append(False)
                children.append([])
            node = child[key]
        if node:
            ends[node] = True
    link, pops = [FAILS] * len(ends), [0] * len(ends)
    waiting = deque([0])
    while waiting:  # shorter strings first
        parent = waiting.popleft()
        for byte, node in children[parent]:
            waiting.append(node)
            if ends[node]:
                link[node], pops[node] = 0, 1
                continue
            back, popped = link[parent], pops[parent]
            while back != FAILS and back << 8 | byte not in child:
                popped += pops[back]
                back = link[back]
            if back != FAILS:
                link[node], pops[node] = child[back << 8 | byte], popped
    return Automaton(child, link, pops)


class Counter(dict):
    """Piece counts of the words seen, a blank set before each."""

    def __init__(self, automaton: Automaton) -> None:
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        found = self.automaton.count(b" " + word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = found
        return found


def vocabulary_pieces(file: bytes) -> list[bytes]:
    return [base64.b64decode(line.split()[0]) for line in file.splitlines() if line]


def count_tokens(
    docs: DataFrame, text: str = "text", keep: list[str] | None = None, vocabulary: str = VOCABULARY
) -> DataFrame:
    """The columns ``keep`` of ``docs`` with n_words and n_tokens.

    A word is a run of characters other than white space, and its pieces are those of the longest
    match from the left in ``vocabulary``, a blank set before the word. They are counted in one
    pass over the bytes, without building pieces; a word that pieces don't make counts one. The
    automaton is built once on the driver from a file of bounded size and broadcast.

    Null and empty texts have no words. Rows are neither changed, repeated nor dropped; columns of
    ``docs`` with the result's names give way to it, others may have any name.
    """
    added = ["n_words", "n_tokens"]
    own = Own(docs, added, keep)
    n, names = len(own.kept), [*own.columns, *added]
    built = build(vocabulary_pieces(read_vocabulary(vocabulary)))
    shared = docs.sparkSession.sparkContext.broadcast((built.child, built.link, built.pops))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter(Automaton(*shared.value))
        for batch in batches:
            n_words, n_tokens = [], []
            for raw in texts(batch.column(n)):
                words = raw.split()
                n_words.append(len(words))
                n_tokens.append(sum([counts[w] for w in words]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=names
            )

    source = own.table.select(*own.columns, F.col(own[text]).alias("text"))
    return own.restore(source.mapInArrow(run, f"{own.types()}n_words bigint, n_tokens bigint"), *added)
