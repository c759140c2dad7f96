"""Language of a text: averaged embeddings of hashed subwords under a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportgraph.llm.common import Own, texts

#: Subwords are the runs of two to four bytes of a word with a blank on either side; they are
#: hashed into this many buckets, each with an embedding of so many numbers.
BUCKETS, WIDTH, SIZES = 1 << 15, 16, (2, 3, 4)
#: Bytes whose subwords are hashed at a time.
PIECE = 1 << 19
#: Rows a label is learned from at least, where it has as many.
LEAST_ROWS = 100
UNKNOWN = "und"

#: A-Z in lower case, every other ASCII byte that is no letter a blank.
LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256)
)


def subwords(raw: bytes) -> Iterator[np.ndarray]:
    """The bucket of each subword of the whole text, in pieces."""
    line = b" " + b" ".join(raw.translate(LETTERS).split()) + b" "
    for low in range(0, len(line), PIECE):
        # A piece has the first bytes of the next one, so no subword is lost or counted twice.
        piece = np.frombuffer(line[low : low + PIECE + max(SIZES) - 1], np.uint8)
        code, inner = piece.astype(np.uint32), None
        for size in range(2, max(SIZES) + 1):
            starts = min(len(piece) - size + 1, PIECE)
            if starts <= 0:
                break
            code = (code[: len(piece) - size + 1] * np.uint32(257)) ^ piece[size - 1 :].astype(np.uint32)
            blank = piece[size - 2 : len(piece) - 1] == 32 if size > 2 else np.zeros(len(code), bool)
            inner = blank if inner is None else inner[: len(code)] | blank
            if size in SIZES:
                found = code[:starts][~inner[:starts]]
                yield ((found * np.uint32(2654435761)) >> np.uint32(32 - 15)).astype(np.int32)


def has_letter(raw: bytes) -> bool:
    if raw.isascii():
        return bool(raw.translate(LETTERS).strip())
    return any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def features(raw: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """The buckets that occur, their shares, and the number of subwords."""
    counts = np.zeros(BUCKETS, np.int64)
    for found in subwords(raw):
        counts += np.bincount(found, minlength=BUCKETS)
    at, total = np.flatnonzero(counts), int(counts.sum())
    return at.astype(np.int32), (counts[at] / max(total, 1)).astype(np.float32), total


@dataclass
class Model:
    """labels, and the logits of a bucket's embedding: what is left of a trained model."""

    labels: list[str]
    logits: np.ndarray  # one row per bucket
    bias: np.ndarray
    few: float  # subwords at which a text's logits count half
    reject_below: float

    def probabilities(self, raw: bytes) -> np.ndarray:
        total, number = np.zeros(len(self.labels)), 0
        for found in subwords(raw):
            total += self.logits[found].sum(axis=0)
            number += len(found)
        return _softmax((total / max(number, 1) + self.bias)[None] * _evidence(number, self.few))[0]


def _evidence(number, few: float):
    """How far the logits of a text of so many subwords count: a short text says less."""
    return number / (number + few)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(
    samples: list[tuple[int, np.ndarray, np.ndarray, int]], labels: list[str], epochs: int = 8,
    rate: float = 1.0, tolerance: float = 0.001, most: float = 0.4, margin: float = 0.5, seed: int = 7,
) -> Model:
    """Stochastic gradient descent over (label number, buckets, shares, number of subwords).

    Every fifth sample is left out of it. On these the temperature and the weight of short texts
    are chosen that make their labels likeliest, and then the probability below which a text is
    rejected: the one that would reject ``tolerance`` of those whose label is right, and never
    above a bound. The likeliest of L labels has a probability of 1/L at least, so the bound is
    ``most`` or, where that is more, as with two or three labels, 1/L and ``margin`` of it again.
    A single label has nothing to compare with and is never rejected.
    """
    random = np.random.default_rng(seed)
    embedding = random.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    weight, bias = np.zeros((WIDTH, len(labels)), np.float32), np.zeros(len(labels), np.float32)
    check = samples[::5] if len(samples) >= 5 else []
    learn = [s for i, s in enumerate(samples) if i % 5 or not check]
    steps, done = max(epochs * len(learn), 1), 0
    for _ in range(epochs):
        for i in random.permutation(len(learn)):
            label, at, share, _ = learn[i]
            step = np.float32(rate * (1 - done / steps))
            done += 1
            mean = share @ embedding[at]
            error = _softmax((mean @ weight + bias)[None])[0]
            error[label] -= 1
            back = weight @ error
            weight -= step * np.outer(mean, error)
            bias -= step * np.float32(0.1) * error
            embedding[at] -= step * share[:, None] * back
    logits, scale, few, least = embedding @ weight, 1.0, 10.0, 0.0
    if check:
        raw = np.array([share @ logits[at] + bias for _, at, share, _ in check])
        truth = np.array([label for label, *_ in check])
        number = np.array([[n] for *_, n in check], float)

        def chances(scale: float, few: float) -> np.ndarray:
            return _softmax(raw * scale * _evidence(number, few))

        def loss(setting: tuple[float, float]) -> float:
            return -np.log(chances(*setting)[np.arange(len(truth)), truth] + 1e-12).mean()

        # Of settings that fit about as well, the one that takes least from short texts.
        settings = [(t, k) for k in (5, 10, 20, 40, 80, 160) for t in np.geomspace(0.25, 16, 25)]
        scale, few = min(settings, key=lambda s: round(loss(s), 4))
        likely = chances(scale, few)
        right = likely.max(axis=1)[likely.argmax(axis=1) == truth]
        least = float(np.quantile(right, tolerance)) if len(right) else 0.0
    least = min(least, max(most, (1 + margin) / max(len(labels), 1)))
    return Model(labels, (logits * scale).astype(np.float32), bias * scale, float(few), least)


def learn(
    rows: DataFrame, id: str = "doc_id", text: str = "text", label: str = "lang",
    per_label: int = 1000, most_rows: int = 200_000, most_shares: int = 1 << 24, **options,
) -> Model:
    """A model from labelled rows.

    Every label is learned. A bounded sample is enough for it: about ``per_label`` rows of each, or
    fewer where all together would be more than ``most_rows``, chosen by a hash of id and label, so
    reruns agree. So many labels that fewer than LEAST_ROWS are left for each are an error. Their
    whole texts are reduced to subword shares in the tasks; only these reach the driver, eight bytes
    each. Labels with long texts are learned from fewer rows, so that about ``most_shares`` are taken
    in all; a text has no more of them than three a byte or one a bucket. Rows without a label, an id or a letter are no samples. Without any sample the model has
    no labels and rejects everything.
    """
    own = Own(rows, [])
    named = own.table.select(
        F.col(own[id]).cast("string").alias("id"), F.col(own[text]).alias("text"), F.col(own[label]).alias("label")
    )
    labelled = named.filter("label IS NOT NULL AND id IS NOT NULL")
    shares = F.least(F.coalesce(F.octet_length("text"), F.lit(0)) * 3, F.lit(BUCKETS)).cast("bigint")
    sizes = {
        r["label"]: (r["n"], r["shares"])
        for r in labelled.groupBy("label").agg(F.count("*").alias("n"), F.sum(shares).alias("shares"))
        .limit(most_rows // LEAST_ROWS + 1).collect()
    }
    labels = sorted(sizes)
    if len(labels) * LEAST_ROWS > most_rows:
        raise ValueError(f"more than {most_rows // LEAST_ROWS} labels: {most_rows} rows are too few to learn them")
    per_label = min(per_label, most_rows / max(len(labels), 1))
    if not labels:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 1.0)
    parts = {k: min(per_label / n, most_shares / len(labels) / max(size, 1)) for k, (n, size) in sizes.items()}
    share = F.create_map(*[F.lit(x) for k, part in parts.items() for x in (k, part)])[F.col("label")]
    place = F.pmod(F.xxhash64("id", "label"), F.lit(1 << 30)) / float(1 << 30)
    chosen = labelled.filter(place < share).select("label", place.alias("place"), "text")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in enumerate(texts(batch.column(2))):
                at, shares, number = features(raw)
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(i, 1),
                            batch.column(1).slice(i, 1),
                            pa.array([at.tobytes()], pa.binary()),
                            pa.array([shares.tobytes()], pa.binary()),
                            pa.array([number], pa.int64()),
                        ],
                        names=["label", "place", "at", "shares", "number"],
                    )

    schema = "label string, place double, at binary, shares binary, number bigint"
    found = chosen.mapInArrow(reduce, schema).collect()
    found.sort(key=lambda r: (r.place, r.label, r.at, r.shares))
    numbers = {name: i for i, name in enumerate(labels)}
    samples = [
        (numbers[r.label], np.frombuffer(r.at, "<i4"), np.frombuffer(r.shares, "<f4"), r.number) for r in found
    ]
    return train(samples, labels, **options)


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred, score and rejected.

    lang_pred is the likeliest label, score its calibrated probability. A null text, a text without
    a letter and, where the model has no labels, every text is "und" with score 0. rejected: "und",
    or less likely than the model's threshold. Whole texts are read, of any length, in pieces.
    Columns of ``docs`` with the result's names give way to it, others may have any name.
    """
    added = ["lang_pred", "score", "rejected"]
    own = Own(docs, added, keep)
    n, columns = len(own.kept), [*own.columns, *added]
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.labels, model.logits, model.bias, model.few, model.reject_below)
    )

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*shared.value)
        for batch in batches:
            names, scores = [], []
            for raw in texts(batch.column(n)):
                if known.labels and has_letter(raw):
                    chances = known.probabilities(raw)
                    best = int(chances.argmax())
                    names.append(known.labels[best])
                    scores.append(min(float(chances[best]), 1.0))
                else:
                    names.append(UNKNOWN)
                    scores.append(0.0)
            rejected = [n == UNKNOWN or s < known.reject_below for n, s in zip(names, scores)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected)],
                names=columns,
            )

    source = own.table.select(*own.columns, F.col(own[text]).alias("text"))
    types = f"{own.types()}lang_pred string, score double, rejected boolean"
    return own.restore(source.mapInArrow(predict, types), *added)
