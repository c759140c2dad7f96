"""Quality of a text: ridge regression on random Fourier features of its statistics, calibrated."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportgraph.llm.common import Own, texts
from supportgraph.workspace import materialize

#: Tasks that sum normal equations, at most: what meets in one place is bounded by it.
SUMS = 1024
#: Steps of the calibration's histogram over scores from -0.5 to 1.5.
STEPS = 2048

STATISTICS = [
    "log_bytes", "log_words", "word_length", "long_words", "short_words", "different_words",
    "log_lines", "line_length", "different_lines", "letters", "upper", "digits", "blanks",
    "points", "exclaims", "symbols", "bars", "brackets", "quotes", "beyond_ascii", "control",
    "capital_words", "entropy",
]

_CLASSES = [
    b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789", b" \t\n\r", b".,;:", b"!?", b"#$%&*@^~+=", b"|\\/_", b"()[]{}<>", b"\"'`",
    bytes(range(128, 256)), bytes(range(9)) + bytes(range(14, 32)) + b"\x7f",
]


def class_table() -> np.ndarray:
    """Which class a byte belongs to: one row per byte."""
    table = np.zeros((256, len(_CLASSES)))
    for i, members in enumerate(_CLASSES):
        table[list(members), i] = 1
    return table


def statistics(raw: bytes, table: np.ndarray) -> list[float]:
    """The numbers named in STATISTICS, of a whole text of any length."""
    n, words, lines = len(raw), raw.split(), raw.split(b"\n")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = counts @ table / max(n, 1)
    present = counts[counts > 0] / max(n, 1)
    w, lengths = max(len(words), 1), [len(x) for x in words]
    return [
        np.log1p(n), np.log1p(len(words)), sum(lengths) / w, sum(x > 12 for x in lengths) / w,
        sum(x < 4 for x in lengths) / w, len(set(words)) / w, np.log1p(len(lines)),
        np.log1p(n / len(lines)), len(set(lines)) / len(lines), *shares.tolist(),
        sum(x.isupper() for x in words) / w, float(-(present * np.log2(present)).sum()),
    ]


def document_statistics(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with a column per statistic; null counts as empty."""
    types = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = class_table()
        for batch in batches:
            rows = [statistics(raw, table) for raw in texts(batch.column(len(keep)))]
            numbers = np.array(rows, np.float64).reshape(-1, len(STATISTICS)).T
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], *[pa.array(x) for x in numbers]], names=[*keep, *STATISTICS]
            )

    columns = ", ".join(f"{c} double" for c in STATISTICS)
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(compute, types + columns)


@dataclass
class Kernel:
    """Random features whose products approximate exp(-|x - y|^2 / (2 * scale^2))."""

    mean: np.ndarray
    spread: np.ndarray
    directions: np.ndarray
    phases: np.ndarray

    def map(self, batch: pa.RecordBatch, first: int) -> np.ndarray:
        raw = np.stack([batch.column(first + i).to_numpy(zero_copy_only=False) for i in range(len(STATISTICS))], axis=1)
        standard = np.clip((raw - self.mean) / self.spread, -6, 6)
        waves = np.sqrt(2 / len(self.phases)) * np.cos(standard @ self.directions + self.phases)
        return np.hstack([waves, np.ones((len(raw), 1))])


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``values``: neighbours out of order are pooled."""
    blocks: list[list[float]] = []  # value, weight, number
    for value, weight in zip(values, weights):
        blocks.append([float(value), float(weight), 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, w, k = blocks.pop()
            u, x, j = blocks.pop()
            blocks.append([(u * x + v * w) / (x + w), x + w, j + k])
    return np.repeat([b[0] for b in blocks], [b[2] for b in blocks])


@dataclass
class Model:
    kernel: Kernel
    weights: np.ndarray
    places: np.ndarray  # raw scores and the probabilities that they stand for
    chances: np.ndarray


def _kernel(stats: DataFrame, features: int, scale: float, seed: int) -> Kernel:
    row = stats.agg(
        *[F.avg(c).alias(f"m_{c}") for c in STATISTICS], *[F.stddev_pop(c).alias(f"s_{c}") for c in STATISTICS]
    ).first()
    random = np.random.default_rng(seed)
    return Kernel(
        np.array([row[f"m_{c}"] or 0.0 for c in STATISTICS]),
        np.array([max(row[f"s_{c}"] or 0.0, 1e-3) for c in STATISTICS]),
        random.normal(0, 1 / scale, (len(STATISTICS), features)),
        random.uniform(0, 2 * np.pi, features),
    )


def _equations(rows: DataFrame, kernel: Kernel) -> dict[int, np.ndarray]:
    """The summed normal equations of each half of the rows, with the targets as last column.

    A task sums its own rows; sums of tasks are added line by line, each line in a group of at
    most SUMS short vectors.
    """
    size = len(kernel.phases) + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, size, size + 1))
        for batch in batches:
            half = batch.column(0).to_numpy(zero_copy_only=False)
            label = batch.column(1).to_numpy(zero_copy_only=False)
            features = kernel.map(batch, 2)
            for h in (0, 1):
                own = features[half == h]
                sums[h, :, :size] += own.T @ own
                sums[h, :, size] += own.T @ label[half == h]
        for h in (0, 1):
            if sums[h].any():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([h] * size, pa.int32()),
                        pa.array(range(size), pa.int32()),
                        pa.array([line.tobytes() for line in sums[h]], pa.binary()),
                    ],
                    names=["half", "line", "sums"],
                )

    def add(part: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), "<f8") for x in part.column("sums"))
        return pa.table(
            {
                "half": part.column("half").slice(0, 1),
                "line": part.column("line").slice(0, 1),
                "sums": pa.array([total.tobytes()], pa.binary()),
            }
        )

    schema = "half int, line int, sums binary"
    lines = rows.coalesce(SUMS).mapInArrow(partial, schema).groupBy("half", "line").applyInArrow(add, schema)
    out = {h: np.zeros((size, size + 1)) for h in (0, 1)}
    for r in lines.collect():  # a fixed number of lines of a fixed length
        out[r.half][r.line] = np.frombuffer(r.sums, "<f8")
    return out


def _solve(sums: np.ndarray, ridge: float) -> np.ndarray:
    size = len(sums)
    penalty = np.full(size, ridge * max(sums[-1, -2] / size, 1.0))  # sums[-1, -2]: rows
    penalty[-1] = 1e-6
    return np.linalg.solve(sums[:, :size] + np.diag(penalty), sums[:, size])


def _bin(score: np.ndarray) -> np.ndarray:
    return np.clip((score + 0.5) / 2 * STEPS, 0, STEPS - 1).astype(np.int64)


def learn(
    stats: DataFrame, labels: DataFrame, id: str = "doc_id", label: str = "quality",
    features: int = 256, scale: float = 4.0, ridge: float = 1e-3, seed: int = 11,
) -> Model | None:
    """A model from all rows of ``stats`` (see ``document_statistics``) that have a label.

    Normal equations are summed per partition over every labelled row, apart for two halves that a
    hash of the id decides. The weights come from both. For the calibration each half is scored by
    the weights of the other; the histogram of these scores, with the share of label 1 in each
    step, is made non-decreasing. A document with several labels counts with their mean. Null
    labels are left out. None where there is no labelled row.
    """
    known = labels.filter(F.col(label).isNotNull()).groupBy(id).agg(F.avg(F.col(label).cast("double")).alias("_label"))
    half = F.pmod(F.xxhash64(F.col(id).cast("string")), F.lit(2)).cast("int")
    rows = materialize(stats.join(known, id).select(half.alias("_half"), "_label", *STATISTICS), "learn")
    kernel = _kernel(rows, features, scale, seed)
    sums = _equations(rows, kernel)
    both = sums[0] + sums[1]
    if not both[-1, -2]:
        return None
    # A half without rows (very small tables) takes the weights of all.
    others = [_solve(sums[1 - h] if sums[1 - h][-1, -2] else both, ridge) for h in (0, 1)]

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            halves = batch.column(0).to_numpy(zero_copy_only=False)
            mapped = kernel.map(batch, 2)
            score = np.where(halves == 0, mapped @ others[0], mapped @ others[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(_bin(score)), batch.column(1).cast(pa.float64())], names=["bin", "label"]
            )

    histogram = sorted(
        rows.mapInArrow(bins, "bin bigint, label double")
        .groupBy("bin").agg(F.count("*").alias("n"), F.avg("label").alias("share")).collect()
    )
    n = np.array([r.n for r in histogram], float)
    smooth = isotonic(np.array([r.share for r in histogram]), n)
    middles = (np.array([r.bin for r in histogram]) + 0.5) / STEPS * 2 - 0.5
    places, chances = [], []
    for value in dict.fromkeys(smooth):  # one point per pooled block: its middle by weight
        block = smooth == value
        places.append(np.average(middles[block], weights=n[block]))
        chances.append(value)
    ends = [-0.5, *places, 1.5], [max(chances[0] - 1e-3, 0.0), *chances, min(chances[-1] + 1e-3, 1.0)]
    return Model(kernel, _solve(both, ridge), np.array(ends[0]), np.array(ends[1]))


def score(stats: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``stats`` with score and predicted (score >= 0.5).

    Without a model every score is one half.
    """
    types = "".join(f"`{c}` {stats.schema[c].dataType.simpleString()}, " for c in keep)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None:
                chances = np.full(batch.num_rows, 0.5)
            else:
                chances = np.interp(model.kernel.map(batch, len(keep)) @ model.weights, model.places, model.chances)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(chances), pa.array((chances >= 0.5).astype(np.int32))],
                names=[*keep, "score", "predicted"],
            )

    return stats.select(*keep, *STATISTICS).mapInArrow(compute, f"{types}score double, predicted int")


def classify(
    docs: DataFrame, labels: DataFrame, learn_from, id: str = "doc_id", text: str = "text",
    label: str = "quality", **options,
) -> DataFrame:
    """(id, score, predicted) of every row of ``docs``: how likely its label is 1.

    ``learn_from``: a condition on ``id`` that says which rows may be learned from. Texts are read
    once, whole; their statistics are written to the shared folder, and all that follows works on
    these few numbers. Null and empty texts have statistics like others and get a score. Rows
    without an id are scored but not learned from; repeated rows count as often as they occur. Other
    columns of both tables may have any name.
    """
    own, marks = Own(docs, []), Own(labels, [])
    docs = own.table.select(F.col(own[id]).alias(id), F.col(own[text]).alias(text))
    labels = marks.table.select(F.col(marks[id]).alias(id), F.col(marks[label]).alias(label))
    stats = materialize(document_statistics(docs, text, [id]), "statistics")
    model = learn(stats.filter(learn_from), labels.filter(learn_from), id, label, **options)
    return score(stats, model, [id])
