"""Cosine similarity of two vector columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scores are rounded before they are ranked, so that the order of equal vectors never depends on
# how the rows were cut into blocks.
SCORE_DECIMALS = 9


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def as_score(cosine: Column, mode: str = "normalized") -> Column:
    value = (1 + cosine) / 2 if mode == "normalized" else cosine
    return F.round(value, SCORE_DECIMALS)


def cosine_score(a: Column, b: Column, mode: str = "normalized") -> Column:
    """Score of two vectors; null when either has no length."""
    lengths = norm(a) * norm(b)
    return as_score(F.when(lengths > 0, dot(a, b) / lengths), mode)
