"""Questions to analysis records: relevance, category, title and description."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supportgraph.functions.embedding import (
    ATTEMPTS,
    PAUSE,
    REQUEST_ROWS,
    ask,
    hashed_embedding,
    text_vector,
)
from supportgraph.functions.rules import CATEGORIES, TITLE_MAX_CHARS, TITLE_MAX_WORDS, strip, words
from supportgraph.functions.similarity import SCORE_DECIMALS
from supportgraph.functions.text import join_text
from supportgraph.operators.quality import validate_analysis

#: Topics that are sent to every task.
MOST_CATEGORIES = 10_000
ANALYSIS = "is_related boolean, category string, title string, description string"


class TriageClient(Protocol):
    def analyze(self, questions: list[str]) -> list[dict]: ...


def topics_of(categories: DataFrame, most: int = MOST_CATEGORIES) -> list[tuple[str, str]]:
    """Code and topic of every row of a category table (categoryId, name, description).

    One small job, to be run once: the topics go to every task of the triage. Raises when there are
    more than ``most``; that many topics are a search, see ``exact_topk``.
    """
    topic = join_text(F.col("name"), F.col("description"))
    rows = categories.where("categoryId IS NOT NULL").select("categoryId", topic.alias("topic"))
    found = rows.distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} categories")
    return sorted((r.categoryId, r.topic) for r in found)


def nearest_category(
    df: DataFrame, dim: int, vector: str = "embedding", topics: list[tuple[str, str]] = CATEGORIES
) -> DataFrame:
    """Add ``category`` and ``category_score``: the category whose topic is closest, the lower code
    first among equals. A row without a vector gets null for both. No job runs."""
    ordered = sorted(topics)
    codes = pa.array([code for code, _ in ordered], pa.string())
    fixed = np.array([text_vector(topic, dim) for _, topic in ordered]).reshape(-1, dim)

    @F.arrow_udf("struct<code:string,score:double>")
    def nearest(vectors: pa.Array) -> pa.Array:
        known = np.asarray(vectors.is_valid()) & (len(fixed) > 0)
        best, score = np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
        if known.any():
            rows = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            close = np.round(rows @ fixed.T, SCORE_DECIMALS)
            best[known], score[known] = close.argmax(axis=1), close.max(axis=1)
        missing = pa.array(~known)
        names = codes.take(pa.array(best, mask=~known))
        return pa.StructArray.from_arrays([names, pa.array(score, mask=~known)], ["code", "score"], mask=missing)

    return (
        df.withColumn("__best", nearest.asNondeterministic()(F.col(vector)))
        .withColumn("category", F.col("__best.code"))
        .withColumn("category_score", F.col("__best.score"))
        .drop("__best")
    )


def short_title(text: Column) -> Column:
    """The first words of a text, cut to the longest title allowed."""
    first = F.array_join(F.slice(words(text), 1, TITLE_MAX_WORDS), " ")
    return strip(F.substring(first, 1, TITLE_MAX_CHARS))


def triage(
    questions: DataFrame,
    dim: int,
    related_from: float = 0.1,
    topics: list[tuple[str, str]] = CATEGORIES,
) -> DataFrame:
    """Analysis of every question by closeness to the topics: the fixed ones, or those of a category
    table (see ``topics_of``).

    Adds ``is_related, category, title, description, category_score``. A question whose best
    category scores below ``related_from`` is not related and has no category. Invalid records are
    replaced by the fallback record.
    """
    vector = "__question_vector"
    scored = nearest_category(
        hashed_embedding(questions, F.col("question"), dim, vector), dim, vector, topics
    ).drop(vector)
    related = F.coalesce(F.col("category_score") >= related_from, F.lit(False))
    return validate_analysis(
        scored.withColumn("is_related", related)
        .withColumn("category", F.when(related, F.col("category")))
        .withColumn("title", short_title(F.col("question")))
        .withColumn("description", F.col("question")),
        [code for code, _ in topics],
    )


def triage_with_model(
    questions: DataFrame, client_factory: Callable[[], TriageClient]
) -> DataFrame:
    """Analysis of every question by a model, checked by the same rules."""

    @F.pandas_udf(ANALYSIS)
    def analyze(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        client = client_factory()
        for texts in batches:
            records = ask(client.analyze, texts.fillna("").tolist(), REQUEST_ROWS, ATTEMPTS, PAUSE)
            yield pd.DataFrame(
                records, columns=["is_related", "category", "title", "description"]
            )

    analyzed = questions.withColumn("__analysis", analyze.asNondeterministic()("question"))
    return validate_analysis(analyzed.select(*questions.columns, "__analysis.*"))
