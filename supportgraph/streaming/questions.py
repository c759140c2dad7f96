"""Answers for questions as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from supportgraph.workspace import materialize, removed_afterwards


def answer_stream(
    questions: DataFrame,
    answer: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    available_now: bool = True,
    every: str = "1 minute",
) -> StreamingQuery:
    """Run ``answer`` on each batch of a stream of questions and store its results.

    Ranking is not allowed on a stream, so each batch is a plain DataFrame job. Results go to a
    folder named by the batch, which a repeated batch overwrites: each question is stored once.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        # Retrieval reads its questions more than once; the source is read once. What the steps
        # of a batch have written goes once its results are stored.
        with removed_afterwards(batch.sparkSession):
            results = answer(materialize(batch, "questions"))
            results.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    writer = questions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime=every)
    return writer.start()
