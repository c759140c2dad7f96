"""Prompts for turns as they arrive: the history of each conversation is kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from supportgraph.operators.messages import DEFAULT_SYSTEM_PROMPT, MODEL_ROLES, SEARCH_GUIDANCE

#: The state store that keeps state of several variables. Set it before the stream starts.
STATE_STORE = (
    "spark.sql.streaming.stateStore.providerClass",
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
)
PROMPT = "conv_id {kind}, turn bigint, messages array<struct<role:string,content:string>>"


class History(StatefulProcessor):
    """The last turns of one conversation, its last turn's number and its own system prompt.

    ``state`` values: history (turn, role, content), at most ``length`` of them; last (the highest
    turn seen); prompt (the text of the last system turn). A conversation without a new turn for
    ``expire_ms`` is forgotten.
    """

    def __init__(self, length: int, system_prompt: str, guidance: str, expire_ms: int | None):
        self.length, self.system_prompt, self.guidance, self.expire_ms = length, system_prompt, guidance, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.history = handle.getListState("history", "turn bigint, role string, content string")
        self.last = handle.getValueState("last", "turn bigint")
        self.prompt = handle.getValueState("prompt", "content string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows), ignore_index=True)
        texts = arrived.astype(object).where(arrived.notna(), None)
        turns = sorted(
            zip(texts["turn"], texts["role"], texts["content"]),
            key=lambda t: (t[0], t[1] or "", t[2] or ""),
        )
        last = self.last.get()[0] if self.last.exists() else None
        own = self.prompt.get()[0] if self.prompt.exists() else None
        history = [tuple(t) for t in self.history.get()]
        asked = []
        for turn, role, content in turns:
            turn = int(turn)
            if last is not None and turn <= last:
                continue  # seen before
            if role == "user":
                asked.append((turn, self._messages(own, history, content)))
            if role == "system":
                own = content
            history, last = (history + [(turn, role, content)])[-self.length :] if self.length else [], turn
        if last is not None:
            self.last.update((last,))
        if own is not None:
            self.prompt.update((own,))
        if history:
            self.history.put(history)
        if self.expire_ms is not None:
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due[0] if isinstance(due, tuple) else due)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.expire_ms)
        if asked:
            yield pd.DataFrame(
                {"conv_id": [key[0]] * len(asked), "turn": [a[0] for a in asked], "messages": [a[1] for a in asked]}
            )

    def _messages(self, own, history, question) -> list[dict]:
        """System prompt, history without other roles, question; no system message for an empty one."""
        prompt = self.system_prompt if own is None else own
        out = [{"role": "system", "content": prompt + self.guidance}] if prompt else []
        out += [{"role": role, "content": content or ""} for _, role, content in history if role in MODEL_ROLES and role != "system"]
        return [*out, {"role": "user", "content": question}]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.history, self.last, self.prompt):
            state.clear()
        yield from ()

    def close(self) -> None:
        pass


def prompt_stream(
    turns: DataFrame,
    history_length: int,
    system_prompt: str = DEFAULT_SYSTEM_PROMPT,
    guidance: str = SEARCH_GUIDANCE,
    expire_ms: int | None = None,
) -> DataFrame:
    """A prompt for every user turn of a stream ``conv_id, turn, role, content``: ``conv_id, turn,
    messages``.

    Messages are a system prompt with guidance, the last ``history_length`` turns before this one
    without other roles, and the turn's text. The system prompt is that of the last system turn
    before it, else ``system_prompt``. State per conversation is bounded by the history; turns of a
    batch are taken in order, and a turn not beyond the last one seen is a repetition and dropped. So
    prompts don't depend on how the stream is cut into batches, as long as turns of a conversation
    don't arrive in a later batch than their successors. With ``expire_ms``, a conversation without
    a turn for so long is forgotten and begins anew. Rows without a conversation or a turn are left
    out. The session needs the state store named by ``STATE_STORE``.
    """
    known = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "content").where(
        "conv_id IS NOT NULL AND turn IS NOT NULL"
    )
    kind = turns.schema["conv_id"].dataType.simpleString()
    return known.groupBy("conv_id").transformWithStateInPandas(
        History(history_length, system_prompt, guidance, expire_ms),
        PROMPT.format(kind=kind),
        "append",
        "none" if expire_ms is None else "processingTime",
    )
