"""Conversation tables: ``conv_id, turn, role, content``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from supportgraph.operators.ranking import rank_in_group

# Roles passed to a model, and roles shown to a reader.
MODEL_ROLES = ["user", "assistant", "system"]
SHOWN_ROLES = ["user", "assistant"]
OPTIONAL_ROLE = "function"

DEFAULT_SYSTEM_PROMPT = (
    "You answer support questions. Use past tickets to give clear steps, and ask when a question "
    "is unclear."
)
SEARCH_GUIDANCE = (
    "\n\nSearch past tickets for problems, errors, access questions, how-to questions and "
    "features. Do not search for greetings, small talk or general questions."
)


def for_model(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("role").isin(MODEL_ROLES))


def for_display(messages: DataFrame) -> DataFrame:
    """Turns a reader sees: users, assistants, and function turns that have text."""
    role = F.col("role")
    with_text = (role == OPTIONAL_ROLE) & (F.length("content") > 0)
    return messages.where(role.isin(SHOWN_ROLES) | with_text)


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last n turns of each conversation. Each map task passes on n rows per conversation."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return (
        messages.withColumn("__back", F.row_number().over(newest))
        .where(F.col("__back") <= n)
        .drop("__back")
    )


def history_window(messages: DataFrame, n: int) -> DataFrame:
    """History for a model: the last n turns are taken first, other roles dropped after."""
    return for_model(last_messages(messages, n))


def prompt_table(
    messages: DataFrame,
    questions: DataFrame,
    history_length: int,
    system_prompt: str = DEFAULT_SYSTEM_PROMPT,
    guidance: str = SEARCH_GUIDANCE,
) -> DataFrame:
    """One prompt per row of ``questions (conv_id, question_id, question)``: ``messages`` is the
    system prompt with guidance, the history and the question. An empty system prompt adds no
    system message. A prompt holds at most ``history_length`` + 2 messages.
    """

    def entry(section: int, turn, role, content):
        return F.struct(
            F.lit(section).alias("section"),
            turn.cast("bigint").alias("turn"),
            role.alias("role"),
            content.alias("content"),
        )

    ids = ["conv_id", "question_id"]
    zero = F.lit(0)
    fixed = [entry(2, zero, F.lit("user"), F.col("question"))]
    if system_prompt:
        fixed.insert(0, entry(0, zero, F.lit("system"), F.lit(system_prompt + guidance)))
    framing = questions.select(*ids, F.explode(F.array(*fixed)).alias("message"))
    history = history_window(messages, history_length)
    past = questions.select(*ids).join(history, "conv_id").select(
        *ids,
        entry(
            1, F.col("turn"), F.col("role"), F.coalesce("content", F.lit(""))
        ).alias("message"),
    )
    return (
        framing.unionByName(past)
        .groupBy(*ids)
        .agg(F.sort_array(F.collect_list("message")).alias("ordered"))
        .select(
            *ids,
            F.transform(
                "ordered",
                lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")),
            ).alias("messages"),
        )
    )


def conversation_stats(messages: DataFrame) -> DataFrame:
    """Per conversation: its last turn and whether a system message is present. Combined before
    the shuffle, so a long conversation is one row per task; the texts are not read."""
    is_system = F.coalesce(F.col("role") == "system", F.lit(False))
    return messages.groupBy("conv_id").agg(
        F.max("turn").alias("last_turn"), F.bool_or(is_system).alias("has_system")
    )


def last_system_message(messages: DataFrame) -> DataFrame:
    """The text of the last system message of each conversation that has one."""
    return (
        messages.where("role = 'system'")
        .groupBy("conv_id")
        .agg(F.max_by("content", "turn").alias("system_prompt"))
    )


def recovered_system_prompt(
    messages: DataFrame, default: str = DEFAULT_SYSTEM_PROMPT
) -> DataFrame:
    """The system prompt of each conversation: the last one saved, else the default."""
    known = messages.select("conv_id").distinct()
    return known.join(last_system_message(messages), "conv_id", "left").select(
        "conv_id", F.coalesce("system_prompt", F.lit(default)).alias("system_prompt")
    )


def upsert_system_prompt(messages: DataFrame, system_prompt: str) -> DataFrame:
    """Set the text of all system messages, and add one after the last turn of conversations that
    have none."""
    text = F.lit(system_prompt)
    updated = messages.withColumn(
        "content", F.when(F.col("role") == "system", text).otherwise(F.col("content"))
    )
    missing = conversation_stats(messages).where(~F.col("has_system"))
    turn_type = messages.schema["turn"].dataType
    added = missing.select(
        "conv_id",
        (F.col("last_turn") + 1).cast(turn_type).alias("turn"),
        F.lit("system").alias("role"),
        text.alias("content"),
    )
    return updated.select("conv_id", "turn", "role", "content").unionByName(added)


def new_turns(
    messages: DataFrame, answers: DataFrame, system_prompt: str = "", order: str | None = None
) -> DataFrame:
    """Rows to add for ``answers (conv_id, question, answer)``: the system prompt if the
    conversation has none, then question and answer, two turns for every answer. A conversation not
    seen before starts at turn 0.

    Answers of one conversation follow each other by the column ``order``, and by their texts where
    there is none or it is the same, so every turn of a conversation is one row. They are numbered
    over range partitions, so a conversation may have any number of them.
    """
    stats = conversation_stats(messages)
    by = ([F.col(order)] if order else []) + [F.col("question"), F.col("answer")]
    numbered = rank_in_group(answers, "conv_id", by, "__number")
    known = numbered.join(stats, "conv_id", "left")
    start = F.coalesce(F.col("last_turn") + 1, F.lit(0))
    earlier = F.col("__number") - 1
    extra = F.lit(0)
    if system_prompt:
        extra = F.when((earlier > 0) & ~F.coalesce("has_system", F.lit(False)), 1).otherwise(0)
    first = start + earlier * 2 + extra
    rows = [
        F.struct(F.lit("user").alias("role"), F.col("question").alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content")),
    ]
    pair = F.array(*rows)
    if system_prompt:
        system = F.array(
            F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content"))
        )
        pair = F.when(F.coalesce("has_system", F.lit(False)) | (earlier > 0), pair).otherwise(
            F.concat(system, pair)
        )
    turn_type = messages.schema["turn"].dataType
    return known.select("conv_id", first.alias("first"), F.posexplode(pair)).select(
        "conv_id",
        (F.col("first") + F.col("pos")).cast(turn_type).alias("turn"),
        "col.role",
        "col.content",
    )


def append_turns(
    messages: DataFrame, answers: DataFrame, system_prompt: str = "", order: str | None = None
) -> DataFrame:
    """The log with the new turns. To store, append only ``new_turns``."""
    return messages.select("conv_id", "turn", "role", "content").unionByName(
        new_turns(messages, answers, system_prompt, order)
    )
