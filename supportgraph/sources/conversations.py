"""Conversation logs: JSON in, JSON out, and the listing of the stored files.

Three layouts. A log holds turns as they were added (``append_conversations``). Conversation files
hold whole conversations with the place of each turn, any number of them in a file, so a long one
lies in several. Lists are one JSON list per file and conversation, for programs that expect that.
In all of them an id is kept as it is: as a text inside the file, or as the name of a folder that is
never read as a number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from supportgraph.functions.text import label_of, stamp
from supportgraph.operators.ranking import rank_in_group

TURNS = "array<struct<content:string,role:string>>"
LINE = "conversation string, place int, role string, content string"
ROWS = "conv_id string, turn int, role string, content string"
FOLDER = "conv_id="
# Fixed value: the folder name that Spark gives to a null.
NO_ID = "__HIVE_DEFAULT_PARTITION__"


def _unescaped(name: Column) -> Column:
    """A name without %-escapes. Unlike in a web form, "+" stands for itself."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def _part_of(path: Column, place: int) -> Column:
    """A part of a file's path, counted from the end."""
    return _unescaped(F.element_at(F.split(path, "/"), place))


# --- conversation files: a turn per line ---------------------------------------------------------


def write_conversation_files(messages: DataFrame, path: str) -> None:
    """One JSON object per turn with its conversation and place, in files that range over both.

    The place counts from 0 in the order of turn, content and role. No task holds a conversation and
    the number of files does not grow with the number of conversations. A null id stays null.
    """
    order = [F.col("turn"), F.col("content"), F.col("role")]
    # Cut by the start of a content: samples of the cuts reach the driver.
    cuts = [F.col("turn"), F.substring("content", 1, 32)]
    placed = rank_in_group(messages, "conv_id", order, "place", cuts)
    lines = placed.select(
        F.col("conv_id").cast("string").alias("conversation"),
        (F.col("place") - 1).cast("int").alias("place"),
        "role",
        "content",
    )
    spread = lines.repartitionByRange("conversation", "place")
    spread.sortWithinPartitions("conversation", "place").write.json(path)


def _conversation_lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``file, reason`` and the columns of LINE: the reason is why a line cannot be used."""
    text = spark.read.option("pathGlobFilter", pattern).text(path)
    lines = text.select(
        _part_of(F.col("_metadata.file_path"), -1).alias("file"), F.from_json("value", LINE).alias("line")
    )
    reason = F.when(F.col("line.place").isNull(), "no message").when(
        F.col("line.role").isNull(), "message without role"
    )
    return lines.select("file", reason.alias("reason"), "line.*")


def load_conversation_files(
    spark: SparkSession, path: str, pattern: str = "*.json", skip_rejects: bool = False
) -> DataFrame:
    """Turns of the conversations in ``path``: ``conv_id, turn, role, content``; the place is the turn.

    A line that is no message or has no role fails the job; with ``skip_rejects`` its conversation
    is left out whole, for the caller to store ``conversation_rejects``; a line that names no
    conversation is left out by itself.
    """
    lines = _conversation_lines(spark, path, pattern)
    if skip_rejects:
        unfit = lines.where("reason IS NOT NULL").select(F.col("conversation").alias("unfit")).distinct()
        # A line that cannot be read names no conversation; others of that id are fit.
        known = lines.where("reason IS NULL")
        lines = known.join(unfit.where("unfit IS NOT NULL"), F.col("conversation") == F.col("unfit"), "left_anti")
    else:
        message = F.concat_ws(": ", "file", "reason")
        checked = F.when(F.col("reason").isNotNull(), F.raise_error(message).cast("int"))
        lines = lines.withColumn("place", checked.otherwise(F.col("place")))
    return lines.select(F.col("conversation").alias("conv_id"), F.col("place").alias("turn"), "role", "content")


def conversation_rejects(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """Conversation files with lines that cannot be used: ``file, reason``."""
    lines = _conversation_lines(spark, path, pattern)
    return lines.where("reason IS NOT NULL").select("file", "reason").distinct()


# --- lists: a file per conversation --------------------------------------------------------------


def export_conversation_lists(messages: DataFrame, path: str) -> None:
    """One JSON list per conversation, in a folder per conversation: ``conv_id=<id>/part-….txt``.

    A list cannot be split over files, so one task writes a conversation. It writes an element per
    line as the sort delivers them and holds no more than one, so a conversation may have any length.
    An id cannot be an empty text, which no folder can be called; a null id is a folder of its own.
    """
    same = Window.partitionBy("conv_id").orderBy("turn", "content", "role")
    element = F.to_json(F.struct("content", "role"))
    name = F.col("conv_id").cast("string")
    rows = messages.select(
        F.when(name == "", F.raise_error(F.lit("a conversation without a name has no folder")).cast("string"))
        .otherwise(name)
        .alias("conv_id"),
        "turn",
        "content",
        "role",
    )
    lines = rows.select(
        "conv_id",
        F.concat(
            F.when(F.row_number().over(same) == 1, "[").otherwise(""),
            element,
            F.when(F.lead(F.lit(1)).over(same).isNull(), "]").otherwise(","),
        ).alias("value"),
    )
    lines.write.partitionBy("conv_id").text(path)


def _list_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``file, conv_id, value, list, reason``: the reason is why a file cannot be used."""
    # A recursive read does not turn folder names into columns, which would be typed by their looks.
    reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    files = reader.text(path, wholetext=True)
    place = F.col("_metadata.file_path")
    name, folder = _part_of(place, -1), _part_of(place, -2)
    own = _unescaped(F.substring(folder, F.lit(len(FOLDER) + 1), F.length(folder)))
    named = F.when(own != NO_ID, own)
    listed = F.from_json("value", TURNS)
    bad_message = F.exists("list", lambda m: m.isNull() | m["role"].isNull())
    return files.select(
        name.alias("file"),
        F.when(folder.startswith(FOLDER), named).otherwise(label_of(name)).alias("conv_id"),
        "value",
        listed.alias("list"),
    ).withColumn(
        "reason",
        F.when(F.trim("value") == "", "empty")
        .when(F.col("list").isNull(), "no list of messages")
        .when(bad_message, "message without role"),
    )


def load_conversation_lists(
    spark: SparkSession, path: str, pattern: str = "*", skip_rejects: bool = False
) -> DataFrame:
    """Turns of conversations stored as one JSON list per file, in ``path`` and the folders below.

    The position in the list is the turn. The conversation is the folder where this is called
    ``conv_id=<id>``, else the file name up to its first dot. File names must not contain a colon. A
    file is read as one value, which holds 2 GB at most; conversation files have no such bound. A
    file that is empty, no list, or has a message without a role fails the job; with ``skip_rejects``
    it is left out, for the caller to store ``list_rejects``.
    """
    files = _list_files(spark, path, pattern)
    if skip_rejects:
        files = files.where("reason IS NULL")
    else:
        message = F.concat_ws(": ", "file", "reason")
        checked = F.when(F.col("reason").isNotNull(), F.raise_error(message).cast(TURNS))
        files = files.withColumn("list", checked.otherwise(F.col("list")))
    turns = files.select("conv_id", F.posexplode("list").alias("turn", "message"))
    return turns.select("conv_id", "turn", "message.role", "message.content")


def list_rejects(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files of lists that cannot be used: ``file, reason``."""
    return _list_files(spark, path, pattern).where("reason IS NOT NULL").select("file", "reason")


# --- logs and listings ---------------------------------------------------------------------------


def append_conversations(messages: DataFrame, path: str) -> None:
    """Add turns to a log with one JSON object per line.

    The turn is stored with each line, so a conversation may spread over any number of files and
    no task ever holds a whole conversation.
    """
    messages.select("conv_id", "turn", "role", "content").write.mode("append").json(path)


def load_conversations(spark: SparkSession, path: str, schema: str = ROWS) -> DataFrame:
    return spark.read.schema(schema).json(path)


def list_conversation_files(
    spark: SparkSession, path: str, pattern: str = "*.json", recursive: bool = False
) -> DataFrame:
    """Stored files, the one changed last first. File contents are not read.

    ``folder`` is the name of the folder a file is in. Exported lists lie in folders and are called
    ``*.txt``: list them with ``pattern="*", recursive=True``.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", recursive)
        .load(path)
    )
    name = _part_of(F.col("path"), -1)
    return (
        files.select(
            name.alias("file_name"),
            label_of(name).alias("label"),
            F.element_at(F.split("path", "/"), -2).alias("folder"),
            F.col("modificationTime").alias("modified"),
            stamp(F.col("modificationTime")).alias("last_update"),
        )
        .orderBy(F.desc("modified"), "file_name")
    )
