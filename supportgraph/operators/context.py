"""The comments that led up to a solution.

For each solution the latest n comments of its ticket that are strictly older. No solution is
paired with all earlier comments: comments are put on a time line and each one looks back n
places, so the work grows with the number of comments even when one ticket holds a third of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supportgraph.workspace import materialize

# Tickets with more comments than this are worked on in pieces of their time line.
LARGE_TICKET = 100_000


def _dated(entries: Column | str) -> Column:
    return F.filter(entries, lambda e: e["creationDate"].isNotNull())


def _whole_tickets(comments: DataFrame, entry: Column, limit: int) -> DataFrame:
    """Solutions with ``earlier``, for tickets that fit in a task: one shuffle, one sort."""
    # Newest last, and the lowest id last among equal times, so that going backwards gives the
    # order of the result. The first row of an instant looks back on older instants only.
    latest_last = [F.col("creationDate"), F.desc("commentId")]
    line = Window.partitionBy("ticketId").orderBy(*latest_last)
    instant = Window.partitionBy("ticketId", "creationDate").orderBy(F.desc("commentId"))
    looked_back = F.collect_list(entry).over(line.rowsBetween(-limit, -1))
    return (
        comments.repartition("ticketId")
        .withColumn("__near", looked_back)
        .withColumn("__near", F.first("__near").over(instant))
        .where("isSolution")
        .withColumn("earlier", F.reverse(_dated("__near")))
        .drop("__near")
    )


def _first_look_back(
    rows: DataFrame, group: list[str], step: str, order: list[Column], limit: int, out: str
) -> DataFrame:
    """For each (group, step): the last ``limit`` entries of the group from earlier steps, as
    ``out``, in the order given. One sort per group and no list longer than ``limit``."""
    line = Window.partitionBy(*group).orderBy(F.col(step), *order)
    return (
        rows.withColumn(out, F.collect_list("entry").over(line.rowsBetween(-limit, -1)))
        .withColumn("__previous", F.lag(step).over(line))
        .where(F.col("__previous").isNull() | (F.col("__previous") != F.col(step)))
        .select(*group, *([] if step in group else [step]), out)
    )


def _ticket_pieces(comments: DataFrame, entry: Column, limit: int) -> DataFrame:
    """Solutions with ``earlier``, for tickets of any size: inside each piece, then across pieces.

    Pieces are range partitions by ticket and time, so none is larger than such a partition, however
    many comments a ticket has and however fine its times are.
    """
    # No look-back reaches past the first n comments of one instant. Spark applies this limit in
    # the map tasks, before rows of one instant come together.
    instant = Window.partitionBy("ticketId", "creationDate").orderBy("commentId")
    rows = (
        comments.where(F.col("creationDate").isNotNull())
        .select(
            "ticketId",
            "commentId",
            "creationDate",
            entry.alias("entry"),
        )
        .withColumn("place", F.row_number().over(instant))
        .where(F.col("place") <= limit)
        .repartitionByRange("ticketId", "creationDate")
        .withColumn("piece", F.spark_partition_id())
    )
    rows = materialize(rows, "time-lines")
    near = _first_look_back(
        rows, ["ticketId", "piece"], "creationDate", [F.desc("place")], limit, "near"
    )
    # What a piece hands on to later pieces: its last n comments.
    newest = Window.partitionBy("ticketId", "piece").orderBy(F.desc("creationDate"), "place")
    tails = rows.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= limit)
    far = _first_look_back(
        tails, ["ticketId"], "piece", [F.col("creationDate"), F.desc("place")], limit, "far"
    )
    both = F.concat(F.reverse("near"), F.reverse("far"))
    lines = near.join(far, ["ticketId", "piece"]).select(
        "ticketId", "creationDate", F.slice(both, 1, limit).alias("earlier")
    )
    # Solutions without a time have nothing before them.
    none = F.array().cast(lines.schema["earlier"].dataType)
    return (
        comments.where("isSolution")
        .join(lines, ["ticketId", "creationDate"], "left")
        .withColumn("earlier", F.coalesce("earlier", none))
    )


def solutions_with_earlier(
    comments: DataFrame, limit: int, carry: list[str], large_ticket: int | None = LARGE_TICKET
) -> DataFrame:
    """The solutions among ``comments``, with ``earlier``: the latest ``limit`` comments of the
    ticket strictly before, newest first, equal times by comment id, as structs of
    ``creationDate, commentId`` and the columns of ``carry``.

    Comments without a time are before nothing and have nothing before them. A caller who knows
    that no ticket is large passes None for ``large_ticket``, which saves a count per ticket.
    """
    comments = comments.where(F.col("ticketId").isNotNull()).select(
        "ticketId", "commentId", "creationDate", "isSolution", *carry
    )
    entry = F.struct("creationDate", "commentId", *carry)
    if limit == 0:
        empty = F.filter(F.array(entry), lambda _: F.lit(False))
        return comments.where("isSolution").withColumn("earlier", empty)
    if large_ticket is None:
        return _whole_tickets(comments, entry, limit)
    # Counts are combined before the shuffle. At most rows / large_ticket tickets are large.
    large = materialize(
        comments.groupBy("ticketId")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > large_ticket)
        .select("ticketId"),
        "large-tickets",
    )
    if large.isEmpty():
        return _whole_tickets(comments, entry, limit)
    common = comments.join(large, "ticketId", "left_anti")
    hot = comments.join(large, "ticketId", "left_semi")
    return _whole_tickets(common, entry, limit).unionByName(_ticket_pieces(hot, entry, limit))


def context_rows(comments: DataFrame, limit: int, large_ticket: int = LARGE_TICKET) -> DataFrame:
    """One row per solution and earlier comment: ``ticketId, solutionId, solutionDate, position,
    commentId, creationDate``. Position 1 is the latest."""
    return (
        solutions_with_earlier(comments, limit, [], large_ticket)
        .select(
            "ticketId",
            F.col("commentId").alias("solutionId"),
            F.col("creationDate").alias("solutionDate"),
            F.posexplode("earlier").alias("pos", "found"),
        )
        .select(
            "ticketId",
            "solutionId",
            "solutionDate",
            (F.col("pos") + 1).alias("position"),
            "found.commentId",
            "found.creationDate",
        )
    )


def with_author_role(comments: DataFrame, users: DataFrame) -> DataFrame:
    """Add ``known`` and ``role`` of the author. Comments by unknown authors stay."""
    roles = users.select(
        F.col("userId").alias("authorUserId"), "role", F.lit(True).alias("known")
    )
    return comments.join(roles, "authorUserId", "left").withColumn(
        "known", F.coalesce("known", F.lit(False))
    )


def solution_cards(
    comments: DataFrame,
    limit: int,
    order: str = "newest",
    large_ticket: int | None = LARGE_TICKET,
) -> DataFrame:
    """Every solution with a known author and its context: ``ticketId, solutionId, solutionDate,
    solutionContent, solutionRole, context``, from comments with the role of their author.

    ``context`` is an array of ``(creationDate, commentId, content, known, role)``, at most
    ``limit`` long and empty when nothing came before. Cards do not depend on a question, so a
    ticket hit by many questions is worked out once.
    """
    earlier = F.col("earlier") if order == "newest" else F.reverse("earlier")
    cards = solutions_with_earlier(comments, limit, ["content", "known", "role"], large_ticket)
    return cards.where("known").select(
        "ticketId",
        F.col("commentId").alias("solutionId"),
        F.col("creationDate").alias("solutionDate"),
        F.col("content").alias("solutionContent"),
        F.col("role").alias("solutionRole"),
        earlier.alias("context"),
    )
