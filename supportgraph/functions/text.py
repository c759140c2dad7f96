"""Text forms of values and of whole results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words and layout of the text form of a result.
NO_TITLE = "No title"
NO_DESCRIPTION = "No description"
UNKNOWN_AUTHOR = "Unknown"
TITLE_LINE = "TICKET: "
ID_LINE = "Ticket ID: "
DESCRIPTION_LINE = "Description: "
RESOLUTION_LINE = "Resolution: "
CONTEXT_HEADING = "\nCONTEXT COMMENTS:"
SOLUTION_HEADING = "\nSOLUTION by "
SCORE_LINE = "\nSimilarity Score: "


def or_default(text: Column, default: str) -> Column:
    """The text, or the default when it is null or empty."""
    return F.when(F.length(text) > 0, text).otherwise(F.lit(default))


def join_text(*columns: Column, null_text: str | None = None) -> Column:
    """Columns joined by one space. Nulls are skipped unless ``null_text`` stands in for them."""
    parts = [c.cast("string") for c in columns]
    if null_text is not None:
        parts = [F.coalesce(c, F.lit(null_text)) for c in parts]
    return F.concat_ws(" ", *parts)


def stamp(at: Column) -> Column:
    """Date and time in UTC, to the second, whatever the zone of the session.

    The text is that of a time without a zone: formatting an instant would pass through the clock
    of the session, which skips an hour a year.
    """
    seconds = F.floor(F.unix_micros(at) / 1_000_000).cast("decimal(18,6)")
    zero, epoch = F.lit(0), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return (epoch + F.make_dt_interval(zero, zero, zero, seconds)).cast("string")


def iso_datetime(at: Column) -> Column:
    """ISO-8601 text with the UTC offset; microseconds are shown only when there are any."""
    micros = F.pmod(F.unix_micros(at), F.lit(1_000_000))
    fraction = F.when(
        micros != 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))
    ).otherwise(F.lit(""))
    return F.concat(F.translate(stamp(at), " ", "T"), fraction, F.lit("+00:00"))


def score_text(score: Column) -> Column:
    return F.format_string("%.3f", score)


def percent_text(score: Column) -> Column:
    return F.format_string("%.1f%%", score * 100)


def label_of(name: Column) -> Column:
    """The part of a name before its first dot."""
    return F.substring_index(name, ".", 1)


def _line(comment: Column) -> Column:
    role = or_default(comment["author"]["role"], UNKNOWN_AUTHOR)
    return F.concat(F.lit("- "), role, F.lit(": "), F.coalesce(comment["content"], F.lit("")))


def result_text(with_score: bool = True) -> Column:
    """One text per result row, from the columns of a retrieval result."""
    context = F.col("contextComments")
    solution = F.col("solutionComment")
    resolution = F.col("resolutionSummary")
    lines = [
        F.concat(F.lit(TITLE_LINE), or_default(F.col("title"), NO_TITLE)),
        F.concat(F.lit(ID_LINE), F.col("ticketId").cast("string")),
        F.concat(F.lit(DESCRIPTION_LINE), or_default(F.col("description"), NO_DESCRIPTION)),
        F.when(F.length(resolution) > 0, F.concat(F.lit(RESOLUTION_LINE), resolution)),
        F.when(
            F.size(context) > 0,
            F.concat(
                F.lit(CONTEXT_HEADING + "\n"), F.array_join(F.transform(context, _line), "\n")
            ),
        ),
        F.concat(
            F.lit(SOLUTION_HEADING),
            or_default(solution["author"]["role"], UNKNOWN_AUTHOR),
            F.lit(":"),
        ),
        F.coalesce(solution["content"], F.lit("")),
    ]
    if with_score:
        lines.append(F.concat(F.lit(SCORE_LINE), score_text(F.col("similarityScore"))))
    return F.concat_ws("\n", *lines)


def result_metadata() -> Column:
    return F.struct(
        F.col("ticketId").alias("ticket_id"),
        F.col("similarityScore").alias("similarity_score"),
        F.col("solutionComment.commentId").alias("solution_comment_id"),
        F.size("contextComments").alias("context_comment_count"),
    )
