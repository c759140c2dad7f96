"""Typing of columns that arrive as text. Bad text gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    IntegerType,
    StringType,
    TimestampType,
)

# The texts that mean true, in any case.
TRUE_TEXTS = ["true", "1", "yes"]


def parse_bool(text: Column) -> Column:
    """True for a true text, false for all else and for null."""
    return F.coalesce(F.lower(text).isin(TRUE_TEXTS), F.lit(False))


def parse_int(text: Column) -> Column:
    """Integer, with fractions cut off; blank and bad text give null."""
    return text.try_cast("double").try_cast("int")


# A time of day followed by a zone.
ZONED = r"(?i):\d{2}(\.\d+)?\s*(z|utc|gmt|[+-]\d|[a-z]+/[a-z_]+)"


def parse_datetime(text: Column) -> Column:
    """Timestamp from ``yyyy-MM-dd HH:mm:ss`` or ISO text. Text without a zone is in UTC, whatever
    the zone of the session."""
    text = F.trim(text)
    plain = text.try_cast("timestamp_ntz").cast("string")
    return F.when(text.rlike(ZONED), F.try_to_timestamp(text)).otherwise(
        F.try_to_timestamp(F.concat(plain, F.lit("+00:00")))
    )


def as_utc(local: Column) -> Column:
    """The instant at which a clock in UTC shows a time without a zone."""
    since = local.cast("timestamp_ntz") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")

    def part(unit: str) -> Column:
        return F.extract(F.lit(unit), since).cast("bigint")

    minutes = (part("DAY") * 24 + part("HOUR")) * 60 + part("MINUTE")
    seconds = (F.extract(F.lit("SECOND"), since) * 1_000_000).cast("bigint")
    return F.timestamp_micros(minutes * 60_000_000 + seconds)


def parse_vector(text: Column) -> Column:
    """Array of doubles from a JSON list; bad text gives null."""
    return F.from_json(text, "array<double>")


def typed(text: Column, kind: DataType) -> Column:
    """The parser that fits the target type."""
    if isinstance(kind, StringType):
        return text
    if isinstance(kind, BooleanType):
        return parse_bool(text)
    if isinstance(kind, IntegerType):
        return parse_int(text)
    if isinstance(kind, TimestampType):
        return parse_datetime(text)
    if isinstance(kind, ArrayType):
        return parse_vector(text)
    raise TypeError(f"no parser for {kind.simpleString()}")
