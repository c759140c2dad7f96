"""Ranks over groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supportgraph.workspace import materialize


def rank_in_group(
    df: DataFrame, group: str, order: list[Column], out: str = "rank", cuts: list[Column] | None = None
) -> DataFrame:
    """Number the rows of each group from 1 in the given order, which must have no ties.

    Rows are range-partitioned by group and order, so a large group lies in many tasks. Each task
    numbers its own rows and adds the row counts of the parts of the group that come before.
    ``cuts`` are columns that rise with the order and by which the ranges are cut instead, where the
    values of ``order`` are long.
    """
    part = "__part"
    sliced = materialize(
        df.repartitionByRange(F.col(group), *(cuts or order)).withColumn(part, F.spark_partition_id()),
        "ranked",
    )
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(group, part)
        .agg(F.count("*").alias("__n"))
        .withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .select(F.col(group).alias("__group"), F.col(part).alias("__of"), "__offset")
    )
    same = F.col(group).eqNullSafe(F.col("__group")) & (F.col(part) == F.col("__of"))
    inside = Window.partitionBy(group, part).orderBy(*order)
    return (
        sliced.withColumn("__place", F.row_number().over(inside))
        .join(offsets, same)
        .withColumn(out, F.col("__place") + F.col("__offset"))
        .drop(part, "__place", "__offset", "__group", "__of")
    )
