"""Mixing sources to target weights by thresholds on a hash, found from histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from supportgraph.llm.common import Own, WORD, join_groups
from supportgraph.workspace import materialize

ADDED = ["size", "source_size", "target", "copies", "taken"]
#: Hexadecimal digits of the hash that one histogram tells apart: 4,096 buckets a source.
DIGITS = 3


def _source_key(source: str) -> Column:
    """A key that is never null and sorts null last."""
    return F.when(F.col(source).isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), F.col(source).cast("string")))


def sized(docs: DataFrame, id: str, text: str, source: str) -> DataFrame:
    """``docs`` with size in words, the source's key and the row's hash (MD5 of id and text)."""
    named = F.concat(F.coalesce(F.col(id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return docs.withColumns(
        {
            "size": F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint"),
            "_source": _source_key(source),
            "_hash": F.md5(named.cast("binary")),
        }
    )


def targets(sources: DataFrame, weights: Sequence[float], share: float, most: int) -> DataFrame:
    """``sources`` (_source, source_size) with the words each is to give.

    Sources in code point order take the weights in turn and share ``share`` of all words. A target
    stops at ``most`` times its source; the excess goes to the others by weight until none is above.
    Sorted by the level at which they fill up, the full sources come first, so running sums give the
    level of the rest. There is a row per source, so these windows are small.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("_rank", F.lit(len(weights))) + 1)
    ranked = sources.withColumn("_rank", (F.row_number().over(W.orderBy("_source")) - 1).cast("int")).withColumns(
        {"_weight": weight, "_cap": (F.col("source_size") * most).cast("double")}
    )
    fill = W.orderBy(F.col("_cap") / F.col("_weight"), "_source")
    before, everything = fill.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    )
    filled = ranked.withColumns({"_level": level, "_order": F.row_number().over(fill)})
    below = F.when(F.col("_cap") / F.col("_weight") > F.col("_level"), F.col("_level"))
    rest = F.first(below, ignorenulls=True).over(W.partitionBy().orderBy("_order").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    target = F.least("_cap", F.coalesce(rest * F.col("_weight"), F.col("_cap")))
    return filled.withColumn("target", F.round(target, 6)).select(*sources.columns, "target")


def thresholds(keyed: DataFrame, weights: Sequence[float], share: float, most: int) -> DataFrame:
    """Per source: rows, source_size, target, whole and upto.

    Every document of a source is taken ``whole`` times, and once more if its hash is below
    ``upto``. The words by source and hash bucket give the bucket in which the running sum reaches
    what is missing; only that bucket's rows are looked at again, by the next digits of the hash,
    until it holds one hash. The threshold lies after this hash or before it, whichever is nearer.
    """
    sources = materialize(
        keyed.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), "sources"
    )
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    planned = materialize(
        targets(sources, weights, share, most)
        .withColumn("whole", F.least(copies, F.lit(most)).cast("int"))
        .withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size")),
        "targets",
    )
    border = planned.filter("missing > 0").select(
        "_source", "missing", F.lit("").alias("prefix"), F.lit(0).cast("bigint").alias("before")
    )
    found = None
    for digits in range(DIGITS, 32 + DIGITS, DIGITS):
        inner = border.withColumnRenamed("before", "_outer").select("_source", "prefix", "missing", "_outer")
        rows = keyed.withColumn("prefix", F.substring("_hash", 1, digits - DIGITS))
        histogram = (
            rows.join(inner, ["_source", "prefix"])
            .groupBy("_source", "missing", "_outer", F.substring("_hash", 1, digits).alias("bucket"))
            .agg(F.sum("size").alias("words"), F.min("_hash").alias("low"), F.max("_hash").alias("high"))
        )
        running = F.col("_outer") + F.sum("words").over(W.partitionBy("_source").orderBy("bucket"))
        border = materialize(
            histogram.withColumn("_sum", running)
            .filter(F.col("_sum") >= F.col("missing"))
            .groupBy("_source")
            .agg(F.min_by(F.struct(
                "missing", F.col("bucket").alias("prefix"), (F.col("_sum") - F.col("words")).alias("before"),
                "words", "low", "high"), "bucket").alias("b"))
            .select("_source", "b.*"),
            "border",
        )
        single = border.filter("low = high")
        nearer = F.col("before") + F.col("words") - F.col("missing") < F.col("missing") - F.col("before")
        ends = single.select("_source", F.when(nearer, F.concat("low", F.lit("~"))).otherwise(F.col("low")).alias("upto"))
        found = ends if found is None else found.unionByName(ends)
        border = border.filter("low <> high")
        if border.isEmpty():
            break
    return materialize(
        planned.join(found, "_source", "left").select("_source", "rows", "source_size", "target", "whole", "upto"),
        "thresholds",
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target, copies and taken.

    size: words of the text, zero for null. copies: how often the mix takes the row, from zero to
    ``most``; taken = copies * size. A source's taken words differ from its target by at most half
    the size of one document (or of the rows that repeat it). Which rows are taken depends on their
    id and text alone: reruns agree, and a larger budget takes all that a smaller one takes.

    Nothing is sorted and no text is shuffled: two scans, histograms summed in the map tasks, and a
    comparison with the source's threshold. A source may hold any share of the rows.

    Null sources are one source, the last. A source without words has target zero and gives
    nothing. Columns of ``docs`` with the result's names give way to it, others may have any name.
    Empty in, empty out.
    """
    own = Own(docs, ADDED)
    rows = sized(own.table, own[id], own[text], own[source])
    keyed = materialize(rows.select("_source", "_hash", "size"), "sizes")
    limits = thresholds(keyed, weights, share, most)
    joined = join_groups(rows, limits, "_source", "rows", "_hash")
    more = F.coalesce((F.col("_hash") < F.col("upto")).cast("int"), F.lit(0))
    return (
        joined.withColumn("copies", F.col("whole") + more)
        .withColumn("taken", F.col("copies") * F.col("size"))
        .transform(own.restore, *ADDED)
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them."""
    own = Own(docs, [])
    names = {name: own[options.get(name, given)] for name, given in (("id", "doc_id"), ("text", "text"), ("source", "source"))}
    out = mix(own.table, **options | names)
    repeats = F.explode(F.array_repeat(F.lit(0), F.col("copies")))
    return own.restore(out.select(*own.columns, repeats.alias("copy")))
