"""Captures of web pages: not-modified revisits resolved to the response that they repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from supportgraph.llm.common import Own
from supportgraph.workspace import materialize

#: Header fields of a not-modified answer that must not replace those stored, because
#: they describe its own empty body or its own connection.
OWN_FIELDS = [
    "connection", "content-encoding", "content-length", "content-range", "content-type",
    "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer",
    "transfer-encoding", "upgrade",
]


def canonical_url(url: Column) -> Column:
    """The address under which captures count as of one page.

    Scheme and host in lower case, without the scheme's usual port, the fragment, and empty or
    ``utm_`` parameters; parameters sorted; an empty path is "/". Text without a scheme and host
    only loses its fragment and outer blanks.
    """
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    form = "^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([^?]*)(?:[?](.*))?$"
    scheme = F.lower(F.regexp_extract(plain, form, 1))
    host = F.lower(F.regexp_extract(plain, form, 2))
    usual = F.when(scheme == "http", ":80$").when(scheme == "https", ":443$").otherwise("[^\\s\\S]")
    path = F.regexp_extract(plain, form, 3)
    parameters = F.filter(
        F.split(F.regexp_extract(plain, form, 4), "&"), lambda p: (p != "") & ~p.startswith("utm_")
    )
    query = F.array_join(F.array_sort(parameters), "&")
    whole = F.concat(
        scheme, F.lit("://"), F.regexp_replace(host, usual, F.lit("")),
        F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
    )
    return F.when(scheme == "", plain).otherwise(whole)


def _fields(headers: Column) -> Column:
    """Header fields with names in lower case; of equal names the last counts; null is none."""
    entries = F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>"))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e.key)))
    return F.map_from_arrays(
        names, F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: F.lower(e.key) == n), -1).value)
    )


def _pairs(fields: Column) -> Column:
    return F.array_sort(F.map_entries(fields))


def _latest_response(captures: DataFrame) -> DataFrame:
    """``captures`` (_url, _ts, _answer: null unless a full response) with _found, the latest earlier answer.

    Captures are sorted by address and time over range partitions, so an address with any share of
    them lies in many partitions, and within each one a running maximum finds the answer. Of each
    partition only the last answers of addresses that go on in another are handed over: an address
    that does is the last of its partition, so they are no more than the partitions.
    """
    # Equal times of an address never lie in two partitions: what is handed over is earlier.
    parts = materialize(
        captures.repartitionByRange("_url", "_ts").withColumn("_part", F.spark_partition_id()), "captures"
    )
    crossing = (
        parts.filter("_url IS NOT NULL").groupBy("_part").agg(F.max("_url").alias("_url")).select("_url").distinct()
    )
    ends = (
        parts.select("_url", "_part", "_answer")
        .join(F.broadcast(crossing), "_url", "left_semi")
        .groupBy("_url", "_part")
        .agg(F.max("_answer").alias("_last"))
    )
    before = W.partitionBy("_url").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carried = materialize(
        ends.select("_url", "_part", F.max("_last").over(before).alias("_carried")).filter("_carried IS NOT NULL"),
        "carried",
    )
    earlier = W.partitionBy("_part", "_url").orderBy("_ts").rangeBetween(W.unboundedPreceding, -1)
    known = F.col("_url").isNotNull() & F.col("_ts").isNotNull()
    return (
        parts.withColumn("_own", F.max("_answer").over(earlier))
        .join(F.broadcast(carried), ["_url", "_part"], "left")
        .withColumn("_found", F.when(known, F.coalesce("_own", "_carried")))
        .drop("_own", "_carried", "_part")
    )


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Every record with canonical_url, outcome, source_id, status and merged headers.

    ``records``: record_id, url, date (timestamp), type ("response", "revisit" or another), status
    and headers (a map), besides any other columns, which stay. A revisit that answers "not modified"
    (status 304) is joined as of its date with the latest strictly earlier full response (type
    "response", status 200) of its canonical address; of several at that instant the one with the
    largest record_id counts.

    outcome: "full" for such a response; for a not-modified revisit "resolved", "no earlier
    response", "mismatch" or "no validator"; "not a 304" for any other revisit, such as one that had
    the same payload under an answer of its own, which keeps status and headers; "other" for records
    that are none of these. Validators are compared as a
    cache does: entity tags where both have one, weak or strong alike, else modification times
    where both have one. A resolved revisit has the id of its response, status 200, and the
    response's headers under those of the revisit, apart from fields that describe the revisit's own
    body or connection. Others keep their own, with names in lower case.

    A record without an address or a date finds nothing and is found by nothing. Null headers are
    none. Repeated rows are repeated in the result. Columns of ``records`` that have the result's
    names give way to it. An address may hold any share of the records, unless at one instant.
    """
    added = ["canonical_url", "outcome", "source_id", "status", "headers"]
    own = Own(records, added)
    fields = own.table.select(
        *own.columns, F.col(own["status"]).alias("status"), F.col(own["type"]).alias("type"),
        F.col(own["record_id"]).alias("record_id"), _fields(F.col(own["headers"])).alias("_fields"),
        canonical_url(F.col(own["url"])).alias("_url"), F.unix_micros(own["date"]).alias("_ts"),
    )
    is_revisit = F.coalesce(F.col("type") == "revisit", F.lit(False))
    not_modified = F.coalesce(F.col("status") == 304, F.lit(False))
    is_full = F.coalesce((F.col("type") == "response") & (F.col("status") == 200), F.lit(False))
    answer = F.struct("_ts", F.col("record_id").alias("id"), _pairs(F.col("_fields")).alias("pairs"))
    found = _latest_response(
        fields.withColumn("_answer", F.when(is_full & F.col("_ts").isNotNull() & F.col("_url").isNotNull(), answer))
    ).withColumn("_stored", F.map_from_entries("_found.pairs"))

    def both(name: str) -> tuple[Column, Column]:
        return F.col("_stored")[name], F.col("_fields")[name]

    old_tag, new_tag = (F.regexp_replace(F.trim(x), "^W/", "") for x in both("etag"))
    old_time, new_time = both("last-modified")
    same = F.coalesce(old_tag == new_tag, old_time == new_time)
    outcome = (
        F.when(is_full, "full").when(~is_revisit, "other").when(~not_modified, "not a 304")
        .when(F.col("_found").isNull(), "no earlier response").when(same, "resolved")
        .when(same.isNull(), "no validator").otherwise("mismatch")
    )
    resolved = F.col("outcome") == "resolved"
    newer = F.map_filter("_fields", lambda k, v: ~k.isin(OWN_FIELDS))
    kept = F.map_filter("_stored", lambda k, v: ~F.array_contains(F.map_keys(newer), k))
    merged = F.when(resolved, F.map_concat(kept, newer)).otherwise(F.col("_fields"))
    return own.restore(
        found.withColumn("outcome", outcome),
        F.col("_url").alias("canonical_url"),
        "outcome",
        F.when(resolved, F.col("_found.id")).alias("source_id"),
        F.when(resolved, F.lit(200)).otherwise(F.col("status")).alias("status"),
        merged.alias("headers"),
    )
