"""The registered queries of these operators: whole tables in, digests of the results out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supportgraph.llm import align, decontaminate, exact_dedup, langid, mixing, packing, quality, repair, secrets, simhash, urls, warc, wordpiece
from supportgraph.llm.common import bound_batches, crc32

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    spans = F.col("spans")

    def count(kind: str):
        return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("bigint").alias(f"n_{kind}")

    def joined(column):
        return F.array_join(
            F.transform(column, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ","
        )

    base = F.filter(spans, lambda s: s.kind.isin("assign", "access", "hex"))
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(spans).alias("spans"),
    )


@query
def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=3)
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontaminate.find_passages(docs, items, window=10, keep=["doc_id"])
    n_hit = F.aggregate("ranges", F.lit(0).cast("bigint"), lambda n, r: n + r.end - r.first)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("ranges") > 0).alias("contaminated"),
    )


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), length=2048)


@query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc32(F.col("doc_id")) % 4 == 2, F.lit(False))
    model = langid.learn(docs.filter(~held_out).select("doc_id", "text", "lang"))
    found = langid.identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2)
    return mix.select("doc_id", "size", "source_size", "target", "taken")


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def captures(pages: DataFrame) -> DataFrame:
    """Capture records of every page: up to three dated full responses, the second under another tag,
    and revisits between and after them that vary by page.

    One revisit has the address in other letters and the tag in its weak form; some pages have a
    revisit with another page's tag, one before any response, one with a time and no tag, one with
    neither, one with the same payload under status 200 and one that is not found. A third of the
    pages are captured under one common address too, where every revisit has thousands of earlier
    responses.
    """
    page, url = F.col("page_id"), F.col("url")

    def tagged(*parts):
        return F.concat(F.lit('"'), F.md5(F.concat(*parts)), F.lit('"'))

    tag, second = tagged(F.col("html")), tagged(F.col("html"), F.lit("2"))
    modified, later = (F.concat(F.lit("day "), ((page + n) % 1000).cast("string")) for n in (0, 1))
    shouted = F.concat(F.upper(F.regexp_extract(url, "^[^/]*//[^/]*", 0)), F.regexp_replace(url, "^[^/]*//[^/]*", ""))

    def record(number, when, address, seconds, kind, status, **headers):
        entries = [F.struct(F.lit(k.replace("_", "-")).alias("key"), v.alias("value")) for k, v in headers.items()]
        return F.when(when, F.struct(
            (page * 16 + number).alias("record_id"), address.alias("url"),
            F.timestamp_seconds(F.lit(1_700_000_000) + page + seconds).alias("date"), F.lit(kind).alias("type"),
            F.lit(status).alias("status"), F.map_from_entries(F.array(*entries)).alias("headers"),
        ))

    every, day = F.lit(True), 86_400
    year = 365 * day
    length, none, html, common = F.octet_length("html").cast("string"), F.lit("0"), F.lit("text/html"), F.lit("http://all.example/")
    records = F.array(
        record(0, every, url, 0, "response", 200, ETag=tag, Last_Modified=modified, Content_Length=length,
               Content_Type=html, Cache_Control=F.lit("max-age=60")),
        record(1, every, F.concat(shouted, F.lit("#again")), year, "revisit", 304, ETag=F.concat(F.lit("W/"), tag),
               Cache_Control=F.lit("max-age=3600"), Content_Length=none),
        record(2, page % 3 == 0, url, 2 * year, "revisit", 304, ETag=F.concat(F.lit("x"), tag), Content_Length=none),
        record(3, page % 5 == 0, url, -year, "revisit", 304, ETag=tag),
        record(4, page % 7 == 0, url, 3 * year, "revisit", 304, Last_Modified=modified, Age=F.lit("9")),
        record(5, page % 11 == 0, url, 4 * year, "revisit", 304, Age=F.lit("9")),
        record(6, page % 2 == 0, url, 182 * day, "response", 200, ETag=second, Last_Modified=later, Content_Length=length,
               Content_Type=html, Cache_Control=F.lit("max-age=120")),
        record(7, page % 4 == 0, url, 200 * day, "response", 200, ETag=tag, Last_Modified=modified, Content_Length=length,
               Content_Type=html),
        record(8, page % 2 == 0, url, 190 * day, "revisit", 304, ETag=second, Content_Length=none),
        record(9, page % 13 == 0, url, 5 * day, "revisit", 200, ETag=tag, Content_Type=html, Content_Length=none),
        record(10, page % 17 == 0, url, 6 * day, "revisit", 404, ETag=tag, Content_Length=none),
        record(11, page % 3 == 1, common, 0, "response", 200, ETag=tag, Content_Length=length, Content_Type=html),
        record(12, page % 3 == 1, common, 1, "revisit", 304, ETag=tag, Content_Length=none),
        record(13, page % 3 == 1, common, 2, "revisit", 304, ETag=second, Content_Length=none),
    )
    return pages.select(F.explode(F.filter(records, lambda r: r.isNotNull())).alias("r")).select("r.*")


@query
def op8_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(captures(table(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e.key, F.lit(": "), e.value))
    return found.select(
        "record_id", F.floor(F.col("record_id") / 16).alias("page_id"), "canonical_url", "outcome", "source_id",
        "status", F.array_join(lines, "\n").alias("headers"),
    )


@query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep=["doc_id"])


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    remainder = crc32(F.col("doc_id")) % 3
    found = quality.classify(docs.select("doc_id", "text"), labels.select("doc_id", "quality"), remainder != 1)
    return found.select("doc_id", F.coalesce(remainder == 1, F.lit(False)).alias("held_out"), "score", "predicted")


# The rules of the query.
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


@query
def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES, keep=["page_id"]).select(
        "page_id", "host", "path", "rule", "verdict", F.array_join("words", " ").alias("words"), "score"
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by the CRC-32 of ``conv_id:turn``; dropped ones are marked ``gone``."""

    def plain(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(plain("text"), ".!?", "")).otherwise(plain("text"))
    rows = conversations.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(plain("role")).alias("role"), text.alias("text"),
        (fault == 0).alias("gone"), F.explode(F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1))).alias("copy"),
    )
    return rows.drop("copy")


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repair.repair(damaged(table(spark, sf_dir, "conversations")), gone="gone")
    digest = F.sha2(repair.lines(F.col("turns")).cast("binary"), 256).alias("repaired_sha256")
    whole = found.whole.select(F.col("conversation").alias("conv_id"), *repair.REPORT, "audit", digest)
    digests = repair.digest_in_order(found.pieces).withColumnRenamed("conversation", "of")
    long = found.long.join(digests, F.col("conversation").eqNullSafe(F.col("of"))).select(
        F.col("conversation").alias("conv_id"), *repair.REPORT, "audit", F.col("digest").alias("repaired_sha256")
    )
    return whole.unionByName(long)


@query
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_and_count(table(spark, sf_dir, "documents"), keep=["doc_id"])
