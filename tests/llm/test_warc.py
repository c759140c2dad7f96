"""Resolved revisits against a loop over all captures, and canonical addresses."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from supportgraph.llm.warc import OWN_FIELDS, canonical_url, resolve_revisits

SCHEMA = "record_id long, url string, date timestamp, type string, status int, headers map<string,string>, outcome string"


@pytest.mark.parametrize(
    "url,want",
    [
        ("HTTP://Example.COM:80/a?b=2&a=1#x", "http://example.com/a?a=1&b=2"),
        ("https://e.com:443", "https://e.com/"),
        ("https://e.com:80/?utm_source=x&&q", "https://e.com:80/?q"),
        ("https://e.com/A/?", "https://e.com/A/"),
        (" https://e.com?z=1 ", "https://e.com/?z=1"),
        ("no address#x", "no address"),
        ("", ""),
        (None, None),
    ],
)
def test_canonical_urls(spark, url, want):
    assert spark.createDataFrame([(url,)], "url string").select(canonical_url(F.col("url"))).first()[0] == want


def lower(headers):
    return {k.lower(): v for k, v in (headers or {}).items()}


def brute(rows):
    out = []
    for id, url, date, type, status, headers, _ in rows:
        own = lower(headers)
        if type == "response" and status == 200:
            out.append((id, "full", None, status, own))
            continue
        if type != "revisit":
            out.append((id, "other", None, status, own))
            continue
        if status != 304:
            out.append((id, "not a 304", None, status, own))
            continue
        earlier = [
            r for r in rows
            if None not in (url, date, r[1], r[2]) and r[1] == url and r[2] < date and r[3] == "response" and r[4] == 200
        ]
        if not earlier:
            out.append((id, "no earlier response", None, status, own))
            continue
        best = max(earlier, key=lambda r: (r[2], r[0]))
        stored, same = lower(best[5]), None
        for name in ("etag", "last-modified"):
            if same is None and name in stored and name in own:
                same = stored[name].removeprefix("W/") == own[name].removeprefix("W/")
        if same:
            merged = stored | {k: v for k, v in own.items() if k not in OWN_FIELDS}
            out.append((id, "resolved", best[0], 200, merged))
        else:
            out.append((id, "no validator" if same is None else "mismatch", None, status, own))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_equals_brute_force(spark, parts):
    random.seed(parts)
    start, rows = datetime.datetime(2024, 1, 1), []
    for i in range(500):
        url = "http://hot/" if random.random() < 0.5 else random.choice(["http://a/", "http://b/", "http://z/", None])
        date = None if random.random() < 0.03 else start + datetime.timedelta(seconds=random.randrange(150))
        headers = {"Content-Length": str(i), "X-Own": str(i)}
        headers |= {"ETag": random.choice(['"1"', 'W/"1"', '"2"'])} if random.random() < 0.6 else {}
        headers |= {"LAST-MODIFIED": random.choice("xy")} if random.random() < 0.5 else {}
        kind = random.choice(["response", "revisit", "revisit", "request", None])
        rows.append((i, url, date, kind, random.choice([200, 304, 304, 404, None] if kind == "revisit" else [200, 200, 404, 304, None]), random.choice([headers, headers, None]), "x"))
    rows.append(rows[7])
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        out = resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    got = [(r.record_id, r.outcome, r.source_id, r.status, r.headers) for r in out]
    assert sorted(((*g[:4], dict(sorted(g[4].items()))) for g in got), key=str) == sorted(
        ((*w[:4], dict(sorted(w[4].items()))) for w in brute(rows)), key=str
    )


def test_only_a_304_is_resolved(spark):
    day = datetime.datetime(2024, 1, 1)
    rows = [(0, "http://a/", day, "response", 200, {"ETag": "1", "Content-Type": "text/html"}, None)]
    rows += [(i, "http://a/", day + datetime.timedelta(i), "revisit", status, {"ETag": "1", "Content-Type": "own"}, None) for i, status in [(1, 304), (2, 404), (3, 200)]]
    got = {r.record_id: r for r in resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[1].outcome, got[1].status, got[1].headers["content-type"]) == ("resolved", 200, "text/html")
    for i, status in [(2, 404), (3, 200)]:
        assert (got[i].outcome, got[i].status, got[i].headers["content-type"], got[i].source_id) == ("not a 304", status, "own", None)


def test_equal_header_names_and_empty(spark):
    row = (1, "http://a/", None, "other", 1, {"A": "1", "a": "2"}, None)
    records = spark.createDataFrame([row], SCHEMA)
    assert resolve_revisits(records).first().headers in ({"a": "2"}, {"a": "1"})
    assert resolve_revisits(records.limit(0)).collect() == []
