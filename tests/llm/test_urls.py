"""Address verdicts against rules, splits and counts worked out one by one."""

import random
import re
from collections import Counter
from itertools import product
from math import log, log10

import pytest
from pyspark.sql import functions as F

from supportgraph.llm import urls
from supportgraph.llm.queries import URL_RULES, op11_url_filter


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match("[^?#]*", rest[len(host) :])[0]


def plain_rule(host, path, rules):
    fits = [
        (len(h) + len(p), len(h), -i, h + p, v)
        for i, (h, p, v) in enumerate(rules)
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fits)[3:] if fits else (None, None)


def name_of(host):
    return ".".join(re.sub(":[0-9]*$", "", host).rstrip(".").split(".")[:-1])


def plain_tokens(host, path, counts, total):
    name = name_of(host)
    words = [w for run in re.findall("[a-z]+", name) for w in urls.split_word(run, counts, total)]
    found = [("host", w) for w in words] + [("host", "0") for _ in re.findall("[0-9]+", name)]
    for run in re.findall(r"[^\W\d_]+|[0-9]+", path.lower()):
        found.append(("path", "0" if run.isdigit() else run))
    return words, found


def plain_judge(rows, rules):
    counts = Counter()
    for _, html in rows:
        for word in re.split(r"[\W\d_]+", re.sub("<[^<>]*>", " ", html or "").lower()):
            if re.fullmatch("[a-z]{1,24}", word):
                counts[word] += 1
    total, out, seen, labels = sum(counts.values()), [], {"allow": Counter(), "block": Counter()}, Counter()
    for url, _ in rows:
        host, path = plain_parts(url)
        rule, verdict = plain_rule(host, path, rules)
        words, tokens = plain_tokens(host, path, counts, total)
        out.append((url, host, path, rule, verdict, words, tokens))
        if verdict:
            labels[verdict] += 1
            seen[verdict].update(tokens)
    sums = {v: sum(c.values()) + urls.CELLS for v, c in seen.items()}

    def odds(token):
        return log((seen["block"][token] + 1) / sums["block"]) - log((seen["allow"][token] + 1) / sums["allow"])

    before, done = log((labels["block"] + 1) / (labels["allow"] + 1)), []
    for url, host, path, rule, verdict, words, tokens in out:
        score = before + sum(odds(t) for t in tokens)
        done.append((url, host, path, rule, verdict or ("block" if score > 5e-7 else "allow"), words, round(score, 4)))
    return done


def test_splits_are_the_likeliest():
    random.seed(1)
    for _ in range(150):
        counts = {"".join(random.choices("ab", k=random.randrange(1, 5))): random.randrange(1, 50) for _ in range(6)}
        total, run = sum(counts.values()), "".join(random.choices("abc", k=random.randrange(1, 9)))

        def worth(words):
            return sum(log10(counts[w] / total) if w in counts else -log10(total + 1) - len(w) for w in words)

        best = -1e9
        for cuts in product([0, 1], repeat=len(run) - 1):
            parts = re.split(" ", "".join(c + (" " if cut else "") for c, cut in zip(run, (*cuts, 0))))
            best = max(best, worth(parts))
        found = urls.split_word(run, counts, total)
        assert "".join(found) == run and worth(found) == pytest.approx(best)
    assert urls.split_word("cheappills", {"cheap": 3, "pills": 2, "heap": 9}, 99) == ["cheap", "pills"]
    assert urls.split_word("x" * 63, {}, 0)


def test_rules():
    rules = [*URL_RULES, ("example.org", "", "block"), ("b.example.org", "/a", "allow"), ("example.org", "/longer/a", "block")]
    table = urls.Rules(rules)
    random.seed(2)
    for _ in range(3000):
        host = ".".join(random.choices(["www", "example", "com", "net", "org", "b", ""], k=random.randrange(5)))
        path = "".join(random.choices(["/en/", "/es/", "/a", "/longer", "/", "x"], k=random.randrange(4)))
        assert (table.find(host, path) or (None, None)) == plain_rule(host, path, rules)
    assert table.find("a." * 500_000 + "com", "/")[0] == "com/"
    with pytest.raises(ValueError):
        urls.Rules([("a", "/", "maybe")])


def rows_of(n):
    random.seed(n)
    sites = ["cheappills", "WWW.Example", "freebets", "blog.thesun", "a-b2", "m.tion", "", "é"]
    urls_ = [None, "", "no address", "://", "http://", "x://HOST", "http://a.com:80/en/?q=/fr/#z", "http://com", "ftp://com./"]
    urls_ += [
        f"http{random.choice(['', 's'])}://{random.choice(sites)}.{random.choice(['com', 'net', 'org', 'example.com'])}"
        f"{random.choice(['', '/en/', '/es/1', '/fr/x-y', '/de/Été/22', '/en'])}{random.choice(['', '?a=://b', '#c'])}"
        for _ in range(n)
    ]
    urls_ += ["http://" + "thesun" * 40_000 + ".org/" + "/en" * 40_000, *["http://hot.net/en/1"] * n]
    html = ["<p class='cheap'>the sun, Cheap pills; free bets été</p><<a <b> bets", None, "", "<" * 50_000, "a b tion"]
    return [(u, html[i % len(html)]) for i, u in enumerate(urls_)]


def test_whole_table(spark):
    rows = rows_of(120)
    docs = spark.createDataFrame([(u, h, "own") for u, h in rows], "url string, html string, `a.b` string")
    docs = docs.withColumn("Host", F.lit(1)).withColumn("found", F.lit(2)).withColumn("word", F.lit(3))
    out = urls.judge(docs, URL_RULES)
    assert out.columns == ["url", "html", "a.b", "found", "word", "host", "path", "rule", "verdict", "words", "score"]
    got = out.collect()
    assert {(r["a.b"], r["found"], r["word"]) for r in got} == {("own", 2, 3)}
    found = Counter((r.url, r.host, r.path, r.rule, r.verdict, tuple(r.words), round(r.score, 4)) for r in got)
    want = plain_judge(rows, URL_RULES)
    # A host longer than any keeps its runs whole: worked out here without splitting.
    assert sum(found.values()) == len(want)
    short = [x for x in want if len(x[1]) <= urls.LONGEST_HOST]
    assert Counter((*x[:5], tuple(x[5]), x[6]) for x in short) == Counter({k: n for k, n in found.items() if len(k[1]) <= 253})
    assert [k[5] for k in found if len(k[1]) > 253] == [("thesun" * 40_000,)]


def test_empty_table_and_no_words(spark):
    schema = "url string, html string"
    assert urls.judge(spark.createDataFrame([], schema), URL_RULES).collect() == []
    rows = spark.createDataFrame([("http://ab.org/x", "ab")] * 2, schema)
    assert {(r.verdict, r.rule, tuple(r.words)) for r in urls.judge(rows, [], content=None).collect()} == {
        ("allow", None, ("ab",))
    }


def test_query_against_counts_one_by_one(spark):
    sf = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("url", "html").collect()
    want = plain_judge([tuple(r) for r in pages], URL_RULES)
    got = op11_url_filter(spark, sf).collect()
    assert Counter((x[1], x[2], x[3], x[4], " ".join(x[5])) for x in want) == Counter(
        (r.host, r.path, r.rule, r.verdict, r.words) for r in got
    )
