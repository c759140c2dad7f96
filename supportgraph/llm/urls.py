"""Addresses judged by rules and, where none fits, by the words of host and path."""

from __future__ import annotations

from collections.abc import Iterator
from math import log, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supportgraph.llm.common import Own, join_groups
from supportgraph.workspace import materialize

#: Rules that a call takes: they travel with the tasks. More are an error.
MOST_RULES = 100_000
#: The longest word a host is split into, and the longest host that is split: the domain name
#: system has none beyond it, so a longer text in that place keeps its runs of letters whole.
LONGEST_WORD, LONGEST_HOST = 24, 253
#: Cells of the classifier: tokens are counted under their hash, so the model has a fixed size.
CELLS = 1 << 18

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host with A-Z in lower case, and the path; both empty without an address or ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, _LETTERS, _LETTERS.lower()), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


class Rules:
    """Rules by host. The longest rule that fits counts, its host and path taken together; among
    rules of one length the one with the longer host, then the one listed first."""

    def __init__(self, rules: list[tuple[str, str, str]]) -> None:
        if len(rules) > MOST_RULES:
            raise ValueError(f"{len(rules)} rules; a call takes {MOST_RULES}")
        self.by_host: dict[str, dict[str, str]] = {}
        for host, path, verdict in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"rule {host}{path}: {verdict!r} is neither allow nor block")
            self.by_host.setdefault(host, {}).setdefault(path, verdict)
        self.lengths = {
            host: sorted({len(p) for p in paths}, reverse=True) for host, paths in self.by_host.items()
        }
        self.longest = max(map(len, self.by_host), default=0)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best, at = None, 0
        if len(host) > self.longest:  # names above a rule's host are not looked at
            at = host.find(".", len(host) - self.longest - 1) + 1 or len(host)
        while True:  # the host, then each domain above it
            name = host[at:]
            for length in self.lengths.get(name, ()):
                verdict = self.by_host[name].get(path[:length]) if length <= len(path) else None
                if verdict is not None:
                    if best is None or len(name) + length > len(best[0]):
                        best = name + path[:length], verdict
                    break
            at = host.find(".", at) + 1
            if not at:
                return best


def split_word(run: str, known: dict[str, int], total: int) -> list[str]:
    """The likeliest words of a run of letters (Viterbi over unigrams).

    A word of the counts has its share of all words as its probability. A piece that is none has
    less than any, and ten times less for every letter. Of equal splits the one whose last word is
    longest counts, so a run without known words stays whole, up to the longest word.
    """
    best, back = [0.0], [0]
    unseen = -log10(total + 1)
    for end in range(1, len(run) + 1):
        found, start = -np.inf, 0
        for at in range(max(0, end - LONGEST_WORD), end):
            n = known.get(run[at:end])
            score = best[at] + (log10(n / total) if n else unseen - (end - at))
            if score > found + 1e-9:
                found, start = score, at
        best.append(found)
        back.append(start)
    words, end = [], len(run)
    while end:
        words.append(run[back[end] : end])
        end = back[end]
    return words[::-1]


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """How often each word of a-z occurs in all texts: ``word, n``. What stands between angle
    brackets doesn't count, nor do words with other letters."""
    plain = F.regexp_replace(F.col(column), "<[^<>]*>", " ")
    words = texts.select(F.explode(F.split(F.lower(plain), "[^\\p{L}]+")).alias("word"))
    return words.filter(F.col("word").rlike(f"^[a-z]{{1,{LONGEST_WORD}}}$")).groupBy("word").agg(F.count("*").alias("n"))


def _names(host: Column) -> Column:
    """The host without its last label, which names no site, and without a port."""
    plain = F.rtrim(F.regexp_replace(host, ":[0-9]*$", ""), F.lit("."))
    return F.substring(plain, F.lit(1), F.length(plain) - F.length(F.substring_index(plain, ".", -1)) - 1)


def segment_hosts(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """``hosts`` (host, rows; a host once) with ``words``, stored.

    Every part of a host that could be a word is looked up among all counted words by a join, so
    no vocabulary is cut or sent around; the words found, no more than a host has parts, meet at
    their host, where the likeliest split is found. ``www`` and numbers are words like others.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    runs = F.regexp_extract_all(_names(F.col("host")), F.lit("[a-z]+"), F.lit(0))

    def parts(run: Column) -> Column:
        def starting(at: Column) -> Column:
            lengths = F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), F.length(run) - at + 1))
            return F.transform(lengths, lambda n: F.substring(run, at, n))

        return F.flatten(F.transform(F.sequence(F.lit(1), F.length(run)), starting))

    short = F.length("host") <= LONGEST_HOST
    pieces = materialize(
        hosts.filter(short).select("host", F.explode(F.array_distinct(F.flatten(F.transform(runs, parts)))).alias("word")),
        "pieces",
    )
    wanted = pieces.groupBy("word").agg(F.count("*").alias("hosts"))
    known = materialize(wanted.join(counts, "word"), "known")
    found = (
        join_groups(pieces, known, "word", "hosts", "host")
        .filter("n IS NOT NULL")
        .groupBy("host")
        .agg(F.collect_list(F.struct("word", "n")).alias("known"))
    )
    shares = hosts.join(found, "host", "left").select("host", "rows", runs.alias("runs"), short.alias("short"), "known")

    @F.arrow_udf("array<string>")
    def split(runs: pa.Array, short: pa.Array, known: pa.Array) -> pa.Array:
        out = []
        for own, fits, words in zip(runs.to_pylist(), short.to_pylist(), known.to_pylist()):
            seen = {x["word"]: x["n"] for x in words or ()}
            out.append([w for run in own for w in (split_word(run, seen, total) if fits else [run])])
        return pa.array(out, pa.list_(pa.string()))

    return materialize(shares.select("host", "rows", split("runs", "short", "known").alias("words")), "hosts")


def _cells(words: Column, host: Column, path: Column) -> Column:
    """The cells of an address's tokens: words of its host, numbers in it, runs of its path."""
    numbers = F.regexp_extract_all(_names(host), F.lit("[0-9]+"), F.lit(0))
    runs = F.regexp_extract_all(F.lower(path), F.lit("[\\p{L}]+|[0-9]+"), F.lit(0))

    def marked(kind: str, tokens: Column) -> Column:
        def cell(token: Column) -> Column:
            plain = F.when(token.rlike("^[0-9]+$"), "0").otherwise(token)
            return F.pmod(F.xxhash64(F.lit(kind), plain), F.lit(CELLS)).cast("int")

        return F.transform(tokens, cell)

    return F.concat(
        marked("host", F.coalesce(words, F.array().cast("array<string>"))), marked("host", numbers), marked("path", runs)
    )


def fit(labelled: DataFrame) -> tuple[float, np.ndarray]:
    """Multinomial naive Bayes from ``cells`` and ``verdict``: the log odds of block before any
    token, and those of each cell. Counts are raised by one. The table of counts has at most two
    rows a cell."""
    documents = dict(labelled.groupBy("verdict").agg(F.count("*")).collect())
    tokens = labelled.select("verdict", F.explode("cells").alias("cell"))
    counts = tokens.groupBy("verdict", "cell").agg(F.count("*").alias("n")).toArrow()
    table = {v: np.ones(CELLS) for v in ("allow", "block")}
    for verdict, cell, n in zip(*(counts.column(c).to_pylist() for c in ("verdict", "cell", "n"))):
        table[verdict][cell] += n
    before = log((documents.get("block", 0) + 1) / (documents.get("allow", 0) + 1))
    shares = {v: np.log(x / x.sum()) for v, x in table.items()}
    return before, shares["block"] - shares["allow"]


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    url: str = "url",
    content: str | None = "html",
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` of ``pages`` with host, path, rule, verdict, words and score.

    ``rules``: (host, path, "allow" or "block"). A rule fits its host and all hosts below it where
    the path begins with the rule's; the longest counts, see ``Rules``. Where none fits, the verdict
    is that of a multinomial naive Bayes classifier, learned from all addresses that a rule decides:
    "block" for a ``score`` (log odds of block) above zero. Its tokens are the words of the host,
    apart from the last label, and the runs of letters or digits of the path; every number is the
    same token. ``words`` are the host's words: runs of letters split by Viterbi over the counts of
    all words in ``content``; without such a column no run has known words.

    Null addresses and those without ``://`` have an empty host and path, and no tokens: the more
    frequent label decides, "allow" if none is. A host beyond 253 characters is not split. Repeated
    rows are repeated. An empty table gives an empty result. Columns with the result's names give
    way to it; others may have any name. One host may hold any share of the rows.
    """
    added = ["host", "path", "rule", "verdict", "words", "score"]
    own = Own(pages, added, keep)
    host, path = host_and_path(F.col(own[url]))
    table = Rules(rules)

    @F.arrow_udf("struct<rule:string,verdict:string>")
    def decide(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        found = [table.find(h, p) for h, p in zip(hosts.to_pylist(), paths.to_pylist())]
        kinds = pa.struct([("rule", pa.string()), ("verdict", pa.string())])
        return pa.array([{"rule": f[0], "verdict": f[1]} if f else {} for f in found], kinds)

    split = own.table.select(*own.columns, host.alias("host"), path.alias("path"))
    decided = materialize(split.withColumn("found", decide("host", "path")), "addresses")
    hosts = materialize(decided.groupBy("host").agg(F.count("*").alias("rows")), "names")
    if content is None:
        counts = pages.sparkSession.createDataFrame([], "word string, n bigint")
    else:
        counts = word_counts(own.table, own[content])
    words = segment_hosts(hosts, counts)
    rows = materialize(
        join_groups(decided, words, "host", "rows", "path").withColumn(
            "cells", _cells(F.col("words"), F.col("host"), F.col("path"))
        ),
        "tokens",
    )
    before, odds = fit(rows.filter("found.verdict IS NOT NULL").select("cells", F.col("found.verdict").alias("verdict")))
    shared = pages.sparkSession.sparkContext.broadcast(odds)

    @F.arrow_udf("double")
    def score(cells: pa.Array) -> pa.Array:
        sums = np.r_[0.0, np.cumsum(shared.value[cells.flatten().to_numpy()])]
        # Sums that should be zero may differ from it by the order of adding.
        ends = np.r_[0, np.cumsum(cells.value_lengths().to_numpy(zero_copy_only=False))].astype(int)
        return pa.array(np.round(before + sums[ends[1:]] - sums[ends[:-1]], 6))

    verdict = F.coalesce("found.verdict", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return own.restore(
        rows.withColumn("score", score("cells")),
        "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "words", "score",
    )
