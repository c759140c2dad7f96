"""Own columns of any name come through every operator and stage unchanged and change nothing."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from supportgraph.llm import align, decontaminate, exact_dedup, langid, mixing, packing, quality, repair, secrets, simhash, urls, warc, wordpiece

#: Names that operators use for themselves or did, names that need quotes, and other letters of the
#: names that are read.
NAMES = [
    "_text", "_hash", "_salt", "_digest", "_shared", "_url", "_source", "_hot", "_cold", "_maybe", "_rows", "_least",
    "_copy", "_print", "_component", "_own_score", "_ts", "_answer", "_fields", "_part", "_fresh", "a.b", "a b", "a`b",
    "row", "rows", "digest", "found", "maybe", "copy", "shared", "print", "first", "least", "component", "id", "label",
    "place", "more", "names", "words_", "conv", "part", "chunk", "gone", "any", "own", "pair", "n", "TEXT", "Doc_ID",
]
RESULTS = {
    "spans", "n_words", "n_tokens", "ranges", "items", "lang_pred", "score", "rejected", "size", "source_size", "target",
    "copies", "taken", "keep_id", "group_size", "kept", "text_sha256", "canonical_url", "outcome", "source_id", "host",
    "path", "rule", "verdict", "words", "groups", "n_a", "n_best",
}

TEXTS = [
    "password = hunter22 and a the cat sat on the mat one two three four five", "", None, "über die straße gehen wir alle heute",
    "the cat sat on the mat one two three four five six", "the cat sat on the mat one two three four five six",
    "THE cat sat on the mat one two three four five six", "deadbeefdeadbeefdeadbeefdeadbeef", "ein zwei drei vier fünf sechs",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "de" if i in (3, 8) else "en", f"s{i % 3}") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "cat sat on the mat one two three four five"), (2, "drei vier")], "item_id long, text string")


def pages(docs):
    return docs.select(
        "doc_id", F.concat(F.lit("http://"), F.element_at(F.split(F.coalesce("text", F.lit("x")), " "), 1), F.lit(".com/en/")).alias("url"),
        F.col("text").alias("html"),
    )


def captures(docs):
    url, when = F.lit("http://a/"), F.timestamp_seconds(F.col("doc_id") * 60)
    kind = F.when(F.col("doc_id") % 2 == 0, "response").otherwise("revisit")
    return docs.select(
        "doc_id", F.col("doc_id").alias("record_id"), url.alias("url"), when.alias("date"), kind.alias("type"),
        F.when(kind == "response", 200).otherwise(304).alias("status"), F.create_map(F.lit("ETag"), F.lit("1")).alias("headers"),
    )


ROWS = {
    "secrets": lambda d, b: secrets.find_secrets(d),
    "decontaminate": lambda d, b: decontaminate.find_passages(d, b),
    "decontaminate parts": lambda d, b: decontaminate.find_passages(d, b, part_bytes=1),
    "langid": lambda d, b: langid.identify(d, langid.learn(d)),
    "mixing": lambda d, b: mixing.mix(d),
    "wordpiece": lambda d, b: wordpiece.count_tokens(d),
    "exact dedup": lambda d, b: exact_dedup.exact_dedup(d, keep=d.columns),
    "align": lambda d, b: align.align(d),
    "align counts": lambda d, b: align.align_and_count(d, frequent=2),
    "urls": lambda d, b: urls.judge(d, [("the.com", "/", "block")]),
    "warc": lambda d, b: warc.resolve_revisits(d),
    "mixed": lambda d, b: mixing.mixed(d),
    "clean": lambda d, b: decontaminate.remove_contaminated(d, b),
    "keep one": lambda d, b: simhash.keep_one(d),
}
OF = {"urls": pages, "warc": captures}


def with_own(df, skip=()):
    used = {c for c in df.columns}
    names = [n for n in [*NAMES, *sorted(RESULTS)] if n not in used and n not in skip]
    return df.select("*", *[F.concat(F.lit(f"{i}:"), F.col("doc_id").cast("string")).alias(n) for i, n in enumerate(names)]), names


@pytest.mark.parametrize("name", list(ROWS))
def test_rows_keep_their_own_columns(docs, items, name):
    plain = OF.get(name, lambda d: d)(docs)
    wide, names = with_own(plain)
    before, after = ROWS[name](plain, items), ROWS[name](wide, with_own(items.withColumnRenamed("item_id", "doc_id"))[0].withColumnRenamed("doc_id", "item_id"))
    results = [c for c in before.columns if c not in plain.columns]
    kept = [n for n in names if n.lower() not in {r.lower() for r in results}]
    expected = sorted(map(repr, before.toArrow().to_pylist()))
    rows = [{c: v for c, v in zip(after.columns, r)} for r in after.collect()]
    shown = {c for c in before.columns}
    arrow = after.select(*["`" + c.replace("`", "``") + "`" for c in before.columns if sum(x.lower() == c.lower() for x in after.columns) == 1])
    wanted = before.select(*arrow.columns)
    assert sorted(map(repr, arrow.toArrow().to_pylist())) == sorted(map(repr, wanted.toArrow().to_pylist()))
    assert len(expected) == len(rows) and shown <= set(after.columns)
    number = {n: i for i, n in enumerate(names)}
    at = {c: i for i, c in enumerate(after.columns)}
    for r in after.collect():
        for n in kept:
            assert r[at[n]] == f"{number[n]}:{r[at['doc_id']]}"


def test_those_that_take_id_and_text_alone(docs, items):
    wide, _ = with_own(docs)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    wide_labels, _ = with_own(labels)
    for run in (
        lambda d: simhash.near_duplicates(d), lambda d: packing.pack(d, length=16),
        lambda d: quality.classify(d, labels if d is docs else wide_labels, F.lit(True)),
    ):
        assert sorted(map(repr, run(wide).toArrow().to_pylist())) == sorted(map(repr, run(docs).toArrow().to_pylist()))


def test_conversations(docs):
    talk = docs.select((F.col("doc_id") % 3).alias("conv_id"), "doc_id", F.col("doc_id").alias("turn"), F.col("lang").alias("role"), "text")
    wide, _ = with_own(talk)
    for a, b in zip(vars(repair.repair(talk)).values(), vars(repair.repair(wide)).values()):
        assert sorted(map(repr, a.toArrow().to_pylist())) == sorted(map(repr, b.toArrow().to_pylist()))


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages(spark, docs, items, tmp_path, name, stage):
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    wide, names = with_own(docs)
    out = stage(spark, wide, str(tmp_path))
    assert out.columns == wide.columns
    at = {c: i for i, c in enumerate(out.columns)}
    rows = out.collect()
    assert rows and len(rows) == stage(spark, docs, str(tmp_path)).count()
    for r in rows:
        assert all(r[at[n]] == f"{i}:{r[at['doc_id']]}" for i, n in enumerate(names))
