"""The whole pipeline against each operator's brute force, and its contract."""

import random
from fractions import Fraction

import corpus_pipeline
from supportgraph.llm import packing
from tests.llm import test_decontaminate, test_mixing, test_simhash

SOUNDS = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["st", "rre", "ön", "ich"]}


def table():
    rng = random.Random(12)

    def text(label, n):
        return " ".join("".join(rng.choices(SOUNDS[label], k=3)) for _ in range(n))

    items = [(i, text("aa", 12)) for i in range(3)] + [(9, "stich rreön")]
    rows = []
    for i in range(150):
        label = rng.choice(["aa", "bb"])
        rows.append((i, text(label, rng.randrange(20, 90)), label, f"s{i % 4}" if i % 5 else "s0"))
    rows += [(200 + i, rows[i % 3][1].upper() if i % 2 else rows[i % 3][1], "aa", "s1") for i in range(30)]
    rows += [(300 + i, rows[50 + i][1] + " " + items[i][1].upper() + " " + rows[60 + i][1], "aa", "s2") for i in range(3)]
    rows += [(400, None, None, None), (401, "", "bb", "s1"), (402, "123 !", "aa", "s3"), (403, "x" * 9000, "aa", None)]
    return rows, items


def test_stages_equal_brute_force(spark, tmp_path):
    rows, items = table()
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    data = [(i, t, lang, s, len(t or ""), "own") for i, t, lang, s in rows]
    spark.createDataFrame(data, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if number < 4:
            assert docs.schema == spark.read.parquet(str(tmp_path / "documents.parquet")).schema
            kept.append(sorted((r.doc_id, r.text, r.source) for r in docs.collect()))
    texts = {r[0]: r for r in rows}
    assert {400, 401, 402}.isdisjoint({i for i, _, _ in kept[0]}) and len(kept[0]) > len(rows) - 8
    left = [(i, test_simhash.plain_fingerprint(t, 3)) for i, t, _ in kept[0]]
    firsts = sorted(set(test_simhash.plain_components(left, 3)))
    assert [i for i, _, _ in kept[1]] == firsts
    named = [(str(i), t) for i, t in items]
    clean = [i for i in firsts if not test_decontaminate.plain(texts[i][1], named, 10)[1]]
    assert [i for i, _, _ in kept[2]] == clean and len(clean) < len(firsts)
    source = [(i, t, s) for i, t, s in kept[2]]
    taken = test_mixing.brute(source, (5, 2, 1), Fraction(3, 2), 2)
    assert [i for i, _, _ in kept[3]] == sorted(source[k][0] for k, (_, _, n) in taken.items() for _ in range(n))
    decode = packing.encoder(packing.read_vocabulary(packing.VOCABULARY)).decode
    packed = docs.collect()
    total = sum(len(decode([int(t) for t in row[: r.n_tokens] if t != 50256])) for r, row in zip(packed, packing.matrix(packed, 2048)))
    assert total == sum(len(t) for _, t, _ in kept[3])
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(i for r in whole for i in r.doc_ids) == sorted(i for r in packed for i in r.doc_ids)


def test_stages_take_an_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), str(tmp_path)).collect() == []
