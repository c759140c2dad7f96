"""Subwords against slices, held-out accuracy on invented languages, and odd inputs."""

import random

import numpy as np
import pytest

from supportgraph.llm import langid

SOUNDS = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["st", "rre", "ön", "ich"], "cc": ["qua", "ño", "ez", "la"]}


def sentence(label, words, random):
    return " ".join("".join(random.choices(SOUNDS[label], k=3)) for _ in range(words)).capitalize() + "."


def table(n=400, words=40):
    rng = random.Random(4)
    labels = rng.choices([*SOUNDS], [6, 1, 1], k=n)
    return [(i, sentence(label, rng.randrange(1, words), rng), label, label) for i, label in enumerate(labels)]


def test_subwords_are_the_slices_of_words(monkeypatch):
    text = "Abc, é x12 " * 9 + "defghij"
    line = b" " + b" ".join(text.encode().translate(langid.LETTERS).split()) + b" "
    grams = [line[i : i + n] for n in langid.SIZES for i in range(len(line) - n + 1)]
    wanted = sum(b" " not in g[1:-1] for g in grams)
    whole = np.sort(np.concatenate(list(langid.subwords(text.encode()))))
    assert len(whole) == wanted
    monkeypatch.setattr(langid, "PIECE", 7)
    assert (np.sort(np.concatenate(list(langid.subwords(text.encode())))) == whole).all()


def test_held_out_accuracy_and_reruns(spark):
    rows = table()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(3)
    model = langid.learn(docs.filter("doc_id % 4 <> 2"))
    out = langid.identify(docs.filter("doc_id % 4 = 2"), model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score", "rejected"]
    found = out.collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.95
    assert np.mean([r.rejected for r in found]) < 0.05
    assert all(0 <= r.score <= 1 for r in found)
    again = langid.learn(docs.repartition(7).filter("doc_id % 4 <> 2"))
    assert (again.logits == model.logits).all() and again.reject_below == model.reject_below


def test_probabilities_are_calibrated(spark):
    rng = random.Random(8)
    noisy = [(i, t, rng.choice([*SOUNDS]) if i % 3 == 0 else label, s) for i, t, label, s in table(900)]
    docs = spark.createDataFrame(noisy, "doc_id long, text string, lang string, sure string")
    model = langid.learn(docs.filter("doc_id % 4 <> 2"))
    found = langid.identify(docs.filter("doc_id % 4 = 2"), model).collect()
    right = np.mean([r.lang == r.lang_pred for r in found])
    assert abs(right - np.mean([r.score for r in found])) < 0.12


@pytest.mark.parametrize("foreign", SOUNDS)
def test_a_language_not_learned_is_rejected(spark, foreign):
    rng = random.Random(5)
    learned = [label for label in SOUNDS if label != foreign]
    rows = [(i, sentence(label, rng.randrange(1, 40), rng), label) for i, label in enumerate(learned * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs.filter("doc_id % 4 <> 2"))
    assert model.reject_below > 1 / len(learned)
    kept = langid.identify(docs.filter("doc_id % 4 = 2"), model).collect()
    assert np.mean([r.rejected for r in kept]) < 0.02
    others = [(i, "щука жила под мостом у реки " * 3, foreign) for i in range(3)]
    strange = langid.identify(spark.createDataFrame(others, docs.schema), model).collect()
    assert all(r.lang_pred != "und" and r.rejected for r in strange)


def test_every_label_is_learned(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}q " * 9, f"l{i % 230:03d}") for i in range(1150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs, epochs=1)
    assert model.labels == [f"l{i:03d}" for i in range(230)] and model.logits.shape[1] == 230


def test_the_sample_is_bounded_by_rows(spark, monkeypatch):
    docs = spark.createDataFrame(table(), "doc_id long, text string, lang string, score string")
    monkeypatch.setattr(langid, "LEAST_ROWS", 5)
    seen = []
    monkeypatch.setattr(langid, "train", lambda samples, labels, **options: seen.append((samples, labels)))
    langid.learn(docs, most_rows=60)
    samples, labels = seen[0]
    assert labels == [*SOUNDS] and 30 < len(samples) < 90 and {s[0] for s in samples} == {0, 1, 2}
    with pytest.raises(ValueError, match="more than 2 labels"):
        langid.learn(docs, most_rows=10)


def test_odd_rows(spark):
    rows = [(1, None, "aa"), (2, "", "bb"), (3, "123 !? …", None), (None, "kalomi", "aa"), (5, "ñ", "cc"), (5, "ñ", "cc"), (6, "ka" * 700_000, "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs)
    found = langid.identify(docs, model).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.lang_pred == "und") == (r.text in (None, "", "123 !? …"))
        if r.lang_pred == "und":
            assert r.score == 0 and r.rejected
    none = langid.learn(docs.limit(0))
    assert [r.lang_pred for r in langid.identify(docs, none).collect()] == ["und"] * len(rows)
    assert langid.identify(docs.limit(0), model).collect() == []
    single = langid.learn(docs.filter("lang = 'aa' AND doc_id IS NOT NULL"))
    assert {r.lang_pred for r in langid.identify(docs, single).collect()} == {"und", "aa"}
