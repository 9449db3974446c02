import itertools
import random
import zlib

import numpy as np
import pytest

from merchlens.llm import langid

SYLLABLES = {
    "aa": ["ka", "lo", "mi", "ta", "nu", "re"],
    "bb": ["sch", "ung", "ein", "keit", "ver", "ü"],
    "cc": ["дом", "ра", "ко", "не", "ли", "ть"],
}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, lang, 80), lang) for i, lang in enumerate(list(SYLLABLES) * 60)]
    rows += [(None, "zzz", "aa"), (500, "qqq", None), (501, None, "bb")]
    return langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_held_out_accuracy(model):
    rng = random.Random(5)
    for lang in list(SYLLABLES) * 30:
        (found, share), *_ = langid.infer(model, prose(rng, lang, rng.choice([4, 20, 300])))
        assert found == lang and share > 0.9


def test_mixtures_have_their_proportions(model):
    rng = random.Random(6)
    text = prose(rng, "aa", 300) + ". " + prose(rng, "cc", 300)
    found = dict(langid.infer(model, text))
    letters = {k: len([c for c in part if c.isalpha()]) for k, part in zip(("aa", "cc"), text.split(". "))}
    assert set(found) == {"aa", "cc"} and abs(sum(found.values()) - 1) < 1e-9
    assert abs(found["aa"] - letters["aa"] / sum(letters.values())) < 0.03


def test_em_climbs_to_the_best_mixture(model):
    rng = random.Random(7)
    ids = langid.trigrams(prose(rng, "aa", 90) + " " + prose(rng, "bb", 60))
    p = model.probability[:2][:, ids]
    _, best = langid._em(p, np.ones(len(ids)), np.array([0.5, 0.5]))
    grid = max(float(np.log(s * p[0] + (1 - s) * p[1]).sum()) for s in np.linspace(0.001, 0.999, 999))
    assert best >= grid - 1e-2


def test_trigrams():
    assert len(langid.trigrams("ab c!! 12 D")) == 4  # one per letter
    assert (langid.trigrams("Ab  c") == langid.trigrams("aB--c")).all()
    assert len(langid.trigrams(None)) == len(langid.trigrams("12 !?")) == 0


def test_predictions_of_edge_rows(docs, model):
    rows = [(1, None, "aa"), (2, "", "aa"), (3, "12 + 4!", None), (4, "k", None), (5, "kalo" * 30_000, "bb"), (None, "kalo mita", None)]
    got = {r.doc_id: r for r in langid.predict(docs(rows), model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0.0 and got[1].mixture == {}
    assert got[5].lang_pred == got[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = langid.keep_determined(docs(rows), model)
    assert {r.doc_id for r in kept.collect()} == {4, 5, None} and kept.columns == docs(rows).columns
    assert langid.predict(docs([]), model).count() == 0


def test_nothing_to_learn_from(spark, docs):
    nothing = langid.fit(docs([(1, "text", None)]))
    assert langid.infer(nothing, "some text") == []
    assert langid.predict(docs([(1, "text")]), nothing).first().lang_pred == "und"


def test_held_out_rows_are_those_of_the_checksum(docs):
    rows = [(i, "x") for i in range(200)] + [(None, "x")]
    table = docs(rows)
    got = {r[0]: r[1] for r in table.select("doc_id", langid.held_out(table.doc_id)).collect()}
    assert got.pop(None) is False
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(200)}


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = langid.op1_language_mixture(spark, "/root/testdata/sf0.001").join(docs, "doc_id")
    held = got.filter("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)


def test_marks_alone_are_no_letters(model):
    for text in ("\u0301\u0301\u0301", " \u0301 12 \u20e3", "", None):
        assert langid.infer(model, text) == [] or not langid.infer(model, text)
    assert langid.infer(model, "ka\u0301lo mita nure")


def test_language_set_is_the_best_of_all_subsets(model):
    rng = random.Random(11)
    for _ in range(40):
        parts = [prose(rng, lang, rng.choice([0, 0, 3, 15, 60, 200])) for lang in SYLLABLES]
        text = ". ".join(rng.sample(parts, len(parts))) + " ka"
        ids = langid.trigrams(text)
        times = np.bincount(ids, minlength=model.probability.shape[1])
        buckets = np.flatnonzero(times)
        p, times = model.probability[:, buckets], times[buckets].astype(float)
        cost = langid.PENALTY * np.log(len(ids) + 1)
        values = {}
        for n in (1, 2, 3):
            for some in itertools.combinations(range(len(model.languages)), n):
                _, value = langid._em(p[list(some)], times, np.full(n, 1 / n))
                values[tuple(model.languages[i] for i in some)] = value - cost * (n - 1)
        found = tuple(sorted(lang for lang, _ in langid.infer(model, text)))
        assert values[found] >= max(values.values()) - 0.5, (found, values)
