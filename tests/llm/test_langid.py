"""Language identification: held-out accuracy, mixtures, edges."""
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartwalk.llm import langid, registry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return langid.fit(docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))


def test_op13_query_held_out_accuracy(spark, docs):
    got = {r["doc_id"]: r for r in registry.QUERIES["op13_language_id"](spark, SF).collect()}
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert got.keys() == lang.keys() and all(0 <= r["score"] <= 1 for r in got.values())
    held = [k for k in got if zlib.crc32(str(k).encode()) % 4 == 2]
    assert {k for k, r in got.items() if r["held_out"]} == set(held) and len(held) > 200
    assert sum(got[k]["lang_pred"] == lang[k] for k in held) >= 0.99 * len(held)


def test_counts_are_those_of_all_words(spark, docs, model):
    some = docs.select("lang", "text").limit(50)
    got = langid.fit(some)
    for lang in got.langs:
        words = Counter()
        for r in some.filter(F.col("lang") == lang).collect():
            words.update(langid.letter_words(r["text"].encode()))
        want = np.zeros(sum(langid.TABLES), np.int64)
        langid._add(want, words)
        k = got.langs.index(lang)
        assert (np.concatenate([got.one[k], got.two[k], got.three[k]]) == want).all()
        assert got.one[k].sum() == sum((len(w) + 1) * n for w, n in words.items()) == got.two[k].sum() == got.three[k].sum()


def test_mixtures_of_two(docs, model):
    held = docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).filter("n_chars > 2000")
    by = {lang: [r["text"].split() for r in held.filter(F.col("lang") == lang).limit(12).collect()] for lang in model.langs}
    rnd = np.random.default_rng(0)
    right = total = 0
    for a in model.langs:
        for b in model.langs:
            if a < b:
                for x, y in zip(by[a], by[b]):
                    part = rnd.integers(60, 140)
                    words = Counter(langid.letter_words(" ".join(x[:part] + y[:200 - part]).encode()))
                    share = dict(zip(model.langs, langid.mixtures(model, [words])[0]))
                    total += 1
                    right += {k for k, v in share.items() if v > 0.1} == {a, b} and abs(share[a] - part / 200) < 0.15
    assert total >= 40 and right >= 0.9 * total


def test_em_raises_the_likelihood_and_screening_changes_nothing(docs, model, monkeypatch):
    rows = [langid.letter_words(r["text"].encode()) for r in docs.limit(60).collect()]
    rows += [rows[k] + rows[k + 1] for k in range(0, 58, 2)]
    got = langid.mixtures(model, rows)
    assert np.allclose(got.sum(1), 1) and (got >= 0).all()
    monkeypatch.setattr(langid, "CELLS", 4000)  # in many small parts
    assert np.allclose(langid.mixtures(model, rows), got, atol=1e-3)
    assert ((got > 0).sum(1) >= 1).all() and ((got > 0).sum(1) == 2).any()


def test_edges(spark, model):
    long_text = "the and of " * 600_000
    rows = [(1, "the of and this", "x", 5), (2, None, "x", 5), (3, "", "x", 5), (4, "12 ² -- !", "x", 5), (1, "the of and this", "x", 5), (None, "der die und nicht", "x", 5), (6, long_text, "x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, `a.b` int")
    out = langid.identify(df, model)
    assert out.columns == ["doc_id", "text", "a.b", "lang_pred", "score", "languages"]
    got = sorted((r["doc_id"] or 0, r["lang_pred"], r["score"] > 0, len(r["languages"])) for r in out.collect())
    assert got == [(0, "de", True, 1), (1, "en", True, 1), (1, "en", True, 1), (2, "und", False, 0), (3, "und", False, 0), (4, "und", False, 0), (6, "en", True, 1)]
    assert langid.identify(df.limit(0), model).collect() == []
    nothing = langid.fit(spark.createDataFrame([(None, "a"), ("en", None)], "lang string, text string"))
    assert nothing.langs == [] and {r["lang_pred"] for r in langid.identify(df, nothing).collect()} == {"und"}
    one = langid.fit(spark.createDataFrame([("en", ""), ("de", "der")], "lang string, text string"))
    assert one.langs == ["de", "en"] and langid.identify(df.filter("doc_id = 1"), one).first()["score"] > 0
    with pytest.raises(ValueError):
        langid.fit(spark.range(langid.MAX_LANGS + 1).select(F.col("id").cast("string").alias("lang"), F.lit("a").alias("text")))
