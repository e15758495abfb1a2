"""Stemmer, tokenizer and all-pairs similarity against brute force."""

import numpy as np
import pytest

from cartwalk.functions.stemmer import stem_word
from cartwalk.operators import text as TX


@pytest.mark.parametrize("word,stem", [
    ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"),
    ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"),
    ("happy", "happi"), ("relational", "relat"), ("generalizations", "gener"), ("oscillators", "oscil"),
    ("triplicate", "triplic"), ("hopeful", "hope"), ("adjustment", "adjust"), ("controll", "control"),
])
def test_porter(word, stem):
    assert stem_word(word) == stem


def test_all_pairs_matches_brute_force(spark):
    rows = [(1, "t1", 0, 2), (1, "t2", 1, 1), (2, "t1", 0, 1), (2, "t3", 2, 3), (3, "t2", 1, 4),
            (4, "t3", 2, 1), (4, "t4", 3, 1), (5, "t4", 3, 2)]
    dv = spark.createDataFrame(rows, "item_id long, term string, term_id long, tf long")
    got = {(r.item_a, r.item_b): r.sim for r in TX.all_pairs_cosine(dv, block_rows=2, vocab_size=4).collect()}
    X = np.zeros((5, 4))
    for i, _, t, tf in rows:
        X[i - 1, t] += tf
    Xn = X / np.linalg.norm(X, axis=1, keepdims=True)
    S = Xn @ Xn.T
    want = {(a + 1, b + 1): S[a, b] for a in range(5) for b in range(5) if S[a, b] > 0.1}
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v)


def test_tokens_whole_text(spark):
    text = " ".join(["palabra"] * 30000) + " última"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    toks = TX.tokens(df, ["doc_id"])
    assert toks.count() == 30001
    assert toks.orderBy("pos", ascending=False).first()["token"] == "última"


def test_token_arrays_stay_where_texts_are_read(spark):
    from cartwalk.operators import text as TX
    texts = [(1, "Uno dos dos de tres"), (2, "dos cuatro"), (1, "uno cinco"), (3, None), (4, "de la"), (None, "tres"), (None, "tres dos")]
    docs, stop = spark.createDataFrame(texts, "doc_id long, text string"), ["de", "la"]
    toks = TX.remove_stop_words(TX.tokens(docs, ["doc_id"]), stop)
    want = {r.doc_id: sorted(r.t) for r in toks.groupBy("doc_id").agg({"token": "collect_list"}).toDF("doc_id", "t").collect()}
    rows = TX.token_arrays(docs, "doc_id", stop).collect()
    assert {r.doc_id: sorted(r.tokens) for r in rows} == want and len(rows) == len(want)
    plan = TX.token_arrays(docs.filter("doc_id > 1"), "doc_id", stop)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
