"""op1 cuts texts into tokens twice only: for the counts, and for the symbols that training and scoring read."""

import math

import numpy as np

from cartwalk.llm import lm


def _docs(spark):
    texts = ["the cat sat on the mat", None, "", "The dog " * 40, "rareword another " + "x" * 30, " \n ", "a b c d e f g"]
    return spark.createDataFrame([(i, texts[i % len(texts)]) for i in range(40)], "doc_id long, text string")


def test_texts_are_read_twice(spark, monkeypatch):
    docs, read = _docs(spark), []
    pair = lm._pair
    monkeypatch.setattr(lm, "_pair", lambda *a: read.append(1) or pair(*a))
    rows = lm.scores_digest(docs).collect()
    assert len(rows) == 40 and len(read) == 2


def test_symbol_texts_against_plain_counting(spark, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN", 6)
    monkeypatch.setattr(lm, "TOKENS_AT_ONCE", 7)
    docs = _docs(spark)
    counts = lm.stored(lm.token_counts(docs))
    vocab = lm.vocabulary(counts)
    texts = lm.symbol_texts(docs, vocab)
    of = {r["token"]: r["c"] for r in counts.collect()}
    model = lm.Model.start(vocab.symbol_counts, seed=3)
    got = {r["id"]: r for r in lm._model_logs(texts, model).collect()}
    symbols = {r["id"]: np.frombuffer(r["symbols"], "<i2") for r in texts.collect()}
    for r in docs.collect():
        tokens = [w.lower() for w in (r["text"] or "").split()] + [lm.END]
        g = got[r["doc_id"]]
        known = [t for t in tokens if t.encode() in vocab.known]
        assert symbols[r["doc_id"]].tolist() == [vocab.symbols.of(t.encode()) for t in tokens]
        assert g["n_tokens"] == len(tokens) and g["known"] == len(known)
        assert math.isclose(g["known_log"], sum(math.log10(of[t] + 1) for t in known), abs_tol=1e-9)
        assert sorted(zip(g["rare"], g["times"])) == sorted({t: tokens.count(t) for t in tokens if t not in known}.items())
        want = model.log_probs(*lm._windows([symbols[r["doc_id"]]], model.size)).sum() / math.log(10)
        assert math.isclose(g["model_log"], want, rel_tol=1e-6)


def test_normalisation_beyond_single_precision():
    rng = np.random.default_rng(2)
    m = lm.Model.start(rng.integers(1, 50, 40).astype(float))
    for shift in (0.0, 95.0, -120.0):
        m.b[:] = rng.normal(size=40) + shift
        target, ctx = rng.integers(0, 40, 900).astype(np.int16), rng.integers(0, 41, (lm.CONTEXT, 900)).astype(np.int16)
        s = m.context(ctx).astype(np.float64) @ m.Q.T.astype(np.float64) + m.b
        top = s.max(1, keepdims=True)
        want = s[np.arange(900), target] - top[:, 0] - np.log(np.exp(s - top).sum(1))
        assert np.allclose(m.log_probs(target, ctx), want, atol=1e-4)
