"""The memo of encoded words: each word is looked up once, special tokens are searched for once a group."""

import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from cartwalk.llm import bpe, lm
from cartwalk.llm.tokenfiles import LibraryEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_words_met_before_are_not_looked_up_again():
    class Counting(dict):
        asked = 0

        def __getitem__(self, k):
            Counting.asked += 1
            return super().__getitem__(k)
    memo = bpe.Memo(lambda words: (np.array([len(w) for w in words], np.int32), np.ones(len(words), np.int64)))
    memo.index = Counting()
    words = [b"a", b"bb", b"a", b"ccc"] * 50
    assert memo.encode(words)[0].tolist() == [1, 2, 1, 3] * 50
    Counting.asked = 0
    ids, n = memo.encode(words + [b"dddd", b"a", b"dddd"])
    assert ids.tolist() == [1, 2, 1, 3] * 50 + [4, 1, 4] and n.tolist() == [1] * 203
    assert Counting.asked <= 2
    ids, n = memo.encode([])
    assert len(ids) == 0 and len(n) == 0


def test_special_tokens_are_searched_for_once_a_group():
    codec = bpe.Codec(bpe.load(PATH))

    class Searched:
        times = 0

        def search(self, s):
            Searched.times += 1
            return re.search("<nothing>", s)
    codec.apart = Searched()
    codec.encode(" ".join(f"word{i} x{i}," for i in range(500)).encode())
    assert Searched.times == 1


def test_odd_texts_equal_the_library():
    special = next(iter(bpe.load(PATH)["special"]))
    texts = ["", " \n ", f"a{special}b {special} c", f"plain words {special}{special}", "it's we'LL don't", "É é ́x ΑΣ Σ İ ﬁ",
             "a b   c　d", "x" * 300, "1234 12.5 ...!?", "日本語 テスト 🙂🙂", "one two one two"]
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    with open(PATH, encoding="utf-8") as f:
        encoder = LibraryEncoder(bpe.load(PATH), f.read())
    for codec in (bpe.Codec(bpe.load(PATH)), encoder):
        for _ in range(2):
            assert [x.tolist() for x in codec.encode_batch([t.encode() for t in texts])] == want


def test_words_survive_a_full_memo():
    """A memo that is full begins anew beside its last half: words met again are taken over, not encoded again."""
    asked = []

    def encode(words):
        asked.extend(words)
        return np.array([len(w) for w in words for _ in range(2)], np.int32), np.full(len(words), 2, np.int64)
    memo = bpe.Memo(encode, limit=2 * 10 * (bpe.ENTRY_BYTES + 4))
    for k in range(20):
        words = [b"often", b"always"] + [b"x%d" % i for i in range(4 * k, 4 * k + 4)]
        ids, n = memo.encode(words)
        assert ids.tolist() == [len(w) for w in words for _ in range(2)] and n.tolist() == [2] * 6
        assert len(memo.index) + len(memo.old) <= 2 * (10 + 6)
    assert asked.count(b"often") == asked.count(b"always") == 1 and len(asked) == 82


def test_parts_of_ascii_run_through_the_model_only():
    with open(PATH, encoding="utf-8") as f:
        encoder = LibraryEncoder(bpe.load(PATH), f.read())
    whole = []
    normal = encoder._normal
    encoder._normal = lambda s: whole.append(s) or normal(s)
    parts = ["plain", "é", "'s", "7", "...", "日本", "q" * 70, "\x1c", "'"]
    ids, n = encoder.merge(parts)
    want = [encoder.tokenizer.encode(p, add_special_tokens=False).ids for p in parts]
    assert ids.tolist() == [i for w in want for i in w] and n.tolist() == [len(w) for w in want]
    assert whole == ["é 日本"]


def test_gradients_are_added_up_without_a_sort(monkeypatch):
    """A training batch adds its rows into place; the sums are those of rows added one by one."""
    rng = np.random.default_rng(3)
    into, rows, values = np.zeros((7, lm.WIDTH), np.float32), rng.integers(0, 7, 400), rng.normal(size=(400, lm.WIDTH))
    want = np.zeros((7, lm.WIDTH))
    np.add.at(want, rows, values * 2)

    def sort(*a, **k):
        raise AssertionError("sorted")
    monkeypatch.setattr(np, "argsort", sort)
    lm._add_rows(into, rows, values, np.full(lm.WIDTH, 2.0))
    assert np.allclose(into, want, atol=1e-4)
    streams = [rng.integers(0, 20, 50).astype(np.int16) for _ in range(80)]
    target, ctx = lm._windows(streams, 20)
    counts = np.bincount(target, minlength=20).astype(float)
    model = lm.Model.start(counts)
    before = model.log_probs(target, ctx).sum()
    p = (counts + 1) / (counts + 1).sum()
    for _ in range(3):
        model.train(target, ctx, p, np.random.default_rng(1), np.full(len(model.flat), 1e-6, np.float32))
    assert np.isfinite(model.flat).all() and model.log_probs(target, ctx).sum() != before
