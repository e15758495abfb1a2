"""Periodic runs against their definition."""
import hashlib
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from cartwalk.llm import registry, runs

SF = "/root/testdata/sf0.001"


def _by_definition(w, least=24, times=3):
    out, seen = [], set()
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least, times * q) and (i, n) not in seen:  # a smaller period came first
                seen.add((i, n))
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_least_shared_words():
    assert runs.least(24, 3) == 16 and runs.least(24, 2) == 12
    for m in range(1, 40):
        for e in (2, 3, 4):
            assert runs.least(m, e) == min(max(m, e * q) - q for q in range(1, 200))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(st.text("ab", min_size=1, max_size=7), st.integers(1, 9)), max_size=5), min_size=1, max_size=4),
       st.sampled_from([(24, 3), (6, 2), (5, 3), (1, 4)]))
def test_runs_by_definition(docs, limits):
    texts = [list("".join(u * n for u, n in d)) for d in docs]
    assert runs.runs_of(texts, *limits) == [_by_definition(t, *limits) for t in texts]


def test_runs_of_copies_and_far_repeats():
    rnd = random.Random(3)
    passage = [f"p{i}" for i in range(20)]
    far = [w for i in range(3000) for w in (f"l{i}", *passage, f"r{i}")]  # no pair of these is close enough
    unit = [rnd.choice("abcdefgh") for _ in range(50)]
    assert runs.runs_of([far, unit * 4, unit * 4, unit * 2, ["a"] * 100_000, []]) == [
        [], _by_definition(unit * 4), _by_definition(unit * 4), _by_definition(unit * 2), [(0, 100_000, 1)], []]


def _expected(doc_id, text):
    w = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = _by_definition(w)
    top = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    return (len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


def test_op11_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in registry.QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert got == {k: _expected(k, t) for k, t in texts.items()}
    assert sum(r[0] > 0 for r in got.values()) >= len(got) // 20


def test_edges(spark):
    long_text = " ".join(f"w{i}" for i in range(300_000)) + " x y" * 50
    rows = [(1, "a " * 30, [7], 1), (2, None, [7], 1), (3, "", [7], 1), (None, "a " * 30, [7], 1), (1, "a " * 30, [7], 1), (5, long_text, [7], 1), (6, " \t\n\x0b ", [7], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs array<int>, `a.b` int")
    out = runs.periodic_runs(df)
    assert out.columns == ["doc_id", "text", "a.b", "runs"]
    got = {(r["doc_id"], tuple(map(tuple, r["runs"]))) for r in out.collect()}
    assert got == {(1, ((0, 30, 1),)), (2, ()), (3, ()), (None, ((0, 30, 1),)), (5, ((300_000, 100, 2),)), (6, ())} and out.count() == 7
    short = {r["doc_id"]: r["collapsed"] for r in runs.collapse_runs(df).filter("doc_id is not null").collect()}
    assert short[1] == "a" and short[2] == "" and short[6] == "" and short[5] == long_text[:-4 * 49]
    assert runs.periodic_runs(df.limit(0)).collect() == [] and runs.runs_digest(df.limit(0)).collect() == []
    kept = {r["doc_id"]: r["text"] for r in runs.planted(df).collect()}
    assert kept[2] is None and kept[3] == "" and kept[None] == "a " * 30
