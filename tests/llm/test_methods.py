"""Each operator against a brute-force version, the library it must equal, or
an exact round trip."""
import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cartwalk.llm import bpe, components, decontaminate, html, licenses, lm, quality, registry, shards, simhash, substrings, tokenfiles

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


# -- substring dedup -----------------------------------------------------------

def _without_repeats(texts, size):
    w = {k: (t or "").encode().split() for k, t in texts.items()}
    n = collections.Counter(tuple(x[i:i + size]) for x in w.values() for i in range(len(x) - size + 1))
    out = {}
    for k, x in w.items():
        gone = set()
        for i in range(len(x) - size + 1):
            if n[tuple(x[i:i + size])] > 1:
                gone.update(range(i, i + size))
        out[k] = (len(x), len(gone), hashlib.sha256(b" ".join(v for i, v in enumerate(x) if i not in gone)).hexdigest())
    return out


def test_levels_double():
    assert substrings.lengths(35) == [18, 35] and substrings.lengths(100) == [13, 25, 50, 100] and substrings.lengths(5) == [5]
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    h[40:55] = h[10:25]
    for size in range(1, 16):
        n = substrings._base_names(h, size)
        assert len(n) == 61 - size and n[10] == n[40] and len(set(n.tolist())) == len(n) - (16 - size)


@pytest.mark.parametrize("size", [6, 35, 40])
def test_substrings_brute_force(spark, size):
    rnd = random.Random(size)
    passages = [" ".join(rnd.choice("abcdefgh") + str(rnd.randint(0, 30)) for _ in range(50)) for _ in range(4)]
    texts = {}
    for i in range(60):
        words = [rnd.choice("abcdefgh") + str(rnd.randint(0, 30)) for _ in range(rnd.randint(0, 80))]
        if rnd.random() < 0.6:
            p = rnd.choice(passages).split()
            lo = rnd.randint(0, 12)
            words[10:10] = p[lo:lo + rnd.randint(20, 45)]
        texts[i] = "  ".join(words)
    texts[60] = "z " * 45  # repeats itself
    texts[61] = texts[62] = passages[0]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.repeats_digest(df, size).collect()}
    assert got == _without_repeats(texts, size)


def test_op10_on_the_table(spark, texts):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in registry.QUERIES["op10_substring_dedup"](spark, SF).collect()}
    assert got == _without_repeats(texts, 35)


# -- SimHash ---------------------------------------------------------------------

def _fingerprint(text):
    w = text.encode().lower().split()
    grams = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def test_op6_brute_force(spark, texts):
    prints = {k: _fingerprint(t) for k, t in texts.items()}
    parent = {k: k for k in prints}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k
    for a in prints:
        for b in prints:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in registry.QUERIES["op6_simhash_near_dedup"](spark, SF).collect()}
    assert got == {k: (f"{p:016x}", find(k)) for k, p in prints.items()}


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_crowded_keys_lose_no_pair(spark, bits):
    rnd = random.Random(bits)
    values = {rnd.getrandbits(64) & ~0xFF | x for x in range(64)} | {x for x in range(100)} | {(x << 50) ^ 5 for x in range(60)}
    values = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    got = {(r["a"], r["b"]) for r in simhash.near_pairs(df, bits, crowd=6).collect()}
    assert got == {(a, b) for a in values for b in values if a < b and bin((a ^ b) & (2 ** 64 - 1)).count("1") <= bits}


def test_components_of_chain_star_and_cycle(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200 + i, 200 + (i + 1) % 30) for i in range(30)] + [(300, 300), (301, None)]
    df = spark.createDataFrame(edges, "a long, b long")
    groups = collections.defaultdict(set)
    for r in components.components(df).collect():
        groups[r["root"]].add(r["node"])
    assert sorted(map(sorted, groups.values())) == [list(range(61)), list(range(100, 160)), list(range(200, 230))]
    assert all(root in nodes for root, nodes in groups.items())


# -- quality ---------------------------------------------------------------------

def _counts(t):
    w, seen, dup = t.encode().split(), set(), 0
    n = len(w)
    lines = [x for x in t.split("\n") if x.encode().split()]
    for x in lines:
        dup += x in seen
        seen.add(x)
    c = collections.Counter(tuple(w[j:j + 3]) for j in range(n - 2))
    cov = {j + k for j in range(n - 2) if c[tuple(w[j:j + 3])] > 1 for k in range(3)}
    return n, sum(len(x.decode()) for x in w), sum(t.count(s) for s in "#*$%&|<>"), dup, len(cov), len(lines)


def _mcd(rows):
    """{key: (mean, covariance)} by the same definition, in numpy."""
    keys = sorted(rows)
    p, unit = quality.P, quality.UNIT
    floor = np.diag(np.square(quality.FLOOR))
    scale = quality.SHARE / quality._chi2_cdf(quality._chi2_upper(1 - quality.SHARE, p), p + 2)

    def pooled(kept, k):
        al = np.concatenate([kept[x] for x in keys]) / unit
        out = {}
        for x in keys:
            v = kept[x] / unit
            own = len(v) / (len(v) + quality.PRIOR)
            cov = own * np.cov(v.T, bias=True) + (1 - own) * np.cov(al.T, bias=True)
            out[x] = own * v.mean(0) + (1 - own) * al.mean(0), k * cov + floor
        return out
    starts = [pooled(rows, 1.0), {}]
    for x in keys:
        med = np.median(rows[x], 0)
        starts[1][x] = rows[x].mean(0) * 0 + med / unit, np.diag((np.median(abs(rows[x] - med), 0) * 1.4826 / unit) ** 2) + floor
    ends = []
    for fit in starts:
        for _ in range(quality.MAX_STEPS):
            kept = {}
            for x in keys:
                y = rows[x] / unit - fit[x][0]
                d = np.einsum("ij,ij->i", y @ np.linalg.inv(fit[x][1]), y)
                cell = np.floor(np.log1p(d) * quality.GRID)
                order = np.sort(cell)
                kept[x] = rows[x][cell <= order[min(len(order) - 1, math.ceil(quality.SHARE * len(order)) - 1)]]
            fit = pooled(kept, scale)
        ends.append(fit)
    return {x: min((e[x] for e in ends), key=lambda f: np.linalg.slogdet(f[1])[1]) for x in keys}


def test_op9_brute_force(spark, texts):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text").collect()
    counts = {r["doc_id"]: _counts(r["text"]) for r in rows}
    lang = {r["doc_id"]: r["lang"] for r in rows}
    # One source, so that groups are large enough to be interesting.
    df = spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.lit("s"))
    got = {r["doc_id"]: r for r in quality.quality_digest(df).collect()}
    failed = {k: c[0] < 50 or 100 * c[4] > 50 * c[0] for k, c in counts.items()}

    def vector(c):
        x = [math.log(c[1] / c[0]), math.log1p(1000 * c[2] / c[0]), math.log1p(100 * c[3] / c[5]), math.log1p(100 * c[4] / c[0])]
        return [math.floor(v * quality.UNIT + 0.5) if v >= 0 else -math.floor(-v * quality.UNIT + 0.5) for v in x]
    groups = collections.defaultdict(list)
    for k, c in counts.items():
        if not failed[k]:
            groups[lang[k]].append(vector(c))
    fit = _mcd({k: np.array(v, float) for k, v in groups.items()})
    cut = quality._chi2_upper(quality.TAIL, quality.P)
    for k, c in counts.items():
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == c[:5]
        assert r["base_failed"] == failed[k]
        if failed[k]:
            assert not r["kept"]
            continue
        m, cov = fit[lang[k]]
        y = np.array(vector(c)) / quality.UNIT - m
        d = float(y @ np.linalg.inv(cov) @ y)
        assert abs(d - cut) < 1e-6 or r["kept"] == (d <= cut)


def test_outliers_do_not_hide_each_other(spark):
    rnd = random.Random(2)

    def doc(junk):
        w = ["".join(rnd.choice("abcdefg") for _ in range(rnd.randint(2, 8))) for _ in range(120)]
        return " ".join(x + "%%%" if junk else x for x in w)
    rows = [(i, doc(i % 5 == 0), "en", "a" if i < 150 else "b") for i in range(200)]
    out = quality.quality_digest(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert all(r["kept"] == (r["doc_id"] % 5 != 0) for r in out)


def test_each_coordinate_alone_rejects(spark):
    rnd = random.Random(3)

    def word(lo=2, hi=8):
        return "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(lo, hi)))

    def clean():
        return [word() for _ in range(120)]
    few, chunk = [word(5, 5) for _ in range(20)], clean()[:27]
    odd = {
        900: " ".join(word(7, 14) for _ in range(120)),
        901: " ".join(w + "#" * (i % 5 == 0) for i, w in enumerate(clean())),
        902: "\n".join(rnd.choice(few) for _ in range(200)),
        903: " ".join(clean()[:66] + chunk + chunk)}
    rows = [(i, " ".join(clean())) for i in range(100)] + list(odd.items())
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    got = {r["doc_id"]: r for r in quality.quality_digest(df).collect()}
    assert not any(r["base_failed"] for r in got.values())
    assert got[902]["n_dup_lines"] == 180 and got[903]["n_repeat_words"] == 54
    assert {k for k, r in got.items() if not r["kept"]} == set(odd)


# -- decontamination ---------------------------------------------------------------

def test_templates_and_slots(spark):
    bench = spark.createDataFrame([
        (1, "Then Anna has 5 km and gives 5 apples to Bob before Anna goes home again now."),
        (2, "Then Carl has 7 miles and gives 7 apples to Dora before Carl goes home again now."),
        (3, "What is the capital?")], "item_id long, text string")
    docs = spark.createDataFrame([
        (10, "Some words before. Then Eve has 12kg and gives 12 apples to Frank before Eve goes home again now. More."),
        (11, "Then Eve has 12 kg and gives 13 apples to Frank before Eve goes home again now."),
        (12, "Then Eve has 12 kg and gives 12 apples to Eve before Eve goes home again now."),
        (13, "we ask: What is the capital? yes"), (14, "the capital is what we ask")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["n_items"], r["covered"], r["n_slots"]) for r in decontaminate.hits(docs, bench).collect()}
    assert got == {(10, 1, 2, 17, 6), (13, 3, 1, 4, 0)}


def test_verbatim_copies_of_short_and_numeric_items(spark):
    bench = spark.createDataFrame([
        (1, "What is 15 percent of 240?"), (2, "What is 17 + 25?"), (3, "What is the capital city of France in Europe?"),
        (4, "Sort 3, 9, 12, 7, 41, 8, 5, 66, 20, 13, 2, 90 and 31 now.")], "item_id long, text string")
    docs = spark.createDataFrame([
        (10, "So: what is 15 percent of 240? Let us see."), (11, "Answer this. What is 17 + 25? It is 42."),
        (12, "1) What is the capital city of France in Europe?"), (13, "- sort 3, 9, 12, 7, 41, 8, 5, 66, 20, 13, 2, 90 and 31 now"),
        (14, "What is 16 percent of 250? What is 18 + 25? Sort 4, 8, 1, 7, 41, 9, 5, 66, 21, 13, 2, 91 and 31 now.")],
        "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.hits(docs, bench).collect()} == {(10, 1), (11, 2), (12, 3), (13, 4)}


def test_one_bad_slot_voids_its_windows_only(spark):
    def ask(a, b, c, d, misprint=None):
        return (f"Then the baker has {a} trays with buns and another {b} trays with rolls on the table near the door, and after selling "
                f"{misprint or a} trays to the school and {c} trays to the clinic there remain some of them which were given to the old "
                f"farmer who lives beyond the river with {d} hens.")
    bench = spark.createDataFrame([(1, ask(3, 5, 2, 9)), (2, "We see 3 red apples beside 5 sweet oranges in this wooden bowl today.")],
                                  "item_id long, text string")
    docs = spark.createDataFrame([
        (10, ask(3, 5, 2, 9, misprint=8)), (11, ask(14, 15, 16, 17, misprint=18)), (12, ask(4, 4, 4, 4)),
        (13, "We see 4 red apples beside 4 sweet oranges in this wooden bowl today.")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.hits(docs, bench).collect()}
    assert set(got) == {(10, 1), (11, 1), (12, 1), (13, 2)}
    assert got[11, 1]["covered"] < got[11, 1]["n_tokens"] == got[12, 1]["covered"]


def test_items_of_few_words_condemn_nothing(spark):
    bench = spark.createDataFrame([(1, "Paris"), (2, "42"), (3, "New York!"), (4, "Is it New York?"), (5, None)],
                                  "item_id long, text string")
    docs = spark.createDataFrame([
        (10, "We met in Paris and then paris again, 42 times."), (11, "42"), (12, "Tell me: is it New York? Yes, New York.")],
        "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.hits(docs, bench).collect()} == {(12, 4)}
    assert sorted(map(tuple, decontaminate.too_short(bench).collect())) == [(1, 1), (2, 1), (3, 2), (5, 0)]


def test_conflicting_slots_against_brute_force(spark):
    import random
    rng = random.Random(5)
    rows, want = [], {}
    for a in range(60):
        pairs = [(p, rng.randrange(4), rng.choice([decontaminate.NAME, decontaminate.NUMBER]) + rng.choice("xyz"))
                 for p in range(rng.randrange(1, 9))]
        rows += [(a, *x) for x in pairs]

        def often(s, v):
            return sum(1 for _, s2, v2 in pairs if (s2, v2) == (s, v))
        want[a] = {p for p, s, v in pairs if any(s2 == s and v2 != v and often(s2, v2) >= often(s, v) for _, s2, v2 in pairs)
                   or v[0] == decontaminate.NAME and any(s2 != s and v2 == v for _, s2, v2 in pairs)}
    got = decontaminate._conflicts(spark.createDataFrame(rows, "a long, p int, s int, v string"), ["a"]).collect()
    assert {r["a"]: set(r["bad"]) for r in got} == {a: b for a, b in want.items() if b}


def test_a_table_of_many_numbers(spark):
    text = "Then add all of these to one sum: " + ", ".join(f"item number {7 * i % 1009} of the long list" for i in range(400))
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    docs = spark.createDataFrame([(10, text), (11, "item number 7 of a short list")], "doc_id long, text string")
    got = decontaminate.hits(docs, bench).collect()
    assert [(r["doc_id"], r["covered"], r["n_slots"]) for r in got] == [(10, got[0]["n_tokens"], 400)]


def test_op8_finds_the_planted_passages(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    flat = {r["doc_id"]: " ".join(r["text"].split()) for r in docs}
    want = {(k, b["item_id"]) for k, t in flat.items() for b in bench if " ".join(b["text"].split()) in t}
    got = {(r["doc_id"], r["item_id"]) for r in registry.QUERIES["op8_benchmark_decontamination"](spark, SF).collect()}
    # Anything more shares at least MIN_TOKENS words in a row with its item.
    assert want <= got and want

    def plain(t):
        return decontaminate_words(t)

    def decontaminate_words(t):
        return "".join(c.lower() if c.isalnum() else " " for c in t).split()
    items = {b["item_id"]: plain(b["text"]) for b in bench}
    for k, i in got - want:
        w, q = plain(flat[k]), items[i]
        grams = {tuple(w[j:j + 8]) for j in range(len(w) - 7)}
        assert any(tuple(q[j:j + 8]) in grams for j in range(len(q) - 7))


# -- BPE and token files ---------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load(PATH))


ODD = ["", "  ", "'s it's DON'T we'll x'd", "a<|endoftext|>b <|startoftext|><|startoftext|> <|endo", "ΣΑΣ Σ", "İstanbul I ı", "é ẛ̣",
       "x y\x85z\x1cq\x1f 　a​b", "aaaaaaaaaa aaa", "123 ½²٣", "\U0001f600\U0001f468‍\U0001f469", "\x00\x01 nul", "日本語", "....!!!! ,,;;"]


def test_bpe_equals_the_library(library, codec):
    for t, ids in zip(ODD, codec.encode_batch([t.encode() for t in ODD])):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want and codec.decode(want) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8", max_codepoint=0x2FFF), st.sampled_from("abeths' .,!\n<|>endoftext")), max_size=60))
def test_bpe_equals_the_library_on_any_text(library, codec, text):
    assert codec.encode(text.encode()).tolist() == library.encode(text, add_special_tokens=False).ids


def test_op3_on_the_table(spark, texts, library):
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in registry.QUERIES["op3_bpe_codec"](spark, SF).collect()}
    for k, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[k] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                          hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2 ** 32), st.sampled_from([1, 63, 64, 65, 5000, 32768, 65536, 65537, 140_000]), st.sampled_from([1.05, 1.5, 3.0]))
def test_rans_round_trip(seed, n, a):
    ids = np.minimum(np.random.default_rng(seed).zipf(a, n), 49407).astype(np.int32)
    assert (tokenfiles.decode_chunk(tokenfiles.encode_chunk(ids)) == ids).all()


def test_damage_is_noticed():
    ids = np.random.default_rng(1).integers(0, 49408, 70_000).astype(np.int32)
    data = tokenfiles.encode_chunk(ids)
    for at in (len(data) // 2, len(data) - 3, len(data) - 60_000):
        bad = bytearray(data)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            tokenfiles.decode_chunk(bytes(bad))


def test_scaled_frequencies():
    for counts in ([1], [1, 1], [10 ** 9] + [1] * 49_000, list(range(1, 40_000))):
        f = tokenfiles.scaled(np.array(counts))
        assert f.sum() == 1 << tokenfiles.BITS and f.min() >= 1


def test_crc_of_joined_pieces():
    a, b = bytes(range(256)) * 5, b"xyz" * 99
    assert tokenfiles._combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_op7_on_the_table(spark, texts, library):
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in registry.QUERIES["op7_token_files"](spark, SF).collect()}
    start = 0
    for k in sorted(texts):
        ids = np.array(library.encode(texts[k], add_special_tokens=False).ids + [2], "<u4")
        assert got[k] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


# -- shards ------------------------------------------------------------------------

def test_matrix_has_exact_margins():
    counts, sizes = np.array([5, 0, 17, 100, 3]), shards.cell_sizes(125, 4, 2)
    for seed in range(5):
        m = np.array([shards.matrix_row(p, counts, sizes, seed) for p in range(5)])
        assert (m.sum(0) == sizes).all() and (m.sum(1) == counts).all() and (m >= 0).all()


def test_large_populations_follow_the_same_law(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(shards, "_SAFE", 0)
    for good, bad, draws in ((700, 300, 400), (30, 3000, 2900), (5, 5, 5), (1000, 10, 600)):
        x = np.array([shards.hypergeometric(rng, good, bad, draws) for _ in range(6000)])
        mean = draws * good / (good + bad)
        sd = math.sqrt(mean * bad / (good + bad) * (good + bad - draws) / (good + bad - 1))
        assert abs(x.mean() - mean) < 5 * sd / math.sqrt(len(x)) and abs(x.std() - sd) < 0.06 * sd + 0.01


def test_op2_on_the_table(spark, texts):
    rows = registry.QUERIES["op2_sharding"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    by = collections.defaultdict(list)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        by[r["shard"]].append(r["slot"])
    assert sorted(by) == list(range(16)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_every_place_is_equally_likely(spark):
    df = spark.range(40).withColumn("text", F.lit("x")).withColumnRenamed("id", "doc_id").repartition(3)
    hits = collections.Counter()
    for seed in range(12):
        for r in shards.shuffle_into_shards(df, 2, seed).collect():
            hits[r["doc_id"] < 20, r["shard"]] += 1
    assert all(abs(n - 120) < 40 for n in hits.values())


# -- LM ------------------------------------------------------------------------------

def test_op1_base_and_model(spark, texts, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN", 500)  # so that most counts are joined in
    tokens = {k: t.encode().lower().split() + [b"\n"] for k, t in texts.items()}
    c = collections.Counter()
    for k, w in tokens.items():
        if zlib.crc32(str(k).encode()) % 7 != 2:
            c.update(w)
    total, distinct = sum(c.values()), len(c)
    out = registry.QUERIES["op1_lm_scoring"](spark, SF).collect()
    base = model = 0.0
    for r in out:
        w = tokens[r["doc_id"]]
        want = sum(math.log10((c[x] + 1) / (total + distinct + 1)) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), total)
        assert r["base_score"] == pytest.approx(want, rel=1e-9) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        if r["held_out"]:
            base, model = base + r["base_score"], model + r["score"]
    assert model > base


def test_probabilities_add_up_to_one():
    rng = np.random.default_rng(0)
    m = lm.Model.start(rng.integers(1, 50, 40).astype(float))
    m.R[:] += rng.normal(0, 1, m.R.shape)
    ctx = rng.integers(0, 41, (lm.CONTEXT, 6)).astype(np.int16)
    total = sum(np.exp(m.log_probs(np.full(6, s, np.int16), ctx)) for s in range(40))
    assert np.allclose(total, 1)


def test_nce_learns_a_known_source():
    rng = np.random.default_rng(1)
    stream = [np.array([(i + s) % 5 for i in range(4000)], np.int16) for s in range(5)]
    target, ctx = lm._windows(stream, 5)
    m = lm.Model.start(np.full(5, 4000.0))
    p = np.full(5, 0.2)
    before, g = m.log_probs(target, ctx).mean(), np.full(len(m.flat), 1e-6, np.float32)
    for _ in range(20):
        m.train(target, ctx, p, rng, g)
    assert before < -1.5 and m.log_probs(target, ctx).mean() > -0.1


# -- HTML and licenses ----------------------------------------------------------------

def test_layout():
    title, text = html.extract("""<head><title>T &amp; x</title><style>p{}</style></head><ul><li>one<li>two<ul><li>sub</ul><li>three</ul>
<h1>Head <b>bold</b></h1><p>First  para<br>next<p>Second<div style="display: none">gone</div><p hidden>gone<ol start=3><li>x<li>y</ol>
<pre>a
  b</pre><table><caption>Cap</caption><tr><th>Name<th>Qty<tr><td>apple pie<td>3<tr><td colspan=2>wide cell here<tr><td>fig<td>12 &lt;kg</table>after <script>"</p>"</script>tail
<blockquote>quoted</blockquote><select><option>A<option selected>B</select><details><summary>S</summary>hid</details>""")
    assert title == "T & x"
    assert text == """- one
- two
  - sub
- three

Head bold

First para
next

Second

3. x
4. y

a
  b

Cap
Name       Qty
apple pie  3
wide cell here
fig        12 <kg

after tail

  quoted

B
S"""


def test_formulas_and_drawings_are_shown():
    title, text = html.extract("""<head><title>Page</title></head><body><p>Area <math><semantics><mrow><mi>A</mi><mo>=</mo>
<mfrac><mn>7</mn><mn>2</mn></mfrac></mrow><annotation encoding="tex">A=\\frac</annotation><annotation-xml>gone</annotation-xml></semantics></math> here</p>
<svg><title>gone</title><desc>gone</desc><metadata>gone</metadata><defs><text>gone</text></defs><defs/><path d="M0 0"/>
<text x="1">North</text><text x="9">South</text><text display="none">gone</text></svg><svg style="display:none"><text>gone</text></svg>
<desc>shown</desc><p>end</p>""")
    assert title == "Page"
    assert text.split() == ["Area", "A=", "7", "2", "here", "North", "South", "shown", "end"]
    assert html.extract("<svg><title>gone</title><text>a</text></svg>") == (None, "a")


def test_op4_keeps_all_visible_words(spark):
    import re
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in registry.QUERIES["op4_html_extraction"](spark, SF).collect():
        import html as stdlib
        body = re.sub(r"(?s)<head>.*?</head>|<(script|style)\b.*?</\1>|<!--.*?-->|<!DOCTYPE[^>]*>", " ", pages[r["page_id"]])
        want = stdlib.unescape(re.sub(r"</?(?:b|a)\b[^>]*>", "", body))
        want = re.sub(r"<[a-z/!][^>]*>", " ", want)
        drop = str.maketrans("", "", " \n\t-")
        assert r["text"].translate(drop) == "".join(want.split()).translate(drop)


def test_dice_brute_force():
    scanner = licenses.Scanner(licenses.default_templates())
    rnd = random.Random(4)
    for lic, text in rnd.sample(licenses.default_templates(), 60):
        words = licenses.tokens(text)
        for _ in range(3):
            w = [x for x in words if rnd.random() > 0.08] + ["more"] * rnd.randint(0, 2)
            grams = licenses.bigrams(w)
            want = max(((2 * len(grams & b) / (len(grams) + len(b))), lic2) for lic2, b in scanner.templates) if grams else (0, "")
            got = scanner.best(grams)
            assert (got is None) == (want[0] < licenses.THRESHOLD)
            if got:
                assert got[0] == pytest.approx(want[0])


def test_license_passages():
    scanner = licenses.Scanner(licenses.default_templates())
    mit = licenses.TEXTS["MIT"][0]
    half = len(mit) // 2
    text = "Words. Licensed under CC BY-NC 4.0. More words here.\n\n" + mit[:half] + "\n" + mit[half:] + "\nGoodbye."
    hits = [(text[a:b], lic, d) for a, b, lic, d in scanner.scan(text)]
    assert [(h[0][:13], h[1]) for h in hits] == [("Licensed unde", "CC-BY-NC-4.0"), ("Permission is", "MIT")] and hits[1][2] > 0.95


def test_op5_finds_the_notices(spark, texts):
    notices = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT",
               "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
               "Licensed under the Apache License, Version 2.0.": "Apache-2.0"}
    want = {(k, lic) for k, t in texts.items() for n, lic in notices.items() if n in t}
    got = {(r["doc_id"], r["license"]) for r in registry.QUERIES["op5_license_scan"](spark, SF).collect()}
    assert want == got and want
