"""Language identification by multilingual mixture inference.

Learning counts the characters, pairs and triples of characters of the words
of each language over all labelled documents; a word's likelihood in a language
is the product of its letters' probabilities given the two before (orders
mixed, each a prior of the next with the weight of ``PRIOR`` counts).  n-grams
are hashed into fixed tables (``TABLES``), so a model has 86,016 counts a
language whatever the corpus, and at most ``MAX_LANGS`` languages are learnt.

A document is a mixture: each word comes from one of its languages, and
expectation-maximisation estimates the languages' proportions.  The set of
languages is chosen by penalised likelihood: it begins with the best single
language, and the language that adds most is taken in as long as the gain in
log-likelihood is more than ``PENALTY * log(1 + words)``.  The log-likelihood
is concave in the proportions, so its slope towards a language bounds the gain
that language can bring; languages whose slope is below the penalty are not
tried, which changes no result.

Both steps are maps over the table.  Learning keeps a table of counts a task,
summed by language and bucket; prediction needs the model only.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwalk.llm.common import PIECE_BYTES, plain, quoted, ready, word_pieces

TABLES = (1 << 12, 1 << 14, 1 << 16)  # buckets of single characters, pairs, triples
MAX_LANGS = 1000
PRIOR = 4.0
PENALTY = 3.0
CLIP = 20.0   # most that one word can say for one language against another, in nats
ROUNDS, TOLERANCE = 40, 1e-4
CELLS = 2_000_000  # words times languages worked on at once
UNDETERMINED = "und"

_WORD = re.compile(r"[^\W\d_]+")
_SPACE = 32
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def letter_words(raw: bytes | None) -> Counter:
    """The runs of letters of a UTF-8 text in lower case with their counts;
    long texts are read piece by piece."""
    out: Counter = Counter()
    if raw:
        pieces = [raw] if len(raw) <= PIECE_BYTES else (b" ".join(p) for p in word_pieces(raw))
        for piece in pieces:
            out.update(_WORD.findall(piece.decode("utf-8", "replace").lower()))
    for w in [w for w in out if not any(map(str.isalpha, w))]:  # signs like a raised two count as word characters only
        del out[w]
    return out


def _buckets(words: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Buckets of the one-, two- and three-character n-grams that end at every
    letter and at the end of every word; bucket of the character before; first
    place of every word."""
    x = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    one, two = x[1:], x[:-1]
    three = np.concatenate([[0], x[:-2]]).astype(np.uint64)
    three[two == _SPACE] = 0  # nothing from the word before
    a, b, c = one * _ODD[0], two * _ODD[1], three * _ODD[2]
    shift = [np.uint64(64 - n.bit_length() + 1) for n in TABLES]
    grams = [(a >> shift[0]), ((a ^ (b << np.uint64(1))) * _ODD[2] >> shift[1]), (((a ^ (b << np.uint64(1))) + c) * _ODD[1] >> shift[2])]
    before = two * _ODD[0] >> shift[0]
    pair_before = (two * _ODD[0] ^ (three * _ODD[1] << np.uint64(1))) * _ODD[2] >> shift[1]
    ends = np.flatnonzero(one == _SPACE)
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [g.astype(np.int64) for g in (*grams, before, pair_before)], starts, two == _SPACE


def _add(counts: np.ndarray, words: Counter) -> None:
    if not words:
        return
    (one, two, three, *_), starts, _ = _buckets(list(words))
    weight = np.repeat(np.fromiter(words.values(), np.float64, len(words)), np.diff(np.append(starts, len(one))))
    lo = 0
    for g, n in zip((one, two, three), TABLES):
        counts[lo:lo + n] += np.rint(np.bincount(g, weight, n)).astype(np.int64)
        lo += n


class Model:
    """Counts of every language and what follows from them."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        ends = np.cumsum(TABLES)[:-1]
        self.one, self.two, self.three = np.split(counts.astype(np.float64), ends, axis=1)
        self.total = self.one.sum(1)

    def likelihoods(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word in each language."""
        (g1, g2, g3, before, pair_before), starts, first = _buckets(words)
        out = np.empty((len(words), len(self.langs)))
        for k in range(len(self.langs)):
            one, two, three = self.one[k], self.two[k], self.three[k]
            p = (one[g1] + 1.0) / (self.total[k] + len(one))
            p = (two[g2] + PRIOR * p) / (one[before] + PRIOR)
            # In front of a first letter there is the mark alone, so pairs are all there is to go by.
            p = np.where(first, p, (three[g3] + PRIOR * p) / (two[pair_before] + PRIOR))
            out[:, k] = np.add.reduceat(np.log(p), starts)
        return out


def _em(p, n, owner, starts, share):
    """Proportions after EM from ``share`` (zeros stay) and log-likelihoods of
    the documents whose words have likelihoods ``p`` and counts ``n``."""
    size = np.add.reduceat(n, starts)
    for _ in range(ROUNDS):
        mix = np.einsum("ij,ij->i", p, share[owner])
        new = share * np.add.reduceat(p * (n / mix)[:, None], starts) / size[:, None]
        done = np.abs(new - share).max() < TOLERANCE
        share = new
        if done:
            break
    return share, np.add.reduceat(n * np.log(np.einsum("ij,ij->i", p, share[owner])), starts)


def _pick(rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """Entries of the documents ``rows``: their places, owners and starts."""
    n = sizes[rows]
    begin = np.cumsum(n) - n
    at = np.repeat(starts[rows] - begin, n) + np.arange(int(n.sum()))
    return at, np.repeat(np.arange(len(rows)), n), begin


def mixtures(model: Model, docs: list[Counter], penalty: float = PENALTY) -> np.ndarray:
    """Proportion of every language in every document; documents without a
    word have none at all."""
    out = np.zeros((len(docs), len(model.langs)))
    if not model.langs:
        return out
    most = max(1, CELLS // len(model.langs))
    full = [k for k, d in enumerate(docs) if d]
    lo = 0
    while lo < len(full):
        hi, n = lo, 0
        while hi < len(full) and (hi == lo or n + len(docs[full[hi]]) <= most):
            n += len(docs[full[hi]])
            hi += 1
        out[full[lo:hi]] = _mixtures(model, [docs[k] for k in full[lo:hi]], penalty)
        lo = hi
    return out


def _mixtures(model: Model, docs: list[Counter], penalty: float) -> np.ndarray:
    index = dict.fromkeys(w for d in docs for w in d)
    index = dict(zip(index, range(len(index))))
    logs = model.likelihoods(list(index))
    logs = np.maximum(logs - logs.max(1, keepdims=True), -CLIP)
    sizes = np.array([len(d) for d in docs], np.int64)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(docs)), sizes)
    at = np.fromiter((index[w] for d in docs for w in d), np.int64, int(sizes.sum()))
    n = np.fromiter((c for d in docs for c in d.values()), np.float64, len(at))
    alone = np.add.reduceat(logs[at] * n[:, None], starts)
    likely = np.exp(logs)[at]
    least = penalty * np.log1p(np.add.reduceat(n, starts))
    share = np.zeros((len(docs), len(model.langs)))
    share[np.arange(len(docs)), alone.argmax(1)] = 1.0
    value = alone.max(1)
    live = np.arange(len(docs))
    while len(live):
        e, o, s = _pick(live, starts, sizes)
        mix = np.einsum("ij,ij->i", likely[e], share[live][o])
        slope = np.add.reduceat(likely[e] * (n[e] / mix)[:, None], s) - np.add.reduceat(n[e], s)[:, None]
        slope[share[live] > 0] = -np.inf
        best, gain = share[live].copy(), np.zeros(len(live))
        for k in range(len(model.langs)):
            try_at = np.flatnonzero(slope[:, k] > least[live])
            if not len(try_at):
                continue
            rows = live[try_at]
            e, o, s = _pick(rows, starts, sizes)
            begin = share[rows] * 0.9
            begin[:, k] = 0.1
            got, log = _em(likely[e], n[e], o, s, begin)
            more = log - value[rows] - least[rows]
            better = more > gain[try_at]
            best[try_at[better]], gain[try_at[better]] = got[better], more[better]
        taken = gain > 0
        share[live[taken]] = best[taken]
        value[live[taken]] += gain[taken] + least[live[taken]]
        live = live[taken]
    return share


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of all rows with a text and a language.  Rows with a null in
    either are left out; without any other row the model knows no language.
    More than ``MAX_LANGS`` languages raise ValueError."""
    spark = ready(docs.sparkSession)
    known = docs.select(quoted(lang_col).alias("lang"), quoted(text_col).alias("text")).filter("lang is not null and text is not null")
    langs = sorted(r[0] for r in known.select("lang").distinct().limit(MAX_LANGS + 1).collect())
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    place = {name: k for k, name in enumerate(langs)}

    def count(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            words: dict[int, Counter] = {}
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                words.setdefault(place[name], Counter()).update(letter_words(raw.as_py()))
            for k, c in words.items():
                _add(total.setdefault(k, np.zeros(sum(TABLES), np.int64)), c)
        for k, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())],
                                             names=["lang", "bucket", "n"])

    counts = np.zeros((len(langs), sum(TABLES)), np.int64)
    if langs:
        got = known.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
        counts[got.column("lang").to_numpy(), got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return Model(langs, counts)


def identify(docs: DataFrame, model: Model, text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """``docs`` with ``lang_pred`` (the language of the largest proportion,
    the first in alphabetical order of several), ``score`` (its proportion) and
    ``languages``: all languages of the document with their proportions,
    largest first.

    Null texts and texts without a letter are ``und`` with score 0 and no
    languages, as is every text under a model without languages.  Whole texts
    are read, whatever their length; equal rows get equal answers; an empty
    table gives an empty one.  Input columns of the three names are replaced,
    all others pass through."""
    return _identify(docs, model, text_col, penalty, False)


def _identify(docs: DataFrame, model: Model, text_col: str, penalty: float, drop: bool) -> DataFrame:
    spark = ready(docs.sparkSession)
    share_type = T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())])
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", T.ArrayType(share_type))]
    docs = docs.select(*[quoted(c) for c in docs.columns if c.lower() not in {f.name for f in fields}])
    at = docs.columns.index(text_col)
    docs, old = plain(docs)
    stay = [k for k in range(len(old)) if not (drop and k == at)]
    schema = T.StructType([*[docs.schema.fields[k] for k in stay], *fields])
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            found = mixtures(m, [letter_words(raw.as_py()) for raw in b.column(at).cast(pa.binary())], penalty)
            pred, score, langs = [], [], []
            for row in found:
                some = sorted(((-x, m.langs[k]) for k, x in enumerate(row) if x > 0))
                pred.append(some[0][1] if some else UNDETERMINED)
                score.append(min(1.0, -some[0][0]) if some else 0.0)
                langs.append([{"lang": name, "share": min(1.0, -x)} for x, name in some])
            extra = [pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                     pa.array(langs, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in stay], *extra], names=schema.names)

    return docs.mapInArrow(run, schema).toDF(*[old[k] for k in stay], *[f.name for f in fields])


def languages_digest(docs: DataFrame) -> DataFrame:
    """Query form: learns from the documents whose id's CRC-32 leaves another
    remainder than 2 by 4 (null ids too) and predicts all."""
    part = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4, F.lit(0))
    docs = docs.select("doc_id", (part == 2).alias("held_out"), "text", "lang")
    model = fit(docs.filter(~F.col("held_out")))
    return _identify(docs.select("doc_id", "held_out", "text"), model, "text", PENALTY, True).select("doc_id", "held_out", "lang_pred", "score", "languages")
