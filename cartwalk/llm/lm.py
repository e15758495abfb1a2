"""LM scoring with a log-bilinear model trained by noise-contrastive estimation.

Tokens are lower-cased words and one end per text.  The model predicts symbols:
the ``WORDS`` most frequent tokens have a symbol each, every other token the
symbol of its last two characters (the ``ENDINGS`` endings with the most tokens, and one
for the rest).  A context of ``CONTEXT`` symbols gives the vector
``sum_i C_i * R[s_i]`` (C_i diagonal), a symbol's score is its product with ``Q[s]``
plus a bias, and

    p(token | context) = softmax(scores)[symbol] * p(token | symbol)

where p(token | symbol) is 1 for a symbol of its own and (c + 1) / (N_s + V_s + 1)
within an ending, c the token's count and the last 1 for unseen tokens.
The softmax is over all symbols, so probabilities add up to one over all known
tokens and one unseen token for each ending.

Training.  Counts cover all training texts.  For each of ``ROUNDS`` rounds every
input partition runs over all its training tokens in minibatches, with noise symbols
shared by a batch so that forward and backward pass are matrix products, from the
parameters of the round before; the partitions' parameters are averaged, weighted
by tokens, with a distributed sum.  The parameters have a fixed size.

Counts of rare tokens.  At most ``KNOWN`` of the most frequent tokens are broadcast
with their counts (a fixed bound); for all others the counts are joined in.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwalk.llm.common import quoted, ready, stored, word_pieces

END = "\n"  # no word has a line break
WORDS, ENDINGS, KNOWN = 384, 127, 1 << 17
CONTEXT, WIDTH = 4, 16
ROUNDS, BATCH, NOISE, RATE = 2, 2048, 48, 0.1
TOKENS_AT_ONCE = 20_000
ROWS_AT_ONCE = 512  # scores of so many contexts stay in a core's cache
FLUSH = 300_000  # distinct tokens a counting task holds at once


def _tokens(raw: bytes | None):
    """A text's tokens in lists of bounded size, the end behind the last."""
    last: list[bytes] = []
    for piece in word_pieces(raw.lower() if raw else raw):
        if last:
            yield last
        last = piece
    last.append(b"\n")
    yield last


def held_out(doc_id) -> bool:
    """Whether a document is kept from training.  A null id counts as the
    empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def _pair(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(token, c) over all training texts."""
    def run(batches):
        held: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["token", "c"])
            held.clear()
            return out
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                if held_out(i):
                    continue
                for piece in _tokens(raw):
                    held.update(piece)
                if len(held) > FLUSH:
                    yield flush()
        if held:
            yield flush()
    return _pair(docs, id_col, text_col).mapInArrow(run, "token string, c bigint").groupBy("token").agg(F.sum("c").alias("c"))


class Symbols:
    """Token -> symbol.  ``words`` and ``endings`` in symbol order; the last
    symbol is for tokens of any other ending."""

    def __init__(self, words: list[str], endings: list[str]):
        self.words, self.endings = words, endings
        self.size = len(words) + len(endings) + 1
        self.by_word = {w.encode(): i for i, w in enumerate(words)}
        self.by_ending = {e: len(words) + i for i, e in enumerate(endings)}
        self.rest = self.size - 1

    def of(self, token: bytes) -> int:
        s = self.by_word.get(token)
        return self.by_ending.get(token.decode()[-2:], self.rest) if s is None else s


class Vocabulary:
    """Symbols and known tokens: bounded tables for the tasks."""

    def __init__(self, symbols: Symbols, known: list[tuple[str, int]], total: int, distinct: int,
                 class_mass: np.ndarray, symbol_counts: np.ndarray):
        self.symbols, self.total, self.distinct = symbols, total, distinct
        self.class_mass, self.symbol_counts = class_mass, symbol_counts
        self.known = {t.encode(): i for i, (t, _) in enumerate(known)}
        self.known_symbol = np.array([symbols.of(t.encode()) for t, _ in known], np.int16)
        self.known_log = np.log10(np.array([c for _, c in known], np.float64) + 1)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The tables over all training counts; ``counts`` is a stored table."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # The most frequent tokens by a threshold on the count, from a histogram of
    # fixed size; a top-k would have every task send k rows to the driver.
    cell = F.floor(F.log2("c") * 64).cast("int")
    cells = sorted(counts.groupBy(cell.alias("cell")).count().collect(), reverse=True)
    held, least = 0, 1 << 30
    for r in cells:
        if held + r["count"] > KNOWN:
            break
        held, least = held + r["count"], r["cell"]
    known = sorted(((r["token"], r["c"]) for r in counts.filter(cell >= least).collect()), key=lambda x: (-x[1], x[0]))
    words = [t for t, _ in known[:WORDS]]
    if END not in words:
        words = words[:WORDS - 1] + [END]
    count = dict(known)
    ending = F.substring("token", -2, 2)
    others = counts.filter(~F.col("token").isin(words)).groupBy(ending.alias("e")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"))
    top = others.orderBy(F.desc("n"), "e").limit(ENDINGS).collect()
    all_n, all_v = others.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    symbols = Symbols(words, [r["e"] for r in top])
    n = [r["n"] for r in top] + [all_n - sum(r["n"] for r in top)]
    v = [r["v"] for r in top] + [all_v - sum(r["v"] for r in top)]
    return Vocabulary(symbols, known, int(total), int(distinct), np.array(n, np.float64) + np.array(v, np.float64) + 1,
                      np.array([count.get(w, 0) for w in words] + n, np.float64))


class Model:
    """Parameters as one flat vector: R (with a row for "before the text"),
    Q, bias, C."""

    def __init__(self, flat: np.ndarray, size: int):
        self.flat, self.size = flat.astype(np.float32), size
        r, q = (size + 1) * WIDTH, size * WIDTH
        self.R = self.flat[:r].reshape(size + 1, WIDTH)
        self.Q = self.flat[r:r + q].reshape(size, WIDTH)
        self.b = self.flat[r + q:r + q + size]
        self.C = self.flat[r + q + size:].reshape(CONTEXT, WIDTH)

    @classmethod
    def start(cls, counts: np.ndarray, seed: int = 1) -> Model:
        size, rng = len(counts), np.random.default_rng(seed)
        p = (counts + 1) / (counts + 1).sum()
        return cls(np.concatenate([rng.normal(0, 0.1, (size + 1) * WIDTH), rng.normal(0, 0.1, size * WIDTH), np.log(p),
                                   np.ones(CONTEXT * WIDTH)]), size)

    def context(self, ctx: np.ndarray) -> np.ndarray:
        out = self.C[0] * self.R.take(ctx[0], axis=0)
        for i in range(1, CONTEXT):
            out += self.C[i] * self.R.take(ctx[i], axis=0)
        return out

    def train(self, target: np.ndarray, ctx: np.ndarray, noise_p: np.ndarray, rng, grad2: np.ndarray) -> None:
        """One pass of minibatch NCE with per-parameter step sizes
        (``grad2``: running sums of squared gradients)."""
        log_kp = np.log(NOISE * noise_p).astype(np.float32)
        edges = np.cumsum(noise_p)
        g = Model(np.zeros(len(self.flat)), self.size)
        order = rng.permutation(len(target))
        # Places as numpy indexes by them: rows are taken and added by them without a cast or a sort.
        target, ctx = target.take(order).astype(np.intp), ctx.take(order, axis=1).astype(np.intp)
        with np.errstate(over="ignore"):  # exp to infinity is a sigmoid of 0
            for lo in range(0, len(target), BATCH):
                t, c = target[lo:lo + BATCH], ctx[:, lo:lo + BATCH]
                noise = np.minimum(np.searchsorted(edges, rng.random(NOISE)), self.size - 1)
                rows = [self.R.take(x, axis=0) for x in c]
                h = self.C[0] * rows[0]
                for i in range(1, CONTEXT):
                    h += self.C[i] * rows[i]
                q_true, q_noise = self.Q.take(t, axis=0), self.Q[noise]
                e_true = np.einsum("ij,ij->i", h, q_true)
                e_true += (self.b - log_kp).take(t)
                np.exp(e_true, out=e_true)
                e_true += 1
                np.reciprocal(e_true, out=e_true)  # 1 - sigmoid
                e_noise = h @ q_noise.T
                e_noise += (self.b - log_kp)[noise]
                np.negative(e_noise, out=e_noise)
                np.exp(e_noise, out=e_noise)
                e_noise += 1
                np.divide(-1, e_noise, out=e_noise)  # -sigmoid
                dh = e_noise @ q_noise
                q_true *= e_true[:, None]
                dh += q_true
                g.flat[:] = 0
                np.add.at(g.Q, noise, e_noise.T @ h)
                np.add.at(g.b, noise, e_noise.sum(0))
                g.b += np.bincount(t, weights=e_true, minlength=self.size)
                h *= e_true[:, None]
                _add_rows(g.Q, t, h.astype(np.float64))
                wide = dh.astype(np.float64)
                for i in range(CONTEXT):
                    g.C[i] += np.einsum("ij,ij->j", dh, rows[i])
                    _add_rows(g.R, c[i], wide, self.C[i])
                step = g.flat
                step /= len(t)
                grad2 += step * step
                self.flat += RATE * step / np.sqrt(grad2 + 1e-8)

    def log_probs(self, target: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        """Normalised natural-log probabilities of the target symbols."""
        out, ones = np.empty(len(target), np.float64), np.ones(self.size, np.float32)
        q = np.ascontiguousarray(np.concatenate([self.Q, self.b[:, None]], 1).T)  # the bias as one more column
        h, s = np.ones((ROWS_AT_ONCE, WIDTH + 1), np.float32), np.empty((ROWS_AT_ONCE, self.size), np.float32)
        with np.errstate(over="ignore"):
            for lo in range(0, len(target), ROWS_AT_ONCE):
                t = target[lo:lo + ROWS_AT_ONCE]
                n, rows = len(t), np.arange(len(t))
                h[:n, :WIDTH] = self.context(ctx[:, lo:lo + ROWS_AT_ONCE])
                e = np.matmul(h[:n], q, out=s[:n])
                at = e[rows, t].astype(np.float64)
                np.exp(e, out=e)
                total = (e @ ones).astype(np.float64)
                if not (total.min() > 1e-20 and total.max() < 1e30):  # beyond single precision: less each row's maximum
                    e = np.matmul(h[:n], q, out=s[:n])
                    e -= e.max(1, keepdims=True)
                    at = e[rows, t].astype(np.float64)
                    total = (np.exp(e, out=e) @ ones).astype(np.float64)
                out[lo:lo + n] = at - np.log(total)
        return out


def _add_rows(into: np.ndarray, rows: np.ndarray, values: np.ndarray, factor=None) -> None:
    """Add ``values`` (doubles; times ``factor`` by column) to the given rows."""
    cells = rows[:, None] * WIDTH + np.arange(WIDTH)
    total = np.bincount(cells.ravel(), values.ravel(), into.size).reshape(into.shape)
    into += total if factor is None else total * factor


def _windows(streams: list[np.ndarray], before: int) -> tuple[np.ndarray, np.ndarray]:
    """Targets and their contexts (CONTEXT, n) for texts as symbol arrays."""
    pad = np.full(CONTEXT, before, np.int16)
    flat = np.concatenate([x for s in streams for x in (pad, s)])
    is_target = np.concatenate([x for s in streams for x in (np.zeros(CONTEXT, bool), np.ones(len(s), bool))])
    at = np.flatnonzero(is_target)
    return flat[at], np.stack([flat[at - i - 1] for i in range(CONTEXT)])


class _Reader:
    """Token -> (known number or -1, symbol), for the words of a task."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab

    def numbers(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Known numbers (-1: not among them), symbols, and the places of the
        tokens that are not known."""
        got = list(map(self.vocab.known.get, tokens))
        odd: list[int] = []
        if None in got:
            odd = [i for i, k in enumerate(got) if k is None]
            for i in odd:
                got[i] = -1
        number = np.array(got, np.int64)
        symbol = self.vocab.known_symbol[number] if len(self.vocab.known_symbol) else np.zeros(len(number), np.int16)
        if odd:
            of = self.vocab.symbols.of
            symbol[odd] = [of(tokens[i]) for i in odd]
        return number, symbol, odd


def _train_round(texts: DataFrame, vocab: Vocabulary, model: Model, seed: int) -> np.ndarray:
    """Average of the partitions' parameters after a pass over their texts."""
    start, size, counts = model.flat, model.size, vocab.symbol_counts

    def run(batches):
        from pyspark import TaskContext
        mine = Model(start.copy(), size)
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        p = counts + 1
        p = p / p.sum()
        grad2, tokens, streams, held = np.full(len(start), 1e-6, np.float32), 0, [], 0

        def learn():
            mine.train(*_windows(streams, size), p, rng, grad2)
            streams.clear()
        for b in batches:
            for symbols in b.column(0).to_pylist():
                streams.append(np.frombuffer(symbols, "<i2"))
                held += len(streams[-1])
                tokens += len(streams[-1])
                if held > 300_000:
                    learn()
                    held = 0
        if streams:
            learn()
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([mine.flat.astype(np.float64)], pa.list_(pa.float64()))], names=["n", "flat"])
    got = texts.filter(~F.col("held_out")).select("symbols").mapInArrow(run, "n bigint, flat array<double>").select("n", F.posexplode("flat").alias("i", "x")).groupBy("i").agg(
        (F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("x")).collect()  # one row for each parameter
    out = start.copy()
    for r in got:
        out[r["i"]] = r["x"]
    return out


class LanguageModel:
    def __init__(self, vocab: Vocabulary, model: Model):
        self.vocab, self.model = vocab, model


def fit(docs: DataFrame, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: DataFrame | None = None,
        vocab: Vocabulary | None = None) -> LanguageModel:
    """Train on the documents that are not held out; ``counts`` is their
    stored :func:`token_counts`, ``texts`` and ``vocab``, where known, the :func:`symbol_texts` of ``docs`` and their
    vocabulary.  Without any training text the model is the uniform one over its symbols."""
    ready(docs.sparkSession)
    vocab = vocab or vocabulary(counts)
    model = Model.start(vocab.symbol_counts)
    if vocab.total:
        texts = symbol_texts(docs, vocab, id_col, text_col) if texts is None else texts
        for k in range(ROUNDS):
            model = Model(_train_round(texts, vocab, model, k), model.size)
    return LanguageModel(vocab, model)


def symbol_texts(docs: DataFrame, vocab: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One stored row per row of ``docs``: id, held_out, n_tokens, known (tokens among the known ones), known_log and
    class_log (sums over them, log10), rare and times (the other tokens and their number), symbols (16-bit numbers of all
    tokens) and row, a number of its own.  Training and scoring read it, so texts are cut into tokens once
    for the counts and once here.  Null ids count as the empty text for the split."""
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(vocab)
    pairs = _pair(docs, id_col, text_col)
    schema = T.StructType([
        T.StructField("id", pairs.schema["id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("known", T.LongType()), T.StructField("known_log", T.DoubleType()), T.StructField("class_log", T.DoubleType()),
        T.StructField("rare", T.ArrayType(T.StringType())), T.StructField("times", T.ArrayType(T.LongType())), T.StructField("symbols", T.BinaryType())])

    def run(batches):
        vocab = shared.value
        reader, own = _Reader(vocab), len(vocab.symbols.words)
        mass = np.concatenate([np.zeros(own), np.log10(vocab.class_mass)])
        known_log = np.append(vocab.known_log, 0.0)  # the last stands for -1, not known

        def finish(group, sums, rare, symbols):
            """Add what the pieces of ``group`` (row, tokens) contribute."""
            tokens = list(itertools.chain.from_iterable(t for _, t in group))
            number, symbol, odd = reader.numbers(tokens)
            ends = np.cumsum([len(t) for _, t in group])
            starts = ends - [len(t) for _, t in group]
            log_c = known_log[number]
            in_class = np.flatnonzero(symbol >= own)
            of_class = np.zeros(len(symbol))
            of_class[in_class] = log_c[in_class] - mass[symbol[in_class]]
            at_rows = [k for k, _ in group]
            for c, x in enumerate((number >= 0, log_c, of_class)):
                np.add.at(sums[:, c], at_rows, np.add.reduceat(x, starts, dtype=np.float64))
            owner = np.searchsorted(ends, odd, side="right") if odd else []
            for i, o in zip(odd, owner):
                rare[at_rows[o]].append(tokens[i])
            for k, lo, hi in zip(at_rows, starts.tolist(), ends.tolist()):
                symbols[k].append(symbol[lo:hi])

        for b in batches:
            sums = np.zeros((b.num_rows, 3))
            rare: list[list[bytes]] = [[] for _ in range(b.num_rows)]
            symbols: list[list[np.ndarray]] = [[] for _ in range(b.num_rows)]
            group, held = [], 0
            for k, raw in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
                for tokens in _tokens(raw):
                    if held + len(tokens) > TOKENS_AT_ONCE and group:
                        finish(group, sums, rare, symbols)
                        group, held = [], 0
                    group.append((k, tokens))
                    held += len(tokens)
            if group:
                finish(group, sums, rare, symbols)
            counted = [Counter(r) for r in rare]
            whole = [np.concatenate(x).astype("<i2", copy=False) for x in symbols]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([held_out(i) for i in b.column(0).to_pylist()], pa.bool_()),
                pa.array([len(x) for x in whole], pa.int64()), pa.array(sums[:, 0].astype(np.int64)), pa.array(sums[:, 1]), pa.array(sums[:, 2]),
                pa.array([list(c) for c in counted], pa.list_(pa.binary())).cast(pa.list_(pa.string())),
                pa.array([list(c.values()) for c in counted], pa.list_(pa.int64())), pa.array([x.tobytes() for x in whole], pa.binary())], names=schema.names)
    return stored(pairs.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))


def _model_logs(texts: DataFrame, model: Model) -> DataFrame:
    """``texts`` with ``model_log``: the log10 probability of the symbols."""
    start, size = model.flat, model.size
    schema = T.StructType([f for f in texts.schema.fields if f.name != "symbols"] + [T.StructField("model_log", T.DoubleType())])
    at = texts.columns.index("symbols")

    def run(batches):
        model, pad = Model(start, size), np.full(CONTEXT, size, np.int16)

        def finish(group, sums):
            """Add the logs of ``group`` (row, context before, symbols)."""
            flat = np.concatenate([x for _, before, s in group for x in (before, s)])
            lengths = np.array([len(s) for _, _, s in group])
            ends = np.cumsum(lengths)
            place = np.arange(ends[-1]) + np.repeat(CONTEXT * np.arange(1, len(group) + 1), lengths)
            logs = model.log_probs(flat[place], np.stack([flat[place - i - 1] for i in range(CONTEXT)]))
            np.add.at(sums, [k for k, _, _ in group], np.add.reduceat(logs, ends - lengths))

        for b in batches:
            sums, group, held = np.zeros(b.num_rows), [], 0
            for k, raw in enumerate(b.column(at).to_pylist()):
                symbols = np.frombuffer(raw, "<i2")
                for lo in range(0, len(symbols), TOKENS_AT_ONCE):
                    part = symbols[lo:lo + TOKENS_AT_ONCE]
                    if held + len(part) > TOKENS_AT_ONCE and group:
                        finish(group, sums)
                        group, held = [], 0
                    group.append((k, symbols[lo - CONTEXT:lo] if lo else pad, part))
                    held += len(part)
            if group:
                finish(group, sums)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(b.num_columns) if i != at], pa.array(sums / math.log(10))], names=schema.names)
    return texts.mapInArrow(run, schema)


def score(docs: DataFrame, counts: DataFrame, lm: LanguageModel, id_col: str = "doc_id", text_col: str = "text",
          texts: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known,
    train_tokens, base_score and score (log10).  Null and empty texts have the
    end as their only token.  ``texts``, where known, are the :func:`symbol_texts` of ``docs`` by the model's vocabulary."""
    ready(docs.sparkSession)
    total, distinct = lm.vocab.total, lm.vocab.distinct
    texts = symbol_texts(docs, lm.vocab, id_col, text_col) if texts is None else texts
    scored = _model_logs(texts.drop("rare", "times"), lm.model)
    rare = texts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("token"), F.col("x.times").alias("k"))
    found = rare.join(counts, "token").groupBy("row").agg(
        F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("log"))
    log = F.coalesce("log", F.lit(0.0))
    return scored.join(found, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("known_log") + log - F.col("n_tokens") * F.lit(math.log10(total + distinct + 1))).alias("base_score"),
        (F.col("model_log") + F.col("class_log") + log).alias("score"))


def scores_digest(docs: DataFrame) -> DataFrame:
    """Query form: count, train and score over all documents."""
    docs = docs.select("doc_id", "text")
    ready(docs.sparkSession)
    counts = stored(token_counts(docs))
    vocab = vocabulary(counts)
    texts = symbol_texts(docs, vocab)
    return score(docs, counts, fit(docs, counts, texts=texts, vocab=vocab), texts=texts)
