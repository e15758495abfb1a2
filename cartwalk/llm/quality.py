"""Quality rules: robust multivariate outliers by language and source.

Built from DataFrame functions only.  Each document gets five counts; their
transformed vector is compared with a minimum-covariance-determinant (MCD)
estimate of its (language, source) group and rejected when its squared
Mahalanobis distance is beyond the chi-square tail ``tail``.

Statistics vector (fixed-point, 1/512): log of the mean word length, and log(1 +
rate) of symbols per thousand words, duplicate lines per hundred lines and
repeated words per hundred words.

MCD.  The ``share`` of a group's rows with the smallest distances is kept, mean
and covariance are taken over it, distances are computed anew, and so on until
the kept set no longer changes (concentration steps).  Two starts are followed
at once, median and MAD of each coordinate and the plain mean and covariance of
all rows; the one that ends with the smaller determinant is taken.  All sums are over
integers, so a task that runs again gives the same bits and verdicts don't
depend on partitioning.  The cut within a step is made on a fixed grid of
distances, which turns "the h smallest" into one aggregate by (group, grid
cell) and a running sum over at most a thousand cells; no group is ever sorted
or collected, and the hot source costs what its rows cost.

Small groups.  Group scatter is pooled with the overall scatter, which counts
as ``prior`` rows, and every variance has the floor ``FLOOR``: the estimate is
regular for a group of one row and moves smoothly towards the group's own as it
grows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwalk.llm.common import WORD_SEPARATORS, fresh, quoted, ready, stored

SYMBOLS = "#*$%&|<>"
P = 4
UNIT = 512
# Standard deviations no coordinate goes below: chance variation of a short
# text, and rates that are zero in nearly every document.  With ``TAIL`` a
# coordinate alone passes the cut at 4.85 floors from its group's mean.  Rates
# end at log(101) (duplicate lines) and log(51) (repeated words past the base
# rules), so the floors of these must stay below 0.95 and 0.81.
FLOOR = (0.07, 0.85, 0.7, 0.6)
SHARE = 0.75
PRIOR = 50
TAIL = 1e-4
GRID = 64
MAX_STEPS = 20
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def statistics(text: Column) -> Column:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a
    text as one struct (all long, all 0 for null and empty texts)."""
    t = F.coalesce(text, F.lit(""))
    split = F.filter(F.split(t, WORD_SEPARATORS), lambda x: x != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def bound(value: Column, body) -> Column:
        """``body(value)`` with ``value`` evaluated once."""
        return F.element_at(F.transform(F.array(value), body), 1)

    def covered(w: Column) -> Column:
        n = F.size(w)
        grams = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(
            F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

        def repeated(s: Column) -> Column:
            at = F.filter(F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda j: F.when(
                (F.get(s, j)["h"] == F.get(s, j + 1)["h"]) | (F.get(s, j)["h"] == F.get(s, j - 1)["h"]), F.get(s, j)["i"])),
                lambda x: x.isNotNull())
            return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))
        return F.when(n < 3, F.lit(0)).otherwise(bound(F.sort_array(grams), repeated))

    def all_of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            bound(lines, F.size).cast("long").alias("n_lines"),
            covered(w).cast("long").alias("n_repeat_words"))
    return bound(split, all_of)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def vector(s: Column) -> Column:
    """The transformed statistics as an array of fixed-point longs."""
    n = F.greatest(s["n_words"], F.lit(1))

    def fixed(x):
        return F.round(x * UNIT).cast("long")

    def rate(k, total, per):
        return fixed(F.log1p(F.lit(float(per)) * k / total))
    return F.array(
        fixed(F.log(F.greatest(s["word_chars"], F.lit(1)) / n)),
        rate(s["n_symbols"], n, 1000), rate(s["n_dup_lines"], F.greatest(s["n_lines"], F.lit(1)), 100),
        rate(s["n_repeat_words"], n, 100))


def _chi2_cdf(x: float, k: int) -> float:
    """Chi-square distribution function for an even number of degrees."""
    term = total = 1.0
    for i in range(1, k // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def _chi2_upper(tail: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        term = total = 1.0
        for i in range(1, k // 2):
            term *= mid / 2 / i
            total += term
        lo, hi = (mid, hi) if math.exp(-mid / 2) * total > tail else (lo, mid)
    return lo


def _distance() -> Column:
    """Squared Mahalanobis distance of the columns v, m0.., l00.. by forward
    substitution in the Cholesky factor."""
    y: list[Column] = []
    for i in range(P):
        x = F.col("v")[i] / F.lit(float(UNIT)) - F.col(f"m{i}")
        for j in range(i):
            x = x - F.col(f"l{i}{j}") * y[j]
        y.append(x / F.col(f"l{i}{i}"))
    return sum((a * a for a in y[1:]), y[0] * y[0])


def _factor(df: DataFrame) -> DataFrame:
    """Columns c00.. (covariance) -> Cholesky factor l00.. and its log
    determinant."""
    for i in range(P):
        for j in range(i + 1):
            s = F.col(f"c{i}{j}")
            for k in range(j):
                s = s - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            df = df.withColumn(f"l{i}{j}", F.sqrt(s) if i == j else s / F.col(f"l{j}{j}"))
    return df.withColumn("logdet", sum((F.log(F.col(f"l{i}{i}")) for i in range(1, P)), F.log("l00")))


def _sums(weight=1) -> list[Column]:
    return [F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(P)] + [
        F.sum(F.col("v")[i] * F.col("v")[j]).alias(f"q{i}{j}") for i, j in PAIRS]


_SUM_COLS = ["n", *[f"s{i}" for i in range(P)], *[f"q{i}{j}" for i, j in PAIRS]]


def _estimates(sums: DataFrame, prior: float, scale: float) -> DataFrame:
    """(lang, source, start) sums over the kept rows -> mean m0.., Cholesky
    factor l00.. and logdet, pooled with all groups of the same start."""
    total = sums.groupBy("start").agg(*[F.sum(c).alias("t" + c) for c in _SUM_COLS])
    df = sums.join(F.broadcast(total), "start")  # one row for each start
    n, tn = F.col("n").cast("double"), F.col("tn").cast("double")

    def mean(i, s="s", k=n):
        return F.col(f"{s}{i}") / k / UNIT

    def scatter(i, j, q, s, k):
        return F.col(f"{q}{i}{j}") / k / (UNIT * UNIT) - mean(i, s, k) * mean(j, s, k)
    own = n / (n + prior)
    return _factor(df.select(
        "lang", "source", "start", F.col("n").alias("kept_n"), F.col("s0").alias("kept_s"),
        *[(own * mean(i) + (1 - own) * mean(i, "ts", tn)).alias(f"m{i}") for i in range(P)],
        *[(scale * (own * scatter(i, j, "q", "s", n) + (1 - own) * scatter(i, j, "tq", "ts", tn))
           + F.lit(FLOOR[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in PAIRS])).drop(*[f"c{i}{j}" for i, j in PAIRS])


def _beside(rows: DataFrame, by_group: DataFrame) -> DataFrame:
    """``rows`` with the columns of their group, null keys included."""
    g = by_group.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    return rows.join(g, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))).drop("_lang", "_source")


def estimate(rows: DataFrame, share: float = SHARE, prior: float = PRIOR) -> DataFrame:
    """MCD estimates of every group: ``rows`` (lang, source, v) -> lang,
    source, m0.., l00...  Null languages and sources are values of their own."""
    rows = stored(rows)
    keys = ["lang", "source"]
    q = _chi2_upper(1 - share, P)
    scale = share / _chi2_cdf(q, P + 2)  # consistency at the normal distribution

    everything = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *_sums()).withColumn("start", F.lit("all"))
    plain = _estimates(everything, prior, 1.0)
    # Exact medians: the coordinates take a bounded number of fixed-point values.
    med = rows.groupBy(*keys).agg(*[F.percentile(F.col("v")[i], 0.5).alias(f"k{i}") for i in range(P)])
    mad = _beside(rows, med).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("kept_n"), F.sum(F.col("v")[0]).alias("kept_s"),
        *[(F.first(f"k{i}") / UNIT).alias(f"m{i}") for i in range(P)],
        *[(F.percentile(F.abs(F.col("v")[i] - F.col(f"k{i}")), 0.5) * 1.4826 / UNIT).alias(f"d{i}") for i in range(P)])
    robust = _factor(mad.select(*keys, F.lit("mad").alias("start"), "kept_n", "kept_s", *[f"m{i}" for i in range(P)], *[
        (F.col(f"d{i}") ** 2 + FLOOR[i] ** 2 if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS])).drop(*[f"c{i}{j}" for i, j in PAIRS])
    now = stored(plain.unionByName(robust))

    by_cell = Window.partitionBy(*keys, "start").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys, "start")
    for _ in range(MAX_STEPS):
        cells = (_beside(rows, now).withColumn("cell", F.floor(F.log1p(_distance()) * GRID).cast("int"))
                 .groupBy(*keys, "start", "cell").agg(F.count(F.lit(1)).alias("n"), *_sums()))
        kept = (cells.withColumn("below", F.coalesce(F.sum("n").over(by_cell), F.lit(0)))
                .withColumn("all", F.sum("n").over(whole)).filter(F.col("below") < F.lit(share) * F.col("all"))
                .groupBy(*keys, "start").agg(*[F.sum(c).alias(c) for c in _SUM_COLS]))
        new = stored(_estimates(kept, prior, scale))
        moved = new.alias("x").join(now.alias("y"), F.expr(
            "x.lang <=> y.lang AND x.source <=> y.source AND x.start = y.start AND x.kept_n = y.kept_n AND x.kept_s = y.kept_s"), "left_anti")
        now, done = new, moved.isEmpty()
        if done:
            break
    cols = [*[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i, j in PAIRS]]
    best = now.groupBy(*keys).agg(F.min(F.struct("logdet", "start", *cols)).alias("b"))
    return best.select(*keys, *[F.col("b")[c].alias(c) for c in cols])


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          share: float = SHARE, prior: float = PRIOR, tail: float = TAIL) -> DataFrame:
    """``docs`` with one struct column more, ``_quality`` (prefixed by
    underscores if taken): the counts of :func:`statistics`, base_failed, d2 (squared
    distance, null where base_failed) and kept.

    Estimates are fitted on the rows that pass the base rules and cover all of
    them.  Null and empty texts have no words and fail the base rules.  Equal
    rows get equal verdicts.  An empty table gives an empty one.  Counts are
    generated beside the rows, as the optimiser would copy a plain expression
    into each place that uses it; texts are split once for the estimate and once for the verdict.
    """
    ready(docs.sparkSession)
    out = fresh("_quality", docs)
    measured = docs.withColumn(out, F.explode(F.array(statistics(quoted(text_col)))))
    s = F.col(out)
    rows = measured.filter(~base_failed(s)).select(
        quoted(lang_col).alias("lang"), quoted(source_col).alias("source"), vector(s).alias("v"))
    return _judged(measured, out, lang_col, source_col, estimate(rows, share, prior), tail)


def _judged(measured: DataFrame, out: str, lang_col: str, source_col: str, fit: DataFrame, tail: float) -> DataFrame:
    names = {c: fresh("_fit_" + c, measured) for c in fit.columns}
    fit = fit.select(*[F.col(c).alias(n) for c, n in names.items()])
    s = F.col(out)
    failed = base_failed(s)
    near = measured.join(fit, quoted(lang_col).eqNullSafe(F.col(names["lang"])) & quoted(source_col).eqNullSafe(F.col(names["source"])), "left")
    v, y = vector(s), []
    for i in range(P):
        x = v[i] / F.lit(float(UNIT)) - F.col(names[f"m{i}"])
        for j in range(i):
            x = x - F.col(names[f"l{i}{j}"]) * y[j]
        y.append(x / F.col(names[f"l{i}{i}"]))
    d2 = F.when(~failed, sum((a * a for a in y[1:]), y[0] * y[0]))
    return near.withColumn(out, F.struct(
        *[s[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"), d2.alias("d2"), (~failed & (d2 <= F.lit(_chi2_upper(tail, P)))).alias("kept"))
    ).select(*[quoted(c) for c in measured.columns])


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``docs`` without the documents the rules reject."""
    judged = judge(docs, text_col, lang_col, source_col)
    return judged.filter(F.col(judged.columns[-1])["kept"]).select(*[quoted(c) for c in docs.columns])


def quality_digest(docs: DataFrame) -> DataFrame:
    """Query form: the counts and both verdicts for every document.  The
    counts are stored once, so texts are read and split a single time."""
    ready(docs.sparkSession)
    measured = stored(docs.select("doc_id", "lang", "source", statistics(F.col("text")).alias("q")))
    s = F.col("q")
    rows = measured.filter(~base_failed(s)).select("lang", "source", vector(s).alias("v"))
    judged = _judged(measured, "q", "lang", "source", estimate(rows), TAIL)
    return judged.select("doc_id", *[s[c].alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])
