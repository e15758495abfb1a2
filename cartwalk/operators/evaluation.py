"""Hold-out evaluation of ranked lists: accuracy, coverage, diversity and
novelty metrics at several cutoffs.

Inputs are long tables:

* ``ranking``  (session_id, item_id, rank)   the lists, rank 1..max cutoff
* ``test``     (session_id, item_id, score)  held-out interactions (ratings)
* ``pop_src``  (session_id, item_id[, score]) the matrix popularity metrics
                read (the recommender's current profile matrix)

Every metric is a grouped aggregation: per (cutoff, user) sums over the
list, then per cutoff means; item-distribution metrics aggregate per
(cutoff, item) counts.  Cutoffs are attached with a generator (``explode``
of a literal array), never a join.  The mergeable metric state of the
reference is Spark's own partial/final aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartwalk.functions.exprs import r6, safe_div
from cartwalk.operators.ids import with_scalar

# Metric names in report order.
METRICS = [
    "PRECISION", "PRECISION_RECALL_MIN_DEN", "RECALL", "MAP", "MAP_MIN_DEN", "MRR", "NDCG", "F1",
    "HIT_RATE", "ARHR_ALL_HITS", "NOVELTY", "AVERAGE_POPULARITY", "DIVERSITY_SIMILARITY",
    "DIVERSITY_MEAN_INTER_LIST", "DIVERSITY_HERFINDAHL", "COVERAGE_ITEM", "COVERAGE_ITEM_CORRECT",
    "COVERAGE_USER", "COVERAGE_USER_CORRECT", "DIVERSITY_GINI", "SHANNON_ENTROPY",
    "RATIO_DIVERSITY_HERFINDAHL", "RATIO_DIVERSITY_GINI", "RATIO_SHANNON_ENTROPY",
    "RATIO_AVERAGE_POPULARITY", "RATIO_NOVELTY",
]


def remove_items(df: DataFrame, items: DataFrame | None) -> DataFrame:
    if items is None:
        return df
    return df.join(items.select("item_id").distinct(), "item_id", "left_anti")


def eval_users(test: DataFrame, ignore_items: DataFrame | None = None,
               ignore_users: DataFrame | None = None, min_ratings: int = 1) -> DataFrame:
    """Users with at least ``min_ratings`` test interactions after the
    ignored items are removed, minus ignored users."""
    t = remove_items(test, ignore_items)
    u = (t.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
         .filter(F.col("n") >= min_ratings).select("session_id"))
    if ignore_users is not None:
        u = u.join(ignore_users.select("session_id"), "session_id", "left_anti")
    return u


def eval_relevance(ranking: DataFrame, test: DataFrame, users: DataFrame, cutoffs: list[int]) -> DataFrame:
    """(cutoff, session_id, item_id, rank, rel, rating, cumhits) for the
    list of every evaluated user cut at each cutoff."""
    rel = test.select("session_id", "item_id", F.col("score").cast("double").alias("rating"))
    r = (
        ranking.select("session_id", "item_id", "rank")
        .join(users, "session_id", "left_semi")
        .join(rel, ["session_id", "item_id"], "left")
        .withColumn("rel", F.col("rating").isNotNull().cast("int"))
        .withColumn("rating", F.coalesce("rating", F.lit(0.0)))
    )
    w = Window.partitionBy("session_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("cumhits", F.sum("rel").over(w))
    ks = F.array(*[F.lit(int(k)) for k in cutoffs])
    return r.select(F.explode(ks).alias("cutoff"), "*").filter(F.col("rank") <= F.col("cutoff"))


def _user_frame(users: DataFrame, cutoffs: list[int]) -> DataFrame:
    ks = F.array(*[F.lit(int(k)) for k in cutoffs])
    return users.select(F.explode(ks).alias("cutoff"), "session_id")


def user_metrics(rel: DataFrame, test: DataFrame, users: DataFrame, cutoffs: list[int]) -> DataFrame:
    """Per (cutoff, user) accuracy terms.  Relevant counts and the ideal DCG
    read the whole test table (reference behaviour)."""
    per = rel.groupBy("cutoff", "session_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("rel").alias("hits"),
        F.sum(F.col("rel") * F.col("cumhits") / F.col("rank")).alias("ap_sum"),
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first_hit"),
        F.sum(F.col("rel") / F.col("rank")).alias("arhr"),
        F.sum((F.pow(F.lit(2.0), F.col("rating")) - 1) / F.log2(F.col("rank") + 1)).alias("dcg"),
    )
    tcount = test.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_test"))
    ideal_w = Window.partitionBy("session_id").orderBy(F.col("score").desc(), F.col("item_id"))
    # only the first max(cutoff) ideal positions matter; filtering right after
    # row_number lets Spark keep at most that many rows per user per task
    ideal = test.select("session_id", "item_id", F.col("score").cast("double").alias("score")).withColumn(
        "pos", F.row_number().over(ideal_w)).filter(F.col("pos") <= max(cutoffs))
    ks = F.array(*[F.lit(int(k)) for k in cutoffs])
    idcg = (ideal.select(F.explode(ks).alias("cutoff"), "*").filter(F.col("pos") <= F.col("cutoff"))
            .groupBy("cutoff", "session_id")
            .agg(F.sum((F.pow(F.lit(2.0), F.col("score")) - 1) / F.log2(F.col("pos") + 1)).alias("idcg")))
    base = _user_frame(users, cutoffs).join(per, ["cutoff", "session_id"], "left").join(
        tcount, "session_id", "left").join(idcg, ["cutoff", "session_id"], "left")
    n = F.coalesce("n", F.lit(0))
    hits = F.coalesce("hits", F.lit(0)).cast("double")
    mind = F.least(F.col("n_test"), n)
    return base.select(
        "cutoff", "session_id", n.alias("n"), hits.alias("hits"),
        F.when(n > 0, hits / n).otherwise(0.0).alias("precision"),
        F.when(n > 0, safe_div(hits, mind)).otherwise(0.0).alias("prec_min_den"),
        safe_div(hits, F.col("n_test")).alias("recall"),
        F.when(n > 0, F.coalesce("ap_sum", F.lit(0.0)) / n).otherwise(0.0).alias("ap"),
        F.when(n > 0, safe_div(F.coalesce("ap_sum", F.lit(0.0)), mind)).otherwise(0.0).alias("ap_min_den"),
        F.coalesce(F.lit(1.0) / F.col("first_hit"), F.lit(0.0)).alias("rr"),
        F.coalesce("arhr", F.lit(0.0)).alias("arhr"),
        F.when((F.coalesce("dcg", F.lit(0.0)) == 0) | (F.coalesce("idcg", F.lit(0.0)) == 0), 0.0)
        .otherwise(safe_div(F.col("dcg"), F.col("idcg"))).alias("ndcg"),
        (hits > 0).cast("double").alias("hit"),
    )


def item_popularity(pop_src: DataFrame) -> DataFrame:
    """Stored interactions per item of the popularity source."""
    return pop_src.groupBy("item_id").agg(F.count(F.lit(1)).alias("pop"))


def novelty_terms(rel: DataFrame, pop: DataFrame, n_items_df: DataFrame) -> DataFrame:
    """Per (cutoff, user): novelty and average-popularity terms."""
    tot = pop.agg(F.sum("pop").alias("n_inter"), F.max("pop").alias("max_pop"))
    x = with_scalar(with_scalar(rel.join(pop, "item_id", "left"), tot), n_items_df)
    p = F.coalesce("pop", F.lit(0)) / F.col("n_inter")
    return x.groupBy("cutoff", "session_id").agg(
        F.coalesce(F.sum(F.when(p > 0, -F.log2(p) / F.col("n_items"))), F.lit(0.0)).alias("novelty"),
        (F.sum(F.coalesce("pop", F.lit(0)) / F.col("max_pop")) / F.count(F.lit(1))).alias("avg_pop"),
    )


def train_side(pop_src: DataFrame, n_items_df: DataFrame) -> DataFrame:
    """Novelty and average popularity of the popularity source itself,
    averaged over all its users (the ratio denominators)."""
    pop = item_popularity(pop_src)
    rows = pop_src.select("session_id", "item_id")
    tot = pop.agg(F.sum("pop").alias("n_inter"), F.max("pop").alias("max_pop"))
    x = with_scalar(with_scalar(rows.join(pop, "item_id"), tot), n_items_df)
    per = x.groupBy("session_id").agg(
        F.sum(-F.log2(F.col("pop") / F.col("n_inter")) / F.col("n_items")).alias("nov"),
        (F.sum(F.col("pop") / F.col("max_pop")) / F.count(F.lit(1))).alias("ap"))
    return per.agg(F.avg("nov").alias("train_novelty"), F.avg("ap").alias("train_avg_pop"))


def distribution(counts: DataFrame, n_eff: DataFrame, keys: list[str], c: str = "c") -> DataFrame:
    """Gini, Herfindahl and Shannon of per-item counts by ``keys``.

    counts: (keys..., item_id, c) with c > 0; n_eff: one row ``n_eff`` = items
    in the universe minus ignored.  Zero-count items sit first in the
    ascending order; tied counts form one block whose position sum is
    closed-form, so the window runs over distinct count values only.
    """
    tot = counts.groupBy(*keys).agg(
        F.sum(c).alias("total"), F.count(F.lit(1)).alias("nz"),
        F.sum(F.pow(F.col(c), 2)).alias("sq"))
    blocks = counts.groupBy(*keys, c).agg(F.count(F.lit(1)).alias("g"))
    w = Window.partitionBy(*keys).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("below", F.coalesce(F.sum("g").over(w), F.lit(0)))
    b = with_scalar(blocks.join(tot, keys), n_eff)
    z = F.col("n_eff") - F.col("nz")
    start = z + F.col("below")
    pos_sum = F.col("g") * start + F.col("g") * (F.col("g") + 1) / 2
    gini_terms = b.groupBy(*keys).agg(
        F.sum(F.col(c) * (F.col("g") * (F.col("n_eff") + 1) - pos_sum)
              / (F.col("n_eff") + 1) / F.col("total")).alias("gini_half"))
    ent = counts.join(tot, keys).groupBy(*keys).agg(
        (-F.sum((F.col(c) / F.col("total")) * F.log2(F.col(c) / F.col("total")))).alias("shannon"))
    return (tot.join(gini_terms, keys).join(ent, keys)
            .select(*keys, "total", "sq",
                    (F.lit(2.0) * F.col("gini_half")).alias("gini"),
                    F.when(F.col("total") != 0, F.lit(1.0) - F.col("sq") / F.pow(F.col("total"), 2)).alias("herfindahl"),
                    "shannon"))


@dataclass
class EvalInputs:
    ranking: DataFrame
    test: DataFrame
    pop_src: DataFrame
    items: DataFrame                 # item universe (n_items)
    user_universe: DataFrame         # users of the test matrix (n_users)
    cutoffs: list
    ignore_items: DataFrame | None = None
    ignore_users: DataFrame | None = None
    min_ratings: int = 1
    diversity: DataFrame | None = None   # (item_a, item_b, d) for M14
    exact_pairs: bool = False


def evaluate(e: EvalInputs) -> DataFrame:
    """One row per cutoff with all metrics (wide)."""
    from cartwalk.session import materialize
    users = eval_users(e.test, e.ignore_items, e.ignore_users, e.min_ratings)
    # the cut lists with relevance flags feed every metric family: stored once
    rel = materialize(eval_relevance(e.ranking, e.test, users, e.cutoffs))
    um = user_metrics(rel, e.test, users, e.cutoffs)
    items = e.items.select("item_id").distinct()
    n_items_df = items.agg(F.count(F.lit(1)).alias("n_items"))
    ign = (items.join(e.ignore_items.select("item_id").distinct(), "item_id", "left_semi")
           if e.ignore_items is not None else items.limit(0))
    n_ign = ign.agg(F.count(F.lit(1)).alias("n_ign"))
    n_users_df = e.user_universe.select("session_id").distinct().agg(F.count(F.lit(1)).alias("n_users"))
    n_ign_u = (e.ignore_users.select("session_id").distinct().agg(F.count(F.lit(1)).alias("n_ign_u"))
               if e.ignore_users is not None else um.sparkSession.range(1).select(F.lit(0).cast("long").alias("n_ign_u")))
    pop = item_popularity(e.pop_src)
    nov = novelty_terms(rel, pop, n_items_df)
    um = um.join(nov, ["cutoff", "session_id"], "left")
    if e.diversity is not None:
        um = um.join(diversity_similarity_terms(rel, e.diversity, e.exact_pairs), ["cutoff", "session_id"], "left")
    else:
        um = um.withColumn("div_sim", F.lit(None).cast("double"))

    acc = um.groupBy("cutoff").agg(
        F.count(F.lit(1)).alias("n_eval"),
        F.avg("precision").alias("PRECISION"),
        F.avg("prec_min_den").alias("PRECISION_RECALL_MIN_DEN"),
        F.avg("recall").alias("RECALL"),
        F.avg("ap").alias("MAP"),
        F.avg("ap_min_den").alias("MAP_MIN_DEN"),
        F.avg("rr").alias("MRR"),
        F.avg("ndcg").alias("NDCG"),
        F.avg("hit").alias("HIT_RATE"),
        F.avg("arhr").alias("ARHR_ALL_HITS"),
        (F.sum(F.coalesce("novelty", F.lit(0.0))) / F.count(F.lit(1))).alias("NOVELTY"),
        (F.sum(F.coalesce("avg_pop", F.lit(0.0))) / F.count(F.lit(1))).alias("AVERAGE_POPULARITY"),
        (F.sum(F.coalesce("div_sim", F.lit(0.0))) / F.count(F.lit(1))).alias("DIVERSITY_SIMILARITY"),
        F.sum((F.col("n") > 0).cast("long")).alias("n_cov_users"),
        F.sum((F.col("hits") > 0).cast("long")).alias("n_cov_users_ok"),
    )
    # item counters (ignored items removed, as the reference masks them)
    rel_kept = remove_items(rel, e.ignore_items)
    counts = rel_kept.groupBy("cutoff", "item_id").agg(
        F.count(F.lit(1)).alias("c"), F.sum("rel").alias("c_ok"))
    n_eff = with_scalar(n_items_df, n_ign).select((F.col("n_items") - F.col("n_ign")).alias("n_eff"))
    dist = distribution(counts.select("cutoff", "item_id", "c"), n_eff, ["cutoff"])
    cov = counts.groupBy("cutoff").agg(
        F.count(F.lit(1)).alias("n_rec_items"),
        F.sum((F.col("c_ok") > 0).cast("long")).alias("n_rec_items_ok"))
    inter = rel.groupBy("cutoff", "item_id").agg(F.count(F.lit(1)).alias("c")).groupBy("cutoff").agg(
        F.sum(F.pow("c", 2)).alias("sq_all"))
    # train side of the ratio metrics
    tr_counts = remove_items(pop, e.ignore_items).select(F.lit(0).alias("_k"), "item_id", F.col("pop").alias("c"))
    tr = distribution(tr_counts, n_eff, ["_k"]).drop("_k", "total", "sq").select(
        F.col("gini").alias("tr_gini"), F.col("herfindahl").alias("tr_herf"), F.col("shannon").alias("tr_shannon"))
    trn = train_side(e.pop_src, n_items_df)
    gt_items = remove_items(e.test.select("item_id").distinct().join(items, "item_id", "left_semi"), e.ignore_items) \
        .agg(F.count(F.lit(1)).alias("n_gt_items"))
    gt_users = e.test.select("session_id").distinct()
    if e.ignore_users is not None:
        gt_users = gt_users.join(e.ignore_users.select("session_id"), "session_id", "left_anti")
    gt_users = gt_users.agg(F.count(F.lit(1)).alias("n_gt_users"))

    x = acc.join(dist, "cutoff", "left").join(cov, "cutoff", "left").join(inter, "cutoff", "left")
    for s in (n_items_df, n_ign, n_eff, n_users_df, n_ign_u, tr, trn, gt_items, gt_users):
        x = with_scalar(x, s)
    U = F.col("n_eval").cast("double")
    k = F.col("cutoff").cast("double")
    pairs = U * U - U
    denom_u = F.col("n_users") - F.col("n_ign_u")
    P_, R_ = F.col("PRECISION"), F.col("RECALL")
    return x.select(
        F.col("cutoff").cast("long").alias("cutoff"),
        "PRECISION", "PRECISION_RECALL_MIN_DEN", "RECALL", "MAP", "MAP_MIN_DEN", "MRR", "NDCG",
        F.when(P_ + R_ != 0, safe_div(2 * P_ * R_, P_ + R_)).otherwise(0.0).alias("F1"),
        "HIT_RATE", "ARHR_ALL_HITS", "NOVELTY", "AVERAGE_POPULARITY", "DIVERSITY_SIMILARITY",
        safe_div(pairs - safe_div(F.coalesce("sq_all", F.lit(0.0)) - U * k, k), pairs)
        .alias("DIVERSITY_MEAN_INTER_LIST"),
        F.col("herfindahl").alias("DIVERSITY_HERFINDAHL"),
        safe_div(F.coalesce("n_rec_items", F.lit(0)), F.col("n_eff")).alias("COVERAGE_ITEM"),
        safe_div(F.coalesce("n_rec_items_ok", F.lit(0)), F.col("n_eff")).alias("COVERAGE_ITEM_CORRECT"),
        safe_div(F.col("n_cov_users"), denom_u).alias("COVERAGE_USER"),
        safe_div(F.col("n_cov_users_ok"), denom_u).alias("COVERAGE_USER_CORRECT"),
        F.col("gini").alias("DIVERSITY_GINI"),
        F.col("shannon").alias("SHANNON_ENTROPY"),
        safe_div(F.col("herfindahl"), F.col("tr_herf")).alias("RATIO_DIVERSITY_HERFINDAHL"),
        safe_div(F.col("gini"), F.col("tr_gini")).alias("RATIO_DIVERSITY_GINI"),
        safe_div(F.col("shannon"), F.col("tr_shannon")).alias("RATIO_SHANNON_ENTROPY"),
        safe_div(F.col("AVERAGE_POPULARITY"), F.col("train_avg_pop")).alias("RATIO_AVERAGE_POPULARITY"),
        safe_div(F.col("NOVELTY"), F.col("train_novelty")).alias("RATIO_NOVELTY"),
        (1 - safe_div(safe_div((U * k) * (U * k), F.col("n_items")) - U * k, k * pairs))
        .alias("DIVERSITY_MEAN_INTER_LIST_MAX"),
        safe_div(F.col("n_gt_items"), F.col("n_eff")).alias("ITEMS_IN_GT"),
        safe_div(F.col("n_gt_users"), denom_u).alias("USERS_IN_GT"),
        F.col("n_eval").cast("long").alias("n_users_evaluated"),
    )


def diversity_similarity_terms(rel: DataFrame, emb: DataFrame, exact: bool = False) -> DataFrame:
    """M14 per (cutoff, user): sum of pair diversities over n(n-1).

    ``emb`` is (item_id, v, nrm) from ``item_vectors``; the diversity of a
    pair is (1 - cosine) / 2, zero when an item has no vector.  No pairs are
    formed: with unit vectors u, m of them in the list and their sum S, the
    pairs whose first item is a add up to (m - u_a . S) / 2, so a list costs one
    pass over its vectors (at most cutoff of them).  Reference mode skips pairs whose first item
    is the last of the list; ``exact`` uses all ordered pairs; a one-item
    list gives null.
    """
    unit = emb.select("item_id", F.transform("v", lambda x: x / F.col("nrm")).alias("u"))
    lists = rel.select("cutoff", "session_id", "item_id", "rank").join(unit, "item_id", "left").groupBy("cutoff", "session_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("rank").alias("last"),
        F.sort_array(F.collect_list(F.when(F.col("u").isNotNull(), F.struct("rank", "u")))).alias("vs"))

    def total(vectors):
        zero = F.transform(F.element_at(vectors, 1)["u"], lambda x: F.lit(0.0))
        return F.aggregate(vectors, zero, lambda acc, x: F.zip_with(acc, x["u"], lambda p, q: p + q))
    firsts = F.col("vs") if exact else F.filter("vs", lambda x: x["rank"] != F.col("last"))
    sums = lists.withColumn("fs", firsts).withColumn("S", F.when(F.size("vs") > 0, total(F.col("vs")))).withColumn(
        "T", F.when(F.size("fs") > 0, total(F.col("fs"))))
    dot = F.aggregate(F.zip_with("S", "T", lambda p, q: p * q), F.lit(0.0).cast("double"), lambda acc, x: acc + x)
    s = F.coalesce((F.size("vs") * F.size("fs") - dot) / 2, F.lit(0.0))
    return sums.select("cutoff", "session_id",
                       (s / F.when(F.col("n") > 1, F.col("n") * (F.col("n") - 1))).alias("div_sim"))


def item_vectors(emb: DataFrame) -> DataFrame:
    """(item_id, v, nrm) from the embeddings table, vec_id as item."""
    e = emb.select(F.col("vec_id").alias("item_id"),
                   F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return e.withColumn("nrm", F.sqrt(F.aggregate(F.transform("v", lambda x: x * x),
                                                  F.lit(0.0).cast("double"), lambda acc, x: acc + x)))


def eval_report(wide: DataFrame) -> DataFrame:
    """(cutoff, metric, value, line) with ``CUTOFF: k - NAME: v`` text."""
    cols = [m for m in METRICS if m in wide.columns]
    stack = "stack({n}, {args}) AS (metric, value)".format(
        n=len(cols), args=", ".join(f"'{m}', CAST(`{m}` AS DOUBLE)" for m in cols))
    long = wide.select("cutoff", F.expr(stack)).withColumn("value", r6("value"))
    return long.select(
        "cutoff", "metric", "value",
        F.format_string("CUTOFF: %d - %s: %.7f", F.col("cutoff"), F.col("metric"), F.col("value")).alias("line"))


def failed_users(rel_or_ranking: DataFrame, test: DataFrame, users: DataFrame, cutoff: int) -> DataFrame:
    """Evaluated users whose list at ``cutoff`` has no hit."""
    rel = eval_relevance(rel_or_ranking, test, users, [cutoff])
    hit_users = rel.filter(F.col("rel") == 1).select("session_id").distinct()
    return users.join(hit_users, "session_id", "left_anti")


def mrr_frame(pred: DataFrame) -> DataFrame:
    """M7: MRR of a labelled prediction frame (session_id, rank, target)."""
    per = pred.groupBy("session_id").agg(F.min(F.when(F.col("target") == 1, F.col("rank"))).alias("fh"))
    return per.agg(F.avg(F.coalesce(F.lit(1.0) / F.col("fh"), F.lit(0.0))).alias("mrr"))
