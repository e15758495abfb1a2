"""Registered queries: item-feature enrichment and imputation (E1-E31, IO4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartwalk.functions.exprs import r6
from cartwalk.operators import assignment as AS
from cartwalk.operators import enrichment as EN
from cartwalk.operators import imputation as IM
from cartwalk.operators import networks as NW
from cartwalk.operators.ids import with_scalar
from cartwalk.plans.registry import query
from cartwalk.plans.sqlroles import R6, with_roles
from cartwalk.session import materialize
from cartwalk.sources import io as IO

# Vocabulary: category -> sorted literals observed on train-purchased items.
VOCAB_CTES = """
catmap AS (SELECT * FROM (VALUES (30, 'colour'), (55, 'brand'), (68, 'product'), (72, 'type')) t(feature_category_id, category_literal)),
vocab AS (
  SELECT feature_category_literal AS category, list_sort(list(DISTINCT feature_value_literal)) AS literals
  FROM feature_values WHERE item_id IN (SELECT item_id FROM train_purchases) GROUP BY 1),
vocab_x AS (SELECT category, unnest(literals) AS literal FROM vocab),
used AS (SELECT DISTINCT feature_category_literal AS category, feature_value_literal AS literal FROM item_features
  WHERE feature_category_literal IS NOT NULL AND feature_value_literal IS NOT NULL)"""


def vocab(ctx):
    fv = ctx.r.feature_values().join(ctx.r.train_purchases().select("item_id").distinct(), "item_id", "left_semi")
    return EN.vocabulary_from(fv)


def sub_vocab(ctx):
    """Alternative colour / type lists for the footwear and accessory
    subgroups, observed on their own train-purchased items."""
    prod = product_of(ctx)
    fv = (ctx.r.feature_values().join(ctx.r.train_purchases().select("item_id").distinct(), "item_id", "left_semi")
          .join(prod, "item_id").filter(F.col("feature_category_literal").isin("colour", "type")))
    return (fv.groupBy("subgroup", F.col("feature_category_literal").alias("category"))
            .agg(F.array_sort(F.collect_set("feature_value_literal")).alias("literals")))


def product_of(ctx):
    groups = [(g, p) for g, ps in EN.SUBGROUPS.items() for p in ps]
    m = F.broadcast(ctx.spark.createDataFrame(groups, "subgroup STRING, product STRING"))
    prod = ctx.r.feature_values().filter(F.col("feature_category_id") == 68).select(
        "item_id", F.col("feature_value_literal").alias("product"))
    return prod.join(m, "product").select("item_id", "subgroup")


@query("vocab_explode", with_roles("SELECT category, CAST(pos AS BIGINT) AS pos, literal FROM ("
                                   "SELECT category, unnest(literals) AS literal, unnest(range(1, len(literals) + 1)) AS pos FROM vocab)",
                                   VOCAB_CTES))
def vocab_explode(ctx):
    """IO4: the vocabulary written as JSON and read back to (category, pos, literal)."""
    js = EN.vocab_to_json(vocab(ctx))
    return EN.vocab_explode(EN.vocab_from_json(js))


@query("feat_category_literal", with_roles("""
SELECT f.item_id, f.feature_category_id, f.feature_value_id, m.category_literal
FROM item_features f LEFT JOIN catmap m USING (feature_category_id)""", VOCAB_CTES))
def feat_category_literal(ctx):
    """Category id to literal."""
    return EN.feat_category_literal(ctx.r.item_features())


CYCLIC = """
e1 AS (SELECT f.item_id, f.feature_category_id, f.feature_value_id, m.category_literal
       FROM item_features f LEFT JOIN catmap m USING (feature_category_id)),
firsts AS (
  SELECT feature_category_id, feature_value_id, any_value(category_literal) AS category_literal, min(item_id) AS first_item
  FROM e1 WHERE category_literal IS NOT NULL GROUP BY 1, 2),
numbered AS (SELECT *, row_number() OVER (PARTITION BY category_literal ORDER BY first_item, feature_value_id) AS n FROM firsts),
assigned AS (
  SELECT n.feature_category_id, n.feature_value_id,
    CASE WHEN len(v.literals) > 0 THEN v.literals[((n.n - 1) % len(v.literals)) + 1] END AS feature_literal
  FROM numbered n LEFT JOIN vocab v ON v.category = n.category_literal)"""


@query("feat_cyclic_literal", with_roles("""
SELECT e.item_id, e.feature_category_id, e.feature_value_id, e.category_literal, a.feature_literal, e.item_id AS bis
FROM e1 e LEFT JOIN assigned a USING (feature_category_id, feature_value_id)""", VOCAB_CTES + "," + CYCLIC))
def feat_cyclic_literal(ctx):
    """E2 + E4: cyclic literal assignment per category (row order = item,
    category, value), item id duplicated as ``bis``."""
    return EN.feat_cyclic_literal(ctx.r.item_features(), vocab(ctx))


SUB = """
subgroups AS (SELECT * FROM (VALUES ('footwear', 'anvil'), ('footwear', 'rod'), ('accessory', 'ring'), ('accessory', 'gizmo')) t(subgroup, product)),
prod_of AS (SELECT f.item_id, s.subgroup FROM feature_values f JOIN subgroups s ON s.product = f.feature_value_literal WHERE f.feature_category_id = 68),
sub_vocab AS (
  SELECT p.subgroup, f.feature_category_literal AS category, list_sort(list(DISTINCT f.feature_value_literal)) AS literals
  FROM feature_values f JOIN prod_of p USING (item_id)
  WHERE f.item_id IN (SELECT item_id FROM train_purchases) AND f.feature_category_literal IN ('colour', 'type') GROUP BY 1, 2),
s1 AS (
  SELECT e.*, CASE WHEN sv.literals IS NOT NULL THEN p.subgroup ELSE 'general' END AS list_key
  FROM e1 e LEFT JOIN prod_of p USING (item_id)
  LEFT JOIN sub_vocab sv ON sv.subgroup = p.subgroup AND sv.category = e.category_literal),
s_first AS (
  SELECT feature_category_id, feature_value_id, arg_min(list_key, item_id) AS list_key,
    any_value(category_literal) AS category_literal, min(item_id) AS first_item
  FROM s1 WHERE category_literal IS NOT NULL GROUP BY 1, 2),
s_num AS (SELECT *, row_number() OVER (PARTITION BY list_key, category_literal ORDER BY first_item, feature_value_id) AS n FROM s_first),
s_lists AS (SELECT 'general' AS list_key, category, literals FROM vocab UNION ALL SELECT subgroup, category, literals FROM sub_vocab),
s_assigned AS (
  SELECT n.feature_category_id, n.feature_value_id,
    CASE WHEN len(l.literals) > 0 THEN l.literals[((n.n - 1) % len(l.literals)) + 1] END AS feature_literal
  FROM s_num n LEFT JOIN s_lists l ON l.list_key = n.list_key AND l.category = n.category_literal)"""


@query("feat_subgroup_literal", with_roles("""
SELECT e.item_id, e.feature_category_id, e.feature_value_id, e.category_literal, a.feature_literal, e.item_id AS bis
FROM e1 e LEFT JOIN s_assigned a USING (feature_category_id, feature_value_id)""", VOCAB_CTES + "," + CYCLIC + "," + SUB))
def feat_subgroup_literal(ctx):
    """Cyclic assignment with footwear / accessory lists (keyed by the
    item's product literal) and their own counters."""
    return EN.feat_cyclic_literal(ctx.r.item_features(), vocab(ctx), sub_vocab(ctx), product_of(ctx))


@query("feat_unassigned_ids", with_roles("""
SELECT i.feature_category_id, coalesce(l.literals, []::VARCHAR[]) AS literals, l.literals IS NOT NULL AS assigned
FROM (SELECT DISTINCT feature_category_id FROM item_features) i LEFT JOIN (
  SELECT feature_category_id, list_sort(list(DISTINCT feature_category_literal)) AS literals FROM item_features
  WHERE feature_category_literal IS NOT NULL GROUP BY 1) l USING (feature_category_id)"""))
def feat_unassigned_ids(ctx):
    """E5: literals per category id; ids without any."""
    return EN.feat_unassigned_ids(ctx.r.item_features())


@query("feat_vocab_setops", with_roles("""
SELECT category, literal, 'assigned' AS status FROM (SELECT category, literal FROM vocab_x INTERSECT SELECT category, literal FROM used)
UNION ALL SELECT category, literal, 'unassigned' FROM (SELECT category, literal FROM vocab_x EXCEPT SELECT category, literal FROM used)""",
    VOCAB_CTES))
def feat_vocab_setops(ctx):
    """Vocabulary literals in use / unused."""
    return EN.feat_vocab_setops(vocab(ctx), ctx.r.item_features())


@query("feat_empty_values", with_roles("""
SELECT feature_category_id, CAST(count(DISTINCT feature_value_id) AS BIGINT) AS n_values,
  list_sort(list(DISTINCT feature_value_id)) AS value_ids
FROM item_features WHERE feature_value_literal IS NULL GROUP BY 1"""))
def feat_empty_values(ctx):
    """Value ids without a literal per category."""
    return EN.feat_empty_values(ctx.r.item_features())


@query("feat_combo_counts", with_roles("""
SELECT assigned, count(*) AS n_combos FROM (
  SELECT DISTINCT f.feature_category_id, f.feature_value_id, coalesce(a.assigned, FALSE) AS assigned FROM item_features f
  LEFT JOIN (SELECT DISTINCT feature_category_id, TRUE AS assigned FROM item_features WHERE feature_category_literal IS NOT NULL) a
  USING (feature_category_id)) GROUP BY ROLLUP (assigned)"""))
def feat_combo_counts(ctx):
    """(category, value) combinations by assigned flag, with total."""
    return EN.feat_combo_counts(ctx.r.item_features())


@query("vocab_combo_count", with_roles("SELECT count(*) AS n_pairs FROM (SELECT DISTINCT category, literal FROM vocab_x)", VOCAB_CTES))
def vocab_combo_count(ctx):
    """Distinct (category, literal) pairs in the vocabulary."""
    return EN.vocab_explode(vocab(ctx)).select("category", "literal").distinct().agg(
        F.count(F.lit(1)).alias("n_pairs"))


@query("vocab_by_size", with_roles("""
SELECT v.category, CAST(len(v.literals) AS BIGINT) AS n_literals, coalesce(u.assigned, FALSE) AS assigned FROM vocab v
LEFT JOIN (SELECT DISTINCT category, TRUE AS assigned FROM used) u USING (category)""", VOCAB_CTES))
def vocab_by_size(ctx):
    """Vocabulary categories by list length, with use flag."""
    return EN.vocab_by_size(vocab(ctx), ctx.r.item_features())


@query("vocab_vs_table", with_roles("""
SELECT (SELECT count(*) FROM used) AS n_table_pairs, (SELECT count(*) FROM (SELECT DISTINCT category, literal FROM vocab_x)) AS n_vocab_pairs""",
    VOCAB_CTES))
def vocab_vs_table(ctx):
    """Distinct assigned pairs in the table vs in the vocabulary."""
    from cartwalk.operators.ids import with_scalar
    a = EN.used_pairs(ctx.r.item_features()).agg(F.count(F.lit(1)).alias("n_table_pairs"))
    b = EN.vocab_explode(vocab(ctx)).select("category", "literal").distinct().agg(
        F.count(F.lit(1)).alias("n_vocab_pairs"))
    return with_scalar(a, b)


@query("feat_assigned_listing", with_roles("""
SELECT DISTINCT feature_category_id, feature_value_id, feature_category_literal, feature_value_literal FROM item_features
WHERE feature_category_literal IS NOT NULL AND feature_value_literal IS NOT NULL"""))
def feat_assigned_listing(ctx):
    """Distinct assigned id/literal quadruples."""
    return ctx.r.item_features().filter(
        F.col("feature_category_literal").isNotNull() & F.col("feature_value_literal").isNotNull()).select(
        "feature_category_id", "feature_value_id", "feature_category_literal", "feature_value_literal").distinct()


CORR = """corrections AS (
  SELECT CAST(feature_category_id AS VARCHAR) AS feature_category_id, CAST(feature_value_id AS VARCHAR) AS feature_value_id,
    'color' AS new_category_literal, upper(feature_value_literal) AS new_value_literal FROM value_ids WHERE feature_category_id = 30
  UNION ALL SELECT 'x30', '1', 'bad', 'bad'),
corr_ok AS (SELECT TRY_CAST(feature_category_id AS INT) AS cid, TRY_CAST(feature_value_id AS BIGINT) AS vid,
  new_category_literal, new_value_literal FROM corrections
  WHERE TRY_CAST(feature_category_id AS INT) IS NOT NULL AND TRY_CAST(feature_value_id AS BIGINT) IS NOT NULL)"""


def corrections(ctx):
    v = ctx.r.value_ids().filter(F.col("feature_category_id") == 30)
    good = v.select(F.col("feature_category_id").cast("string").alias("feature_category_id"),
                    F.col("feature_value_id").cast("string").alias("feature_value_id"),
                    F.lit("color").alias("new_category_literal"),
                    F.upper("feature_value_literal").alias("new_value_literal"))
    bad = ctx.spark.createDataFrame([("x30", "1", "bad", "bad")], good.schema)
    return good.unionByName(bad)


@query("feat_corrections", with_roles("""
SELECT f.item_id, f.feature_category_id, f.feature_value_id,
  coalesce(c.new_category_literal, f.feature_category_literal) AS feature_category_literal,
  coalesce(c.new_value_literal, f.feature_value_literal) AS feature_value_literal
FROM item_features f LEFT JOIN corr_ok c ON c.cid = f.feature_category_id AND c.vid = f.feature_value_id""", CORR))
def feat_corrections(ctx):
    """Literal corrections from a table (one row per correction call)."""
    return EN.feat_corrections(ctx.r.item_features(), corrections(ctx))


@query("feat_complete_split", with_roles("""
SELECT CASE WHEN feature_category_literal IS NOT NULL AND feature_value_literal IS NOT NULL THEN 'complete' ELSE 'missing' END AS part,
  item_id, feature_category_id, feature_value_id, feature_category_literal, feature_value_literal FROM item_features"""))
def feat_complete_split(ctx):
    """Complete rows and rows lacking a literal, told apart by ``part``."""
    f = ctx.r.item_features()
    ok = F.col("feature_category_literal").isNotNull() & F.col("feature_value_literal").isNotNull()
    return f.select(F.when(ok, "complete").otherwise("missing").alias("part"), "item_id", "feature_category_id",
                    "feature_value_id", "feature_category_literal", "feature_value_literal")


@query("feat_export", with_roles("""
SELECT item_id, feature_category_id, feature_value_id, feature_category_literal, feature_value_literal FROM item_features
WHERE feature_category_literal IS NOT NULL AND feature_value_literal IS NOT NULL"""))
def feat_export(ctx):
    """E31 / IO11: the complete rows written as CSV with a header and read
    back with the declared schema."""
    f = ctx.r.item_features().dropna(subset=["feature_category_literal", "feature_value_literal"])
    path = IO.write_csv(f.select("item_id", "feature_category_id", "feature_value_id", "feature_category_literal",
                                 "feature_value_literal"), IO.new_dir(ctx.spark, "features-csv"))
    return IO.read_csv(ctx.spark, path, IO.ENRICHED_FEATURES)


def labelled(ctx):
    """Rows the classifiers of E18-E20, E29 and E30 learn from: the features of
    the items the vocabulary was observed on, with their category's literal.  They hold
    categories that have no literal anywhere in the table, which is what is left to assign."""
    bought = ctx.r.train_purchases().select("item_id").distinct()
    names = ctx.r.feature_values().select("feature_category_id", "feature_category_literal").distinct()
    return (ctx.r.item_features().join(bought, "item_id", "left_semi").drop("feature_category_literal")
            .join(F.broadcast(names), "feature_category_id"))  # one row per category


@query("feat_validate_vocab", with_roles("""
SELECT f.item_id, f.feature_category_id, f.feature_value_id, f.feature_category_literal,
  CASE WHEN f.feature_value_literal IS NULL THEN NULL WHEN v.literal IS NULL THEN 'Desconocido' ELSE f.feature_value_literal END AS feature_value_literal
FROM item_features f LEFT JOIN vocab_x v ON v.category = f.feature_category_literal AND v.literal = f.feature_value_literal""",
    VOCAB_CTES))
def feat_validate_vocab(ctx):
    """Literals outside their category's vocabulary become unknown."""
    return EN.feat_validate_vocab(ctx.r.item_features(), vocab(ctx))


@query("assign_one_to_one", with_roles("""
SELECT m.category, m.item_id, f.literal FROM
  (SELECT category, item_id, row_number() OVER (PARTITION BY category ORDER BY item_id) AS n FROM (
     SELECT DISTINCT c.category_literal AS category, i.item_id FROM item_features i JOIN catmap c USING (feature_category_id)
     WHERE i.feature_value_literal IS NULL)) m
LEFT JOIN (SELECT category, literal, row_number() OVER (PARTITION BY category ORDER BY literal) AS n FROM (
     SELECT category, literal FROM vocab_x EXCEPT SELECT category, literal FROM used)) f USING (category, n)""", VOCAB_CTES))
def assign_one_to_one(ctx):
    """One unused vocabulary literal per missing (category, item)."""
    f = ctx.r.item_features()
    m = EN.feat_category_literal(f.filter(F.col("feature_value_literal").isNull())).filter(
        F.col("category_literal").isNotNull()).select(F.col("category_literal").alias("category"), "item_id").distinct()
    v = EN.vocab_explode(vocab(ctx)).select("category", "literal")
    free = v.exceptAll(EN.used_pairs(f)).distinct()
    return EN.assign_one_to_one(m, free)


@query("vocab_card_match", with_roles("""
SELECT v.category, CAST(len(v.literals) AS BIGINT) AS n_literals, list_sort(list(c.feature_category_id)) AS category_ids
FROM vocab v JOIN (SELECT feature_category_id, count(DISTINCT feature_value_id) AS n FROM item_features GROUP BY 1) c
  ON c.n = len(v.literals) GROUP BY v.category, v.literals""", VOCAB_CTES))
def vocab_card_match(ctx):
    """Vocabulary categories whose size equals a category's value count."""
    return EN.vocab_card_match(vocab(ctx), ctx.r.item_features())


@query("vocab_missing", with_roles("""
SELECT DISTINCT v.category FROM vocab v JOIN (SELECT feature_category_id, count(DISTINCT feature_value_id) AS n FROM item_features GROUP BY 1) c
  ON c.n = len(v.literals)
WHERE v.category NOT IN (SELECT category FROM used)""", VOCAB_CTES))
def vocab_missing(ctx):
    """Matched vocabulary categories missing from the table."""
    return EN.vocab_missing(vocab(ctx), ctx.r.item_features())


@query("feat_label_encode", with_roles("""
SELECT f.item_id, f.feature_category_id, f.feature_category_literal AS label, l.label_idx FROM item_features f
LEFT JOIN (SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS BIGINT) AS label_idx FROM (
  SELECT DISTINCT feature_category_literal AS label FROM item_features WHERE feature_category_literal IS NOT NULL)) l
  ON l.label = f.feature_category_literal"""))
def feat_label_encode(ctx):
    """Class index of the category literal, null when unknown."""
    f = ctx.r.item_features()
    return EN.feat_label_encode(f, f)


@query("split_grouped")
def split_grouped(ctx):
    """Grouped 80/20 split by item (hash of item and seed)."""
    return EN.split_grouped(ctx.r.item_features().select("item_id", "feature_category_id"))


@query("impute_rf")
def impute_rf(ctx):
    """Random forest imputation of missing category literals."""
    return IM.impute(ctx.r.item_features(), "rf", numTrees=100)


@query("impute_rf_cv")
def impute_rf_cv(ctx):
    """80/20 split and 5-fold accuracy."""
    return IM.cv_accuracy(ctx.r.item_features())


@query("impute_unique")
def impute_unique(ctx):
    """Per unassigned id, the top prediction unless used elsewhere."""
    return IM.unique_predictions(ctx.r.item_features(), labelled(ctx))


@query("impute_topn")
def impute_topn(ctx):
    """Five most probable literals per missing row."""
    return IM.top_n_candidates(ctx.r.item_features(), 5, labelled(ctx))


@query("impute_greedy")
def impute_greedy(ctx):
    """Best-first walk over candidates by deferred acceptance, no literal twice."""
    f = ctx.r.item_features()
    return IM.greedy_assign(IM.per_id_candidates(f, labelled(ctx)), IM.used_literals(f))


# Candidates of every value id by shared items, five each.
CANDS = """
fv_pairs AS (SELECT DISTINCT item_id, feature_value_id FROM item_features),
fv_lits AS (SELECT DISTINCT item_id, feature_value_literal AS literal FROM item_features WHERE feature_value_literal IS NOT NULL),
cands AS (SELECT * FROM (
  SELECT feature_value_id, literal, prob, row_number() OVER (PARTITION BY feature_value_id ORDER BY prob DESC, literal) AS rank FROM (
    SELECT feature_value_id, literal, CAST(count(*) AS DOUBLE) / min(n) AS prob FROM fv_pairs JOIN fv_lits USING (item_id)
    JOIN (SELECT feature_value_id, count(*) AS n FROM fv_pairs GROUP BY 1) USING (feature_value_id) GROUP BY 1, 2)) WHERE rank <= 5)"""


def _value_candidates(ctx):
    f = ctx.r.item_features()
    return materialize(AS.shared_item_candidates(f, f.select("item_id", F.col("feature_value_literal").alias("literal")), 5))


# All pairs in one line, likeliest first: a pair is made when both are free.
@query("assign_stable", with_roles("""
SELECT id AS feature_value_id, literal, prob, CAST(rank AS BIGINT) AS rank, CAST(0 AS BIGINT) AS n_blocking
FROM line JOIN (SELECT unnest(made) AS k FROM made_of WHERE k = (SELECT max(k) FROM made_of)) USING (k)""", CANDS + """,
line AS (SELECT feature_value_id AS id, literal, prob, rank, row_number() OVER (ORDER BY prob DESC, feature_value_id, literal) AS k FROM cands),
made_of AS (
  SELECT CAST(0 AS BIGINT) AS k, []::BIGINT[] AS made, []::BIGINT[] AS ids, []::VARCHAR[] AS literals
  UNION ALL
  SELECT l.k, CASE WHEN free THEN list_append(m.made, l.k) ELSE m.made END, CASE WHEN free THEN list_append(m.ids, l.id) ELSE m.ids END,
    CASE WHEN free THEN list_append(m.literals, l.literal) ELSE m.literals END
  FROM (SELECT m.*, l.k AS next, NOT list_contains(m.ids, l.id) AND NOT list_contains(m.literals, l.literal) AS free
        FROM made_of m JOIN line l ON l.k = m.k + 1) m JOIN line l ON l.k = m.next)"""))
def assign_stable(ctx):
    """E18 / E20 on given probabilities: one literal for each value id by
    deferred acceptance, literals to whom they are likeliest for; with the number of
    pairs that would rather have each other (a stable result has none)."""
    prefs = AS.preferences(_value_candidates(ctx), "feature_value_id")
    matches, _ = AS.deferred_acceptance(prefs)
    blocking = AS.blocking_pairs(prefs, matches).agg(F.count(F.lit(1)).alias("n_blocking"))
    return with_scalar(matches, blocking).select(
        F.col("seeker").alias("feature_value_id"), "literal", F.col("claim").alias("prob"), "rank", "n_blocking")


def _walk_sql(walk: str, by: str) -> str:
    # the ids one by one, each with the first literal not taken before
    return f"""
{walk}_lists AS (SELECT feature_value_id AS id, list(literal ORDER BY rank {by}) AS ls, row_number() OVER (ORDER BY feature_value_id) AS k
  FROM cands GROUP BY 1),
{walk}_walk AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS pick, []::VARCHAR[] AS taken
  UNION ALL
  SELECT k, id, pick, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END FROM (
    SELECT l.k, l.id, w.taken, list_filter(l.ls, lambda x: NOT list_contains(w.taken, x))[1] AS pick
    FROM {walk}_walk w JOIN {walk}_lists l ON l.k = w.k + 1))"""


@query("assign_in_order", with_roles("""
SELECT 'best' AS walk, id AS feature_value_id, pick AS literal FROM best_walk WHERE pick IS NOT NULL
UNION ALL SELECT 'reference', id, pick FROM reference_walk WHERE pick IS NOT NULL""",
    CANDS + "," + _walk_sql("best", "") + "," + _walk_sql("reference", "DESC")))
def assign_in_order(ctx):
    """E20 on given probabilities, value ids one after the other, each with its
    first candidate not used before: from the likeliest on, and in the
    reference's order (of the five likeliest, the least likely first)."""
    cands, out = _value_candidates(ctx), None
    for walk in ("best", "reference"):
        matches, _ = AS.deferred_acceptance(AS.preferences(cands, "feature_value_id", "listed", walk, 5))
        one = matches.select(F.lit(walk).alias("walk"), F.col("seeker").alias("feature_value_id"), "literal")
        out = one if out is None else out.unionByName(one)
    return out


@query("impute_mlp")
def impute_mlp(ctx):
    """Feed-forward network (one hidden layer of 50) imputation."""
    return IM.impute(ctx.r.item_features(), "mlp", maxIter=50)


@query("impute_grid")
def impute_grid(ctx):
    """Sixteen networks (layers, activation, solver) under shuffled,
    stratified and forward-chaining time folds, five each.  An item's date is
    that of its first train view."""
    dates = ctx.r.train_views().groupBy("item_id").agg(F.min("date").alias("date"))
    return NW.grid_search(ctx.r.item_features(), IM.LABEL, dates, epochs=4)


CLF = """clf AS (
  SELECT l.doc_id, CAST(l.quality AS DOUBLE) AS label, CASE WHEN d.n_chars >= 2000 THEN 1.0 ELSE 0.0 END AS pred,
    CAST(d.n_chars AS DOUBLE) AS score FROM labels l JOIN documents d USING (doc_id)),
cls AS (SELECT c AS cls FROM (VALUES (0.0), (1.0)) t(c)),
f1s AS (
  SELECT cls.cls, sum(CASE WHEN clf.label = cls.cls THEN 1 ELSE 0 END) AS support,
    sum(CASE WHEN clf.label = cls.cls AND clf.pred = cls.cls THEN 1 ELSE 0 END) AS tp,
    sum(CASE WHEN clf.pred = cls.cls THEN 1 ELSE 0 END) AS npred
  FROM cls CROSS JOIN clf GROUP BY cls.cls),
ranks AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM clf)"""


@query("clf_metrics", with_roles(f"""
SELECT {R6('(SELECT avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END) FROM clf)')} AS accuracy,
  {R6('''(SELECT sum(support * CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (support + npred) END) / sum(support) FROM f1s)''')} AS weighted_f1,
  {R6('''(SELECT (sum(CASE WHEN label = 1 THEN r ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0)
          / (sum(label) * (count(*) - sum(label))) FROM ranks)''')} AS roc_auc""", CLF))
def clf_metrics(ctx):
    """Accuracy, weighted F1 and ROC AUC of a document-length quality
    classifier against the labels."""
    d = ctx.t.labels.join(ctx.t.documents.select("doc_id", "n_chars"), "doc_id").select(
        F.col("quality").cast("double").alias("label"),
        F.when(F.col("n_chars") >= 2000, 1.0).otherwise(0.0).alias("prediction"),
        F.col("n_chars").cast("double").alias("score"))
    return EN.binary_report(d).select(*[r6(c).alias(c) for c in ("accuracy", "weighted_f1", "roc_auc")])


def _constrained(ctx, f):
    cands = IM.constrained_candidates(f, vocab(ctx), labelled(ctx))
    return IM.greedy_assign(cands, IM.used_literals(f))


@query("impute_constrained")
def impute_constrained(ctx):
    """Per unassigned category id, the likeliest literal missing from the
    table whose vocabulary length equals the id's value count."""
    return _constrained(ctx, ctx.r.item_features())


@query("impute_failed")
def impute_failed(ctx):
    """Category ids left without an admissible literal."""
    f = ctx.r.item_features()
    ids = f.filter(F.col("feature_category_literal").isNull()).select("feature_category_id").distinct()
    return IM.impute_failed(ids, _constrained(ctx, f))
