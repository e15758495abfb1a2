"""Item-feature enrichment: literals for anonymous ids, vocabulary checks,
corrections, validation and one-to-one assignment.

Row order matters to the cyclic assignment; it is carried explicitly as
(item_id, feature_category_id, feature_value_id), never taken from physical
row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartwalk.operators.ids import dense_index_within, join_small, with_scalar
from cartwalk.session import materialize

# Category id -> category literal of the test catalogue
# (category 50 deliberately has none), and the validation fallback literal.
CATEGORY_LITERALS = {55: "brand", 72: "type", 30: "colour", 68: "product"}
UNKNOWN_LITERAL = "Desconocido"
# Product literals that select the alternative literal lists
# (the footwear / accessory subgroups of the reference, re-keyed to the test
# catalogue's products).
SUBGROUPS = {"footwear": ["anvil", "rod"], "accessory": ["ring", "gizmo"]}


def category_map(spark) -> DataFrame:
    return spark.createDataFrame(sorted(CATEGORY_LITERALS.items()), "feature_category_id INT, category_literal STRING")


def feat_category_literal(features: DataFrame) -> DataFrame:
    """Category id to literal (broadcast join to a fixed 4-row map),
    null when unmapped."""
    m = F.broadcast(category_map(features.sparkSession))
    return features.select("item_id", "feature_category_id", "feature_value_id").join(
        m, "feature_category_id", "left")


def vocabulary_from(rows: DataFrame) -> DataFrame:
    """A vocabulary (category, literals sorted) from (category literal, value
    literal) rows - the ordered lists the cyclic assignment walks."""
    return (rows.filter(F.col("feature_category_literal").isNotNull() & F.col("feature_value_literal").isNotNull())
            .groupBy(F.col("feature_category_literal").alias("category"))
            .agg(F.array_sort(F.collect_set("feature_value_literal")).alias("literals")))


def vocab_explode(vocab: DataFrame) -> DataFrame:
    """IO4 (after parsing): (category, pos, literal), pos from 1."""
    return vocab.select("category", F.posexplode("literals").alias("pos", "literal")).withColumn(
        "pos", (F.col("pos") + 1).cast("long"))


def vocab_to_json(vocab: DataFrame) -> DataFrame:
    """The vocabulary as one JSON document ``{category: [literal, ...]}``."""
    return vocab.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "literals")))))
                     .alias("json"))


def vocab_from_json(js: DataFrame, col: str = "json") -> DataFrame:
    """IO4: parse ``{category: [literal]}`` and explode to (category, literals)."""
    m = F.from_json(F.col(col), "map<string, array<string>>")
    return js.select(F.explode(m).alias("category", "literals"))


def feat_cyclic_literal(features: DataFrame, vocab: DataFrame, sub_vocab: DataFrame | None = None,
                        product_of: DataFrame | None = None) -> DataFrame:
    """E2 (+E3, E4): each new (category, value) in row order takes the next
    literal of its category's list, cycling; repeats reuse it.

    Closed form of the reference's counters: the k-th distinct key of a
    category (by first appearance) gets ``list[(k-1) mod size]``.  With
    ``sub_vocab`` (subgroup, category, literals) and ``product_of``
    (item_id, subgroup), keys of items in a subgroup that has its own list
    for the category use that list and their own counter (E3)."""
    base = feat_category_literal(features)
    key_cols = ["feature_category_id", "feature_value_id"]
    pos = F.struct("item_id", "feature_category_id", "feature_value_id")
    rows = base
    if sub_vocab is not None and product_of is not None:
        rows = rows.join(product_of.select("item_id", "subgroup"), "item_id", "left").join(
            sub_vocab.select("subgroup", F.col("category").alias("category_literal"),
                             F.col("literals").alias("_sub")), ["subgroup", "category_literal"], "left") \
            .withColumn("list_key", F.when(F.col("_sub").isNotNull(), F.col("subgroup")).otherwise(F.lit("general"))) \
            .drop("_sub")
    else:
        rows = rows.withColumn("list_key", F.lit("general"))
    # first appearance of each key; the first row decides the list it uses
    first = rows.filter(F.col("category_literal").isNotNull()).groupBy(*key_cols).agg(
        F.min_by(F.struct("list_key", "category_literal"), pos).alias("_k"), F.min(pos).alias("_first"))
    first = first.select(*key_cols, "_k.list_key", "_k.category_literal", "_first")
    first = dense_index_within(first.select(*key_cols, "list_key", "category_literal", F.col("_first.item_id").alias("_at_item")),
                               ["list_key", "category_literal"], ["_at_item", *key_cols], "_n").drop("_at_item")
    lists = vocab.select(F.lit("general").alias("list_key"), F.col("category").alias("category_literal"),
                         "literals")
    if sub_vocab is not None:
        lists = lists.unionByName(sub_vocab.select(F.col("subgroup").alias("list_key"),
                                                   F.col("category").alias("category_literal"), "literals"))
    assigned = first.join(lists, ["list_key", "category_literal"], "left").select(
        *key_cols,
        F.when(F.size("literals") > 0,
               F.element_at("literals", (F.pmod(F.col("_n") - 1, F.size("literals")) + 1).cast("int")))
        .alias("feature_literal"))
    return base.join(assigned, key_cols, "left").select(
        "item_id", "feature_category_id", "feature_value_id", "category_literal", "feature_literal",
        F.col("item_id").alias("bis"))


def feat_unassigned_ids(features: DataFrame) -> DataFrame:
    """E5: literals used per category id, and ids with none."""
    lit = features.filter(F.col("feature_category_literal").isNotNull()).groupBy("feature_category_id").agg(
        F.array_sort(F.collect_set("feature_category_literal")).alias("literals"))
    ids = features.select("feature_category_id").distinct()
    return ids.join(lit, "feature_category_id", "left").select(
        "feature_category_id", F.coalesce("literals", F.array().cast("array<string>")).alias("literals"),
        F.col("literals").isNotNull().alias("assigned"))


def used_pairs(features: DataFrame) -> DataFrame:
    return features.filter(F.col("feature_category_literal").isNotNull() & F.col("feature_value_literal").isNotNull()) \
        .select(F.col("feature_category_literal").alias("category"), F.col("feature_value_literal").alias("literal")) \
        .distinct()


def feat_vocab_setops(vocab: DataFrame, features: DataFrame) -> DataFrame:
    """Vocabulary literals in use (intersect) and unused (except)."""
    v = vocab_explode(vocab).select("category", "literal")
    u = used_pairs(features)
    return v.intersect(u).withColumn("status", F.lit("assigned")).unionByName(
        v.exceptAll(u).distinct().withColumn("status", F.lit("unassigned")))


def feat_empty_values(features: DataFrame) -> DataFrame:
    """Per category, the value ids lacking a literal, largest set first."""
    e = features.filter(F.col("feature_value_literal").isNull()).groupBy("feature_category_id").agg(
        F.array_sort(F.collect_set("feature_value_id")).alias("value_ids"))
    return e.select("feature_category_id", F.size("value_ids").cast("long").alias("n_values"), "value_ids")


def feat_combo_counts(features: DataFrame) -> DataFrame:
    """Distinct (category, value) in assigned / unassigned categories and
    the total, via ``rollup``."""
    assigned_ids = features.filter(F.col("feature_category_literal").isNotNull()).select(
        "feature_category_id").distinct().withColumn("assigned", F.lit(True))
    f = features.select("feature_category_id", "feature_value_id").distinct().join(
        assigned_ids, "feature_category_id", "left").fillna(False, ["assigned"])
    return f.rollup("assigned").agg(F.count(F.lit(1)).alias("n_combos"))


def vocab_by_size(vocab: DataFrame, features: DataFrame) -> DataFrame:
    """Vocabulary categories with their list length and whether the
    table uses the category."""
    used = features.filter(F.col("feature_category_literal").isNotNull()).select(
        F.col("feature_category_literal").alias("category")).distinct().withColumn("assigned", F.lit(True))
    return vocab.select("category", F.size("literals").cast("long").alias("n_literals")).join(
        used, "category", "left").fillna(False, ["assigned"])


def feat_corrections(features: DataFrame, corrections: DataFrame) -> DataFrame:
    """Overwrite both literals of listed (category, value) pairs.
    Correction ids arrive as text and are coerced with ``try_cast`` (null if
    bad, so the row matches nothing); a missing column is an error."""
    need = {"feature_category_id", "feature_value_id", "new_category_literal", "new_value_literal"}
    missing = need - set(corrections.columns)
    if missing:
        raise ValueError(f"corrections lack columns: {sorted(missing)}")
    c = corrections.select(
        F.expr("try_cast(feature_category_id AS INT)").alias("feature_category_id"),
        F.expr("try_cast(feature_value_id AS BIGINT)").alias("feature_value_id"),
        "new_category_literal", "new_value_literal").filter(
        F.col("feature_category_id").isNotNull() & F.col("feature_value_id").isNotNull()).dropDuplicates(
        ["feature_category_id", "feature_value_id"])
    return features.join(c, ["feature_category_id", "feature_value_id"], "left").select(
        "item_id", "feature_category_id", "feature_value_id",
        F.coalesce("new_category_literal", "feature_category_literal").alias("feature_category_literal"),
        F.coalesce("new_value_literal", "feature_value_literal").alias("feature_value_literal"))


def feat_validate_vocab(features: DataFrame, vocab: DataFrame) -> DataFrame:
    """A value literal not in its category's list becomes the unknown
    literal (left join to the exploded vocabulary)."""
    v = vocab_explode(vocab).select(F.col("category").alias("feature_category_literal"),
                                    F.col("literal").alias("feature_value_literal")).withColumn("_ok", F.lit(True))
    return features.join(v, ["feature_category_literal", "feature_value_literal"], "left").select(
        "item_id", "feature_category_id", "feature_value_id", "feature_category_literal",
        F.when(F.col("feature_value_literal").isNull(), F.lit(None).cast("string"))
        .when(F.col("_ok").isNull(), F.lit(UNKNOWN_LITERAL))
        .otherwise(F.col("feature_value_literal")).alias("feature_value_literal"))


def assign_one_to_one(missing: DataFrame, free: DataFrame) -> DataFrame:
    """Each missing row (category, item) gets exactly one unused literal
    of its category and no literal twice: the n-th missing row (by item) is
    paired with the n-th free literal (alphabetical) - an equi-join on
    (category, n).  Rows beyond the free literals get null (infeasible)."""
    m = dense_index_within(missing, ["category"], ["item_id"], "n")
    f = dense_index_within(free, ["category"], ["literal"], "n")
    return m.join(f, ["category", "n"], "left").select("category", "item_id", "literal")


def vocab_card_match(vocab: DataFrame, features: DataFrame) -> DataFrame:
    """Vocabulary categories whose list length equals some category
    id's distinct-value count (equi-join on the count)."""
    cnt = features.groupBy("feature_category_id").agg(F.countDistinct("feature_value_id").alias("n"))
    v = vocab.select("category", F.size("literals").alias("n"))
    return v.join(cnt, "n").groupBy("category", "n").agg(
        F.array_sort(F.collect_list("feature_category_id")).alias("category_ids")).select(
        "category", F.col("n").cast("long").alias("n_literals"), "category_ids")


def vocab_missing(vocab: DataFrame, features: DataFrame) -> DataFrame:
    """Matched vocabulary categories the table does not use."""
    used = features.filter(F.col("feature_category_literal").isNotNull()).select(
        F.col("feature_category_literal").alias("category")).distinct()
    return vocab_card_match(vocab, features).select("category").join(used, "category", "left_anti")


def feat_label_encode(features: DataFrame, labels_from: DataFrame) -> DataFrame:
    """Class index of the category literal among the sorted known
    labels (``dense_rank - 1``), null when unknown or missing."""
    labels = labels_from.filter(F.col("feature_category_literal").isNotNull()).select(
        F.col("feature_category_literal").alias("label")).distinct()
    idx = labels.withColumn("label_idx", (F.dense_rank().over(Window.orderBy("label")) - 1).cast("long"))
    return join_small(features.select("item_id", "feature_category_id", F.col("feature_category_literal").alias("label")),
                      materialize(idx), "label", "left")


def split_grouped(df: DataFrame, key: str = "item_id", test_pct: int = 20, seed: int = 42) -> DataFrame:
    """Every row of a group on the same side: hash of (key, seed)."""
    return df.withColumn("is_test", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(100)) < test_pct)


def binary_report(d: DataFrame) -> DataFrame:
    """One row with accuracy, weighted F1 and ROC AUC of (label,
    prediction, score), labels and predictions being 0.0 or 1.0.

    Rows are first counted by (score, label, prediction); the ranks the AUC
    needs then run over the distinct scores only."""
    counts = d.groupBy("score", "label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    by_score = counts.groupBy("score").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("pos"),
                                           F.sum(F.when(F.col("label") == 1, 0).otherwise(F.col("n"))).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    auc = by_score.withColumn("below", below).agg(
        (F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("roc_auc"))

    def total(*conditions):
        hit = F.lit(True)
        for c in conditions:
            hit = hit & c
        return F.sum(F.when(hit, F.col("n")).otherwise(0))
    f1 = []
    for c in (0.0, 1.0):
        label, guess = F.col("label") == c, F.col("prediction") == c
        f1.append(total(label) * F.when(total(label) + total(guess) == 0, 0.0).otherwise(
            2.0 * total(label, guess) / (total(label) + total(guess))))
    report = counts.agg((total(F.col("label") == F.col("prediction")) / F.sum("n")).alias("accuracy"),
                        ((f1[0] + f1[1]) / F.sum("n")).alias("weighted_f1"))
    return with_scalar(report, auc)
