"""Registered queries: sources and sinks (IO1-IO10)."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.sql import functions as F

from cartwalk.functions.exprs import r6
from cartwalk.operators import text as TX
from cartwalk.plans import recommend as P
from cartwalk.plans.queries_rec import REC, TRAIN, W20
from cartwalk.plans.registry import query
from cartwalk.plans.sqlroles import R6, with_roles
from cartwalk.sources import io as IO


@query("io_interactions", with_roles("SELECT session_id, item_id, date FROM train_views"))
def io_interactions(ctx):
    """IO1: train views written as CSV and read back with a declared schema."""
    path = IO.write_csv(ctx.r.train_views(), IO.new_dir(ctx.spark, "views-csv"))
    return IO.read_csv(ctx.spark, path, IO.INTERACTIONS)


@query("io_item_features", with_roles("SELECT item_id, feature_category_id, feature_value_id FROM item_features"))
def io_item_features(ctx):
    """IO2: the long item-feature table through CSV with a declared schema."""
    f = ctx.r.item_features().select("item_id", "feature_category_id", "feature_value_id")
    path = IO.write_csv(f, IO.new_dir(ctx.spark, "features-csv"))
    return IO.read_csv(ctx.spark, path, IO.ITEM_FEATURES)


@query("io_candidates", with_roles("SELECT item_id FROM candidate_items"))
def io_candidates(ctx):
    """IO3: candidate items through CSV."""
    path = IO.write_csv(ctx.r.candidate_items(), IO.new_dir(ctx.spark, "candidates-csv"))
    return IO.read_csv(ctx.spark, path, IO.CANDIDATES)


@query("model_roundtrip", with_roles(f"SELECT item_i, item_j, {R6('sim')} AS sim FROM m_w", TRAIN + "," + W20))
def model_roundtrip(ctx):
    """IO6 + IO7: fit W, save it with side tables and weights, load it back."""
    path = IO.new_dir(ctx.spark, "model")
    IO.save_model(ctx.spark, path, P.fit_w(ctx), ctx.r.candidate_items(), ctx.r.item_features(),
                  P.VIEW_WEIGHT, P.PURCHASE_WEIGHT)
    m = IO.load_model(ctx.spark, path)
    return m["W"].select("item_i", "item_j", r6("sim").alias("sim"))


@query("bundle_roundtrip", with_roles("""
SELECT 'features' AS member, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_diff FROM item_features
UNION ALL SELECT 'purchases', count(*), CAST(0 AS BIGINT) FROM purchases"""))
def bundle_roundtrip(ctx):
    """IO8 + IO9: a bundle with tables, scalars, a list, a nested bundle and a
    hidden member; the reloaded tables are compared with the saved ones row by row."""
    path = IO.new_dir(ctx.spark, "bundle")
    tables = {"purchases": ctx.r.purchases(), "features": ctx.r.item_features()}
    IO.save_bundle(ctx.spark, path, {
        "purchases": tables["purchases"], "alpha": 1.0, "cutoffs": [5, 10],
        "nested": {"features": tables["features"], "note": "side tables"}, ".hidden": "skipped on load"})
    b = IO.load_bundle(ctx.spark, path)
    if (b["alpha"], b["cutoffs"], b["nested"]["note"]) != (1.0, [5, 10], "side tables") or ".hidden" in b:
        raise ValueError("the bundle's values changed on the way")
    out = None
    for name, back in (("purchases", b["purchases"]), ("features", b["nested"]["features"])):
        cols = tables[name].columns
        both = tables[name].withColumn("_d", F.lit(1)).unionByName(back.withColumn("_d", F.lit(-1)))
        same = both.groupBy(*cols).agg(F.sum("_d").alias("_d"), F.sum(F.when(F.col("_d") > 0, 1).otherwise(0)).alias("_n"))
        one = same.agg(F.sum("_n").cast("long").alias("n_rows"), F.sum(F.abs("_d")).cast("long").alias("n_diff")).select(
            F.lit(name).alias("member"), "n_rows", "n_diff")
        out = one if out is None else out.unionByName(one)
    return out


@query("results_roundtrip", with_roles("SELECT session_id, item_id, rank FROM t_top", REC))
def results_roundtrip(ctx):
    """IO5: the ranked list of the test sessions exported as CSV and read back."""
    path = IO.new_dir(ctx.spark, "results")
    IO.save_results(P.recommend(ctx, P.test_profile(ctx), P.fit_w(ctx, store=False), 10), path, "csv")
    return IO.read_csv(ctx.spark, path, IO.RESULTS)


@query("encoder_roundtrip")
def encoder_roundtrip(ctx):
    """IO10: item text, fitted vectorizer and term counts saved together and
    reloaded; the reloaded vectorizer re-encodes the documents."""
    path = IO.new_dir(ctx.spark, "encoder")
    arrays = TX.token_arrays(ctx.t.documents, "doc_id", TX.spanish_stop_words(ctx.spark))
    cv = CountVectorizer(inputCol="tokens", outputCol="vec", vocabSize=TX.VOCAB_SIZE).fit(arrays)
    cv.write().save(f"{path}/vectorizer")
    from cartwalk.plans.queries_text import doc_vecs
    IO.save_bundle(ctx.spark, f"{path}/tables", {
        "item_text": TX.item_descrip(ctx.r.item_features()), "item_terms": doc_vecs(ctx)})
    cv2 = CountVectorizerModel.load(f"{path}/vectorizer")
    enc = cv2.transform(arrays).select("doc_id", "vec")
    from pyspark.ml.functions import vector_to_array
    return enc.select("doc_id", F.aggregate(vector_to_array("vec"), F.lit(0.0), lambda a, x: a + x)
                      .cast("long").alias("n_vocab_tokens"))
