"""Model-based literal imputation with ``spark.ml``.

Rows with a category literal train a classifier over one-hot encoded ids;
rows without one get a prediction.  Forests and networks of another library
are not reproducible here, so results are checked on rows, classes and
accuracy bounds only.  One-to-one rounds (E20, E29) are in ``assignment``.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import FeatureHasher, IndexToString, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartwalk.operators import forest, perceptron
from cartwalk.operators.assignment import deferred_acceptance, preferences
from cartwalk.operators.ids import join_small
from cartwalk.session import drop_stored, materialize

SEED = 42
LABEL = "feature_category_literal"


# Width of the hashed ids: fixed, whatever the number of distinct values.
HASHED = 1024


def _features_stages():
    return [FeatureHasher(inputCols=["feature_category_id", "feature_value_id"], outputCol="features", numFeatures=HASHED)]


def _prep(df: DataFrame) -> DataFrame:
    return df.withColumn("feature_category_id", F.col("feature_category_id").cast("string")) \
             .withColumn("feature_value_id", F.col("feature_value_id").cast("string"))


def split_known(features: DataFrame):
    known = features.filter(F.col(LABEL).isNotNull())
    missing = features.filter(F.col(LABEL).isNull())
    return known, missing


def fit_classifier(known: DataFrame, kind: str = "rf", **params):
    label_idx = StringIndexer(inputCol=LABEL, outputCol="label").fit(known)
    to_str = IndexToString(inputCol="prediction", outputCol="predicted", labels=label_idx.labelsArray[0])
    if kind == "rf":
        clf = RandomForestClassifier(numTrees=params.get("numTrees", 100), maxDepth=params.get("maxDepth", 5),
                                     seed=SEED, labelCol="label", featuresCol="features")
        model = Pipeline(stages=_features_stages() + [label_idx, clf, to_str]).fit(_prep(known))
    else:
        [hasher] = _features_stages()
        alike = known.groupBy("feature_category_id", "feature_value_id", LABEL).agg(F.count(F.lit(1)).alias("n"))
        rows = materialize(label_idx.transform(hasher.transform(_prep(alike))).select("features", "label", "n"))
        net = perceptron.fit(rows, [HASHED, 50, len(label_idx.labelsArray[0])], SEED, params.get("maxIter", 50))
        model = PipelineModel(stages=[hasher, label_idx, net, to_str])
    return model, label_idx.labelsArray[0]


def impute(features: DataFrame, kind: str = "rf", **params) -> DataFrame:
    """Predicted category literal for rows lacking one; known
    literals are kept (``coalesce``).  A row's ids are all that a prediction knows, so
    each pair of ids is predicted once."""
    known, missing = split_known(features)
    model, _ = fit_classifier(known, kind, **params)
    pred = _predict(model, missing.select("feature_category_id", "feature_value_id").distinct())
    out = materialize(pred.select(F.col("feature_category_id").cast("int"), F.col("feature_value_id").cast("long"),
                                  "predicted"))
    return join_small(features, out, ["feature_category_id", "feature_value_id"], "left").select(
        "item_id", "feature_category_id", "feature_value_id",
        F.coalesce(LABEL, "predicted").alias(LABEL), F.col(LABEL).isNull().alias("imputed"))


def _predict(model, df: DataFrame) -> DataFrame:
    """Apply the fitted pipeline skipping the label indexer (rows to predict
    have no label)."""
    x = _prep(df)
    for i, st in enumerate(model.stages):
        if i != 1:  # stage 1 is the label indexer
            x = st.transform(x)
    return x


def cv_accuracy(features: DataFrame, folds: int = 5, trees: int = 100, depth: int = 5) -> DataFrame:
    """80/20 split, 5-fold mean accuracy on the 80 and accuracy on the 20.

    Every row is dealt to the 20 or to a fold by chance; then rows that are alike are one
    with a count, and the forests (``operators/forest``) learn from counts."""
    known, _ = split_known(features)
    fold = F.when(F.rand(SEED) < 0.8, F.floor(F.rand(SEED + 1) * folds).cast("int")).otherwise(forest.HOLDOUT)
    alike = materialize(known.select("feature_category_id", "feature_value_id", LABEL, fold.alias("fold"))
                        .groupBy("feature_category_id", "feature_value_id", LABEL, "fold").agg(F.count(F.lit(1)).alias("n")))
    label_idx = StringIndexer(inputCol=LABEL, outputCol="label").fit(alike)
    [hasher] = _features_stages()
    rows = label_idx.transform(hasher.transform(_prep(alike)))
    *cv, held = forest.cross_validated(rows, folds, trees, depth, len(label_idx.labelsArray[0]), HASHED, SEED)
    drop_stored(alike)
    spark = features.sparkSession
    return spark.createDataFrame([("cv_mean_accuracy", sum(cv) / len(cv)), ("holdout_accuracy", held)],
                                 "metric STRING, value DOUBLE")


def _class_probabilities(features: DataFrame, labelled: DataFrame | None, trees: int) -> DataFrame:
    """Probability of every class for every row lacking a literal.  The
    classifier learns from ``labelled`` rows, by default the known ones."""
    known, missing = split_known(features)
    model, labels = fit_classifier(known if labelled is None else labelled, "rf", numTrees=trees)
    p = _predict(model, missing).select("item_id", F.col("feature_category_id").cast("int"),
                                        F.col("feature_value_id").cast("long"),
                                        F.posexplode(vector_to_array("probability")).alias("cls", "prob"))
    lab = features.sparkSession.createDataFrame(list(enumerate(labels)), "cls INT, literal STRING")
    return p.join(F.broadcast(lab), "cls")  # one row per class


def top_n_candidates(features: DataFrame, n: int = 5, labelled: DataFrame | None = None, trees: int = 100) -> DataFrame:
    """The n most probable literals of every row lacking one."""
    w = Window.partitionBy("item_id", "feature_category_id", "feature_value_id").orderBy(
        F.col("prob").desc(), F.col("cls"))
    return (_class_probabilities(features, labelled, trees).withColumn("rank", F.row_number().over(w).cast("long"))
            .filter(F.col("rank") <= n).drop("cls"))


def per_id_candidates(features: DataFrame, labelled: DataFrame | None = None, trees: int = 100) -> DataFrame:
    """Candidate literals per category id lacking literals: the mean of each
    class's probability over all of the id's missing rows, best first."""
    agg = _class_probabilities(features, labelled, trees).groupBy("feature_category_id", "literal").agg(F.avg("prob").alias("prob"))
    w = Window.partitionBy("feature_category_id").orderBy(F.col("prob").desc(), F.col("literal"))
    return agg.withColumn("rank", F.row_number().over(w).cast("long"))


def unique_predictions(features: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Per category id without literals, the top prediction, rejected
    when the literal is already used by another category id."""
    best = per_id_candidates(features, labelled).filter(F.col("rank") == 1)
    used = features.filter(F.col(LABEL).isNotNull()).select(
        F.col(LABEL).alias("literal"), F.col("feature_category_id").alias("_owner")).distinct()
    rejected = best.join(used, "literal").filter(F.col("_owner") != F.col("feature_category_id")).select(
        "feature_category_id", "literal").distinct()
    return best.join(rejected, ["feature_category_id", "literal"], "left_anti").select(
        "feature_category_id", "literal", "prob")


def used_literals(features: DataFrame) -> DataFrame:
    """Category literals that stand in the table already."""
    return features.filter(F.col(LABEL).isNotNull()).select(F.col(LABEL).alias("literal")).distinct()


def greedy_assign(cands: DataFrame, used: DataFrame, order: str = "probability", walk: str = "best",
                  n: int | None = None) -> DataFrame:
    """Each id takes the first of its candidates not used anywhere,
    by deferred acceptance (``operators/assignment``).  With ``order="listed"`` the
    ids come one after the other as in the reference, with ``walk="reference"`` its ``n``
    likeliest candidates from the least likely on."""
    prefs = preferences(cands, "feature_category_id", order, walk, n)
    matches, _ = deferred_acceptance(prefs, used)
    return matches.select(F.col("seeker").cast("int").alias("feature_category_id"), "literal")


def constrained_candidates(features: DataFrame, vocab: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """E29 candidates: the id's likeliest literals whose vocabulary list
    length equals the id's distinct-value count (length predicate)."""
    cand = per_id_candidates(features, labelled)
    nvals = features.groupBy("feature_category_id").agg(F.countDistinct("feature_value_id").alias("n_values"))
    sizes = vocab.select(F.col("category").alias("literal"), F.size("literals").alias("n_values"))
    return cand.join(nvals, "feature_category_id").join(sizes, ["literal", "n_values"])


def impute_failed(ids: DataFrame, assigned: DataFrame) -> DataFrame:
    """Ids left without an admissible literal."""
    return ids.select("feature_category_id").distinct().join(
        assigned.select("feature_category_id"), "feature_category_id", "left_anti")
