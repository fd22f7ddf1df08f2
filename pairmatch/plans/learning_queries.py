"""Sampling, balancing, models and evaluation."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from pairmatch.functions import text as T
from pairmatch.operators import boosting as B
from pairmatch.operators import evaluate as E
from pairmatch.operators import features, grid, learn, pairs, perceptron, sampling
from pairmatch.operators.word_vectors import fit_word_vectors
from pairmatch.plans import views as V
from pairmatch.plans.blocks import with_blocks
from pairmatch.plans.feature_queries import model_table, plain_inputs
from pairmatch.plans.registry import query
from pairmatch.session import work_dir, written

NUMERIC = [*features.COUNT_COLUMNS, "wrdmatchpct"]
PLAIN_INPUTS = [
    *features.COUNT_COLUMNS, *features.SCORE_COLUMNS, *pairs.WEIGHT_COLUMNS,
    *(f"scaled_{k}" for k in range(len(features.SCALED_FROM))),
]


def _labels(spark, sf):
    return V.load(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("is_duplicate")
    )


_VALID = "('0x' || substr(md5('37458:' || doc_id), 1, 15))::BIGINT % 1000 < 200"


@query("random_split", f"""
    SELECT doc_id AS id, quality AS is_duplicate, CASE WHEN {_VALID} THEN 'valid' ELSE 'train' END AS part
    FROM labels""")
def random_split(spark, sf):
    train, valid = sampling.split(_labels(spark, sf), 0.2)
    return train.withColumn("part", F.lit("train")).unionByName(
        valid.withColumn("part", F.lit("valid"))
    )


_PLAN = """
    SELECT p.*, n0 * power(2, k)::BIGINT + trunc((excess - k) * n0 * power(2, k))::BIGINT AS target FROM (
        SELECT n0, excess, greatest(0, ceil(excess - 1))::BIGINT AS k FROM (
            SELECT count(*) FILTER (quality = 0) AS n0,
                   count(*) FILTER (quality = 1) / count(*)::DOUBLE / 0.165 - 1 AS excess FROM labels)) p"""
_OVERSAMPLED = """
    SELECT id, is_duplicate FROM (
        SELECT doc_id AS id, quality AS is_duplicate,
               target // n0 + (row_number() OVER (ORDER BY doc_id) <= target % n0)::INTEGER AS copies
        FROM labels, plan WHERE quality = 0), LATERAL (SELECT unnest(range(copies))) AS r
    UNION ALL SELECT doc_id, quality FROM labels WHERE quality = 1"""


@query("oversample", with_blocks("""
    SELECT id, is_duplicate, count(*) AS n FROM oversampled GROUP BY ALL""", "plan", "oversampled",
    own={"plan": _PLAN, "oversampled": _OVERSAMPLED}))
def oversample(spark, sf):
    out = sampling.oversample(_labels(spark, sf), cls=0, target=0.165)
    return out.groupBy("id", "is_duplicate").agg(F.count("*").alias("n"))


@query("class_share", with_blocks("""
    SELECT round_even(avg(is_duplicate), 6) AS positive_share FROM oversampled""", "plan", "oversampled",
    own={"plan": _PLAN, "oversampled": _OVERSAMPLED}))
def class_share(spark, sf):
    out = sampling.class_share(sampling.oversample(_labels(spark, sf), cls=0, target=0.165))
    return out.withColumn("positive_share", F.bround("positive_share", 6))


@query("stratified_folds", """
    SELECT doc_id AS id, quality AS is_duplicate,
           ((row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1) % 5)::INTEGER AS fold FROM labels""")
def stratified_folds(spark, sf):
    return sampling.stratified_folds(_labels(spark, sf), 5)


@query("one_hot_label", """
    SELECT doc_id AS id, (quality = 0)::INTEGER::DOUBLE AS is_dup_0,
           (quality = 1)::INTEGER::DOUBLE AS is_dup_1 FROM labels""")
def one_hot_label(spark, sf):
    return sampling.one_hot_label(_labels(spark, sf))


@query("label_stack", "SELECT doc_id AS id, quality AS is_duplicate FROM labels")
def label_stack(spark, sf):
    return pairs.stack_classes(_labels(spark, sf))


# evaluation


@query("accuracy", with_blocks("""
    SELECT round_even(avg(((p >= 0.5)::INTEGER = y)::INTEGER) * 100, 2) AS accuracy_pct FROM scored""",
    "scored"))
def accuracy(spark, sf):
    return E.accuracy(V.scored_labels(spark, sf))


@query("log_loss", with_blocks("""
    SELECT round_even(avg(-CASE WHEN y = 1 THEN ln(q) ELSE ln(1 - q) END), 6) AS log_loss
    FROM (SELECT y, greatest(1e-15, least(1 - 1e-15, p)) AS q FROM scored)""", "scored"))
def log_loss(spark, sf):
    return E.log_loss(V.scored_labels(spark, sf)).withColumn("log_loss", F.bround("log_loss", 6))


@query("confusion_matrix", with_blocks("""
    SELECT label, predicted, count(id) AS n FROM (SELECT unnest([0, 0, 1, 1]) AS label, unnest([0, 1, 0, 1]) AS predicted) f
    LEFT JOIN scored ON y = label AND (p >= 0.5)::INTEGER = predicted GROUP BY ALL""", "scored"))
def confusion_matrix(spark, sf):
    return E.confusion_matrix(V.scored_labels(spark, sf))


@query("precision_recall_f1", with_blocks("""
    SELECT class, round_even(pr, 6) AS precision, round_even(re, 6) AS recall,
           round_even(2 * pr * re / nullif(pr + re, 0), 6) AS f1, support
    FROM (SELECT class, count(*) FILTER (y = class AND c = class) / nullif(count(*) FILTER (c = class), 0)::DOUBLE AS pr,
                 count(*) FILTER (y = class AND c = class) / nullif(count(*) FILTER (y = class), 0)::DOUBLE AS re,
                 count(*) FILTER (y = class) AS support
          FROM (SELECT y, (p >= 0.5)::INTEGER AS c FROM scored), (SELECT unnest([0, 1]) AS class) GROUP BY class)""",
    "scored"))
def precision_recall_f1(spark, sf):
    out = E.precision_recall_f1(V.scored_labels(spark, sf))
    return out.withColumns({c: F.bround(c, 6) for c in ("precision", "recall", "f1")})


@query("batched_accuracy", with_blocks("""
    SELECT (rn - 1) // 250 AS batch, count(*) AS n, round_even(avg(hit), 6) AS accuracy
    FROM (SELECT row_number() OVER (ORDER BY id) AS rn, ((p >= 0.5)::INTEGER = y)::INTEGER AS hit FROM scored)
    GROUP BY 1""", "scored"))
def batched_accuracy(spark, sf):
    out = E.batched_accuracy(V.scored_labels(spark, sf), 250)
    return out.withColumn("accuracy", F.bround("accuracy", 6))


# models: results differ between libraries, so these have no SQL


def _model_rows(spark, sf):
    """Numeric features of the text pairs; written once because fitting reads them often."""
    rows = V.basic_features(spark, sf).select("id", "type", "is_duplicate", *NUMERIC)
    return written(rows, "model-rows")


def _train_rows(spark, sf):
    return _model_rows(spark, sf).where("type = 'TR'").drop("type")


def _table_rows(spark, sf):
    """All 792 inputs of the text pairs as the array ``inputs``, for the boosted trees."""
    rows = features.feature_vector(model_table(spark, sf), "inputs")
    inputs = vector_to_array("inputs").alias("inputs")
    return written(rows.select("id", "type", "is_duplicate", inputs), "table-rows")


@query("train_word_vectors")
def train_word_vectors(spark, sf):
    """Vectors from the latest text of each training question."""
    cleaned = pairs.rename(
        V.cleaned_pairs(spark, sf), {"q1nopunct": "question1", "q2nopunct": "question2"}
    )
    texts = pairs.latest_text(cleaned).select(T.tokenize(F.col("text")).alias("tokens"))
    return fit_word_vectors(written(texts, "sentences"))


def _grids(spark, sf):
    cells = grid.similarity_grid(*V.tokens_and_vectors(spark, sf))
    return written(cells.join(_labels(spark, sf), "id"), "grids")


@query("pca_features")
def pca_features(spark, sf):
    return learn.pca_features(_grids(spark, sf)).drop("grid")


@query("explained_variance")
def explained_variance(spark, sf):
    grids = _grids(spark, sf)
    fit = learn.fit_pca(grids)
    return learn.explained_variance(fit.transform(grids), fit.k, fit)


@query("component_points")
def component_points(spark, sf):
    return learn.component_points(learn.pca_features(_grids(spark, sf)))


@query("linear_discriminant")
def linear_discriminant(spark, sf):
    rows = _train_rows(spark, sf)
    fit = learn.fit_discriminant(rows, NUMERIC)
    return fit.transform(rows).select("id", "is_duplicate", "LD1", "posterior_1", "class")


#: Settings of the tree grid that do not change.
GRID_BASE = B.Settings(rounds=350, step=0.1, depth=8, gamma=1.076)


@query("boosted_trees")
def boosted_trees(spark, sf):
    """Fit with early stopping, score the rows held out."""
    rows = _table_rows(spark, sf).where("type = 'TR'")
    rows = rows.withColumn("valid", sampling.slot(F.col("id")) < 200)
    return B.fit_model(rows, held="valid").score(rows.where("valid"), name="boosted")


@query("grid_search_trees")
def grid_search_trees(spark, sf):
    rows = _table_rows(spark, sf).where("type = 'TR'")
    settings = B.grid(
        GRID_BASE, child_weight=[5.0, 6.0], row_share=[0.7, 0.8, 0.9], column_share=[0.7, 0.8]
    )
    return B.grid_scores(rows, settings, 5, ["child_weight", "row_share", "column_share"])


@query("grid_search_mlp")
def grid_search_mlp(spark, sf):
    """All inputs but the grid, 18 settings of the network over 3 folds."""
    basic = written(V.basic_features(spark, sf), "basic")
    rows = plain_inputs(spark, sf, basic).where("type = 'TR'")
    settings = perceptron.grid(
        perceptron.Settings(), solver=["sgd", "lbfgs", "adam"],
        activation=["relu", "logistic", "tanh"], schedule=["invscaling", "adaptive"],
    )
    return perceptron.grid_scores(rows, PLAIN_INPUTS, settings, 3)


@query("batch_score")
def batch_score(spark, sf):
    """Fit on the labelled pairs, store the model, score every pair without a label."""
    rows = _table_rows(spark, sf)
    train = rows.where("type = 'TR'").withColumn("valid", sampling.slot(F.col("id")) < 200)
    path = work_dir(spark, "model")
    B.fit_model(train, held="valid").save(spark, path)
    return B.BoostedTrees.load(spark, path).score(rows.where("type = 'TS'"), name="boosted")


@query("save_load_model")
def save_load_model(spark, sf):
    """Scores of all pairs by a model and by its stored copy."""
    rows = _table_rows(spark, sf)
    path = work_dir(spark, "model")
    model = B.fit_model(rows.where("type = 'TR'"))
    model.save(spark, path)
    again = B.BoostedTrees.load(spark, path)
    return model.score(rows, name="fitted").unionByName(again.score(rows, name="reloaded"))
