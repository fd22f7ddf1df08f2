"""Numeric features, tf-idf, similarity grid, sentence similarity."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from pairmatch.operators import features, grid, joins, pairs as P, profile as R, taxonomy, tfidf
from pairmatch.plans import views as V
from pairmatch.plans.blocks import with_blocks
from pairmatch.plans.registry import query
from pairmatch.plans.table_queries import word_pairs
from pairmatch.session import written


def _counts(spark, sf):
    """Word and character counts, stored: statistics and rows are two reads."""
    counted = features.count_features(V.cleaned_pairs(spark, sf))
    return written(counted.select("id", *features.COUNT_COLUMNS), "counts")


def _z(c: str) -> str:
    return f'round_even(("{c}" - avg("{c}") OVER ()) / stddev_pop("{c}") OVER (), 5) AS "{c}_zscore"'


@query("zscore", with_blocks(
    f"SELECT id, {', '.join(_z(c) for c in features.COUNT_COLUMNS)} FROM basic", "basic"))
def zscore(spark, sf):
    df = _counts(spark, sf)
    scored = features.zscore(df, features.COUNT_COLUMNS)
    return scored.select("id", *[f"{c}_zscore" for c in features.COUNT_COLUMNS])


def _scaled(i: int, c: str, lo: float, hi: float, fit: str = "true") -> str:
    low, high = (f'{f}("{c}") FILTER ({fit}) OVER ()' for f in ("min", "max"))
    return (
        f'round_even({lo} + ("{c}" - {low}) * {hi - lo} / '
        f"CASE WHEN {high} > {low} THEN {high} - {low} ELSE 1 END::DOUBLE, 6) AS scaled_{i}"
    )


def _scaled_list(lo, hi, columns=features.COUNT_COLUMNS, fit="true"):
    return ", ".join(_scaled(i, c, lo, hi, fit) for i, c in enumerate(columns))


_TRAIN = "b.type = 'TR'"


@query("minmax_scale", with_blocks(
    f"SELECT id, {_scaled_list(-1.0, 1.0)} FROM basic", "basic"))
def minmax_scale(spark, sf):
    df = _counts(spark, sf)
    scaled = features.minmax(df, features.COUNT_COLUMNS, -1.0, 1.0)
    return scaled.select("id", *[F.bround(f"scaled_{i}", 6).alias(f"scaled_{i}") for i in range(4)])


@query("doc_frequency", with_blocks("SELECT term, df FROM df", "df"))
def doc_frequency(spark, sf):
    docs = tfidf.documents(V.cleaned_pairs(spark, sf))
    return tfidf.doc_frequency(tfidf.term_counts(docs))


@query("sort_term_weights", with_blocks("""
    SELECT id, side, term, round_even(weight, 6) AS weight FROM weights ORDER BY id, side, term""",
    "weights"))
def sort_term_weights(spark, sf):
    docs = tfidf.documents(V.cleaned_pairs(spark, sf))
    # dealing by ranges reads the rows twice, so they are computed once first
    weights = written(tfidf.tfidf_weights(docs), "weights").orderBy("id", "side", "term")
    return weights.withColumn("weight", F.bround("weight", 6))


@query("term_sum_mean", with_blocks("""
    SELECT id, side, round_even(sum(weight), 6) AS sum_w, round_even(avg(weight), 6) AS mean_w
    FROM weights GROUP BY id, side""", "weights"))
def term_sum_mean(spark, sf):
    docs = tfidf.documents(V.cleaned_pairs(spark, sf))
    stats = tfidf.term_stats(tfidf.tfidf_weights(docs, named=False))
    return stats.withColumns({c: F.bround(c, 6) for c in ("sum_w", "mean_w")})


_WEIGHTS = ", ".join(f"round_even({c}, 6) AS {c}" for c in P.WEIGHT_COLUMNS)


@query("tfidf_features", with_blocks(f"SELECT id, {_WEIGHTS} FROM tfidf", "tfidf"))
def tfidf_features(spark, sf):
    out = tfidf.tfidf_features(tfidf.documents(V.cleaned_pairs(spark, sf)))
    return out.withColumns({c: F.bround(c, 6) for c in P.WEIGHT_COLUMNS})


@query("word_similarity_grid", with_blocks("SELECT id, k, v FROM grid", "grid"))
def word_similarity_grid(spark, sf):
    out = grid.similarity_grid(*V.tokens_and_vectors(spark, sf))
    cells = out.select("id", F.posexplode("grid").alias("k", "v"))
    return cells.select(
        "id", F.col("k").cast("long").alias("k"), F.bround(F.col("v").cast("double"), 5).alias("v")
    )


def plain_inputs(spark, sf, basic):
    """Counts, overlap, scores, tf-idf sums and scaled columns of the text pairs."""
    weights = tfidf.tfidf_features(tfidf.documents(basic))
    df = joins.join_scores(
        basic.drop("q1nopunct", "q2nopunct", "qid1", "qid2"), V.pair_scores(spark, sf)
    )
    df = P.impute(joins.attach(df, weights), [*P.IMPUTED, "sem_similarity"])
    stage = written(df, "stage")
    # the ranges are those of the training pairs; pairs to be scored may lie outside
    fitted = features.fit_minmax(stage.where("type = 'TR'"), features.SCALED_FROM)
    return features.apply_minmax(stage, fitted, features.SCALED_FROM)


def model_table(spark, sf):
    """Grid and all other inputs of the text pairs."""
    basic = written(V.basic_features(spark, sf), "basic")
    scaled = plain_inputs(spark, sf, basic)
    tokens = grid.numbered(basic.select("id", *V.token_columns()))
    vectors = written(V.vectors_for(spark, sf, tokens), "vectors")
    cells = grid.similarity_grid(tokens, vectors)
    return joins.attach(scaled, cells)


@query("select_features", with_blocks(f"""
    SELECT id, 792::BIGINT AS n, grid_total, wrdmatchpct, sem, word_order,
           scaled_1, scaled_2, scaled_3, scaled_4, scaled_5
    FROM (SELECT b.id, wrdmatchpct, round_even(coalesce(s.sem_similarity, 0), 6) AS sem,
                 round_even(coalesce(s.word_order_similarity, 0), 6) AS word_order,
                 {_scaled_list(0.0, 1.0, fit=_TRAIN)}, {_scaled(4, 'sw1', 0.0, 1.0, _TRAIN)},
                 {_scaled(5, 'sw2', 0.0, 1.0, _TRAIN)}
          FROM (SELECT basic.*, coalesce(weight_q1_sw, 0) AS sw1, coalesce(weight_q2_sw, 0) AS sw2
                FROM basic LEFT JOIN tfidf USING (id)) b
          LEFT JOIN pair_scores s ON s.id = b.id AND s.type = b.type)
    JOIN (SELECT id, round_even(sum(v), 5) AS grid_total FROM grid GROUP BY id) USING (id)""",
    "basic", "tfidf", "pair_scores", "grid"))
def select_features(spark, sf):
    vector = features.feature_vector(model_table(spark, sf))
    v = vector.select("id", vector_to_array("features").alias("v"))
    names = ["wrdmatchpct", "sem", "word_order", *[f"scaled_{i}" for i in range(1, 6)]]
    total = F.aggregate(F.slice("v", 1, 784), F.lit(0.0), lambda a, x: a + F.bround(x, 5))
    return v.select(
        "id", F.size("v").cast("long").alias("n"), F.bround(total, 5).alias("grid_total"),
        *[F.bround(F.get("v", F.lit(784 + i)), 6).alias(n) for i, n in enumerate(names)],
    )


# sentence similarity


def _tables(spark, sf):
    lemma, edge = V.taxonomy(spark, sf)
    return V.sentences(spark, sf), lemma, taxonomy.build_closure(lemma, edge)


def _info(sentences):
    words = sentences.select(F.concat("tokens1", "tokens2").alias("tokens"))
    return written(R.info_content(written(R.word_frequency(words), "frequency")), "info")


@query("word_similarity", with_blocks(
    "SELECT w1, w2, round_even(sim, 6) AS sim FROM word_sim", "word_sim"))
def word_similarity(spark, sf):
    pairs, lemma, edge = word_pairs(spark, sf)
    sim = taxonomy.word_similarity(pairs, lemma, taxonomy.build_closure(lemma, edge))
    return sim.withColumn("sim", F.bround("sim", 6))


@query("semantic_similarity", with_blocks(
    "SELECT id, round_even(sem_similarity, 6) AS sem_similarity FROM sem", "sem"))
def semantic_similarity(spark, sf):
    sentences, lemma, closure = _tables(spark, sf)
    out = taxonomy.semantic_similarity(sentences, lemma, closure, _info(sentences))
    return out.withColumn("sem_similarity", F.bround("sem_similarity", 6))


@query("semantic_similarity_plain", with_blocks(
    "SELECT id, round_even(sem_similarity, 6) AS sem_similarity FROM sem_plain", "sem_plain"))
def semantic_similarity_plain(spark, sf):
    out = taxonomy.semantic_similarity(*_tables(spark, sf))
    return out.withColumn("sem_similarity", F.bround("sem_similarity", 6))


@query("word_order_similarity", with_blocks("""
    SELECT id, round_even(word_order_similarity, 6) AS word_order_similarity FROM word_order""",
    "word_order"))
def word_order_similarity(spark, sf):
    out = taxonomy.word_order_similarity(*_tables(spark, sf))
    return out.withColumn("word_order_similarity", F.bround("word_order_similarity", 6))


@query("blended_similarity", with_blocks("""
    SELECT id, round_even(0.85 * sem_similarity + 0.15 * coalesce(word_order_similarity, 0), 6) AS similarity
    FROM sem JOIN word_order USING (id)""", "sem", "word_order"))
def blended_similarity(spark, sf):
    sentences, lemma, closure = _tables(spark, sf)
    semantic = taxonomy.semantic_similarity(sentences, lemma, closure, _info(sentences))
    order = taxonomy.word_order_similarity(sentences, lemma, closure)
    blend = taxonomy.similarity(semantic, order)
    return blend.select("id", F.bround("similarity", 6).alias("similarity"))
