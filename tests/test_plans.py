import pytest
from check import canonical, connect
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from pairmatch.operators import features
from pairmatch.plans import views as V
from pairmatch.session import work_dir
from pairmatch.sources import tables as S

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = queries()[name](spark, SMALL).toPandas()
    want = duck.execute(oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry(spark):
    assert entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_native_operators_have_no_python(spark):
    for name in ("clean_flow", "ngrams", "stem_tokens", "token_cross", "precision_recall_f1"):
        assert "Python" not in plan(queries()[name](spark, SMALL)), name


def test_store_scan_prunes_partitions_and_columns(spark):
    path = work_dir(spark, "store")
    S.append_features(V.basic_features(spark, SMALL), path)
    read = S.read_features(spark, path, "TR").where("tr_q1Len > 10").select("id")
    text = plan(read)
    assert "PartitionFilters: [isnotnull(type" in text
    assert "PushedFilters: [IsNotNull(tr_q1Len), GreaterThan(tr_q1Len,10)]" in text
    assert "q1nopunct" not in text


def test_generators_do_not_compute_their_array_twice(spark):
    tokens = V.doc_tokens(spark, SMALL)
    from pairmatch.operators.tfidf import vocabulary

    assert plan(vocabulary(tokens)).count("what's") == 1


def test_one_pass_scaling(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("x"), "id")
    assert plan(features.zscore(df, ["x"])).count("stddev_pop") >= 1
    assert "CartesianProduct" not in plan(features.zscore(df, ["x"]))


def test_words_of_pairs_are_taken_once_per_batch(spark):
    """No set is built per pair; a pair with a null side has no words."""
    data = [(1, ["a", "b", "b"], ["c"]), (2, None, ["x"]), (3, ["y"], None), (4, [], ["a", "d"])]
    tokens = spark.createDataFrame(data, "id long, tokens1 array<string>, tokens2 array<string>")
    found = V.vectors_for(spark, SMALL, tokens)
    words = spark.createDataFrame([(w,) for w in "abcd"], "word string")
    want = V.word_vectors(words, V.load(spark, SMALL, "embeddings"))
    assert found.count() == want.count() > 0 and found.exceptAll(want).count() == 0
    assert "array_union" not in plan(found)


def test_cells_are_exploded_before_words_are_looked_up(spark):
    from pairmatch.operators import grid

    tokens = spark.createDataFrame([(1, ["a"], ["b"])], "id long, tokens1 array<string>, tokens2 array<string>")
    assert "lambdafunction" not in plan(grid.grid_cells(tokens))
