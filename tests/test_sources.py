from pairmatch.operators.flow import FeatureFlow
from pairmatch.sources import tables as S
from pairmatch.streaming import incremental as I

PAIRS = [
    (1, 1, 2, 'say "hi", twice', " two\nlines ", 1),
    (2, 3, 4, "", "back\\slash", 0),
    (3, 5, 6, "10k steps", None, 0),
]


def test_pair_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame(PAIRS, S.PAIR_SCHEMA)
    S.write_stage(df, str(tmp_path / "csv"), fmt="csv")
    back = S.read_pairs(spark, str(tmp_path / "csv")).orderBy("id").collect()
    # an empty text reads back as missing; fill_text makes it empty again
    assert [r["question1"] for r in back] == ['say "hi", twice', None, "10k steps"]
    assert [r["question2"] for r in back] == [" two\nlines ", "back\\slash", None]


def test_wordlist_with_byte_order_mark_and_cr(spark, tmp_path):
    path = tmp_path / "words.csv"
    path.write_bytes("﻿Column1\r1\r20\r300".encode())
    assert [r["word"] for r in S.read_wordlist(spark, str(path)).collect()] == ["1", "20", "300"]


def test_predictions_are_sorted(spark, tmp_path):
    scored = spark.createDataFrame([(3, 0.5), (1, 0.25), (2, 0.75)], "test_id long, is_duplicate_1 double")
    S.write_predictions(scored.repartition(3), str(tmp_path / "out"))
    lines = [
        line
        for part in sorted((tmp_path / "out").glob("part-*.csv"))
        for line in part.read_text().splitlines()
        if line != "test_id,is_duplicate"
    ]
    assert lines == ["1,0.25", "2,0.75", "3,0.5"]


def flow_pairs(spark):
    rows = [
        (1, 1, 2, "how do i say hi twice", " two\nlines here ", 1, "TR"),
        (2, 3, 4, "", "back slash words", 0, "TR"),
        (3, 5, 6, "10k steps and words", None, 0, "TR"),
        (4, 7, 8, "say two words twice today", "steps here", 1, "TR"),
        (5, 9, 10, "new words " * 50, "never seen terms", None, "TS"),
    ]
    schema = S.T.StructType([*S.PAIR_SCHEMA.fields, S.T.StructField("type", S.T.StringType())])
    vectors = [(w, [float(len(w)), float(k), 1.0]) for k, w in enumerate(["say", "words", "two", "steps", "hi"])]
    return spark.createDataFrame(rows, schema), spark.createDataFrame(vectors, S.VECTOR_SCHEMA)


def by_id(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def test_a_flow_takes_nothing_from_pairs_to_be_scored(spark, tmp_path):
    pairs, vectors = flow_pairs(spark)
    flow = FeatureFlow.fit(pairs, vectors)
    alone = FeatureFlow.fit(pairs.where("type = 'TR'"), vectors)
    want = by_id(alone.transform(pairs))
    assert by_id(flow.transform(pairs)) == want
    flow.save(str(tmp_path / "flow"))
    again = FeatureFlow.load(spark, str(tmp_path / "flow"))
    assert by_id(again.transform(pairs)) == want
    rows = {r["id"]: r for r in flow.transform(pairs).collect()}
    assert max(rows[k]["scaled_0"] for k in (1, 2, 3, 4)) == 1.0 < rows[5]["scaled_0"]
    assert rows[5]["weight_q2_sw"] == 0.0  # no term of the training pairs
    assert {len(r["grid"]) for r in rows.values()} == {784}
    # any part of the pairs gets the same values
    parts = flow.transform(pairs.where("id % 2 = 0")).unionByName(flow.transform(pairs.where("id % 2 = 1")))
    assert by_id(parts) == want


def test_new_files_count_once(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    pairs, vectors = flow_pairs(spark)
    flow, raw = FeatureFlow.fit(pairs, vectors), pairs.drop("type")

    def run():
        return I.incremental_features(spark, source, raw.schema, sink, state, flow)

    raw.where("id < 3").write.parquet(source)
    assert sorted(r["id"] for r in run().collect()) == [1, 2]
    raw.where("id >= 3").write.mode("append").parquet(source)
    after = run()
    assert by_id(after) == by_id(flow.transform(pairs).drop("grid"))
    assert sorted(r["id"] for r in run().collect()) == [1, 2, 3, 4, 5]  # nothing new
    # a batch without its marker counts in no table
    for table in ("features", "grids"):
        rows = spark.read.parquet(f"{sink}/{table}").drop("batch")
        rows.write.parquet(f"{sink}/{table}/batch=other-0")
        assert I.read_sink(spark, sink, table).count() == 5


def store_rows(spark, ids, value=0.0):
    rows = [(k, "TR" if k % 3 else "TS", float(k) + value) for k in ids]
    return spark.createDataFrame(rows, "id long, type string, x double")


def test_a_repeated_append_replaces_its_batch(spark, tmp_path):
    path = str(tmp_path / "store")
    S.append_features(store_rows(spark, range(10)), path, "a")
    S.append_features(store_rows(spark, range(10, 20)), path, "b")
    S.append_features(store_rows(spark, range(8), 100.0), path, "a")
    # rows of an append that failed before its entry was made
    store_rows(spark, range(50, 60)).write.partitionBy("type").parquet(f"{path}/data/entry=0-lost")
    got = {r["id"]: r["x"] for r in S.read_features(spark, path).collect()}
    assert got == {**{k: k + 100.0 for k in range(8)}, **{k: float(k) for k in range(10, 20)}}
    assert S.read_features(spark, path, "TS").count() == 6


def test_ranges_of_a_store_read_few_files(spark, tmp_path):
    path = str(tmp_path / "store")
    for k in range(4):
        S.append_features(store_rows(spark, range(100 * k, 100 * k + 100)), path, str(k))
    order = [
        r for k in range(4) for r in sorted(
            range(100 * k, 100 * k + 100), key=lambda i: ("TR" if i % 3 else "TS", i)
        )
    ]
    for start, stop in ((0, 1), (37, 181), (99, 101), (350, 9999), (400, 500), (10, 10)):
        rows = S.read_feature_range(spark, path, start, stop)
        assert sorted(r["id"] for r in rows.collect()) == sorted(order[start:stop])
        assert set(rows.columns) == {"id", "type", "x"}
    files = len(S.read_features(spark, path).inputFiles())
    assert len(S.read_feature_range(spark, path, 0, 5).inputFiles()) * 4 <= files


def scanned_rows(df):
    """Rows that the scan gave on, from the plan's metrics."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def test_ids_of_a_store_skip_row_groups(spark, tmp_path):
    path = str(tmp_path / "store")
    spark.conf.set("parquet.block.size", "20000")
    spark.conf.set("parquet.page.size", "2000")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        S.append_features(store_rows(spark, range(0, 40000, 2)), path)
        store = S.read_features(spark, path)
        assert scanned_rows(store.where("id between 5000 and 5200")) < 5000
        missing = store.where("id = 10001")  # inside the range of a row group, but in no filter
        assert missing.count() == 0
        assert "PushedFilters: [IsNotNull(id), EqualTo(id,10001)]" in missing._jdf.queryExecution().toString()
    finally:
        for key in ("parquet.block.size", "parquet.page.size"):
            spark.conf.unset(key)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_chunks_have_exactly_their_rows(spark, tmp_path):
    path = str(tmp_path / "rows")
    df = spark.range(1003).repartition(5)
    df.write.parquet(path)
    spark.range(2000, 2010).coalesce(1).write.mode("append").parquet(path)
    for size in (1, 100, 1013, 5000):
        got = S.read_chunked(spark, path, size)
        n = {r["chunk"]: r["count"] for r in got.groupBy("chunk").count().collect()}
        assert sorted(n) == list(range(-(-1013 // size)))
        assert all(n[k] == size for k in sorted(n)[:-1]) and sum(n.values()) == 1013
        assert got.columns == ["id", "chunk"]
    empty = str(tmp_path / "empty")
    df.limit(0).write.parquet(empty)
    assert S.read_chunked(spark, empty).count() == 0
