import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairmatch.operators import (
    evaluate, features, grid, joins, learn, pairs, profile, rows, sampling, taxonomy, term_tiles,
    tfidf,
)
from pairmatch.operators.groups import apply_by_key, apply_groups, combine_by_key


def test_row_numbers_follow_the_key_whatever_its_distribution(spark):
    keys = [*range(500), *[10**9 + i * i for i in range(300)]]
    df = spark.createDataFrame([(k, k % 2) for k in reversed(keys)], "id long, y int")
    got = {r["id"]: r["rn"] for r in rows.global_row_number(df, "id", buckets=16).collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(keys))}
    by = rows.global_row_number(df, "id", by="y", buckets=16).where("y = 1").collect()
    odd = sorted(k for k in keys if k % 2)
    assert {r["id"]: r["rn"] for r in by} == {k: i + 1 for i, k in enumerate(odd)}


def test_row_numbers_of_null_keys_and_of_nothing(spark):
    data = [(k, k % 2 if k % 7 else None) for k in range(200)] + [(None, 1)] * 5
    df = spark.createDataFrame(data, "id long, y int")
    got = rows.global_row_number(df, "id", buckets=8).collect()
    assert sorted(r["rn"] for r in got) == list(range(1, 206))
    assert {r["rn"] for r in got if r["id"] is None} == set(range(201, 206))
    by = rows.global_row_number(df, "id", by="y", buckets=8).collect()
    assert len(by) == 205
    for y in (0, 1, None):
        own = sorted(r["rn"] for r in by if r["y"] == y)
        assert own == list(range(1, len(own) + 1))
    none = df.limit(0)
    assert rows.global_row_number(none, "id", by="y").count() == 0
    assert sampling.stratified_folds(none, 5, label="y").count() == 0
    assert sampling.oversample(none, 0, 0.165, label="y").count() == 0
    assert sampling.stratified_folds(df, 5, label="y").count() == 205


def test_splits_whatever_the_pattern_of_the_keys(spark):
    for keys in (range(0, 500_000, 250), [k * 0x5DEECE66D1234567 % (1 << 63) for k in range(2000)]):
        df = spark.createDataFrame([(k,) for k in keys], "id long")
        train, valid = sampling.split(df, 0.2)
        assert 300 < valid.count() < 500 and train.count() + valid.count() == 2000
        picked = sampling.sample_n(df, 100).collect()
        assert len(picked) == 100 and max(r["id"] for r in picked) > sorted(keys)[1500]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_a_plain_join(spark, how):
    left = spark.createDataFrame(
        [(i, "hot" if i % 3 else f"w{i % 7}") for i in range(300)] + [(999, None)],
        "id long, word string",
    )
    right = spark.createDataFrame([("hot", 1), ("w0", 2), ("w3", 3), ("x", 4)], "word string, v int")
    counts = left.groupBy("word").agg(F.count("*").alias("n"))
    hot = joins.hot_keys(counts, ["word"])
    assert [r[0] for r in hot.collect()] == ["hot"]
    got = joins.salted_join(left, right, ["word"], hot, F.col("id"), how)
    plain = left.join(right, "word", how)
    assert sorted(got.collect(), key=repr) == sorted(plain.collect(), key=repr)


def test_histogram_equals_numpy(spark):
    values = [0.0, 0.1, 0.1, 0.35, 0.9, 1.0, float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = profile.histogram(df, "v", 4).orderBy("bin").collect()
    n, edges = np.histogram(values[:6], 4)
    density, _ = np.histogram(values[:6], 4, density=True)
    assert [r["n"] for r in got] == n.tolist()
    assert np.allclose([r["bin_lo"] for r in got], edges[:-1])
    assert np.allclose([r["density"] for r in got], density)
    part = profile.histogram(df, "v", 2, lo=0.1, hi=0.9).orderBy("bin").collect()
    assert [r["n"] for r in part] == np.histogram(values[:6], 2, (0.1, 0.9))[0].tolist()


def test_box_summary(spark):
    values = [0.0, 0.1, 0.2, 0.3, 0.4, 5.0]
    df = spark.createDataFrame([(1, v) for v in values], "y int, v double")
    box = profile.box_summary(df, "v", "y").first()
    q = np.percentile(values, [25, 50, 75])
    assert np.allclose([box["q1"], box["median"], box["q3"]], q)
    assert (box["whisker_lo"], box["whisker_hi"]) == (0.0, 0.4)


def test_constant_columns(spark):
    df = spark.createDataFrame([(1, 3.0, 7), (2, 5.0, 7)], "id long, a double, b int")
    scaled = features.minmax(df, ["a", "b"], -1.0, 1.0).orderBy("id").collect()
    assert [(r["scaled_0"], r["scaled_1"]) for r in scaled] == [(-1.0, -1.0), (1.0, -1.0)]
    z = features.zscore(df, ["a", "b"]).orderBy("id").collect()
    assert [(r["a_zscore"], r["b_zscore"]) for r in z] == [(-1.0, None), (1.0, None)]
    assert features.drop_low_variance(df, ["a", "b"]).columns == ["id", "a"]
    assert features.drop_low_variance(df, ["a", "b"], skip=["b"]).columns == ["id", "a", "b"]


@pytest.mark.parametrize(("share", "target"), [(0.36, 0.165), (0.369, 0.22), (0.9, 0.165), (0.1, 0.3)])
def test_oversample_follows_the_doubling_rule(spark, share, target):
    n = 200
    labels = [1 if i < share * n else 0 for i in range(n)]
    df = spark.createDataFrame(list(enumerate(labels)), "id long, is_duplicate int")
    negatives = [i for i, y in enumerate(labels) if not y]
    excess = sum(labels) / n / target - 1
    expected = list(negatives)
    while excess > 1:
        expected, excess = expected + expected, excess - 1
    expected += expected[: max(0, int(excess * len(expected)))]
    out = sampling.oversample(df, 0, target)
    got = [r["id"] for r in out.where("is_duplicate = 0").collect()]
    assert sorted(got) == sorted(expected)
    assert out.where("is_duplicate = 1").count() == sum(labels)


def test_folds_and_splits(spark):
    df = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(203)], "id long, is_duplicate int")
    folds = sampling.stratified_folds(df, 5).groupBy("is_duplicate", "fold").count().collect()
    for label in (0, 1):
        sizes = [r["count"] for r in folds if r["is_duplicate"] == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    train, valid = sampling.split(df, 0.2)
    assert train.count() + valid.count() == 203
    assert not train.join(valid, "id", "left_semi").count()


def cell_values(t1, t2, vectors, size=28):
    """The grid built the long way: all scores, cyclic fill, nearest neighbour."""

    def sim(a, b):
        if a not in vectors or b not in vectors:
            return 0.0
        x, y = np.array(vectors[a]), np.array(vectors[b])
        return float(x @ y / np.sqrt((x @ x) * (y @ y)))

    scores = [sim(a, b) for a, b in itertools.product(t1, t2)] or [0.0]
    side = math.ceil(math.sqrt(len(scores)))
    square = np.resize(np.array(scores), (side, side))
    # aligned corners: output r shows input r * (side-1) / (size-1), rounded
    at = [math.floor(r * (side - 1) / (size - 1) + 0.5) for r in range(size)]
    return np.round(square[np.ix_(at, at)].ravel(), 5)


def test_grid_equals_the_full_product(spark):
    rng = np.random.default_rng(1)
    vectors = {f"w{i}": rng.normal(size=6).tolist() for i in range(40)}
    words = [*vectors, "unknown"]
    sizes = [(0, 3), (1, 1), (2, 3), (11, 13), (28, 28), (29, 28), (60, 45), (3, 700)]
    data = [
        (i, [words[k] for k in rng.integers(0, 41, a)], [words[k] for k in rng.integers(0, 41, b)])
        for i, (a, b) in enumerate(sizes)
    ]
    df = spark.createDataFrame(data, "id long, tokens1 array<string>, tokens2 array<string>")
    table = spark.createDataFrame(list(vectors.items()), "word string, vector array<double>")
    got = {r["id"]: r["grid"] for r in grid.similarity_grid(df, table).collect()}
    for i, t1, t2 in data:
        assert len(got[i]) == 784
        assert np.allclose(got[i], cell_values(t1, t2, vectors), atol=1.1e-5), i
    assert got[0] == [0.0] * 784


def test_tfidf_equals_the_long_way(spark):
    texts = {
        (1, 1): "red rings rolling", (1, 2): "the red ring rolled red", (2, 1): "the of",
        (2, 2): "blue bolts", (3, 1): "the", (3, 2): "",
    }
    stems = {"rings": "ring", "rolling": "roll", "rolled": "roll", "bolts": "bolt"}
    df = spark.createDataFrame(
        [(i, s, t.split()) for (i, s), t in texts.items()], "id long, side int, tokens array<string>"
    )
    grams = {}
    for key, t in texts.items():
        kept = [stems.get(w, w) for w in t.split() if w not in ("the", "of")]
        grams[key] = kept + [" ".join(p) for p in zip(kept, kept[1:])]
    freq = {}
    for g in grams.values():
        for term in set(g):
            freq[term] = freq.get(term, 0) + 1
    expected = {}
    for key, g in grams.items():
        w = np.array([g.count(t) * (math.log(7 / (1 + freq[t])) + 1) for t in sorted(set(g))])
        w = w / np.sqrt((w * w).sum()) if len(w) else w
        expected[key] = (w.sum(), w.mean() if len(w) else 0.0)
    got = {r["id"]: r for r in tfidf.tfidf_features(df).collect()}
    assert set(got) == {1, 2}
    for i in (1, 2):
        for s in (1, 2):
            assert got[i][f"weight_q{s}_sw"] == pytest.approx(expected[i, s][0])
            assert got[i][f"weight_q{s}_mw"] == pytest.approx(expected[i, s][1])
    lengths = tfidf.tfidf_weights(df).groupBy("id", "side").agg(F.sum(F.col("weight") ** 2).alias("l"))
    assert all(r["l"] == pytest.approx(1) for r in lengths.collect())
    share = {r["id"]: r["stemmatchpct"] for r in tfidf.stemmed_match_share(df, ["the", "of"]).collect()}
    assert share == {1: 1.0, 2: 0.0, 3: 0.0}


@pytest.fixture(scope="module")
def animals(spark):
    # cat and tiger share a parent; "jaguar" is a cat and a car; "auto" and "car" are one synset
    edge = [("animal", "entity"), ("feline", "animal"), ("cat.n", "feline"), ("tiger.n", "feline"),
            ("jaguar.a", "feline"), ("thing", "entity"), ("car.n", "thing"), ("jaguar.c", "car.n"),
            ("feline", "thing")]
    lemma = [("cat", "cat.n", 1), ("tiger", "tiger.n", 1), ("jaguar", "jaguar.c", 1),
             ("jaguar", "jaguar.a", 2), ("car", "car.n", 1), ("auto", "car.n", 1)]
    lemma = spark.createDataFrame(lemma, "word string, synset string, sense_no int")
    edge = spark.createDataFrame(edge, "child string, parent string")
    return lemma, edge, taxonomy.build_closure(lemma, edge)


def test_closure(animals):
    rows_ = {(r["synset"], r["ancestor"]): r for r in animals[2].collect()}
    assert (rows_["cat.n", "entity"]["dmin"], rows_["cat.n", "entity"]["dmax"]) == (3, 3)
    assert rows_["jaguar.c", "car.n"]["dmin"] == 1
    assert rows_["cat.n", "cat.n"]["deepest"] == 3 and rows_["cat.n", "entity"]["shallow"] == 0
    assert ("cat.n", "car.n") not in rows_


def test_closure_refuses_a_cycle(spark, animals):
    edge = spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string")
    with pytest.raises(ValueError, match="cycle"):
        taxonomy.build_closure(animals[0], edge)


def test_word_similarity(spark, animals):
    lemma, _, closure = animals
    asked = [("cat", "tiger"), ("cat", "cat"), ("jaguar", "cat"), ("jaguar", "car"), ("car", "auto"),
             ("cat", "nothing")]
    df = spark.createDataFrame(asked, "w1 string, w2 string")
    got = {(r["w1"], r["w2"]): r["sim"] for r in taxonomy.word_similarity(df, lemma, closure).collect()}

    def expected(path, height):
        return pytest.approx(math.exp(-0.2 * path) * math.tanh(0.45 * height))

    assert got["cat", "tiger"] == expected(2, 3)
    assert got["cat", "cat"] == expected(0, 3)
    assert got["jaguar", "cat"] == expected(2, 3)  # the animal sense wins
    assert got["jaguar", "car"] == expected(1, 3)  # the car sense wins
    assert got["car", "auto"] == expected(0, 2)
    assert ("cat", "nothing") not in got


def test_sentence_similarity(spark, animals):
    lemma, _, closure = animals
    data = [
        (1, ["cat", "runs"], ["cat", "runs"]),
        (2, ["cat"], ["tiger"]),
        (3, ["the"], ["cat"]),
        (4, ["stone"], ["water"]),
        (5, [], []),
    ]
    df = spark.createDataFrame(data, "id long, tokens1 array<string>, tokens2 array<string>")
    sem = {r["id"]: r["sem_similarity"] for r in taxonomy.semantic_similarity(df, lemma, closure).collect()}
    # cat/tiger are close: vectors (1, .2) and (.2, 1)
    assert sem == {1: pytest.approx(1), 2: pytest.approx(0.4 / 1.04), 3: 0.0, 4: 0.0, 5: 0.0}
    order = {
        r["id"]: r["word_order_similarity"]
        for r in taxonomy.word_order_similarity(df, lemma, closure).collect()
    }
    assert order[1] == pytest.approx(1)
    # joint (cat, tiger): r1 = (0, 0), r2 = (1, 1)
    assert order[2] == pytest.approx(0.0)
    assert order[5] is None
    info = spark.createDataFrame([("cat", 3, 0.5), ("tiger", 1, 0.8)], "word string, n long, info double")
    weighted = taxonomy.semantic_similarity(df, lemma, closure, info).where("id = 2").first()[1]
    # vectors (.25, .2*.8*.5) and (.2*.5*.8, .64)
    a, b = np.array([0.25, 0.08]), np.array([0.08, 0.64])
    assert weighted == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)))
    one = spark.createDataFrame([(1, ["cat"], ["cat"])], df.schema)
    assert taxonomy.word_order_similarity(one, lemma, closure).first()[1] is None


def test_dedupe(spark):
    df = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.2), (2, "a", 0.3)], "test_id int, m string, p double")
    assert [tuple(r) for r in pairs.dedupe_predictions(df).collect()] == [(2, "a", 0.3)]
    kept = pairs.dedupe_predictions(df, keep="last", order="m").orderBy("test_id").collect()
    assert [tuple(r) for r in kept] == [(1, "b", 0.2), (2, "a", 0.3)]


def test_latest_text(spark):
    data = [(1, 7, 8, "a", "b", "TR"), (2, 8, 9, "c", "", "TR"), (3, 7, 9, "z", "z", "TS")]
    df = spark.createDataFrame(data, "id long, qid1 long, qid2 long, question1 string, question2 string, type string")
    assert {tuple(r) for r in pairs.latest_text(df).collect()} == {(7, "a"), (8, "c")}


def test_metrics(spark):
    df = spark.createDataFrame([(1, 0.5, 1), (2, 0.4, 1), (3, 0.9, 0), (4, 0.1, 0)], "id long, p double, y int")
    assert evaluate.accuracy(df).first()[0] == 50.0
    cells = {(r["label"], r["predicted"]): r["n"] for r in evaluate.confusion_matrix(df).collect()}
    assert cells == {(0, 0): 1, (0, 1): 1, (1, 0): 1, (1, 1): 1}
    expected = -np.mean(np.log([0.5, 0.4, 0.1, 0.9]))
    assert evaluate.log_loss(df).first()[0] == pytest.approx(expected)
    none = evaluate.precision_recall_f1(df.where("y = 0 and p < 0.5")).orderBy("class").collect()
    assert none[1]["precision"] is None and none[0]["f1"] == 1.0
    batches = evaluate.batched_accuracy(df, 3).orderBy("batch").collect()
    assert [(r["batch"], r["n"]) for r in batches] == [(0, 3), (1, 1)]


def test_apply_groups_passes_arguments(spark):
    df = spark.range(10).repartition(3)
    out = apply_groups(df, lambda f, by: f.assign(id=f["id"] * by), "id long", by=3)
    assert sorted(r[0] for r in out.collect()) == [3 * i for i in range(10)]


def test_cooccurrence_equals_a_matrix_product(spark):
    docs = [["a", "b", "a"], ["b", "c"], ["a", "c", "c"]]
    df = spark.createDataFrame([(d,) for d in docs], "tokens array<string>")
    got = {(r["focus"], r["term"]): r["n"] for r in profile.cooccurrence(df, ["a", "c"]).collect()}
    x = np.array([[d.count(w) for w in "abc"] for d in docs])
    product = x.T @ x
    expected = {
        (f, t): int(product["abc".index(f), j])
        for f in "ac" for j, t in enumerate("abc") if f != t and product["abc".index(f), j]
    }
    assert got == expected


def test_discriminant_separates_two_classes(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 1, (60, 2)), rng.normal(2, 1, (40, 2))])
    y = [0] * 60 + [1] * 40
    df = spark.createDataFrame(
        [(i, float(a), float(b), c) for i, ((a, b), c) in enumerate(zip(x, y))],
        "id long, a double, b double, is_duplicate int",
    )
    fit = learn.fit_discriminant(df, ["a", "b"], ridge=0.0)
    within = sum(np.cov(x[np.array(y) == k].T, bias=True) * (np.array(y) == k).sum() for k in (0, 1)) / 98
    w = np.linalg.solve(within, x[60:].mean(0) - x[:60].mean(0))
    assert np.allclose(fit.weights, w)
    scored = fit.transform(df).collect()
    ld = np.array([r["LD1"] for r in scored])
    assert ld.mean() == pytest.approx(0, abs=1e-9)
    right = np.mean([r["class"] == r["is_duplicate"] for r in scored])
    assert right > 0.85


def test_pca(spark):
    rng = np.random.default_rng(5)
    data = [(i, [float(v) for v in rng.normal(i % 2, 1, 6)], i % 2) for i in range(80)]
    df = spark.createDataFrame(data, "id long, grid array<double>, is_duplicate int")
    fit = learn.fit_pca(df, k=3)
    projected = fit.transform(df)
    scree = learn.explained_variance(projected, 3, fit).orderBy("component").collect()
    x = np.array([r[1] for r in data])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    eigen = np.sort(np.linalg.eigvalsh(np.cov(z.T, bias=True)))[::-1][:3]
    assert np.allclose([r["variance"] for r in scree], eigen)


def test_cooccurrence_matrix(spark):
    rng = np.random.default_rng(1)
    docs = [[f"w{k}" for k in rng.integers(0, 30, n)] for n in (0, 1, 5, 80, 200)]
    df = spark.createDataFrame([(d,) for d in docs], "tokens array<string>")
    for max_n, block in ((1, 256), (2, 7)):
        want = {}
        for d in docs:
            grams = [" ".join(d[i : i + k]) for k in range(1, max_n + 1) for i in range(len(d) - k + 1)]
            counts = {g: grams.count(g) for g in grams}
            for a, b in itertools.combinations(sorted(counts), 2):
                want[a, b] = want.get((a, b), 0) + counts[a] * counts[b]
        got = profile.cooccurrence_matrix(df, max_n, block)
        assert {(r["term1"], r["term2"]): r["n"] for r in got.collect()} == want
        row = {r["term"]: r for r in profile.matrix_rows(got).collect()}["w3"]
        own = [n for pair, n in want.items() if "w3" in pair]
        assert (row["n_terms"], row["total"], row["most"]) == (len(own), sum(own), max(own))
    assert profile.cooccurrence_matrix(df.limit(0)).count() == 0


def test_cooccurrence_rows_are_sums_of_the_matrix(spark):
    rng = np.random.default_rng(4)
    docs = [[f"w{k}" for k in rng.zipf(1.3, n) % 400] for n in (0, 1, 2, 60, 60, 300)]
    docs += [docs[3], ["alone"], ["x", "x", "y"], ["z", None, "x"], None]
    df = spark.createDataFrame([(d,) for d in docs], "tokens array<string>").repartition(3)
    clean = df.select(F.filter("tokens", lambda t: t.isNotNull()).alias("tokens"))
    for source, max_n in ((df, 1), (clean, 2)):
        cells = {}
        for d in docs:
            d = [t for t in d or [] if t is not None]
            grams = [" ".join(d[i : i + k]) for k in range(1, max_n + 1) for i in range(len(d) - k + 1)]
            counts = {g: grams.count(g) for g in grams}
            for a, b in itertools.permutations(counts, 2):
                row = cells.setdefault(a, {})
                row[b] = row.get(b, 0) + counts[a] * counts[b]
        want = {(t, len(r), sum(r.values()), max(r.values())) for t, r in cells.items()}
        for block in (1 << 23, 50):
            got = profile.cooccurrence_rows(source, max_n, block)
            assert {tuple(r) for r in got.select("term", "n_terms", "total", "most").collect()} == want
        matrix = profile.matrix_rows(profile.cooccurrence_matrix(source, max_n))
        assert {tuple(r) for r in matrix.collect()} == want
    assert profile.cooccurrence_rows(df.limit(0)).count() == 0


def test_a_tile_is_multiplied_some_rows_at_a_time(monkeypatch):
    rng = np.random.default_rng(6)

    def entries(terms, seen):
        block = object.__new__(term_tiles.Entries)
        cells = np.argwhere(seen)  # in the order of terms
        block.terms, block.own, block.doc = terms, cells[:, 0].astype(np.int32), cells[:, 1] + 7
        block.n = rng.integers(1, 5, len(cells)).astype(np.int32)
        return block

    def dense(block):
        x = np.zeros((len(block.terms), 60), np.int64)
        x[block.own, block.doc - 7] = block.n
        return x

    left, right = (entries(np.arange(k) * 3, rng.random((k, 60)) < 0.2) for k in (20, 30))
    monkeypatch.setattr(term_tiles, "PRODUCTS", 50)
    for a, b in ((left, right), (left, left)):
        parts = list(term_tiles.products(a, b))
        assert len(parts) > 5 and max(len(row) for row, _, _ in parts) < 500
        got, want = np.zeros((len(a.terms), len(b.terms)), np.int64), dense(a) @ dense(b).T
        for row, column, n in parts:
            assert not got[row, column].any()
            got[row, column] = n
        if a is b:
            np.fill_diagonal(want, 0)
        assert (got == want).all()
    keys, n = np.array([5, 1 << 61, 5, 0]), np.array([1, 1 << 40, 2, 3])
    assert [x.tolist() for x in term_tiles.summed(keys, n)] == [[0, 5, 1 << 61], [3, 3, 1 << 40]]


def test_functions_of_groups_see_them_in_parts(spark):
    rows = [(k % 7 if k % 11 else None, float(k)) for k in range(5000)] + [(1, 0.5)] * 20000
    df = spark.createDataFrame(rows, "key int, v double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")

    def total(frames, times):
        n, s, most = 0, 0.0, 0
        for frame in frames:
            n, s, most = n + len(frame), s + frame["v"].sum(), max(most, len(frame))
        yield frame[["key"]].head(1).assign(n=n, total=s * times, most=most)

    try:
        schema = "key int, n long, total double, most long"
        got = {r["key"]: r for r in apply_by_key(df, "key", total, schema, times=2).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for k, v in rows:
        n, s = want.get(k, (0, 0.0))
        want[k] = (n + 1, s + v)
    assert {k: (r["n"], r["total"]) for k, r in got.items()} == {k: (n, 2 * s) for k, (n, s) in want.items()}
    assert max(r["most"] for r in got.values()) <= 1000  # never a whole large group
    assert apply_by_key(df.limit(0), "key", total, schema, times=2).count() == 0

    def part(frame, times):
        return frame[["key"]].head(1).assign(n=len(frame), v=frame["v"].sum())

    def combine(frames, times):
        for frame in frames:
            yield frame[["key"]].head(1).assign(n=frame["n"].sum(), total=frame["v"].sum() * times)

    parts = combine_by_key(df.coalesce(1), "key", part, combine, "key int, n long, v double",
                           "key int, n long, total double", times=2)
    merged = {}
    for r in parts.collect():
        n, s = merged.get(r["key"], (0, 0.0))
        merged[r["key"]] = (n + r["n"], s + r["total"])
    assert merged == {k: (n, 2 * s) for k, (n, s) in want.items()}


def test_stem_of_a_word_equals_the_vocabulary(spark):
    import random

    from pairmatch.functions import words
    from pairmatch.functions.stem import SPECIAL, stem_vocabulary, stem_word

    rng = random.Random(7)
    ends = "ing ed eed eedly ingly ies ied sses s ss us y Y e l ll li logi ogi ization ational tional ative " \
        "fulness ement ment ion tion sion ous ive ize able 's 's' ' bb tt at iz".split()
    starts = ["", "'", "''", "y", "gener", "commun", "arsen", "sky", "É", "-", "9"]
    made = {"".join(rng.choice("aeiouybdlmnrstxw'Yé") for _ in range(rng.randint(0, 6))) for _ in range(1500)}
    made = {rng.choice(starts) + w + rng.choice(["", *ends]) + rng.choice(["", "", *ends]) for w in made for _ in range(4)}
    made |= {*SPECIAL, *words.STOP_WORDS, "eatss\u0085", "tried\u2028", "ba\u0085s", "controll", "hopping"}
    rows = stem_vocabulary(spark.createDataFrame([(w,) for w in made], "word string")).collect()
    assert {r["word"]: stem_word(r["word"]) for r in rows} == {r["word"]: r["stem"] for r in rows}


def test_terms_are_counted_without_a_row_per_token(spark, monkeypatch):
    from collections import Counter

    monkeypatch.setattr(tfidf, "PIECE_WORDS", 4)
    rows = [
        (1, 1, ["x1", "the", "y2", "x1", None, "x1"]), (1, 2, []), (2, 1, None),
        (2, 2, ["x1 y2", "x1", "y2"]), (3, 1, ["q7", "r8"]), (3, 1, ["r9", None, "s3"]), (None, 1, ["x1"]),
    ]
    docs = spark.createDataFrame(rows, "id long, side int, tokens array<string>")
    got = {(r["id"], r["side"], r["term"]): r["tf"] for r in tfidf.term_counts(docs, max_n=3).collect()}
    texts = {
        (1, 1): ["x1", "y2", "x1", "x1"], (2, 2): ["x1 y2", "x1", "y2"], (3, 1): ["q7", "r9", "r8", "s3"],
        (None, 1): ["x1"],
    }
    want = Counter(
        (*doc, " ".join(words[i : i + n]))
        for doc, words in texts.items() for n in (1, 2, 3) for i in range(len(words) - n + 1)
    )
    assert got == want
    # the tokens of a document stay in one row up to its terms
    plan = tfidf.stem_tokens(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_parts_are_about_one_per_key_however_rows_lie(spark):
    import pandas as pd

    from pairmatch.operators.groups import combine_by_key

    def part(frame):
        return pd.DataFrame({"k": frame["k"].iloc[:1], "n": [len(frame)], "parts": [1]})

    def combine(frames):
        rows = pd.concat(list(frames))
        yield pd.DataFrame({"k": rows["k"].iloc[:1], "n": [rows["n"].sum()], "parts": [len(rows)]})

    key = F.when(F.col("id") % 100 != 0, F.col("id") % 100)
    rows = spark.range(0, 800, 1, 8).select(key.alias("k"))
    rows = rows.unionByName(spark.range(0, 6000, 1, 2).select(F.lit(1000).alias("k")))
    schema = "k long, n long, parts long"
    got = {r["k"]: (r["n"], r["parts"]) for r in combine_by_key(rows, "k", part, combine, schema, schema).collect()}
    assert got.pop(1000)[0] == 6000
    assert got == {k or None: (8, 1) for k in range(100)}


@pytest.mark.parametrize("most", [0, 1, 3, 100])
def test_word_pairs_are_scored_whether_words_are_common_or_not(spark, monkeypatch, most):
    monkeypatch.setattr(grid, "MOST_COMMON", most, raising=False)
    found = {"p": [1.0, 0.0], "q": [1.0, 1.0], "r": [0.0, 2.0], "z": [0.0, 0.0]}
    pairs = [("p", "p"), ("p", "q"), ("p", "r"), ("p", "u"), ("q", "r"), ("p", "z"), ("u", "u"), ("q", "q")]
    got = grid.score_word_pairs(
        spark.createDataFrame(pairs, "a string, b string"),
        spark.createDataFrame(list(found.items()), "word string, vector array<float>"),
    )
    want = {("p", "p"): 1.0, ("p", "q"): 0.70711, ("p", "r"): 0.0, ("q", "r"): 0.70711, ("q", "q"): 1.0}
    assert {(r["a"], r["b"]): r["sim"] for r in got.collect()} == want
    assert grid.most_used(spark.createDataFrame([("p", 9), ("q", 2)], "word string, n long"), most).count() == min(most, 2)


def test_sentences_of_few_words_shuffle_no_product(spark, animals, monkeypatch):
    lemma, _, closure = animals
    rng = np.random.default_rng(3)
    words = ["cat", "tiger", "jaguar", "car", "auto", "the", "x"]
    data = [(k, *(rng.choice(words, n).tolist() for n in rng.integers(0, 6, 2))) for k in range(40)]
    data += [(None, ["cat"], ["tiger"]), (50, None, ["cat"])]
    df = spark.createDataFrame(data, "id long, tokens1 array<string>, tokens2 array<string>")

    def found(rows):
        best = taxonomy.most_similar(rows, lemma, closure, 0.2, ["auto"])
        return sorted(map(tuple, best.collect())), sorted(map(tuple, taxonomy.asked_pairs(rows, lemma).collect()))

    def refused(*_, **__):
        raise AssertionError("a product of sentences")

    with monkeypatch.context() as m:
        m.setattr(taxonomy, "wanted_pairs", refused)
        few = found(df)
    monkeypatch.setattr(taxonomy, "FEW_WORDS", 0)
    assert few == found(df) and len(few[0]) > 20
    monkeypatch.undo()
    # rows of one id are one to the joins, as before
    twice = df.unionByName(df.where("id < 9").withColumn("id", F.lit(1).cast("long")))
    both = found(twice)
    monkeypatch.setattr(taxonomy, "FEW_WORDS", 0)
    assert both == found(twice)


def test_grids_of_common_and_rare_words(spark, monkeypatch):
    """The same grids however many words are sent to the tasks; null sides, repeated and null keys."""
    rng = np.random.default_rng(5)
    vectors = [(f"w{k}", rng.normal(size=5).tolist()) for k in range(30)] + [("zero", [0.0] * 5)]
    words = [w for w, _ in vectors] + ["unknown"]
    data = [
        (k, [words[x] for x in rng.integers(0, 32, 3 + k)], [words[x] for x in rng.integers(0, 32, 40)])
        for k in range(30)
    ]
    data += [(50, None, ["w1", "w2"]), (51, ["w1"], None), (52, None, None), (53, [], ["w1"]), (None, ["w1"], ["w1"])]
    data += [data[2], data[25], (60, ["w1"], ["w2"]), (60, ["w1"], ["w3"])]
    df = spark.createDataFrame(data, "id long, tokens1 array<string>, tokens2 array<string>").repartition(3)
    table = spark.createDataFrame(vectors, "word string, vector array<float>")
    found = []
    for most in (0, 4, 100):
        monkeypatch.setattr(grid, "MOST_COMMON", most)
        found.append({r["id"]: r["grid"] for r in grid.similarity_grid(df, table).collect()})
    assert found[0] == found[1] == found[2] and len(found[0]) == 36
    known = {w: np.float32(v).tolist() for w, v in vectors if w != "zero"}
    for i, t1, t2 in data[:30]:
        if i not in (2, 25):
            assert np.allclose(found[0][i], cell_values(t1, t2, known), atol=1.1e-5), i
    assert found[0][50] == [1.0] * 784 and found[0][None] == [1.0] * 784
    assert found[0][51] == found[0][52] == found[0][53] == [0.0] * 784
    assert len(found[0][25]) == 2 * 784


def test_no_word_pair_of_a_grid_is_shuffled(spark, monkeypatch):
    """Stored and shuffled rows grow with the words of a text pair, not with its cells."""
    names, written = [], grid.written
    monkeypatch.setattr(grid, "written", lambda df, name: names.append((name, df.count())) or written(df, name))
    tokens = [[f"w{p}-{k}" for k in range(28)] for p in range(20)]
    rows = [(p, words, words) for p, words in enumerate(tokens)]
    df = spark.createDataFrame(rows, "id long, tokens1 array<string>, tokens2 array<string>")
    table = spark.createDataFrame([(w, [1.0, 2.0]) for t in tokens for w in t], "word string, vector array<float>")
    assert grid.similarity_grid(df, table).count() == 20
    assert max(n for _, n in names) == 20 * 28


def test_word_pairs_without_a_score_stay_when_asked_for(spark, monkeypatch):
    pairs = [("p", "q"), ("p", "u"), ("u", "v"), ("p", "z")]
    table = spark.createDataFrame([("p", [1.0, 0.0]), ("q", [1.0, 1.0]), ("z", [0.0, 0.0])], "word string, vector array<float>")
    for most in (0, 2, 100):
        monkeypatch.setattr(grid, "MOST_COMMON", most)
        got = grid.score_word_pairs(spark.createDataFrame(pairs, "a string, b string"), table, "left")
        assert {(r["a"], r["b"]): r["sim"] for r in got.collect()} == {
            ("p", "q"): 0.70711, ("p", "u"): None, ("u", "v"): None, ("p", "z"): None
        }


def test_five_decimals_as_spark_rounds(spark):
    values = [0.000005, 0.000015, 0.123455, -0.123465, 0.1234550000001, 1.0, -0.0, 0.99999500000000001]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    want = [r[0] for r in df.select(F.bround("x", 5)).collect()]
    assert grid.bround5(np.array(values)).tolist() == want


def test_words_with_several_vectors_score_for_each(spark, monkeypatch):
    """A row per two vectors of a pair; in a grid the scores of a cell follow one another, the least first."""
    pairs = spark.createDataFrame([("p", "q"), ("q", "q"), ("p", "r")], "a string, b string")
    vectors = [("p", [1.0, 0.0]), ("q", [1.0, 1.0]), ("q", [0.0, 1.0]), ("r", [-0.000001, 1.0])]
    table = spark.createDataFrame(vectors, "word string, vector array<double>")
    df = spark.createDataFrame([(1, ["p"], ["q"])], "id long, tokens1 array<string>, tokens2 array<string>")
    for most in (0, 100):
        monkeypatch.setattr(grid, "MOST_COMMON", most)
        got = sorted((r["a"], r["b"], repr(r["sim"])) for r in grid.score_word_pairs(pairs, table).collect())
        assert got == [
            ("p", "q", "0.0"), ("p", "q", "0.70711"), ("p", "r", "0.0"),
            ("q", "q", "0.70711"), ("q", "q", "0.70711"), ("q", "q", "1.0"), ("q", "q", "1.0"),
        ]
        shown = grid.similarity_grid(df, table).first()["grid"]
        assert set(shown) == {0.0} and len(shown) == 784


def test_token_product_has_every_cell(spark):
    """All cells of a product beyond 784, in the order of itertools.product; no pair is left out."""
    rng = np.random.default_rng(24)
    texts = {k: [[f"w{x}" for x in rng.integers(0, 60, m)] for m in sizes]
             for k, sizes in enumerate([(45, 70), (1, 1), (3, 2000), (0, 4), (4, 0), (0, 0)])}
    data = [(k, *t) for k, t in texts.items()] + [(90, None, ["a"]), (91, ["a"], None), (92, None, None)]
    df = spark.createDataFrame(data, "id long, tokens1 array<string>, tokens2 array<string>")
    got = {}
    for r in grid.token_product(df).collect():
        got.setdefault(r["id"], []).append(r)
    for k, t1, t2 in data:
        want = list(itertools.product(t1 or [], t2 or []))
        rows = sorted(got[k], key=lambda r: r["cell"])
        if not want:
            lone = t2[0] if t1 is None and t2 else None
            assert [tuple(r)[1:] for r in rows] == [(0, 1, None, lone)]
            continue
        cells = {r["cell"] + j: (r["w1"], w) for r in rows for j, w in enumerate(r["w2"].split(" "))}
        assert [cells[c] for c in range(len(cells))] == want
        assert {r["n"] for r in rows} == {len(want)}


@pytest.mark.parametrize("repeats", [0, 100])
def test_weights_of_packed_terms(spark, monkeypatch, repeats):
    """Many small packs and buckets give the weights of the long way; no row per term is stored."""
    rng = np.random.default_rng(12)
    data = [(int(i), s, [f"x{w}" for w in rng.integers(0, 30, rng.integers(0, 25))]) for i in range(40) for s in (1, 2)]
    data += [(None, 1, ["x1", "x2"]), (3, 1, ["x5", "x6"]), (90, 1, None), (91, 2, ["the"])]
    docs = spark.createDataFrame(data, "id long, side int, tokens array<string>")
    names, written = [], tfidf.written
    monkeypatch.setattr(tfidf, "written", lambda df, name: names.append(name) or written(df, name))
    for name, n in (("PACK_WORDS", 60), ("BUCKET_TERMS", 40), ("HANDED_ROWS", 7), ("MOST_REPEATS", repeats)):
        monkeypatch.setattr(tfidf, name, n)
    texts = {}
    for i, s, words in data:
        if (i, s) in texts:  # rows of a document are merged by place
            longer = itertools.zip_longest(texts[i, s], words)
            texts[i, s] = [w for pair in longer for w in sorted(w for w in pair if w)]
        else:
            texts[i, s] = words or []
    grams = {}
    for k, words in texts.items():
        kept = [w for w in words if w != "the"]
        grams[k] = kept + [" ".join(p) for p in zip(kept, kept[1:])]

    def long_way(freq, n):
        out = {}
        for k, g in grams.items():
            own = {t: g.count(t) * (math.log((1 + n) / (1 + freq[t])) + 1) for t in set(g) if t in freq}
            length = math.sqrt(sum(w * w for w in own.values()))
            out |= {(*k, t): w / length for t, w in own.items()}
        return out

    freq = {}
    for g in grams.values():
        for t in set(g):
            freq[t] = freq.get(t, 0) + 1
    want = long_way(freq, len(data))
    rows_ = tfidf.tfidf_weights(docs).collect()
    got = {(r["id"], r["side"], r["term"]): r["weight"] for r in rows_}
    assert len(rows_) == len(got) and got == pytest.approx(want)
    assert names == ["packed-terms"]
    plain = tfidf.tfidf_weights(docs, named=False)
    assert plain.columns == ["id", "side", "weight"] and plain.count() == len(want)
    some = [(t, n) for t, n in freq.items() if len(t) % 3]
    fitted = tfidf.Frequencies(spark.createDataFrame(some, "term string, df long"), 55)
    want = long_way(dict(some), 55)
    found = {r["id"]: r for r in tfidf.tfidf_features(docs, fitted=fitted).collect()}
    assert set(found) == {k[0] for k in want}
    for i, r in found.items():
        for s in (1, 2):
            own = [w for k, w in want.items() if k[:2] == (i, s)]
            assert r[f"weight_q{s}_sw"] == pytest.approx(sum(own))
            assert r[f"weight_q{s}_mw"] == pytest.approx(sum(own) / len(own) if own else 0.0)
    assert tfidf.tfidf_weights(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sizes", [(1 << 12, 1 << 20), (3, 5)])
def test_best_matches_of_few_words_in_packed_form(spark, animals, monkeypatch, sizes):
    """Matches looked up in tasks are those of the joins, also in small pieces; no list is searched per word."""
    rng = np.random.default_rng(14)
    names = ["cat", "tiger", "jaguar", "car", "auto", "x", "y", None]
    def side():
        return None if rng.random() < 0.1 else [names[k] for k in rng.integers(0, 8, rng.integers(0, 7))]
    data = [(k, side(), side()) for k in range(60)] + [(None, ["cat"], ["tiger"])]
    df = spark.createDataFrame(data, "id long, tokens1 array<string>, tokens2 array<string>")
    for name, n in zip(("PIECE_ROWS", "PIECE_PAIRS"), sizes):
        monkeypatch.setattr(taxonomy, name, n)
    lemma, _, closure = animals
    for skip in ([], ["tiger"]):
        few = taxonomy.most_similar(df, lemma, closure, 0.01, skip)
        assert "array_intersect" not in few._jdf.queryExecution().executedPlan().toString()
        with monkeypatch.context() as m:
            m.setattr(taxonomy, "FEW_WORDS", 0)
            joined = taxonomy.most_similar(df, lemma, closure, 0.01, skip)
            want = sorted(map(tuple, joined.collect()))
        got = sorted(map(tuple, few.collect()))
        assert len(want) > 30 and [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
        assert [r[3] for r in got] == pytest.approx([r[3] for r in want])


def test_feature_vector_computes_no_row_for_a_length(spark):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    tokens = spark.createDataFrame([(1, ["a"], ["b"])], "id long, tokens1 array<string>, tokens2 array<string>")
    vectors = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "word string, vector array<double>")
    cells = grid.similarity_grid(tokens, vectors)
    ones = spark.createDataFrame([(1,)], "id long").mapInArrow(run, "id long")
    tail = [*features.SCORE_COLUMNS, *[f"scaled_{i}" for i in range(1, 6)]]
    df = ones.join(cells, "id").withColumns({c: F.lit(0.5) for c in tail})
    vector = features.feature_vector(df)
    assert seen.value == 0
    assert vector.first()["features"].size == 792
