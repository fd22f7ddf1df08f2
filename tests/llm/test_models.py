import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairmatch.llm.queries import CATEGORIES, QUERIES, labelled_texts, load
from pairmatch.llm.suffix_tree import END, Settings, fit_suffix_tree, probability, score_texts
from pairmatch.llm.text import LOWER
from pairmatch.llm.toxicity import classify, fit_chain

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def tokens(text):
    return (text or "").encode().translate(LOWER).split() + [END]


def test_base_scores_equal_the_formula_and_contexts_help(spark):
    docs = load(spark, MEDIUM, "documents").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in QUERIES["op5_suffix_tree"](spark, MEDIUM).collect()}
    assert len(got) == len(docs)
    counts = Counter()
    for d in docs:
        if zlib.crc32(str(d["doc_id"]).encode()) % 10:
            counts.update(tokens(d["text"]))
    total, distinct = sum(counts.values()), len(counts)
    base = score = 0.0
    for d in docs:
        r, own = got[d["doc_id"]], tokens(d["text"])
        want = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in own)
        assert r["base_score"] == pytest.approx(want)
        assert r["n_tokens"] == len(own) and r["train_tokens"] == total
        assert r["n_known"] == sum(counts[t] > 0 for t in own)
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 10 == 0)
        if r["held_out"]:
            base, score = base + r["base_score"], score + r["score"]
    assert score > base


def model_of(spark, texts, **settings):
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, c int")
    settings = Settings(symbol=1e-4, context=1e-3, entry=1e-4, **settings)
    return docs, fit_suffix_tree(docs, settings=settings)


def test_every_state_is_a_distribution(spark):
    texts = ["a b c a b c a b d"] * 60 + ["x a y a z a"] * 40 + [f"w{k} a w{k}" for k in range(80)]
    _, model = model_of(spark, texts)
    tree = model.tree
    assert any(len(p) == 2 for p in tree.paths) and len(tree.paths) > 2
    symbols = np.arange(len(tree.words))
    rest = 10.0 ** model.base(0.0)  # a token that was never seen
    for node in range(len(tree.parent)):
        listed = probability(tree, node, symbols)
        # all tokens are symbols here, so only unseen ones are left
        factor = sum(tree.factor[n] for n in way(tree, node))
        assert listed.sum() + rest * 10.0**factor == pytest.approx(1.0)


def way(tree, node):
    while node:
        yield node
        node = tree.parent[node]


def test_scores_equal_a_walk_over_the_tree(spark):
    texts = ["a b c a b c a b d"] * 60 + ["x a y a z a"] * 40 + [None, "", "new a b c"]
    docs, model = model_of(spark, texts[:100])
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    tree = model.tree
    for r in score_texts(docs, model).collect():
        own, want = tokens(texts[r["doc_id"]]), 0.0
        for k, token in enumerate(own):
            node = 0
            for length in (1, 2):
                path = tuple(tree.words.get(t, -1) for t in own[max(0, k - length) : k])
                if len(path) == length and path in tree.paths:
                    node = tree.paths[path]
            if token in tree.words:
                want += math.log10(probability(tree, node, np.array([tree.words[token]]))[0])
            else:
                want += model.base(0.0) + sum(tree.factor[n] for n in way(tree, node))
        assert r["score"] == pytest.approx(want)


def test_nothing_to_learn_from(spark):
    docs, model = model_of(spark, [])
    assert score_texts(docs, model).count() == 0
    some = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    assert [r["n_known"] for r in score_texts(some, model).collect()] == [0, 0]


def test_toxic_documents_are_found(spark):
    docs, labels = load(spark, MEDIUM, "documents"), load(spark, MEDIUM, "labels")
    fitted = labels.where("doc_id % 4 <> 0")
    chain = fit_chain(labelled_texts(docs, fitted), CATEGORIES)
    # the later model reads the earlier probability
    assert len(chain.links[1].earlier) == len(chain.links[0].earlier) + 1
    rest = labels.where("doc_id % 4 = 0").select("doc_id", F.col("toxic").alias("truth"))
    got = classify(docs.withColumn("toxic", F.lit(3)), chain).select("doc.doc_id", "toxic")
    pairs = Counter((r["truth"], r["toxic"]) for r in rest.join(got, "doc_id").collect())
    hit, missed, wrong = pairs[1, True], pairs[1, False], pairs[0, True]
    assert hit >= 0.7 * (hit + missed) and wrong <= 0.03 * rest.count()


@pytest.mark.parametrize("truth", [[], [(1, "bad words", 1.0)] * 5, [(2, None, None)] * 3])
def test_labels_without_two_classes(spark, truth):
    rows = spark.createDataFrame(truth, "doc_id long, text string, toxic double")
    chain = fit_chain(rows, ["toxic"])
    docs = spark.createDataFrame([(1, "bad words"), (None, None), (1, "")], "doc_id long, text string")
    got = classify(docs, chain).collect()
    assert {r["toxic"] for r in got} == {bool(truth) and truth[0][2] == 1.0}


def test_the_tree_grows_with_the_corpus(spark):
    # 20 occurrences are enough among 1,200,000 tokens as well
    texts = ["p q r"] * 20 + ["z " * 1200] * 1000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tree = fit_suffix_tree(docs).tree
    p, q, r = (tree.words[t] for t in (b"p", b"q", b"r"))
    for path, symbol in (((p,), q), ((q,), r)):
        listed, values = tree.listed[tree.paths[path]]
        assert 10.0 ** values[listed == symbol][0] > 0.9


def test_joined_scores_equal_sent_ones(spark, monkeypatch):
    texts = ["a b c a b c a b d"] * 60 + ["x a y a z a"] * 40 + [None, "", "new a b c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = fit_suffix_tree(docs, settings=Settings(depth=3))
    assert len(model.levels) == 3
    want = {r["doc_id"]: r["score"] for r in score_texts(docs, model).collect()}
    for sent in (0, 3):
        monkeypatch.setattr("pairmatch.llm.suffix_tree.MOST_SENT", sent)
        got = {r["doc_id"]: r["score"] for r in score_texts(docs, model).collect()}
        assert got == pytest.approx(want)


def test_tasks_hand_over_small_batches(spark, monkeypatch):
    texts = ["a b c a b c a b d"] * 60 + ["x a y a z a"] * 40 + [f"w{k} a w{k}" for k in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)

    def fitted():
        model = fit_suffix_tree(docs)
        counts = {bytes(r["token"]): r["c"] for r in model.vocabulary.collect()}
        return counts, [sorted((r["key"], r["n"], r["p"]) for r in level.collect()) for level, _ in model.levels]

    want = fitted()
    for size in (1, 7):
        monkeypatch.setattr("pairmatch.llm.suffix_tree.BATCH", size)
        monkeypatch.setattr("pairmatch.llm.suffix_tree.FLUSH", 4 * size)
        got = fitted()
        assert got[0] == want[0] == Counter(t for text in texts for t in tokens(text))
        assert got[1] == want[1]
