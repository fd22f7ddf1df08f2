from collections import Counter

import corpus_pipeline as P
from pairmatch.llm.queries import load
from pairmatch.session import written

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stages(spark, docs):
    out = []
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, SMALL), "test-stage")
        out.append((name, docs))
    return dict(out)


def test_stages_on_the_documents(spark):
    docs = load(spark, SMALL, "documents")
    toxic = {r["doc_id"] for r in load(spark, SMALL, "labels").where("toxic = 1").collect()}
    out = stages(spark, docs)
    for name in list(out)[:-1]:
        assert out[name].columns == COLUMNS
    ids = {name: Counter(r[0] for r in t.select("doc_id").collect()) for name, t in out.items()}
    assert not toxic & set(ids["toxicity"]) or len(toxic & set(ids["toxicity"])) <= 0.2 * len(toxic)
    for before, after in zip(["toxicity", "near duplicates"], ["near duplicates", "decontamination"]):
        assert set(ids[after]) <= set(ids[before]) and max(ids[after].values()) == 1
    assert max(ids["mixing"].values()) <= 3
    assert ids["mixing"] == ids["sharding"]
    sizes = Counter(r["shard"] for r in out["sharding"].collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert P.run(spark, SMALL).count() == sum(ids["sharding"].values())


def test_stages_on_odd_rows(spark):
    t = "the quick brown fox jumps over the lazy dog again and again " * 3
    rows = [
        (1, t, "en", "a", 1), (1, t, "en", "a", 1), (2, t, None, None, None),
        (None, t, "en", "a", 1), (None, None, None, None, None), (None, None, None, None, None),
        (3, "", "en", "b", 0), (4, None, "en", "b", 0), (5, "one two", "en", "b", 0),
        (5, "one two", "en", "b", 0), (6, "x " * 50000, "en", "c", 1),
    ]
    docs = spark.createDataFrame(rows, load(spark, SMALL, "documents").schema)
    out = stages(spark, docs)
    left = sorted(out["near duplicates"].collect(), key=repr)
    assert Counter(r["doc_id"] for r in left) == Counter([None, 1, 3, 4, 5, 6])
    assert next(r["text"] for r in left if r["doc_id"] is None) is None
    empty = stages(spark, docs.limit(0))
    assert [t.count() for t in empty.values()] == [0] * 5


def left_after_near_copies(spark, rows):
    schema = load(spark, SMALL, "documents").schema
    docs = spark.createDataFrame([(k, t, "en", "a", 1) for k, t in rows], schema)
    return sorted((r["doc_id"], r["text"]) for r in P.drop_near_copies(spark, docs, SMALL).collect())


def test_near_copies_are_linked_at_four_fifths(spark):
    base = [f"w{k}" for k in range(104)]
    cut = lambda n: " ".join(base[: 104 - n])
    # 80 and 79 of 100 shingles are shared
    assert left_after_near_copies(spark, [(1, cut(0)), (2, cut(20))]) == [(1, cut(0))]
    assert len(left_after_near_copies(spark, [(1, cut(0)), (2, cut(21))])) == 2


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark):
    text = lambda name: " ".join(f"{name}{k}" for k in range(40))
    rows = [(1, text("a")), (7, text("a") + " end"), (7, text("b")), (7, text("c")), (8, text("c"))]
    want = [(1, text("a")), (7, text("b")), (7, text("c"))]
    assert left_after_near_copies(spark, rows) == want
