
import random
import re

import numpy as np
import pytest


import pairmatch.llm.components as C
import pairmatch.llm.minhash as M
from pairmatch.llm.components import connected_components
from pairmatch.llm.decontamination import contamination
from pairmatch.llm.fm_index import FMIndex
from pairmatch.llm.queries import load
from pairmatch.llm.text import LOWER

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("size,symbols", [(0, 3), (1, 3), (60, 2), (400, 4), (900, 9)])
def test_index_finds_all_places(size, symbols):
    rng = np.random.default_rng(size)
    text = rng.integers(0, symbols + 1, size)
    index = FMIndex(text, symbols, sample=4)
    for m in (1, 2, 3, 6):
        patterns = rng.integers(1, symbols + 1, (25, m))
        for pattern, low, high in zip(patterns, *index.search(patterns)):
            want = [k for k in range(size - m + 1) if (text[k : k + m] == pattern).all()]
            assert sorted(index.locate(np.arange(low, high)).tolist()) == want


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(LOWER))


def hits(text, items, window=13):
    own, mask, names = words(text), set(), set()
    for name, item in items:
        ws = words(item)
        for at in range(max(1, len(ws) - window + 1) if ws else 0):
            part = ws[at : at + window]
            for k in range(len(own) - len(part) + 1):
                if own[k : k + len(part)] == part:
                    mask.update(range(k, k + len(part)))
                    names.add("" if name is None else str(name))
    return len(own), len(mask), sorted(names)


@pytest.mark.parametrize("shard,block", [(1 << 20, 1 << 22), (40, 60)])
def test_contamination_equals_brute_force(spark, shard, block):
    rng = random.Random(3)
    vocabulary = ["a", "B", "c", "dé", "e1", "f"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([0, 2, 13, 14, 20])))) for k in range(12)]
    items += [(None, "q r"), (3, "s t u"), (50, None), (51, "!!"), (52, "lone")]
    docs = [(k, ", ".join(rng.choices(vocabulary, k=40)) + " " + (items[k % 12][1] or "")) for k in range(30)]
    docs += [(None, "x q r s T u y"), (1, ""), (2, None), (2, None), (60, "lone " * 300), (61, "no")]
    left = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, items int")
    right = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(left, right, shard_words=shard, block_words=block).collect()
    want = [(-1 if d[0] is None else d[0], *hits(d[1], items)) for d in docs]
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got) == sorted(want)
    for r in got:
        assert sum(s["stop"] - s["start"] for s in r["words"]) == r["n_hit"]
    if block > 1000:
        row = next(r for r in got if r["doc_id"] is None)
        assert [("x q r s T u y"[s["start"] : s["stop"]]) for s in row["spans"]] == ["q r s T u"]
    assert contamination(left.limit(0), right).count() == 0
    assert {r["n_hit"] for r in contamination(left, right.limit(0)).collect()} == {0}


def shingles(text):
    w = (text or "").encode().translate(LOWER).split()
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def components(docs):
    """Component per id, by comparing all pairs."""
    sets = {k: shingles(t) for k, t in docs}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: (len(sets[k]), root(k)) for k in sets}


def found(docs):
    rows = M.near_duplicates(docs).collect()
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


def test_near_duplicates_equal_all_pairs(spark):
    docs = load(spark, SMALL, "documents")
    want = components([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert found(docs) == want


def near_base(n, words, changed, seed=1):
    """Copies of one text with some words replaced: each resembles the text, not the others."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(words)]
    rows = [(n, " ".join(base))]  # the text itself has the largest id
    for k in range(n):
        own = list(base)
        for at in rng.sample(range(0, words, 5), changed):
            own[at] = f"x{k}_{at}"
        rows.append((k, " ".join(own)))
    return rows


@pytest.mark.parametrize("changed", [2, 3, 4, 6])
def test_links_through_a_member_that_is_no_centre(spark, changed):
    rows = near_base(40, 160, changed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs) == components(rows)


def test_many_rounds_of_centres(spark, monkeypatch):
    monkeypatch.setattr(M, "CENTRES", (1, 2, 3))
    rows = near_base(30, 160, 6) + [(k + 100, t) for k, t in near_base(20, 160, 3, seed=2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs) == components(rows)


def test_parts_of_a_bucket_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_MEMBERS", 7)
    monkeypatch.setattr(M, "BLOCK_HASHES", 1500)  # some nine centres a round
    rows = near_base(30, 160, 6) + [(k + 100, t) for k, t in near_base(20, 160, 3, seed=2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs) == components(rows)


def test_a_block_returns_no_more_links_than_components_join():
    block, rng = M.Block(), np.random.default_rng(2)
    base = np.unique(rng.integers(0, 1 << 40, 400))
    near = [np.sort(np.append(base[:-8], rng.integers(1 << 41, 1 << 42, 8))) for _ in range(6)]
    for k in range(3):
        block.add(k, k, near[k])
    block.add(9, 9, np.unique(rng.integers(1 << 43, 1 << 44, 50)))
    got = [(k, b) for k in range(3, 6) for b in block.links(k, k, near[k], 80)]
    assert len(got) == 5 and {x for pair in got for x in pair} == {0, 1, 2, 3, 4, 5}
    assert block.links(20, 20, np.zeros(0, np.int64), 80) == []


def test_joins_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(M, "MOST_BROADCAST", 1)
    monkeypatch.setattr(C, "MOST_BROADCAST", 1)
    rows = near_base(12, 160, 3) + [(50, "a b c"), (51, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs) == components(rows)


def test_odd_rows(spark):
    text = " ".join(f"w{k}" for k in range(50))
    rows = [
        (5, text), (5, text), (5, "other text"), (3, text.upper()), (None, text), (None, "alone here"),
        (6, None), (7, ""), (8, " \n"), (9, "a b"), (10, "a  B"), (11, "a b c"), (12, "v " * 60000),
    ]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    got = M.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    view = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got}
    assert view == {
        (5, 46, 3, False), (5, 1, 5, True), (3, 46, 3, True), (None, 46, 3, False),
        (None, 1, None, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True),
        (9, 1, 9, True), (10, 1, 9, False), (11, 1, 11, True), (12, 1, 12, True),
    }
    assert M.near_duplicates(docs.limit(0)).count() == 0


def test_signatures_agree_as_often_as_sets():
    rng = np.random.default_rng(0)
    pool = np.unique(rng.integers(0, 1 << 64, 8000, dtype=np.uint64))
    for size, share in ((20, 0.9), (400, 0.8), (3000, 0.5)):
        agree, similar = [], []
        for _ in range(30):
            a = np.sort(rng.choice(pool, size, replace=False))
            keep = rng.random(size) < share
            others = rng.choice(np.setdiff1d(pool, a), size - keep.sum(), replace=False)
            b = np.sort(np.concatenate((a[keep], others)))
            one, two = M.signatures([a, b])
            agree.append((one == two).mean())
            similar.append(len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(agree) - np.mean(similar)) < 0.04


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    table = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["comp"] for r in connected_components(table).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)}
    assert connected_components(table.limit(0)).count() == 0


