from bisect import bisect_left
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairmatch.llm.exact_dedup import exact_duplicates
from pairmatch.llm.mixing import mixed, water_fill
from pairmatch.llm.queries import load
from pairmatch.llm.ring import bounded_loads, capacities, ring_marks, ring_shards

SMALL = "/root/testdata/sf0.001"
# two columns whose names the operators use themselves
SCHEMA = "doc_id long, text string, source string, kept int, row string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)


ROWS = [
    (1, "a b", "s"), (2, " a\tb\n", "s"), (3, "a  b ", "s"), (3, "a  b ", "s"), (4, None, "t"),
    (5, "", None), (6, " \x0b\x0c\r", None), (None, "ab", "s"), (7, "a b", "s"),
    (8, "z" * 70 + "1", "s"), (9, "z" * 70 + "2", "s"), (10, "solo", "t"),
    (11, "long " * 30000, "t"),
]


@pytest.mark.parametrize("digest_all", [True, False])
def test_exact_duplicates(spark, digest_all):
    got = exact_duplicates(frame(spark, ROWS), digest_all=digest_all).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["keep_id"], r["group_size"], r["kept"]))
    # the most code points are 5 in "a b" with spaces around, 2 and 3; 2 is the smaller id
    assert by[1] == [(2, 5, False)] and by[2] == [(2, 5, True)]
    assert by[3] == [(2, 5, False)] * 2 and by[None] == [(2, 5, False)]
    assert by[6] == [(6, 3, True)] and by[4] == by[5] == [(6, 3, False)]
    for alone in (7, 8, 9, 10, 11):
        assert by[alone] == [(alone, 1, True)]


def test_one_of_rows_that_agree_in_all_stays(spark):
    got = exact_duplicates(frame(spark, [(1, "x y", "s")] * 4)).collect()
    assert sorted(r["kept"] for r in got) == [False, False, False, True]


@pytest.mark.parametrize("digest_all", [True, False])
def test_no_documents(spark, digest_all):
    none = frame(spark, [])
    assert exact_duplicates(none, digest_all=digest_all).count() == 0
    assert ring_shards(none).count() == 0
    assert mixed(none).count() == 0


def test_ring_equals_one_row_after_the_other(spark):
    docs = load(spark, SMALL, "documents").union(load(spark, SMALL, "documents").limit(20))
    got = ring_shards(docs, 7, vnodes=32).collect()
    n = len(got)
    assert n == docs.count()
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for shard, size in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(size))
    marks, room = ring_marks(7, 32), capacities(n, 7)
    text = F.coalesce("text", F.lit(""))
    places = docs.select("doc_id", F.xxhash64("doc_id", text).alias("h")).collect()
    want = []
    for row in sorted(places, key=lambda r: r["h"] & (1 << 64) - 1):
        node = bisect_left([c for c, _ in marks], (row["h"] & (1 << 64) - 1) >> 48)
        while not room[marks[node % len(marks)][1]]:
            node += 1
        shard = marks[node % len(marks)][1]
        room[shard] -= 1
        want.append((row["doc_id"], shard))
    # rows of one cell share a place in the order of signed hashes, the same within a cell
    assert Counter((r["doc_id"], r["shard"]) for r in got) == Counter(want)


def test_most_rows_stay_when_a_shard_is_added(spark):
    docs = load(spark, SMALL, "documents")
    before = {r["doc_id"]: r["shard"] for r in ring_shards(docs, 8, slack=0.1).collect()}
    after = {r["doc_id"]: r["shard"] for r in ring_shards(docs, 9, slack=0.1).collect()}
    moved = sum(before[k] != after[k] for k in before)
    assert moved <= 0.3 * len(before)  # a fresh placement would move 8 of 9


def test_bounded_loads_keep_to_the_room():
    counts = {5: 40, 900: 3, 65535: 10}
    pieces = bounded_loads(counts, ring_marks(4, 8), [14, 13, 13, 13])
    assert sum(stop - start for _, start, stop, _, _ in pieces) == 53
    taken = Counter()
    for _, start, stop, shard, slot in pieces:
        assert slot == taken[shard]
        taken[shard] += stop - start
    assert taken == {0: 14, 1: 13, 2: 13, 3: 13}


def filled(sizes, weights, most):
    clamped = set()
    while True:
        left = sum(sizes) - sum(most * sizes[k] for k in clamped)
        by = sum(w for k, w in enumerate(weights) if k not in clamped)
        targets = [
            most * s if k in clamped else w * left / by
            for k, (s, w) in enumerate(zip(sizes, weights))
        ]
        over = {k for k, t in enumerate(targets) if t > most * sizes[k]}
        if not over:
            return targets
        clamped |= over


@pytest.mark.parametrize("sizes", [[10, 1, 1000, 0, 50], [5], [1, 1, 1, 1], [0, 0, 0], [900, 2, 3]])
def test_water_fill_equals_the_iteration(spark, sizes):
    weights = [k % 3 + 1 for k in range(len(sizes))]
    rows = [(f"s{k}", s, w) for k, (s, w) in enumerate(zip(sizes, weights))]
    table = spark.createDataFrame(rows, "key string, source_size long, weight long")
    got = {r["key"]: r["target"] for r in water_fill(table).collect()}
    for k, want in enumerate(filled(sizes, weights, 3)):
        assert got[f"s{k}"] == pytest.approx(want)


def test_mix_takes_whole_rows_near_the_targets(spark):
    rows = [(k, "w " * (k % 17 + 1), "abc"[k % 3] if k % 50 else None) for k in range(600)]
    docs = frame(spark, rows + [(None, "n n", "a"), (None, None, "b"), (5, "", "c")])
    got = mixed(docs).collect()
    assert len(got) == docs.count() and all(0 <= r["reps"] <= 3 for r in got)
    by = {}
    for r in got:
        by.setdefault(r["doc"]["source"], []).append(r)
    for group in by.values():
        taken = sum(r["size"] * r["reps"] for r in group)
        assert abs(taken - group[0]["target"]) <= 17 / 2 + 1
        assert group[0]["source_size"] == sum(r["size"] for r in group)
    again = mixed(docs.repartition(3)).collect()
    def key(r):
        return (str(r["doc"]), r["reps"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    # many sources: the table is joined with salts, with the same result
    plan = {(str(r["doc"]), r["reps"]) for r in got}
    assert {(str(r["doc"]), r["reps"]) for r in mixed(docs, most=2).collect()} == plan


def test_rows_without_words_are_not_taken_beyond_the_epochs(spark):
    rows = [(k, "w", "a") for k in range(3)] + [(10 + k, " ", "a") for k in range(12)]
    rows += [(100 + k, "w " * 40, "b") for k in range(5)] + [(200, "w " * 30000, "b")]
    got = {r["doc"]["doc_id"]: (r["reps"], r["target"]) for r in mixed(frame(spark, rows)).collect()}
    # source a is clamped at three times its three words
    assert all(got[k] == (3, 9.0) for k in [*range(3), *range(10, 22)])
    assert sum(got[k][0] for k in got if k >= 100) > 0
    # no words at all: nothing is taken
    none = mixed(frame(spark, [(1, "", "a"), (2, None, None)])).collect()
    assert [r["reps"] for r in none] == [0, 0]
