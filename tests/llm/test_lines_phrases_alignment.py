import random
import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import pairmatch.llm.alignment as alignment
import pairmatch.llm.collocations as phrases
import pairmatch.llm.line_dedup as line_dedup
from pairmatch.llm.cuckoo import CuckooFilter, buckets_for
from pairmatch.llm.queries import QUERIES, load

SMALL = "/root/testdata/sf0.001"
# columns with names that the operators use themselves
SCHEMA = "doc_id long, text string, lang string, n int, h1 string, row string, pair long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", "y", 1) for r in rows], SCHEMA)


# lines


@pytest.mark.parametrize("n", [0, 1, 7, 1000, 50000])
def test_cuckoo_filter_holds_what_is_added_and_loses_what_is_removed(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64))
    added, others = keys[: len(keys) // 2], keys[len(keys) // 2 :]
    f = CuckooFilter(buckets_for(len(added)))
    assert f.add(added[::2]) and f.add(added[1::2])
    assert f.has(added).all()
    assert f.has(others).mean() < 0.01 if n > 100 else True
    f.remove(added[: n // 2])
    assert f.has(added[n // 2 :]).all()
    again = CuckooFilter(len(f.table), f.tobytes())
    assert (again.table == f.table).all() and again.has(added[n // 2 :]).all()
    f.remove(added[n // 2 :])
    assert not f.table.any()


def test_cuckoo_filter_says_when_it_is_full():
    assert not CuckooFilter(4).add(np.arange(100, dtype=np.uint64))
    with pytest.raises(ValueError):
        CuckooFilter(4).remove(np.arange(1, dtype=np.uint64))


STRIP = " \t\n\x0b\x0c\r"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def lines_kept(rows, min_docs, least=1):
    keys = [[lower(x).strip(STRIP) for x in (text or "").split("\n")] for _, text, _ in rows]
    n = Counter(k for doc in keys for k in set(doc))
    out = []
    for (doc_id, text, _), doc in zip(rows, keys):
        lines = (text or "").split("\n")
        kept = [x for x, k in zip(lines, doc) if len(k) < least or n[k] < min_docs]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def odd_lines():
    random.seed(3)
    parts = ["Menu", " menu\t", "MENU\x0b", "", "  ", "Ärger", "ärger", "own", "a\rb", "x" * 300]
    rows = [
        (k if k % 5 else None, "\n".join(random.choices([*parts, f"line {k}"], k=k % 9)), "en")
        for k in range(60)
    ]
    rows += rows[:7] + [(1, None, None), (1, "", "en"), (2, "\n", "en"), (3, "menu\n\n", "en")]
    return rows + [(9, "\n".join(["menu", "own " * 50] * 20000), "en")]


def dropped(index, docs):
    rows = index.drop(docs).collect()
    for r in rows:
        assert r["kept_sha256"] == sha256(r["kept"].encode()).hexdigest()
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in rows), key=repr)


@pytest.mark.parametrize("least", [1, 4])
def test_lines_equal_brute_force(spark, least):
    rows = odd_lines()
    docs = frame(spark, rows)
    index = line_dedup.LineIndex(spark, min_docs=4, least=least, shards=5).insert(docs)
    assert dropped(index, docs) == lines_kept(rows, 4, least)


def test_lines_looked_up_without_filters_and_broadcasts(spark, monkeypatch):
    rows = odd_lines()
    docs = frame(spark, rows)
    monkeypatch.setattr(line_dedup, "MOST_SENT", 0)
    monkeypatch.setattr(line_dedup, "MOST_BROADCAST", 0)
    index = line_dedup.LineIndex(spark, min_docs=4, shards=5).insert(docs)
    assert dropped(index, docs) == lines_kept(rows, 4)


def state(index):
    counts = sorted((r["h1"], r["h2"], r["n"]) for r in index.totals().collect())
    shards = {r["shard"]: r for r in index.filters.collect()}
    for r in index.common().collect():  # every common key is in its filter
        f = shards[r["shard"]]
        assert CuckooFilter(f["buckets"], bytes(f["prints"])).has(np.array([r["h1"]]).view(np.uint64)).all()
    held = Counter(r["shard"] for r in index.common().collect())
    assert all(f["held"] == held[k] for k, f in shards.items())
    return counts


def test_documents_can_be_taken_back(spark):
    rows = odd_lines()[:60]
    first, second = frame(spark, rows[:30]), frame(spark, rows[30:])
    index = line_dedup.LineIndex(spark, min_docs=3, shards=3).insert(first)
    both = index.insert(second)
    assert dropped(both, frame(spark, rows)) == lines_kept(rows, 3)
    back = both.delete(second)
    assert state(back) == state(index) and len(back.generations) == 3
    assert dropped(back, first) == dropped(index, first) == lines_kept(rows[:30], 3)
    merged = back.merge()
    assert state(merged) == state(index) and len(merged.generations) == 1
    none = merged.delete(first)
    assert state(none) == [] and none.common().isEmpty()
    assert dropped(none, first) == lines_kept(rows[:30], 10**6)
    with pytest.raises(ValueError):
        none.delete(first)
    with pytest.raises(ValueError):
        line_dedup.LineIndex(spark).delete(first)
    # from nothing to more than the filters were made for
    many = [(k, "\n".join(f"l{j}" for j in range(400)), "en") for k in range(3)]
    grown = none.insert(frame(spark, many))
    assert state(grown) and dropped(grown, frame(spark, many)) == lines_kept(many, 3)


def test_no_lines(spark):
    none = frame(spark, [])
    index = line_dedup.LineIndex(spark).insert(none)
    assert index.drop(none).count() == 0 and index.totals().isEmpty()
    assert index.insert(none).delete(none).drop(none).count() == 0


# phrases


def best_phrases(rows, most_words, least, share, keep):
    f, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lower(text or "")):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, most_words + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = {}
    for lang, counts in f.items():
        found = []
        candidates = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        for g, a in candidates.items():
            cuts = [(10**6 * a * a // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            inside = any(
                100 * b >= share * a
                and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))
                for h, b in candidates.items()
                if len(h) > len(g)
            )
            if not inside:
                phrase = " ".join(g)
                found.append((-score, -a, phrase.encode(), phrase, counts[g[:k]], counts[g[k:]]))
        for rank, (s, a, _, phrase, left, right) in enumerate(sorted(found)[:keep], 1):
            out[lang, rank] = (phrase, -a, left, right, total[lang], -s)
    return out


def as_ranked(df):
    return {
        (r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"])
        for r in df.collect()
    }


def odd_phrases():
    random.seed(5)
    words = ["a", "B", "b\x01", "c", "New", "york", "City", "été", "\x00", "x\x1cy", "'s", "　"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r", "\x0b", "? ", " ! "]
    rows = [
        (k, "".join(random.choice(words) + random.choice(ends) for _ in range(k % 70)),
         ["en", "de", None, "und"][k % 4])
        for k in range(200)
    ]
    rows += [(k, "new york city hall. new york city", "en") for k in range(30)] + rows[:9]
    return rows + [(1, None, "en"), (None, "", None), (None, "...", "fr"), (5, "z y " * 50000, "en")]


@pytest.mark.parametrize(
    "most_words,least,share,keep", [(3, 10, 50, 2000), (2, 3, 50, 9), (4, 4, 80, 25), (3, 1, 10, 50)]
)
def test_phrases_equal_brute_force(spark, monkeypatch, most_words, least, share, keep):
    monkeypatch.setattr(phrases, "CHUNK", 500)
    rows = odd_phrases()
    if least == 1:
        rows = rows[:60]
    got = as_ranked(
        phrases.collocations(
            frame(spark, rows).repartition(3),
            most_words=most_words, least=least, share=share, keep=keep,
        )
    )
    assert got == best_phrases(rows, most_words, least, share, keep)


def test_scores_are_exact_beyond_64_bits():
    a, left, right = 3 * 10**9 + 1, [4 * 10**9 + 7], [5 * 10**9 + 3]
    score = 10**6 * a * a // (left[0] * right[0])
    assert phrases.weakest_cut(a, left, right) == (score, left[0], right[0])
    # equal after flooring: the shorter first part
    assert phrases.weakest_cut(2, [10, 20], [10, 20]) == (20000, 10, 20)


def test_a_word_with_many_phrases_is_dealt_over_tasks(spark):
    rows = [("en", f"the w{k}", k + 1) for k in range(4000)] + [("en", "the", 10**7)]
    rows += [("en", f"w{k}", 10**4) for k in range(4000)]
    counts = spark.createDataFrame(rows, phrases.COUNTS)
    records = counts.select(
        "lang", F.split("phrase", " ").alias("words"), "n",
        F.lit(None).cast("array<long>").alias("firsts"), F.lit(None).cast("long").alias("longer"),
    )
    dealt = phrases.in_order(records).withColumn("part", F.spark_partition_id())
    sizes = [r["count"] for r in dealt.groupBy("part").count().collect()]
    assert max(sizes) <= 0.6 * sum(sizes)
    out = phrases.merged(records, phrases.with_firsts, phrases.RECORD).collect()
    assert Counter(tuple(r["words"][::-1]) for r in out) == Counter(tuple(r[1].split()) for r in rows)
    assert all(r["firsts"] == [10**7] for r in out if len(r["words"]) == 2)
    assert max(r["longer"] for r in out) == 4000


def test_no_phrases(spark):
    assert phrases.collocations(frame(spark, [])).count() == 0
    assert phrases.collocations(frame(spark, [(1, "one two", "en"), (2, None, None)])).count() == 0


# alignment

MODELS = [public_tokenizers.path(m) for m in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


def library():
    plain = Tokenizer.from_file(MODELS[0])
    plain.encode_special_tokens = True
    return plain


def alignments(texts):
    """Per text the ids in groups by two plain encodings, None without tokens."""
    pair, plain = alignment.tokenizer_pair(*MODELS), library()
    a_bytes, b_bytes = pair.a_bytes.to_pylist(), pair.b_bytes.to_pylist()
    out = []
    for text in texts:
        a = plain.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pair.b.encode(text) if text else []
        whole = (" " + text).encode() if text else None
        if b"".join(a_bytes[i] for i in a) != whole or b"".join(b_bytes[i] for i in b) != whole:
            out.append(None)
            continue
        groups, at, used_a, used_b = [([], [])], [0, 0], iter(a), iter(b)
        for i in used_a:
            groups[-1][0].append(i)
            at[0] += len(a_bytes[i])
            while at[1] < at[0]:
                j = next(used_b)
                groups[-1][1].append(j)
                at[1] += len(b_bytes[j])
            if at[0] == at[1]:
                groups.append(([], []))
        out.append((len(a), len(b), groups[:-1]))
    return out


def test_bytes_of_tokens_are_those_of_the_decoder():
    pair, plain = alignment.tokenizer_pair(*MODELS), library()
    for k in range(0, 50257, 97):
        text = plain.decode([k], skip_special_tokens=False)
        assert pair.a_bytes[k].as_py().decode(errors="replace") == text


def test_ranks_give_the_ids_of_the_library_for_every_character():
    pair, plain = alignment.tokenizer_pair(*MODELS), library()
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 500):
        text = "".join(f" a{c}1{c} {c}!" for c in map(chr, points[k : k + 500]))
        assert pair.a.encode_ordinary(text) == plain.encode(text, add_special_tokens=False).ids


def odd_texts():
    random.seed(1)
    parts = [
        "a", "the", "  ", " ", "\n", "\t", "\x0b", "\x1c", "é", "漢字", "🙂", " ", "'s", "123", "!!",
        "<|endoftext|>", "<s>", "</s>", "<0x41>", "\x00", "́", "ß", "  \n ", "▁", "ing", "\r\n",
        "　", "\x85", " ",
    ]
    return ["".join(random.choices(parts, k=random.randint(1, 25))) for _ in range(1500)]


def test_alignment_equals_plain_encodings(spark, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK", 5000)
    texts = odd_texts()
    texts += [r["text"] for r in load(spark, SMALL, "documents").collect()]
    texts += texts[:5] + ["word " * 40000, "x" * 3000, None, "", None, " ", "\n"]
    rows = [(k if k % 9 else None, text, "en") for k, text in enumerate(texts)]
    wanted = alignments(texts)
    counts = Counter((a[-1], b[-1]) for w in wanted if w for a, b in w[2])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    want = []
    for (doc_id, *_), w in zip(rows, wanted):
        if w is None:
            want.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in w[2])
        ns = [(counts[a[-1], b[-1]], most[b[-1]]) for a, b in w[2]]
        want.append((doc_id, w[0], w[1], len(ns), len(ns), sum(n == m for n, m in ns),
                     sum(n for n, _ in ns), sha256(text.encode()).hexdigest()))
    docs = frame(spark, rows).repartition(3)
    for limit in (alignment.MOST_BROADCAST, 0):  # 0: joined with salts
        got = alignment.link_counts(docs, *MODELS, most=limit).drop("pairs", "times").collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    groups = alignment.aligned(frame(spark, [(1, "the word", "en")]), *MODELS, keep_groups=True)
    (a, b, parts), = alignments(["the word"])
    assert groups.first()["groups"] == ";".join(
        f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in parts
    )


def test_no_tokens(spark):
    assert alignment.link_counts(frame(spark, []), *MODELS).count() == 0
    got = alignment.link_counts(frame(spark, [(1, None, None), (1, "", "en")]), *MODELS).collect()
    assert [(r["n_a"], r["n_links"], r["count_sum"], r["groups_sha256"]) for r in got] == [(0, 0, 0, "")] * 2


def test_query_of_the_alignment_reads_all_documents(spark):
    got = QUERIES["op13_token_alignment"](spark, SMALL)
    assert got.count() == load(spark, SMALL, "documents").count()
    assert {t for c, t in got.dtypes if c.startswith(("n_", "count"))} == {"bigint"}
