import random
import re

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from pairmatch.llm.queries import GIVEN_RULES, OWN_RULES, load
from pairmatch.llm.token_counts import PrefixCounter, prefix_counts
from pairmatch.llm.url_filter import Rule, judge_urls
from pairmatch.llm.warc_archive import read_archive, write_archive

SMALL = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")

URLS = [
    "https://Example.NET/en/1?x=/de/", "http://a.example.net/en/", "http://net/x", "http://net",
    "http://notexample.com/de/", "http://example.com/de/q#f", "http://www.example.com/De/",
    "ftp://a.b.org/fr/x/en/", "mailto:x@net/", "", None, "http://x.net?a=://y.org/fr/",
    "http://ads-track.example.com/", "http://m.adult-x.example.com/en/1", "http://h.org\n/fr/x",
    "://example.net/en/é", "http://example.net/en", "http://free.org/fr/",
]


def judged(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = re.split(r"[?#]", url.split("://", 1)[1])[0]
        host, _, tail = rest.partition("/")
        path = rest[len(host) :]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for rule in rules:
        if re.match(rule.expression(), host + path):
            best = max(best or (-1,), (rule.rank, len(rule.text), rule.text, rule.verdict))
    return host, path, best and best[2], best[3] if best else "allow"


def test_every_rule_on_every_url_gives_the_same_verdicts(spark):
    rules = [*GIVEN_RULES, *OWN_RULES, Rule("free*", "block"), Rule("h.org*x", "block", 2)]
    rows = [(k, u, 1, "y") for k, u in enumerate(URLS * 3)] + [(None, URLS[0], 1, "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rank int, rule string")
    got = judge_urls(pages, rules).collect()
    assert len(got) == len(rows)
    want = {(r[0], *judged(r[1], rules)) for r in rows}
    assert {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got} == want
    assert judge_urls(pages.limit(0), rules).count() == 0


def test_tokens_of_rules():
    assert Rule("example.net/en/", "x").tokens() == ["en", "example", "net"]
    assert Rule("ads-*.x.com/a", "x").tokens() == ["ads", "com", "x"]
    assert Rule("free*", "x").tokens() == []


def test_archive_gives_back_every_record(spark):
    big = "<p>é</p>" * 40
    rows = [
        (4, "http://a/\r\nx", big), (2, "http://b/", big), (2, "http://b/", big), (9, None, big),
        (None, "http://c/", big), (1, "http://d/", "short"), (3, "http://e/", "short"),
        (5, "http://f/", None), (6, "http://g/", ""), (7, "u", "WARC/1.1\r\n\r\n" + "y" * 200),
    ]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    archive = write_archive(pages)
    assert spark.read.parquet(archive.payloads).count() == 4
    got = read_archive(spark, archive).collect()
    assert len(got) == len(rows)
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got if len(r["payload"]) == len(big.encode()))
    assert kinds == [(0, "revisit", 2), (2, "response", None), (2, "revisit", 2), (4, "revisit", 2), (9, "revisit", 2)] or kinds[1:3] == [(2, "response", None), (2, "revisit", 2)]
    for r in got:
        head, block = r["header"].encode(), bytes(r["payload"])
        body = b"" if r["record_type"] == "revisit" else block
        assert bytes(r["record"]) == head + body + b"\r\n\r\n"
        length = int(re.search(r"Content-Length: (\d+)", r["header"])[1])
        assert length == len(body)
    texts = {(r[0], (r[2] or "").encode()) for r in rows}
    assert {(r["page_id"], bytes(r["payload"])) for r in got} == texts
    assert all(r["record_type"] == "response" for r in got if r["payload_bytes"] < 100)
    assert len({re.search(r"Record-ID: <(.*?)>", r["header"])[1] for r in got}) == len(rows)
    none = read_archive(spark, write_archive(pages.limit(0)))
    assert none.count() == 0


def test_a_changed_payload_fails_the_read(spark):
    pages = load(spark, SMALL, "pages").limit(5)
    archive = write_archive(pages)
    broken = spark.read.parquet(archive.payloads).withColumn("payload", F.lit(b"other"))
    rows = broken.collect()
    schema = "digest string, payload binary"
    spark.createDataFrame([(r["digest"], bytes(r["payload"])) for r in rows], schema).write.mode("overwrite").parquet(archive.payloads)
    with pytest.raises(Exception, match="without its digest"):
        read_archive(spark, archive).select("payload_bytes").collect()


def texts(seed=5):
    rng = random.Random(seed)
    parts = ["the", " ", "  ", "   ", "\n", "\n\n", "\t", "é", "▁", "Ａ", "x", "ing", ".", "</s>", "\r\n", "日本", "😀", "a b", "  \n "]
    return ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(150)]


def test_every_prefix_equals_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    counter = PrefixCounter(MODEL)
    for text in texts():
        want = [len(library.encode(text[:k])) for k in range(len(text) + 1)]
        assert [counter.at(text, k) for k in range(len(text) + 1)] == want, text
        assert counter.total(text) == want[-1]
        for budget in range(want[-1] + 2):
            longest = max(k for k, n in enumerate(want) if n <= budget)
            assert counter.cut(text, budget) == longest, (text, budget)


def test_counts_of_documents(spark):
    docs = load(spark, SMALL, "documents").select("doc_id", "text", F.lit(1).alias("counts"))
    rows = [(None, None, 1), (-1, "", 1), (-1, "a b", 1), (-2, "x " * 40000, 1)]
    docs = docs.union(spark.createDataFrame(rows, docs.schema))
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = sorted(
        (r["doc_id"] or 0, len((r["text"] or "").encode()), len(library.encode(r["text"] or "")))
        for r in docs.collect()
    )
    got = prefix_counts(docs, MODEL, budget=10).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in got) == want
    for r in got:
        assert (r["counts"][-1] if r["counts"] else 0) == r["n_tokens"]
    plain = prefix_counts(docs, MODEL, prefixes=False).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in plain) == want
    assert prefix_counts(docs.limit(0), MODEL).count() == 0
