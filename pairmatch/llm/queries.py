"""Registered queries of this subpackage: each operator on its whole table, and its SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmatch.llm.alignment import link_counts
from pairmatch.llm.collocations import collocations
from pairmatch.llm.decontamination import contamination
from pairmatch.llm.exact_dedup import exact_duplicates
from pairmatch.llm.line_dedup import LineIndex
from pairmatch.llm.minhash import near_duplicates
from pairmatch.llm.mixing import mixed
from pairmatch.llm.ring import ring_shards
from pairmatch.llm.suffix_tree import Settings, fit_suffix_tree, score_texts
from pairmatch.llm.token_counts import prefix_counts
from pairmatch.llm.toxicity import classify, fit_chain
from pairmatch.llm.url_filter import Rule, judge_urls
from pairmatch.llm.warc_archive import read_archive, write_archive
from pairmatch.session import written

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL where SQL can express it."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op1_exact_dedup",
    r"""
    WITH t AS (
        SELECT doc_id, length(coalesce(text, '')) AS points,
               regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
        FROM documents
    ), g AS (
        SELECT doc_id, sha256(norm) AS text_sha256,
               first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size
        FROM t
    )
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
    """,
)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of all documents."""
    groups = exact_duplicates(load(spark, sf_dir, "documents"), digest_all=True)
    return groups.withColumnRenamed("digest", "text_sha256")


@query("op2_ring_shards")
def op2_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards whose row counts differ by one at most."""
    return ring_shards(load(spark, sf_dir, "documents"), 16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query(
    "op3_mix_sources",
    r"""
    WITH sized AS (
        SELECT doc_id, source,
               len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
               substr(md5('17:' || coalesce(doc_id::VARCHAR, text, '')), 1, 15) AS place
        FROM documents
    ), s AS (
        SELECT source, sum(size)::BIGINT AS source_size,
               ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight
        FROM sized GROUP BY source
    ), tested AS (
        SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
               coalesce(sum(3 * source_size) OVER earlier, 0) AS cap_before,
               coalesce(sum(weight) OVER earlier, 0) AS weight_before
        FROM s
        WINDOW earlier AS (ORDER BY source_size / weight, weight, source NULLS LAST
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), marked AS (
        SELECT *, 3 * source_size * (weights - weight_before) < (total - cap_before) * weight AS clamped
        FROM tested
    ), targets AS (
        SELECT source, source_size,
               CASE WHEN clamped THEN (3 * source_size)::DOUBLE ELSE
               (weight * (total - sum(CASE WHEN clamped THEN 3 * source_size ELSE 0 END) OVER ()))::DOUBLE
               / (weights - sum(CASE WHEN clamped THEN weight ELSE 0 END) OVER ())::DOUBLE END AS target
        FROM marked
    ), joined AS (
        SELECT doc_id, size, source_size, target, place, d.source,
               coalesce(floor(target / nullif(source_size, 0)), 0) AS whole
        FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
    ), running AS (
        SELECT *, target - whole * source_size AS quota,
               coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, size
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far
        FROM joined
    )
    SELECT doc_id, size, source_size, target,
           (size * (whole + CASE WHEN so_far + size / 2 <= quota THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM running
    """,
)
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source."""
    return mixed(load(spark, sf_dir, "documents"), carry=["doc_id"]).select(
        "doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("reps")).alias("taken")
    )


#: The rules on which the verdict of a page rests first, and the filter's own for the rest:
#: hosts whose names advertise.
GIVEN_RULES = [
    Rule("net/", "block", 1),
    Rule("example.net/en/", "allow", 1),
    Rule("example.com/de/", "block", 1),
    Rule("org/fr/", "allow", 1),
]
OWN_RULES = [
    Rule("ads-*.example.com/", "block"),
    Rule("adult-*.example.com/", "block"),
    Rule("casino-*.example.com/", "block"),
    Rule("spam-*.example.com/", "block"),
    Rule("cheap-*.example.com/", "block"),
]


@query(
    "op4_url_filter",
    r"""
    WITH p AS (
        SELECT page_id, translate(regexp_extract(url, '^(?s).*?://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h,
               regexp_extract(url, '^(?s).*?://[^/?#]*([^?#]*)', 1) AS q
        FROM pages
    ), u AS (
        SELECT page_id, coalesce(h, '') AS host, coalesce(q, '') AS path FROM p
    ), rules(rh, rp, rv, own) AS (
        VALUES ('net', '/', 'block', 0), ('example.net', '/en/', 'allow', 0),
               ('example.com', '/de/', 'block', 0), ('org', '/fr/', 'allow', 0)
    ), best AS (
        SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule,
               arg_max(rv, length(rh || rp)) AS rv
        FROM u JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
        GROUP BY page_id
    )
    SELECT u.page_id, host, path, rule,
           coalesce(rv, CASE WHEN regexp_matches(host || path,
               '^([^/]*\.)?(ads|adult|casino|spam|cheap)-.*\.example\.com/') THEN 'block'
               ELSE 'allow' END) AS verdict
    FROM u LEFT JOIN best USING (page_id)
    """,
)
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL; only the given rules are named."""
    given = [rule.text for rule in GIVEN_RULES]
    judged = judge_urls(load(spark, sf_dir, "pages"), GIVEN_RULES + OWN_RULES)
    return judged.withColumn("rule", F.when(F.col("rule").isin(given), F.col("rule")))


@query(
    "op7_warc_archive",
    """
    WITH p AS (
        SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
               sha256(coalesce(html, '')) AS payload_digest
        FROM pages
    ), f AS (
        SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
    ), r AS (
        SELECT *, payload_bytes >= 100 AND page_id <> first_id AS again FROM f
    )
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN again THEN first_id END AS refers_to
    FROM r
    """,
)
def op7_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to an archive and read back; figures are those of the rebuilt payloads."""
    archive = write_archive(load(spark, sf_dir, "pages"))
    return read_archive(spark, archive).select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"), "record_type", "refers_to",
    )


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, read from the stored table of their prefixes."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    prefixes = written(prefix_counts(load(spark, sf_dir, "documents"), model), "prefixes")
    whole = F.coalesce(F.try_element_at("counts", F.lit(-1)), F.lit(0)).cast("long")
    return prefixes.select(
        "doc_id", "n_bytes", whole.alias("n_tokens"),
        F.exists("counts", lambda n: n > 4096).alias("over_limit"),
    )


def is_contaminated():
    """Hit words make up a twentieth of the text."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


@query(
    "op9_decontamination",
    r"""
    WITH d AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM documents
    ), b AS (
        SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM benchmark
    ), windows AS (
        SELECT DISTINCT item_id, least(len(w), 13) AS n,
               array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS phrase
        FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i
              FROM b WHERE len(w) > 0)
    ), lengths AS (
        SELECT DISTINCT n FROM windows
    ), found AS (
        SELECT s.doc_id, s.i, s.n, item_id
        FROM (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS phrase
              FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
                    FROM d, lengths WHERE len(w) >= n)) s
        JOIN windows USING (n, phrase)
    ), hit AS (
        SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
    ), items AS (
        SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM found) GROUP BY doc_id
    )
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit,
           coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
)
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents."""
    found = contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


@query("op10_near_duplicates")
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of all documents."""
    return near_duplicates(load(spark, sf_dir, "documents")).drop("h1", "h2")


def held_out():
    """Documents that the language model does not learn from; a null id is one of them."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(name.cast("binary")) % 10 == 0


@query("op5_suffix_tree")
def op5_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a suffix tree learnt from nine tenths of them."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_suffix_tree(docs.where(~held_out()), settings=Settings(depth=3))
    return score_texts(docs, model).select(
        "doc_id", held_out().alias("held_out"), "n_tokens", "n_known",
        F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )


CATEGORIES = ["low_quality", "toxic"]


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts with the categories of their labels."""
    rows = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return docs.select("doc_id", "text").join(rows, "doc_id")


@query("op6_toxicity_chain")
def op6_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    docs = load(spark, sf_dir, "documents")
    chain = fit_chain(labelled_texts(docs, load(spark, sf_dir, "labels")), CATEGORIES)
    return classify(docs.select("doc_id", "text"), chain).select(
        "doc.doc_id", *(f"p_{name}" for name in CATEGORIES), *CATEGORIES
    )


@query(
    "op11_line_dedup",
    r"""
    WITH l AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
        FROM documents
    ), k AS (
        SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
        FROM l
    ), common AS (
        SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
    ), marked AS (
        SELECT k.*, common.key IS NOT NULL AS gone FROM k LEFT JOIN common USING (key)
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
    """,
)
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that ten or more of them share."""
    docs = load(spark, sf_dir, "documents")
    index = LineIndex(spark, min_docs=10).insert(docs)
    return index.drop(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


@query(
    "op12_collocations",
    r"""
    WITH p AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                             'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents
    ), w AS (
        SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
    ), totals AS (
        SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang
    ), grams AS (
        SELECT lang, w[i : i + k - 1] AS g, count(*) AS f
        FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
             (SELECT unnest([1, 2, 3]) AS k)
        WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 10
    ), cuts AS (
        SELECT c.lang, c.g, c.f AS a, x.f AS l, y.f AS r, len(x.g) AS k,
               ((1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f))::BIGINT AS score
        FROM (SELECT *, unnest(range(1, len(g))) AS split FROM grams) c
        JOIN grams x ON x.lang = c.lang AND x.g = c.g[1 : split]
        JOIN grams y ON y.lang = c.lang AND y.g = c.g[split + 1 : len(c.g)]
    ), weakest AS (
        SELECT * FROM cuts
        QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
    ), inner_ones AS (
        SELECT lang, part, max(f) AS f
        FROM (SELECT lang, f, unnest([g[1:2], g[2:3]]) AS part FROM grams WHERE len(g) = 3)
        GROUP BY lang, part
    ), kept AS (
        SELECT w.lang, array_to_string(w.g, ' ') AS phrase, a, l, r, score
        FROM weakest w LEFT JOIN inner_ones i ON i.lang = w.lang AND i.part = w.g
        WHERE NOT coalesce(100 * i.f >= 50 * a, FALSE)
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
        FROM kept
    )
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang)
    WHERE rank <= 2000
    """,
)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest collocations of each language in all documents."""
    return collocations(load(spark, sf_dir, "documents"))


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents by two tokenizers, aligned."""
    models = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return link_counts(load(spark, sf_dir, "documents"), *models).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
