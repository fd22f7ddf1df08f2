"""Building blocks of the check SQL: named common table expressions in DuckDB's dialect."""

from __future__ import annotations

from pairmatch.functions import stem as S
from pairmatch.functions.text import NORMALIZE_RULES, PUNCTUATION
from pairmatch.functions.words import ALLOWED_NUMBERS, STOP_WORDS, effective_stop_words


def quoted(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def listed(words) -> str:
    """SQL list of string literals."""
    return ", ".join(quoted(w) for w in words)


STOP_SQL = listed(STOP_WORDS)
REDUCED_SQL = listed(effective_stop_words())
NUMBERS_SQL = listed(ALLOWED_NUMBERS)


def replaced(expr: str, pattern: str, new: str) -> str:
    """Replace all matches."""
    return f"regexp_replace({expr}, {quoted(pattern)}, {quoted(new)}, 'g')"


def normalized(expr: str) -> str:
    """Rewrite chain over lower-cased text."""
    out = f"lower({expr})"
    for pattern, new in NORMALIZE_RULES:
        out = replaced(out, pattern, new)
    return out


def without_punct(expr: str) -> str:
    """Punctuation deleted, lower case."""
    return f"lower({replaced(expr, PUNCTUATION, '')})"


def thousands(expr: str) -> str:
    """10k written out."""
    return replaced(expr, r"(?i)([0-9]+)\s{0,2}k\b", r"\1000")


def cleaned(expr: str) -> str:
    """Whole cleaning chain."""
    return thousands(without_punct(normalized(expr)))


def parts(expr: str) -> str:
    """White-space tokens."""
    return f"list_filter(string_split_regex({expr}, '\\s+'), lambda w: w <> '')"


def tokens(expr: str) -> str:
    """White-space tokens with fused words taken apart."""
    for a, b in [("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"),
                 ("wan", "na")]:
        expr = replaced(expr, rf"\b({a})({b})\b", r"\1 \2")
    return parts(expr)


def content(expr: str) -> str:
    """Distinct tokens off the reduced stop list."""
    return (
        f"list_distinct(list_filter({parts(f'lower({expr})')}, "
        f"lambda w: w NOT IN ({REDUCED_SQL})))"
    )


def share(a: str, b: str) -> str:
    """Overlap of two lists of distinct tokens."""
    return (
        f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE "
        f"round_even(2 * len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b})), 5) END"
    )


def numbers_kept(expr: str) -> str:
    """Listed numbers and words off the full stop list."""
    return (
        f"list_filter({expr}, lambda w: CASE WHEN regexp_matches(w, '^[0-9]+$') "
        f"THEN w IN ({NUMBERS_SQL}) ELSE w NOT IN ({STOP_SQL}) END)"
    )


def _map(pairs: dict[str, str], key: str) -> str:
    whens = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in pairs.items())
    return f"CASE {key} {whens} END"


def _ending(word: str, suffixes) -> str:
    return f"regexp_extract({word}, {quoted('(?:' + '|'.join(suffixes) + ')$')}, 0)"


_SHORT = quoted(S.SHORT_SYLLABLE)
_REGION = quoted(S.REGION)


def _region(word: str) -> str:
    found = f"length(regexp_extract({word}, {_REGION}, 0))"
    return f"CASE WHEN {found} > 0 THEN {found} ELSE length({word}) END"


def _step(source: str, expr: str, suffixes=None) -> str:
    if suffixes:
        source = f"(SELECT *, {_ending('w', suffixes)} AS s FROM {source})"
        return f"SELECT word, {expr} AS w, r1, r2 FROM {source}"
    return f"SELECT word, {expr} AS w, r1, r2 FROM {source}"


_START = replaced(
    replaced(replaced(replaced("word", "^'+", ""), "(?:'s'|'s|')$", ""), "^y", "Y"),
    "([aeiouy])y", r"\1Y",
)

# vocabulary(word) must be given by the query; the steps follow the published suffix rules
STEM_STEPS = {
    "stem0": f"SELECT word, {_START} AS w FROM vocabulary",
    "stem1": f"""SELECT word, w, CASE WHEN regexp_matches(w, '^(gener|commun|arsen)')
        THEN length(regexp_extract(w, '^(gener|commun|arsen)', 0)) ELSE {_region('w')} END AS r1
        FROM stem0""",
    "stem2": f"SELECT word, w, r1, r1 + {_region('substr(w, r1 + 1)')} AS r2 FROM stem1",
    "stem3": _step("stem2", """CASE
        WHEN regexp_matches(w, 'sses$') THEN left(w, length(w) - 2)
        WHEN regexp_matches(w, 'ie[ds]$') AND length(w) > 4 THEN left(w, length(w) - 2)
        WHEN regexp_matches(w, 'ie[ds]$') THEN left(w, length(w) - 1)
        WHEN regexp_matches(w, '(us|ss)$') THEN w
        WHEN regexp_matches(w, '[aeiouy].+s$') THEN left(w, length(w) - 1)
        ELSE w END"""),
    "stem4": f"""SELECT *, {_ending('w', ['eedly', 'ingly', 'edly', 'eed', 'ing', 'ed'])} AS s
        FROM stem3""",
    "stem5": "SELECT *, left(w, length(w) - length(s)) AS c FROM stem4",
    "stem6": f"""SELECT word, r1, r2, CASE
        WHEN s IN ('eed', 'eedly') THEN CASE WHEN length(c) >= r1 THEN c || 'ee' ELSE w END
        WHEN s = '' OR NOT regexp_matches(c, '[aeiouy]') THEN w
        WHEN regexp_matches(c, '(at|bl|iz)$') THEN c || 'e'
        WHEN regexp_matches(c, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(c, length(c) - 1)
        WHEN r1 >= length(c) AND regexp_matches(c, {_SHORT}) THEN c || 'e'
        ELSE c END AS w FROM stem5""",
    "stem7": _step("stem6", "regexp_replace(w, '^(.+[^aeiouy])[yY]$', '\\1i')"),
    "stem8": _step("stem7", f"""CASE WHEN s <> '' AND length(w) - length(s) >= r1
        AND (s <> 'ogi' OR w LIKE '%logi') AND (s <> 'li' OR regexp_matches(w, '[cdeghkmnrt]li$'))
        THEN left(w, length(w) - length(s)) || {_map(S.STEP_2, 's')} ELSE w END""", S.STEP_2),
    "stem9": _step("stem8", f"""CASE WHEN s <> '' AND length(w) - length(s) >= r1
        AND (s <> 'ative' OR length(w) - length(s) >= r2)
        THEN left(w, length(w) - length(s)) || {_map(S.STEP_3, 's')} ELSE w END""", S.STEP_3),
    "stem10": _step("stem9", """CASE WHEN s <> '' AND length(w) - length(s) >= r2
        AND (s <> 'ion' OR regexp_matches(w, '[st]ion$'))
        THEN left(w, length(w) - length(s)) ELSE w END""", S.STEP_4),
    "stem11": _step("stem10", f"""CASE
        WHEN w LIKE '%e' AND (length(w) - 1 >= r2 OR (length(w) - 1 >= r1
            AND NOT regexp_matches(left(w, length(w) - 1), {_SHORT}))) THEN left(w, length(w) - 1)
        WHEN w LIKE '%ll' AND length(w) - 1 >= r2 THEN left(w, length(w) - 1)
        ELSE w END"""),
    "stems": f"""SELECT word, CASE WHEN word IN ({STOP_SQL}) OR length(word) <= 2 THEN word
        WHEN word IN ({listed(S.SPECIAL)}) THEN {_map(S.SPECIAL, 'word')}
        ELSE lower(w) END AS stem FROM stem11""",
}

_POS = "(((2 * (k // 28) * (L - 1) + 27) // 54) * L + ((2 * (k % 28) * (L - 1) + 27) // 54)) % n"

BLOCKS: dict[str, tuple[list[str], str]] = {
    "pairs": ([], """
        SELECT a.doc_id AS id, a.doc_id AS qid1, b.doc_id AS qid2, a.text AS question1,
               b.text AS question2, l.quality AS is_duplicate,
               CASE WHEN l.quality IS NULL THEN 'TS' ELSE 'TR' END AS type
        FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1
        LEFT JOIN labels l ON l.doc_id = a.doc_id"""),
    "trained": (["basic"], "SELECT * FROM basic WHERE type = 'TR'"),
    "cleaned": (["pairs"], f"""
        SELECT id, qid1, qid2, is_duplicate, type, {cleaned('question1')} AS q1nopunct,
               {cleaned('question2')} AS q2nopunct FROM pairs"""),
    "basic": (["cleaned"], f"""
        SELECT *, len(string_split(q1nopunct, ' ')) AS tr_q1WrdCnt,
               len(string_split(q2nopunct, ' ')) AS tr_q2WrdCnt,
               length(q1nopunct) AS tr_q1Len, length(q2nopunct) AS tr_q2Len,
               {share('c1', 'c2')} AS wrdmatchpct
        FROM (SELECT *, {content('q1nopunct')} AS c1, {content('q2nopunct')} AS c2 FROM cleaned)"""),
    "token_pairs": (["cleaned"], f"""
        SELECT id, {tokens('q1nopunct')} AS t1, {tokens('q2nopunct')} AS t2 FROM cleaned"""),
    "docs": (["token_pairs"], """
        SELECT id, 1 AS side, t1 AS tokens FROM token_pairs
        UNION ALL SELECT id, 2, t2 FROM token_pairs"""),
    "doc_tokens": ([], f"""
        SELECT doc_id, {tokens(cleaned('text'))} AS tokens FROM documents"""),
    "turns": ([], """
        SELECT a.conv_id, a.turn, a.text AS question1, b.text AS question2 FROM conversations a
        LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1"""),
    "scored": ([], """
        SELECT d.doc_id AS id, l.toxic AS y, n_chars::DOUBLE / (n_chars::DOUBLE + 2000) AS p
        FROM documents d JOIN labels l ON l.doc_id = d.doc_id"""),
    "pair_scores": ([], """
        SELECT d.doc_id AS id, 'TR' AS type, n_chars::DOUBLE / (n_chars::DOUBLE + 3000) AS sem_similarity,
               1000 / (n_chars::DOUBLE + 1000) AS word_order_similarity
        FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.toxic = 0"""),
    # tf-idf
    "vocabulary": (["docs"], """
        SELECT DISTINCT unnest(tokens) AS word FROM docs"""),
    "doc_rows": (["docs"], """
        SELECT id, side, unnest(tokens) AS word, generate_subscripts(tokens, 1) AS pos FROM docs"""),
    "doc_stems": (["doc_rows", "stems"], """
        SELECT id, side, pos, stem FROM doc_rows JOIN stems USING (word)"""),
    "kept": (["doc_stems"], f"""
        SELECT id, side, stem, row_number() OVER (PARTITION BY id, side ORDER BY pos) AS pos
        FROM doc_stems WHERE stem NOT IN ({STOP_SQL})"""),
    "term_rows": (["kept"], """
        SELECT id, side, stem AS term FROM kept UNION ALL
        SELECT a.id, a.side, a.stem || ' ' || b.stem FROM kept a
        JOIN kept b ON b.id = a.id AND b.side = a.side AND b.pos = a.pos + 1"""),
    "tf": (["term_rows"], """
        SELECT id, side, term, count(*) AS tf FROM term_rows GROUP BY ALL"""),
    "df": (["tf"], "SELECT term, count(*) AS df FROM tf GROUP BY term"),
    "weights": (["tf", "df", "docs"], """
        SELECT id, side, term, w / sqrt(sum(w * w) OVER (PARTITION BY id, side)) AS weight FROM (
            SELECT id, side, term, tf * (ln((1 + (SELECT count(*) FROM docs)) / (1.0 + df)) + 1) AS w
            FROM tf JOIN df USING (term))"""),
    "tfidf": (["weights"], """
        SELECT id, coalesce(sum(weight) FILTER (side = 1), 0) AS weight_q1_sw,
               coalesce(sum(weight) FILTER (side = 2), 0) AS weight_q2_sw,
               coalesce(avg(weight) FILTER (side = 1), 0) AS weight_q1_mw,
               coalesce(avg(weight) FILTER (side = 2), 0) AS weight_q2_mw
        FROM weights GROUP BY id"""),
    # similarity grid
    "shaped": (["token_pairs"], """
        SELECT *, ceil(sqrt(n))::BIGINT AS L FROM (
            SELECT id, len(t1)::BIGINT AS n1, len(t2)::BIGINT AS n2,
                   greatest(1, len(t1) * len(t2))::BIGINT AS n FROM token_pairs)"""),
    "words1": (["token_pairs"], """
        SELECT id, generate_subscripts(t1, 1) - 1 AS i, unnest(t1) AS w1 FROM token_pairs"""),
    "words2": (["token_pairs"], """
        SELECT id, generate_subscripts(t2, 1) - 1 AS j, unnest(t2) AS w2 FROM token_pairs"""),
    "positions": (["shaped"], f"""
        SELECT id, k, n, pos // nullif(n2, 0) AS i, pos % nullif(n2, 0) AS j FROM (
            SELECT *, {_POS} AS pos FROM shaped, (SELECT range AS k FROM range(784)))"""),
    "cells": (["positions", "words1", "words2"], """
        SELECT id, k, CASE WHEN w2 IS NOT NULL THEN w1 END AS w1, CASE WHEN w1 IS NOT NULL THEN w2 END AS w2
        FROM positions LEFT JOIN words1 USING (id, i) LEFT JOIN words2 USING (id, j)"""),
    "grid_words": (["token_pairs"], """
        SELECT DISTINCT word FROM (SELECT unnest(t1) AS word FROM token_pairs
                                   UNION ALL SELECT unnest(t2) FROM token_pairs)"""),
    "vectors": (["grid_words"], """
        SELECT word, embedding::DOUBLE[] AS vector FROM grid_words JOIN embeddings ON vec_id =
            ('0x' || substr(md5(word), 1, 7))::BIGINT % (SELECT count(*) FROM embeddings)
        WHERE substr(md5(word), 8, 1) <> '0'"""),
    "word_scores": (["cells", "vectors"], """
        SELECT p.a, p.b, round_even(list_dot_product(x.vector, y.vector)
               / (sqrt(list_dot_product(x.vector, x.vector)) * sqrt(list_dot_product(y.vector, y.vector))), 5) AS sim
        FROM (SELECT DISTINCT least(w1, w2) AS a, greatest(w1, w2) AS b FROM cells WHERE w1 IS NOT NULL) p
        JOIN vectors x ON x.word = p.a JOIN vectors y ON y.word = p.b"""),
    "grid": (["cells", "word_scores"], """
        SELECT c.id, c.k, round_even(coalesce(s.sim, 0)::FLOAT::DOUBLE, 5) AS v FROM cells c
        LEFT JOIN word_scores s ON s.a = least(c.w1, c.w2) AND s.b = greatest(c.w1, c.w2)"""),
    # taxonomy
    "brand_senses": ([], """
        SELECT DISTINCT lower(replace(p_brand, '#', '')) AS word, 'brand:' || p_type || ':' || p_brand AS synset,
               'type:' || p_type AS parent FROM part"""),
    "nodes": (["brand_senses"], """
        SELECT lower(r_name) AS word, 'region:' || r_regionkey AS synset, 'entity' AS parent FROM region
        UNION ALL SELECT lower(n_name), 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation
        UNION ALL SELECT lower(replace(s_name, '#', '')), 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier
        UNION ALL SELECT DISTINCT lower(p_type), 'type:' || p_type, 'part' FROM part
        UNION ALL SELECT * FROM brand_senses"""),
    "edge": (["nodes"], """
        SELECT synset AS child, parent FROM nodes UNION SELECT 'part', 'entity'"""),
    "lemma": (["nodes"], """
        SELECT word, synset, row_number() OVER (PARTITION BY word ORDER BY synset) AS sense_no FROM nodes"""),
    "up": (["edge"], """
        SELECT synset, synset AS ancestor, 0 AS d FROM (SELECT child AS synset FROM edge UNION SELECT parent FROM edge)
        UNION SELECT up.synset, edge.parent, up.d + 1 FROM up JOIN edge ON edge.child = up.ancestor"""),
    "closure": (["up"], """
        SELECT synset, ancestor, min(d) AS dmin, max(d) AS dmax FROM up GROUP BY ALL"""),
    "depth": (["closure"], """
        SELECT c.synset, max(c.dmax) AS deepest, min(c.dmin) FILTER (c.ancestor = 'entity') AS shallow
        FROM closure c GROUP BY c.synset"""),
    "order_texts": ([], """
        SELECT l_orderkey, string_agg(phrase, ' ' ORDER BY l_linenumber, phrase) AS text FROM (
            SELECT l_orderkey, l_linenumber, lower(replace(p_brand, '#', '')) || ' ' || lower(p_type)
                   || ' from ' || lower(n_name) AS phrase
            FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
            JOIN nation ON n_nationkey = s_nationkey) GROUP BY l_orderkey"""),
    "sentences": (["order_texts"], f"""
        SELECT a.l_orderkey AS id, {tokens('a.text')} AS t1, {tokens('b.text')} AS t2
        FROM order_texts a JOIN order_texts b ON b.l_orderkey = a.l_orderkey + 1"""),
    "content_sentences": (["sentences"], f"""
        SELECT id, {numbers_kept('t1')} AS t1, {numbers_kept('t2')} AS t2 FROM sentences"""),
    "wanted": (["content_sentences", "lemma"], """
        SELECT DISTINCT id, w1, w2 FROM (
            SELECT id, w1, unnest(have) AS w2 FROM (
                SELECT id, unnest(list_filter(t2, lambda w: NOT list_contains(t1, w))) AS w1, t1 AS have FROM content_sentences
                UNION ALL
                SELECT id, unnest(list_filter(t1, lambda w: NOT list_contains(t2, w))), t2 FROM content_sentences))
        WHERE w1 IN (SELECT word FROM lemma) AND w2 IN (SELECT word FROM lemma)"""),
    "wanted_order": (["sentences", "lemma"], f"""
        SELECT DISTINCT id, w1, w2 FROM (
            SELECT id, w1, unnest(have) AS w2 FROM (
                SELECT id, unnest(list_filter(t2, lambda w: NOT list_contains(t1, w))) AS w1, t1 AS have FROM sentences
                UNION ALL
                SELECT id, unnest(list_filter(t1, lambda w: NOT list_contains(t2, w))), t2 FROM sentences))
        WHERE w1 IN (SELECT word FROM lemma) AND w2 IN (SELECT word FROM lemma) AND w1 NOT IN ({REDUCED_SQL})"""),
    "word_pairs": (["wanted"], "SELECT DISTINCT w1, w2 FROM wanted"),
    "senses": (["word_pairs", "lemma"], """
        SELECT w1, w2, a.synset AS s1, b.synset AS s2, a.sense_no AS n1, b.sense_no AS n2
        FROM word_pairs JOIN lemma a ON a.word = w1 JOIN lemma b ON b.word = w2"""),
    "common": (["senses", "closure", "depth"], """
        SELECT p.s1, p.s2, x.ancestor, x.dmin AS d1, y.dmin AS d2, deepest, shallow
        FROM (SELECT DISTINCT s1, s2 FROM senses) p
        JOIN closure x ON x.synset = p.s1 JOIN closure y ON y.synset = p.s2 AND y.ancestor = x.ancestor
        JOIN depth ON depth.synset = x.ancestor"""),
    "synset_scores": (["common", "lemma", "depth"], """
        SELECT c.s1, c.s2, c.wup,
               CASE WHEN c.s1 = c.s2 THEN 0
                    WHEN EXISTS (SELECT 1 FROM lemma x JOIN lemma y USING (word) WHERE x.synset = c.s1 AND y.synset = c.s2) THEN 1
                    ELSE c.path END AS path,
               CASE WHEN c.s1 = c.s2 THEN depth.deepest ELSE c.height END AS height
        FROM (SELECT s1, s2, arg_max(2.0 * (deepest + 1) / (d1 + d2 + 2.0 * (deepest + 1)), shallow) AS wup,
                     min(d1 + d2) AS path, max(greatest(d1, d2)) AS height FROM common GROUP BY ALL) c
        JOIN depth ON depth.synset = c.s1"""),
    "best_pairs": (["senses", "synset_scores"], """
        SELECT w1, w2, s1, s2, wup, path, height FROM (
            SELECT *, row_number() OVER (PARTITION BY w1, w2 ORDER BY wup DESC, n1, n2) AS rn
            FROM senses JOIN synset_scores USING (s1, s2)) WHERE rn = 1"""),
    "word_sim": (["best_pairs"], """
        SELECT w1, w2, exp(-0.2 * path) * tanh(0.45 * height) AS sim FROM best_pairs"""),
    "best_match": (["wanted", "word_sim"], """
        SELECT id, w1, w2, sim FROM (
            SELECT *, row_number() OVER (PARTITION BY id, w1 ORDER BY sim DESC, w2) AS rn
            FROM wanted JOIN word_sim USING (w1, w2) WHERE sim > 0.2) WHERE rn = 1"""),
    "best_order": (["wanted_order", "word_sim"], """
        SELECT id, w1, w2, sim FROM (
            SELECT *, row_number() OVER (PARTITION BY id, w1 ORDER BY sim DESC, w2) AS rn
            FROM wanted_order JOIN word_sim USING (w1, w2) WHERE sim > 0.4) WHERE rn = 1"""),
    "sentence_freq": (["sentences"], """
        SELECT word, count(*) AS n FROM (SELECT unnest(t1) AS word FROM sentences
                                         UNION ALL SELECT unnest(t2) FROM sentences) GROUP BY word"""),
    "info": (["sentence_freq"], """
        SELECT word, 1 - ln(n + 1) / ln((SELECT sum(n) FROM sentence_freq) + 1) AS info FROM sentence_freq"""),
    "joint": (["content_sentences"], """
        SELECT id, w, list_contains(t1, w) AS in1, list_contains(t2, w) AS in2 FROM (
            SELECT id, t1, t2, unnest(list_distinct(list_concat(t1, t2))) AS w FROM content_sentences)"""),
    "sem": (["joint", "best_match", "info", "content_sentences"], """
        SELECT s.id, CASE WHEN len(s.t1) = 0 OR len(s.t2) = 0 THEN 0 ELSE coalesce(x.sim, 0) END AS sem_similarity
        FROM content_sentences s LEFT JOIN (
            SELECT id, sum(v1 * v2) / nullif(sqrt(sum(v1 * v1)) * sqrt(sum(v2 * v2)), 0) AS sim FROM (
                SELECT j.id, CASE WHEN in1 THEN i.info * i.info WHEN m.w2 IS NOT NULL THEN 0.2 * i.info * k.info ELSE 0 END AS v1,
                       CASE WHEN in2 THEN i.info * i.info WHEN m.w2 IS NOT NULL THEN 0.2 * i.info * k.info ELSE 0 END AS v2
                FROM joint j LEFT JOIN best_match m ON m.id = j.id AND m.w1 = j.w
                LEFT JOIN info i ON i.word = j.w LEFT JOIN info k ON k.word = m.w2) GROUP BY id) x ON x.id = s.id"""),
    "sem_plain": (["joint", "best_match", "content_sentences"], """
        SELECT s.id, CASE WHEN len(s.t1) = 0 OR len(s.t2) = 0 THEN 0 ELSE coalesce(x.sim, 0) END AS sem_similarity
        FROM content_sentences s LEFT JOIN (
            SELECT id, sum(v1 * v2) / nullif(sqrt(sum(v1 * v1)) * sqrt(sum(v2 * v2)), 0) AS sim FROM (
                SELECT j.id, CASE WHEN in1 THEN 1.0 WHEN m.w2 IS NOT NULL THEN 0.2 ELSE 0 END::DOUBLE AS v1,
                       CASE WHEN in2 THEN 1.0 WHEN m.w2 IS NOT NULL THEN 0.2 ELSE 0 END::DOUBLE AS v2
                FROM joint j LEFT JOIN best_match m ON m.id = j.id AND m.w1 = j.w) GROUP BY id) x ON x.id = s.id"""),
    "first_seen": (["sentences"], """
        SELECT id, t1, t2, list_filter(list_concat(t1, t2), lambda w, i: list_position(list_concat(t1, t2), w) = i) AS j
        FROM sentences"""),
    "word_order": (["first_seen", "best_order"], """
        SELECT id, 1 - sqrt(sum((r1 - r2) * (r1 - r2))) / nullif(sqrt(sum((r1 + r2) * (r1 + r2))), 0) AS word_order_similarity
        FROM (
            SELECT f.id, (CASE WHEN list_contains(t1, w) THEN pos ELSE coalesce(list_position(j, m.w2) - 1, 0) END)::DOUBLE AS r1,
                   (CASE WHEN list_contains(t2, w) THEN pos ELSE coalesce(list_position(j, m.w2) - 1, 0) END)::DOUBLE AS r2
            FROM (SELECT *, unnest(j) AS w, generate_subscripts(j, 1) - 1 AS pos FROM first_seen) f
            LEFT JOIN best_order m ON m.id = f.id AND m.w1 = f.w) GROUP BY id"""),
}

_previous = "vocabulary"
for _name, _body in STEM_STEPS.items():
    BLOCKS[_name] = ([_previous], _body)
    _previous = _name


def with_blocks(body: str, *names: str, own: dict[str, str] | None = None) -> str:
    """A statement that starts with the named blocks and what they need.

    ``own`` replaces blocks for this statement only.
    """
    own = own or {}
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        if name not in own:
            for needed in BLOCKS[name][0]:
                visit(needed)
        ordered.append(name)

    for name in names:
        visit(name)
    bodies = [(n, own.get(n) or BLOCKS[n][1]) for n in ordered]
    recursive = "RECURSIVE " if "up" in ordered else ""
    ctes = ",\n".join(
        f"{n} AS {'' if recursive else 'MATERIALIZED '}({b.strip()})" for n, b in bodies
    )
    return f"WITH {recursive}{ctes}\n{body.strip()}"
