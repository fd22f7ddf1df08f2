"""Text functions over whole texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from pairmatch.functions import text as T
from pairmatch.functions.stem import stem_vocabulary
from pairmatch.functions.words import effective_stop_words
from pairmatch.operators import features, pairs as P, tfidf
from pairmatch.operators.groups import apply_by_key, apply_groups, combine_by_key
from pairmatch.operators.rows import exploded
from pairmatch.plans import views as V
from pairmatch.plans import blocks as B
from pairmatch.plans.blocks import with_blocks
from pairmatch.plans.registry import query


@query("normalize_text", f"SELECT doc_id, {B.normalized('text')} AS text FROM documents")
def normalize_text(spark, sf):
    return V.documents(spark, sf).select(
        "doc_id", T.normalize_text(F.col("text")).alias("text")
    )


@query("strip_punct", f"SELECT doc_id, {B.without_punct('text')} AS text FROM documents")
def strip_punct(spark, sf):
    return V.documents(spark, sf).select("doc_id", T.strip_punct(F.col("text")).alias("text"))


@query("expand_thousands", f"""
    SELECT p_partkey, {B.thousands("p_name || ' ' || p_size || 'k'")} AS text FROM part""")
def expand_thousands(spark, sf):
    text = F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit("k"))
    return V.load(spark, sf, "part").select("p_partkey", T.expand_thousands(text).alias("text"))


@query("drop_stopwords", with_blocks(f"""
    SELECT doc_id, array_to_string(list_filter(tokens, lambda w: w NOT IN ({B.REDUCED_SQL})), ' ') AS text
    FROM doc_tokens""", "doc_tokens"))
def drop_stopwords(spark, sf):
    text = T.clean_text(F.col("text"))
    return V.documents(spark, sf).select("doc_id", T.drop_stopwords(text).alias("text"))


@query("stem_tokens", with_blocks("SELECT word, stem FROM stems", "doc_tokens", "stems", own={
    "vocabulary": "SELECT DISTINCT unnest(tokens) AS word FROM doc_tokens"}))
def stem_tokens(spark, sf):
    words = exploded(V.doc_tokens(spark, sf), "tokens", "word").distinct()
    return stem_vocabulary(words)


@query("split_words", "SELECT page_id, len(string_split(html, ' ')) AS n FROM pages")
def split_words(spark, sf):
    words = T.split_words(F.col("html"))
    return V.load(spark, sf, "pages").select("page_id", F.size(words).cast("long").alias("n"))


@query("tokenize", with_blocks(
    "SELECT doc_id, len(tokens) AS n, array_to_string(tokens, ' ') AS text FROM doc_tokens", "doc_tokens"))
def tokenize(spark, sf):
    return V.doc_tokens(spark, sf).select(
        "doc_id", F.size("tokens").cast("long").alias("n"), F.array_join("tokens", " ").alias("text")
    )


@query("word_count", with_blocks(
    'SELECT id, "tr_q1WrdCnt" AS n1, "tr_q2WrdCnt" AS n2 FROM basic', "basic"))
def word_count(spark, sf):
    df = V.cleaned_pairs(spark, sf)
    return df.select(
        "id",
        T.word_count(F.col("q1nopunct")).cast("long").alias("n1"),
        T.word_count(F.col("q2nopunct")).cast("long").alias("n2"),
    )


@query("char_count", with_blocks(
    'SELECT id, "tr_q1Len" AS n1, "tr_q2Len" AS n2 FROM basic', "basic"))
def char_count(spark, sf):
    df = V.cleaned_pairs(spark, sf)
    return df.select(
        "id",
        T.char_count(F.col("q1nopunct")).cast("long").alias("n1"),
        T.char_count(F.col("q2nopunct")).cast("long").alias("n2"),
    )


@query("strip_accents", "SELECT doc_id, strip_accents(text) AS text FROM documents")
def strip_accents(spark, sf):
    return V.documents(spark, sf).select(
        "doc_id", T.strip_accents(F.col("text")).alias("text")
    )


@query("ngrams", with_blocks("""
    SELECT gram, count(*) AS n FROM (
        SELECT w AS gram FROM words UNION ALL
        SELECT a.w || ' ' || b.w FROM words a JOIN words b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1)
    GROUP BY gram""", "doc_tokens", "words", own={
    "words": "SELECT doc_id, unnest(tokens) AS w, generate_subscripts(tokens, 1) AS pos FROM doc_tokens"}))
def ngrams(spark, sf):
    grams = exploded(V.doc_tokens(spark, sf), T.ngrams(F.col("tokens"), 2), "gram")
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


@query("keep_allowed_numbers", with_blocks(f"""
    SELECT doc_id, array_to_string({B.numbers_kept('tokens')}, ' ') AS text FROM doc_tokens""",
    "doc_tokens"))
def keep_allowed_numbers(spark, sf):
    kept = T.keep_allowed_numbers(F.col("tokens"))
    return V.doc_tokens(spark, sf).select("doc_id", F.array_join(kept, " ").alias("text"))


@query("word_match_share", with_blocks("SELECT id, wrdmatchpct FROM basic", "basic"))
def word_match_share(spark, sf):
    return features.overlap_feature(V.cleaned_pairs(spark, sf)).select("id", "wrdmatchpct")


@query("stemmed_match_share", with_blocks(f"""
    SELECT id, {B.share('a', 'b')} AS stemmatchpct FROM (
        SELECT p.id, coalesce(list(DISTINCT stem) FILTER (side = 1), []) AS a,
               coalesce(list(DISTINCT stem) FILTER (side = 2), []) AS b
        FROM pairs p LEFT JOIN doc_stems s ON s.id = p.id AND stem NOT IN ({B.REDUCED_SQL})
        GROUP BY p.id)""", "pairs", "doc_stems"))
def stemmed_match_share(spark, sf):
    docs = tfidf.documents(V.cleaned_pairs(spark, sf))
    return tfidf.stemmed_match_share(docs, effective_stop_words())


@query("apply_groups", """
    SELECT doc_id, length(text) - length(replace(text, ' ', '')) + 1 AS n_words FROM documents""")
def apply_groups_query(spark, sf):
    def count_words(frame, separator):
        n_words = frame["text"].str.count(separator) + 1
        return frame[["doc_id"]].assign(n_words=n_words)

    docs = V.documents(spark, sf)
    return apply_groups(docs, count_words, "doc_id long, n_words long", separator=" ")


@query("apply_by_key", """
    SELECT event_type, count(*) AS n, round_even(avg(value), 6) AS mean,
           round_even(stddev_pop(value), 6) AS deviation, max(value) - min(value) AS spread
    FROM events GROUP BY event_type""")
def apply_by_key_query(spark, sf):
    """Mean and deviation of each group in one pass, which no function of single rows can give."""

    def moments(frames, digits):
        n, mean, m2, low, high = 0, 0.0, 0.0, float("inf"), float("-inf")
        for frame in frames:
            v = frame["value"].to_numpy()
            ahead, away = n + len(v), v.mean() - mean
            m2 += ((v - v.mean()) ** 2).sum() + away**2 * n * len(v) / ahead
            mean, n = mean + away * len(v) / ahead, ahead
            low, high = min(low, v.min()), max(high, v.max())
            name = frame["event_type"].iloc[0]
        row = (name, n, round(mean, digits), round((m2 / n) ** 0.5, digits), high - low)
        yield pd.DataFrame([row], columns=["event_type", "n", "mean", "deviation", "spread"])

    events = V.load(spark, sf, "events").select("event_type", "value")
    schema = "event_type string, n long, mean double, deviation double, spread double"
    return apply_by_key(events, "event_type", moments, schema, digits=6)


@query("combine_by_key", """
    SELECT user_id, count(*) AS n, max(gap) AS longest_gap FROM (
        SELECT user_id, floor(epoch(ts))::BIGINT - lag(floor(epoch(ts))::BIGINT) OVER (PARTITION BY user_id ORDER BY ts) AS gap
        FROM events) GROUP BY user_id""")
def combine_by_key_query(spark, sf):
    """The longest time between two events of a user, from the distinct times of each part."""

    def seconds(frame):
        times = frame["s"].value_counts()
        return pd.DataFrame({"user_id": frame["user_id"].iloc[0], "s": times.index, "n": times.values})

    def longest_gap(frames):
        rows = pd.concat(list(frames))
        times = sorted(rows["s"])
        n = int(rows["n"].sum())
        gap = max((b - a for a, b in zip(times, times[1:])), default=0 if n > 1 else None)
        yield pd.DataFrame({
            "user_id": rows["user_id"].iloc[:1], "n": [n], "longest_gap": pd.array([gap], "Int64"),
        })

    events = V.load(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").cast("long").alias("s"))
    return combine_by_key(
        events, "user_id", seconds, longest_gap, "user_id long, s long, n long",
        "user_id long, n long, longest_gap long",
    )


@query("clean_flow", with_blocks("""
    SELECT id, is_duplicate, "tr_q1WrdCnt", "tr_q2WrdCnt", "tr_q1Len", "tr_q2Len", wrdmatchpct
    FROM basic""", "basic"))
def clean_flow(spark, sf):
    """Whole cleaning chain, counts and overlap: the flagship query."""
    df = P.fill_text(V.text_pairs(spark, sf), ["question1", "question2"])
    return features.basic_features(df).select(
        "id", "is_duplicate", *features.COUNT_COLUMNS, "wrdmatchpct"
    )
