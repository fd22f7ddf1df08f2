import re
import string
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairmatch.functions import text as T
from pairmatch.functions.stem import stem_vocabulary
from pairmatch.functions.words import ALLOWED_NUMBERS, ALLOWED_STOP_WORDS, STOP_WORDS


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "c string").select(fn(F.col("c"))).first()[0]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("can't you don't see I'm here", "cannot you do not see i am here"),
        ("What's up", "what is up"),
        ("it’s", "it s"),
        ("go e.g. now", "go for example now"),
        ("a eeg b", "a for example b"),
        ("on 9 11 was", "on911was"),
        ("the u s army", "the american army"),
        ("back  \n here", "back here"),
    ],
)
def test_normalize_text(spark, text, expected):
    assert one(spark, text, T.normalize_text) == expected


def test_expand_thousands(spark):
    text = "2k and 10  K a9k 10kg"
    assert one(spark, text, T.expand_thousands) == "2000 and 10000 a9000 10kg"


def test_strip_punct_keeps_the_backslash(spark):
    assert one(spark, "a\\b[c]’ D", T.strip_punct) == "a\\bc d"


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet=string.printable, max_size=40))
def test_strip_punct_matches_a_regular_expression(spark, text):
    kept = "".join(c for c in text if c not in string.punctuation or c == "\\").lower()
    assert one(spark, text, T.strip_punct) == kept


def test_counts_of_the_empty_text(spark):
    assert one(spark, "", T.word_count) == 1
    assert one(spark, "a  b", T.word_count) == 3
    assert one(spark, "añb", T.char_count) == 3


def test_tokenize_takes_fused_words_apart(spark):
    tokens = one(spark, " i cannot  gonna wanna cannots", T.tokenize)
    assert tokens == ["i", "can", "not", "gon", "na", "wan", "na", "cannots"]


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    rows = [r[0] for r in df.select(T.ngrams(F.col("t"), 2)).collect()]
    assert rows == [["a", "b", "c", "a b", "b c"], ["a"], []]


def test_word_lists():
    assert len(STOP_WORDS) == len(set(STOP_WORDS)) == 179
    assert len(ALLOWED_STOP_WORDS) == 60 and set(ALLOWED_STOP_WORDS) <= set(STOP_WORDS)
    assert len(ALLOWED_NUMBERS) == 122 and {"1", "101", "200", "1000000"} <= set(ALLOWED_NUMBERS)


def test_keep_allowed_numbers(spark):
    df = spark.createDataFrame([(["the", "12", "102", "ring", "about"],)], "t array<string>")
    assert df.select(T.keep_allowed_numbers(F.col("t"))).first()[0] == ["12", "ring"]


@pytest.mark.parametrize(
    ("a", "b", "expected"),
    [
        ("the of is", "ring", 0.0),
        ("red ring", "red ring", 1.0),
        ("red ring ring", "blue ring", 0.5),
        ("", "", 0.0),
        ("a1 a2 a3", "a1 b2 b3 b4", 0.28571),
    ],
)
def test_word_match_share(spark, a, b, expected):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    share = T.word_match_share(F.col("a"), F.col("b"))
    swapped = T.word_match_share(F.col("b"), F.col("a"))
    assert tuple(df.select(share, swapped).first()) == (expected, expected)


def test_strip_accents(spark):
    assert one(spark, "Éà ñ ç ø é", T.strip_accents) == "Ea n c ø e"


def test_safe_float(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,), ("NaN",)], "c string")
    rows = df.select(T.is_nan(F.col("c")), T.safe_float(F.col("c"))).collect()
    assert [r[0] for r in rows] == [False, False, False, True]
    assert [r[1] for r in rows][:3] == [1.5, 0.0, 0.0]


# published word-stem pairs of the Porter2 rules
STEMS = {
    "consign": "consign", "consigned": "consign", "consigning": "consign",
    "consistency": "consist", "consolation": "consol", "consolingly": "consol",
    "conspicuously": "conspicu", "knightly": "knight", "knocked": "knock", "kneeling": "kneel",
    "caresses": "caress", "ties": "tie", "cries": "cri", "gas": "gas", "this": "this",
    "gaps": "gap", "kiwis": "kiwi", "luxuriated": "luxuri", "hopping": "hop", "hoping": "hope",
    "by": "by", "say": "say", "cry": "cri", "youth": "youth", "boyish": "boyish",
    "relational": "relat", "generate": "generat", "general": "general", "communism": "communism",
    "skies": "sky", "dying": "die", "news": "news", "proceeding": "proceed",
    "adoption": "adopt", "hopeful": "hope", "goodness": "good", "falling": "fall",
    "sensational": "sensat", "rational": "ration", "possibly": "possibl", "bed": "bed",
    "agreed": "agre", "feed": "feed", "plastered": "plaster", "sky": "sky", "controlling": "control",
}


def test_stems(spark):
    words = spark.createDataFrame([(w,) for w in STEMS], "word string")
    got = {r["word"]: r["stem"] for r in stem_vocabulary(words).collect()}
    assert got == STEMS


def test_normalize_rules_equal_python(spark):
    texts = ["I've 60k e - mail j k", "x b g y", "a e g b 'd 'll", "It's; what's <this> & that?"]
    for text in texts:
        expected = text.lower()
        for pattern, new in T.NORMALIZE_RULES:
            expected = re.sub(pattern, new, expected)
        assert one(spark, text, T.normalize_text) == expected


def test_listed_characters_are_those_the_rule_excludes(spark):
    points = [k for k in range(0x110000) if not 0xD800 <= k < 0xE000]
    text = "".join(map(chr, points))
    pattern, new = T.NORMALIZE_RULES[0]
    df = spark.createDataFrame([(text,)], ["t"])
    listed = df.select(F.regexp_replace("t", T.LISTED[pattern], new)).first()[0]
    assert listed == re.sub(pattern, new, text)
    assert pattern not in df.select(T.normalize_text(F.col("t")))._jdf.queryExecution().toString()
