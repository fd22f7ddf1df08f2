"""Cleaning, tokenising and counting of text columns."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pairmatch.functions.words import ALLOWED_NUMBERS, STOP_WORDS, effective_stop_words

# Rewrite rules, applied in this order to lower-cased text.
NORMALIZE_RULES: list[tuple[str, str]] = [
    (r"[^A-Za-z0-9^,!./'+-=]", " "),
    (r"what's", "what is "),
    (r"'s", " "),
    (r"'ve", " have "),
    (r"can't", "cannot "),
    (r"n't", " not "),
    (r"i'm", "i am "),
    (r"'re", " are "),
    (r"'d", " would "),
    (r"'ll", " will "),
    (r"60k", " 60000 "),
    (r" e g ", " for example "),
    (r" e.g ", " for example "),
    (r" e.g. ", " for example "),
    (r" b g ", " bg "),
    (r" u s ", " american "),
    (r" 9 11 ", "911"),
    (r"e - mail", "email"),
    (r"j k", "jk"),
    (r"\s{2,}", " "),
]

#: Spark's form of rules that are slow as written: the same characters, listed and not excluded;
#: a space stays a space, so it is no match.
LISTED = {
    NORMALIZE_RULES[0][0]: r"""[\x00-\x1f"-&(-*>-@\[-\]_`{-\x{10ffff}]""",
}

# ASCII punctuation without the backslash, and the two curly single quotes.
PUNCTUATION = r"[!-/:-@\[\]^_`{|}~’‘]"

# Fused words that count as two tokens; the first letters are cheaper to look for than a word's start.
FUSED = r"(?=[cglw])\b(?:can(?=not\b)|gim(?=me\b)|gon(?=na\b)|got(?=ta\b)|lem(?=me\b)|wan(?=na\b))"


def unaccented(text: str) -> str:
    """The compatibility decomposition of a text without combining marks."""
    if text.isascii():
        return text
    parts = unicodedata.normalize("NFKD", text)
    return "".join(c for c in parts if not unicodedata.combining(c))


@F.pandas_udf(StringType())
def _unaccented_texts(texts: pd.Series) -> pd.Series:
    return texts.map(unaccented, na_action="ignore")


def normalize_text(text: Column) -> Column:
    """Lower-case, expand contractions and a few abbreviations, collapse white space.

    Most rules are plain strings; replacing those needs no regular expression.
    """

    def rewrite(c: Column, rule: tuple[str, str]) -> Column:
        pattern, new = rule
        if re.search(r"[][\\.^$*+?{}()|]", pattern):
            return F.regexp_replace(c, LISTED.get(pattern, pattern), new)
        return F.replace(c, F.lit(pattern), F.lit(new))

    return reduce(rewrite, NORMALIZE_RULES, F.lower(text))


def strip_punct(text: Column) -> Column:
    """Delete punctuation, then lower-case."""
    return F.lower(F.regexp_replace(text, PUNCTUATION, ""))


def expand_thousands(text: Column) -> Column:
    """Write ``10k`` or ``10  K`` at a word end as ``10000``."""
    return F.regexp_replace(text, r"(?i)([0-9]+)\s{0,2}k\b", "$1000")


def clean_text(text: Column) -> Column:
    """The whole cleaning chain: normalise, delete punctuation, expand thousands."""
    return expand_thousands(strip_punct(normalize_text(text)))


def split_words(text: Column) -> Column:
    """Plain split on a single space; empty parts stay."""
    return F.split(text, " ")


def split_whitespace(text: Column) -> Column:
    """Split on runs of white space; no empty parts."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def tokenize(text: Column) -> Column:
    """Word tokens of punctuation-free lower-case text; fused words are taken apart."""
    return split_whitespace(F.regexp_replace(text, FUSED, "$0 "))


def word_count(text: Column) -> Column:
    """Number of parts of a single-space split; the empty string counts one."""
    return F.size(split_words(text))


def char_count(text: Column) -> Column:
    """Length in code points."""
    return F.char_length(text)


def strip_accents(text: Column) -> Column:
    """The compatibility decomposition without combining marks: base letters, plain forms.

    Spark has no normal forms, so this is a vectorised function; it covers every character.
    """
    return _unaccented_texts(text)


def ngrams(tokens: Column, n: int) -> Column:
    """All 1..n-grams of a token array, joined by a space."""

    def of_size(g: int) -> Column:
        if g == 1:
            return tokens
        grams = F.transform(
            F.sequence(F.lit(0), F.size(tokens) - g),
            lambda i: F.array_join(F.slice(tokens, i + 1, g), " "),
        )
        return F.when(F.size(tokens) >= g, grams).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of_size(g) for g in range(1, n + 1)])


def without_words(tokens: Column, words: list[str]) -> Column:
    """Tokens that are not in a list; order and repeats stay."""
    return F.filter(tokens, lambda w: ~w.isin(*words))


def drop_stopwords(text: Column, stop: list[str] | None = None) -> Column:
    """Text without its stop words, tokens joined by single spaces."""
    stop = effective_stop_words() if stop is None else stop
    return F.array_join(without_words(tokenize(text), stop), " ")


def keep_allowed_numbers(
    tokens: Column, numbers: list[str] = ALLOWED_NUMBERS, stop: list[str] = STOP_WORDS
) -> Column:
    """Keep a number only when it is listed, any other token unless it is a stop word."""
    return F.filter(
        tokens,
        lambda w: F.when(w.rlike("^[0-9]+$"), w.isin(*numbers)).otherwise(~w.isin(*stop)),
    )


def token_share(a: Column, b: Column) -> Column:
    """Shared distinct tokens over all distinct tokens of two arrays, doubled; 0 if one is empty."""
    size_a, size_b = F.size(a), F.size(b)
    shared = F.size(F.array_intersect(a, b))
    return F.when((size_a == 0) | (size_b == 0), F.lit(0.0)).otherwise(
        F.bround(2 * shared / (size_a + size_b), 5)
    )


def content_words(text: Column, stop: list[str] | None = None) -> Column:
    """Distinct lower-cased white-space tokens that are not stop words."""
    stop = effective_stop_words() if stop is None else stop
    return F.array_distinct(without_words(split_whitespace(F.lower(text)), stop))


def word_match_share(a: Column, b: Column, stop: list[str] | None = None) -> Column:
    """Overlap of the content words of two texts, in [0, 1], five decimals."""
    return token_share(content_words(a, stop), content_words(b, stop))


def safe_float(value: Column) -> Column:
    """Null or non-numeric text becomes 0, anything else a double."""
    return F.coalesce(value.cast("string").try_cast("double"), F.lit(0.0))


def is_nan(value: Column) -> Column:
    """True only for a numeric NaN; never null and never an error."""
    return F.coalesce(F.isnan(value.cast("string").try_cast("double")), F.lit(False))
