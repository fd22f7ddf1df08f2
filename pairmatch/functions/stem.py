"""English stemming of a vocabulary, written as Spark column expressions.

``stem_word`` is the same for one word, for tasks that look up their words themselves.

The published Porter2 rules work on a suffix and on two regions of the word: ``r1`` starts
after the first consonant that follows a vowel, ``r2`` is the same inside ``r1``. Every step
is one projection over the vocabulary, so each distinct word is stemmed once.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmatch.functions.words import STOP_WORDS

# Words with their own stem.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes", "inning": "inning",
    "innings": "inning", "outing": "outing", "outings": "outing", "canning": "canning",
    "cannings": "canning", "herring": "herring", "herrings": "herring", "earring": "earring",
    "earrings": "earring", "proceed": "proceed", "proceeds": "proceed",
    "proceeded": "proceed", "proceeding": "proceed", "exceed": "exceed", "exceeds": "exceed",
    "exceeded": "exceed", "exceeding": "exceed", "succeed": "succeed", "succeeds": "succeed",
    "succeeded": "succeed", "succeeding": "succeed",
}

# Suffix replacements inside r1, second step.
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent",
    "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous",
    "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}

# Suffix replacements inside r1, third step.
STEP_3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic",
    "ical": "ic", "ful": "", "ness": "", "ative": "",
}

# Suffixes deleted inside r2, fourth step.
STEP_4 = """
al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion
""".split()

# Letter classes of the published rules (a consonant y is written Y).
SHORT_SYLLABLE = r"^[aeiouy][^aeiouy]$|[^aeiouy][aeiouy][^aeiouywxY]$"
REGION = r"^[^aeiouy]*[aeiouy]+[^aeiouy]"


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def _suffix(word: Column, suffixes) -> Column:
    """Longest listed suffix (the leftmost match that reaches the end), or the empty string."""
    return F.regexp_extract(word, f"(?:{'|'.join(suffixes)})$", 0)


def _cut(word: Column, n: Column | int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def _after_region(word: Column) -> Column:
    """Position after the first vowel-consonant sequence, or the word length."""
    found = F.length(F.regexp_extract(word, REGION, 0))
    return F.when(found > 0, found).otherwise(F.length(word))


def _step_1a(w: Column) -> Column:
    return (
        F.when(w.rlike("sses$"), _cut(w, 2))
        .when(w.rlike("ie[ds]$"), F.when(F.length(w) > 4, _cut(w, 2)).otherwise(_cut(w, 1)))
        .when(w.rlike("(?:us|ss)$"), w)
        .when(w.rlike("[aeiouy].+s$"), _cut(w, 1))
        .otherwise(w)
    )


def _step_1b_repair(w: Column, r1: Column) -> Column:
    return (
        F.when(w.rlike("(?:at|bl|iz)$"), F.concat(w, F.lit("e")))
        .when(w.rlike("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _cut(w, 1))
        .when((r1 >= F.length(w)) & w.rlike(SHORT_SYLLABLE), F.concat(w, F.lit("e")))
        .otherwise(w)
    )


def _swap(w: Column, suffix: Column, table: dict[str, str], allowed: Column) -> Column:
    new = F.concat(_cut(w, F.length(suffix)), F.element_at(_literal_map(table), suffix))
    return F.when((suffix != "") & allowed, new).otherwise(w)


def stem_vocabulary(words: DataFrame, protected: list[str] = STOP_WORDS) -> DataFrame:
    """Add a ``stem`` column to a table with a ``word`` column.

    Words of ``protected`` keep their form. Call it on distinct words.
    """
    word, w, r1, r2 = F.col("word"), F.col("_w"), F.col("_r1"), F.col("_r2")
    start = F.regexp_replace(F.regexp_replace(word, "^'+", ""), "(?:'s'|'s|')$", "")
    marked = F.regexp_replace(F.regexp_replace(start, "^y", "Y"), "([aeiouy])y", "$1Y")
    v = words.withColumn("_w", marked)
    prefix = F.length(F.regexp_extract(w, "^(?:gener|commun|arsen)", 0))
    v = v.withColumn("_r1", F.when(prefix > 0, prefix).otherwise(_after_region(w)))
    rest = F.substring(w, r1 + 1, F.length(w))
    v = v.withColumn("_r2", r1 + _after_region(rest))
    v = v.withColumn("_w", _step_1a(w))

    # -eed, -ed, -ing and their adverbs
    suffix = F.col("_s")
    v = v.withColumn("_s", _suffix(w, ["eedly", "ingly", "edly", "eed", "ing", "ed"]))
    v = v.withColumn("_c", _cut(w, F.length(suffix)))
    in_r1 = F.length(F.col("_c")) >= r1
    is_eed = suffix.startswith("eed")
    v = v.withColumn(
        "_w",
        F.when(is_eed & in_r1, F.concat("_c", F.lit("ee")))
        .when(~is_eed & (suffix != "") & F.col("_c").rlike("[aeiouy]"),
              _step_1b_repair(F.col("_c"), r1))
        .otherwise(w),
    )
    v = v.withColumn("_w", F.regexp_replace(w, "^(.+[^aeiouy])[yY]$", "$1i"))

    fits_r1 = F.length(w) - F.length(suffix) >= r1
    fits_r2 = F.length(w) - F.length(suffix) >= r2
    v = v.withColumn("_s", _suffix(w, STEP_2))
    allowed = (
        F.when(suffix == "ogi", w.endswith("logi"))
        .when(suffix == "li", w.rlike("[cdeghkmnrt]li$"))
        .otherwise(True)
    )
    v = v.withColumn("_w", _swap(w, suffix, STEP_2, fits_r1 & allowed))
    v = v.withColumn("_s", _suffix(w, STEP_3))
    v = v.withColumn("_w", _swap(w, suffix, STEP_3, fits_r1 & ((suffix != "ative") | fits_r2)))
    v = v.withColumn("_s", _suffix(w, STEP_4))
    allowed = fits_r2 & ((suffix != "ion") | w.rlike("[st]ion$"))
    v = v.withColumn(
        "_w", F.when((suffix != "") & allowed, _cut(w, F.length(suffix))).otherwise(w)
    )

    last = F.length(w) - 1
    drop_e = w.endswith("e") & (
        (last >= r2) | ((last >= r1) & ~_cut(w, 1).rlike(SHORT_SYLLABLE))
    )
    drop_l = w.endswith("ll") & (last >= r2)
    v = v.withColumn("_w", F.when(drop_e | drop_l, _cut(w, 1)).otherwise(w))
    stem = (
        F.when(word.isin(*protected) | (F.length(word) <= 2), word)
        .when(word.isin(*SPECIAL), F.element_at(_literal_map(SPECIAL), word))
        .otherwise(F.lower(w))
    )
    return v.withColumn("stem", stem).drop("_w", "_r1", "_r2", "_s", "_c")


#: Words of which a Python worker remembers the stem.
REMEMBERED = 1 << 18
_PROTECTED = frozenset(STOP_WORDS)


def _java(pattern: str) -> re.Pattern:
    """A rule of ``stem_vocabulary`` with Java's line ends."""
    ends = "\n\r\u0085\u2028\u2029"
    end = rf"(?=(?:\r\n|[{ends}])?\Z)"
    return re.compile(pattern.replace("]$", f"]{end}").replace(")$", f"){end}").replace(".+", f"[^{ends}]+"))


def _ending(suffixes) -> re.Pattern:
    return _java(f"(?:{'|'.join(suffixes)})$")


_RULES = {
    name: _java(pattern) for name, pattern in {
        "possessive": r"(?:'s'|'s|')$", "sses": r"(?:sses)$", "ied": r"(?:ie[ds])$",
        "us": r"(?:us|ss)$", "s": r"[aeiouy].+(?:s)$", "long": r"(?:at|bl|iz)$",
        "double": r"(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$", "short": SHORT_SYLLABLE, "region": REGION,
        "y": r"^(.+[^aeiouy])[yY]$", "li": r"[cdeghkmnrt](?:li)$", "ion": r"[st](?:ion)$",
    }.items()
}
_ENDINGS = [
    _ending(x) for x in (["eedly", "ingly", "edly", "eed", "ing", "ed"], STEP_2, STEP_3, STEP_4)
]


def _found(pattern: re.Pattern, word: str) -> str:
    found = pattern.search(word)
    return found.group() if found else ""


def _without(word: str, n: int) -> str:
    return word[: max(0, len(word) - n)]


@lru_cache(REMEMBERED)
def stem_word(word: str) -> str:
    """The stem that ``stem_vocabulary`` gives, with its default list of protected words."""
    if word in _PROTECTED or len(word) <= 2:
        return word
    if word in SPECIAL:
        return SPECIAL[word]

    def has(rule: str, text: str) -> bool:
        return _RULES[rule].search(text) is not None

    def region(text: str) -> int:
        return len(_found(_RULES["region"], text)) or len(text)

    w = _RULES["possessive"].sub("", re.sub("^'+", "", word))
    w = re.sub("([aeiouy])y", r"\1Y", re.sub("^y", "Y", w))
    r1 = len(_found(re.compile("^(?:gener|commun|arsen)"), w)) or region(w)
    r2 = r1 + region(w[r1:])
    if has("sses", w):
        w = _without(w, 2)
    elif has("ied", w):
        w = _without(w, 2 if len(w) > 4 else 1)
    elif not has("us", w) and has("s", w):
        w = _without(w, 1)

    suffix = _found(_ENDINGS[0], w)
    rest = _without(w, len(suffix))
    if suffix.startswith("eed") and len(rest) >= r1:
        w = rest + "ee"
    elif suffix and not suffix.startswith("eed") and re.search("[aeiouy]", rest):
        w = rest
        if has("long", w):
            w += "e"
        elif has("double", w):
            w = _without(w, 1)
        elif r1 >= len(w) and has("short", w):
            w += "e"
    w = _RULES["y"].sub(r"\1i", w)

    suffix = _found(_ENDINGS[1], w)
    allowed = {"ogi": w.endswith("logi"), "li": has("li", w)}.get(suffix, True)
    if suffix and len(w) - len(suffix) >= r1 and allowed:
        w = _without(w, len(suffix)) + STEP_2[suffix]
    suffix = _found(_ENDINGS[2], w)
    if suffix and len(w) - len(suffix) >= (max(r1, r2) if suffix == "ative" else r1):
        w = _without(w, len(suffix)) + STEP_3[suffix]
    suffix = _found(_ENDINGS[3], w)
    if suffix and len(w) - len(suffix) >= r2 and (suffix != "ion" or has("ion", w)):
        w = _without(w, len(suffix))

    last = len(w) - 1
    short = has("short", _without(w, 1))
    if w.endswith("e") and (last >= r2 or (last >= r1 and not short)):
        w = _without(w, 1)
    elif w.endswith("ll") and last >= r2:
        w = _without(w, 1)
    return w.lower()
