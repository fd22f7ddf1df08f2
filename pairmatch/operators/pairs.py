"""The pair table: keys, columns, long form, set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmatch.operators.joins import lookup_join

WEIGHT_COLUMNS = ["weight_q1_sw", "weight_q2_sw", "weight_q1_mw", "weight_q2_mw"]
IMPUTED = ["word_order_similarity", *WEIGHT_COLUMNS]


def tag_type(df: DataFrame, value: str) -> DataFrame:
    """Add the constant column ``type``."""
    return df.withColumn("type", F.lit(value))


def type_of(label: Column) -> Column:
    """``TR`` for a pair with a label, ``TS`` for one without."""
    return F.when(label.isNull(), "TS").otherwise("TR")


def label_last(df: DataFrame, label: str = "is_duplicate") -> DataFrame:
    """Move the label to the last position."""
    return df.select(*[c for c in df.columns if c != label], label)


def assign_group(df: DataFrame, n: int, key: str = "id", name: str = "grpId") -> DataFrame:
    """Add a group number from the key."""
    return df.withColumn(name, F.pmod(F.col(key), F.lit(n)).cast("int"))


def fill_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null text becomes the empty string."""
    return df.fillna("", columns)


def require_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which all the given texts are present."""
    return df.dropna(subset=columns)


def narrow(df: DataFrame) -> DataFrame:
    """All doubles to floats and all longs to ints, arrays of doubles to arrays of floats."""
    target = {"double": "float", "bigint": "int", "array<double>": "array<float>"}
    return df.select(
        *[
            F.col(f.name).cast(target.get(f.dataType.simpleString(), f.dataType)).alias(f.name)
            for f in df.schema
        ]
    )


def impute(df: DataFrame, columns: list[str] = IMPUTED, value: float = 0.0) -> DataFrame:
    """Null or NaN scores become ``value``."""
    filled = {
        c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(value)), F.lit(value))
        for c in columns
    }
    return df.withColumns(filled)


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename columns."""
    return df.withColumnsRenamed(names)


def without_grid(df: DataFrame, label: str = "is_duplicate") -> DataFrame:
    """All columns except the similarity grid and the label."""
    return df.drop("grid", label)


def long_form(df: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per question: ``(id, side, qid, text)``; repeats stay."""
    sides = F.array(
        *[
            F.struct(
                F.lit(s).alias("side"), F.col(f"qid{s}").alias("qid"),
                F.col(f"question{s}").alias("text"),
            )
            for s in (1, 2)
        ]
    )
    return df.select("id", *carry, F.inline_outer(sides))


def union_chunks(parts: list[DataFrame]) -> DataFrame:
    """Stack tables with the same columns."""
    return reduce(DataFrame.unionByName, parts)


def stack_classes(df: DataFrame, label: str = "is_duplicate") -> DataFrame:
    """Positives followed by negatives; the label stays a column."""
    return df.where(F.col(label) == 1).unionByName(df.where(F.col(label) == 0))


def wordlist_difference(words: DataFrame, allowed: DataFrame) -> DataFrame:
    """Words of the first list that are not in the second; each list is made distinct first."""
    return words.distinct().join(allowed.distinct(), "word", "left_anti")


def filter_tokens(rows: DataFrame, words: DataFrame, keep: bool = False) -> DataFrame:
    """Rows ``(.., word)`` whose word is not on a list, or with ``keep`` only those on it.

    The list is sent to the rows if it is short; beyond that, rows of frequent words are salted.
    """
    counts = rows.groupBy("word").agg(F.count("*").alias("n"))
    spread = F.struct(*rows.columns)
    how = "left_semi" if keep else "left_anti"
    return lookup_join(rows, words.distinct(), ["word"], counts, spread, how)


def joint_words(a: Column, b: Column) -> Column:
    """Distinct tokens of both arrays in first-seen order."""
    return F.array_union(a, b)


def shared_words(a: Column, b: Column) -> Column:
    """Distinct tokens that are in both arrays."""
    return F.array_intersect(a, b)


def dedupe_predictions(
    df: DataFrame, key: str = "test_id", keep: str | None = None, order: str | None = None
) -> DataFrame:
    """Drop every key seen more than once, or keep its first or last row in ``order``."""
    others = [c for c in df.columns if c != key]
    row = F.struct(*others)
    if keep is None:
        chosen = df.groupBy(key).agg(F.count("*").alias("_n"), F.any_value(row).alias("_r"))
        chosen = chosen.where("_n = 1")
    else:
        pick = F.min_by if keep == "first" else F.max_by
        chosen = df.groupBy(key).agg(pick(row, F.col(order)).alias("_r"))
    return chosen.select(key, "_r.*").select(*df.columns)


def latest_text(df: DataFrame) -> DataFrame:
    """One text per question id: the last row wins, side 2 after side 1; no empty texts.

    A pair counts only if both of its texts are there.
    """
    rows = long_form(require_text(df.where(F.col("type") == "TR"), ["question1", "question2"]))
    last = rows.groupBy("qid").agg(F.max_by("text", F.struct("id", "side")).alias("text"))
    return last.where(F.char_length("text") > 0)
