"""Joins on keys of which a few may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot above the share ``1 / (HOT_PARTS * P)`` of the rows, with P shuffle partitions.
HOT_PARTS = 4


def shuffle_partitions(df: DataFrame) -> int:
    """The number of shuffle partitions the session is set to."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(counts: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """Keys with more than a fraction of a partition's fair share, from counts per key.

    With P shuffle partitions a key is hot above ``total / (4 P)`` rows, so there are never
    more than ``4 P`` of them, whatever the size of the data. ``_salts`` is the number of
    partitions the key is spread over: its share of all rows times P.
    """
    parts = shuffle_partitions(counts)
    total = counts.agg(F.sum(n)).scalar()
    return counts.where(F.col(n) * (HOT_PARTS * parts) > total).select(
        *on, F.ceil(F.col(n) * parts / total).cast("int").alias("_salts")
    )


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    hot: DataFrame,
    spread: Column,
    how: str = "inner",
) -> DataFrame:
    """Equi-join of a large ``left`` with a smaller ``right``.

    Left rows of a hot key are spread over its ``_salts`` partitions by ``spread`` (a column of
    the left side); the right rows of that key are repeated as often. Left rows with a null in
    the key match nothing and are spread over all partitions. ``hot`` comes from ``hot_keys``
    on all or some of the ``on`` columns and is bounded by the number of partitions, so it is
    safe to broadcast. Which keys are called hot changes only the placement of rows, never the
    result.
    """
    parts = shuffle_partitions(left)
    marked = F.broadcast(hot)
    by = [c for c in hot.columns if c != "_salts"]
    null_key = F.array_contains(F.array(*(F.col(c).isNull() for c in on)), True)
    salts = F.when(null_key, F.lit(parts)).otherwise(F.coalesce("_salts", F.lit(1)))
    salted_left = left.join(marked, by, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(spread), salts).cast("int")
    )
    salted_right = right.join(marked, by, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    )
    return (
        salted_left.drop("_salts")
        .join(salted_right.drop("_salts"), [*on, "_salt"], how)
        .drop("_salt")
    )


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    counts: DataFrame,
    spread: Column,
    how: str = "inner",
    most: int = 100_000,
    n: str = "n",
) -> DataFrame:
    """Join with a table that is small as a rule: broadcast up to ``most`` rows, else salted.

    The rows of ``right`` are counted first, so what is broadcast has a bound. ``counts`` has
    the number ``n`` of left rows per key and serves the salted join.
    """
    if right.count() <= most:
        return left.join(F.broadcast(right), on, how)
    return salted_join(left, right, on, hot_keys(counts, on, n), spread, how)


def join_scores(df: DataFrame, scores: DataFrame, on: tuple[str, ...] = ("id", "type")) -> DataFrame:
    """Left join of scores that were computed before."""
    return df.join(scores, list(on), "left")


def attach(df: DataFrame, columns: DataFrame, on: str = "id") -> DataFrame:
    """Add columns by key; rows without a partner get nulls."""
    return df.join(columns, on, "left")


def join_weights(q1: DataFrame, q2: DataFrame, on: str = "id") -> DataFrame:
    """Full outer join of the two sides' aggregates; a missing side counts as 0."""
    return q1.join(q2, on, "full_outer").fillna(0.0)
