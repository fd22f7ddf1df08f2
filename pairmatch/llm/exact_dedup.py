"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmatch.llm.text import SPACES, text_of
from pairmatch.operators.joins import hot_keys, salted_join
from pairmatch.session import written

#: Characters of the normalised text that the second stage compares.
PREFIX = 64


def normalised(text: Column) -> Column:
    """The text without its white space."""
    for space in SPACES:
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def repeated(rows: DataFrame, on: list[str]) -> DataFrame:
    """Rows that share the values of ``on`` with another row; hot values are salted."""
    counts = rows.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1")
    return salted_join(
        rows, counts.select(*on), on, hot_keys(counts, on), F.col("row"), how="left_semi"
    )


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix: int = PREFIX,
    digest_all: bool = False,
) -> DataFrame:
    """Group the texts that are equal up to white space; of each group one row stays.

    Three stages, each on the rows that the one before could not tell apart: the length of the
    normalised text, a hash of its first ``prefix`` characters, the SHA-256 of all of it. Only
    the third needs whole contents: it reads the texts of the surviving rows again. With
    ``digest_all`` (the caller reports every digest) the first scan takes the digests of all
    texts, and no text is shuffled at all.

    Returns a row per row of ``docs``: ``(doc_id, keep_id, group_size, kept, digest)``. The row
    with the most code points stays, then the smallest id, a null id last; of rows that agree in
    both one stays. ``digest`` is null where an earlier stage told the text apart. A null text
    is an empty one. Other columns are not looked at. An empty table gives an empty result.
    """
    text = text_of("text")
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    norm = source.select("doc_id", F.char_length(text).alias("points"), normalised(text).alias("t"))
    first = {
        "row": F.monotonically_increasing_id(),
        "length": F.octet_length("t"),
        "prefix_hash": F.xxhash64(F.left(F.col("t"), F.lit(prefix))),
    }
    full = F.sha2(F.col("t").cast("binary"), 256)
    if digest_all:
        first["digest"] = full
    keys = written(norm.withColumns(first).drop("t"), "lengths")
    same_length = written(repeated(keys, ["length"]), "same-length")
    on = ["length", "prefix_hash"]
    same_prefix = written(repeated(same_length, on), "same-prefix")
    if digest_all:
        hashed, rest = same_prefix, keys.join(same_prefix.select("row"), "row", "left_anti")
    else:
        wanted = same_prefix.select(F.col("doc_id").alias("id"), *on).distinct()
        same = F.col("doc_id").eqNullSafe(F.col("id"))
        for name in on:
            same &= F.col(f"a.{name}") == F.col(f"b.{name}")
        again = norm.withColumns(first).alias("a").join(wanted.alias("b"), same, "left_semi")
        hashed = written(again.withColumn("digest", full).drop("t"), "digests")
        rest = keys.join(same_prefix.select("row"), "row", "left_anti")
        rest = rest.withColumn("digest", F.lit(None).cast("string"))
    best = F.struct(
        (-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"
    )
    groups = written(
        hashed.groupBy("digest")
        .agg(F.count("*").alias("n"), F.min(best).alias("best"))
        .where("n > 1"),
        "groups",
    )
    found = salted_join(
        hashed, groups, ["digest"], hot_keys(groups, ["digest"]), F.col("row"), how="left"
    )
    alone = F.col("n").isNull()
    result = [
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).alias("group_size"),
        (alone | (F.col("row") == F.col("best.row"))).alias("kept"),
        "digest",
    ]
    singles = rest.withColumns(
        {"n": F.lit(None).cast("long"), "best": F.lit(None).cast(groups.schema["best"].dataType)}
    )
    return found.select(*result).unionByName(singles.select(*result))
