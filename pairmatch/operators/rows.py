"""Row numbers and prefixes in key order, without a single global sort task."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairmatch.session import written


def exploded(df: DataFrame, array: Column | str, name: str, *keep: str) -> DataFrame:
    """One row per non-null array element, next to the ``keep`` columns.

    The outer form stops the optimiser from testing the array size in a filter below the
    projection, which would compute a costly array twice.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


#: Rows that one bucket of a row number holds about, and the most buckets (the broadcast bound).
BUCKET_ROWS = 1 << 20
MOST_BUCKETS = 1 << 16


def global_row_number(
    df: DataFrame,
    key: str,
    by: str | None = None,
    buckets: int | None = None,
    name: str = "rn",
) -> DataFrame:
    """Number rows 1.. in order of a unique numeric ``key``, optionally within ``by``.

    Approximate quantiles of the key cut the rows into buckets of about equal size, whatever
    the distribution of the key; there are as many as the rows ask for. A row number is the
    number of rows in earlier buckets plus the rank inside the own bucket, so the largest sort
    is one bucket. The offsets table has a row per bucket and value of ``by``, which should have
    few values (a label); it is broadcast if it is small. Null keys come last, in a bucket of
    their own, dealt over the hash of the row and numbered in that order. A null in ``by`` is a
    value of its own. An empty table stays empty.

    The table is read for its size, its quantiles, the counts and the numbers, so it is written
    once first.
    """
    df = written(df, "numbered")
    if buckets is None:
        buckets = min(MOST_BUCKETS, max(64, df.count() // BUCKET_ROWS))
    probabilities = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(df.approxQuantile(key, probabilities, 0.25 / buckets)))
    splits = [-float("inf"), *(cuts or [0.0]), float("inf")]
    by_cols = [by] if by else []
    bucketizer = Bucketizer(
        splits=splits, inputCol="_key", outputCol="_bucket", handleInvalid="keep"
    )
    keyed = bucketizer.transform(df.withColumn("_key", F.col(key).cast("double")))
    # null keys are spread over as many buckets behind all others
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(buckets)) + len(splits)
    keyed = keyed.withColumn(
        "_bucket", F.when(F.col("_key").isNull(), spread).otherwise(F.col("_bucket").cast("long"))
    )
    counts = keyed.groupBy(*by_cols, "_bucket").agg(F.count("*").alias("_n"))
    before = (
        Window.partitionBy(*by_cols)
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select(
        *(F.col(c).alias("_by") for c in by_cols),
        F.col("_bucket").alias("_at"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    same = F.col("_bucket") == F.col("_at")
    if by:
        same &= F.col(by).eqNullSafe(F.col("_by"))
    if offsets.count() <= MOST_BUCKETS * 4:
        offsets = F.broadcast(offsets)
    inside = Window.partitionBy(*by_cols, "_bucket").orderBy(key)
    return (
        keyed.join(offsets, same)
        .withColumn(name, F.col("_before") + F.row_number().over(inside))
        .select(*df.columns, name)
    )
