"""Numeric features of a pair table."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmatch.functions import text as T

COUNT_COLUMNS = ["tr_q1WrdCnt", "tr_q2WrdCnt", "tr_q1Len", "tr_q2Len"]
SCALED_FROM = [*COUNT_COLUMNS, "weight_q1_sw", "weight_q2_sw"]
SCORE_COLUMNS = ["wrdmatchpct", "sem_similarity", "word_order_similarity"]


def clean_pairs(df: DataFrame) -> DataFrame:
    """Replace the two questions by their cleaned texts ``q1nopunct`` and ``q2nopunct``."""
    return df.withColumns(
        {
            "q1nopunct": T.clean_text(F.col("question1")),
            "q2nopunct": T.clean_text(F.col("question2")),
        }
    ).drop("question1", "question2")


def count_features(df: DataFrame) -> DataFrame:
    """Word and character counts of the cleaned texts."""
    return df.withColumns(
        {
            "tr_q1WrdCnt": T.word_count(F.col("q1nopunct")),
            "tr_q2WrdCnt": T.word_count(F.col("q2nopunct")),
            "tr_q1Len": T.char_count(F.col("q1nopunct")),
            "tr_q2Len": T.char_count(F.col("q2nopunct")),
        }
    )


def overlap_feature(df: DataFrame) -> DataFrame:
    """Share of matching content words."""
    # the word sets are columns of their own, so that they are computed once
    words = {f"_words{s}": T.content_words(F.col(f"q{s}nopunct")) for s in (1, 2)}
    share = T.token_share(F.col("_words1"), F.col("_words2"))
    return df.withColumns(words).withColumn("wrdmatchpct", share).drop(*words)


def basic_features(df: DataFrame) -> DataFrame:
    """Cleaned texts, counts and overlap of a pair table."""
    return overlap_feature(count_features(clean_pairs(df)))


def zscore(df: DataFrame, columns: list[str], digits: int = 5) -> DataFrame:
    """Add ``<column>_zscore``: distance from the mean in population standard deviations."""
    stats = df.agg(
        F.struct(
            *[F.avg(c).alias(f"{c}_mean") for c in columns],
            *[F.stddev_pop(c).alias(f"{c}_std") for c in columns],
        ).alias("s")
    )
    with_stats = df.withColumn("_s", stats.scalar())
    return with_stats.withColumns(
        {
            f"{c}_zscore": F.bround(
                (F.col(c) - F.col(f"_s.{c}_mean")) / F.nullif(F.col(f"_s.{c}_std"), F.lit(0.0)),
                digits,
            )
            for c in columns
        }
    ).drop("_s")


def fit_minmax(df: DataFrame, columns: list[str] = SCALED_FROM) -> DataFrame:
    """One row with the minimum and maximum of each column; save it to apply it elsewhere."""
    return df.agg(
        *[F.min(c).cast("double").alias(f"{c}_min") for c in columns],
        *[F.max(c).cast("double").alias(f"{c}_max") for c in columns],
    )


def apply_minmax(
    df: DataFrame,
    fitted: DataFrame,
    columns: list[str] = SCALED_FROM,
    lo: float = 0.0,
    hi: float = 1.0,
) -> DataFrame:
    """Add ``scaled_0..`` with the fitted range mapped to ``lo..hi``; a constant maps to ``lo``."""
    with_stats = df.withColumn("_s", fitted.select(F.struct("*")).scalar())
    scaled = {}
    for i, c in enumerate(columns):
        low, high = F.col(f"_s.{c}_min"), F.col(f"_s.{c}_max")
        span = F.when(high > low, high - low).otherwise(F.lit(1.0))
        scaled[f"scaled_{i}"] = lo + (F.col(c) - low) * (hi - lo) / span
    return with_stats.withColumns(scaled).drop("_s")


def minmax(df: DataFrame, columns: list[str], lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Fit and apply on the same table."""
    return apply_minmax(df, fit_minmax(df, columns), columns, lo, hi)


def variance_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Population variance of each column, one row per column, from one aggregate."""
    row = df.agg(*[F.var_pop(F.col(c).cast("double")).alias(c) for c in columns])
    entries = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("variance")) for c in columns]
    )
    return row.select(F.inline(entries))


def low_variance(df: DataFrame, columns: list[str], threshold: float = 0.01) -> DataFrame:
    """Columns whose population variance is at most ``threshold``."""
    return variance_report(df, columns).where(F.col("variance") <= threshold)


def drop_low_variance(
    df: DataFrame, columns: list[str], threshold: float = 0.01, skip: list[str] = ()
) -> DataFrame:
    """The table without its low-variance columns; columns of ``skip`` always stay."""
    tested = [c for c in columns if c not in skip]
    # one value per column name reaches the driver: the new schema depends on it
    removed = [r["column"] for r in low_variance(df, tested, threshold).collect()]
    return df.drop(*removed)


def feature_vector(df: DataFrame, name: str = "features") -> DataFrame:
    """Model input: the grid, three scores and ``scaled_1..scaled_5`` as one vector.

    Without the length that ``similarity_grid`` notes in its column, a row would be computed for it,
    and with it all stages below.
    """
    tail = [*SCORE_COLUMNS, *[f"scaled_{i}" for i in range(1, 6)]]
    size = df.schema["grid"].metadata.get("size")
    about = {"ml_attr": {"num_attrs": size}} if size else {}
    vector = array_to_vector(F.col("grid").cast("array<double>"))
    as_vector = df.withColumn("_grid", vector.alias("_grid", metadata=about))
    assembler = VectorAssembler(inputCols=["_grid", *tail], outputCol=name, handleInvalid="error")
    return assembler.transform(as_vector).drop("_grid")
