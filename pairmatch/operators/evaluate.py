"""Evaluation tables for predicted probabilities ``p`` and a 0/1 label ``y``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmatch.operators.rows import global_row_number


def predicted(p: str = "p") -> Column:
    """Class of a probability."""
    return (F.col(p) >= 0.5).cast("int")


def accuracy(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Share of right classes, in percent with two decimals."""
    right = (predicted(p) == F.col(y)).cast("double")
    return df.agg(F.bround(F.avg(right) * 100, 2).alias("accuracy_pct"))


def log_loss(df: DataFrame, p: str = "p", y: str = "y", eps: float = 1e-15) -> DataFrame:
    """Mean negative log likelihood; probabilities are clipped to [eps, 1-eps]."""
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col(p)))
    loss = -F.when(F.col(y) == 1, F.log(q)).otherwise(F.log(1 - q))
    return df.agg(F.avg(loss).alias("log_loss"))


def _cells(df: DataFrame, p: str, y: str) -> DataFrame:
    c, t = predicted(p), F.col(y)
    return df.agg(
        F.count_if((c == 1) & (t == 1)).alias("tp"),
        F.count_if((c == 0) & (t == 0)).alias("tn"),
        F.count_if((c == 1) & (t == 0)).alias("fp"),
        F.count_if((c == 0) & (t == 1)).alias("fn"),
    )


def confusion_matrix(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Counts of the four (label, class) cells, empty cells included."""
    cells = F.array(
        *[
            F.struct(F.lit(t).alias("label"), F.lit(c).alias("predicted"), F.col(n).alias("n"))
            for t, c, n in [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
        ]
    )
    return _cells(df, p, y).select(F.inline(cells))


def precision_recall_f1(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Precision, recall, F1 and support of both classes; null on division by zero."""

    def scores(cls: int, hit: str, false: str, missed: str) -> Column:
        h, f, m = F.col(hit), F.col(false), F.col(missed)
        precision, recall = h / F.nullif(h + f, F.lit(0)), h / F.nullif(h + m, F.lit(0))
        f1 = 2 * precision * recall / F.nullif(precision + recall, F.lit(0.0))
        return F.struct(
            F.lit(cls).alias("class"), precision.alias("precision"), recall.alias("recall"),
            f1.alias("f1"), (h + m).alias("support"),
        )

    rows = F.array(scores(0, "tn", "fn", "fp"), scores(1, "tp", "fp", "fn"))
    return _cells(df, p, y).select(F.inline(rows))


def batched_accuracy(
    df: DataFrame, size: int = 250, key: str = "id", p: str = "p", y: str = "y", every: int = 1
) -> DataFrame:
    """Accuracy of consecutive batches in key order; ``every`` keeps each n-th batch."""
    numbered = global_row_number(df.select(key, p, y), key)
    batch = F.floor((F.col("rn") - 1) / size)
    right = (predicted(p) == F.col(y)).cast("double")
    out = numbered.groupBy(batch.alias("batch")).agg(
        F.count("*").alias("n"), F.avg(right).alias("accuracy")
    )
    return out.where(F.col("batch") % every == 0)
