"""Principal components and linear discriminants of feature tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PcaFit:
    """Standardisation and projection, and how much variance the components keep."""

    pipeline: PipelineModel
    k: int

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``pca_0..pca_k-1``; the sign of a component is free."""
        projected = self.pipeline.transform(_with_vector(df))
        values = projected.withColumn("_a", vector_to_array("_pca"))
        return values.withColumns({f"pca_{i}": F.col("_a")[i] for i in range(self.k)}).drop(
            "_raw", "_std", "_pca", "_a"
        )


def _with_vector(df: DataFrame, grid: str = "grid") -> DataFrame:
    return df.withColumn("_raw", array_to_vector(F.col(grid).cast("array<double>")))


def fit_pca(df: DataFrame, k: int = 10, standardise: bool = True) -> PcaFit:
    """Fit principal components of the ``grid`` column."""
    scaler = StandardScaler(
        withMean=standardise, withStd=standardise, inputCol="_raw", outputCol="_std"
    )
    pca = PCA(k=k, inputCol="_std", outputCol="_pca")
    return PcaFit(Pipeline(stages=[scaler, pca]).fit(_with_vector(df)), k)


def pca_features(df: DataFrame, k: int = 10) -> DataFrame:
    """Fit on the table and add its components."""
    return fit_pca(df, k).transform(df)


def explained_variance(projected: DataFrame, k: int, fit: PcaFit) -> DataFrame:
    """``(component, variance, ratio)``: scree data from the projections."""
    ratios = fit.pipeline.stages[-1].explainedVariance.toArray()
    row = projected.agg(*[F.var_pop(f"pca_{i}").alias(f"pca_{i}") for i in range(k)])
    entries = [
        F.struct(
            F.lit(i).alias("component"), F.col(f"pca_{i}").alias("variance"),
            F.lit(float(ratios[i])).alias("ratio"),
        )
        for i in range(k)
    ]
    return row.select(F.inline(F.array(*entries)))


def component_points(projected: DataFrame, label: str = "is_duplicate") -> DataFrame:
    """First two components and the class of each row."""
    return projected.select(
        "id", F.col("pca_0").alias("PC1"), F.col("pca_1").alias("PC2"),
        F.col(label).alias("class"),
    )


@dataclass(frozen=True)
class Discriminant:
    """Two-class linear discriminant: coefficients, midpoint and log prior odds."""

    columns: list[str]
    weights: list[float]
    scalings: list[float]
    offset: float
    centre: float

    def coefficients(self) -> dict[str, float]:
        """Coefficient of the discriminant per column (unit within-class variance)."""
        return dict(zip(self.columns, self.scalings))

    def transform(self, df: DataFrame) -> DataFrame:
        """Add the score ``LD1``, the posterior of class 1 and the class."""

        def linear(coefficients):
            terms = [
                F.col(c).cast("double") * w for c, w in zip(self.columns, coefficients)
            ]
            return sum(terms[1:], terms[0])

        odds = linear(self.weights) + F.lit(self.offset)
        scored = df.withColumn("LD1", linear(self.scalings) - F.lit(self.centre))
        scored = scored.withColumn("posterior_1", 1 / (1 + F.exp(-odds)))
        return scored.withColumn("class", (F.col("posterior_1") >= 0.5).cast("int"))


def fit_discriminant(
    df: DataFrame, columns: list[str], label: str = "is_duplicate", ridge: float = 1e-9
) -> Discriminant:
    """Fit from class means and pooled covariance.

    One aggregate yields counts, means and co-moments per class, two rows of d*d numbers; the
    d x d system is solved on the driver. Use it for some tens of columns. Rows without a label
    are left out; a class without rows is refused.
    """
    d = len(columns)
    cast = {c: F.col(c).cast("double") for c in columns}
    moments = [
        F.covar_pop(cast[a], cast[b]).alias(f"c_{i}_{j}")
        for i, a in enumerate(columns)
        for j, b in enumerate(columns)
        if i <= j
    ]
    stats = (
        df.where(F.col(label).isNotNull())
        .groupBy(label)
        .agg(F.count("*").alias("n"), *[F.avg(cast[c]).alias(f"m_{c}") for c in columns], *moments)
        .collect()
    )
    rows = {int(r[label]): r for r in stats}
    if missing := {0, 1} - set(rows):
        raise ValueError(f"no rows of class {missing}: both are needed")
    n = {k: r["n"] for k, r in rows.items()}
    total = n[0] + n[1]
    mean = {k: np.array([r[f"m_{c}"] for c in columns]) for k, r in rows.items()}
    pooled = np.zeros((d, d))
    for k, r in rows.items():
        for i in range(d):
            for j in range(i, d):
                pooled[i, j] += n[k] * r[f"c_{i}_{j}"]
                pooled[j, i] = pooled[i, j]
    pooled = pooled / (total - 2) + ridge * np.eye(d)
    weights = np.linalg.solve(pooled, mean[1] - mean[0])
    offset = -0.5 * (mean[1] + mean[0]) @ weights + np.log(n[1] / n[0])
    scalings = weights / np.sqrt(weights @ pooled @ weights)
    overall = (n[0] * mean[0] + n[1] * mean[1]) / total
    return Discriminant(
        list(columns), weights.tolist(), scalings.tolist(), float(offset),
        float(overall @ scalings),
    )
