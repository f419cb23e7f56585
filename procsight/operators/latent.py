"""Scaling, clusters, principal components and operating regimes."""

from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procsight import KEY, LABEL
from procsight.functions.columns import long_form, total
from procsight.operators.correlation import correlation_pairs
from procsight.operators.quantiles import exact_quantiles
from procsight.operators.sampling import SEED

LEAST_DEFECTS = 5
CLUSTERS = 3


def standardize(df: DataFrame, features: list[str]) -> DataFrame:
    """z-scores with the population deviation; a constant feature becomes 0."""
    return scale(df, features, "standard")


def scale(df: DataFrame, features: list[str], method: str = "standard") -> DataFrame:
    """'standard': (x - mean) / deviation; 'minmax': onto 0..1; 'robust': (x - median) / quartile range."""
    if method == "robust":
        q = exact_quantiles(df, features, [0.25, 0.5, 0.75])
        marks = {c: (q[(c,)][1], q[(c,)][2] - q[(c,)][0]) for c in features}
    elif method in ("standard", "minmax"):
        centre, width = (
            (F.avg, F.stddev_pop) if method == "standard" else (F.min, lambda c: F.max(c) - F.min(c))
        )
        row = df.agg(
            *[centre(c).alias(f"c_{c}") for c in features],
            *[width(c).alias(f"w_{c}") for c in features],
        ).first()
        marks = {c: (row[f"c_{c}"], row[f"w_{c}"]) for c in features}
    else:
        raise ValueError(f"unknown method: {method}")
    return df.withColumns(
        {c: (F.col(c) - F.lit(low)) / F.lit(span if span else 1.0) for c, (low, span) in marks.items()}
    )


def defect_clusters(
    df: DataFrame,
    features: list[str],
    label: str = LABEL,
    k: int = CLUSTERS,
    seed: int = SEED,
) -> DataFrame:
    """(cluster, n, pct) of K-means on the scaled defect rows; empty unless there are more than five."""
    defects = df.filter(F.col(label) == 1).select(*features)
    n = defects.count()
    if n <= LEAST_DEFECTS:
        return df.sparkSession.createDataFrame([], "cluster int, n bigint, pct double")
    scaled = standardize(defects, features)
    means = KMeans(k=min(k, n), seed=seed, featuresCol="__point", predictionCol="cluster")
    points = VectorAssembler(inputCols=features, outputCol="__point")
    model = Pipeline(stages=[points, means]).fit(scaled)
    sizes = model.transform(scaled).groupBy("cluster").agg(F.count("*").alias("n"))
    return sizes.withColumn("pct", F.col("n") / n * 100).orderBy("cluster")


@dataclass
class Components:
    """Principal components of the scaled features; `loadings[i]` belongs to component i."""

    features: list[str]
    mean: np.ndarray
    spread: np.ndarray
    ratios: np.ndarray
    loadings: np.ndarray

    def project(self, k: int) -> dict[str, Column]:
        """pc1..pck as plain projections: a weighted sum of the features and a constant."""
        weights = self.loadings[:k] / self.spread
        columns = {}
        for i, row in enumerate(weights):
            terms = [f"{c} * ({float(w)!r}D)" for c, w in zip(self.features, row)]
            columns[f"pc{i + 1}"] = total([*terms, f"({float(-(row @ self.mean))!r}D)"])
        return columns


def fit_pca(df: DataFrame, features: list[str]) -> Components:
    """Components of the scaled features: the eigenvectors of their correlation matrix.

    The matrix (p x p) is one distributed aggregation; only its decomposition
    happens on the driver. A component's sign is chosen so that its largest
    loading is positive. Constant features do not take part.
    """
    size = len(features)
    marks = {
        row["feature"]: row
        for row in long_form(df, features, [])
        .groupBy("feature")
        .agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("spread"))
        .collect()
    }
    mean = np.array([marks[c]["mean"] for c in features])
    spread = np.array([marks[c]["spread"] for c in features])
    matrix = np.diag((spread > 0).astype(float))
    for row in correlation_pairs(df, features).filter(F.col("r").isNotNull()).collect():
        matrix[row["position_1"], row["position_2"]] = row["r"]
        matrix[row["position_2"], row["position_1"]] = row["r"]
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(values)[::-1]
    values, loadings = np.clip(values[order], 0, None), vectors[:, order].T
    largest = np.abs(loadings).argmax(axis=1)
    loadings = loadings * np.sign(loadings[np.arange(size), largest])[:, None]
    return Components(features, mean, np.where(spread > 0, spread, 1.0), values / values.sum(), loadings)


def pca_profile(df: DataFrame, features: list[str]) -> DataFrame:
    """(component, variance_ratio, cumulative), one row per component, 1-based."""
    rows = [(i + 1, float(r)) for i, r in enumerate(fit_pca(df, features).ratios)]
    table = df.sparkSession.createDataFrame(rows, "component int, variance_ratio double")
    # One row per feature.
    running = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    return table.withColumn("cumulative", F.sum("variance_ratio").over(running))


def components_needed(profile: DataFrame, shares: tuple = (0.80, 0.95)) -> DataFrame:
    """(share, components): the first component count that reaches each share."""
    reached = F.array(*[F.lit(s) for s in shares])
    return (
        profile.withColumn("share", F.explode(reached))
        .filter(F.col("cumulative") >= F.col("share"))
        .groupBy("share")
        .agg(F.min("component").alias("components"))
    )


def pca_project(
    df: DataFrame, features: list[str], k: int = 3, keep: tuple = (KEY, LABEL)
) -> DataFrame:
    """The kept columns and pc1..pck of every row."""
    columns = fit_pca(df, features).project(k)
    return df.select(*keep, *[column.alias(name) for name, column in columns.items()])


def pca_features(df: DataFrame, features: list[str], k: int = 18) -> DataFrame:
    """The table with k component columns added."""
    return df.withColumns(fit_pca(df, features).project(k))


def assign_regimes(
    df: DataFrame,
    features: list[str],
    k: int = CLUSTERS,
    components: int = 3,
    seed: int = SEED,
    keep: tuple = (KEY, LABEL),
) -> DataFrame:
    """The kept columns, pc1..pc3 and the regime of every row: K-means on the leading components."""
    projected = pca_project(df, features, components, keep)
    names = [f"pc{i + 1}" for i in range(components)]
    means = KMeans(k=k, seed=seed, featuresCol="__point", predictionCol="regime")
    model = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="__point"), means]).fit(projected)
    return model.transform(projected).drop("__point")


def operating_regimes(
    df: DataFrame,
    features: list[str],
    label: str = LABEL,
    k: int = CLUSTERS,
    seed: int = SEED,
    keep: tuple | None = None,
) -> DataFrame:
    """(regime, n, defect_rate_pct)."""
    rows = assign_regimes(df, features, k, seed=seed, keep=keep or (label,))
    return (
        rows.groupBy("regime")
        .agg(
            F.count("*").alias("n"),
            (F.count_if(F.col(label) == 1) / F.count("*") * 100).alias("defect_rate_pct"),
        )
        .orderBy("regime")
    )
