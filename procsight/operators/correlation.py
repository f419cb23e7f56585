"""Correlation structure: matrices, blocks, redundancy and class breakdowns."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procsight import LABEL
from procsight.functions.columns import feature_number, feature_table, with_position

# Cut-offs of the correlation reports, and the feature-number limits of the stages.
HIGH_CORRELATION = 0.8
REDUNDANT_CORRELATION = 0.7
BREAKDOWN_CHANGE = 0.3
STAGE_LIMITS = {"Furnace": 12, "Rolling": 24, "Cooling": 36, "Control": 42}
LAST_STAGE = "Other"


def co_moments(df: DataFrame, features: list[str], label: str | None = None) -> DataFrame:
    """Co-moments of every feature pair, optionally per class, in one scan.

    (label, i, j, n, mean_i, mean_j, c_ii, c_jj, c_ij) with i < j, over the rows
    where both features are present. Each task turns its batches into one p x p
    matrix product, centred on its own first rows, so that large magnitudes do
    not cancel; the partial matrices (p(p-1)/2 rows per task and class) are then
    merged by an ordinary aggregation.
    """
    size = len(features)
    first, second = np.triu_indices(size, k=1)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shift, sums = None, {}
        for batch in batches:
            for value, rows in batch.groupby("grp", dropna=False) if len(batch) else ():
                x = rows[features].to_numpy(dtype=float)
                present = ~np.isnan(x)
                if shift is None:
                    counts = present.sum(axis=0)
                    shift = np.where(present, x, 0.0).sum(axis=0) / np.maximum(counts, 1)
                x = np.where(present, x - shift, 0.0)
                here = present.astype(float)
                parts = np.stack([here.T @ here, x.T @ here, (x * x).T @ here, x.T @ x])
                sums[value] = sums[value] + parts if value in sums else parts
        for value, (n, s, q, xy) in sums.items():
            count = n[first, second]
            safe = np.maximum(count, 1)
            s_i, s_j = s[first, second], s[second, first]
            yield pd.DataFrame(
                {
                    "grp": value,
                    "i": first,
                    "j": second,
                    "n": count.astype("int64"),
                    "mean_i": shift[first] + s_i / safe,
                    "mean_j": shift[second] + s_j / safe,
                    "c_ii": q[first, second] - s_i * s_i / safe,
                    "c_jj": q[second, first] - s_j * s_j / safe,
                    "c_ij": xy[first, second] - s_i * s_j / safe,
                }
            ).query("n > 0")

    group = F.col(label).cast("int") if label else F.lit(0)
    schema = (
        "grp int, i int, j int, n bigint, mean_i double, mean_j double, "
        "c_ii double, c_jj double, c_ij double"
    )
    parts = df.select(
        group.alias("grp"), *[F.col(c).cast("double").alias(c) for c in features]
    ).mapInPandas(partial, schema)
    # Merging centred parts: inner co-moments plus those of the part means.
    pair = Window.partitionBy("grp", "i", "j")
    n = F.sum("n").over(pair)
    away_i = F.col("mean_i") - F.sum(F.col("n") * F.col("mean_i")).over(pair) / n
    away_j = F.col("mean_j") - F.sum(F.col("n") * F.col("mean_j")).over(pair) / n
    return (
        parts.withColumns({"away_i": away_i, "away_j": away_j})
        .groupBy("grp", "i", "j")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("c_ii") + F.col("n") * F.col("away_i") * F.col("away_i")).alias("c_ii"),
            F.sum(F.col("c_jj") + F.col("n") * F.col("away_j") * F.col("away_j")).alias("c_jj"),
            F.sum(F.col("c_ij") + F.col("n") * F.col("away_i") * F.col("away_j")).alias("c_ij"),
        )
    )


def _pearson(moments: DataFrame) -> DataFrame:
    spread = F.sqrt(F.col("c_ii")) * F.sqrt(F.col("c_jj"))
    bounded = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(F.col("c_ij"), spread)))
    enough = (F.col("c_ii") > 0) & (F.col("c_jj") > 0) & (F.col("n") > 1)
    return moments.withColumn("r", F.when(enough, bounded))


def correlation_pairs(df: DataFrame, features: list[str], label: str | None = None) -> DataFrame:
    """(label, feature_1, feature_2, position_1, position_2, r) for position_1 < position_2."""
    names = F.array(*[F.lit(c) for c in features])
    rows = _pearson(co_moments(df, features, label)).select(
        F.col("grp").alias(label or "grp"),
        F.element_at(names, F.col("i") + 1).alias("feature_1"),
        F.element_at(names, F.col("j") + 1).alias("feature_2"),
        F.col("i").alias("position_1"),
        F.col("j").alias("position_2"),
        "r",
    )
    return rows if label else rows.drop("grp")


def full_matrix(pairs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Both triangles of the matrix from its upper one (without the diagonal)."""
    keep = keep or []
    ends = F.array(
        F.struct(F.col("feature_1").alias("feature_1"), F.col("feature_2").alias("feature_2")),
        F.struct(F.col("feature_2").alias("feature_1"), F.col("feature_1").alias("feature_2")),
    )
    return pairs.select(*keep, F.explode(ends).alias("ends"), "r").select(*keep, "ends.*", "r")


def correlation_matrix(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature_1, feature_2, r): the whole matrix in long form, diagonal included."""
    diagonal = feature_table(df, features).select(
        F.col("feature").alias("feature_1"), F.col("feature").alias("feature_2"), F.lit(1.0).alias("r")
    )
    return full_matrix(correlation_pairs(df, features)).unionByName(diagonal)


def correlation_by_class(df: DataFrame, features: list[str], label: str = LABEL) -> DataFrame:
    """(label, feature_1, feature_2, r): the whole matrix of each class in long form, diagonal included."""
    pairs = correlation_pairs(df, features, label).select(label, "feature_1", "feature_2", "r")
    mirrored = pairs.select(label, F.col("feature_2").alias("feature_1"), F.col("feature_1").alias("feature_2"), "r")
    names = F.explode(F.array(*[F.lit(c) for c in features])).alias("feature_1")
    # One row per class.
    diagonal = df.groupBy(label).agg(F.lit(1.0).alias("r")).select(label, names, "r")
    same = diagonal.select(label, "feature_1", F.col("feature_1").alias("feature_2"), "r")
    return pairs.unionByName(mirrored).unionByName(same)


def high_correlation_pairs(
    df: DataFrame, features: list[str], cut: float = HIGH_CORRELATION
) -> DataFrame:
    """Pairs with |r| above the cut, strongest first."""
    return (
        correlation_pairs(df, features)
        .filter(F.abs("r") > cut)
        .orderBy(F.desc(F.abs("r")), "position_1", "position_2")
        .select("feature_1", "feature_2", "r")
    )


def feature_blocks(
    df: DataFrame, features: list[str], cut: float = HIGH_CORRELATION, mode: str = "greedy"
) -> DataFrame:
    """(feature, block): groups of strongly correlated features.

    'greedy' walks the pairs from the strongest down: a pair of two unassigned
    features opens a block, otherwise the second feature follows the first if
    that one is assigned, else the first follows the second. 'components' gives
    the connected components. Both read at most p(p-1)/2 pairs.
    """
    pairs = [
        (row["feature_1"], row["feature_2"])
        for row in high_correlation_pairs(df, features, cut).collect()
    ]
    rows = list(assign_blocks(pairs, merge=mode == "components").items())
    return df.sparkSession.createDataFrame(rows, "feature string, block int")


def assign_blocks(pairs: list[tuple[str, str]], merge: bool = False) -> dict[str, int]:
    """Block number per feature from ordered pairs; with `merge`, meeting blocks become one."""
    block: dict[str, int] = {}
    for one, other in pairs:
        home = block.get(one, block.get(other, len(block)))
        if merge:
            left = block.get(other, home)
            block = {f: home if b == left else b for f, b in block.items()}
        block[one] = block[other] = home
    # Blocks are numbered in the order in which their features came up.
    number = {home: place for place, home in enumerate(dict.fromkeys(block.values()))}
    return {feature: number[home] for feature, home in block.items()}


def process_stages(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, stage), by the number in the feature name."""
    number = feature_number(F.col("feature"))
    # The limits ascend, so the first one that holds names the stage.
    stages = [F.when(number <= limit, name) for name, limit in STAGE_LIMITS.items()]
    stage = F.coalesce(*stages, F.lit(LAST_STAGE))
    return feature_table(df, features).select("feature", stage.alias("stage"))


def stage_sizes(df: DataFrame, features: list[str]) -> DataFrame:
    """(stage, n)."""
    return process_stages(df, features).groupBy("stage").agg(F.count("*").alias("n"))


def redundancy(df: DataFrame, features: list[str], cut: float = REDUNDANT_CORRELATION) -> DataFrame:
    """Per feature: strongly correlated partners, largest and mean |r|, and the risk class."""
    strength = F.abs("r")
    report = (
        full_matrix(correlation_pairs(df, features))
        .groupBy(F.col("feature_1").alias("feature"))
        .agg(
            F.count_if(strength > cut).alias("highly_correlated_pairs"),
            F.max(strength).alias("max_correlation"),
            F.avg(strength).alias("avg_correlation"),
        )
        .withColumn(
            "redundancy_risk",
            F.when(F.col("highly_correlated_pairs") > 3, "HIGH")
            .when(F.col("highly_correlated_pairs") > 1, "MEDIUM")
            .otherwise("LOW"),
        )
    )
    return (
        with_position(report, features)
        .orderBy(F.desc_nulls_last("max_correlation"), "position")
        .drop("position")
    )


def redundancy_counts(df: DataFrame, features: list[str]) -> DataFrame:
    """(redundancy_risk, n)."""
    return redundancy(df, features).groupBy("redundancy_risk").agg(F.count("*").alias("n"))


def correlation_breakdowns(
    df: DataFrame, features: list[str], label: str = LABEL, change: float = BREAKDOWN_CHANGE
) -> DataFrame:
    """Pairs whose correlation differs between the classes by more than `change`, largest first."""
    both = (
        correlation_pairs(df, features, label)
        .groupBy("feature_1", "feature_2", "position_1", "position_2")
        .agg(
            F.max(F.when(F.col(label) == 0, F.col("r"))).alias("normal_correlation"),
            F.max(F.when(F.col(label) == 1, F.col("r"))).alias("defect_correlation"),
        )
    )
    return (
        both.withColumn(
            "correlation_change", F.abs(F.col("normal_correlation") - F.col("defect_correlation"))
        )
        .filter(F.col("correlation_change") > change)
        .orderBy(F.desc("correlation_change"), "position_1", "position_2")
        .drop("position_1", "position_2")
    )


def top_k(report: DataFrame, order: list, k: int = 10) -> DataFrame:
    """The first k rows of a report under the given order (which should end in a unique column)."""
    return report.orderBy(*order).limit(k)
