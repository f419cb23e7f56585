"""Engineered features: row-wise projections, two published sets.

Set 1 adds 44 columns in 12 families, set 2 adds 15 columns in 5 groups. Both
are pure projections; the training statistics some families need are fitted
once (a bounded number of scalars) and enter the plan as literals.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procsight import LABEL
from procsight.functions.columns import (
    feature_columns,
    finite_or_zero,
    long_form,
    safe_divide,
    total,
)
from procsight.operators.quantiles import exact_quantiles

# The feature choices of both sets.
SET1_PRODUCTS = [
    ("X35", "X41"), ("X29", "X41"), ("X30", "X41"), ("X31", "X41"), ("X32", "X41"),
    ("X13", "X41"), ("X36", "X13"), ("X36", "X35"), ("X13", "X30"),
]
SET1_RATIOS = [("X36", "X35"), ("X35", "X41"), ("X13", "X30"), ("X32", "X30"), ("X34", "X35")]
SET1_DIFFERENCES = [("X35", "X34"), ("X36", "X35"), ("X31", "X30"), ("X13", "X10"), ("X42", "X41")]
BLOCKS = {
    "Furnace": [1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 12],
    "Rolling": [10, 13, 14, 16, 17, 18, 19, 20],
    "Cooling": [25, 26, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36],
    "Control": [37, 38, 39, 40, 41, 42],
    "Other": [43, 44, 45, 46, 47, 48, 49],
}
REGIME_FEATURES = ["X36", "X13", "X14", "X16", "X35"]
LIMITS = {"X13": 1032.32, "X10": 9.83, "X32": 17.15, "X36": 178.0, "X30": 12.17}
SECONDARY = ["X10", "X13", "X14", "X16"]
SET2_INTERACTIONS = [("X29", "X41"), ("X30", "X41"), ("X31", "X41"), ("X32", "X41"), ("X13", "X41")]
EPSILON = 1e-6
EXTREME = 3.0


@dataclass
class TrainStatistics:
    """Scalars fitted on the training table."""

    mean: dict[str, float]
    spread: dict[str, float]
    normal_mean: dict[str, float]
    normal_spread: dict[str, float]
    quartiles: dict[str, list[float]]


def fit_statistics(
    train: DataFrame, features: list[str] | None = None, label: str = LABEL
) -> TrainStatistics:
    """Means, population deviations (all rows and normal rows) and the regime quartiles."""
    features = features or feature_columns(train)
    normal = F.when(F.col(label) == 0, F.col("value"))
    fitted = (
        long_form(train, features, [label])
        .groupBy("feature")
        .agg(
            F.avg("value").alias("mean"),
            F.stddev_pop("value").alias("spread"),
            F.avg(normal).alias("normal_mean"),
            F.stddev_pop(normal).alias("normal_spread"),
        )
        .collect()
    )
    regime = [c for c in REGIME_FEATURES if c in features]
    quartiles = exact_quantiles(train, regime, [0.25, 0.75]) if regime else {}

    def scalars(name: str) -> dict[str, float]:
        return {row["feature"]: row[name] for row in fitted}

    return TrainStatistics(
        scalars("mean"),
        scalars("spread"),
        scalars("normal_mean"),
        scalars("normal_spread"),
        {feature: q for (feature,), q in quartiles.items()},
    )


def interaction_product(pairs: list[tuple[str, str]]) -> dict[str, Column]:
    return {f"{a}x{b}": F.col(a) * F.col(b) for a, b in pairs}


def safe_ratio(
    pairs: list[tuple[str, str]], eps: float = 0.0, sign: str = "div"
) -> dict[str, Column]:
    return {f"{a}{sign}{b}": safe_divide(F.col(a), F.col(b) + F.lit(eps)) for a, b in pairs}


def difference(pairs: list[tuple[str, str]], sign: str = "sub") -> dict[str, Column]:
    return {f"{a}{sign}{b}": F.col(a) - F.col(b) for a, b in pairs}


def row_mean(features: list[str]) -> Column:
    return total(features) / len(features)


def row_std(features: list[str], mean: str) -> Column:
    """Population deviation across the features of one row, given the name of their mean."""
    return F.sqrt(total([f"({c} - {mean}) * ({c} - {mean})" for c in features]) / len(features))


def row_instability(mean: Column, std: Column) -> Column:
    return finite_or_zero(F.try_divide(std, F.abs(mean) + EPSILON))


def with_row_stats(df: DataFrame, features: list[str], extremes: bool = True) -> DataFrame:
    """row_mean and row_std, and row_max and row_min if asked for."""
    df = df.withColumn("row_mean", row_mean(features))
    df = df.withColumn("row_std", row_std(features, "row_mean"))
    if extremes:
        columns = [F.col(c) for c in features]
        df = df.withColumns({"row_max": F.greatest(*columns), "row_min": F.least(*columns)})
    return df


def blocks_present(features: list[str]) -> dict[str, list[str]]:
    named = {block: [f"X{i}" for i in numbers if f"X{i}" in features] for block, numbers in BLOCKS.items()}
    return {block: names for block, names in named.items() if names}


def with_block_stats(df: DataFrame, features: list[str]) -> DataFrame:
    """Mean and population deviation over the columns of each block."""
    blocks = blocks_present(features)
    df = df.withColumns({f"{block}_mean": row_mean(names) for block, names in blocks.items()})
    return df.withColumns(
        {f"{block}_std": row_std(names, f"{block}_mean") for block, names in blocks.items()}
    )


def block_divergence(features: list[str]) -> dict[str, Column]:
    """Deviation of the values from their block mean: the block's own deviation, which does not
    change when a constant is taken off."""
    blocks = blocks_present(features)
    return {
        f"{block}_divergence": F.col(f"{block}_std") for block, names in blocks.items() if len(names) > 1
    }


def literal(value: float | None) -> str:
    """A double as SQL text; a statistic that does not exist is null."""
    return "CAST(NULL AS DOUBLE)" if value is None else f"({float(value)!r}D)"


def anomaly_distance(features: list[str], stats: TrainStatistics) -> Column:
    """Mean absolute standard score against the normal training rows."""
    return _standard_scores(features, stats.normal_mean, stats.normal_spread, "{0}") / len(features)


def _standard_scores(
    features: list[str], mean: dict[str, float], spread: dict[str, float], term: str
) -> Column:
    """Sum of `term` over the absolute standard scores of the features."""
    scores = [
        f"abs(({c} - {literal(mean[c])}) / ({literal(spread[c])} + {literal(EPSILON)}))" for c in features
    ]
    return total([term.format(score) for score in scores])


def regime_anomaly(stats: TrainStatistics) -> Column:
    """Mean distance from the middle of the training quartiles, in quartile ranges."""
    terms = [
        f"abs({c} - {literal((low + high) / 2)}) / {literal(high - low + EPSILON)}"
        for c, (low, high) in stats.quartiles.items()
    ]
    return total(terms) / len(terms)


def threshold_count(features: list[str], limits: dict[str, float] | None = None) -> Column:
    """How many of the given limits are exceeded."""
    limits = limits or LIMITS
    return total(["0", *[f"int({c} > {literal(v)})" for c, v in limits.items() if c in features]])


def extreme_count(features: list[str], stats: TrainStatistics) -> Column:
    """How many features lie more than three deviations from the training mean."""
    return _standard_scores(features, stats.mean, stats.spread, f"int({{0}} > {literal(EXTREME)})")


def secondary_mean(features: list[str]) -> Column:
    return row_mean([c for c in SECONDARY if c in features])


def features_set1(df: DataFrame, stats: TrainStatistics, features: list[str] | None = None) -> DataFrame:
    """The table plus the 44 columns of set 1."""
    features = features or feature_columns(df)
    out = df.withColumns(
        interaction_product(SET1_PRODUCTS) | safe_ratio(SET1_RATIOS) | difference(SET1_DIFFERENCES)
    )
    out = with_row_stats(out, features)
    out = out.withColumns(
        {
            "instability": row_instability(F.col("row_mean"), F.col("row_std")),
            "imbalance": F.col("row_max") - F.col("row_min"),
        }
    )
    out = with_block_stats(out, features)
    out = out.withColumns(
        {
            "anomaly_distance": anomaly_distance(features, stats),
            "regime_anomaly": regime_anomaly(stats),
            "threshold_count": threshold_count(features),
            "extreme_count": extreme_count(features, stats),
            **block_divergence(features),
        }
    )
    return out.select(*df.columns, *set1_registry(features))


def features_set2(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """The table plus the 15 columns of set 2; needs no training statistics."""
    features = features or feature_columns(df)
    out = df.withColumns(
        safe_ratio([("X36", "X35"), ("X36", "X34"), ("X35", "X34")], EPSILON, "/")
        | interaction_product([("X36", "X41"), ("X35", "X41"), *SET2_INTERACTIONS])
        | difference([("X34", "X36")], "-")
    )
    out = with_row_stats(out, features, extremes=False)
    out = out.withColumns(
        {
            "instability": row_instability(F.col("row_mean"), F.col("row_std")),
            "rolling_mean": secondary_mean(features),
        }
    )
    return out.select(*df.columns, *set2_registry())


def set1_registry(features: list[str]) -> dict[str, str]:
    """Name -> type of the set 1 columns, in order."""
    blocks = blocks_present(features)
    names = {f"{a}x{b}": "interaction_mult" for a, b in SET1_PRODUCTS}
    names |= {f"{a}div{b}": "interaction_ratio" for a, b in SET1_RATIOS}
    names |= {f"{a}sub{b}": "interaction_diff" for a, b in SET1_DIFFERENCES}
    names |= dict.fromkeys(["row_mean", "row_std", "row_max", "row_min"], "row_stat")
    names |= {"instability": "instability", "imbalance": "imbalance"}
    for block in blocks:
        names |= {f"{block}_mean": "block_feature", f"{block}_std": "block_feature"}
    names |= {"anomaly_distance": "anomaly", "regime_anomaly": "regime"}
    names |= {"threshold_count": "threshold", "extreme_count": "outlier"}
    return names | {f"{block}_divergence": "divergence" for block in block_divergence_names(blocks)}


def block_divergence_names(blocks: dict[str, list[str]]) -> list[str]:
    return [block for block, names in blocks.items() if len(names) > 1]


def set2_registry() -> dict[str, str]:
    """Name -> type of the set 2 columns, in order."""
    names = dict.fromkeys(["X36/X35", "X36/X34", "X36xX41"], "X36_centric")
    names |= dict.fromkeys(["X35/X34", "X35xX41", "X34-X36"], "cooling_cluster")
    names |= {f"{a}x{b}": "dangerous_interaction" for a, b in SET2_INTERACTIONS}
    names |= dict.fromkeys(["row_mean", "row_std", "instability"], "row_stat")
    return names | {"rolling_mean": "rolling_cluster"}


def feature_registry(df: DataFrame, registry: dict[str, str]) -> DataFrame:
    """(position, feature, type)."""
    rows = [(position, name, kind) for position, (name, kind) in enumerate(registry.items())]
    return df.sparkSession.createDataFrame(rows, "position int, feature string, type string")


def feature_type_counts(registry: DataFrame) -> DataFrame:
    """(type, n)."""
    return registry.groupBy("type").agg(F.count("*").alias("n"))
