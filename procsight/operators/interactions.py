"""Quantile-binned feature pairs: defect density, strength, risk and exclusive regions."""

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procsight import LABEL
from procsight.operators.quantiles import exact_quantiles
from procsight.operators.univariate import ranked_features

# Sizes and cut-offs of the interaction reports.
TOP_FEATURES = 15
MIN_STRENGTH = 0.01
HIGH_RISK = 0.15
LOW_RISK = 0.03
TOP_CONDITIONAL = 20
TOP_EXCLUSIVE = 10
# Decimals to which the edges of the two classes' own bins are rounded before they are compared.
EDGE_DECIMALS = 3


def quantile_edges(df: DataFrame, features: list[str], q: int = 3) -> dict[str, list[float]]:
    """Distinct edges of q equally filled bins per feature, over all rows."""
    steps = [i / q for i in range(q + 1)]
    found = exact_quantiles(df, features, steps)
    return {feature: sorted(set(edges)) for (feature,), edges in found.items()}


def bin_number(value: Column, edges: list[float]) -> Column:
    """0-based right-closed bin, lowest value included; null outside the edges or without a bin."""
    if len(edges) < 2:
        return F.lit(None).cast("int")
    number = F.lit(0)
    for edge in edges[1:-1]:
        number = number + (value > edge).cast("int")
    return F.when(value.between(edges[0], edges[-1]), number)


def quantile_bins(df: DataFrame, features: list[str], q: int = 3, suffix: str = "_bin") -> DataFrame:
    """The table with one bin column per feature."""
    edges = quantile_edges(df, features, q)
    return df.withColumns({f"{c}{suffix}": bin_number(F.col(c), edges[c]) for c in features})


def pair_list(features: list[str]) -> list[tuple[str, str]]:
    return list(itertools.combinations(features, 2))


def defect_density_map(
    df: DataFrame,
    pairs: list[tuple[str, str]],
    label: str = LABEL,
    q: int = 3,
    edges: dict[str, list[float]] | None = None,
) -> DataFrame:
    """(pair_index, feature_1, feature_2, bin1, bin2, n, n_defect, rate) of every observed cell.

    Each feature is binned once; each row then yields one small integer per pair,
    and the counts of at most pairs x q^2 cells are combined on the map side.
    """
    features = sorted({f for pair in pairs for f in pair})
    edges = edges or quantile_edges(df, features, q)
    binned = df.select(label, *[bin_number(F.col(c), edges[c]).alias(c) for c in features])
    base = q * q
    # One code per pair and cell; null where a side has no bin.
    codes = F.array(
        *[
            F.lit(index * base) + F.col(one) * q + F.col(other)
            for index, (one, other) in enumerate(pairs)
        ]
    )
    counts = (
        binned.select(label, F.explode(codes).alias("code"))
        .filter(F.col("code").isNotNull())
        .groupBy("code")
        .agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("n_defect"))
    )
    firsts = F.array(*[F.lit(one) for one, _ in pairs])
    seconds = F.array(*[F.lit(other) for _, other in pairs])
    index = F.floor(F.col("code") / base).cast("int")
    cell = F.pmod("code", F.lit(base))
    return counts.select(
        index.alias("pair_index"),
        F.element_at(firsts, index + 1).alias("feature_1"),
        F.element_at(seconds, index + 1).alias("feature_2"),
        F.floor(cell / q).cast("int").alias("bin1"),
        F.pmod(cell, F.lit(q)).cast("int").alias("bin2"),
        "n",
        "n_defect",
        (F.col("n_defect") / F.col("n")).alias("rate"),
    )


def interaction_strength(density: DataFrame, min_strength: float | None = MIN_STRENGTH) -> DataFrame:
    """Per pair: largest and smallest cell rate and their difference, strongest first.

    A pair is reported only where both classes occur.
    """
    pairs = (
        density.groupBy("pair_index", "feature_1", "feature_2")
        .agg(
            F.max("rate").alias("max_defect_rate"),
            F.min("rate").alias("min_defect_rate"),
            F.sum("n").alias("n"),
            F.sum("n_defect").alias("n_defect"),
        )
        .filter((F.col("n_defect") > 0) & (F.col("n_defect") < F.col("n")))
        .withColumn("interaction_strength", F.col("max_defect_rate") - F.col("min_defect_rate"))
    )
    if min_strength is not None:
        pairs = pairs.filter(F.col("interaction_strength") > min_strength)
    return pairs.orderBy(F.desc("interaction_strength"), "pair_index").select(
        F.concat("feature_1", F.lit(" × "), "feature_2").alias("feature_pair"),
        "feature_1",
        "feature_2",
        "max_defect_rate",
        "min_defect_rate",
        "interaction_strength",
        F.format_string(
            "%.2f%% to %.2f%%", F.col("min_defect_rate") * 100, F.col("max_defect_rate") * 100
        ).alias("risk_range"),
        "pair_index",
    )


def interaction_scan(
    df: DataFrame,
    features: list[str],
    label: str = LABEL,
    min_strength: float | None = MIN_STRENGTH,
    top: int = TOP_FEATURES,
) -> DataFrame:
    """Interaction report of all pairs of the `top` lowest-p features."""
    pairs = pair_list(ranked_features(df, features, label, top))
    return interaction_strength(defect_density_map(df, pairs, label), min_strength)


def interaction_scan_small(df: DataFrame, features: list[str], label: str = LABEL) -> DataFrame:
    """The short variant: each of the three lowest-p features with the later ones of the first four."""
    pairs = pair_list(ranked_features(df, features, label, 4))
    return interaction_strength(defect_density_map(df, pairs, label), None)


def risk_score(interactions: DataFrame) -> DataFrame:
    """100 max rate + 50 strength, highest first."""
    score = F.col("max_defect_rate") * 100 + F.col("interaction_strength") * 50
    return interactions.withColumn("risk_score", score).orderBy(F.desc("risk_score"), "pair_index")


def select_interaction_pairs(interactions: DataFrame, k: int) -> list[tuple[str, str]]:
    """The k highest-risk pairs as names, for feature building."""
    rows = risk_score(interactions).limit(k).select("feature_1", "feature_2").collect()
    return [(row["feature_1"], row["feature_2"]) for row in rows]


def strongest_pairs(interactions: DataFrame, k: int) -> DataFrame:
    """(feature_1, feature_2, place) of the k strongest pairs; k rows."""
    best = interactions.orderBy(F.desc("interaction_strength"), "pair_index").limit(k)
    return best.select("feature_1", "feature_2", "pair_index", "interaction_strength")


def ranked_density(df: DataFrame, features: list[str], label: str = LABEL) -> DataFrame:
    """The density map of all pairs of the 15 lowest-p features."""
    return defect_density_map(df, pair_list(ranked_features(df, features, label, TOP_FEATURES)), label)


def conditional_regions(df: DataFrame, features: list[str], label: str = LABEL, **cuts) -> DataFrame:
    """High- and low-risk cells of the strongest pairs; pairs with neither are left out."""
    return conditional_cells(ranked_density(df, features, label), **cuts)


def conditional_cells(
    density: DataFrame, high: float = HIGH_RISK, low: float = LOW_RISK, top: int = TOP_CONDITIONAL
) -> DataFrame:
    """`conditional_regions` from a density map."""
    best = strongest_pairs(interaction_strength(density), top)
    cell = F.concat(
        F.lit("("), F.col("bin1").cast("string"), F.lit(","), F.col("bin2").cast("string"), F.lit(")")
    )

    def cells(condition: Column) -> Column:
        # At most q^2 cells per pair.
        return F.array_sort(F.collect_list(F.when(condition, cell)))

    found = (
        density.join(F.broadcast(best), ["feature_1", "feature_2", "pair_index"])
        .groupBy("feature_1", "feature_2", "pair_index", "interaction_strength")
        .agg(cells(F.col("rate") > high).alias("highs"), cells(F.col("rate") < low).alias("lows"))
        .filter((F.size("highs") > 0) | (F.size("lows") > 0))
    )

    def text(name: str) -> Column:
        return F.concat(F.lit("["), F.array_join(name, " "), F.lit("]"))

    both = (F.size("highs") > 0) & (F.size("lows") > 0)
    return found.orderBy(F.desc("interaction_strength"), "pair_index").select(
        F.concat("feature_1", F.lit(" × "), "feature_2").alias("feature_pair"),
        text("highs").alias("high_risk_regions"),
        text("lows").alias("low_risk_regions"),
        F.when(both, "YES").otherwise("PARTIAL").alias("conditional_behavior"),
    )


def exclusive_regions(
    df: DataFrame,
    features: list[str],
    label: str = LABEL,
    edges: str = "shared",
    top: int = TOP_EXCLUSIVE,
) -> DataFrame:
    """Cells of the strongest pairs that defect rows occupy and normal rows do not.

    'shared' bins all rows alike. 'per_class' bins each class by its own
    quantiles and compares the cells by their edges, rounded to EDGE_DECIMALS, so
    nearly every defect cell counts as exclusive.
    """
    density = ranked_density(df, features, label)
    if edges == "shared":
        return exclusive_cells(density, top)
    if edges == "per_class":
        best = strongest_pairs(interaction_strength(density), top)
        return _count_exclusive(_exclusive_intervals(df, best, label))
    raise ValueError(f"unknown edges: {edges}")


def exclusive_cells(density: DataFrame, top: int = TOP_EXCLUSIVE) -> DataFrame:
    """`exclusive_regions` on shared edges from a density map."""
    best = strongest_pairs(interaction_strength(density), top)
    alone = density.filter(F.col("n_defect") == F.col("n")).join(
        F.broadcast(best), ["feature_1", "feature_2", "pair_index"]
    )
    return _count_exclusive(alone)


def _count_exclusive(alone: DataFrame) -> DataFrame:
    return (
        alone.groupBy("feature_1", "feature_2", "pair_index", "interaction_strength")
        .agg(F.count("*").alias("unstable_regions_found"))
        .orderBy(F.desc("interaction_strength"), "pair_index")
        .select(
            F.concat("feature_1", F.lit(" × "), "feature_2").alias("feature_pair"),
            "unstable_regions_found",
            F.lit("DEFECT_EXCLUSIVE").alias("instability_type"),
        )
    )


def _exclusive_intervals(df: DataFrame, best: DataFrame, label: str) -> DataFrame:
    pairs = [(row["feature_1"], row["feature_2"]) for row in best.collect()]
    if not pairs:
        return best
    spark = df.sparkSession
    cells = {}
    for value in (0, 1):
        rows = df.filter(F.col(label) == value)
        edges = quantile_edges(rows, sorted({f for pair in pairs for f in pair}))
        spans = [
            (feature, number, round(low, EDGE_DECIMALS), round(high, EDGE_DECIMALS))
            for feature, marks in edges.items()
            for number, (low, high) in enumerate(itertools.pairwise(marks))
        ]
        names = spark.createDataFrame(spans, "feature string, bin int, low double, high double")
        density = defect_density_map(rows, pairs, label, edges=edges)
        for side in ("1", "2"):
            span = names.select(
                F.col("feature").alias(f"feature_{side}"),
                F.col("bin").alias(f"bin{side}"),
                F.struct("low", "high").alias(f"span{side}"),
            )
            density = density.join(F.broadcast(span), [f"feature_{side}", f"bin{side}"])
        cells[value] = density.select("feature_1", "feature_2", "span1", "span2").distinct()
    alone = cells[1].join(cells[0], ["feature_1", "feature_2", "span1", "span2"], "left_anti")
    return alone.join(F.broadcast(best), ["feature_1", "feature_2"])
