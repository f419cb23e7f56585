"""The tables behind the charts of the reports."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procsight import KEY, LABEL
from procsight.functions.columns import long_form, with_position
from procsight.operators.cleaning import class_distribution
from procsight.operators.correlation import correlation_by_class, correlation_matrix
from procsight.operators.latent import assign_regimes, pca_project
from procsight.operators.quantiles import SKETCH
from procsight.operators.univariate import (
    ALPHA,
    class_quartiles,
    cv_instability,
    iqr_outliers,
    mann_whitney,
    ranked_features,
)

# Sizes of the charts.
BINS = 20
CHART_FEATURES = 12
SIGNIFICANCE_FEATURES = 15
CHART_ROWS = 10
ANOMALY_BINS = 30
ANOMALY_CUT = -0.5
# Cells of a scatter plot along each side.
GRID = 40


def class_share(df: DataFrame, label: str = LABEL) -> DataFrame:
    """(label_name, n, pct)."""
    return class_distribution(df, label).select("label_name", "n", "pct")


def significance_chart(
    df: DataFrame, features: list[str], label: str = LABEL, k: int = SIGNIFICANCE_FEATURES
) -> DataFrame:
    """(feature, p_value, log_p, significant) of the k lowest p-values; the line is -log10(0.05)."""
    tests = with_position(mann_whitney(df, features, label), features)
    return (
        tests.orderBy(F.desc_nulls_last("z"), "position")
        .limit(k)
        .select(
            "feature",
            "p_value",
            (-F.log10("p_value")).alias("log_p"),
            (F.col("p_value") < ALPHA).alias("significant"),
            (-F.log10(F.lit(ALPHA))).alias("line"),
        )
    )


def histogram_by_class(
    df: DataFrame,
    features: list[str],
    label: str = LABEL,
    bins: int = BINS,
    top: int | None = CHART_FEATURES,
) -> DataFrame:
    """(feature, label, bin, low, high, n, density): equal-width bins from the class's own
    minimum to its maximum, the last bin closed; empty bins are listed."""
    chosen = ranked_features(df, features, label, top) if top else features
    values = long_form(df, chosen, [label]).filter(F.col("value").isNotNull())
    spans = values.groupBy("feature", label).agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("total")
    )
    flat = F.col("low") == F.col("high")
    # A constant feature gets a range of width 1 around its value.
    spans = spans.select(
        "feature",
        label,
        "total",
        F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"),
        F.when(flat, F.col("high") + 0.5).otherwise(F.col("high")).alias("high"),
    ).withColumn("width", (F.col("high") - F.col("low")) / bins)
    # features x classes rows
    value, first = F.col("value"), F.col("low")
    place = F.least(F.floor((value - first) / (F.col("high") - first) * bins), F.lit(bins - 1))
    # Rounding may put a value that lies on a border on the wrong side of it.
    exact = (
        F.when(value < first + place * F.col("width"), place - 1)
        .when((place < bins - 1) & (value >= first + (place + 1) * F.col("width")), place + 1)
        .otherwise(place)
    )
    counts = (
        values.join(F.broadcast(spans), ["feature", label])
        .groupBy("feature", label, exact.cast("int").alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    listed = spans.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    n = F.coalesce("n", F.lit(0))
    return listed.join(counts, ["feature", label, "bin"], "left").select(
        "feature",
        label,
        "bin",
        (F.col("low") + F.col("bin") * F.col("width")).alias("low"),
        (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("high"),
        n.alias("n"),
        (n / (F.col("total") * F.col("width"))).alias("density"),
    )


def boxplot_by_class(
    df: DataFrame,
    features: list[str],
    label: str = LABEL,
    top: int | None = CHART_FEATURES,
    size: int = SKETCH,
) -> DataFrame:
    """(feature, label, q1, median, q3, whisker_low, whisker_high, fliers)."""
    chosen = ranked_features(df, features, label, top) if top else features
    boxes = class_quartiles(df, chosen, label, (0.25, 0.5, 0.75), size).select(
        "feature",
        label,
        F.col("q")[0].alias("q1"),
        F.col("q")[1].alias("median"),
        F.col("q")[2].alias("q3"),
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    value = F.col("value")
    inside_low, inside_high = value >= F.col("q1") - reach, value <= F.col("q3") + reach
    return (
        long_form(df, chosen, [label])
        .filter(value.isNotNull())
        .join(F.broadcast(boxes), ["feature", label])
        .groupBy("feature", label, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside_low, value)).alias("lowest"),
            F.max(F.when(inside_high, value)).alias("highest"),
            F.count_if(~(inside_low & inside_high)).alias("fliers"),
        )
        .select(
            "feature",
            label,
            "q1",
            "median",
            "q3",
            F.least("lowest", "q1").alias("whisker_low"),
            F.greatest("highest", "q3").alias("whisker_high"),
            "fliers",
        )
    )


def instability_chart(df: DataFrame, features: list[str], label: str = LABEL) -> DataFrame:
    """Top 10 by relative instability with both coefficients."""
    columns = ["feature", "relative_instability_pct", "normal_cv", "defect_cv"]
    return cv_instability(df, features, label).select(*columns).limit(CHART_ROWS)


def outlier_chart(df: DataFrame, features: list[str], label: str = LABEL) -> DataFrame:
    """Top 10 by defect outliers, and top 10 by outlier ratio among those that have any."""
    report = with_position(iqr_outliers(df, features, label), features)
    by_count = report.orderBy(F.desc("outliers_defect"), "position").limit(CHART_ROWS)
    by_ratio = (
        report.filter(F.col("outliers_defect") > 0)
        .orderBy(F.desc("outlier_ratio"), "position")
        .limit(CHART_ROWS)
    )
    return by_count.select(
        F.lit("count").alias("panel"), "feature", F.col("outliers_defect").cast("double").alias("value")
    ).unionByName(by_ratio.select(F.lit("ratio").alias("panel"), "feature", F.col("outlier_ratio").alias("value")))


def interaction_chart(interactions: DataFrame) -> DataFrame:
    """Top 10 pairs by strength."""
    return (
        interactions.orderBy(F.desc("interaction_strength"), "pair_index")
        .limit(CHART_ROWS)
        .select("feature_pair", "interaction_strength")
    )


def heatmap_long(df: DataFrame, features: list[str], label: str = LABEL) -> DataFrame:
    """(scope, feature_1, feature_2, r): overall, normal and defect correlation, whole matrices in one table."""
    scope = F.when(F.col(label) == 0, "normal").otherwise("defect").alias("scope")
    overall = correlation_matrix(df, features).select(F.lit("overall").alias("scope"), "*")
    by_class = correlation_by_class(df, features, label).select(scope, "feature_1", "feature_2", "r")
    return overall.unionByName(by_class)


def window_chart(thresholds: DataFrame) -> DataFrame:
    """(feature, safe_pct, unsafe_pct)."""
    return thresholds.select(
        "feature",
        (F.col("safe_rate") * 100).alias("safe_pct"),
        (F.col("unsafe_rate") * 100).alias("unsafe_pct"),
    )


def anomaly_chart(flagged: DataFrame, label: str = LABEL) -> DataFrame:
    """(label, anomaly, n): rows of each class below and above the cut at -0.5."""
    anomalous = (F.col("anomaly") < ANOMALY_CUT).alias("anomalous")
    return flagged.groupBy(label, anomalous).agg(F.count("*").alias("n"))


def anomaly_histogram(flagged: DataFrame, label: str = LABEL) -> DataFrame:
    """(label, bin, n, density) of the -1/1 flags in 30 equal bins from -1 to 1."""
    width = 2 / ANOMALY_BINS
    place = F.least(F.floor((F.col("anomaly") + 1) / width), F.lit(ANOMALY_BINS - 1)).cast("int")
    counts = flagged.groupBy(label, place.alias("bin")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(label)
    return counts.withColumn("density", F.col("n") / (F.sum("n").over(whole) * width))


def pca_chart(profile: DataFrame) -> DataFrame:
    """Cumulative share of the first 20 components, single share of the first 10."""
    single = F.when(F.col("component") <= 10, F.col("variance_ratio")).alias("variance_ratio")
    return profile.filter(F.col("component") <= 20).select("component", single, "cumulative")


def binned_points(df: DataFrame, x: str, y: str, by: list[str], bins: int = GRID) -> DataFrame:
    """(by, bin_x, bin_y, low_x, high_x, low_y, high_y, n): all points of a scatter plot, counted in a grid.

    The grid spans the values of both columns; points without a value of either are left out.
    A column of one value has one bin. Two scans, and bins x bins rows for each group at most.
    """
    points = df.select(*by, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    points = points.filter(F.col("__x").isNotNull() & F.col("__y").isNotNull())
    ends = points.agg(F.min("__x"), F.max("__x"), F.min("__y"), F.max("__y")).first()
    marks = {"x": ends[:2], "y": ends[2:]}
    if ends[0] is None:
        marks = {"x": (0.0, 0.0), "y": (0.0, 0.0)}

    def place(name: str) -> Column:
        low, high = marks[name]
        if low == high:
            return F.lit(0).alias(f"bin_{name}")
        step = F.floor((F.col(f"__{name}") - low) / (high - low) * bins)
        return F.least(step, F.lit(bins - 1)).cast("int").alias(f"bin_{name}")

    def edge(name: str, side: str) -> Column:
        low, high = marks[name]
        step = F.col(f"bin_{name}") + (1 if side == "high" else 0)
        width = (high - low) / bins
        return (F.lit(low) + step * (width if width else 0.0)).alias(f"{side}_{name}")

    counts = points.groupBy(*by, place("x"), place("y")).agg(F.count("*").alias("n"))
    edges = [edge(name, side) for name in ("x", "y") for side in ("low", "high")]
    return counts.select(*by, "bin_x", "bin_y", *edges, "n")


def pca_points(df: DataFrame, features: list[str], label: str = LABEL, bins: int = GRID) -> DataFrame:
    """(panel, label, grid cell, n): all rows on PC1-PC2 and PC1-PC3, by class."""
    projected = pca_project(df, features, 3, (label,))
    panels = [
        binned_points(projected, "pc1", other, [label], bins).withColumn("panel", F.lit(f"pc1-{other}")) for other in ("pc2", "pc3")
    ]
    return panels[0].unionByName(panels[1])


def regime_points(df: DataFrame, features: list[str], label: str = LABEL, bins: int = GRID) -> DataFrame:
    """(regime, label, grid cell, n): all rows on PC1-PC2, by regime and class."""
    return binned_points(assign_regimes(df, features, keep=(label,)), "pc1", "pc2", ["regime", label], bins)


def regime_chart(regimes: DataFrame) -> DataFrame:
    """(regime, n, defect_rate_pct, colour): green below 10 %, orange below 20 %, red above."""
    rate = F.col("defect_rate_pct")
    colour = F.when(rate < 10, "green").when(rate < 20, "orange").otherwise("red")
    return regimes.withColumn("colour", colour)


def fingerprints(df: DataFrame, features: list[str], label: str = LABEL) -> DataFrame:
    """(label, feature, mean, std, band_low, band_high) over all rows of each class."""
    stats = long_form(df, features, [label]).groupBy(label, "feature").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")
    )
    return stats.withColumns(
        {"band_low": F.col("mean") - F.col("std"), "band_high": F.col("mean") + F.col("std")}
    )


def threshold_chart(sweep: DataFrame) -> DataFrame:
    """The sweep with markers at the F1 and industrial optimum."""
    # The window runs over the rows of one sweep.
    whole = Window.partitionBy()

    def at_best(metric: str):
        best = F.max_by("threshold", F.struct(F.col(metric), -F.col("threshold"))).over(whole)
        return F.col("threshold") == best

    return sweep.select(
        "threshold",
        "precision",
        "recall",
        "f1",
        "industrial_score",
        at_best("f1").alias("f1_optimum"),
        at_best("industrial_score").alias("industrial_optimum"),
    )


def strategy_chart(comparison: DataFrame) -> DataFrame:
    """(strategy, roc_auc_mean, f1_mean)."""
    return comparison.select("strategy", "roc_auc_mean", "f1_mean")
