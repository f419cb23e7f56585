"""Per-feature comparison of the two outcome classes."""

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from procsight import LABEL
from procsight.functions.columns import long_form, with_position
from procsight.operators.quantiles import SKETCH, RankScan, Span, exact_quantiles, interpolated, quantile_ranks
from procsight.operators.ranks import ROWS_PER_RANGE, rank_sums, ranged_long_form
from procsight.session import Scratch

ALPHA = 0.05


@F.pandas_udf(DoubleType())
def two_sided_tail(z: pd.Series) -> pd.Series:
    """P(|N(0,1)| >= z), at most 1. Applied to report rows only."""
    return z.map(lambda x: min(1.0, math.erfc(x / math.sqrt(2.0))))


def class_moments(df: DataFrame, features: list[str], label: str = LABEL) -> DataFrame:
    """(feature, label, n, mean, std, std_pop, variance, skew, kurtosis, low, high), in one pass."""
    value = F.col("value")
    return (
        long_form(df, features, [label])
        .groupBy("feature", label)
        .agg(
            F.count(value).alias("n"),
            F.avg(value).alias("mean"),
            F.stddev_samp(value).alias("std"),
            F.stddev_pop(value).alias("std_pop"),
            F.var_samp(value).alias("variance"),
            F.skewness(value).alias("skew"),
            F.kurtosis(value).alias("kurtosis"),
            F.min(value).alias("low"),
            F.max(value).alias("high"),
        )
    )


QUARTILES = (0.25, 0.5, 0.75)


class ClassProfile:
    """What the class reports of a table have in common, in two scans for any number of features.

    The first scan sketches every feature of every class. The second one counts the
    rows around the quartiles and around the outlier fences, whose places
    follow from the quartiles' brackets, and sums the moments; the exact quartiles and
    the exact numbers of outliers come from those counts. All results are
    bounded by features x classes.
    """

    def __init__(
        self, df: DataFrame, features: list[str], label: str = LABEL, reach: float = 1.5, size: int = SKETCH
    ):
        self.spark, self.features, self.label = df.sparkSession, features, label
        self.kind = dict(df.dtypes)[label]
        with Scratch(self.spark) as scratch:
            plain = df.select(label, *[F.col(c).cast("double").alias(c) for c in features]).filter(F.col(label).isNotNull())
            scan = RankScan(plain, features, scratch, label, size, [F.count("*").alias("rows")])
            self.sizes = {value: row["rows"] for value, row in scan.groups.items()}
            spans = scan.spans(quantile_ranks(QUARTILES))
            fences = {key: self._fences(own, scan.n[key], reach) for key, own in spans.items()}
            counted = scan.count({key: [*own, *fences[key]] for key, own in spans.items()}, moments=True)
            places = counted.places()
            self.quartiles = {key: interpolated(found, scan.n[key], QUARTILES) for key, found in places.items()}
            limits = {}
            for key, (q1, _, q3) in self.quartiles.items():
                at = len(spans[key])
                limits[key] = [(at, q1 - reach * (q3 - q1), False), (at + 1, q3 + reach * (q3 - q1), True)]
            self.outliers = {key: sum(n) for key, n in counted.beyond(limits).items()}
            self.moments_of = {key: counted.moments(key) for key in places}

    @staticmethod
    def _fences(spans: list[Span], n: int, reach: float) -> list[Span]:
        """Where the two fences can be, given where the quartiles can be."""

        def bracket(p: float) -> tuple[float, float]:
            low = int(p * (n - 1))
            own = [s for s in spans if low in s.ranks or min(low + 1, n - 1) in s.ranks]
            return min(s.low for s in own), max(s.high for s in own)

        (a, b), (c, d) = bracket(0.25), bracket(0.75)
        ends = [a - reach * (d - a), b - reach * (c - b), c + reach * (c - b), d + reach * (d - a)]
        if not all(math.isfinite(x) for x in ends):
            return [Span(-math.inf, math.inf)] * 2
        # Room for the rounding of the fences themselves.
        slack = 1e-9 * max(abs(x) for x in (a, b, c, d, *ends))
        return [Span(min(ends[:2]) - slack, max(ends[:2]) + slack), Span(min(ends[2:]) - slack, max(ends[2:]) + slack)]

    def moments(self) -> DataFrame:
        """As `class_moments`."""
        names = ["n", "mean", "std", "std_pop", "variance", "skew", "kurtosis", "low", "high"]
        rows = [(feature, value, *[m[x] for x in names]) for (value, feature), m in self.moments_of.items()]
        numbers = ", ".join(f"{x} {'bigint' if x == 'n' else 'double'}" for x in names)
        return self.spark.createDataFrame(rows, f"feature string, {self.label} {self.kind}, {numbers}")

    def outlier_counts(self) -> DataFrame:
        """(feature, label, outliers, rows, min, max) by the class's own fences; rows with a gap count in the class size."""
        rows = [
            (feature, value, n, self.sizes[value], m["low"], m["high"])
            for (value, feature), n in self.outliers.items()
            for m in [self.moments_of[value, feature]]
        ]
        schema = f"feature string, {self.label} {self.kind}, outliers bigint, rows bigint, min double, max double"
        return self.spark.createDataFrame(rows, schema)


def side_by_side(per_class: DataFrame, names: list[str], label: str = LABEL) -> DataFrame:
    """(feature, label, ...) rows to one row per feature with normal_* and defect_* columns."""
    picks = [
        F.max(F.when(F.col(label) == value, F.col(name))).alias(f"{side}_{name}")
        for name in names
        for value, side in ((0, "normal"), (1, "defect"))
    ]
    return per_class.groupBy("feature").agg(*picks)


def mann_whitney(
    df: DataFrame,
    features: list[str],
    label: str = LABEL,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Two-sided U test of normal against defect rows, asymptotic with tie and continuity correction.

    Columns: feature, n_normal, n_defect, u_defect, u_normal, tie_term, z, p_value.
    """
    sums = rank_sums(ranged_long_form(df, features, [label], rows_per_range), ["feature"], label)
    n0, n1 = F.col("n_normal").cast("double"), F.col("n_defect").cast("double")
    n = n0 + n1
    spread = F.sqrt(n0 * n1 / 12 * ((n + 1) - F.try_divide(F.col("tie_term"), n * (n - 1))))
    larger = F.greatest("u_defect", "u_normal")
    centred = larger - n0 * n1 / 2 - 0.5
    # With all values equal the spread is 0: no evidence at all.
    z = F.when(spread > 0, F.try_divide(centred, spread)).when(spread == 0, F.lit(float("-inf")))
    return (
        sums.withColumn("u_normal", n0 * n1 - F.col("u_defect"))
        .withColumn("z", F.when((n0 > 0) & (n1 > 0), z))
        .withColumn("p_value", F.when(F.col("z").isNotNull(), two_sided_tail(F.coalesce("z", F.lit(0.0)))))
        .select("feature", "n_normal", "n_defect", "u_defect", "u_normal", "tie_term", "z", "p_value")
    )


def _moments(df: DataFrame, features: list[str], label: str, profile: ClassProfile | None) -> DataFrame:
    return profile.moments() if profile else class_moments(df, features, label)


def significant(p_value: Column, alpha: float = ALPHA) -> Column:
    return F.when(p_value < alpha, "YES").otherwise("NO")


def univariate_stats(
    df: DataFrame, features: list[str], label: str = LABEL, alpha: float = ALPHA, profile: ClassProfile | None = None
) -> DataFrame:
    """The univariate report, lowest p-value first."""
    moments = side_by_side(_moments(df, features, label, profile), ["mean", "std", "skew", "kurtosis"], label)
    tests = mann_whitney(df, features, label).select("feature", "z", "p_value")
    report = with_position(moments.join(F.broadcast(tests), "feature"), features)
    return (
        report.orderBy(F.asc_nulls_last("p_value"), F.desc("z"), "position")
        .select(
            "feature",
            "normal_mean",
            "defect_mean",
            "normal_std",
            "defect_std",
            (F.col("defect_mean") - F.col("normal_mean")).alias("mean_diff"),
            "p_value",
            significant(F.col("p_value"), alpha).alias("significant"),
            "normal_skew",
            "defect_skew",
            "normal_kurtosis",
            "defect_kurtosis",
        )
    )


def ranked_features(df: DataFrame, features: list[str], label: str = LABEL, k: int = 15) -> list[str]:
    """The k features with the lowest p-value (largest z where p underflows), at most p names."""
    tests = with_position(mann_whitney(df, features, label), features)
    lowest = tests.orderBy(F.desc_nulls_last("z"), "position").limit(k)
    return [row["feature"] for row in lowest.select("feature").collect()]


def significance(
    df: DataFrame, features: list[str], label: str = LABEL, alpha: float = ALPHA
) -> DataFrame:
    """(significant, n): how many features differ between the classes."""
    return (
        mann_whitney(df, features, label)
        .select(significant(F.col("p_value"), alpha).alias("significant"))
        .groupBy("significant")
        .agg(F.count("*").alias("n"))
    )


def top_significant(
    df: DataFrame, features: list[str], label: str = LABEL, k: int = 10
) -> DataFrame:
    """The k most significant features with the class means."""
    return univariate_stats(df, features, label).select(
        "feature", "normal_mean", "defect_mean", "p_value"
    ).limit(k)


def cv_instability(
    df: DataFrame, features: list[str], label: str = LABEL, profile: ClassProfile | None = None
) -> DataFrame:
    """Coefficient of variation per class, their ratio and the relative instability, highest first."""
    sides = side_by_side(_moments(df, features, label, profile), ["mean", "std"], label)

    def variation(side: str) -> Column:
        return F.when(F.col(f"{side}_mean") == 0, F.lit(0.0)).otherwise(
            F.try_divide(F.col(f"{side}_std"), F.abs(F.col(f"{side}_mean")))
        )

    ratio = F.try_divide(F.col("defect_cv"), F.col("normal_cv"))
    report = (
        sides.select("feature", variation("normal").alias("normal_cv"), variation("defect").alias("defect_cv"))
        .withColumn("cv_ratio", F.when(F.col("normal_cv") > 0, ratio).otherwise(F.lit(0.0)))
        .withColumn(
            "relative_instability_pct",
            F.when(F.col("normal_cv") > 0, (ratio - 1) * 100).otherwise(F.lit(0.0)),
        )
    )
    return (
        with_position(report, features)
        .orderBy(F.desc("relative_instability_pct"), "position")
        .drop("position")
    )


def class_quartiles(
    df: DataFrame,
    features: list[str],
    label: str = LABEL,
    probabilities: tuple = (0.25, 0.75),
    size: int = SKETCH,
) -> DataFrame:
    """(feature, label, q): quantiles of each class, as a table of features x classes rows."""
    found = exact_quantiles(df, features, list(probabilities), by=label, size=size)
    kind = dict(df.dtypes)[label]
    rows = [(feature, value, q) for (value, feature), q in found.items() if value is not None]
    return df.sparkSession.createDataFrame(rows, f"feature string, {label} {kind}, q array<double>")


def iqr_outliers(
    df: DataFrame,
    features: list[str],
    label: str = LABEL,
    k: float = 1.5,
    size: int = SKETCH,
    profile: ClassProfile | None = None,
) -> DataFrame:
    """Rows strictly outside their own class's quartile fences, most defect outliers first. Two scans."""
    per_class = (profile or ClassProfile(df, features, label, k, size)).outlier_counts()
    sides = side_by_side(per_class, ["outliers", "rows", "min", "max"], label)
    report = sides.select(
        "feature",
        F.coalesce("normal_outliers", F.lit(0)).alias("outliers_normal"),
        F.coalesce("defect_outliers", F.lit(0)).alias("outliers_defect"),
        F.coalesce(F.try_divide("defect_outliers", "defect_rows"), F.lit(0.0)).alias("outlier_ratio"),
        "normal_min",
        "normal_max",
        "defect_min",
        "defect_max",
    )
    return (
        with_position(report, features).orderBy(F.desc("outliers_defect"), "position").drop("position")
    )


def profile_diversity(
    df: DataFrame, features: list[str], label: str = LABEL, profile: ClassProfile | None = None
) -> DataFrame:
    """Mean feature variance of each class and the verdict on which class varies more."""
    moments = _moments(df, features, label, profile)
    means = moments.agg(
        F.avg(F.when(F.col(label) == 0, F.col("variance"))).alias("normal_variance"),
        F.avg(F.when(F.col(label) == 1, F.col("variance"))).alias("defect_variance"),
    )
    return means.withColumn(
        "verdict",
        F.when(F.col("defect_variance") > F.col("normal_variance"), "MORE_VARIABLE").otherwise("SIMILAR"),
    )


def signature_entropy(
    df: DataFrame, features: list[str], label: str = LABEL, profile: ClassProfile | None = None
) -> DataFrame:
    """-sum(s ln(s + 1e-10)) over the population deviations s of each class, and the verdict."""
    moments = _moments(df, features, label, profile)
    spread = F.col("std_pop")
    term = -spread * F.log(spread + 1e-10)
    sums = moments.agg(
        F.sum(F.when(F.col(label) == 0, term)).alias("normal_entropy"),
        F.sum(F.when(F.col(label) == 1, term)).alias("defect_entropy"),
    )
    return sums.withColumn(
        "verdict",
        F.when(F.col("defect_entropy") > F.col("normal_entropy"), "MORE_COMPLEX").otherwise("SIMPLER"),
    )
