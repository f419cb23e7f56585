"""Cleaning, profiling and validation of measurement tables."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procsight import LABEL
from procsight.operators.quantiles import SKETCH, exact_quantiles
from procsight.session import stored

# The shape of a decimal number, and the label names of the class report.
NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity)\s*$"
LABEL_NAMES = ("NORMAL", "DEFECT")
SEVERE_RATIO = 10
# Hashes of 8 bytes that every task may hold.
FEW_HASHES = 1_000_000


def coerce_numeric(df: DataFrame, features: list[str]) -> DataFrame:
    """Measurements as doubles; text that is not a number, and NaN, become null."""
    kinds = dict(df.dtypes)

    def number(name: str) -> Column:
        if kinds[name] == "string":
            return F.when(F.col(name).rlike(NUMBER), F.trim(F.col(name)).try_cast("double"))
        value = F.col(name).cast("double")
        return F.when(~F.isnan(value), value)

    return df.withColumns({name: number(name) for name in features})


def missing_profile(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, missing, missing_pct) of the features that have gaps."""
    counts = df.agg(
        F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in features]
    )
    return (
        counts.unpivot(["rows"], features, "feature", "missing")
        .filter(F.col("missing") > 0)
        .select("feature", "missing", (F.col("missing") / F.col("rows") * 100).alias("missing_pct"))
    )


def fit_median(
    df: DataFrame, features: list[str], size: int = SKETCH
) -> dict[str, float]:
    """Exact medians of the features that have gaps in `df` (the training table)."""
    gaps = [row["feature"] for row in missing_profile(df, features).collect()]
    if not gaps:
        return {}
    medians = exact_quantiles(df, gaps, [0.5], size=size)
    return {feature: q[0] for (feature,), q in medians.items()}


def apply_fill(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    """Fill gaps with the fitted medians. Features without a gap in training stay as they are."""
    return df.fillna(medians) if medians else df


def fill_report(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    """(feature, median, filled): what `apply_fill` does to `df`; the sum of `filled` is the total."""
    table = df.sparkSession.createDataFrame(list(medians.items()), "feature string, median double")
    gaps = missing_profile(df, list(medians)).select("feature", F.col("missing").alias("filled"))
    return table.join(gaps, "feature", "left").fillna({"filled": 0})


def validate_clean(
    train: DataFrame, test: DataFrame, features: list[str], label: str = LABEL
) -> DataFrame:
    """Violations (check_name, feature, n); an empty table means both tables are valid."""
    gaps = missing_profile(train, features).select(
        F.lit("null_in_train").alias("check_name"), "feature", F.col("missing").alias("n")
    )
    numeric = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    kinds = dict(train.dtypes)
    faults = [("not_numeric", c, 1) for c in features if kinds[c] not in numeric]
    if label not in train.columns:
        faults.append(("label_missing_in_train", label, 1))
    if label in test.columns:
        faults.append(("label_present_in_test", label, 1))
    for name in sorted(set(train.columns) ^ set(test.columns) - {label}):
        if name != label:
            faults.append(("column_in_one_table_only", name, 1))
    schema = "check_name string, feature string, n bigint"
    return gaps.unionByName(train.sparkSession.createDataFrame(faults, schema))


def class_distribution(df: DataFrame, label: str = LABEL) -> DataFrame:
    """(label, label_name, n, pct) per class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    # The window runs over one row per class.
    everything = Window.partitionBy()
    return counts.select(
        F.col(label),
        F.when(F.col(label) == 0, LABEL_NAMES[0]).otherwise(LABEL_NAMES[1]).alias("label_name"),
        "n",
        (F.col("n") / F.sum("n").over(everything) * 100).alias("pct"),
    ).orderBy(label)


def imbalance_ratio(df: DataFrame, label: str = LABEL) -> DataFrame:
    """n(lowest label) / n(next label) with a severity verdict; null if one class is missing."""
    counts = df.agg(
        F.count_if(F.col(label) == 0).alias("n_normal"), F.count_if(F.col(label) == 1).alias("n_defect")
    )
    ratio = F.try_divide(F.nullif("n_normal", F.lit(0)).cast("double"), F.col("n_defect").cast("double"))
    return counts.withColumn("ratio", ratio).withColumn(
        "severity",
        F.when(F.col("ratio") > SEVERE_RATIO, "SEVERE").when(F.col("ratio").isNotNull(), "MODERATE"),
    )


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of fully equal rows."""
    # A hash of the row keys the first aggregate, so that the shuffle carries 8 bytes per row;
    # only rows that share a hash with another row are then compared column by column.
    hashed = df.withColumn("row_hash", F.xxhash64(*df.columns))
    repeated = stored(hashed.groupBy("row_hash").agg(F.count("*").alias("copies")).filter("copies > 1").select("row_hash"))
    n = repeated.count()
    if not n:
        return df.sparkSession.createDataFrame([(0,)], "duplicates bigint")
    # Where the hashes are known to be few, no other row is shuffled.
    few = F.broadcast(repeated) if n <= FEW_HASHES else repeated
    groups = hashed.join(few, "row_hash", "left_semi").groupBy(*df.columns).count()
    return groups.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))


def feature_variances(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, variance): sample variance of each feature."""
    return df.agg(*[F.var_samp(c).alias(c) for c in features]).unpivot(
        [], features, "feature", "variance"
    )


def low_variance_features(df: DataFrame, features: list[str], quantile: float = 0.10) -> DataFrame:
    """Features whose sample variance lies strictly below the given quantile of all variances."""
    everything = Window.partitionBy()
    return (
        feature_variances(df, features)
        .withColumn("cut", F.percentile("variance", F.lit(quantile)).over(everything))
        .filter(F.col("variance") < F.col("cut"))
    )


def variance_range(df: DataFrame, features: list[str]) -> DataFrame:
    """Smallest and largest feature variance."""
    return feature_variances(df, features).agg(
        F.min("variance").alias("min_variance"), F.max("variance").alias("max_variance")
    )


def dataset_profile(df: DataFrame, features: list[str], quantile: float = 0.10) -> DataFrame:
    """One row: size, missing cells, duplicates, and the range of the feature variances."""
    spark = df.sparkSession
    # One scan for all but the duplicates.
    found = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{i}") for i, c in enumerate(features)],
        *[F.var_samp(c).alias(f"variance_{i}") for i, c in enumerate(features)],
    ).first()
    variances = spark.createDataFrame([(found[f"variance_{i}"],) for i in range(len(features))], "variance double").agg(
        F.min("variance").alias("min_variance"),
        F.max("variance").alias("max_variance"),
        F.percentile("variance", F.lit(quantile)).alias("low_variance_cut"),
    )
    missing = sum(found[f"missing_{i}"] for i in range(len(features)))
    size = (found["rows"], len(df.columns), len(features), missing, duplicate_count(df).first()["duplicates"])
    shape = spark.createDataFrame([size], "rows bigint, columns bigint, features bigint, missing_cells bigint, duplicates bigint")
    # Two tables of one row each.
    return shape.crossJoin(F.broadcast(variances))


def class_filter(df: DataFrame, value: int, label: str = LABEL) -> DataFrame:
    """The rows of one class."""
    return df.filter(F.col(label) == value)


def drop_sparse_columns(df: DataFrame, features: list[str], threshold: float = 0.5) -> DataFrame:
    """Drop the features whose share of missing values exceeds `threshold`."""
    sparse = missing_profile(df, features).filter(F.col("missing_pct") > threshold * 100)
    return df.drop(*[row["feature"] for row in sparse.select("feature").collect()])


def impute(df: DataFrame, features: list[str], strategy: str = "median") -> DataFrame:
    """Fill or drop gaps: 'median', 'mean' or 'drop'."""
    if strategy == "drop":
        return df.dropna(subset=features)
    if strategy == "median":
        return apply_fill(df, fit_median(df, features))
    if strategy == "mean":
        means = df.agg(*[F.avg(c).alias(c) for c in features]).first().asDict()
        return df.fillna({c: m for c, m in means.items() if m is not None})
    raise ValueError(f"unknown strategy: {strategy}")
