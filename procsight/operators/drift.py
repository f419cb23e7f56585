"""Drift between a reference table and current rows."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procsight.functions.columns import long_form, text_prefix
from procsight.operators.interactions import bin_number, quantile_edges
from procsight.operators.scoring import with_sample_id

FLOOR = 1e-6
# Rows that one task of a whole-table window sees.
ROWS_PER_PART = 200_000


def open_edges(reference: DataFrame, features: list[str], bins: int = 10) -> dict[str, list[float]]:
    """Edges of the reference's quantile bins, the outer bins open; features of one value have none."""
    edges = quantile_edges(reference, features, bins)
    return {c: [float("-inf"), *marks[1:-1], float("inf")] for c, marks in edges.items() if len(marks) > 1}


def bin_counts(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """(feature, bin, n): features x bins rows at most. Works on streams too, where those rows are all of the state."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("feature"), bin_number(F.col(c), marks).alias("bin")) for c, marks in edges.items()]
    )
    return df.select(F.inline(cells)).filter(F.col("bin").isNotNull()).groupBy("feature", "bin").agg(F.count("*").alias("n"))


def stability_index(reference: DataFrame, current: DataFrame) -> DataFrame:
    """(feature, psi) of two tables of `bin_counts`."""
    sides = [df.withColumn("side", F.lit(side)) for side, df in (("reference", reference), ("current", current))]
    counts = (
        sides[0]
        .unionByName(sides[1])
        .groupBy("feature", "bin")
        .agg(
            F.coalesce(F.sum(F.when(F.col("side") == "reference", F.col("n"))), F.lit(0)).alias("was"),
            F.coalesce(F.sum(F.when(F.col("side") == "current", F.col("n"))), F.lit(0)).alias("now"),
        )
    )
    whole = Window.partitionBy("feature")
    was = F.greatest(F.col("was") / F.sum("was").over(whole), F.lit(FLOOR))
    now = F.greatest(F.col("now") / F.sum("now").over(whole), F.lit(FLOOR))
    return counts.withColumn("part", (now - was) * F.log(now / was)).groupBy("feature").agg(F.sum("part").alias("psi"))


def drift_report(reference: DataFrame, current: DataFrame, features: list[str], bins: int = 10) -> DataFrame:
    """(feature, mean_shift, psi): shift in reference deviations, and the stability index over the
    reference's quantile bins (outer bins open)."""
    edges = open_edges(reference, features, bins)
    psi = stability_index(bin_counts(reference, edges), bin_counts(current, edges))

    def means(df: DataFrame, prefix: str) -> DataFrame:
        return long_form(df, features, []).groupBy("feature").agg(
            F.avg("value").alias(f"{prefix}_mean"), F.stddev_pop("value").alias(f"{prefix}_std")
        )

    shift = means(reference, "was").join(means(current, "now"), "feature")
    return shift.join(psi, "feature", "left").select(
        "feature",
        F.try_divide(F.col("now_mean") - F.col("was_mean"), F.col("was_std")).alias("mean_shift"),
        "psi",
    )


def rolling_std(
    df: DataFrame,
    features: list[str],
    key: str,
    by: list[str] | None = None,
    window: int = 5,
    rows_per_part: int = ROWS_PER_PART,
) -> DataFrame:
    """Sample deviation over each row and the `window - 1` rows before it, in key order.

    With `by`, within each group, else over the whole table (text keys then in the order of `text_order`). Rows are numbered in
    key order and cut into parts of equal size, and each part gets the last rows
    of the one before it; so no group, not even one of all rows, is one task's work.
    """
    by = by or []
    text = dict(df.dtypes)[key] == "string"
    placed = with_sample_id(df, key, by, text_prefix(key) if by and text else None)
    part = F.floor(F.col("sample_id") / rows_per_part)
    own = placed.withColumns({"__part": part, "__own": F.lit(True)})
    last = F.pmod("sample_id", F.lit(rows_per_part)) >= rows_per_part - (window - 1)
    before = placed.where(last).withColumns({"__part": part + 1, "__own": F.lit(False)})
    recent = Window.partitionBy(*by, "__part").orderBy("sample_id").rowsBetween(1 - window, 0)
    rolled = own.unionByName(before).withColumns({f"{c}_rolling_std": F.stddev_samp(c).over(recent) for c in features})
    return rolled.where("__own").drop("__part", "__own", "sample_id")
