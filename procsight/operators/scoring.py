"""Decisions, confidence and the result tables of a scoring run."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procsight import KEY
from procsight.functions.columns import text_order
from procsight.operators.quantiles import SKETCH, exact_quantiles
from procsight.operators.ranks import range_borders, running_totals, with_ranges

# The production threshold and the triage bands.
THRESHOLD = 0.25
BANDS = [(0.50, "HOLD"), (0.30, "INSPECT")]
LOWEST_BANDS = ("MONITOR", "RELEASE")


def decide(probability: Column, threshold: float = THRESHOLD) -> Column:
    return (probability >= threshold).cast("int")


def confidence(probability: Column, threshold: float = THRESHOLD) -> Column:
    """Distance from the threshold, as a share of the larger side, within 0..1."""
    scaled = F.abs(probability - threshold) / max(threshold, 1 - threshold)
    return F.greatest(F.least(scaled, F.lit(1.0)), F.lit(0.0))


def predictions_table(
    scored: DataFrame,
    raw: str = "probability_raw",
    calibrated: str = "probability_calibrated",
    key: str = KEY,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The predictions, with the row's own key."""
    p = F.col(calibrated)
    return scored.select(
        key,
        F.col(raw).alias("probability_raw"),
        p.alias("probability_calibrated"),
        decide(p, threshold).alias("prediction"),
        confidence(p, threshold).alias("confidence"),
        F.lit(threshold).alias("threshold"),
    )


def with_sample_id(
    predictions: DataFrame, key: str = KEY, by: list[str] | None = None, order: Column | None = None
) -> DataFrame:
    """Add `sample_id` 0..n-1 in each group of `by`, ordered by the number `order`, then by key.

    Without `order` numeric keys come in their own order and text keys in that of `text_order`.

    Keys are split into ranges first, so neither the numbering nor a group that has most rows is one task's work.
    """
    by = by or []
    if order is None:
        order = text_order(key) if dict(predictions.dtypes)[key] == "string" else F.col(key)
    # A text, as rows with a null in `by` are a group too.
    group = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in by])
    placed = with_ranges(
        predictions.withColumns({"__order": order, "__key": order.cast("double"), "__by": group}),
        range_borders(predictions.select(order.cast("double").alias("__key")), ["__key"]),
    )
    sizes = placed.groupBy("__by", "__key__range").agg(F.count("*").alias("__n"))
    offsets = running_totals(sizes, ["__by"], ["__n"], "__key__range").select(
        "__by", "__key__range", F.col("__n_before").alias("__offset")
    )
    inside = Window.partitionBy("__by", "__key__range").orderBy("__order", key)
    numbered_rows = placed.join(offsets, ["__by", "__key__range"]).withColumn(
        "sample_id", F.col("__offset") + F.row_number().over(inside) - 1
    )
    return numbered_rows.select("sample_id", *predictions.columns)


def predictions_detailed(
    scored: DataFrame,
    features: list[str],
    engineered: list[str],
    calibrated: str = "probability_calibrated",
    key: str = KEY,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Key, decision, probability and confidence, followed by all model inputs."""
    p = F.col(calibrated)
    return scored.select(
        key,
        decide(p, threshold).alias("prediction"),
        p.alias("probability_calibrated"),
        confidence(p, threshold).alias("confidence"),
        *features,
        *[F.col(f"`{c}`") for c in engineered],
    )


def prediction_summary(
    predictions: DataFrame,
    probability: str = "probability_calibrated",
    threshold: float = THRESHOLD,
    model: str = "gradient-boosted hybrid",
    original: int = 49,
    engineered: int = 15,
    size: int = SKETCH,
) -> DataFrame:
    """(position, metric, value): counts, moments, quartiles and run facts, as text."""
    quartiles = exact_quantiles(predictions, [probability], [0.25, 0.5, 0.75], size=size)
    low, middle, high = quartiles.get((probability,), [None] * 3)
    p = F.col(probability)
    sums = predictions.agg(
        F.count("*").alias("n"),
        F.count_if(p >= threshold).alias("defects"),
        F.avg(p).alias("mean"),
        F.stddev_pop(p).alias("std"),
        F.min(p).alias("least"),
        F.max(p).alias("most"),
    )

    def four(value: Column) -> Column:
        return F.format_string("%.4f", F.round(value, 4))

    share = F.format_string("%.2f%%", F.round(100 * F.col("defects") / F.col("n"), 2))
    other = F.format_string(
        "%.2f%%", F.round(100 * (F.col("n") - F.col("defects")) / F.col("n"), 2)
    )
    lines = [
        ("Total Samples", F.col("n").cast("string")),
        ("Defect Predictions", F.col("defects").cast("string")),
        ("Normal Predictions", (F.col("n") - F.col("defects")).cast("string")),
        ("Defect Rate (%)", share),
        ("Mean Probability", four(F.col("mean"))),
        ("Std Probability", four(F.col("std"))),
        ("Min Probability", four(F.col("least"))),
        ("Max Probability", four(F.col("most"))),
        ("Threshold Used", F.lit(str(threshold))),
        ("Model", F.lit(model)),
        ("Features (Original)", F.lit(str(original))),
        ("Features (Engineered)", F.lit(str(engineered))),
        ("Features (Total)", F.lit(str(original + engineered))),
        ("Calibration Method", F.lit("Sigmoid (Platt scaling)")),
        ("Normal Rate (%)", other),
        ("Median", four(F.lit(middle).cast("double"))),
        ("Percentile 25", four(F.lit(low).cast("double"))),
        ("Percentile 75", four(F.lit(high).cast("double"))),
    ]
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(name).alias("metric"), value.alias("value"))
            for i, (name, value) in enumerate(lines)
        ]
    )
    return sums.select(F.inline(rows))


def triage_band(probability: Column, threshold: float = THRESHOLD) -> Column:
    """HOLD, INSPECT, MONITOR or RELEASE, by the documented limits."""
    steps = [F.when(probability > limit, name) for limit, name in BANDS]
    steps.append(F.when(probability >= threshold, LOWEST_BANDS[0]))
    return F.coalesce(*steps, F.lit(LOWEST_BANDS[1]))


def triage_bands(scored: DataFrame, probability: str, threshold: float = THRESHOLD) -> DataFrame:
    """(band, n)."""
    band = triage_band(F.col(probability), threshold).alias("band")
    return scored.groupBy(band).agg(F.count("*").alias("n"))


def defects_only(predictions: DataFrame, key: str = KEY) -> DataFrame:
    """Positive predictions, highest probability first."""
    return predictions.filter(F.col("prediction") == 1).orderBy(F.desc("probability_calibrated"), key)
