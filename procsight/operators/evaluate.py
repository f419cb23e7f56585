"""Ranking metrics, curves and decision thresholds on tables of scored rows."""

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procsight.operators.ranks import (
    ROWS_PER_RANGE,
    cumulative_counts,
    range_borders,
    rank_sums,
    with_ranges,
)

# The weights of the industrial score.
RECALL_WEIGHT = 0.6
PRECISION_WEIGHT = 0.4


def zero_divide(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Accuracy, precision, recall and F1 of a 2 x 2 table; 0 where a denominator is 0."""
    return {
        "accuracy": zero_divide(tp + tn, tp + fp + fn + tn),
        "precision": zero_divide(tp, tp + fp),
        "recall": zero_divide(tp, tp + fn),
        "f1": zero_divide(2 * tp, 2 * tp + fp + fn),
    }


def cell_counts(df: DataFrame, label: str, pred: str, by: list[str]) -> DataFrame:
    """tp, fp, fn, tn per group."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    return df.groupBy(*by).agg(
        F.count_if(y & p).alias("tp"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
        F.count_if(~y & ~p).alias("tn"),
    )


def confusion_matrix(df: DataFrame, label: str, pred: str) -> DataFrame:
    """(actual, predicted, n): all four cells, empty ones too."""
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(c).alias("n"))
            for a, p, c in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))
        ]
    )
    return cell_counts(df, label, pred, []).select(F.inline(cells))


def classification_metrics(
    df: DataFrame, label: str, pred: str, by: list[str] | None = None
) -> DataFrame:
    """accuracy, precision, recall, f1 per group."""
    by = by or []
    cells = cell_counts(df, label, pred, by)
    measures = rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    return cells.select(*by, *[column.alias(name) for name, column in measures.items()])


def classification_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """(row_name, precision, recall, f1, support) per class, plus accuracy and both averages."""
    cells = cell_counts(df, label, pred, [])
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    defect = rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    normal = rates(*[F.col(c) for c in ("tn", "fn", "fp", "tp")])
    supports = {"Normal": F.col("tn") + F.col("fp"), "Defect": F.col("tp") + F.col("fn")}
    names = ("precision", "recall", "f1")

    def line(title: str, values: list[Column], support: Column) -> Column:
        measures = [v.cast("double").alias(m) for m, v in zip(names, values)]
        return F.struct(F.lit(title).alias("row_name"), *measures, support.alias("support"))

    macro = [(normal[m] + defect[m]) / 2 for m in names]
    weighted = [
        zero_divide(normal[m] * supports["Normal"] + defect[m] * supports["Defect"], n) for m in names
    ]
    return cells.select(
        F.inline(
            F.array(
                line("Normal", [normal[m] for m in names], supports["Normal"]),
                line("Defect", [defect[m] for m in names], supports["Defect"]),
                line("accuracy", [defect["accuracy"]] * 3, n),
                line("macro avg", macro, n),
                line("weighted avg", weighted, n),
            )
        )
    )


def _ranged_scores(
    df: DataFrame, score: str, label: str, by: list[str], rows_per_range: int
) -> DataFrame:
    plain = df.select(*by, F.col(score).cast("double").alias("value"), F.col(label).alias("__label"))
    plain = plain.filter(F.col("value").isNotNull())
    return with_ranges(plain, range_borders(plain, ["value"], rows_per_range)).withColumnRenamed(
        "value__range", "range"
    )


def descending_counts(
    df: DataFrame, score: str, label: str, by: list[str] | None = None, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """(by, score, tp, fp, n_pos, n_neg): counts with a score at or above each distinct score."""
    by = by or []
    counts = cumulative_counts(_ranged_scores(df, score, label, by, rows_per_range), by, "__label")
    return counts.select(
        *by,
        F.col("value").alias("score"),
        (F.col("total1") - F.col("below1")).alias("tp"),
        (F.col("total0") - F.col("below0")).alias("fp"),
        F.col("total1").alias("n_pos"),
        F.col("total0").alias("n_neg"),
        "n0",
        "n1",
    )


def roc_curve(
    df: DataFrame, score: str, label: str, by: list[str] | None = None, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """(by, threshold, fpr, tpr) at each distinct score, plus (0, 0) at a null threshold."""
    by = by or []
    counts = descending_counts(df, score, label, by, rows_per_range)
    point = _point("score", fpr=F.try_divide("fp", "n_neg"), tpr=F.try_divide("tp", "n_pos"))
    return _with_start(counts, by, point, _point(None, fpr=F.lit(0.0), tpr=F.lit(0.0)))


def _point(threshold: str | None, **values: Column) -> Column:
    mark = F.col(threshold) if threshold else F.lit(None).cast("double")
    return F.struct(mark.alias("threshold"), *[v.alias(name) for name, v in values.items()])


def _with_start(counts: DataFrame, by: list[str], point: Column, start: Column) -> DataFrame:
    """One point per score; the highest score of each group adds the curve's starting point."""
    highest = (F.col("tp") == F.col("n1")) & (F.col("fp") == F.col("n0"))
    points = F.when(highest, F.array(start, point)).otherwise(F.array(point))
    return counts.select(*by, F.inline(points))


def roc_auc(
    df: DataFrame, score: str, label: str, by: list[str] | None = None, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """(by, n_neg, n_pos, roc_auc): U / (n0 n1), half for ties; null if a class is missing."""
    by = by or []
    sums = rank_sums(_ranged_scores(df, score, label, by, rows_per_range), by, "__label")
    pairs = F.col("n_normal").cast("double") * F.col("n_defect")
    return sums.select(
        *by,
        F.col("n_normal").alias("n_neg"),
        F.col("n_defect").alias("n_pos"),
        F.try_divide("u_defect", pairs).alias("roc_auc"),
    )


def pr_curve(
    df: DataFrame, score: str, label: str, by: list[str] | None = None, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """(by, threshold, precision, recall) at each distinct score, plus (1, 0) at a null threshold."""
    by = by or []
    counts = descending_counts(df, score, label, by, rows_per_range)
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    point = _point("score", precision=precision, recall=F.try_divide("tp", "n_pos"))
    return _with_start(counts, by, point, _point(None, precision=F.lit(1.0), recall=F.lit(0.0)))


def pr_auc(
    df: DataFrame, score: str, label: str, by: list[str] | None = None, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """(by, pr_auc): trapezoids under the precision-recall curve.

    The trapezoid that ends at a score starts at the next higher one, whose
    counts follow from the score's own; so no row looks at its neighbour.
    """
    by = by or []
    counts = descending_counts(df, score, label, by, rows_per_range)
    tp, fp = F.col("tp"), F.col("fp")
    tp_above, fp_above = tp - F.col("n1"), fp - F.col("n0")
    above = F.coalesce(F.try_divide(tp_above, tp_above + fp_above), F.lit(1.0))
    area = F.try_divide(F.col("n1"), F.col("n_pos")) * (tp / (tp + fp) + above) / 2
    return counts.groupBy(*by).agg(F.sum(area).alias("pr_auc"))


def threshold_grid(points: int = 101) -> list[float]:
    """Evenly spaced thresholds from 0 to 1."""
    return [float(t) for t in np.linspace(0, 1, points)]


def threshold_sweep(
    df: DataFrame,
    score: str,
    label: str,
    grid: list[float] | None = None,
    by: list[str] | None = None,
) -> DataFrame:
    """(by, threshold, tp, fp, fn, tn, precision, recall, f1, industrial_score), predicting 1 at score >= t.

    One pass: each row is put in the interval between two thresholds, and the
    counts of at most len(grid) + 1 intervals are accumulated from above.
    """
    grid, by = grid or threshold_grid(), by or []
    plain = df.select(*by, F.col(score).cast("double").alias("value"), F.col(label).alias("__label"))
    placed = Bucketizer(
        inputCol="value",
        outputCol="reached",
        splits=[float("-inf"), *grid, float("inf")],
        handleInvalid="skip",
    ).transform(plain)
    pieces = placed.groupBy(*by, F.col("reached").cast("int").alias("reached")).agg(
        F.count_if(F.col("__label") == 1).alias("pos"), F.count_if(F.col("__label") == 0).alias("neg")
    )
    thresholds = F.array(
        *[
            F.struct(F.lit(t).alias("threshold"), F.lit(i + 1).alias("place"))
            for i, t in enumerate(grid)
        ]
    )
    # Sums over the pieces at or above each threshold: (grid + 1) x grid additions on report rows.
    summed = (
        pieces.withColumn("cut", F.explode(thresholds))
        .groupBy(*by, "cut")
        .agg(
            F.sum(F.when(F.col("reached") >= F.col("cut.place"), F.col("pos")).otherwise(0)).alias("tp"),
            F.sum(F.when(F.col("reached") >= F.col("cut.place"), F.col("neg")).otherwise(0)).alias("fp"),
            F.sum(F.when(F.col("reached") < F.col("cut.place"), F.col("pos")).otherwise(0)).alias("fn"),
            F.sum(F.when(F.col("reached") < F.col("cut.place"), F.col("neg")).otherwise(0)).alias("tn"),
        )
        .select(*by, F.col("cut.threshold").alias("threshold"), "tp", "fp", "fn", "tn")
    )
    measures = rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    return summed.withColumns(
        {m: measures[m] for m in ("precision", "recall", "f1")}
    ).withColumn("industrial_score", industrial_score(F.col("precision"), F.col("recall")))


def industrial_score(precision: Column, recall: Column) -> Column:
    return RECALL_WEIGHT * recall + PRECISION_WEIGHT * precision


def optimal_threshold(
    sweep: DataFrame,
    metric: str = "f1",
    by: list[str] | None = None,
    fallback: float | None = 0.5,
) -> DataFrame:
    """(by, metric, threshold, best): the lowest threshold with the largest metric.

    With a fallback, that threshold is given where the best value is 0; None
    takes the first threshold of the sweep there.
    """
    if metric not in ("f1", "recall", "precision", "industrial_score"):
        raise ValueError(f"unknown metric: {metric}")
    by = by or []
    best = sweep.groupBy(*by).agg(
        F.max_by("threshold", F.struct(F.col(metric), -F.col("threshold"))).alias("threshold"),
        F.max(metric).alias("best"),
    )
    if fallback is not None:
        best = best.withColumn(
            "threshold", F.when(F.col("best") > 0, F.col("threshold")).otherwise(F.lit(fallback))
        )
    return best.select(*by, F.lit(metric).alias("metric"), "threshold", "best")


def optimum_row(sweep: DataFrame, metric: str = "f1") -> DataFrame:
    """The whole sweep row at the optimum."""
    names = [c for c in sweep.columns]
    return sweep.agg(
        F.max_by(F.struct(*names), F.struct(F.col(metric), -F.col("threshold"))).alias("best")
    ).select("best.*")


def cost_threshold(sweep: DataFrame, cost_fn: float, cost_fp: float) -> DataFrame:
    """(threshold, cost): the lowest threshold of least total cost."""
    priced = sweep.withColumn("cost", F.col("fn") * cost_fn + F.col("fp") * cost_fp)
    return priced.agg(
        F.min_by("threshold", F.struct("cost", "threshold")).alias("threshold"),
        F.min("cost").alias("cost"),
    )


def fold_metrics(
    scored: DataFrame, score: str, label: str, by: list[str], threshold: float = 0.5
) -> DataFrame:
    """(by, metric, value) in long form: roc_auc, f1, precision, recall, accuracy per group."""
    decided = scored.withColumn("__pred", (F.col(score) >= threshold).cast("int"))
    counted = classification_metrics(decided, label, "__pred", by)
    areas = roc_auc(scored, score, label, by).select(*by, "roc_auc")
    metrics = ["roc_auc", "f1", "precision", "recall", "accuracy"]
    return counted.join(areas, by).unpivot(by, metrics, "metric", "value")


def model_comparison(results: DataFrame) -> DataFrame:
    """One row per model: mean and population deviation of each metric over the folds."""
    metrics = ["roc_auc", "f1", "precision", "recall", "accuracy"]
    return _summary(results, metrics, F.stddev_pop)


def performance_tracker(*results: DataFrame) -> DataFrame:
    """Appended fold results; mean and sample deviation of each metric by model."""
    everything = results[0]
    for more in results[1:]:
        everything = everything.unionByName(more)
    return _summary(everything, ["accuracy", "precision", "recall", "f1", "roc_auc"], F.stddev_samp)


def _summary(results: DataFrame, metrics: list[str], deviation) -> DataFrame:
    return (
        results.groupBy("model")
        .pivot("metric", metrics)
        .agg(F.avg("value").alias("mean"), deviation("value").alias("std"))
    )


def strategy_comparison(results: DataFrame) -> DataFrame:
    """The imbalance strategies side by side."""
    summary = _summary(results, ["roc_auc", "f1", "precision", "recall"], F.stddev_pop)
    return summary.select(
        F.col("model").alias("strategy"),
        "roc_auc_mean",
        "roc_auc_std",
        "f1_mean",
        "f1_std",
        "precision_mean",
        "recall_mean",
    )


def fold_roc_curves(scored: DataFrame, score: str, label: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """ROC points and areas per model and fold."""
    return roc_curve(scored, score, label, by), roc_auc(scored, score, label, by)
