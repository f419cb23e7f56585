"""Scoring and monitoring of rows that arrive as a stream."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procsight.operators.drift import bin_counts, stability_index
from procsight.operators.scoring import THRESHOLD, confidence, decide


def stream_score(
    rows: DataFrame, score, name: str = "probability_calibrated", threshold: float = THRESHOLD
) -> DataFrame:
    """The batch scorer on a streaming frame: `score` adds the probability `name`. Stateless."""
    p = F.col(name)
    return score(rows).withColumns(
        {"prediction": decide(p, threshold), "confidence": confidence(p, threshold)}
    )


def stream_monitor(
    rows: DataFrame,
    time: str,
    positive: str,
    value: str | None = None,
    window: str = "10 minutes",
    late: str = "10 minutes",
) -> DataFrame:
    """(window_start, n, n_positive, positive_rate, mean_value) per tumbling window.

    Works on streaming frames, where windows close after the watermark, and on
    batch frames alike.
    """
    framed = rows.withColumn(time, F.col(time).cast("timestamp"))
    if rows.isStreaming:
        framed = framed.withWatermark(time, late)
    counted = framed.groupBy(F.window(time, window).alias("span")).agg(
        F.count("*").alias("n"),
        F.sum(F.col(positive).cast("bigint")).alias("n_positive"),
        F.avg(value or F.lit(None).cast("double")).alias("mean_value"),
    )
    return counted.select(
        F.col("span.start").alias("window_start"),
        "n",
        "n_positive",
        (F.col("n_positive") / F.col("n")).alias("positive_rate"),
        "mean_value",
    )


def start_drift(rows: DataFrame, edges: dict[str, list[float]], folder: str):
    """Start counting a stream's rows in the bins of a reference; returns the query.

    The state is one count for each feature and bin. Every batch appends the counts that it changed to a table of
    files, under its number, so a batch that is run again changes nothing.
    """

    def append(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/counts/batch={batch}")

    return (
        bin_counts(rows, edges)
        .writeStream.foreachBatch(append)
        .outputMode("update")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )


def latest_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(feature, bin, n) as of the last batch that `start_drift` has written."""
    written = spark.read.parquet(f"{folder}/counts")
    return written.groupBy("feature", "bin").agg(F.max_by("n", "batch").alias("n"))


def stream_drift(spark: SparkSession, folder: str, reference: DataFrame) -> DataFrame:
    """(feature, n, psi): rows seen so far, and how far they are from the reference's `bin_counts`."""
    now = latest_counts(spark, folder)
    seen = now.groupBy("feature").agg(F.sum("n").alias("n"))
    return seen.join(stability_index(reference, now), "feature")
