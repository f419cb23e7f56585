"""Readers and writers of measurement tables, reports and predictions."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from procsight import KEY, LABEL
from procsight.functions.columns import feature_columns
from procsight.operators.cleaning import coerce_numeric


def read_measurements(
    spark: SparkSession, path: str, fmt: str = "csv", schema: StructType | str | None = None
) -> DataFrame:
    """A measurement table. CSV files have a header; without a schema their columns stay text,
    so that no extra pass over the files infers types and `coerce_numeric` decides what a number is."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if fmt == "csv":
        return reader.csv(path, header=True)
    return reader.format(fmt).load(path)


def read_typed(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """`read_measurements` with measurements as doubles, the key as long and the label as int."""
    raw = read_measurements(spark, path, fmt)
    df = coerce_numeric(raw, feature_columns(raw))
    kinds = {KEY: "bigint", LABEL: "int"}
    return df.withColumns({c: df[c].try_cast(kind) for c, kind in kinds.items() if c in df.columns})


def read_cleaned(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A cleaned table, as written by `write_cleaned`."""
    return read_typed(spark, path, fmt) if fmt == "csv" else spark.read.format(fmt).load(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_cleaned(train: DataFrame, test: DataFrame, folder: str, fmt: str = "parquet") -> tuple[str, str]:
    """Write both cleaned tables; returns their paths."""
    paths = f"{folder}/train_cleaned", f"{folder}/test_cleaned"
    write_table(train, paths[0], fmt)
    write_table(test, paths[1], fmt)
    return paths


def write_reports(reports: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """One folder per report. Reports have at most p^2 rows, so one file each is enough."""
    for name, report in reports.items():
        write_table(report.coalesce(1), f"{folder}/{name}", fmt)


def read_reports(spark: SparkSession, folder: str, names: list[str], fmt: str = "parquet") -> dict[str, DataFrame]:
    """Report tables written by `write_reports`."""
    reader = spark.read.option("header", True).option("inferSchema", True) if fmt == "csv" else spark.read
    return {name: reader.format(fmt).load(f"{folder}/{name}") for name in names}


EDA_TABLES = ["instability", "interactions", "redundancy", "univariate"]


def read_eda_tables(spark: SparkSession, folder: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """The four report tables that steer feature building."""
    return read_reports(spark, folder, EDA_TABLES, fmt)


def write_predictions(
    predictions: DataFrame, detailed: DataFrame, summary: DataFrame, folder: str, fmt: str = "parquet"
) -> None:
    """Predictions, detailed predictions, and the summary as a small table."""
    write_table(predictions, f"{folder}/predictions", fmt)
    write_table(detailed, f"{folder}/predictions_detailed", fmt)
    write_table(summary.coalesce(1), f"{folder}/prediction_summary", fmt)


def write_summary_text(summary: DataFrame, path: str) -> None:
    """The summary as a text file of aligned lines."""
    line = F.concat(F.rpad("metric", 24, " "), "value").alias("value")
    summary.coalesce(1).sortWithinPartitions("position").select(line).write.mode("overwrite").text(path)
