"""Column helpers shared by the operators. All of them build expressions only."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procsight import PREFIX


def feature_columns(df: DataFrame, prefix: str = PREFIX) -> list[str]:
    """Names of the measurement columns, in schema order. Metadata only, no job."""
    return [field.name for field in df.schema.fields if field.name.startswith(prefix)]


def feature_number(feature: Column) -> Column:
    """The number inside a feature name: 'X12' -> 12."""
    return F.regexp_extract(feature, r"(\d+)", 1).cast("int")


def finite_or_zero(value: Column) -> Column:
    """Null, NaN and both infinities become 0."""
    broken = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(broken, F.lit(0.0)).otherwise(value)


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """Division that yields 0 where the denominator is 0 or the result is not finite."""
    return finite_or_zero(F.try_divide(numerator, denominator))


def total(terms: list[str]) -> Column:
    """Sum of SQL terms over one row, as one flat codegen expression."""
    return F.expr(" + ".join(terms))


def long_form(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """One row per (row, feature): the kept columns plus `feature` and `value`."""
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in features]).unpivot(
        keep, features, "feature", "value"
    )


def feature_table(df: DataFrame, features: list[str]) -> DataFrame:
    """The feature dimension (feature, position): as many rows as the table has features."""
    rows = [(name, position) for position, name in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "feature string, position int")


def with_position(report: DataFrame, features: list[str]) -> DataFrame:
    """Add the schema position of `feature` to a report, to break ties the way a stable sort does."""
    names = F.array(*[F.lit(name) for name in features])
    return report.withColumn("position", F.array_position(names, F.col("feature")).cast("int") - 1)


def text_order(key: str):
    """A 60-bit number by which rows with text keys are ordered; any engine that has MD5 gives the same."""
    return _mark(F.col(key).cast("string"))


def text_prefix(key: str):
    """The first 7 bytes of a text key as a number: larger for keys that sort later, equal for keys that begin alike."""
    first = F.hex(F.substring(F.col(key).cast("string").cast("binary"), 1, 7))
    return F.conv(F.rpad(first, 14, "0"), 16, 10).cast("bigint")


def key_mark(keys: list, seed: int):
    """A 60-bit number of some columns and a seed, joined by `|`; any engine that has MD5 gives the same."""
    return _mark(F.concat_ws("|", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in keys], F.lit(str(seed))))


def _mark(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")
