"""Running counts over ordered values, split so that no feature is one task's work.

Rank tests, areas under curves and the curves themselves all need, for each
distinct value, the number of rows of each class below it. Rows are first
combined to distinct values (equal values, however many, leave each map task
as one row), then spread over value ranges. A window runs inside each range;
the ranges' totals supply the offsets.

Ranges have two levels: borders that hold equal shares of the rows, from one scan
that sketches all columns, and equal parts of the width between two borders.
Their number grows with the table, so a range has about as many rows at any size;
totals are summed over blocks of ranges first, then inside each block. Borders
enter the plan as literals, so a task that is run again after a lost executor
puts every row in the same range.
"""

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procsight.operators.quantiles import RankScan
from procsight.session import Scratch

ROWS_PER_RANGE = 200_000
# Borders of the first level, and ranges whose totals are summed by one task.
FIRST_LEVEL, BLOCK = 1024, 1024


class Ranges(dict):
    """Ascending inner borders by column; `ends`: least and largest value; `parts`: ranges between two borders."""

    def __init__(self, borders: dict[str, list[float]], ends: dict[str, tuple[float, float]] | None = None, parts: int = 1):
        super().__init__(borders)
        self.ends, self.parts = ends or {}, parts


def range_borders(
    df: DataFrame, columns: list[str], rows_per_range: int = ROWS_PER_RANGE, first_level: int = FIRST_LEVEL
) -> Ranges:
    """The ranges of numeric columns; no borders where one range is enough. One scan."""
    with Scratch(df.sparkSession) as scratch:
        plain = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
        scan = RankScan(plain, columns, scratch)
        total = math.ceil(max(scan.n.values(), default=0) / rows_per_range)
        if total <= 1:
            return Ranges({c: [] for c in columns})
        level = min(total, first_level)
        marks = scan.marks({(c,): [i / level for i in range(level + 1)] for c in columns})
    inner, ends = {}, {}
    for c in columns:
        own = [float(m) for m in marks[(c,)]]
        inner[c] = sorted(set(own[1:-1]))
        ends[c] = (own[0], own[-1]) if own else (0.0, 0.0)
    return Ranges(inner, ends, math.ceil(total / level))


def with_ranges(df: DataFrame, borders: dict[str, list[float]]) -> DataFrame:
    """Add a column `<name>__range` per column, which grows with the value."""
    columns = list(borders)
    parts = getattr(borders, "parts", 1)
    # Without borders the values fall on both sides of 0.
    splits = [[float("-inf"), *(borders[c] or [0.0]), float("inf")] for c in columns]
    placed = Bucketizer(
        inputCols=columns,
        outputCols=[f"{c}__range" for c in columns],
        splitsArray=splits,
        handleInvalid="keep",
    ).transform(df)

    def number(c: str):
        place = F.col(f"{c}__range").cast("int")
        if parts == 1 or not borders[c]:
            return place
        low, high = borders.ends[c]
        marks = [low, *borders[c], high]
        under = F.element_at(F.array(*[F.lit(m) for m in marks[:-1]]), place + 1)
        over = F.element_at(F.array(*[F.lit(m) for m in marks[1:]]), place + 1)
        share = F.when(over > under, (F.col(c) - under) / (over - under)).otherwise(F.lit(0.0))
        inside = F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor(share * parts))).cast("int")
        # Missing values have one place more than there are borders' gaps.
        return F.when(place < len(marks) - 1, place * parts + inside).otherwise(place * parts)

    return placed.withColumns({f"{c}__range": number(c) for c in columns})


def ranged_long_form(
    df: DataFrame, features: list[str], keep: list[str], rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """One row per (row, feature) with `feature`, `value`, `range`; nulls are left out."""
    plain = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in features])
    placed = with_ranges(plain, range_borders(plain, features, rows_per_range))
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"), F.col(c).alias("value"), F.col(f"{c}__range").alias("range")
            )
            for c in features
        ]
    )
    return (
        placed.select(*keep, F.explode(cells).alias("cell"))
        .select(*keep, "cell.feature", "cell.value", "cell.range")
        .filter(F.col("value").isNotNull())
    )


def class_counts(values: DataFrame, by: list[str], label: str) -> DataFrame:
    """Per distinct value: rows of each class (`n0`, `n1`), and those below it in the same range."""
    distinct = values.groupBy(*by, "range", "value").agg(
        F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")
    )
    below = (
        Window.partitionBy(*by, "range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    )
    return distinct.withColumns(
        {
            "below0": F.coalesce(F.sum("n0").over(below), F.lit(0)),
            "below1": F.coalesce(F.sum("n1").over(below), F.lit(0)),
        }
    )


def running_totals(totals: DataFrame, by: list[str], names: list[str], order: str = "range") -> DataFrame:
    """Add to totals(by, order, names) `<name>_before` (sum over lower ranges) and `<name>_all`, block by block."""
    block = F.floor(F.col(order) / BLOCK).alias("__block")
    blocked = totals.withColumn("__block", block)
    inside = Window.partitionBy(*by, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    lower = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    sums = blocked.groupBy(*by, "__block").agg(*[F.sum(x).alias(f"__{x}") for x in names])
    offsets = sums.select(
        *by,
        "__block",
        *[F.coalesce(F.sum(f"__{x}").over(lower), F.lit(0)).alias(f"__{x}_before") for x in names],
        *[F.sum(f"__{x}").over(whole).alias(f"{x}_all") for x in names],
    )
    placed = blocked.withColumns({f"{x}_before": F.coalesce(F.sum(x).over(inside), F.lit(0)) for x in names})
    joined = placed.join(offsets, [*by, "__block"])
    return joined.withColumns({f"{x}_before": F.col(f"{x}_before") + F.col(f"__{x}_before") for x in names}).drop(
        "__block", *[f"__{x}_before" for x in names]
    )


def range_offsets(counts: DataFrame, by: list[str]) -> DataFrame:
    """Rows of each class in all lower ranges, and in the group."""
    totals = counts.groupBy(*by, "range").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    return running_totals(totals, by, ["n0", "n1"]).select(
        *by,
        "range",
        *[F.col(f"n{i}_before").alias(f"offset{i}") for i in (0, 1)],
        *[F.col(f"n{i}_all").alias(f"total{i}") for i in (0, 1)],
    )


def cumulative_counts(values: DataFrame, by: list[str], label: str) -> DataFrame:
    """`class_counts` with `below0`/`below1` over the whole group, and the group totals."""
    counts = class_counts(values, by, label)
    placed = counts.join(range_offsets(counts, by), [*by, "range"])
    return placed.select(
        *by,
        "value",
        "n0",
        "n1",
        (F.col("below0") + F.col("offset0")).alias("below0"),
        (F.col("below1") + F.col("offset1")).alias("below1"),
        "total0",
        "total1",
    )


def rank_sums(values: DataFrame, by: list[str], label: str) -> DataFrame:
    """Per group: class sizes, the U statistic of class 1 (half for ties) and the tie term.

    Each range contributes its inner pairs and, times its defect rows, the normal
    rows of all lower ranges, so nothing is joined back to the values.
    """
    counts = class_counts(values, by, label)
    size = (F.col("n0") + F.col("n1")).cast("double")
    inner = F.col("n1").cast("double") * (F.col("below0") + F.col("n0") / 2)
    per_range = counts.groupBy(*by, "range").agg(
        F.sum("n0").alias("n0"),
        F.sum("n1").alias("n1"),
        F.sum(inner).alias("u_inner"),
        F.sum(size * size * size - size).alias("ties"),
    )
    pairs = F.col("u_inner") + F.col("n1").cast("double") * F.col("n0_before")
    return (
        running_totals(per_range, by, ["n0"])
        .withColumn("u", pairs)
        .groupBy(*by)
        .agg(
            F.sum("n0").alias("n_normal"),
            F.sum("n1").alias("n_defect"),
            F.sum("u").alias("u_defect"),
            F.sum("ties").alias("tie_term"),
        )
    )
