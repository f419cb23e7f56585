"""Deterministic numbering, folds and exact samples, all driven by a hash of the row key.

The hash is the first 60 bits of an MD5, so any engine can repeat a draw. Rows are
spread over its upper bits, which are even whatever the keys look like, so that neither a rare nor a dominating class is ever numbered
in one task. Only the bucket totals, a bounded table, are ordered globally.
"""

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procsight import KEY, LABEL
from procsight.functions.columns import key_mark
from procsight.functions.marks import Texts, marks
from procsight.session import Scratch

# 16,384 buckets: the totals stay a small table, and a bucket of a table of 10^11 rows is still one
# task's work.
BUCKET_BITS = 14
HASH_BITS = 60
ROWS_PER_TASK = 1_000_000
# Hashes of one class and bag that are counted one by one.
MOST_HASHES = 1_000_000
SEED = 42


def hashed(keys: list, seed: int):
    return key_mark(keys, seed)


def unit(column):
    """A hash as a number in [0, 1)."""
    return F.pmod(column, F.lit(2**52)).cast("double") / F.lit(float(2**52))


def _bucketed(df: DataFrame, keys: list[str], seed: int) -> DataFrame:
    mark = hashed(keys, seed)
    return df.withColumn("__hash", mark).withColumn(
        "__bucket", F.shiftright("__hash", HASH_BITS - BUCKET_BITS)
    )


def _bucket_offsets(bucketed: DataFrame, by: list[str]) -> DataFrame:
    earlier = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = bucketed.groupBy(*by, "__bucket").agg(F.count("*").alias("__count"))
    return counts.withColumn("__offset", F.coalesce(F.sum("__count").over(earlier), F.lit(0)))


def numbered(
    df: DataFrame, by: list[str], keys: list[str], name: str = "position", seed: int = SEED, rows: int = 0
) -> DataFrame:
    """Add a 0-based gapless number within each group, in hash order.

    `rows`, where known, keeps the tasks of a large table small enough to sort in memory.
    """
    bucketed = _bucketed(df, keys, seed)
    offsets = _bucket_offsets(bucketed, by).select(*by, "__bucket", "__offset")
    parts = math.ceil(rows / ROWS_PER_TASK)
    if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        bucketed, offsets = (x.repartition(parts, *by, "__bucket") for x in (bucketed, offsets))
    inside = Window.partitionBy(*by, "__bucket").orderBy("__hash", *keys)
    return (
        bucketed.join(offsets, [*by, "__bucket"])
        .withColumn(name, F.col("__offset") + F.row_number().over(inside) - 1)
        .drop("__hash", "__bucket", "__offset")
    )


def stratified_folds(
    df: DataFrame, label: str = LABEL, key: str = KEY, k: int = 5, seed: int = SEED, rows: int = 0
) -> DataFrame:
    """Add `fold` in 0..k-1; per class the fold sizes differ by at most one."""
    return numbered(df, [label], [key], "__place", seed, rows).withColumn(
        "fold", F.pmod("__place", F.lit(k)).cast("int")
    ).drop("__place")


def hash_sample(
    df: DataFrame, by: list[str], keys: list[str], sizes: DataFrame, seed: int = SEED
) -> DataFrame:
    """Exactly `sizes.size` rows per group (all rows of smaller groups): those of lowest hash.

    Buckets that lie wholly inside the sample are kept as they are, only the one
    bucket per group where the sample ends is ordered.
    """
    bucketed = _bucketed(df, keys, seed)
    offsets = _bucket_offsets(bucketed, by).join(sizes, by)
    spans = offsets.filter(F.col("__offset") < F.col("size")).select(
        *by,
        "__bucket",
        (F.col("size") - F.col("__offset")).alias("__left"),
        (F.col("size") - F.col("__offset") < F.col("__count")).alias("__partial"),
    )
    kept = bucketed.join(spans, [*by, "__bucket"])
    inside = Window.partitionBy(*by, "__bucket").orderBy("__hash", *keys)
    last = (
        kept.filter("__partial")
        .withColumn("__place", F.row_number().over(inside))
        .filter(F.col("__place") <= F.col("__left"))
        .drop("__place")
    )
    return kept.filter(~F.col("__partial")).unionByName(last).drop(
        "__hash", "__bucket", "__left", "__partial"
    )


def class_weights(
    df: DataFrame, label: str = LABEL, mode: str | float = "balanced", name: str = "weight"
) -> DataFrame:
    """Add a row weight.

    A number is the weight of the positive class; 'unbalance' gives it
    n_normal / n_defect; 'balanced' gives every class n / (classes * n_class).
    """
    positive = F.col(label) == 1
    if not isinstance(mode, str):
        return df.withColumn(name, F.when(positive, F.lit(float(mode))).otherwise(F.lit(1.0)))
    sizes = df.agg(
        F.count_if(~positive).alias("normal"), F.count_if(positive).alias("defect")
    ).first()
    if not sizes["normal"] or not sizes["defect"]:
        raise ValueError("class weights need both classes")
    if mode == "unbalance":
        heavy, light = sizes["normal"] / sizes["defect"], 1.0
    elif mode == "balanced":
        half = (sizes["normal"] + sizes["defect"]) / 2
        heavy, light = half / sizes["defect"], half / sizes["normal"]
    else:
        raise ValueError(f"unknown mode: {mode}")
    return df.withColumn(name, F.when(positive, F.lit(heavy)).otherwise(F.lit(light)))


def balanced_bags(
    df: DataFrame, label: str = LABEL, key: str = KEY, bags: int = 10, seed: int = SEED
) -> DataFrame:
    """`bag` x rows: a bootstrap of the table per bag with the majority cut to the minority's size.

    The bootstrap draws a Poisson(1) number of copies per row and bag. The
    majority keeps exactly as many copies as the minority has in that bag: those of lowest hash.
    """
    classes = {row[label]: row["count"] for row in df.groupBy(label).count().collect()}
    values, names = list(classes), df.columns
    place = F.coalesce(*[F.when(F.col(label).eqNullSafe(F.lit(v)), i) for i, v in enumerate(values)], F.lit(-1))
    rows = df.withColumns({"__class": place, "__text": F.concat_ws("|", F.col(key).cast("string"), F.lit(""))})
    cuts = _bag_cuts(rows.select("__class", "__text"), values, classes, bags, seed)
    # For each bag and class: the hash at which it ends, and what becomes of that hash's copies.
    ends, split = np.full((bags, len(values) + 1), -1), np.zeros((bags, len(values) + 1), bool)
    for at, (cut, left, equal) in cuts.items():
        ends[at], split[at] = cut, left < equal
    others = [c for c in names if c != label]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    columns = [("bag", "int"), *[(c, kinds[c]) for c in (label, *others)], ("copy", "int"), ("__hash", "bigint"), ("__split", "boolean")]

    def chosen(batches):
        for batch in batches:
            code = batch.column(len(names)).to_numpy()
            for row, bag, copy, mark in _copies(batch.column(len(names) + 1), bags, seed):
                end = ends[bag, code[row]]
                in_bag = mark <= end
                row, bag, copy, mark = row[in_bag], bag[in_bag], copy[in_bag], mark[in_bag]
                own = batch.take(pa.array(row))
                last = split[bag, code[row]] & (mark == end[in_bag])
                made = [bag.astype(np.int32), *[own.column(names.index(c)) for c in (label, *others)], copy.astype(np.int32), mark, last]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in made], [c for c, _ in columns])

    kept = rows.mapInArrow(chosen, ", ".join(f"`{c}` {kind}" for c, kind in columns))
    if not split.any():
        return kept.drop("__hash", "__split")
    # Only rows of the one hash at which a bag's class ends, so of one key, are ordered.
    left = df.sparkSession.createDataFrame([(bag, values[i], n) for (bag, i), (_, n, _) in cuts.items()], f"bag int, {label} {kinds[label]}, __left bigint")
    order = Window.partitionBy("bag", label).orderBy(key, "copy")
    last = kept.filter("__split").withColumn("__place", F.row_number().over(order)).join(F.broadcast(left), ["bag", label])
    whole = kept.filter("not __split").unionByName(last.filter("__place <= __left").drop("__place", "__left"))
    return whole.drop("__hash", "__split")


def _copies(texts: pa.Array, bags: int, seed: int):
    """(row, bag, copy, hash) of what a batch's rows draw, as arrays."""
    for size, rows, own in Texts(texts).groups:
        first = marks(size, own, [f"{bag}|{seed}".encode() for bag in range(bags)])
        drawn = np.searchsorted(POISSON_ONE, (first % np.uint64(2**52)) / 2.0**52, side="right")
        for copy in range(1, int(drawn.max(initial=0)) + 1):
            bag, row = np.nonzero(drawn >= copy)
            mark = marks(size, own, [f"{b}|{copy}|{seed}".encode() for b in range(bags)], (bag, row))
            yield rows[row], bag, np.full(len(row), copy), mark.astype(np.int64)


class _Span(NamedTuple):
    """The hashes from low up to high, in cells of 2^shift."""

    low: int
    high: int
    shift: int


def _span(low: int, high: int, n: float) -> _Span:
    """Cells of single hashes where few are expected."""
    return _Span(low, high, 0 if n <= MOST_HASHES else max(0, (high - low - 1).bit_length() - BUCKET_BITS))


def _bag_cuts(rows: DataFrame, values: list, classes: dict, bags: int, seed: int) -> dict[tuple[int, int], tuple[int, int, int]]:
    """By bag and place of the class, of bags with two classes: the hash at which the class ends, how many of that hash's copies are in it, and exist.

    The hash is looked for where even hashes would have it, in one pass; where it
    is elsewhere, or too many hashes are near, further passes narrow the place down by cells.
    """
    spark, least, top = rows.sparkSession, min(classes.values(), default=0), 1 << HASH_BITS
    spans: dict[tuple[int, int], _Span] = {}
    for i, value in enumerate(values):
        # Rows without a label are a class of their own, but of no bag.
        if value is not None:
            share, reach = least / classes[value], 6 * math.sqrt(3 / least)
            low, high = (min(top, max(0, int(share * (1 + side) * top))) for side in (-reach, reach))
            spans |= {(bag, i): _span(low, high, classes[value] * (high - low) / top) for bag in range(bags)}
    cuts, sizes = {}, None
    while spans:
        with Scratch(spark) as scratch:
            counts = scratch.stored(_cell_counts(rows, spans, len(values), bags, seed))
            if sizes is None:
                totals = {(r.bag, r.place): r.n for r in counts.groupBy("bag", "place").agg(F.sum("n").alias("n")).collect()}
                own = {bag: [n for (b, _), n in totals.items() if b == bag] for bag, _ in totals}
                sizes = {at: min(own[at[0]]) for at in totals if at in spans and len(own[at[0]]) == 2}
                cuts = {at: (top, 0, 0) for at, size in sizes.items() if size == totals[at]}
                spans = {at: span for at, span in spans.items() if at in sizes and at not in cuts}
            ends = spark.createDataFrame([(*at, sizes[at]) for at in spans], "bag int, place int, size bigint")
            running = F.sum("n").over(Window.partitionBy("bag", "place").orderBy("cell"))
            ended = (
                counts.join(F.broadcast(ends), ["bag", "place"]).withColumn("upto", running)
                .filter((F.col("upto") >= F.col("size")) & (F.col("upto") - F.col("n") < F.col("size")))
            )
            for r in ended.collect() if spans else []:
                at = (r.bag, r.place)
                low, high, shift = spans.pop(at)
                if r.cell < 0:
                    spans[at] = _span(0, low, r.n)
                elif r.cell == top:
                    spans[at] = _span(high, top, r.n)
                elif shift:
                    first = low + (r.cell << shift)
                    spans[at] = _span(first, min(high, first + (1 << shift)), r.n)
                else:
                    cuts[at] = (low + r.cell, r.size - r.upto + r.n, r.n)
    return cuts


def _cell_counts(rows: DataFrame, spans: dict[tuple[int, int], _Span], classes: int, bags: int, seed: int) -> DataFrame:
    """(bag, place, cell, n): copies by cell of their class's span; -1 and 2^60 are the cells below and above."""
    top = 1 << HASH_BITS
    low, high, shift = (np.zeros((bags, classes), np.int64) for _ in range(3))
    for at, span in spans.items():
        low[at], high[at], shift[at] = span

    def count(batches):
        rest = np.zeros(bags * classes * 2, np.int64)
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64())
        made = lambda *x: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(x, kinds, strict=True)], ["bag", "place", "cell", "n"])
        for batch in batches:
            code = batch.column(0).to_numpy()
            for row, bag, _, mark in _copies(batch.column(1), bags, seed):
                at = (bag, code[row])
                inside = (mark >= low[at]) & (mark < high[at])
                place = (bag * classes + code[row]) * 2 + (mark >= high[at])
                rest += np.bincount(place[~inside], minlength=len(rest))
                if inside.any():
                    b, c = at[0][inside], at[1][inside]
                    cells, n = np.unique(np.stack([b, c, (mark[inside] - low[b, c]) >> shift[b, c]]), axis=1, return_counts=True)
                    yield made(*cells, n)
        found = np.flatnonzero(rest)
        if len(found):
            yield made(found // (classes * 2), found // 2 % classes, np.where(found % 2 == 0, -1, top), rest[found])

    counted = rows.mapInArrow(count, "bag int, place int, cell bigint, n bigint")
    return counted.groupBy("bag", "place", "cell").agg(F.sum("n").alias("n"))


def _poisson_one() -> np.ndarray:
    """The Poisson(1) distribution function, far enough into the tail for 2^-52."""
    steps, term, reached = [], math.exp(-1.0), 0.0
    for count in range(18):
        reached += term
        steps.append(reached)
        term /= count + 1
    return np.array(steps)


POISSON_ONE = _poisson_one()
