"""Exact order statistics of any number of columns in two scans, without a global sort.

The first scan builds one mergeable rank sketch (KLL) for each column and group, all
in one aggregation. A sketch brackets every wanted rank by two values that
lie a little beyond its error. The second scan counts exactly, for each bracket, the rows
below it and the rows of each value inside it. Counts confirm the bracket; one
that misses its rank is opened and read again, so the sketch decides the speed,
never the result. A value that a large part of the table shares is one row of
each task.

The values inside brackets are a stored table, a small share of the input. If a
bracket still holds more than one task should order, it is cut into equal parts
of its width until the part that holds the rank is small enough.

Results are bounded by columns x groups x ranks, so they are returned to the driver
and used as literals in later plans.
"""

from collections.abc import Callable, Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procsight.session import Scratch

# Items of a sketch level: brackets are then about half a hundredth of the rows wide.
SKETCH = 4096
# Number of the span that has a column's ends.
ENDS = -5
# Distinct values that one task puts in order, and parts that a wider bracket is cut into at a time.
ROWS_PER_TASK, PARTS = 200_000, 1024

Key = tuple


class Place(NamedTuple):
    """A value with the rows below it and the rows that have it."""

    value: float
    below: int
    equal: int


class Span(NamedTuple):
    """An interval of values, and the ranks that it should hold (none for a span that is only counted)."""

    low: float
    high: float
    ranks: tuple = ()


def margin(size: int) -> float:
    """Twice the rank error that a sketch of this size exceeds once in a hundred times, as a share of all rows."""
    return 2 * 2.3 / size**0.9


class RankScan:
    """Ranks of numeric columns (all of them double, or all bigint) in each group of `by`.

    Nulls and NaN are left out. `extra`: further aggregates of the first scan;
    their values are in `groups`, by group value.
    """

    def __init__(
        self,
        df: DataFrame,
        columns: list[str],
        scratch: Scratch,
        by: str | None = None,
        size: int = SKETCH,
        extra: Iterable[Column] = (),
        rows_per_task: int = ROWS_PER_TASK,
    ):
        self.columns, self.by, self.size, self.scratch, self.rows_per_task = columns, by, size, scratch, rows_per_task
        self.whole = {kind for c, kind in df.dtypes if c in columns} == {"bigint"}
        self.kind = "bigint" if self.whole else "double"
        number = lambda c: F.col(c) if self.whole else F.nanvl(F.col(c).cast("double"), F.lit(None))
        self.df = df.select(*([by] if by else []), *[number(c).alias(c) for c in columns])
        sketch = F.kll_sketch_agg_bigint if self.whole else F.kll_sketch_agg_double
        each = [a for i, c in enumerate(columns) for a in (F.count(number(c)).alias(f"n{i}"), sketch(number(c), size).alias(f"s{i}"))]
        grouped = df.groupBy(by) if by else df.groupBy()
        self.sketches = scratch.stored(grouped.agg(*each, *extra))
        names = [c for c in self.sketches.columns if c[0] != "s" or not c[1:].isdigit()]
        self.groups = {(row[by] if by else None): row for row in self.sketches.select(*names).collect()}
        self.n = {
            self._key(g, c): row[f"n{i}"] for g, row in self.groups.items() for i, c in enumerate(columns) if row[f"n{i}"]
        }

    def _key(self, group, column: str) -> Key:
        return (group, column) if self.by else (column,)

    def spans(self, wanted: Callable[[Key, int], Iterable[int]]) -> dict[Key, list[Span]]:
        """Brackets of the ranks that `wanted` gives for each key and its number of rows; near ranks share one."""
        plans: dict[Key, list[tuple[float, float, list[int]]]] = {}
        for key, n in self.n.items():
            own: list[tuple[float, float, list[int]]] = []
            for rank in sorted(set(wanted(key, n))):
                low, high = rank / n - margin(self.size), (rank + 1) / n + margin(self.size)
                if own and low <= own[-1][1]:
                    own[-1] = (own[-1][0], high, [*own[-1][2], rank])
                else:
                    own.append((low, high, [rank]))
            plans[key] = own
        marks = self.marks({k: [p for low, high, _ in own for p in (low, high)] for k, own in plans.items()})
        least, most = (-(1 << 63), (1 << 63) - 1) if self.whole else (-np.inf, np.inf)
        out = {}
        for key, own in plans.items():
            ends = marks[key]
            out[key] = [
                Span(
                    ends[2 * i] if low > 0 else least,
                    ends[2 * i + 1] if high < 1 else most,
                    tuple(ranks),
                )
                for i, (low, high, ranks) in enumerate(own)
            ]
        return out

    def marks(self, shares: dict[Key, list[float]]) -> dict[Key, list]:
        """The sketches' values at some shares of each key's rows."""
        quantile = F.kll_sketch_get_quantile_bigint if self.whole else F.kll_sketch_get_quantile_double

        def asked(g, c) -> list[float]:
            return [min(1.0, max(0.0, p)) for p in shares.get(self._key(g, c), [])]

        def marked(g, i: int) -> Column:
            # Ranks must be literals.
            ranks = asked(g, self.columns[i])
            if not ranks:
                return F.lit(None).cast(f"array<{self.kind}>")
            own = F.col(f"n{i}") > 0
            if self.by:
                own = own & F.col(self.by).eqNullSafe(F.lit(g))
            return F.when(own, quantile(f"s{i}", F.array(*[F.lit(float(p)) for p in ranks])))

        found = self.sketches.select(
            (F.col(self.by) if self.by else F.lit(None)).alias("g"),
            *[F.coalesce(*[marked(g, i) for g in self.groups]).alias(f"m{i}") for i in range(len(self.columns))],
        )
        return {
            self._key(row["g"], c): row[f"m{i}"] or [] for row in found.collect() for i, c in enumerate(self.columns)
        }

    def count(self, spans: dict[Key, list[Span]], moments: bool = False) -> "Counted":
        """The second scan; with `moments` it also sums what `Counted.moments` needs."""
        counted = Counted(self, spans, moments)
        missed = counted.missed()
        if missed:
            least, most = (-(1 << 63), (1 << 63) - 1) if self.whole else (-np.inf, np.inf)
            opened = {
                key: [Span(least, most, s.ranks) if i in missed.get(key, ()) else s for i, s in enumerate(own)]
                for key, own in spans.items()
            }
            counted = Counted(self, opened, moments)
        return counted


def _counting(
    columns: list[str],
    groups: list,
    by: bool,
    kind: pa.DataType,
    spans: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]],
    shifts: dict[tuple[int, int], float],
):
    """Tasks' rows (g, c, s, value, n, x): rows of each value inside span s, and with a null value the rows below it.

    Where there is a shift, span -k has in x the sum of the k-th powers of the values' distances from it, for k
    from 1 to 4, and span ENDS the least and the largest value.
    """

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int32(), pa.int32(), kind, pa.int64(), pa.float64())
        parts = [np.concatenate(c) if isinstance(c[0], np.ndarray) else list(c) for c in zip(*rows, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(parts, kinds, strict=True)], ["g", "c", "s", "value", "n", "x"])

    def count(batches):
        below = {key: np.zeros(len(low), np.int64) for key, (low, _) in spans.items()}
        powers = {key: np.zeros(4) for key in shifts}
        ends: dict[tuple[int, int], tuple] = {}
        for batch in batches:
            codes = None
            if by:
                known = pa.array(groups, batch.column(0).type)
                codes = pc.index_in(batch.column(0), value_set=known).to_numpy(zero_copy_only=False)
            found = []
            for g in range(len(groups)):
                mask = None if codes is None else pa.array(codes == g)
                for c in range(len(columns)):
                    if (g, c) not in spans:
                        continue
                    column = batch.column(c + by)
                    v = (column if mask is None else column.filter(mask)).drop_null().to_numpy(zero_copy_only=False)
                    v = np.sort(v)
                    if (g, c) in shifts and len(v):
                        off = v - shifts[g, c]
                        square = off * off
                        powers[g, c] += off.sum(), square.sum(), (square * off).sum(), (square * square).sum()
                        least, most = ends.get((g, c), (v[0], v[-1]))
                        ends[g, c] = (min(least, v[0]), max(most, v[-1]))
                    low, high = spans[g, c]
                    first, end = np.searchsorted(v, low), np.searchsorted(v, high, side="right")
                    below[g, c] += first
                    for s in np.flatnonzero(end > first):
                        values, n = np.unique(v[first[s] : end[s]], return_counts=True)
                        found.append(tuple(np.full(len(values), x, np.int32) for x in (g, c, s)) + (values, n, np.zeros(len(values))))
            if found:
                yield batch_of(found)
        rest = [(g, c, s, None, int(n), 0.0) for (g, c), counts in below.items() for s, n in enumerate(counts) if n]
        rest += [(g, c, -k, None, 0, float(x)) for (g, c), own in powers.items() for k, x in enumerate(own, 1)]
        rest += [(g, c, ENDS, x, 0, 0.0) for (g, c), own in ends.items() for x in own]
        if rest:
            yield batch_of(rest)

    return count


class Counted:
    """What the second scan has counted."""

    def __init__(self, scan: RankScan, spans: dict[Key, list[Span]], moments: bool = False):
        self.scan, self.spans = scan, spans
        groups = list(scan.groups)
        kind = pa.int64() if scan.whole else pa.float64()
        number = np.int64 if scan.whole else np.float64
        self.at_key = {
            scan._key(g, c): (i, j) for i, g in enumerate(groups) for j, c in enumerate(scan.columns) if spans.get(scan._key(g, c))
        }
        ends = {
            place: (np.array([s.low for s in spans[key]], number), np.array([s.high for s in spans[key]], number))
            for key, place in self.at_key.items()
        }
        # Powers are summed around each key's median, about, so that nothing cancels.
        self.shifts = {self.at_key[k]: float(m[0]) for k, m in scan.marks({k: [0.5] for k in self.at_key}).items() if k in self.at_key} if moments else {}
        count = _counting(scan.columns, groups, bool(scan.by), kind, ends, self.shifts)
        rows = scan.df.mapInArrow(count, f"g int, c int, s int, value {scan.kind}, n bigint, x double")
        self.rows = scan.scratch.stored(rows.groupBy("g", "c", "s", "value").agg(F.sum("n").alias("n"), F.sum("x").alias("x")))
        inside = F.col("value").isNotNull()
        sums = self.rows.groupBy("g", "c", "s").agg(
            F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("below"),
            F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias("inside"),
            F.count_if(inside).alias("values"),
            F.min("value").alias("least"),
            F.max("value").alias("most"),
            F.sum("x").alias("x"),
        )
        self.sums = {(r.g, r.c, r.s): r for r in sums.collect()}

    def missed(self) -> dict[Key, set[int]]:
        """Spans whose ranks lie elsewhere."""
        out: dict[Key, set[int]] = {}
        for key, place in self.at_key.items():
            for i, span in enumerate(self.spans[key]):
                r = self.sums.get((*place, i))
                low, n = (r.below, r.inside) if r else (0, 0)
                if any(not low <= rank < low + n for rank in span.ranks):
                    out.setdefault(key, set()).add(i)
        return out

    def moments(self, key: Key) -> dict[str, float | None]:
        """n, mean, std, std_pop, variance, skew, kurtosis, low, high of a key's values."""
        place, n = self.at_key[key], self.scan.n[key]
        s1, s2, s3, s4 = (self.sums[(*place, -k)].x / n for k in (1, 2, 3, 4))
        square = max(0.0, s2 - s1 * s1)
        third = s3 - 3 * s1 * s2 + 2 * s1**3
        fourth = s4 - 4 * s1 * s3 + 6 * s1 * s1 * s2 - 3 * s1**4
        variance = square * n / (n - 1) if n > 1 else None
        ends = self.sums[(*place, ENDS)]
        return {
            "n": n,
            "mean": self.shifts[place] + s1,
            "std": variance**0.5 if variance is not None else None,
            "std_pop": square**0.5,
            "variance": variance,
            "skew": third / square**1.5 if square else float("nan"),
            "kurtosis": fourth / square**2 - 3 if square else float("nan"),
            "low": ends.least,
            "high": ends.most,
        }

    def places(self) -> dict[Key, dict[int, Place]]:
        """The value at each rank of each key."""
        todo, found = {}, {key: {} for key in self.at_key}
        for key, place in self.at_key.items():
            for i, span in enumerate(self.spans[key]):
                for rank in span.ranks:
                    r = self.sums[(*place, i)]
                    if r.values == 1:
                        found[key][rank] = Place(r.least, r.below, r.inside)
                    else:
                        todo[(*place, i, rank)] = (r.least, r.most, r.below, r.values)
        todo = self._narrowed(todo)
        if todo:
            keys = {place: key for key, place in self.at_key.items()}
            for g, c, _, rank, place in self._ordered(todo):
                found[keys[g, c]][rank] = place
        return found

    def _asked(self, todo: dict) -> DataFrame:
        """The rows between the ends of each rank's bracket."""
        rows = [(*key, low, high, before) for key, (low, high, before, _) in todo.items()]
        kind = self.scan.kind
        asked = self.rows.sparkSession.createDataFrame(
            rows, f"g int, c int, s int, rank bigint, low {kind}, high {kind}, before bigint"
        )
        return self.rows.join(asked, ["g", "c", "s"]).filter((F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high")))

    def _narrowed(self, todo: dict) -> dict:
        """Brackets cut down until each has few enough values for one task."""
        while wide := {key: x for key, x in todo.items() if x[3] > self.scan.rows_per_task}:
            if self.scan.whole:
                # Doubles can't tell such numbers apart.
                value, low, high = (F.col(c).cast("decimal(20,0)") for c in ("value", "low", "high"))
                share = (value - low) * PARTS / (high - low + 1)
            else:
                # Half of the width first: the whole may not fit into a number.
                share = F.try_divide(F.col("value") / 2 - F.col("low") / 2, F.col("high") / 2 - F.col("low") / 2) * PARTS
            part = F.coalesce(F.least(F.lit(PARTS - 1), F.floor(share)).cast("int"), F.lit(0))
            parts = self._asked(wide).groupBy("g", "c", "s", "rank", part.alias("part")).agg(
                F.sum("n").alias("n"), F.count("*").alias("values"), F.min("value").alias("low"), F.max("value").alias("high")
            )
            by_rank: dict = {}
            for r in parts.collect():
                by_rank.setdefault((r.g, r.c, r.s, r.rank), []).append(r)
            for key, own in by_rank.items():
                before = todo[key][2]
                for r in sorted(own, key=lambda r: r.part):
                    if before + r.n > key[3]:
                        # Values too near for a division to part are ordered as they are.
                        todo[key] = (r.low, r.high, before, r["values"] if len(own) > 1 else 0)
                        break
                    before += r.n
        return todo

    def _ordered(self, todo: dict):
        running = Window.partitionBy("g", "c", "s", "rank").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        rows = self._asked(todo).withColumn("below", F.col("before") + F.sum("n").over(running) - F.col("n"))
        hit = rows.filter((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("n")))
        for r in hit.collect():
            yield r.g, r.c, r.s, r.rank, Place(r.value, r.below, r.n)

    def beyond(self, limits: dict[Key, list[tuple[int, float, bool]]]) -> dict[Key, list[int]]:
        """For each (span, limit, above): the key's rows above the limit, or below it. The limit lies inside the span."""
        rows = [(*self.at_key[key], i, limit, above, nth) for key, own in limits.items() for nth, (i, limit, above) in enumerate(own)]
        asked = self.rows.sparkSession.createDataFrame(rows, f"g int, c int, s int, edge {self.scan.kind}, above boolean, nth int")
        value = F.col("value")
        past = F.when(F.col("above"), value <= F.col("edge")).otherwise(value < F.col("edge"))
        counts = asked.join(self.rows, ["g", "c", "s"], "left").groupBy("g", "c", "nth", "above").agg(
            F.coalesce(F.sum(F.when(value.isNull() | past, F.col("n"))), F.lit(0)).alias("n")
        )
        found = {(r.g, r.c, r.nth): r.n for r in counts.collect()}
        return {
            key: [
                self.scan.n[key] - found[(*self.at_key[key], nth)] if above else found[(*self.at_key[key], nth)]
                for nth, (_, _, above) in enumerate(own)
            ]
            for key, own in limits.items()
        }


def quantile_ranks(probabilities: Iterable[float]) -> Callable[[Key, int], set[int]]:
    """The ranks between which quantiles of n rows lie."""

    def ranks(_: Key, n: int) -> set[int]:
        low = [int(p * (n - 1)) for p in probabilities]
        return {*low, *(min(x + 1, n - 1) for x in low)}

    return ranks


def interpolated(places: dict[int, Place], n: int, probabilities: Iterable[float]) -> list[float]:
    out = []
    for p in probabilities:
        spot = p * (n - 1)
        low = int(spot)
        below, above = places[low].value, places[min(low + 1, n - 1)].value
        out.append(below + (above - below) * (spot - low))
    return out


def exact_quantiles(
    df: DataFrame, features: list[str], probabilities: list[float], by: str | None = None, size: int = SKETCH,
    rows_per_task: int = ROWS_PER_TASK,
) -> dict[Key, list[float]]:
    """Linearly interpolated quantiles per feature (and per value of `by`).

    Keys are (feature,) or (by value, feature). Nulls and NaN are left out.
    """
    with Scratch(df.sparkSession) as scratch:
        plain = df.select(*([by] if by else []), *[F.col(c).cast("double").alias(c) for c in features])
        scan = RankScan(plain, features, scratch, by, size, rows_per_task=rows_per_task)
        places = scan.count(scan.spans(quantile_ranks(probabilities))).places()
        return {key: interpolated(found, scan.n[key], probabilities) for key, found in places.items()}


def select_ranks(
    df: DataFrame, columns: list[str], wanted: Callable[[Key, int], Iterable[int]], by: str | None = None, size: int = SKETCH,
    rows_per_task: int = ROWS_PER_TASK,
) -> tuple[dict[Key, int], dict[Key, dict[int, Place]]]:
    """Rows of each key, and the value at each 0-based rank that `wanted` asks for."""
    with Scratch(df.sparkSession) as scratch:
        scan = RankScan(df, columns, scratch, by, size, rows_per_task=rows_per_task)
        return scan.n, scan.count(scan.spans(wanted)).places()
