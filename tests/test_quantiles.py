import numpy as np
import pytest
from pyspark.sql import functions as F

from procsight.operators import quantiles
from procsight.operators.quantiles import RankScan, Span, exact_quantiles, select_ranks
from procsight.operators.ranks import class_counts, range_borders, rank_sums, ranged_long_form, with_ranges
from procsight.session import Scratch

FEATURES = ["X1", "X2", "X3", "X4", "X5"]
PROBABILITIES = [0.0, 0.1, 1 / 3, 0.5, 0.75, 1.0]


@pytest.mark.parametrize("size, rows_per_task", [(4096, 200_000), (8, 200_000), (8, 2)])
def test_quantiles_match_numpy(small, table, size, rows_per_task):
    """Exact whatever the sketch's size and however few values one task may order."""
    found = exact_quantiles(small, FEATURES, PROBABILITIES, size=size, rows_per_task=rows_per_task)
    for c in FEATURES:
        expected = np.quantile(table[c].dropna(), PROBABILITIES)
        assert np.allclose(found[(c,)], expected, rtol=1e-12)


@pytest.mark.parametrize("size", [4096, 8])
def test_quantiles_by_class(small, table, size):
    found = exact_quantiles(small, FEATURES, [0.25, 0.75], by="Y", size=size)
    for y in (0, 1):
        for c in FEATURES:
            expected = np.quantile(table.loc[table.Y == y, c].dropna(), [0.25, 0.75])
            assert np.allclose(found[(y, c)], expected, rtol=1e-12)


def test_a_bad_bracket_is_discarded(small, table, monkeypatch):
    """Brackets that miss the rank are detected by the exact count."""
    monkeypatch.setattr(RankScan, "spans", lambda self, wanted: {k: [Span(1e9, 2e9, tuple(wanted(k, n)))] for k, n in self.n.items()})
    found = exact_quantiles(small, ["X1"], [0.5])
    assert np.isclose(found[("X1",)][0], np.median(table.X1))


@pytest.mark.parametrize("size", [4096, 8])
def test_select_ranks_counts_ties(small, table, size):
    wanted = {"X2": [0, 17, 150, 299], "X3": [0, 100, 200, 299]}
    sizes, found = select_ranks(small, ["X2", "X3"], lambda key, n: wanted[key[0]], size=size)
    assert sizes == {("X2",): 300, ("X3",): 300}
    for feature, ranks in wanted.items():
        ordered = np.sort(table[feature])
        for rank in ranks:
            value = ordered[rank]
            assert found[(feature,)][rank] == (value, (ordered < value).sum(), (ordered == value).sum())


@pytest.mark.parametrize("rows_per_task", [200_000, 3])
def test_ranks_of_whole_numbers_beyond_double_precision(spark, rows_per_task):
    """60-bit numbers that doubles cannot tell apart, and the ends of the 64 bits."""
    values = [(1 << 60) + i for i in range(500)] + [-(1 << 63), (1 << 63) - 1]
    df = spark.createDataFrame([(v,) for v in values], "t bigint").repartition(3)
    _, found = select_ranks(df, ["t"], lambda key, n: range(0, n, 7), size=16, rows_per_task=rows_per_task)
    ordered = sorted(values)
    assert {r: p.value for r, p in found[("t",)].items()} == {r: ordered[r] for r in range(0, len(ordered), 7)}


def test_two_scans_for_any_number_of_features(spark, small, monkeypatch):
    """The source is read by the sketches and by the counts, and by nothing else."""
    seen = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    source = small.select(*FEATURES).mapInArrow(counting, small.select(*FEATURES).schema)
    exact_quantiles(source, FEATURES, PROBABILITIES)
    assert seen.value == 2 * 300


def test_empty_and_missing(spark, small):
    assert exact_quantiles(small.filter("false"), ["X1"], [0.5]) == {}
    gaps = small.withColumn("X9", F.lit(None).cast("double")).withColumn("X8", F.lit(float("nan")))
    assert set(exact_quantiles(gaps, ["X1", "X8", "X9"], [0.5])) == {("X1",)}


@pytest.mark.parametrize("rows_per_range, first_level", [(20, 1024), (20, 3), (5, 2)])
def test_ranges_grow_with_the_table(spark, rows_per_range, first_level):
    """However few borders there are, no range holds many more distinct values than it should."""
    random = np.random.default_rng(4)
    x = np.concatenate([random.normal(0, 1, 1500), np.full(500, 0.25)])
    df = spark.createDataFrame([(float(v), int(i % 3 == 0)) for i, v in enumerate(x)], "X1 double, Y int").repartition(4)
    borders = range_borders(df, ["X1"], rows_per_range, first_level)
    rows = with_ranges(df, borders).select("X1", F.col("X1__range").alias("range")).toPandas()
    by_value = rows.drop_duplicates().sort_values("X1")
    assert by_value.range.is_monotonic_increasing and by_value.X1.is_unique
    assert by_value.groupby("range").size().max() <= 12 * rows_per_range
    assert by_value.range.nunique() > len(x) / rows_per_range / 4
    values = ranged_long_form(df, ["X1"], ["Y"], rows_per_range)
    sums = rank_sums(values, ["feature"], "Y").first()
    y = np.arange(len(x)) % 3 == 0
    u = sum((x[~y] < v).sum() + 0.5 * (x[~y] == v).sum() for v in x[y])
    assert sums.u_defect == u and class_counts(values, ["feature"], "Y").count() == len(np.unique(x))
