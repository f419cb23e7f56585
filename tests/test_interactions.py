import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from procsight.operators import drift, interactions, windows
from tests.conftest import as_spark

FEATURES = ["X1", "X2", "X3", "X4", "X5"]


def test_edges(spark):
    rows = [(i, v, 0) for i, v in enumerate([1.0, 2.0, 2.0, 5.0, 9.0, 30.0])]
    df = spark.createDataFrame(rows, "CoilID bigint, X1 double, Y int")
    assert np.allclose(interactions.quantile_edges(df, ["X1"])["X1"], [1, 2, 19 / 3, 30])


def test_bins_match_pandas(small, table):
    found = interactions.quantile_bins(small, FEATURES).toPandas().set_index("CoilID").sort_index()
    for c in FEATURES:
        expected = pd.qcut(table[c], 3, labels=False, duplicates="drop").to_numpy()
        ours = found[f"{c}_bin"].to_numpy(dtype=float)
        assert np.array_equal(ours, expected.astype(float), equal_nan=True)


def test_density_and_strength(small, table):
    pairs = interactions.pair_list(["X1", "X2", "X3"])
    density = interactions.defect_density_map(small, pairs)
    found = density.toPandas()
    for a, b in pairs:
        cross = pd.crosstab(
            [pd.qcut(table[a], 3, labels=False, duplicates="drop"), pd.qcut(table[b], 3, labels=False, duplicates="drop")],
            table.Y,
        )
        part = found[(found.feature_1 == a) & (found.feature_2 == b)].set_index(["bin1", "bin2"]).sort_index()
        assert part.n.tolist() == cross.sum(axis=1).tolist()
        assert np.allclose(part.rate, cross[1] / cross.sum(axis=1))
    report = interactions.interaction_strength(density).collect()
    assert all(x["interaction_strength"] >= y["interaction_strength"] for x, y in itertools.pairwise(report))
    best = report[0]
    part = found[(found.feature_1 == best["feature_1"]) & (found.feature_2 == best["feature_2"])]
    assert np.isclose(best["interaction_strength"], part.rate.max() - part.rate.min())
    assert best["risk_range"] == f"{part.rate.min():.2%} to {part.rate.max():.2%}"


def test_one_class_gives_no_pair(small):
    density = interactions.defect_density_map(small.filter("Y = 0"), [("X1", "X2")])
    assert interactions.interaction_strength(density).count() == 0


def test_exclusive_regions_per_class(small, table):
    found = {
        r["feature_pair"]: r["unstable_regions_found"]
        for r in interactions.exclusive_regions(small, ["X1", "X2", "X3"], edges="per_class").collect()
    }
    for a, b in interactions.pair_list(["X1", "X2", "X3"]):
        sets = []
        for y in (0, 1):
            rows = table[table.Y == y]
            cut = []
            for c in (a, b):
                edges = sorted(set(rows[c].quantile([0, 1 / 3, 2 / 3, 1])))
                number = pd.cut(rows[c], edges, labels=False, include_lowest=True)
                cut.append([None if np.isnan(i) else (round(edges[int(i)], 3), round(edges[int(i) + 1], 3)) for i in number])
            sets.append({x for x in zip(*cut) if None not in x})
        name = next((n for n in (f"{a} × {b}", f"{b} × {a}") if n in found), None)
        assert found.get(name, 0) == len(sets[1] - sets[0])


def brute_windows(frame, feature):
    rows = frame[[feature, "Y", "CoilID"]].dropna().sort_values([feature, "CoilID"])
    n = len(rows)
    size = max(30, n // 10)
    return [
        (start, rows.Y.iloc[start : start + size].mean(), rows[feature].iloc[start + size // 2])
        for start in range(0, n - size, size // 2)
    ]


@pytest.mark.parametrize("n", [20, 30, 31, 100, 300])
@pytest.mark.parametrize("size", [4096, 8])
def test_windows_match_a_loop(spark, table, n, size):
    frame = table.head(n)
    df = as_spark(spark, frame)
    names = ["X1", "X2", "X3", "X5"]
    found = windows.operating_windows(df, names, top=None, size=size).toPandas()
    for c in names:
        part = found[found.feature == c].sort_values("start")
        expected = brute_windows(frame, c)
        assert part.start.tolist() == [e[0] for e in expected]
        assert np.allclose(part.defect_rate, [e[1] for e in expected])
        assert np.allclose(part.boundary, [e[2] for e in expected])


def test_windows_with_text_keys(spark, small, table):
    named = small.withColumn("CoilID", F.concat(F.lit("c"), F.col("CoilID").cast("string")))
    found = windows.operating_windows(named, ["X1"], top=None).toPandas().sort_values("start")
    # X1 has no equal values, so the order of keys does not matter.
    assert np.allclose(found.defect_rate, [e[1] for e in brute_windows(table, "X1")])


def test_critical_threshold(small, table):
    found = windows.critical_threshold(windows.operating_windows(small, ["X1", "X2"], top=None)).toPandas()
    for row in found.itertuples():
        expected = brute_windows(table, row.feature)
        rates = [e[1] for e in expected]
        jump = int(np.argmax(np.abs(np.diff(rates))))
        assert np.isclose(row.critical_threshold, expected[jump][2])
        assert np.isclose(row.safe_rate, min(rates)) and np.isclose(row.unsafe_rate, max(rates))


def test_drift_is_zero_against_itself(small):
    rows = drift.drift_report(small, small, ["X1", "X2", "X5"]).collect()
    assert len(rows) == 3 and all(abs(r["psi"]) < 1e-12 and abs(r["mean_shift"]) < 1e-12 for r in rows)
