import numpy as np
import pytest
from pyspark.sql import functions as F

from procsight.operators import features as fe

WIDE = [f"X{i}" for i in range(1, 50)]


@pytest.fixture(scope="module")
def both(wide):
    stats = fe.fit_statistics(wide, WIDE)
    one = fe.features_set1(wide, stats, WIDE).toPandas()
    two = fe.features_set2(wide, WIDE).toPandas()
    return one, two, stats


def test_sizes(both, wide):
    one, two, _ = both
    assert one.shape[1] == len(wide.columns) + 44 and two.shape[1] == len(wide.columns) + 15
    assert len(fe.set1_registry(WIDE)) == 44 and len(set(fe.set1_registry(WIDE).values())) == 12
    assert len(fe.set2_registry()) == 15 and len(set(fe.set2_registry().values())) == 5
    registry = fe.feature_registry(wide, fe.set2_registry())
    counts = {r["type"]: r["n"] for r in fe.feature_type_counts(registry).collect()}
    assert counts["dangerous_interaction"] == 5 and sum(counts.values()) == 15


def test_row_statistics(both):
    one, two, _ = both
    x = one[WIDE].to_numpy()
    assert np.allclose(one.row_mean, x.mean(axis=1)) and np.allclose(two.row_std, x.std(axis=1))
    assert np.allclose(one.imbalance, x.max(axis=1) - x.min(axis=1))
    assert np.allclose(two.instability, x.std(axis=1) / (np.abs(x.mean(axis=1)) + 1e-6))
    assert np.allclose(two.rolling_mean, one[["X10", "X13", "X14", "X16"]].mean(axis=1))


def test_train_statistics(both):
    one, _, stats = both
    x, normal = one[WIDE], one.loc[one.Y == 0, WIDE]
    distance = (np.abs(x - normal.mean()) / (normal.std(ddof=0) + 1e-6)).mean(axis=1)
    assert np.allclose(one.anomaly_distance, distance)
    z = np.abs(x - x.mean()) / (x.std(ddof=0) + 1e-6)
    assert (one.extreme_count == (z > 3).sum(axis=1)).all()
    regime = x[fe.REGIME_FEATURES]
    q1, q3 = regime.quantile(0.25), regime.quantile(0.75)
    assert np.allclose(one.regime_anomaly, (np.abs(regime - (q1 + q3) / 2) / (q3 - q1 + 1e-6)).mean(axis=1))


def test_blocks(both):
    one, _, _ = both
    for block, numbers in fe.BLOCKS.items():
        part = one[[f"X{i}" for i in numbers]].to_numpy()
        assert np.allclose(one[f"{block}_mean"], part.mean(axis=1))
        assert np.allclose(one[f"{block}_std"], part.std(axis=1))
        assert (one[f"{block}_divergence"] == one[f"{block}_std"]).all()


def test_ratios_with_bad_denominators(spark):
    rows = [(1.0, 0.0), (0.0, 0.0), (1.0, -1e-6), (None, 2.0), (1e308, 1e-308), (3.0, 2.0)]
    df = spark.createDataFrame(rows, "X1 double, X2 double")
    plain = fe.safe_ratio([("X1", "X2")])["X1divX2"]
    shifted = fe.safe_ratio([("X1", "X2")], 1e-6, "/")["X1/X2"]
    found = df.select(plain.alias("a"), shifted.alias("b")).collect()
    assert [r["a"] for r in found] == [0.0, 0.0, -1e6, 0.0, 0.0, 1.5]
    assert [r["b"] for r in found][2:4] == [0.0, 0.0]
    assert np.isclose(found[0]["b"], 1e6) and np.isclose(found[5]["b"], 3 / (2 + 1e-6))


def test_limits_are_strict(spark):
    df = spark.createDataFrame([(1032.32, 9.84), (1032.33, 9.83)], "X13 double, X10 double")
    found = df.select(fe.threshold_count(["X13", "X10"]).alias("n")).collect()
    assert [r["n"] for r in found] == [1, 1]


def test_no_python_in_the_plan(wide):
    stats = fe.fit_statistics(wide, WIDE)
    plan = fe.features_set1(wide, stats, WIDE)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Join" not in plan and "Exchange" not in plan.split("InMemoryTableScan")[0]
