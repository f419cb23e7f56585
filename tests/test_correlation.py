import numpy as np
import pandas as pd

from procsight.operators import correlation
from tests.conftest import as_spark

FEATURES = ["X1", "X2", "X3", "X4", "X5"]


def matrix(found):
    return found.toPandas().pivot(index="feature_1", columns="feature_2", values="r")


def test_matrix_matches_pandas_with_gaps(small, table):
    expected = table[FEATURES].corr()
    found = matrix(correlation.correlation_matrix(small, FEATURES))
    for a in FEATURES:
        for b in FEATURES:
            if a == b:
                assert found.loc[a, b] == 1.0
            elif "X4" in (a, b):
                assert np.isnan(found.loc[a, b])
            else:
                assert np.isclose(found.loc[a, b], expected.loc[a, b])


def test_large_magnitudes_do_not_cancel(spark):
    random = np.random.default_rng(3)
    x = 1e9 + random.normal(0, 1e-2, 500)
    frame = pd.DataFrame({"CoilID": range(500), "X1": x, "X2": x + random.normal(0, 1e-2, 500), "Y": 0})
    r = correlation.correlation_pairs(as_spark(spark, frame, 9), ["X1", "X2"]).first()["r"]
    centred = frame[["X1", "X2"]] - frame[["X1", "X2"]].mean()
    assert np.isclose(r, centred.corr().iloc[0, 1], rtol=1e-4)


def test_by_class_and_breakdowns(small, table):
    found = correlation.correlation_by_class(small, ["X1", "X2", "X3"]).toPandas()
    for y in (0, 1):
        expected = table[table.Y == y][FEATURES].corr()
        assert (found.Y == y).sum() == 9
        for row in found[found.Y == y].itertuples():
            assert np.isclose(row.r, expected.loc[row.feature_1, row.feature_2])
    assert correlation.correlation_breakdowns(small, FEATURES, change=2.0).count() == 0


def chain(spark):
    """X1-X2 and X3-X4 strongest, then X2-X3 weaker, all above the cut; X5 apart."""
    random = np.random.default_rng(5)
    n = 4000
    core = random.normal(size=n)
    left, right = core + 0.25 * random.normal(size=n), core + 0.25 * random.normal(size=n)
    frame = pd.DataFrame(
        {
            "CoilID": np.arange(n),
            "X1": left + 0.05 * random.normal(size=n),
            "X2": left,
            "X3": right,
            "X4": right + 0.05 * random.normal(size=n),
            "X5": random.normal(size=n),
            "Y": 0,
        }
    )
    return as_spark(spark, frame)


def test_blocks(spark):
    df = chain(spark)
    greedy = {r["feature"]: r["block"] for r in correlation.feature_blocks(df, FEATURES).collect()}
    assert "X5" not in greedy and set(greedy) == {"X1", "X2", "X3", "X4"}
    joined = {r["feature"]: r["block"] for r in correlation.feature_blocks(df, FEATURES, mode="components").collect()}
    assert len(set(joined.values())) == 1


def test_greedy_blocks_do_not_merge():
    pairs = [("A", "B"), ("C", "D"), ("B", "C"), ("E", "D")]
    assert correlation.assign_blocks(pairs) == {"A": 0, "B": 0, "C": 0, "D": 1, "E": 1}
    assert set(correlation.assign_blocks(pairs, merge=True).values()) == {0}


def test_redundancy(spark):
    report = {r["feature"]: r for r in correlation.redundancy(chain(spark), FEATURES).collect()}
    assert report["X1"]["highly_correlated_pairs"] == 3 and report["X1"]["redundancy_risk"] == "MEDIUM"
    assert report["X5"]["redundancy_risk"] == "LOW"


def test_stages(wide):
    names = [f"X{i}" for i in range(1, 50)]
    found = {r["stage"]: r["n"] for r in correlation.stage_sizes(wide, names).collect()}
    assert found == {"Furnace": 12, "Rolling": 12, "Cooling": 12, "Control": 6, "Other": 7}
