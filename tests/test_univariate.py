import math

import numpy as np
import pytest

from procsight.operators import charts, univariate
from tests.conftest import as_spark

FEATURES = ["X1", "X2", "X3", "X4", "X5"]


def brute_u(normal, defect):
    return sum((d > normal).sum() + 0.5 * (d == normal).sum() for d in defect)


@pytest.mark.parametrize("rows_per_range", [1_000_000, 40])
def test_rank_test_matches_brute_force(small, table, rows_per_range):
    found = {r["feature"]: r for r in univariate.mann_whitney(small, FEATURES, rows_per_range=rows_per_range).collect()}
    for c in FEATURES:
        part = table[[c, "Y"]].dropna()
        a, b = part.loc[part.Y == 0, c].to_numpy(), part.loc[part.Y == 1, c].to_numpy()
        u, row = brute_u(a, b), found[c]
        assert row["u_defect"] == u and row["u_normal"] == len(a) * len(b) - u
        ties = part[c].value_counts().to_numpy().astype(float)
        n = len(part)
        term = (ties**3 - ties).sum()
        assert row["tie_term"] == term
        spread = math.sqrt(len(a) * len(b) / 12 * (n + 1 - term / (n * (n - 1))))
        if spread == 0:
            assert row["p_value"] == 1.0
            continue
        z = (max(u, len(a) * len(b) - u) - len(a) * len(b) / 2 - 0.5) / spread
        assert np.isclose(row["z"], z)
        assert np.isclose(row["p_value"], min(1, math.erfc(z / math.sqrt(2))))


def test_report_moments(small, table):
    report = univariate.univariate_stats(small, FEATURES).toPandas().set_index("feature")
    for y, side in ((0, "normal"), (1, "defect")):
        x = table.loc[table.Y == y, "X5"].dropna()
        centred = (x - x.mean()) / x.std(ddof=0)
        assert np.isclose(report.loc["X5", f"{side}_mean"], x.mean())
        assert np.isclose(report.loc["X5", f"{side}_std"], x.std())
        assert np.isclose(report.loc["X5", f"{side}_skew"], (centred**3).mean())
        assert np.isclose(report.loc["X5", f"{side}_kurtosis"], (centred**4).mean() - 3)
    assert report.index[0] == "X1" and report.loc["X1", "significant"] == "YES"
    assert univariate.ranked_features(small, FEATURES, k=5) == list(report.index)


def test_known_moments(spark):
    rows = [(i, v, 0) for i, v in enumerate([1.0, 2.0, 2.0, 5.0, 9.0, 30.0])]
    df = spark.createDataFrame(rows, "CoilID bigint, X1 double, Y int")
    row = univariate.class_moments(df, ["X1"]).first()
    assert np.isclose(row["skew"], 1.532737064) and np.isclose(row["kurtosis"], 0.696134633)
    assert np.isclose(row["std_pop"], 10.122856426) and np.isclose(row["std"], 11.089033622)
    assert univariate.class_quartiles(df, ["X1"]).first()["q"] == [2.0, 8.0]


def test_variation_with_zero_mean(spark):
    rows = [(i, v, y) for i, (v, y) in enumerate([(1.0, 0), (-1.0, 0), (2.0, 1), (4.0, 1)])]
    row = univariate.cv_instability(spark.createDataFrame(rows, "CoilID bigint, X1 double, Y int"), ["X1"]).first()
    assert row["normal_cv"] == 0 and row["cv_ratio"] == 0 and row["relative_instability_pct"] == 0
    assert np.isclose(row["defect_cv"], np.std([2, 4], ddof=1) / 3)


@pytest.mark.parametrize("size", [4096, 8])
def test_outliers(small, table, size):
    found = {r["feature"]: r for r in univariate.iqr_outliers(small, FEATURES, size=size).collect()}
    for c in FEATURES:
        for y, side in ((0, "normal"), (1, "defect")):
            x = table.loc[table.Y == y, c]
            q1, q3 = x.quantile([0.25, 0.75])
            outside = ((x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1))).sum()
            assert found[c][f"outliers_{side}"] == outside
            assert found[c][f"{side}_min"] == x.min() and found[c][f"{side}_max"] == x.max()
        # Rows with a gap count in the class size.
        assert np.isclose(found[c]["outlier_ratio"], found[c]["outliers_defect"] / (table.Y == 1).sum())


def test_one_class_only(small):
    normal = small.filter("Y = 0")
    row = univariate.mann_whitney(normal, ["X1"]).first()
    assert row["z"] is None and row["p_value"] is None
    assert univariate.iqr_outliers(normal, ["X1"]).first()["outlier_ratio"] == 0
    assert univariate.profile_diversity(normal, FEATURES).first()["defect_variance"] is None


def test_diversity_and_entropy(small, table):
    row = univariate.profile_diversity(small, FEATURES).first()
    assert np.isclose(row["defect_variance"], table[table.Y == 1][FEATURES].var().mean())
    spread = table[table.Y == 0][FEATURES].std(ddof=0)
    row = univariate.signature_entropy(small, FEATURES).first()
    assert np.isclose(row["normal_entropy"], -(spread * np.log(spread + 1e-10)).sum())


def test_histogram_matches_numpy(small, table):
    found = charts.histogram_by_class(small, FEATURES, top=None).toPandas()
    for c in FEATURES:
        for y in (0, 1):
            x = table.loc[table.Y == y, c].dropna()
            counts, edges = np.histogram(x, bins=20)
            density, _ = np.histogram(x, bins=20, density=True)
            part = found[(found.feature == c) & (found.Y == y)].sort_values("bin")
            assert part.n.tolist() == counts.tolist()
            assert np.allclose(part.low, edges[:-1]) and np.allclose(part.density, density)


def test_significance_chart(small):
    rows = charts.significance_chart(small, FEATURES).collect()
    assert rows[0]["feature"] == "X1" and np.isclose(rows[0]["log_p"], -math.log10(rows[0]["p_value"]))
    assert np.isclose(rows[0]["line"], -math.log10(0.05))


def test_fingerprints(small, table):
    found = charts.fingerprints(small, ["X1"]).toPandas().set_index("Y")
    for y in (0, 1):
        first = table[table.Y == y].X1
        assert np.isclose(found.loc[y, "mean"], first.mean()) and np.isclose(found.loc[y, "std"], first.std())


@pytest.mark.parametrize("size", [4096, 8])
def test_one_profile_serves_all_reports(small, size):
    profile = univariate.ClassProfile(small, FEATURES, size=size)
    a = univariate.class_moments(small, FEATURES).toPandas().sort_values(["feature", "Y"], ignore_index=True)
    b = profile.moments().toPandas().sort_values(["feature", "Y"], ignore_index=True)
    for c in ("n", "mean", "std", "std_pop", "variance", "skew", "kurtosis", "low", "high"):
        assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=1e-9, equal_nan=True), c
    for report in (univariate.cv_instability, univariate.profile_diversity, univariate.signature_entropy, univariate.univariate_stats):
        plain, shared = (report(small, FEATURES, profile=p).toPandas() for p in (None, profile))
        for c in plain.columns:
            if plain[c].dtype == float:
                assert np.allclose(plain[c], shared[c], rtol=1e-9, equal_nan=True), (report, c)
            else:
                assert (plain[c] == shared[c]).all()
    outliers = [univariate.iqr_outliers(small, FEATURES, size=size, profile=p).toPandas() for p in (None, profile)]
    assert outliers[0].equals(outliers[1])


def test_the_profile_reads_the_table_twice(spark, small):
    """Quartiles in one scan, everything else in the other, for any number of features."""
    seen = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = small.select("Y", *FEATURES)
    profile = univariate.ClassProfile(rows.mapInArrow(counting, rows.schema), FEATURES)
    profile.moments().count()
    profile.outlier_counts().count()
    assert seen.value == 2 * 300


def test_moments_far_from_zero(spark):
    """Sums of powers are taken around the median, so a large offset costs no digits."""
    x = 1e9 + np.random.default_rng(3).normal(0, 1, 500)
    df = spark.createDataFrame([(float(v), i % 2) for i, v in enumerate(x)], "X1 double, Y int")
    found = {r.Y: r for r in univariate.ClassProfile(df, ["X1"]).moments().collect()}
    for y in (0, 1):
        own = x[y::2] - x[y::2].mean()
        assert np.isclose(found[y].std, own.std(ddof=1), rtol=1e-6)
        assert np.isclose(found[y].kurtosis, (own**4).mean() / (own**2).mean() ** 2 - 3, rtol=1e-5)
