import numpy as np
from pyspark.sql import functions as F

from procsight.operators import charts, latent, models

FEATURES = ["X1", "X2", "X3"]


def test_anomaly_tables(spark, small, table):
    flagged = small.withColumn("anomaly", F.when(F.col("X1") > 1, -1).otherwise(1))
    counts = {(r["Y"], r["anomalous"]): r["n"] for r in charts.anomaly_chart(flagged).collect()}
    for y in (0, 1):
        assert counts[y, True] == ((table.Y == y) & (table.X1 > 1)).sum()
    bars = charts.anomaly_histogram(flagged).toPandas()
    for y in (0, 1):
        signs = np.where(table[table.Y == y].X1 > 1, -1, 1)
        density, _ = np.histogram(signs, bins=30, range=(-1, 1), density=True)
        part = bars[bars.Y == y].set_index("bin").density
        assert np.isclose(part[0], density[0]) and np.isclose(part[29], density[29])


def test_component_and_regime_tables(spark, small):
    shown = charts.pca_chart(latent.pca_profile(small, FEATURES)).toPandas()
    assert len(shown) == 3 and np.isclose(shown.cumulative.iloc[-1], 1)
    regimes = spark.createDataFrame([(0, 5, 9.9), (1, 5, 10.0), (2, 5, 20.0)], "regime int, n int, defect_rate_pct double")
    assert [r["colour"] for r in charts.regime_chart(regimes).collect()] == ["green", "orange", "red"]


def test_permuting_the_informative_feature_costs_most(small):
    fitted = models.fit(models.preset("forest", trees=6, depth=4), small, FEATURES)
    drops = models.permutation_importance(fitted, small, repeats=2).toPandas().set_index("feature").drop_mean
    assert set(drops.index) == set(FEATURES) and drops["X1"] > 0


def test_stack(small):
    specs = [models.preset("forest", trees=3, depth=3), models.preset("boosted", trees=2, depth=2)]
    model, scores = models.stack(small, FEATURES, specs, k=2)
    assert scores.count() == 300 and set(scores.columns) == {"CoilID", "Y", "forest", "boosted"}
    assert model.transform(scores).count() == 300


def test_scatter_grid_holds_every_point(spark):
    random = np.random.default_rng(5)
    rows = [(float(a), float(b), int(a > 0)) for a, b in random.normal(0, 1, (400, 2))] + [(None, 1.0, 0), (1.0, None, 1)]
    df = spark.createDataFrame(rows, "X1 double, X2 double, Y int")
    found = charts.binned_points(df, "X1", "X2", ["Y"], bins=7).toPandas()
    assert found.n.sum() == 400 and found.bin_x.between(0, 6).all() and found.bin_y.between(0, 6).all()
    for r in found.itertuples():
        inside = [
            1 for a, b, y in rows[:400] if y == r.Y and r.low_x - 1e-9 <= a <= r.high_x + 1e-9 and r.low_y - 1e-9 <= b <= r.high_y + 1e-9
        ]
        assert len(inside) >= r.n
    flat = charts.binned_points(df.withColumn("X2", F.lit(3.0)), "X1", "X2", [], bins=7).toPandas()
    assert set(flat.bin_y) == {0} and flat.n.sum() == 401
    assert charts.binned_points(df.filter("false"), "X1", "X2", ["Y"]).count() == 0


def test_component_and_regime_points(wide):
    names = [f"X{i}" for i in range(1, 8)]
    points = charts.pca_points(wide, names).toPandas()
    assert points.groupby(["panel", "Y"]).n.sum().groupby("panel").sum().tolist() == [wide.count()] * 2
    regimes = charts.regime_points(wide, names).toPandas()
    assert regimes.n.sum() == wide.count() and regimes.regime.nunique() > 1
