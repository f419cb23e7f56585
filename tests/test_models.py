import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from procsight.operators import isolation, latent, models
from procsight.operators.calibrate import (
    apply_platt,
    calibrate_cv,
    calibrated_oof,
    calibrated_oof_mixed,
    platt_calibrate,
)
from procsight.operators.explain import (
    attribution_rows,
    cover,
    explain_first_defect,
    global_attributions,
    parse_trees,
    read_leaves,
    tree_attributions,
)

FEATURES = ["X1", "X2", "X3"]
FOREST = models.preset("forest", trees=4, depth=4)


@pytest.fixture(scope="module")
def boosted(small, tmp_path_factory):
    fitted = models.fit(models.preset("boosted", trees=4, depth=3), small, FEATURES)
    path = str(tmp_path_factory.mktemp("model") / "gbt")
    fitted.models[0].stages[-1].write().overwrite().save(path)
    return fitted, path


def test_out_of_fold_scores(small):
    found = models.oof_predictions(small, FEATURES, FOREST, k=3).toPandas()
    assert sorted(found.CoilID) == list(range(1000, 1300)) and found.probability.between(0, 1).all()


@pytest.mark.parametrize("name", ["smote", "hybrid", "bagging", "focal", "unbalanced"])
def test_strategies_fit(small, name):
    fitted = models.fit(models.preset(name, trees=2, depth=3, bags=2), small, FEATURES)
    row = fitted.score(small).agg(F.min("probability_raw"), F.max("probability_raw"), F.count("*")).first()
    assert 0 <= row[0] < row[1] <= 1 and row[2] == 300
    assert len(fitted.models) == (2 if name == "bagging" else 1)


def test_cross_validation(small):
    found = models.cross_validate(small, FEATURES, FOREST, k=2, train_scores=True).toPandas()
    assert len(found) == 2 * 2 * 5 and set(found.part) == {"test", "train"}
    areas = found[found.metric == "roc_auc"].groupby("part").value.mean()
    assert areas["train"] >= areas["test"] - 0.05


def test_oversampling_before_the_split_is_a_choice(small):
    spec = models.preset("smote", trees=2, depth=2)
    rows = models.leaky_rows(small, FEATURES)
    assert rows.groupBy("CoilID").count().filter("count > 1").count() == 0
    found = models.cross_validate(small, FEATURES, spec, k=2, resample="before")
    assert found.count() == 2 * 5
    with pytest.raises(ValueError):
        models.cross_validate(small, FEATURES, spec, resample="after")


def test_importance_sums_to_one(spark, small, boosted):
    forest = models.fit(FOREST, small, FEATURES)
    table = models.feature_importance([boosted[0], forest], spark).toPandas()
    assert np.allclose(table.groupby("model").importance.sum(), 1)


def test_saved_models_score_alike(small, boosted, tmp_path):
    models.save_model(boosted[0], str(tmp_path))
    back = models.load_model(boosted[0].spec, FEATURES, str(tmp_path))
    a, b = (m.score(small).orderBy("CoilID").toPandas().probability_raw for m in (boosted[0], back))
    assert a.tolist() == b.tolist()


def test_attributions_add_up(small, boosted):
    fitted, path = boosted
    found = tree_attributions(small, FEATURES, path).toPandas().set_index("CoilID").sort_index()
    margin = (
        fitted.models[0].transform(small)
        .select("CoilID", vector_to_array(models.MODEL_COLUMNS["rawPredictionCol"])[1].alias("margin"))
        .toPandas().set_index("CoilID").sort_index()
    )
    assert np.allclose(found.base + found.attributions.map(sum), margin.margin)


def test_attributions_are_shapley_values(spark, small, boosted):
    """Against the definition: mean marginal contribution over all orders of the features."""
    import itertools

    fitted, path = boosted
    trees = parse_trees(fitted.models[0].stages[-1].toDebugString)
    leaves = read_leaves(trees, cover(small, FEATURES, trees))
    row = small.orderBy("CoilID").first()
    x = [row[c] for c in FEATURES]

    def worth(known):
        total = 0.0
        for value, conditions in leaves:
            for f, (share, low, high) in conditions.items():
                value *= float(low < x[f] <= high) if f in known else share
            total += value
        return total

    expected = np.zeros(3)
    orders = list(itertools.permutations(range(3)))
    for order in orders:
        for i, f in enumerate(order):
            expected[f] += worth(set(order[: i + 1])) - worth(set(order[:i]))
    found = tree_attributions(small, FEATURES, path).orderBy("CoilID").first()
    assert np.allclose(found["attributions"], expected / len(orders)) and np.isclose(found["base"], worth(set()))


def test_trees_are_read_from_their_description(small, boosted):
    model = boosted[0].models[0].stages[-1]
    trees = parse_trees(model.toDebugString)
    assert [t.weight for t in trees] == model.treeWeights and [len(t.feature) for t in trees] == [t.numNodes for t in model.trees]
    rows = boosted[0].models[0].transform(small.dropna()).select(*FEATURES, models.MODEL_COLUMNS["rawPredictionCol"]).collect()
    x = np.array([[r[c] for c in FEATURES] for r in rows])
    margin = 2 * sum(t.weight * t.value[t.leaf_of(x)] for t in trees) / 2
    assert np.allclose(margin, [r[-1][1] for r in rows])
    for t, own in zip(trees, cover(small, FEATURES, trees), strict=True):
        inner = t.feature >= 0
        assert own[0] == 300 and (own[inner] == own[t.low[inner]] + own[t.high[inner]]).all()
    with pytest.raises(ValueError):
        parse_trees("  Tree 0 (weight 1.0):\n    If (feature 0 in {1.0})\n")


def test_unused_features_lose_nothing(small):
    constant = small.withColumn("X9", F.lit(1.0))
    fitted = models.fit(models.preset("forest", trees=3, depth=3), constant, [*FEATURES, "X9"])
    found = {r.feature: r for r in models.permutation_importance(fitted, constant, repeats=2).collect()}
    assert set(found) == {*FEATURES, "X9"} and found["X9"].drop_mean == 0 and found["X9"].drop_std == 0


def test_attribution_tables(small, boosted):
    table = tree_attributions(small, FEATURES, boosted[1])
    assert attribution_rows(table, FEATURES).count() == 900
    ranked = global_attributions(table, FEATURES).collect()
    assert ranked[0]["mean_abs"] >= ranked[-1]["mean_abs"] and len(ranked) == 3
    assert explain_first_defect(table, FEATURES).count() == 3


def test_platt_matches_newton(spark):
    random = np.random.default_rng(4)
    y = (random.random(300) < 0.3).astype(int)
    s = random.normal(y, 1.0)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, Y int")
    model = platt_calibrate(df, "s")
    found = apply_platt(df, model, "s").toPandas().sort_values("s").probability_calibrated.to_numpy()
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    w, design = np.zeros(2), np.column_stack([s, np.ones_like(s)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        w -= np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design, design.T @ (p - t))
    assert np.allclose(found, 1 / (1 + np.exp(-(w[0] * np.sort(s) + w[1]))), atol=1e-5)
    with pytest.raises(ValueError):
        platt_calibrate(df.filter("Y = 0"), "s")


def test_calibrated_variants(small):
    ensemble = calibrate_cv(small, FEATURES, FOREST, k=3)
    assert len(ensemble.members) == 3
    assert ensemble.score(small).filter("probability_calibrated BETWEEN 0 AND 1").count() == 300
    sound = calibrated_oof(small, FEATURES, FOREST, k=2).toPandas()
    assert sound.CoilID.is_unique and len(sound) == 300
    mixed = calibrated_oof_mixed(small, FEATURES, FOREST, k=2, inner=2).toPandas()
    assert sorted(mixed.CoilID) == list(range(1000, 1300))
    raw = mixed.probability_mixed == mixed.probability
    assert raw.groupby(mixed.fold).sum().between(70, 85).all()


def test_votes(small, boosted):
    forest = models.fit(FOREST, small, FEATURES)
    votes = models.soft_vote([boosted[0], forest], small).toPandas().sort_values("CoilID").probability.to_numpy()
    parts = [m.score(small).toPandas().sort_values("CoilID").probability_raw.to_numpy() for m in (boosted[0], forest)]
    assert np.allclose(votes, np.mean(parts, axis=0))


def test_components(small, table):
    x = table[FEATURES]
    z = ((x - x.mean()) / x.std(ddof=0)).to_numpy()
    values, vectors = np.linalg.eigh(np.corrcoef(z.T))
    profile = latent.pca_profile(small, FEATURES).toPandas()
    assert np.allclose(profile.variance_ratio, values[::-1] / 3) and np.isclose(profile.cumulative.iloc[-1], 1)
    found = latent.pca_project(small, FEATURES, 2).toPandas().sort_values("CoilID")
    for i, name in enumerate(["pc1", "pc2"]):
        expected = z @ vectors[:, ::-1][:, i]
        assert np.allclose(np.abs(found[name]), np.abs(expected))
    needed = {r["share"]: r["components"] for r in latent.components_needed(latent.pca_profile(small, FEATURES)).collect()}
    assert needed[0.95] >= needed[0.80]


def test_constant_features_do_not_break_components(small):
    profile = latent.pca_profile(small, ["X1", "X2", "X4"]).toPandas()
    assert np.isclose(profile.variance_ratio.sum(), 1) and profile.variance_ratio.iloc[-1] == 0


def test_clusters_and_regimes(small, table):
    sizes = latent.defect_clusters(small, FEATURES).toPandas()
    assert sizes.n.sum() == (table.Y == 1).sum() and np.isclose(sizes.pct.sum(), 100)
    few = small.filter("Y = 0").unionByName(small.filter("Y = 1").limit(5))
    assert latent.defect_clusters(few, FEATURES).count() == 0
    regimes = latent.operating_regimes(small, FEATURES).toPandas()
    assert regimes.n.sum() == 300 and np.isclose((regimes.n * regimes.defect_rate_pct).sum() / 100, (table.Y == 1).sum())


def test_scaling(small, table):
    for method, expected in (
        ("standard", (table.X1 - table.X1.mean()) / table.X1.std(ddof=0)),
        ("minmax", (table.X1 - table.X1.min()) / (table.X1.max() - table.X1.min())),
        ("robust", (table.X1 - table.X1.median()) / (table.X1.quantile(0.75) - table.X1.quantile(0.25))),
    ):
        found = latent.scale(small, ["X1", "X4"], method).orderBy("CoilID").toPandas()
        assert np.allclose(found.X1, expected) and (found.X4.abs() <= 1).all()
    with pytest.raises(ValueError):
        latent.scale(small, ["X1"], "unit")


@pytest.mark.parametrize("trees, sample", [(20, 64), (40, 16)])
def test_isolation_forest(spark, small, trees, sample):
    """Both cases draw each tree's rows from all rows; few rows need more trees to tell the far ones apart."""
    far = small.limit(5).withColumns(
        {"CoilID": F.col("CoilID") + 5000, "X1": F.lit(40.0), "X2": F.lit(90.0), "X3": F.lit(-60.0)}
    )
    rows = small.unionByName(far).persist()
    found = isolation.isolation_forest(rows, FEATURES, trees=trees, sample=sample, contamination=0.1).toPandas()
    assert len(found) == 305 and (found.anomaly == -1).sum() <= 31
    assert (found[found.CoilID >= 6000].anomaly == -1).all()
    share = isolation.anomaly_share(isolation.isolation_forest(rows, FEATURES, trees=trees, sample=sample)).first()
    defects = found[found.Y == 1]
    assert share["anomalous"] == (defects.anomaly == -1).sum() and share["defects"] == len(defects)


def test_isolation_samples_are_exact(small):
    for n, trees, sample in ((300, 10, 64), (300, 2, 16)):
        drawn = isolation.tree_samples(small.select("CoilID", "X1"), "CoilID", n, trees, sample, 1).toPandas()
        assert (drawn.groupby("tree").size() == sample).all() and len(drawn) == trees * sample
        assert not drawn.duplicated(["tree", "CoilID"]).any()


def test_skipping_ahead_draws_each_pair_alike():
    """Every (row, tree) comes up at the same rate, and trees independently of each other."""
    marks = np.random.default_rng(2).integers(-(1 << 63), (1 << 63) - 1, 40_000)
    row, tree = isolation.trees_of(marks, 30, 0.07)
    assert np.all(np.diff(row) >= 0) and len(np.unique(row * 30 + tree)) == len(row)
    drawn = np.zeros((40_000, 30))
    drawn[row, tree] = 1
    rates = drawn.mean(axis=0)
    assert abs(rates - 0.07).max() < 5 * np.sqrt(0.07 * 0.93 / 40_000)
    together = (drawn.T @ drawn / 40_000)[~np.eye(30, dtype=bool)]
    assert abs(together - 0.07**2).max() < 5 * np.sqrt(0.07**2 / 40_000)
    row, tree = isolation.trees_of(marks[:5], 4, 1.0)
    assert row.tolist() == np.repeat(np.arange(5), 4).tolist() and tree.tolist() == [0, 1, 2, 3] * 5


def test_permuted_rows_are_scored_once(small):
    """Rows and scores are stored: the report's plan neither numbers nor scores anything again."""
    fitted = models.fit(models.preset("forest", trees=2, depth=3), small.fillna(0.0), ["X1", "X2", "X3"])
    found = models.permutation_importance(fitted, small.fillna(0.0), repeats=2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "md5(" not in plan and "UDF(" not in plan and found.count() == 3
