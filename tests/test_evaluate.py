import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from procsight.operators import evaluate, scoring
from procsight.operators.evaluate import threshold_grid


def scored(spark, scores, labels):
    rows = [(i, float(p), int(y)) for i, (p, y) in enumerate(zip(scores, labels))]
    return spark.createDataFrame(rows, "CoilID bigint, p double, y int").repartition(4)


@pytest.fixture(scope="module")
def sample(spark):
    random = np.random.default_rng(9)
    y = (random.random(400) < 0.3).astype(int)
    p = np.round(np.clip(random.normal(0.4 + 0.2 * y, 0.2), 0, 1), 2)
    return p, y, scored(spark, p, y).persist()


def area(p, y):
    return np.mean([(a > p[y == 0]).mean() + 0.5 * (a == p[y == 0]).mean() for a in p[y == 1]])


@pytest.mark.parametrize("rows_per_range", [1_000_000, 30])
def test_roc(sample, rows_per_range):
    p, y, df = sample
    row = evaluate.roc_auc(df, "p", "y", rows_per_range=rows_per_range).first()
    assert np.isclose(row["roc_auc"], area(p, y))
    curve = evaluate.roc_curve(df, "p", "y", rows_per_range=rows_per_range).toPandas().sort_values(["fpr", "tpr"])
    assert len(curve) == len(np.unique(p)) + 1
    assert np.isclose(np.trapezoid(curve.tpr, curve.fpr), row["roc_auc"])
    for point in curve.dropna().itertuples():
        assert np.isclose(point.tpr, (p[y == 1] >= point.threshold).mean())
        assert np.isclose(point.fpr, (p[y == 0] >= point.threshold).mean())


@pytest.mark.parametrize("rows_per_range", [1_000_000, 30])
def test_precision_recall(sample, rows_per_range):
    p, y, df = sample
    curve = evaluate.pr_curve(df, "p", "y", rows_per_range=rows_per_range).toPandas()
    curve = curve.sort_values("threshold", ascending=False, na_position="first")
    found = evaluate.pr_auc(df, "p", "y", rows_per_range=rows_per_range).first()["pr_auc"]
    assert np.isclose(found, np.trapezoid(curve.precision, curve.recall))
    assert curve.iloc[0][["precision", "recall"]].tolist() == [1.0, 0.0]
    for point in curve.dropna().itertuples():
        assert np.isclose(point.precision, y[p >= point.threshold].mean())


def test_mixed_top_group_starts_at_one(spark):
    df = scored(spark, [0.9, 0.9, 0.1], [1, 0, 1])
    # (0, 1) -> (0.5, 0.5) -> (1, 2/3)
    assert np.isclose(evaluate.pr_auc(df, "p", "y").first()["pr_auc"], 0.375 + 0.5 * (0.5 + 2 / 3) / 2)


def test_sweep(sample):
    p, y, df = sample
    for points in (100, 101):
        found = evaluate.threshold_sweep(df, "p", "y", threshold_grid(points)).toPandas().sort_values("threshold")
        assert np.allclose(found.threshold, np.linspace(0, 1, points), atol=0)
        for row in found.itertuples():
            tp, fp = ((p >= row.threshold) & (y == 1)).sum(), ((p >= row.threshold) & (y == 0)).sum()
            assert (row.tp, row.fp, row.fn, row.tn) == (tp, fp, (y == 1).sum() - tp, (y == 0).sum() - fp)
        assert found.tp.is_monotonic_decreasing and found.fp.is_monotonic_decreasing


def test_scores_on_the_grid(spark):
    scores = [0.0, 0.25, 0.29, 0.57, 1.0]
    found = evaluate.threshold_sweep(scored(spark, scores, [1] * 5), "p", "y").toPandas()
    for row in found.itertuples():
        assert row.tp == sum(s >= row.threshold for s in scores)
    reached = [int((found.threshold <= s).sum()) for s in scores]
    assert reached == [1, 26, 30, 57, 101]


def test_all_scores_equal(spark):
    df = scored(spark, [0.5] * 6, [0, 1, 0, 1, 0, 0])
    assert evaluate.roc_auc(df, "p", "y").first()["roc_auc"] == 0.5
    assert evaluate.roc_curve(df, "p", "y").count() == 2


def test_one_class(spark):
    df = scored(spark, [0.2, 0.4], [0, 0])
    assert evaluate.roc_auc(df, "p", "y").first()["roc_auc"] is None
    assert evaluate.pr_auc(df, "p", "y").first()["pr_auc"] is None


def test_optimum(sample, spark):
    p, y, df = sample
    sweep = evaluate.threshold_sweep(df, "p", "y")
    table = sweep.toPandas().sort_values("threshold", ignore_index=True)
    for metric in ("f1", "recall", "precision", "industrial_score"):
        row = evaluate.optimal_threshold(sweep, metric).first()
        assert row["threshold"] == table.threshold[table[metric].idxmax()]
    assert evaluate.optimum_row(sweep).first()["threshold"] == table.threshold[table.f1.idxmax()]
    cost = table.fn * 10 + table.fp
    assert evaluate.cost_threshold(sweep, 10, 1).first()["threshold"] == table.threshold[cost.idxmin()]
    with pytest.raises(ValueError):
        evaluate.optimal_threshold(sweep, "accuracy")
    nothing = evaluate.threshold_sweep(scored(spark, [0.5, 0.6], [0, 0]), "p", "y")
    assert evaluate.optimal_threshold(nothing).first()["threshold"] == 0.5
    assert evaluate.optimal_threshold(nothing, fallback=None).first()["threshold"] == 0.0


def test_counts_and_report(sample):
    p, y, df = sample
    df = df.withColumn("pred", (F.col("p") >= 0.5).cast("int"))
    pred = (p >= 0.5).astype(int)
    cells = {(r["actual"], r["predicted"]): r["n"] for r in evaluate.confusion_matrix(df, "y", "pred").collect()}
    assert cells == {(a, b): int(((y == a) & (pred == b)).sum()) for a in (0, 1) for b in (0, 1)}
    report = {r["row_name"]: r for r in evaluate.classification_report(df, "y", "pred").collect()}
    precision = [y[pred == 1].mean(), 1 - y[pred == 0].mean()]
    assert np.isclose(report["Defect"]["precision"], precision[0])
    assert np.isclose(report["Normal"]["precision"], precision[1])
    assert np.isclose(report["macro avg"]["precision"], np.mean(precision))
    assert np.isclose(report["weighted avg"]["recall"], (pred == y).mean())
    assert np.isclose(report["accuracy"]["f1"], (pred == y).mean())


def test_zero_division(spark):
    df = scored(spark, [0.1, 0.2], [0, 0]).withColumn("pred", F.lit(0))
    row = evaluate.classification_metrics(df, "y", "pred").first()
    assert (row["accuracy"], row["precision"], row["recall"], row["f1"]) == (1.0, 0.0, 0.0, 0.0)


def test_summaries(spark):
    random = np.random.default_rng(2)
    rows = [
        (m, f, k, float(random.random()))
        for m in ("a", "b")
        for f in range(5)
        for k in ("roc_auc", "f1", "precision", "recall", "accuracy")
    ]
    df = spark.createDataFrame(rows, "model string, fold int, metric string, value double")
    frame = pd.DataFrame(rows, columns=["model", "fold", "metric", "value"])
    pop = evaluate.model_comparison(df).toPandas().set_index("model")
    sample = evaluate.performance_tracker(df.filter("fold < 2"), df.filter("fold >= 2")).toPandas().set_index("model")
    for (model, metric), part in frame.groupby(["model", "metric"]):
        assert np.isclose(pop.loc[model, f"{metric}_mean"], part.value.mean())
        assert np.isclose(pop.loc[model, f"{metric}_std"], part.value.std(ddof=0))
        assert np.isclose(sample.loc[model, f"{metric}_std"], part.value.std())
    assert evaluate.strategy_comparison(df).columns[0] == "strategy"


def test_confidence_golden(spark):
    df = spark.createDataFrame([(0.0290,), (0.7541,), (0.2779,)], "p double")
    rows = df.select(scoring.decide(F.col("p")).alias("d"), scoring.confidence(F.col("p")).alias("c")).collect()
    assert [r["d"] for r in rows] == [0, 1, 1]
    assert [round(r["c"], 3) for r in rows] == [0.295, 0.672, 0.037]


def test_sample_ids_are_gapless(spark, sample, monkeypatch):
    monkeypatch.setattr("procsight.operators.scoring.range_borders", lambda df, c, **k: {c[0]: [50.0, 60.0, 300.0]})
    predictions = scoring.predictions_table(sample[2], "p", "p")
    found = scoring.with_sample_id(predictions).orderBy("CoilID").select("sample_id").collect()
    assert [r["sample_id"] for r in found] == list(range(400))


def test_sample_ids_of_text_keys(spark, sample):
    predictions = scoring.predictions_table(sample[2], "p", "p").withColumn("CoilID", F.concat(F.lit("c"), "CoilID"))
    found = scoring.with_sample_id(predictions).toPandas()
    assert sorted(found.sample_id) == list(range(400))


def test_summary_text(spark, sample):
    p = sample[0]
    rows = scoring.prediction_summary(scoring.predictions_table(sample[2], "p", "p")).collect()
    facts = {r["metric"]: r["value"] for r in rows}
    assert facts["Total Samples"] == "400" and facts["Defect Predictions"] == str((p >= 0.25).sum())
    assert facts["Std Probability"] == f"{p.std():.4f}" and facts["Median"] == f"{np.median(p):.4f}"
    assert len(rows) == 18


def test_triage(spark):
    df = spark.createDataFrame([(v,) for v in (0.6, 0.5, 0.31, 0.3, 0.25, 0.1)], "p double")
    found = {r["band"]: r["n"] for r in scoring.triage_bands(df, "p").collect()}
    assert found == {"HOLD": 1, "INSPECT": 2, "MONITOR": 2, "RELEASE": 1}
