import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from checks.compare import TABLES, difference
from checks.queries import stream_events
from procsight.operators import scoring
from procsight.plans import eda, scoring as scoring_plan, training
from procsight.sources import stand_ins, tables
from procsight.streaming.scoring import stream_monitor, stream_score
from tests.conftest import SF

WIDE = stand_ins.WIDE


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 10 and rows[0]["feature"].startswith("X")


def test_every_statement_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


FAST = [
    "coerce_numeric", "fit_median", "univariate_stats", "mann_whitney_lineitem", "iqr_outliers_lineitem",
    "correlation_matrix_gaps", "interaction_scan", "critical_threshold", "operating_windows_lineitem",
    "roc_curve", "threshold_sweep", "predictions_table", "rolling_std", "stream_monitor", "stream_drift", "smote",
    "balanced_bags", "stratified_folds", "binned_points", "isolation_samples", "write_predictions",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", FAST)
def test_queries_equal_their_sql(spark, duck, name):
    ours = __spark_entry__.queries()[name](spark, SF).toPandas()
    assert difference(ours, duck.execute(__spark_entry__.oracle_sql()[name]).df()) is None


def test_explore_from_text_files(spark, tmp_path):
    raw = stand_ins.measurements_text(spark, SF)
    raw.write.option("header", True).csv(str(tmp_path / "train"))
    raw.drop("Y").write.option("header", True).csv(str(tmp_path / "test"))
    train = tables.read_typed(spark, str(tmp_path / "train"))
    test = tables.read_typed(spark, str(tmp_path / "test"))
    reports = eda.run_eda(train, test, str(tmp_path / "out"))
    assert reports["univariate"].count() == 49 and reports["anomaly_share"].count() == 1
    written = tables.read_eda_tables(spark, str(tmp_path / "out" / "reports"))
    assert written["redundancy"].count() == 49 and written["interactions"].columns[0] == "feature_pair"


@pytest.fixture(scope="module")
def trained(wide, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("trained"))
    return training.run_final(wide, WIDE, folder, k=2, trees=2), folder


def test_scoring_loads_what_training_saved(spark, wide, trained, tmp_path):
    final, folder = trained
    kept = scoring_plan.Scorer(final.model, final.calibrator, WIDE)
    loaded = scoring_plan.Scorer.load(folder, WIDE, folds=2)
    columns = ["CoilID", "probability_raw", "probability_calibrated"]
    test = wide.drop("Y")
    a, b = (s(test).select(columns).orderBy("CoilID").toPandas() for s in (kept, loaded))
    assert np.allclose(a, b, rtol=0, atol=1e-12)
    out = scoring_plan.run_scoring(test, loaded, str(tmp_path))
    detailed = spark.read.parquet(str(tmp_path / "predictions_detailed"))
    assert len(detailed.columns) == 68 and detailed.count() == wide.count()
    tables.write_summary_text(out["prediction_summary"], str(tmp_path / "summary"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "summary")).collect()]
    assert len(lines) == 18 and lines[0].split() == ["Total", "Samples", str(wide.count())]


def test_streamed_scores_equal_batch(spark, wide, trained, tmp_path):
    _, folder = trained
    rows = wide.drop("Y")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    scorer = scoring_plan.Scorer.load(folder, WIDE, folds=2)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (
        stream_score(stream, scorer).select("CoilID", "probability_calibrated", "prediction", "confidence")
        .writeStream.format("memory").queryName("streamed").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    batch = stream_score(rows, scorer).select("CoilID", "probability_calibrated", "prediction", "confidence")
    assert spark.table("streamed").count() == rows.count()
    assert spark.table("streamed").exceptAll(batch).count() == 0


def test_late_windows_close(spark, tmp_path):
    """In append mode a window comes out once the watermark has passed its end."""
    stream = stream_monitor(stream_events(spark, SF), "ts", "flag", "value", "1 hour")
    query = (
        stream.writeStream.format("memory").queryName("closed").outputMode("append")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    whole = stream_monitor(stream_events(spark, SF, as_stream=False), "ts", "flag", "value", "1 hour")
    closed = spark.table("closed")
    assert 0 < closed.count() <= whole.count() and closed.exceptAll(whole).count() == 0


def test_baselines_and_strategies(wide, tmp_path):
    names = ["X1", "X2", "X13", "X36"]
    base = training.run_baselines(wide, names, str(tmp_path / "base"), k=2, trees=2)
    assert base["model_comparison"].count() == 3 and base["threshold_curve"].count() == 100
    strategies = training.run_strategies(wide, WIDE, str(tmp_path / "str"), k=2, trees=1)
    assert strategies["strategy_comparison"].count() == 5 and strategies["engineered_features"].count() == 44


@pytest.mark.parametrize(
    "name",
    ["univariate_stats", "defect_density_map", "operating_windows_lineitem", "roc_curve", "threshold_sweep", "stratified_folds"],
)
def test_plans_have_no_cross_join(spark, name):
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_scans_read_only_what_is_needed(spark):
    df = stand_ins.scores_lineitem(spark, SF)
    plan = df.select("p", "y")._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: ")[1]
    assert "l_quantity" in schema and "l_tax" not in schema and "l_extendedprice" not in schema


def test_drift_of_a_stream_equals_the_batch(spark, tmp_path):
    """Three files, three batches: the counts of the last one are those of the whole table."""
    from procsight.operators import drift
    from procsight.streaming.scoring import latest_counts, start_drift, stream_drift

    random = np.random.default_rng(8)
    reference = spark.createDataFrame([(float(v),) for v in random.normal(0, 1, 500)], "value double")
    current = spark.createDataFrame([(float(v),) for v in random.normal(0.7, 1.5, 900)], "value double")
    current.repartition(3).write.parquet(str(tmp_path / "rows"))
    edges = drift.open_edges(reference, ["value"])
    stream = spark.readStream.schema("value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "rows"))
    start_drift(stream, edges, str(tmp_path / "drift")).awaitTermination()
    counts = drift.bin_counts(reference, edges)
    found = stream_drift(spark, str(tmp_path / "drift"), counts).first()
    whole = drift.stability_index(counts, drift.bin_counts(current, edges)).first()
    assert found.n == 900 and np.isclose(found.psi, whole.psi) and found.psi > 0.1
    assert latest_counts(spark, str(tmp_path / "drift")).count() == len(edges["value"]) - 1


def test_rolling_deviation_of_one_group_of_all_rows(spark):
    """A group that holds every row is cut into parts; null groups are groups too."""
    from procsight.operators.drift import rolling_std

    x = np.random.default_rng(9).normal(0, 1, 600)
    rows = [(f"k{i:06d}", float(v), None if i % 10 == 3 else "hot") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "CoilID string, X1 double, line string").repartition(4)
    found = rolling_std(df, ["X1"], "CoilID", ["line"], window=4, rows_per_part=50).toPandas().set_index("CoilID")
    for line in ("hot", None):
        own = [(k, v) for k, v, g in rows if g == line]
        for i, (k, _) in enumerate(own):
            part = [v for _, v in own[max(0, i - 3) : i + 1]]
            want = np.std(part, ddof=1) if len(part) > 1 else np.nan
            assert np.isclose(found.X1_rolling_std[k], want, equal_nan=True)
