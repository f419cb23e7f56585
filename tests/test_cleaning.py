import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from procsight.operators import cleaning
from procsight.sources import tables
from tests.conftest import as_spark

FEATURES = ["X1", "X2", "X3", "X4", "X5"]


def test_text_to_numbers(spark):
    texts = ["1.5", " 2 ", "1e3", "-.5", "+7.", "1.5f", "3d", "n/a", "", "NaN", "inf", "-Infinity", None, "0x1A"]
    expected = [1.5, 2.0, 1000.0, -0.5, 7.0, None, None, None, None, None, np.inf, -np.inf, None, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "CoilID bigint, X1 string")
    found = [row["X1"] for row in cleaning.coerce_numeric(df, ["X1"]).orderBy("CoilID").collect()]
    assert found == expected


def test_nan_in_a_double_column_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "X1 double")
    assert cleaning.coerce_numeric(df, ["X1"]).filter("X1 IS NULL").count() == 1


def test_only_training_gaps_are_filled(spark, table, small):
    test = small.drop("Y").withColumn("X1", F.when(F.col("CoilID") != 1001, F.col("X1")))
    medians = cleaning.fit_median(small, FEATURES)
    assert list(medians) == ["X5"] and np.isclose(medians["X5"], table.X5.median())
    assert cleaning.apply_fill(small, medians).filter("X5 IS NULL").count() == 0
    filled = cleaning.apply_fill(test, medians)
    assert filled.filter("X5 IS NULL").count() == 0
    assert filled.filter("X1 IS NULL").count() == 1
    report = cleaning.fill_report(small, medians).collect()
    assert [(r["feature"], r["filled"]) for r in report] == [("X5", int(table.X5.isna().sum()))]


def test_violations(small):
    assert cleaning.validate_clean(small.dropna(), small.drop("Y"), FEATURES).count() == 0
    found = cleaning.validate_clean(
        small.withColumn("X2", F.col("X2").cast("string")), small.drop("X3"), FEATURES
    ).collect()
    assert {(r["check_name"], r["feature"]) for r in found} == {
        ("null_in_train", "X5"),
        ("not_numeric", "X2"),
        ("label_present_in_test", "Y"),
        ("column_in_one_table_only", "X3"),
    }


def test_duplicates_treat_nulls_as_equal(spark):
    rows = [(1, None, 2.0)] * 2 + [(2, 1.0, 1.0)] * 3 + [(3, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "CoilID bigint, X1 double, X2 double")
    assert cleaning.duplicate_count(df).first()["duplicates"] == 3
    assert cleaning.duplicate_count(df.limit(0)).first()["duplicates"] == 0


def test_class_tables(spark, table, small):
    rows = cleaning.class_distribution(small).collect()
    assert [(r["Y"], r["label_name"], r["n"]) for r in rows] == [
        (0, "NORMAL", (table.Y == 0).sum()),
        (1, "DEFECT", (table.Y == 1).sum()),
    ]
    one = cleaning.imbalance_ratio(small.filter("Y = 0")).first()
    assert one["ratio"] is None and one["severity"] is None


def test_profile(small, table):
    row = cleaning.dataset_profile(small, FEATURES).first()
    assert (row["rows"], row["columns"], row["features"]) == (300, 7, 5)
    assert row["missing_cells"] == table.X5.isna().sum() and row["duplicates"] == 0
    low = cleaning.low_variance_features(small, FEATURES).collect()
    assert [r["feature"] for r in low] == ["X4"]


def test_impute_and_sparse_columns(small, table):
    assert cleaning.impute(small, FEATURES, "drop").count() == table.dropna().shape[0]
    mean = cleaning.impute(small, FEATURES, "mean").agg(F.avg("X5")).first()[0]
    assert np.isclose(mean, table.X5.mean())
    sparse = small.withColumn("X6", F.when(F.col("CoilID") < 1010, 1.0))
    assert "X6" not in cleaning.drop_sparse_columns(sparse, FEATURES + ["X6"]).columns
    with pytest.raises(ValueError):
        cleaning.impute(small, FEATURES, "mode")


def test_files(spark, small, tmp_path):
    train, test = tables.write_cleaned(small, small.drop("Y"), str(tmp_path), "csv")
    back = tables.read_cleaned(spark, train, "csv")
    assert dict(back.dtypes) == dict(small.dtypes)
    assert back.exceptAll(small).count() == 0 and back.count() == 300
    assert "Y" not in tables.read_typed(spark, test).columns
    with pytest.raises(AnalysisException):
        tables.read_measurements(spark, str(tmp_path / "missing.csv")).count()
    tables.write_reports({"univariate": small}, str(tmp_path / "reports"))
    assert tables.read_reports(spark, str(tmp_path / "reports"), ["univariate"])["univariate"].count() == 300


def test_duplicates_are_compared_only_where_hashes_repeat(spark, monkeypatch):
    """Without repeated hashes no row is joined or shuffled; with few no row but theirs is."""
    once = spark.createDataFrame([(i, float(i % 3)) for i in range(50)], "CoilID bigint, X1 double")
    found = cleaning.duplicate_count(once)
    assert found.first()[0] == 0 and "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    more = once.unionByName(once.filter("CoilID < 7")).unionByName(once.filter("CoilID < 2"))
    for few in (cleaning.FEW_HASHES, 0):
        monkeypatch.setattr(cleaning, "FEW_HASHES", few)
        found = cleaning.duplicate_count(more)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert found.first()[0] == 9 and ("broadcast" in plan) == (few > 0)
    profile = cleaning.dataset_profile(more, ["X1"]).first()
    assert (profile.rows, profile.missing_cells, profile.duplicates) == (59, 0, 9)


def test_stored_tables_leave_no_shuffle_files(spark, small):
    """Their shuffles end with the writing; the setting is put back."""
    from procsight.session import CLEANUP, stored

    before = spark.conf.get(CLEANUP)
    seen = []
    write = type(small.write).parquet
    try:
        type(small.write).parquet = lambda self, *a, **b: (seen.append(spark.conf.get(CLEANUP)), write(self, *a, **b))[1]
        assert stored(small.groupBy("Y").count()).count() == 2
    finally:
        type(small.write).parquet = write
    assert seen == ["true"] and spark.conf.get(CLEANUP) == before
