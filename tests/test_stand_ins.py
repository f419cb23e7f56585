import datetime

import numpy as np
import pytest

from procsight.operators.drift import rolling_std
from procsight.sources import stand_ins
from procsight.sources.stand_ins import line_key, table_stream
from tests.conftest import SF


def test_line_keys_stay_apart_at_any_size(spark):
    day = datetime.date(1995, 1, 2)
    rows = [(7, 1, 1_048_581, 3, day), (7, 2, 5, 3, day), (2**40, 7, 2**35, 2**33, day), (2**40, 7, 2**35, 2**33 + 1, day)]
    df = spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_shipdate date")
    keys = [r[0] for r in df.select(line_key()).collect()]
    assert len(set(keys)) == 4 and "7-1-1048581-3-19950102" in keys


def test_rolling_deviation_of_a_whole_table(small, table):
    want = table.sort_values("CoilID").X2.rolling(5, min_periods=2).std()
    for size in (4, 7, 1000):
        found = rolling_std(small, ["X2"], "CoilID", rows_per_part=size).orderBy("CoilID").toPandas()
        assert len(found) == len(table) and np.allclose(found.X2_rolling_std.astype(float), want, equal_nan=True)


@pytest.mark.parametrize("files", [0, 3])
def test_a_table_streams_as_one_file_or_as_a_folder(spark, tmp_path, files):
    rows = spark.range(0, 100, 1, 3).selectExpr("id", "id * 0.5 AS value")
    if files:
        rows.write.parquet(str(tmp_path / "things.parquet"))
    else:
        rows.toPandas().to_parquet(tmp_path / "things.parquet")
    rows.toPandas().to_parquet(tmp_path / "others.parquet")
    query = table_stream(spark, str(tmp_path), "things").writeStream.format("memory").queryName(f"things{files}")
    query.trigger(availableNow=True).start().awaitTermination()
    assert spark.table(f"things{files}").exceptAll(rows).isEmpty() and spark.table(f"things{files}").count() == 100


def test_lines_join_in_small_tasks_after_the_orders_found_their_customers(spark, monkeypatch):
    want = stand_ins.measurements_lineitem(spark, SF)
    monkeypatch.setattr(stand_ins, "SMALL", 0)
    monkeypatch.setattr(stand_ins, "ROWS_PER_TASK", 100)
    found = stand_ins.measurements_lineitem(spark, SF)
    assert found.exceptAll(want).isEmpty() and found.count() == want.count()
    assert found.rdd.getNumPartitions() >= want.count() / 100
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # Each join with a large table deals both sides out; the customers' one deals out the orders instead of the lines.
    assert plan.count("RepartitionByExpression") == 2 * 4
    assert any("o_custkey" in x and "c_custkey" in x and "Join" in x for x in plan.splitlines())


def test_many_lines_are_joined_once(spark, monkeypatch):
    from checks.queries import large_lines

    few = large_lines(["X1", "Y"])(spark, SF)
    monkeypatch.setattr(stand_ins, "ROWS_PER_TASK", 1000)
    many = large_lines(["X1", "Y"])(spark, SF)
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (few, many)]
    assert "Join" in plans[0] and "Join" not in plans[1] and many.exceptAll(few).isEmpty() and many.columns == ["X1", "Y"]
