import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from procsight.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("8")
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return session


@pytest.fixture(scope="session")
def table(spark):
    """300 rows: a shifted, a tied, a hot and a constant feature, and gaps."""
    random = np.random.default_rng(7)
    n = 300
    y = (random.random(n) < 0.15).astype(int)
    frame = pd.DataFrame(
        {
            "CoilID": np.arange(1000, 1000 + n),
            "X1": random.normal(0, 1, n) + y,
            "X2": random.integers(0, 6, n).astype(float),
            "X3": np.where(random.random(n) < 0.4, 2.5, random.normal(3, 1, n)),
            "X4": np.full(n, 7.0),
            "X5": random.lognormal(10, 1, n),
            "Y": y,
        }
    )
    frame.loc[frame.index % 11 == 0, "X5"] = np.nan
    return frame


def as_spark(spark, frame, parts=5):
    """A Spark table of a pandas frame with NaN as null, over several partitions."""
    columns = {c: "bigint" if c == "CoilID" else "int" if c == "Y" else "double" for c in frame.columns}
    rows = [
        tuple(None if isinstance(v, float) and np.isnan(v) else v for v in row)
        for row in frame.astype(object).itertuples(index=False, name=None)
    ]
    schema = ", ".join(f"`{c}` {kind}" for c, kind in columns.items())
    return spark.createDataFrame(rows, schema).repartition(parts)


@pytest.fixture(scope="session")
def small(spark, table):
    return as_spark(spark, table).persist()


@pytest.fixture(scope="session")
def wide(spark):
    from procsight.sources.stand_ins import measurements_embeddings

    return measurements_embeddings(spark, SF).persist()
