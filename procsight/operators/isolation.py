"""Isolation forest: many random trees on small samples, scored over all rows.

The samples are exact draws of `sample` rows per tree by hash, one group of that
fixed size per tree. A row finds the trees that it is a candidate of by skipping
ahead: one hash gives the next tree, so a row of a large table costs one hash
whatever the number of trees. The forest is a table of at most trees x 2 x sample
nodes.
"""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procsight import KEY, LABEL
from procsight.operators.latent import standardize
from procsight.operators.quantiles import SKETCH, exact_quantiles
from procsight.operators.sampling import SEED
from procsight.session import stored

TREES = 100
SAMPLE = 256
# Candidates per drawn row.
SPARE = 3


def expected_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    if n <= 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grow(sample: pd.DataFrame, features: list[str], seed: int) -> pd.DataFrame:
    """One random tree as rows (tree, node, feature, cut, low, high, length); leaves have feature -1."""
    tree = int(sample["tree"].iloc[0])
    x = sample.sort_values("__order")[features].to_numpy(dtype=float)
    random = np.random.default_rng([seed, tree])
    deepest = math.ceil(math.log2(max(len(x), 2)))
    nodes, waiting, issued = [], [(0, 0, np.arange(len(x)))], 1
    while waiting:
        node, depth, rows = waiting.pop()
        spread = np.ptp(x[rows], axis=0) if len(rows) else np.zeros(x.shape[1])
        choices = np.flatnonzero(spread > 0)
        if depth >= deepest or len(rows) <= 1 or not len(choices):
            nodes.append((tree, node, -1, 0.0, -1, -1, depth + expected_path(len(rows))))
            continue
        feature = int(random.choice(choices))
        column = x[rows, feature]
        cut = float(random.uniform(column.min(), column.max()))
        nodes.append((tree, node, feature, cut, issued, issued + 1, 0.0))
        waiting.append((issued, depth + 1, rows[column <= cut]))
        waiting.append((issued + 1, depth + 1, rows[column > cut]))
        issued += 2
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "low", "high", "length"])


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each 64-bit number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def trees_of(marks: np.ndarray, trees: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, tree): each row is in each tree with probability `rate`, independently; rows ascending.

    Gaps between a row's trees are geometric, so every hash of a row gives its
    next tree, and most rows of a large table are done after one.
    """
    step = math.log1p(-rate) if rate < 1 else -math.inf
    row, at = np.arange(len(marks)), np.full(len(marks), -1.0)
    x = marks.view(np.uint64)
    rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(row):
        x = _mixed(x + np.uint64(0x9E3779B97F4A7C15))
        u = ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        at = at + 1 + np.floor(np.log(u) / step)
        alive = at < trees
        row, at, x = row[alive], at[alive], x[alive]
        rows.append(row)
        found.append(at.astype(np.int64))
    rows, found = np.concatenate(rows), np.concatenate(found)
    order = np.argsort(rows, kind="stable")
    return rows[order], found[order]


def tree_samples(
    rows: DataFrame, key: str, n: int, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED
) -> DataFrame:
    """`sample` of the n rows per tree (all rows of a smaller table), without replacement in a tree, with `tree` and `__order`.

    A row is a tree's candidate at a rate that leaves SPARE candidates for each
    place; of those the ones with the lowest hashes are the sample.
    """
    rate = min(1.0, SPARE * sample / max(n, 1))

    @F.arrow_udf("array<int>")
    def drawn(marks: pa.Array) -> pa.Array:
        row, tree = trees_of(marks.to_numpy(zero_copy_only=False), trees, rate)
        edge = np.searchsorted(row, np.arange(len(marks) + 1))
        return pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(tree, pa.int32()))

    candidates = rows.withColumn("tree", F.explode(drawn(F.xxhash64(F.lit(seed + 1), F.col(key)))))
    lowest = Window.partitionBy("tree").orderBy("__order", key)
    placed = candidates.withColumn("__order", F.xxhash64(F.lit(seed), F.col(key), "tree"))
    return placed.withColumn("__place", F.row_number().over(lowest)).filter(F.col("__place") <= sample).drop("__place")


def isolation_scores(
    df: DataFrame,
    features: list[str],
    key: str = KEY,
    label: str = LABEL,
    trees: int = TREES,
    sample: int = SAMPLE,
    seed: int = SEED,
) -> DataFrame:
    """(key, label, score): 2^(-mean path / expected path), higher is more anomalous."""
    spark = df.sparkSession
    scaled = standardize(df.select(key, label, *features), features)
    n = df.count()
    forest = (
        tree_samples(scaled.select(key, *features), key, n, trees, sample, seed)
        .select("tree", "__order", *features)
        .groupBy("tree")
        .applyInPandas(
            lambda rows: _grow(rows, features, seed),
            "tree int, node int, feature int, cut double, low int, high int, length double",
        )
        .toPandas()
    )
    size = min(sample, n)
    shared = spark.sparkContext.broadcast(
        [part.sort_values("node") for _, part in forest.groupby("tree")]
    )
    scale = expected_path(size)

    @F.pandas_udf("double")
    def score(rows: pd.Series) -> pd.Series:
        x = np.stack(rows.to_numpy())
        every = np.arange(len(x))
        length = np.zeros(len(x))
        for part in shared.value:
            feature, cut = part["feature"].to_numpy(), part["cut"].to_numpy()
            low, high, depth = (part[c].to_numpy() for c in ("low", "high", "length"))
            at = np.zeros(len(x), dtype=int)
            while (inner := feature[at] >= 0).any():
                left = x[every, np.maximum(feature[at], 0)] <= cut[at]
                at = np.where(inner, np.where(left, low[at], high[at]), at)
            length += depth[at]
        return pd.Series(2.0 ** (-length / len(shared.value) / scale))

    point = F.array(*[F.col(c) for c in features])
    return scaled.select(key, label, score(point).alias("score"))


def isolation_forest(
    df: DataFrame,
    features: list[str],
    key: str = KEY,
    label: str = LABEL,
    contamination: float = 0.1,
    trees: int = TREES,
    sample: int = SAMPLE,
    seed: int = SEED,
    size: int = SKETCH,
) -> DataFrame:
    """(key, label, score, anomaly): anomaly is -1 for scores above the cut, else 1."""
    scored = stored(isolation_scores(df, features, key, label, trees, sample, seed))
    cut = exact_quantiles(scored, ["score"], [1 - contamination], size=size)[("score",)][0]
    return scored.withColumn("anomaly", F.when(F.col("score") > cut, F.lit(-1)).otherwise(F.lit(1)))


def anomaly_share(flagged: DataFrame, label: str = LABEL) -> DataFrame:
    """(defects, anomalous, share, verdict) over the defect rows."""
    defect = F.col(label) == 1
    counts = flagged.agg(
        F.count_if(defect).alias("defects"),
        F.count_if(defect & (F.col("anomaly") == -1)).alias("anomalous"),
    )
    share = F.coalesce(F.try_divide("anomalous", "defects"), F.lit(0.0))
    return counts.withColumn("share", share).withColumn(
        "verdict",
        F.when(F.col("share") > 0.7, "ISOLATED").when(F.col("share") > 0.3, "MIXED").otherwise("SYSTEMATIC"),
    )
