"""Additive attributions of boosted-tree scores, computed as a scoring job.

The ensemble's public description is read as a small table of nodes; how many rows
pass each node is counted on the training rows. For every leaf the exact Shapley
values of "all conditions on the path hold" have a closed form over the leaf's
few features, where a feature outside the coalition is replaced by the share of
training weight that follows the path.
"""

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procsight import KEY, LABEL


@dataclass
class Tree:
    """One tree as arrays by node, the root first; `feature` is -1 at leaves."""

    weight: float
    feature: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: np.ndarray

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row falls into."""
        every, at = np.arange(len(x)), np.zeros(len(x), np.int64)
        while (inner := self.feature[at] >= 0).any():
            left = x[every, np.maximum(self.feature[at], 0)] <= self.cut[at]
            at = np.where(inner, np.where(left, self.low[at], self.high[at]), at)
        return at


_TREE = re.compile(r"\s*Tree \d+ \(weight (\S+)\):")
_SPLIT = re.compile(r"(\s*)If \(feature (\d+) <= (\S+)\)")
_LEAF = re.compile(r"(\s*)Predict: (\S+)")


def parse_trees(description: str) -> list[Tree]:
    """The trees of an ensemble's public description (`toDebugString`), which gives every number in full.

    Splits on ranges only; the branch for larger values follows its `Else` at the same indent as the `If`.
    """
    trees, nodes, waiting, weight = [], [], [], 1.0

    def done():
        if nodes:
            columns = [np.array(c) for c in zip(*nodes, strict=True)]
            trees.append(Tree(weight, *columns))

    for line in description.splitlines():
        if found := _TREE.fullmatch(line):
            done()
            nodes, waiting, weight = [], [], float(found[1])
        elif found := _SPLIT.fullmatch(line):
            _place(nodes, waiting)
            waiting.append(len(nodes))
            nodes.append([int(found[2]), float(found[3]), -1, -1, 0.0])
        elif found := _LEAF.fullmatch(line):
            _place(nodes, waiting)
            nodes.append([-1, 0.0, -1, -1, float(found[2])])
        elif " in {" in line:
            raise ValueError("splits on categories have no ranges")
    done()
    return trees


def _place(nodes: list[list], waiting: list[int]) -> None:
    """Hang the next node under the last split that lacks a branch."""
    if waiting:
        parent = nodes[waiting[-1]]
        if parent[2] < 0:
            parent[2] = len(nodes)
        else:
            parent[3] = len(nodes)
            waiting.pop()


def cover(df: DataFrame, features: list[str], trees: list[Tree]) -> list[np.ndarray]:
    """How many rows of `df` pass each node of each tree: one scan, one row for each task and leaf."""

    def count(batches):
        total = [np.zeros(len(t.feature), np.int64) for t in trees]
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)])
            for t, own in zip(trees, total, strict=True):
                own += np.bincount(t.leaf_of(x), minlength=len(own))
        rows = [(i, j, int(n)) for i, own in enumerate(total) for j, n in enumerate(own) if n]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        kinds = (pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["tree", "node", "n"])

    rows = df.select(*[F.col(f"`{c}`").cast("double") for c in features]).mapInArrow(count, "tree int, node int, n bigint")
    out = [np.zeros(len(t.feature)) for t in trees]
    for r in rows.groupBy("tree", "node").agg(F.sum("n").alias("n")).collect():
        out[r.tree][r.node] = r.n
    for t, own in zip(trees, out, strict=True):
        # Children come after their parents.
        for node in range(len(own) - 1, -1, -1):
            if t.feature[node] >= 0:
                own[node] = own[t.low[node]] + own[t.high[node]]
    return out


def read_leaves(trees: list[Tree], covers: list[np.ndarray]) -> list[tuple]:
    """(value, {feature: (share, low, high)}) per leaf.

    A row meets the leaf's conditions on a feature when low < x <= high; share is the part of the rows at the
    splits on that feature that went the leaf's way (half where no row came by).
    """
    leaves = []
    for tree, own in zip(trees, covers, strict=True):
        open_nodes = [(0, {})]
        while open_nodes:
            node, path = open_nodes.pop()
            if tree.feature[node] < 0:
                leaves.append((tree.weight * float(tree.value[node]), path))
                continue
            feature, cut = int(tree.feature[node]), float(tree.cut[node])
            share, low, high = path.get(feature, (1.0, -math.inf, math.inf))
            for child, span in (
                (int(tree.low[node]), (low, min(high, cut))),
                (int(tree.high[node]), (max(low, cut), high)),
            ):
                part = own[child] / own[node] if own[node] else 0.5
                open_nodes.append((child, {**path, feature: (share * float(part), *span)}))
    return leaves


def _leaf_values(x: np.ndarray, value: float, path: dict) -> Iterator[tuple[int, np.ndarray]]:
    """Shapley value per feature of one leaf, for all rows of a batch."""
    d = len(path)
    meets = {f: ((x[:, f] > low) & (x[:, f] <= high)).astype(float) for f, (_, low, high) in path.items()}
    coalition = [math.factorial(s) * math.factorial(d - s - 1) / math.factorial(d) for s in range(d)]
    for feature, (share, _, _) in path.items():
        # Coefficient s: sum over coalitions of s other features of their joint product.
        terms = np.zeros((d, len(x)))
        terms[0] = 1.0
        for other, (rest, _, _) in path.items():
            if other != feature:
                shifted = np.vstack([np.zeros((1, len(x))), terms[:-1]]) * meets[other]
                terms = terms * rest + shifted
        yield feature, value * (meets[feature] - share) * (np.array(coalition) @ terms)


def tree_attributions(
    df: DataFrame, features: list[str], model, key: str = KEY, label: str = LABEL, background: DataFrame | None = None
) -> DataFrame:
    """(key, label, base, attributions): base + sum(attributions) is the model's margin.

    `model` is a boosted classifier stage, or the folder that it was saved to. The
    rows of `background` (by default `df`, best the training rows) weigh the
    branches. The leaf table, trees x 2^depth entries, travels to the tasks as
    a broadcast variable.
    """
    spark = df.sparkSession
    if isinstance(model, str):
        model = GBTClassificationModel.load(model)
    trees = parse_trees(model.toDebugString)
    leaves = read_leaves(trees, cover(df if background is None else background, features, trees))
    base = float(sum(v * math.prod(s for s, _, _ in path.values()) for v, path in leaves))
    shared = spark.sparkContext.broadcast(leaves)
    width = len(features)

    @F.pandas_udf("array<double>")
    def attribute(rows: pd.Series) -> pd.Series:
        x = np.stack(rows.to_numpy())
        out = np.zeros((len(x), width))
        for value, path in shared.value:
            for feature, part in _leaf_values(x, value, path):
                out[:, feature] += part
        return pd.Series(list(out))

    inputs = F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    return df.select(key, label, F.lit(base).alias("base"), attribute(inputs).alias("attributions"))


def attribution_rows(attributed: DataFrame, features: list[str], key: str = KEY) -> DataFrame:
    """(key, label, feature, attribution): the long table."""
    names = F.array(*[F.lit(c) for c in features])
    others = [c for c in attributed.columns if c != "attributions"]
    return attributed.select(*others, F.posexplode("attributions").alias("place", "attribution")).select(
        *others, F.element_at(names, F.col("place") + 1).alias("feature"), "attribution"
    )


def global_attributions(attributed: DataFrame, features: list[str]) -> DataFrame:
    """(feature, mean_abs): ranking by mean absolute attribution."""
    return (
        attribution_rows(attributed, features)
        .groupBy("feature")
        .agg(F.avg(F.abs("attribution")).alias("mean_abs"))
        .orderBy(F.desc("mean_abs"), "feature")
    )


def explain_first_defect(
    attributed: DataFrame, features: list[str], key: str = KEY, label: str = LABEL
) -> DataFrame:
    """The attributions of the first defect row, largest first."""
    first = attributed.filter(F.col(label) == 1).orderBy(key).limit(1)
    return attribution_rows(first, features, key).orderBy(F.desc(F.abs("attribution")), "feature")
