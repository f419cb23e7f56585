import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from procsight.operators import sampling
from procsight.operators.smote import hybrid_resample, nearest_neighbours, smote

FEATURES = ["X1", "X2", "X3"]


def test_numbers_are_gapless_and_repeatable(small):
    one = sampling.numbered(small, ["Y"], ["CoilID"]).toPandas()
    for _, part in one.groupby("Y"):
        assert sorted(part.position) == list(range(len(part)))
    other = sampling.numbered(small.repartition(3), ["Y"], ["CoilID"]).toPandas()
    key = ["CoilID", "position"]
    assert one.sort_values(key)[key].values.tolist() == other.sort_values(key)[key].values.tolist()


def test_folds(small):
    folded = sampling.stratified_folds(small).toPandas()
    assert len(folded) == 300 and folded.CoilID.is_unique and set(folded.fold) == set(range(5))
    sizes = folded.groupby(["Y", "fold"]).size()
    for y in (0, 1):
        assert sizes[y].max() - sizes[y].min() <= 1


def test_hash_sample_is_exact(spark, small):
    sizes = spark.createDataFrame([(0, 37), (1, 10_000)], "Y int, size int")
    found = sampling.hash_sample(small, ["Y"], ["CoilID"], sizes).toPandas()
    whole = small.groupBy("Y").count().toPandas().set_index("Y")["count"]
    assert (found.Y == 0).sum() == 37 and (found.Y == 1).sum() == whole[1] and found.CoilID.is_unique


def test_weights(small, table):
    normal, defect = (table.Y == 0).sum(), (table.Y == 1).sum()
    for mode, expected in ((19.5, (1.0, 19.5)), ("unbalance", (1.0, normal / defect)), ("balanced", (300 / 2 / normal, 300 / 2 / defect))):
        found = {r["Y"]: r["weight"] for r in sampling.class_weights(small, mode=mode).select("Y", "weight").distinct().collect()}
        assert np.allclose((found[0], found[1]), expected)
    with pytest.raises(ValueError):
        sampling.class_weights(small, mode="none")
    with pytest.raises(ValueError):
        sampling.class_weights(small.filter("Y = 0"))


def test_bags_are_balanced(small, table):
    bags = sampling.balanced_bags(small, bags=4).toPandas()
    minority = (table.Y == 1).sum()
    for _, part in bags.groupby("bag"):
        sizes = part.Y.value_counts()
        assert sizes[0] == sizes[1] and abs(sizes[1] - minority) < 4 * np.sqrt(minority)
    # Copies of one row are told apart, and bags differ.
    assert not bags.duplicated(["bag", "CoilID", "copy"]).any()
    assert bags[bags.bag == 0].CoilID.tolist() != bags[bags.bag == 1].CoilID.tolist()


@pytest.mark.parametrize("rows_per_leaf", [4096, 7])
@pytest.mark.parametrize("k", [1, 3])
def test_neighbours_match_brute_force(small, table, rows_per_leaf, k):
    few = small.filter("Y = 1")
    found = nearest_neighbours(few, FEATURES, k=k, rows_per_leaf=rows_per_leaf).toPandas()
    rows = table[table.Y == 1]
    x, names = rows[FEATURES].to_numpy(), rows.CoilID.to_numpy()
    assert len(found) == k * len(rows)
    for i, name in enumerate(names):
        distance = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        distance[i] = np.inf
        order = np.lexsort((names, distance))[:k]
        part = found[found.CoilID == name].sort_values("place")
        assert part.neighbour.tolist() == names[order].tolist()
        assert np.allclose(part.distance, distance[order])


def test_neighbours_of_equal_rows(spark):
    rows = [(i, 1.0, 2.0) for i in range(9)] + [(9, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "CoilID bigint, X1 double, X2 double")
    found = nearest_neighbours(df, ["X1", "X2"], rows_per_leaf=3).toPandas()
    assert (found.groupby("CoilID").size() == 3).all()
    assert (found[found.CoilID < 9].distance == 0).all()
    assert found[found.CoilID == 9].neighbour.tolist() == [0, 1, 2]


def test_smote(small, table):
    made = smote(small, FEATURES).toPandas()
    assert (made.Y == 1).sum() == (made.Y == 0).sum() == (table.Y == 0).sum()
    kept = made[~made.synthetic].sort_values("CoilID")
    assert np.allclose(kept[FEATURES].to_numpy(), table[FEATURES].to_numpy())
    rows = table.set_index("CoilID")[FEATURES]
    synthetic = made[made.synthetic]
    a, b = rows.loc[synthetic.source].to_numpy(), rows.loc[synthetic.neighbour].to_numpy()
    gap = synthetic.gap.to_numpy()[:, None]
    assert np.allclose(synthetic[FEATURES].to_numpy(), a + gap * (b - a)) and ((gap >= 0) & (gap < 1)).all()
    assert not synthetic.duplicated(["source", "copy"]).any()
    again = smote(small.repartition(2), FEATURES).toPandas()
    order = ["source", "copy"]
    assert again[again.synthetic].sort_values(order).gap.tolist() == synthetic.sort_values(order).gap.tolist()


def test_smote_needs_neighbours(small):
    few = small.filter("Y = 0").unionByName(small.filter("Y = 1").orderBy("CoilID").limit(3))
    with pytest.raises(ValueError):
        smote(few, FEATURES)


def test_hybrid(small):
    found = {r["Y"]: r["weight"] for r in hybrid_resample(small, FEATURES).select("Y", "weight").distinct().collect()}
    assert found == {0: 1.0, 1: 20.0}


@pytest.mark.parametrize("most", [sampling.MOST_HASHES, 1])
def test_bags_equal_brute_force(spark, monkeypatch, most):
    """Also where a key has many rows, is null, or too many hashes are near to be counted one by one."""
    monkeypatch.setattr(sampling, "MOST_HASHES", most)
    keys = [*range(250), *[3] * 60, *[None] * 40]
    rows = [(k, float(i), int(i % 9 == 1)) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "CoilID bigint, X1 double, Y int").repartition(3)
    found = sampling.balanced_bags(df, bags=6).toPandas()

    def mark(*parts):
        return int(hashlib.md5("|".join(str(p) for p in (*parts, sampling.SEED) if p is not None).encode()).hexdigest()[:15], 16)

    def copies(u):
        n, term, reached = 0, math.exp(-1.0), math.exp(-1.0)
        while u >= reached:
            n, term = n + 1, term / (n + 1)
            reached += term
        return n

    for bag in range(6):
        drawn = [
            (mark(k, bag, c), k, c, y) for k, _, y in rows for c in range(1, copies(mark(k, bag) % 2**52 / 2**52) + 1)
        ]
        classes = [sorted(d[0] for d in drawn if d[3] == y) for y in (0, 1)]
        size = min(map(len, classes))
        for y in (0, 1):
            own = found[(found.bag == bag) & (found.Y == y)]
            got = [mark(None if np.isnan(k) else int(k), bag, c) for k, c in zip(own.CoilID, own["copy"], strict=True)]
            assert sorted(got) == classes[y][:size]


def test_bags_hash_in_batches(small):
    """No MD5 is left to each row and bag, or to each branch that compares it."""
    plan = sampling.balanced_bags(small, bags=4)._jdf.queryExecution().executedPlan().toString()
    assert "md5(" not in plan and plan.count("MapInArrow") == 1


def test_marks_of_any_length(spark):
    from procsight.functions.columns import key_mark
    from procsight.functions.marks import Texts, marks

    texts = [("x" * n + "é" * (n % 3),) for n in (0, 1, 2, 3, 4, 5, 30, 48, 49, 50, 60, 130) for _ in range(2)]
    df = spark.createDataFrame(texts, "k string")
    want = df.select(*[key_mark(["k", F.lit(i)], 42).alias(f"m{i}") for i in (3, 11)]).toPandas()
    column = pa.array([f"{t}|" for t, in texts])
    for size, rows, own in Texts(column.slice(2)).groups:
        found = marks(size, own, [b"3|42", b"11|42"])
        for i, name in enumerate(("m3", "m11")):
            assert found[i].tolist() == want[name][rows + 2].tolist()
        pairs = np.array([1, 0]), np.array([0, len(rows) - 1])
        assert marks(size, own, [b"3|42", b"11|42"], pairs).tolist() == [found[1, 0], found[0, -1]]


def test_many_rows_are_numbered_in_small_tasks(small, monkeypatch):
    want = sampling.numbered(small, ["Y"], ["CoilID"])
    monkeypatch.setattr(sampling, "ROWS_PER_TASK", 10)
    found = sampling.numbered(small, ["Y"], ["CoilID"], rows=300)
    assert found.exceptAll(want).isEmpty() and found.count() == 300
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2 and ", 30" in plan


def test_synthetic_rows_are_made_after_the_last_join(small):
    plan = smote(small, FEATURES)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    copies = next(i for i, line in enumerate(plan) if "Generate explode(sequence(1" in line)
    assert not any("Join" in line for line in plan[:copies])
