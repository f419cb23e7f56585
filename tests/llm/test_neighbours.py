import numpy as np

from procsight.llm import neighbours
from procsight.llm.queries import op7_nearest_neighbours
from tests.conftest import SF

VECTORS = "vec_id bigint, embedding array<float>, label int, key int, v string, dim int"


def product(a, b):
    # A plain loop: the sum of recent interpreters rounds otherwise.
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total


def plain(rows, every, k):
    usable = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        usable.append((i, [float(np.float32(x)) for x in v]))
    out = []
    for n, (q, a) in enumerate(usable):
        if q % every == 0:
            scores = [(-product(a, b), i) for m, (i, b) in enumerate(usable) if m != n and len(a) == len(b)]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x", 2) for i, v in rows], VECTORS).repartition(3)


def test_awkward_rows_and_ties(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE", 16)
    random = np.random.default_rng(6)
    rows = [(i, random.normal(0, 1, 8).tolist()) for i in range(150)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]) for i in range(200, 300)]
    rows += [(300, None), (301, []), (302, [0.0] * 8), (303, [None] + [1.0] * 7), (304, [float("nan")] * 8), (305, [float("inf")] * 8)]
    rows += [(306, [1e30] * 8), (320, [1e-30] * 8), (None, [1.0] * 8), (340, [1.0, 2.0]), (341, [3.0, 1.0]), (200, [9.0] * 8), (0, rows[0][1])]
    found = neighbours.nearest(table(spark, rows), every=20, k=20).collect()
    assert sorted(tuple(r) for r in found) == plain(rows, 20, 20)


def test_fewer_candidates_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])]
    found = neighbours.nearest(table(spark, rows), every=20, k=20).collect()
    assert sorted(tuple(r) for r in found) == [(0, 1, 1, 0.5), (0, 2, 2, -1.0)]
    assert neighbours.nearest(table(spark, []), every=20, k=20).count() == 0
    assert neighbours.nearest(table(spark, rows[:1]), every=20, k=20).count() == 0


def test_bounds_hold():
    random = np.random.default_rng(8)
    a, b = random.normal(0, 1, (50, 64)), random.normal(0, 5, (60, 64))
    product, slack = neighbours.Codes(a).bounds(neighbours.Codes(b))
    assert (np.abs(a @ b.T - product) <= slack).all() and slack.mean() < 0.1 * np.abs(a @ b.T).max()


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in op7_nearest_neighbours(spark, SF).collect()) == plain(rows, 20, 20)
