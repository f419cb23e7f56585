import numpy as np
import pytest

from procsight.operators import balltree
from procsight.operators.balltree import BallTree, child_of, closest, cuts_of, nearest_points
from procsight.operators.smote import nearest_neighbours, searched
from procsight.session import Scratch


def as_points(spark, x, kind="bigint"):
    rows = [(i if kind == "bigint" else f"k{i:05d}", v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, f"id {kind}, point array<double>").repartition(4)


def brute(x, k):
    square = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(square, np.inf)
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), square.shape), square), axis=1)[:, :k]
    return {(i, int(j), round(float(np.sqrt(square[i, j])), 9)) for i in range(len(x)) for j in order[i] if np.isfinite(square[i, j])}


def mixed(seed, n, dim):
    """Clusters of very different density, a line, and a lattice with many equal distances."""
    random = np.random.default_rng(seed)
    parts = [random.normal(0, 1, (n, dim)), random.normal(5, 0.01, (n, dim)), np.zeros((n // 2, dim))]
    parts[2][:, 0] = np.arange(n // 2)
    lattice = np.zeros((n // 2, dim))
    lattice[:, :2] = np.stack(np.divmod(np.arange(n // 2), 12), axis=1) - 40
    return np.unique(np.concatenate([*parts, lattice]), axis=0)


@pytest.mark.parametrize("rows_per_leaf, fanout", [(2048, 64), (40, 64), (12, 4)])
def test_points_match_brute_force(spark, monkeypatch, rows_per_leaf, fanout):
    monkeypatch.setattr(balltree, "FANOUT", fanout)
    monkeypatch.setattr(balltree, "ROWS_PER_CHUNK", 50)
    x = mixed(1, 120, 3)
    found, visited = nearest_points(as_points(spark, x), 3, rows_per_leaf)
    assert {(r.id, r.other, round(r.distance, 9)) for r in found.collect()} == brute(x, 3)
    assert visited == 1 if rows_per_leaf == 2048 else 1 < visited < 12


def test_text_ids_and_few_points(spark):
    x = mixed(2, 20, 2)
    found, _ = nearest_points(as_points(spark, x, "string"), 4, 8)
    assert {(int(r.id[1:]), int(r.other[1:]), round(r.distance, 9)) for r in found.collect()} == brute(x, 4)
    few, _ = nearest_points(as_points(spark, x[:3]), 5, 8)
    assert few.groupBy("id").count().select("count").distinct().collect() == [(2,)]
    assert nearest_points(as_points(spark, x[:1]), 5, 8)[0].count() == 0


def test_points_that_cuts_cannot_part(spark, monkeypatch):
    """Where projections fail, nodes are split by hash, and the answer is the same."""
    monkeypatch.setattr(balltree, "cuts_of", lambda x, n: (np.zeros((n - 1, x.shape[1])), np.full(n - 1, np.inf)))
    monkeypatch.setattr(balltree, "PATIENCE", 1)
    x = mixed(3, 40, 2)
    found, _ = nearest_points(as_points(spark, x), 3, 30)
    assert {(r.id, r.other, round(r.distance, 9)) for r in found.collect()} == brute(x, 3)


def test_halvings_are_balanced():
    random = np.random.default_rng(4)
    x = random.normal(0, 1, (4096, 5))
    child = child_of(x, *cuts_of(x, 16))
    assert set(child) == set(range(16)) and np.bincount(child).max() <= 2 * 4096 / 16
    same = child_of(np.ones((10, 2)), *cuts_of(np.ones((10, 2)), 4))
    assert set(same) == {0}


def test_leaves_are_bounded_and_balls_hold_their_points(spark):
    x = np.random.default_rng(5).normal(0, 1, (3000, 4))
    with Scratch(spark) as scratch:
        tree = BallTree(as_points(spark, x), scratch, 100)
        balls = {r.node: r for r in tree.balls.collect()}
        leaf = {}
        for r in tree.placed.collect():
            leaf.setdefault(r.node, []).append(r.point)
        assert max(map(len, leaf.values())) <= 100 and sum(map(len, leaf.values())) == 3000
        assert {n for n, b in balls.items() if b.leaf} == set(leaf)
        for node, points in leaf.items():
            at = node
            while at is not None:
                ball = balls[at]
                far = np.linalg.norm(np.array(points) - np.array(ball.center), axis=1).max()
                assert far <= ball.radius * (1 + 1e-9) + 1e-9
                at = ball.parent
        assert balls[0].n == 3000


def test_visits_stay_flat_as_the_table_grows(spark):
    """Eight times the points in the same space: a point still visits about as many leaves."""
    random = np.random.default_rng(6)
    visits = [nearest_points(as_points(spark, random.normal(0, 1, (n, 3))), 3, 100)[1] for n in (1500, 12_000)]
    assert visits[1] < 1.3 * visits[0]


def test_ties_go_to_the_smaller_id():
    y = np.array([[0.0], [2.0], [2.0], [-2.0]])
    row, column, distance = closest(np.array([9]), np.array([[0.0]]), np.array([7, 5, 3, 4]), y, 3)
    assert column.tolist() == [0, 2, 3] and distance.tolist() == [0, 2, 2]


def test_far_from_the_origin_distances_stay_exact():
    random = np.random.default_rng(7)
    x = random.normal(0, 1e-3, (200, 3)) + 1e6
    row, column, distance = closest(np.arange(200), x, np.arange(200), x, 3)
    want = sorted(brute(x, 3))
    assert sorted((int(a), int(b), round(float(d), 9)) for a, b, d in zip(row, column, distance, strict=True)) == want


def test_a_point_that_most_rows_share(spark):
    """Neighbours of equal rows are the first keys among them; rows without a place take no part."""
    rows = [(i, 1.0, 2.0) for i in range(400)] + [(400, 1.5, 2.0), (401, 9.0, 9.0), (402, None, 1.0), (403, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "CoilID bigint, X1 double, X2 double").repartition(3)
    found, visited = searched(df, ["X1", "X2"], rows_per_leaf=2)
    near = {}
    for r in found.orderBy("CoilID", "place").collect():
        near.setdefault(r.CoilID, []).append((r.neighbour, round(r.distance, 6)))
    assert near[0] == [(1, 0.0), (2, 0.0), (3, 0.0)] and near[2] == [(0, 0.0), (1, 0.0), (3, 0.0)]
    assert near[399] == [(0, 0.0), (1, 0.0), (2, 0.0)] and near[400] == [(0, 0.5), (1, 0.5), (2, 0.5)]
    assert set(near) == set(range(402)) and near[401][0][0] == 400
    assert nearest_neighbours(df, ["X1"], k=1).filter("CoilID = 401").first().neighbour == 400
