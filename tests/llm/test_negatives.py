import numpy as np
import pytest

from procsight.llm import negatives
from procsight.llm.queries import SQL, op13_hard_negatives
from tests.conftest import SF

VECTORS = "vec_id bigint, embedding array<double>, label int, uid int, x string, dim int, rank int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def plain(rows, every=50, positives=5, k=3, low=50, high=95):
    usable = []
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        usable.append((i, [int(np.floor(x * 256)) for x in v], label))
    out = []
    for i, a, label in usable:
        if i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(a, b, strict=True)), j, other) for j, b, other in usable if j != i and len(a) == len(b)]
        scored.sort(key=lambda s: s[:2])
        for s, j, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [t for t in scored if t[2] != label and low * -s <= 100 * -t[0] <= high * -s]
            out += [(i, j, rank, t[1], -s, -t[0]) for rank, t in enumerate(fits[:k], 1)]
    return sorted(out)


def mined(spark, rows, **how):
    df = spark.createDataFrame([(i, v, label, 1, "x", 2, 3) for i, v, label in rows], VECTORS).repartition(3)
    return sorted(tuple(r[c] for c in COLUMNS) for r in negatives.mine(df, **how).collect())


def random_rows(n, dim=20, seed=1, labels=4):
    random = np.random.default_rng(seed)
    centre = random.normal(0, 1, (labels, dim))
    return [(i, (centre[i % labels] + random.normal(0, 1, dim)).tolist(), int(i % labels)) for i in range(n)]


AWKWARD = [
    (1000, None, 1), (1050, [], 1), (1100, [None] + [1.0] * 19, 1), (1150, [float("nan")] * 20, 1), (1200, [float("inf")] * 20, 1),
    (None, [1.0] * 20, 1), (1250, [1.0] * 20, None), (1300, [0.0] * 20, 2), (1350, [1.0, 2.0], 2), (1351, [2.0, 1.0], 2), (1352, [1.0, 1.5], 1),
    (1400, [-3.0] * 20, 7),
]


@pytest.mark.parametrize("blocks", [8192, 16])
def test_awkward_rows_ties_and_rounds(spark, monkeypatch, blocks):
    """Small blocks: many cells, and rounds that start from the bounds of those before."""
    for name in ("ANCHOR_BLOCK", "ROW_BLOCK", "TILE"):
        monkeypatch.setattr(negatives, name, blocks)
    monkeypatch.setattr(negatives, "LEAST_BLOCKS", 2)
    monkeypatch.setattr(negatives, "FIRST", 4)
    monkeypatch.setattr(negatives, "GROWTH", 2)
    rows = random_rows(260)
    # Equal vectors of both kinds: ties go to the smaller id.
    rows += [(i, [0.5] * 20, i % 3) for i in range(300, 420)]
    rows += AWKWARD
    assert mined(spark, rows) == plain(rows)


def test_repeated_ids_stay_candidates(spark):
    rows = random_rows(60) + [(3, [0.4] * 20, 0), (3, [0.4] * 20, 0), (7, [0.3] * 20, 1)]
    assert mined(spark, rows) == plain(rows)
    # A repeated anchor has its rows each; none of them is another's positive.
    twice = [*rows, rows[0]]
    assert mined(spark, twice) == plain(twice)


def test_few_rows_and_none(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0, 2.0], 1)]) == []
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 5.0], 2), (3, [0.2, 0.0], 2)]
    assert mined(spark, rows) == plain(rows) == [(0, 1, 1, 2, 65536, 58880)]


def test_large_entries(spark):
    rows = [(0, [6.5e6, -4e6], 1), (1, [4e6, 2e6], 1), (2, [3.2e6, 2.2e6], 2), (50, [1e300, 1.0], 2), (51, [1e300, 2.0], 2)]
    some = mined(spark, [r for r in rows if r[0] < 50])
    assert some == plain([r for r in rows if r[0] < 50]) and len(some) == 1
    # Entries and scores beyond 64 bits are the last number of 64 bits.
    assert len(mined(spark, rows)) >= len(some)


def test_bounds_hold_on_every_level():
    random = np.random.default_rng(3)
    for dim in (1, 5, 16, 33, 64):
        x = random.integers(-300, 300, (40, dim))
        side = object.__new__(negatives.Side)
        side.dim, side.levels, side.top = dim, negatives.edges(dim), int(np.abs(x).max())
        parts = [negatives.summaries(x, e) for e in side.levels]
        side.mean, side.dev = [m for m, _ in parts], [d for _, d in parts]
        exact, width = x @ x.T, []
        for level in range(len(side.levels)):
            low, high = negatives.bounds(side, side, level)
            assert (low <= exact).all() and (exact <= high).all()
            width.append((high - low).mean())
        # Finer segments bound better.
        assert all(b <= a for a, b in zip(width, width[1:], strict=False))


def test_coarse_summaries_from_fine_ones(spark):
    rows = random_rows(30, 21)
    df = spark.createDataFrame([(i, v, label, 1, "x", 2, 3) for i, v, label in rows], VECTORS)
    table = negatives.prepared(df, "vec_id", "label", "embedding").toArrow()
    side = negatives.Side(table, negatives._LEFT)
    for level, edge in enumerate(side.levels):
        mean, dev = negatives.summaries(side.x, edge)
        assert np.allclose(mean, side.mean[level]) and np.allclose(dev, side.dev[level])


def test_pairs_are_ruled_out_before_they_are_scored(spark, monkeypatch):
    """Vectors that a few segments tell apart: most pairs never come to be scored."""
    random = np.random.default_rng(5)
    x = np.repeat(random.normal(0, 100, (400, 4)), 16, axis=1).astype(np.int64) + random.integers(0, 3, (400, 64))
    side = object.__new__(negatives.Side)
    side.dim, side.levels, side.top = 64, negatives.edges(64), int(np.abs(x).max())
    parts = [negatives.summaries(x, e) for e in side.levels]
    side.mean, side.dev = [m for m, _ in parts], [d for _, d in parts]
    exact = x @ x.T
    floor = np.sort(exact, axis=1)[:, -5]
    keep = lambda i, low, high: high >= (floor[:, None] if i is None else floor[i])
    i, j = negatives.filtered(side, side, np.ones((400, 400), bool), keep)
    assert len(i) < 0.1 * 400 * 400
    assert {(a, b) for a, b in zip(*np.nonzero(exact >= floor[:, None]), strict=True)} <= set(zip(i.tolist(), j.tolist(), strict=True))


def test_whole_table_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({SQL['op13_hard_negatives']})").fetchall())
    found = sorted(tuple(r[c] for c in COLUMNS) for r in op13_hard_negatives(spark, SF).collect())
    assert found == want and len(found) > 20
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert found == plain(rows)
