from fractions import Fraction

import numpy as np
import pytest

from procsight.llm import whitening as wh
from procsight.llm.queries import op12_embedding_whitening
from tests.conftest import SF

VECTORS = "vec_id bigint, embedding array<double>, label int, key string, x int, n int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "k", 1, 2) for i, v in rows], VECTORS).repartition(3)


def expected(rows, most=4):
    """{(vec_id, component): (n, deviation, whitened up to its sign, explained)} by numpy."""
    usable = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    dims = [len(v) for _, v in usable]
    dim = max(set(dims), key=lambda d: (dims.count(d), d))
    usable = [(i, [int(np.floor(x * 256)) for x in v]) for i, v in usable if len(v) == dim]
    fit = np.array(sorted({tuple(x) for _, x in usable}), float)
    centred = fit - fit.mean(axis=0)
    value, vector = np.linalg.eigh(centred.T @ centred / len(fit))
    out = []
    sums = [int(x) for x in fit.sum(axis=0)]
    for i, x in usable:
        deviation = sum((len(fit) * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        for k in range(1, min(most, dim) + 1):
            if value[-k] > 1e-12 * value[-1]:
                out.append((i, k, len(fit), deviation, (np.array(x) - fit.mean(axis=0)) @ vector[:, -k] / np.sqrt(value[-k]), value[-k] / value.sum()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0], r[1], r[3]))


def whitened(spark, rows, most=4):
    found = wh.whiten(table(spark, rows), most).collect()
    return sorted((tuple(r) for r in found), key=lambda r: (r[0] is not None, r[0], r[1], r[3]))


def agree(found, want):
    assert [r[:4] for r in found] == [r[:4] for r in want]
    for k in {r[1] for r in want}:
        a, b = (np.array([r[4] for r in rows if r[1] == k]) for rows in (found, want))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
    assert np.allclose([r[5] for r in found], [r[5] for r in want], rtol=1e-10)
    assert all(r[6] < 1e-9 for r in found)


def test_awkward_rows(spark):
    random = np.random.default_rng(1)
    rows = [(i, (random.normal(0, 1, 6) * [5, 4, 3, 2, 1, 0.5]).tolist()) for i in range(80)]
    rows += [(100 + i, [0.25, -0.5, 1.0, 2.0, 0.0, -0.0]) for i in range(60)]
    rows += [(200, None), (201, []), (202, [None] * 6), (203, [float("nan")] + [1.0] * 5), (204, [float("-inf")] * 6), (205, [1.0, 2.0]), (206, [1.0])]
    rows += [(None, [3.0] * 6), (100, [7.0] * 6), (7, rows[7][1])]
    agree(whitened(spark, rows), expected(rows))


def test_few_dimensions_low_rank_and_none(spark):
    agree(whitened(spark, [(1, [1.0]), (2, [2.0]), (3, [2.0])]), expected([(1, [1.0]), (2, [2.0]), (3, [2.0])]))
    # Rank two in five dimensions: two components.
    random = np.random.default_rng(2)
    base = np.array([[1, 2, 0, 1, 3], [0, 1, 1, 4, 1]])
    rows = [(i, (random.integers(-9, 9, 2) @ base).astype(float).tolist()) for i in range(30)]
    found = whitened(spark, rows)
    assert {r[1] for r in found} == {1, 2}
    agree(found, expected(rows))
    assert whitened(spark, []) == [] and whitened(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    assert whitened(spark, [(1, None)]) == []


def test_equal_eigenvalues(spark):
    """The corners of a cross polytope: every direction is a component, any orthogonal choice is right."""
    rows = [(i, [float(s * (j == i // 2)) for j in range(5)]) for i, s in ((i, 1 if i % 2 else -1) for i in range(10))]
    found = whitened(spark, rows)
    assert len(found) == 40 and all(r[6] < 1e-12 for r in found)
    assert np.allclose([r[5] for r in found], 0.2)


def test_very_large_entries(spark):
    rows = [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [5e17, 3.0]), (4, [1e5, 2.0])]
    found = whitened(spark, rows)
    assert len(found) == 8 and {r[2] for r in found} == {4} and any(r[3] is None for r in found)
    agree(whitened(spark, rows[3:] + [(5, [2e5, 1.0]), (6, [3e5, -8.0])]), expected(rows[3:] + [(5, [2e5, 1.0]), (6, [3e5, -8.0])]))


def test_primes():
    sieve = np.ones(2000, bool)
    sieve[:2] = False
    for i in range(2, 45):
        sieve[i * i :: i] = False
    assert [i for i in range(2000) if wh.is_prime(i)] == np.flatnonzero(sieve).tolist()
    assert wh.is_prime(2147483647) and not wh.is_prime(2147483647 - 2)


def exact_polynomial(matrix):
    """Faddeev's and Le Verrier's recurrence in fractions."""
    n = len(matrix)
    a = [[Fraction(int(x)) for x in row] for row in matrix]
    c, m = [Fraction(1)], [[Fraction(0)] * n for _ in range(n)]
    for k in range(1, n + 1):
        m = [[sum(a[i][t] * m[t][j] for t in range(n)) + (c[-1] if i == j else 0) for j in range(n)] for i in range(n)]
        c.append(-sum(sum(a[i][t] * m[t][i] for t in range(n)) for i in range(n)) / k)
    return [int(x) for x in c]


@pytest.mark.parametrize("dim", [1, 2, 5, 9])
def test_polynomial_against_fractions(spark, dim):
    random = np.random.default_rng(dim)
    x = random.integers(-1000, 1000, (dim + 3, dim))
    x[:, : dim // 3] = 0
    matrix = (x.T @ x).tolist()
    assert wh.characteristic_polynomial(spark, matrix) == exact_polynomial(matrix)
    for p in (101, 2147483647):
        any_matrix = random.integers(0, p, (dim, dim))
        any_matrix[dim // 2 :, 0] = 0
        assert wh.polynomial_mod(any_matrix, p) == [c % p for c in exact_polynomial(any_matrix)]


def test_roots_with_multiplicity_and_zero():
    # (t - 7)^2 (t - 3) t^2, and roots that lie a millionth apart.
    p = np.array([1], object)
    for r in (7, 7, 3, 0, 0):
        p = np.convolve(p, np.array([1, -r], object))
    found, bits = wh.largest_roots(p.tolist(), 4)
    assert len(found) == 3
    for m, r in zip(found, (7, 7, 3), strict=True):
        assert m < r << bits <= m + 1
    p = np.array([1], object)
    for r in (10**12 + 1, 10**12, 10**6, 1):
        p = np.convolve(p, np.array([1, -r], object))
    found, bits = wh.largest_roots(p.tolist(), 4)
    assert [round(Fraction(2 * m + 1, 1 << bits + 1)) for m in found] == [10**12 + 1, 10**12, 10**6, 1]


def test_components_of_a_hidden_basis():
    random = np.random.default_rng(4)
    x = random.integers(-50, 50, (200, 12)) * np.array([9, 8, 7, 6, 5, 4, 3, 2, 1, 1, 1, 1])
    matrix = (x.T @ x).tolist()
    roots, bits = wh.largest_roots(exact_polynomial(matrix), 4)
    v = wh.components(matrix, roots, bits)
    for axis, root in zip(v, roots, strict=True):
        value = float(Fraction(root, 1 << bits))
        assert abs(np.linalg.norm(axis) - 1) < 1e-15 and np.abs(np.array(matrix, float) @ axis - value * axis).max() < 1e-10 * value


def test_packing_of_rows():
    x = np.array([[1, -128, 127], [300, 0, 0], [1 << 20, 0, -5], [-(1 << 62), 1, 2], [1, -128, 127]])
    rows = wh.packed(x)
    assert [len(r) for r in rows] == [3, 6, 12, 24, 3] and rows[0] == rows[4]
    assert (wh.unpacked(rows, 3) == x).all()


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    found = sorted((tuple(r) for r in op12_embedding_whitening(spark, SF).collect()), key=lambda r: r[:2])
    want = expected(rows)
    assert len(found) == 4 * len(rows)
    agree(found, want)
