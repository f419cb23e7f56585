"""Whitening of embeddings by principal components from the exact characteristic polynomial.

Entries become whole numbers, so the scatter matrix n * X'X - S S' of the distinct
vectors is one of whole numbers and is summed without rounding. Its
characteristic polynomial is computed for many primes, each prime reduced to
Hessenberg form by itself on an executor, and put together by Chinese
remainders; as the matrix has no negative eigenvalues, the coefficients'
signs are known and their sizes bounded by the trace. All roots are real, so the
sign changes of the shifted polynomial count the roots beyond a point exactly
(Budan and Fourier): bisection isolates the largest roots and narrows them to
any precision. Components are the null space of the matrix less its root, by
inverse iteration in fixed-point arithmetic of a few hundred bits. Only what
the dimensions bound, never rows, comes to the driver.
"""

from decimal import Decimal
from fractions import Fraction
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procsight.llm.tables import kept

#: Entries are floor(SCALE * value).
SCALE = 256
#: Bits behind the point at first, significant bits that a root must have, and further bits of the inverse iteration.
BITS, SIGNIFICANT, GUARD = 128, 110, 64
#: Primes are below this, so that products of residues fit into 64 bits.
PRIMES_BELOW = 1 << 31
#: Sums are sent as two parts, as decimals have 38 digits.
HALF = 60
#: Bound of sums of whole numbers that double precision holds exactly.
EXACT = 1 << 53

RESULT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whole_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, x (array of floor(SCALE * entry)): rows of the commonest length without null and non-finite entries."""
    v = F.col(vector)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = df.where(v.isNotNull() & (F.size(v) > 0)).where(finite)
    found = rows.groupBy(F.size(v).alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    dim = found.dim if found else 0
    x = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE))
    return rows.where(F.size(v) == dim).select(F.col(key).cast("bigint").alias("key"), x.alias("x"))


def matrix_of(column: pa.Array) -> np.ndarray:
    """The rows of a column of lists of equal length, as 64-bit numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def packed(x: np.ndarray) -> list[bytes]:
    """Each row in the fewest bytes for a number (1, 2, 4 or 8) that hold it: equal rows have equal bytes."""
    out = np.empty(len(x), object)
    low, high = x.min(axis=1, initial=0), x.max(axis=1, initial=0)
    done = np.zeros(len(x), bool)
    for kind in ("<i1", "<i2", "<i4", "<i8"):
        info = np.iinfo(kind)
        fits = ~done & (low >= info.min) & (high <= info.max)
        for i in np.flatnonzero(fits):
            out[i] = x[i].astype(kind).tobytes()
        done |= fits
    return out.tolist()


def unpacked(rows: list[bytes], dim: int) -> np.ndarray:
    out = np.empty((len(rows), dim), np.int64)
    for i, row in enumerate(rows):
        out[i] = np.frombuffer(row, f"<i{len(row) // dim}")
    return out


def fit_list(vectors: DataFrame) -> DataFrame:
    """x (packed): every distinct vector once. A vector that very many rows share is one row of each map task."""

    def pack(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted(set(packed(matrix_of(batch.column(0))))), pa.binary())], ["x"])

    return vectors.select("x").mapInArrow(pack, "x binary").distinct()


def products(x: np.ndarray) -> np.ndarray:
    """x'x without rounding, as Python's whole numbers."""
    top = int(max(x.max(initial=0), -int(x.min(initial=0))))
    if top * top >= EXACT:
        own = x.astype(object)
        return own.T @ own
    step = max(1, EXACT // max(1, top * top) - 1)
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for k in range(0, len(x), step):
        part = x[k : k + step].astype(np.float64)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def scatter(distinct: DataFrame, dim: int) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums S, and n * X'X - S S' of the distinct vectors, exactly."""

    def add(batches):
        total = np.zeros((dim + 1, dim + 1), object)
        for batch in batches:
            x = unpacked(batch.column(0).to_pylist(), dim)
            total += products(np.column_stack([x, np.ones(len(x), np.int64)]))
        i, j = np.triu_indices(dim + 1)
        cells = [int(v) for v in total[i, j]]
        kind = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(i.astype(np.int32)),
                pa.array(j.astype(np.int32)),
                pa.array([Decimal(v >> HALF) for v in cells], kind),
                pa.array([Decimal(v & ((1 << HALF) - 1)) for v in cells], kind),
            ],
            ["i", "j", "high", "low"],
        )

    parts = distinct.mapInArrow(add, "i int, j int, high decimal(38,0), low decimal(38,0)")
    found = parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    gram = [[0] * (dim + 1) for _ in range(dim + 1)]
    for r in found:
        gram[r.i][r.j] = gram[r.j][r.i] = (int(r.high) << HALF) + int(r.low)
    n, sums = gram[dim][dim], gram[dim][:dim]
    return n, sums, [[n * gram[i][j] - sums[i] * sums[j] for j in range(dim)] for i in range(dim)]


def is_prime(n: int) -> bool:
    """Miller and Rabin's test; these bases decide every number below 3,215,031,751."""
    if n < 2 or n % 2 == 0:
        return n == 2
    d, twos = n - 1, 0
    while d % 2 == 0:
        d, twos = d // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, d, n)
        if base % n == 0 or x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def polynomial_mod(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(t - matrix) modulo p, the leading one first."""
    h = matrix % p
    dim = len(h)
    for k in range(dim - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        pivot = k + 1 + below[0]
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        factor = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        # Rows less multiples of the pivot row; the same multiples of their columns go to the pivot column.
        h[k + 2 :] = (h[k + 2 :] - factor[:, None] * h[k + 1][None, :] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * factor[None, :] % p).sum(axis=1)) % p
    # Of the leading blocks' polynomials, lowest coefficient first.
    polynomials = np.zeros((dim + 1, dim + 1), np.int64)
    polynomials[0, 0] = 1
    for k in range(1, dim + 1):
        own = np.zeros(dim + 1, np.int64)
        own[1:] = polynomials[k - 1, :-1]
        own = (own - int(h[k - 1, k - 1]) * polynomials[k - 1] % p) % p
        below = 1
        for i in range(1, k):
            below = below * int(h[k - i, k - i - 1]) % p
            if not below:
                break
            own = (own - below * int(h[k - i - 1, k - 1]) % p * polynomials[k - i - 1] % p) % p
        polynomials[k] = own
    return polynomials[dim][::-1].tolist()


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(t - matrix), the leading one first, of a symmetric matrix without negative eigenvalues.

    The k-th is (-1)^k times the eigenvalues' k-th elementary symmetric sum,
    which is at most comb(dim, k) * (trace / dim)^k.
    """
    dim = len(matrix)
    trace = sum(matrix[i][i] for i in range(dim))
    bound = max(comb(dim, k) * trace**k // dim**k + 1 for k in range(dim + 1))
    primes, product, candidate = [], 1, PRIMES_BELOW - 1
    while product <= bound:
        if is_prime(candidate):
            primes.append(candidate)
            product *= candidate
        candidate -= 2

    def reduce(batches):
        for batch in batches:
            found = []
            for p in batch.column(0).to_pylist():
                found.append(polynomial_mod(np.array([[x % p for x in row] for row in matrix], np.int64), p))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["p", "c"])

    rows = spark.createDataFrame([(p,) for p in primes], "p bigint").repartition(min(len(primes), 64))
    residues = {r.p: r.c for r in rows.mapInArrow(reduce, "p bigint, c array<bigint>").collect()}
    # Chinese remainders, prime by prime.
    sizes, modulus = [0] * (dim + 1), 1
    for p in primes:
        inverse = pow(modulus, -1, p)
        for k in range(dim + 1):
            residue = residues[p][k] if k % 2 == 0 else -residues[p][k]
            sizes[k] += modulus * ((residue - sizes[k]) * inverse % p)
        modulus *= p
    return [c if k % 2 == 0 else -c for k, c in enumerate(sizes)]


class Roots:
    """The roots of a polynomial all of whose roots are real and not negative, times 2^bits."""

    def __init__(self, coefficients: list[int], bits: int):
        self.c = [c << bits * k for k, c in enumerate(coefficients)]
        self.top = -self.c[1]

    def beyond(self, m: int) -> int:
        """Roots above m, with their multiplicity: the sign changes of the polynomial shifted by m."""
        c = list(self.c)
        for k in range(len(c) - 1, 0, -1):
            for i in range(1, k + 1):
                c[i] += m * c[i - 1]
        signs = [x > 0 for x in c if x]
        return sum(a != b for a, b in zip(signs, signs[1:], strict=False))

    def sign(self, m: int) -> int:
        value = 0
        for c in self.c:
            value = value * m + c
        return (value > 0) - (value < 0)

    def largest(self, k: int) -> int:
        """m with the k-th largest root (from 1) in (m, m + 1]; -1 for a root of 0."""
        low, high = -1, self.top
        above, under = len(self.c) - 1, 0
        while high - low > 1 and above - under > 1:
            middle = (low + high) // 2
            n = self.beyond(middle)
            if n >= k:
                low, above = middle, n
            else:
                high, under = middle, n
        # A lone root: the polynomial has one sign above it, the other below.
        right = 1 if k % 2 else -1
        while high - low > 1:
            middle = (low + high) // 2
            if self.sign(middle) in (right, 0):
                high = middle
            else:
                low = middle
        return low


def largest_roots(coefficients: list[int], most: int) -> tuple[list[int], int]:
    """The largest positive roots times 2^bits, falling, repeated by multiplicity, and bits."""
    bits = BITS
    while True:
        roots = Roots(coefficients, bits)
        positive = roots.beyond(0)
        found = [roots.largest(k) for k in range(1, min(most, positive) + 1)]
        if all(m.bit_length() >= SIGNIFICANT for m in found):
            return found, bits
        bits *= 2


class Shifted:
    """matrix - root / 2^bits, as a triangular form in fixed point."""

    def __init__(self, matrix: list[list[int]], root: int, bits: int):
        self.bits = bits + GUARD
        a = np.array(matrix, object) << self.bits
        for i in range(len(a)):
            # The middle of the interval that holds the root.
            a[i, i] -= (2 * root + 1) << (GUARD - 1)
        self.swaps, self.factors = [], []
        for k in range(len(a)):
            pivot = k + max(range(len(a) - k), key=lambda i: abs(a[k + i, k]))
            self.swaps.append(pivot)
            if pivot != k:
                a[[k, pivot]] = a[[pivot, k]]
            a[k, k] = a[k, k] or 1
            factor = (a[k + 1 :, k] << self.bits) // a[k, k]
            self.factors.append(factor)
            if len(factor):
                a[k + 1 :, k:] -= (factor[:, None] * a[k, k:][None, :]) >> self.bits
        self.upper = a

    def solved(self, right: np.ndarray) -> np.ndarray:
        y = right.copy()
        for k, (pivot, factor) in enumerate(zip(self.swaps, self.factors, strict=True)):
            y[k], y[pivot] = y[pivot], y[k]
            y[k + 1 :] -= (factor * y[k]) >> self.bits
        for k in range(len(y) - 1, -1, -1):
            rest = (self.upper[k, k + 1 :] @ y[k + 1 :]) >> self.bits if k + 1 < len(y) else 0
            y[k] = ((y[k] - rest) << self.bits) // self.upper[k, k]
        return y

    def unit(self, y: np.ndarray) -> np.ndarray:
        return (y << self.bits) // isqrt(int(y @ y))


def components(matrix: list[list[int]], roots: list[int], bits: int) -> np.ndarray:
    """Unit eigenvectors of the roots, one a row, in double precision."""
    dim, out, found, form = len(matrix), [], [], None
    for k, root in enumerate(roots):
        if form is None or root != roots[k - 1]:
            form, found = Shifted(matrix, root, bits), []
        v = np.array([((i + 1) * (k + 1) * 2654435761 >> 5) % 1021 - 510 for i in range(dim)], object) << form.bits
        for _ in range(3):
            v = form.unit(form.solved(v))
            # Components of the same root are orthogonal to each other.
            for u in found:
                v = form.unit(v - ((u * (int(u @ v) >> form.bits)) >> form.bits))
        found.append(v)
        out.append([float(Fraction(int(x), 1 << form.bits)) for x in v])
    return np.array(out).reshape(len(out), dim)


class Whitening:
    """What projects a row: n, the sums, the components and the roots' square roots."""

    def __init__(self, n: int, sums: list[int], axes: np.ndarray, roots: list[float], explained: list[float]):
        self.n, self.sums, self.axes, self.explained = n, sums, axes, explained
        self.scale = np.sqrt(np.array(roots))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        top = max(int(np.abs(x.astype(np.float64)).max(initial=0)) + 1, 1) * self.n + max((abs(s) for s in self.sums), default=0)
        kind = np.int64 if top < 1 << 62 else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)[None, :]

    def projected(self, centred: np.ndarray) -> np.ndarray:
        return centred.astype(np.float64) @ self.axes.T / self.scale

    @staticmethod
    def deviations(centred: np.ndarray) -> list[int | None]:
        """Sums of squares; null beyond 64 bits."""
        top = int(np.abs(centred).max(initial=0))
        small = top * top * max(1, centred.shape[1]) < 1 << 63
        own = centred if small else centred.astype(object)
        sums = (int(v) for v in (own * own).sum(axis=1))
        return [v if v < 1 << 63 else None for v in sums]


def learn(vectors: DataFrame, distinct: DataFrame, most: int) -> Whitening | None:
    """The whitening fitted on the distinct vectors; None if no component has a positive eigenvalue."""
    first = vectors.select(F.size("x").alias("dim")).first()
    if first is None:
        return None
    n, sums, matrix = scatter(distinct, first.dim)
    trace = sum(matrix[i][i] for i in range(first.dim))
    if not trace:
        return None
    roots, bits = largest_roots(characteristic_polynomial(vectors.sparkSession, matrix), most)
    exact = [Fraction(2 * m + 1, 1 << (bits + 1)) for m in roots]
    return Whitening(n, sums, components(matrix, roots, bits), [float(r) for r in exact], [float(r / trace) for r in exact])


def identity_error(distinct: DataFrame, fitted: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened distinct vectors less the identity.

    Every task centres its own rows before it multiplies; the tasks' parts are
    then moved to the common mean.
    """
    dim, k = fitted.axes.shape[1], len(fitted.scale)

    def part(batches):
        rows = [fitted.projected(fitted.centred(unpacked(b.column(0).to_pylist(), dim))) for b in batches]
        w = np.concatenate([np.zeros((0, k)), *rows])
        if len(w):
            mean = w.mean(axis=0)
            around = (w - mean).T @ (w - mean)
            yield pa.RecordBatch.from_pydict(
                {"n": pa.array([float(len(w))]), "mean": pa.array([mean.tolist()]), "around": pa.array([around.ravel().tolist()])}
            )

    parts = kept(distinct.mapInArrow(part, "n double, mean array<double>, around array<double>"), "moments")
    means = parts.agg(*[(F.sum(F.col("n") * F.col("mean")[i]) / F.sum("n")).alias(f"m{i}") for i in range(k)]).first()
    off = [F.col("mean")[i] - F.lit(means[i]) for i in range(k)]
    cells = [(F.sum(F.col("around")[i * k + j] + F.col("n") * off[i] * off[j]) / F.sum("n")).alias(f"c{i}_{j}") for i in range(k) for j in range(k)]
    covariance = np.array(parts.agg(*cells).first()).reshape(k, k)
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(rows: DataFrame, most: int = 4, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The rows of RESULT: one for each usable row of `rows` and component, up to `most` of them.

    Null vectors, empty ones and those with null or non-finite entries are left
    out, and so are those of another length than the commonest (the longest of
    equally common ones). Repeated vectors count once in the fit and keep
    their rows; null keys stay null. Only components of a positive eigenvalue are
    given, so a table of one distinct vector, like an empty one, gives no rows.
    Entries beyond 64 bits are the last number of 64 bits; a deviation beyond
    them is null. Other columns are not read.
    """
    vectors = whole_vectors(rows, key, vector)
    distinct = kept(fit_list(vectors), "fit-list")
    fitted = learn(vectors, distinct, most)
    if fitted is None:
        return rows.sparkSession.createDataFrame([], RESULT)
    error = identity_error(distinct, fitted)
    k = len(fitted.scale)

    def project(batches):
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            centred = fitted.centred(matrix_of(batch.column(1)))
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(n), k)))
            deviation = pa.array(fitted.deviations(centred), pa.int64()).take(pa.array(np.repeat(np.arange(n), k)))
            yield pa.RecordBatch.from_arrays(
                [
                    keys,
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * k, fitted.n)),
                    deviation,
                    pa.array(fitted.projected(centred).ravel()),
                    pa.array(np.tile(np.array(fitted.explained), n)),
                    pa.array(np.full(n * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.mapInArrow(project, RESULT)
