"""Nearest vectors by inner product: a block matrix join over int8 tiles.

Query vectors and all vectors are dealt into blocks of bounded size, and each
pair of blocks is one cell of the product. In a cell the vectors are int8 codes
with a scale for each vector; the product of two tiles of codes gives every
inner product up to an error bound that follows from the lengths of the rounding
errors. A pair survives if its upper bound reaches the query's k-th best lower
bound so far; survivors are computed again from the original numbers in double
precision, and a heap for each query keeps the best. The heaps of all cells of a
query are merged at the end. The result is exact.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procsight.llm.tables import kept

#: Rows of a block at most, about, and least number of blocks, so that small tables too are shared out.
QUERY_BLOCK, ROW_BLOCK, LEAST_BLOCKS = 4096, 4096, 32
#: Rows of a tile.
TILE = 1024

HITS = "owner bigint, query_id bigint, vec_id bigint, score double"


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """uid, key, v, dim of every row with a key; null, empty, zero and non-finite vectors are left out."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.where(F.col(key).isNotNull() & v.isNotNull()).where(finite & F.exists(v, lambda x: x != 0))
    return rows.select(F.monotonically_increasing_id().alias("uid"), F.col(key).cast("bigint").alias("key"), v.alias("v"), F.size(v).alias("dim"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


class Codes:
    """int8 codes of some vectors, with what is needed to bound the error of a product."""

    def __init__(self, v: np.ndarray):
        self.scale = np.abs(v).max(axis=1) / 127
        self.codes = np.rint(v / self.scale[:, None]).astype(np.int8)
        near = self.codes * self.scale[:, None]
        self.error = np.linalg.norm(v - near, axis=1)
        self.length = np.linalg.norm(near, axis=1)

    def bounds(self, other: "Codes") -> tuple[np.ndarray, np.ndarray]:
        """Every product with `other`, and how far from the true one it can be."""
        # Sums of products of int8 codes are whole numbers; single precision holds them exactly below 2^24.
        kind = np.float32 if self.codes.shape[1] <= 1000 else np.float64
        product = (self.codes.astype(kind) @ other.codes.astype(kind).T).astype(np.float64)
        product *= self.scale[:, None] * other.scale[None, :]
        slack = self.length[:, None] * other.error[None, :] + self.error[:, None] * (other.length + other.error)[None, :]
        slack += 1e-9 * (self.length[:, None] * other.length[None, :]) + 1e-300
        return product, slack


def _cell(k: int):
    def best(queries: pa.Table, rows: pa.Table) -> pa.Table:
        ids, scores, owners, names = [], [], [], []
        if queries.num_rows and rows.num_rows:
            dim = queries.column("dim")[0].as_py()
            qid, rid = queries.column("key").to_numpy(), rows.column("row").to_numpy()
            quid, ruid = queries.column("uid").to_numpy(), rows.column("uid2").to_numpy()
            q, r = _matrix(queries.column("v"), dim), _matrix(rows.column("w"), dim)
            heaps: list[list[tuple[float, int]]] = [[] for _ in range(len(q))]
            coded = Codes(q)
            floor = np.full(len(q), -np.inf)
            for at in range(0, len(r), TILE):
                tile, tile_ids = r[at : at + TILE], rid[at : at + TILE]
                product, slack = coded.bounds(Codes(tile))
                own = quid[:, None] == ruid[None, at : at + TILE]
                low = np.where(own, -np.inf, product - slack)
                if low.shape[1] > k:
                    floor = np.maximum(floor, np.partition(low, -k, axis=1)[:, -k])
                alive = (product + slack >= floor[:, None]) & ~own
                for i in np.flatnonzero(alive.any(axis=1)):
                    j = np.flatnonzero(alive[i])
                    # Sums in the order of the components, as a plain loop would add them.
                    exact = np.cumsum(tile[j] * q[i], axis=1)[:, -1]
                    heaps[i] = heapq.nlargest(k, [*heaps[i], *zip(exact.tolist(), (-tile_ids[j]).tolist(), strict=True)])
                    if len(heaps[i]) == k:
                        floor[i] = max(floor[i], heaps[i][-1][0])
            for owner, name, heap in zip(quid.tolist(), qid.tolist(), heaps, strict=True):
                owners += [owner] * len(heap)
                names += [name] * len(heap)
                scores += [s for s, _ in heap]
                ids += [-x for _, x in heap]
        return pa.table(
            {
                "owner": pa.array(owners, pa.int64()),
                "query_id": pa.array(names, pa.int64()),
                "vec_id": pa.array(ids, pa.int64()),
                "score": pa.array(scores, pa.float64()),
            }
        )

    return best


def _merge(k: int):
    """The k best of each query among sorted or unsorted hits of some queries."""

    def merge(hits: pa.Table) -> pa.Table:
        heaps: dict[tuple[int, int], list] = {}
        for o, q, v, s in zip(*(hits.column(c).to_pylist() for c in ("owner", "query_id", "vec_id", "score")), strict=True):
            heap = heaps.setdefault((o, q), [])
            if len(heap) < k:
                heapq.heappush(heap, (s, -v))
            elif (s, -v) > heap[0]:
                heapq.heapreplace(heap, (s, -v))
        rows = [(q, rank, -v, s) for (_, q), heap in heaps.items() for rank, (s, v) in enumerate(sorted(heap, reverse=True), 1)]
        q, rank, v, s = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.table(
            {
                "query_id": pa.array(q, pa.int64()),
                "rank": pa.array(rank, pa.int32()),
                "vec_id": pa.array(v, pa.int64()),
                "score": pa.array(s, pa.float64()),
            }
        )

    return merge


def nearest(rows: DataFrame, every: int = 20, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product for each row whose key `every` divides.

    A row is no candidate of its own; ties go to the smaller key; fewer than k
    candidates are all given. Null keys, null, empty and zero vectors and those
    with null or non-finite components take no part. Vectors of different
    length are not compared. Rows that repeat a key are candidates each, of each
    other too, and queries each. Other columns are not read; an empty table gives
    no rows.
    """
    vectors = kept(usable(rows, key, vector), "vectors")
    n = vectors.count()
    queries = vectors.where(F.col("key") % every == 0)
    row_blocks = max(-(-n // ROW_BLOCK), LEAST_BLOCKS)
    query_blocks = max(-(-queries.count() // QUERY_BLOCK), 1)

    def blocks(df: DataFrame, own: str, count: int, other: str, others: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("uid"), F.lit(count))).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(others - 1).cast("bigint")))
        )

    left = blocks(queries, "qb", query_blocks, "rb", row_blocks)
    # The two sides of a cogroup need names of their own.
    right = blocks(vectors, "rb", row_blocks, "qb", query_blocks).select(
        F.col("uid").alias("uid2"), F.col("key").alias("row"), F.col("v").alias("w"), F.col("dim").alias("dim2"), F.col("qb").alias("qb2"), F.col("rb").alias("rb2")
    )
    hits = left.groupBy("dim", "qb", "rb").cogroup(right.groupBy("dim2", "qb2", "rb2")).applyInArrow(_cell(k), HITS)
    # Whole queries in groups of some hundred, so that a group is small however many blocks there are.
    group = F.pmod(F.xxhash64(F.lit("merge"), "owner"), F.lit(max(1, query_blocks * 64)))
    return hits.groupBy(group.alias("part")).applyInArrow(
        _merge(k), "query_id bigint, rank int, vec_id bigint, score double"
    )
