"""Exact nearest neighbours among distinct points by a balanced tree of balls.

The tree grows in rounds. In each round every node with too many points is split
into up to FANOUT children: a bounded sample of the node's points, in one task,
gives halving cuts across the line between two far points, and chunks of
the node's points are routed by them. Leaves have a bounded size, and every node
is a ball around the mean of its points.

Each point's own leaf gives a first bound on its k-th neighbour's distance. Pairs
of (leaf, node) then walk down the tree together and go where the balls are
farther apart than the leaf's bound. The leaves that stay are visited best first:
a few of the nearest, then WIDEN times as many, and so on; each round tightens the
bounds, and a point visits only leaves whose ball reaches into its own bound.
Points and leaves meet in groups of bounded size, as one matrix product.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procsight.session import Scratch, stored

ROWS_PER_LEAF = 2048
# Children of a node at most (a power of two), and rows that its cuts are found from.
FANOUT, SAMPLE = 64, 1024
# Points routed, or asking one leaf, at a time.
ROWS_PER_CHUNK = 8192
# Leaves visited in the first round after the own one, and by how much the number grows.
WIDEN = 4
# Rounds after which nodes that cuts do not halve are split by hash, and the most rounds that node numbers allow.
PATIENCE, DEEPEST = 6, 10
# Relative allowance for rounding in distances.
SLACK = 1e-9


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def cuts_of(x: np.ndarray, children: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions and cuts of a tree of halvings in heap order; where points cannot be told apart all go left."""
    directions, cuts = np.zeros((children - 1, x.shape[1])), np.full(children - 1, np.inf)
    waiting = [(0, x)]
    while waiting:
        at, own = waiting.pop()
        if at >= children - 1 or len(own) < 2:
            continue
        one = own[((own - own.mean(axis=0)) ** 2).sum(axis=1).argmax()]
        other = own[((own - one) ** 2).sum(axis=1).argmax()]
        place = own @ (other - one)
        values = np.unique(place)
        if len(values) < 2:
            continue
        middle = min(np.searchsorted(values, np.median(place), side="right"), len(values) - 1)
        cut = (values[middle - 1] + values[middle]) / 2
        directions[at], cuts[at] = other - one, cut
        waiting += [(2 * at + 1, own[place <= cut]), (2 * at + 2, own[place > cut])]
    return directions, cuts


def child_of(x: np.ndarray, directions: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The child (from 0) that each point belongs to."""
    at = np.zeros(len(x), np.int64)
    for _ in range(int(np.log2(len(cuts) + 1))):
        at = 2 * at + 1 + ((x * directions[at]).sum(axis=1) > cuts[at])
    return at - len(cuts)


def _distance(a, b):
    square = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda total, x: total + x)
    return F.sqrt(square)


def _parent(node):
    # Children of node p are p * FANOUT + 1 and on; FANOUT is a power of two, so no division rounds.
    return F.shiftright(node - 1, FANOUT.bit_length() - 1)


def _split(sample: pa.Table) -> pa.Table:
    children = sample.column("children")[0].as_py()
    directions, cuts = cuts_of(_matrix(sample.column("point")), children)
    return pa.table(
        {
            "node": sample.column("node").slice(0, 1),
            "directions": pa.array([directions.ravel().tolist()], pa.list_(pa.float64())),
            "cuts": pa.array([cuts.tolist()], pa.list_(pa.float64())),
        }
    )


def _route(points: pa.Table, splits: pa.Table) -> pa.Table:
    if not points.num_rows:
        return points.select(["id", "point", "node"])
    x = _matrix(points.column("point"))
    node = points.column("node").to_numpy()
    if splits.num_rows:
        cuts = np.array(splits.column("cuts")[0].as_py())
        directions = np.array(splits.column("directions")[0].as_py()).reshape(len(cuts), -1)
        node = node * FANOUT + 1 + child_of(x, directions, cuts)
    return pa.table({"id": points.column("id"), "point": points.column("point"), "node": pa.array(node)})


class BallTree:
    """A tree over points(id, point array<double>): distinct points with ids that are not null.

    placed: id, point, node (the point's leaf); balls: node, parent, center,
    radius, n, leaf (is it one?). Both are stored tables of `scratch`.
    """

    def __init__(self, points: DataFrame, scratch: Scratch, rows_per_leaf: int = ROWS_PER_LEAF):
        self.scratch, self.rows_per_leaf = scratch, rows_per_leaf
        self.kind = dict(points.dtypes)["id"]
        self.placed = scratch.stored(points.select("id", "point", F.lit(0).cast("bigint").alias("node")))
        for depth in range(DEEPEST):
            if not self._deepen(depth):
                break
        self.balls = scratch.stored(self._balls())

    def _deepen(self, depth: int) -> bool:
        """Split every node that has too many points; False if none has."""
        sizes = self.placed.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > self.rows_per_leaf)
        parts = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n") / self.rows_per_leaf)))
        open_nodes = self.scratch.stored(
            sizes.select(
                "node",
                "n",
                F.least(F.lit(FANOUT), parts).cast("int").alias("children"),
                F.ceil(F.col("n") / ROWS_PER_CHUNK).cast("int").alias("chunks"),
            )
        )
        if open_nodes.isEmpty():
            return False
        rows = self.placed.join(open_nodes, "node")
        closed = self.placed.join(open_nodes.select("node"), "node", "left_anti").select("id", "point", "node")
        if depth >= PATIENCE:
            child = F.pmod(F.xxhash64("id", F.lit(depth)), F.col("children"))
            routed = rows.select("id", "point", (F.col("node") * FANOUT + 1 + child).alias("node"))
        else:
            drawn = F.pmod(F.xxhash64("id", F.lit(depth)), F.lit(1 << 30)) < F.lit(float(SAMPLE << 30)) / F.col("n")
            splits = rows.filter(drawn).select("node", "point", "children").groupBy("node").applyInArrow(
                _split, "node bigint, directions array<double>, cuts array<double>"
            )
            splits = self.scratch.stored(splits)
            chunk = F.pmod(F.xxhash64("id", F.lit(-1)), F.col("chunks")).cast("int")
            left = rows.select("id", "point", "node", chunk.alias("chunk"))
            right = splits.join(open_nodes.select("node", "chunks"), "node").select(
                F.col("node").alias("of"),
                F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("in"),
                "directions",
                "cuts",
            )
            routed = (
                left.groupBy("node", "chunk")
                .cogroup(right.groupBy("of", "in"))
                .applyInArrow(_route, f"id {self.kind}, point array<double>, node bigint")
            )
        self.placed = self.scratch.stored(routed.unionByName(closed))
        return True

    def ancestors(self):
        """A leaf and all nodes above it."""
        steps, node = [], F.col("node")
        for _ in range(DEEPEST + 1):
            steps.append(node)
            node = F.when(node > 0, _parent(node))
        return F.filter(F.array(*steps), lambda x: x.isNotNull())

    def _balls(self) -> DataFrame:
        dim = len(self.placed.select("point").first()["point"])
        mean = [F.avg(F.col("point")[i]) for i in range(dim)]
        centers = self.placed.groupBy("node").agg(F.count("*").alias("n"), F.array(*mean).alias("center"))
        leaves = self.scratch.stored(
            self.placed.join(centers, "node").groupBy("node").agg(
                F.first("n").alias("n"), F.first("center").alias("center"), F.max(_distance("point", "center")).alias("radius")
            )
        )
        above = leaves.select(F.explode(F.slice(self.ancestors(), 2, DEEPEST)).alias("top"), "n", "center", "radius")
        mean = [F.sum(F.col("center")[i] * F.col("n")) / F.sum("n") for i in range(dim)]
        tops = above.groupBy("top").agg(F.sum("n").alias("whole"), F.array(*mean).alias("middle"))
        reach = _distance("center", "middle") + F.col("radius")
        inner = above.join(tops, "top").groupBy(F.col("top").alias("node")).agg(
            F.first("whole").alias("n"), F.first("middle").alias("center"), F.max(reach).alias("radius")
        )
        both = leaves.withColumn("leaf", F.lit(True)).unionByName(inner.withColumn("leaf", F.lit(False)))
        return both.withColumn("parent", F.when(F.col("node") > 0, _parent(F.col("node"))))


def closest(ids: np.ndarray, x: np.ndarray, other_ids: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in x, place in y, distance) of the k nearest other points, ties by id.

    The matrix product finds candidates up to its rounding; their distances are
    computed again from the differences.
    """
    middle = y.mean(axis=0)
    a, b = x - middle, y - middle
    size_a, size_b = (a * a).sum(axis=1), (b * b).sum(axis=1)
    square = size_a[:, None] + size_b[None, :] - 2 * (a @ b.T)
    # Ids as numbers in their order.
    own, others = np.split(np.unique(np.concatenate([ids, other_ids]), return_inverse=True)[1], [len(ids)])
    square[own[:, None] == others[None, :]] = np.inf
    limit = np.partition(square, k - 1, axis=1)[:, k - 1] if square.shape[1] > k else np.full(len(x), np.inf)
    room = 1e-12 * (size_a + size_b.max(initial=0)) * x.shape[1]
    row, column = np.nonzero((square <= (limit + room)[:, None]) & np.isfinite(square))
    distance = np.sqrt(((x[row] - y[column]) ** 2).sum(axis=1))
    order = np.lexsort((others[column], distance, row))
    row, column, distance = row[order], column[order], distance[order]
    begin = np.searchsorted(row, np.arange(len(x)))
    first = np.arange(len(row)) - begin[row] < k
    return row[first], column[first], distance[first]


def _visit(k: int, kind: pa.DataType):
    def visit(asking: pa.Table, leaf: pa.Table) -> pa.Table:
        out = []
        if asking.num_rows and leaf.num_rows:
            ids, x = asking.column("id").to_numpy(zero_copy_only=False), _matrix(asking.column("point"))
            other, y = leaf.column("other").to_numpy(zero_copy_only=False), _matrix(leaf.column("place"))
            for low in range(0, len(x), ROWS_PER_LEAF):
                row, column, distance = closest(ids[low : low + ROWS_PER_LEAF], x[low : low + ROWS_PER_LEAF], other, y, k)
                out.append((ids[low + row], other[column], distance))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else ([], [], [])
        return pa.table({"id": pa.array(columns[0], kind), "other": pa.array(columns[1], kind), "distance": pa.array(columns[2], pa.float64())})

    return visit


def nearest_points(points: DataFrame, k: int, rows_per_leaf: int = ROWS_PER_LEAF) -> tuple[DataFrame, float]:
    """(id, other, distance) of the k nearest other points of each point, ties by id; and the leaves visited per point.

    points(id, point): distinct points. Fewer than k others are all given.
    """
    with Scratch(points.sparkSession) as scratch:
        tree = BallTree(points, scratch, rows_per_leaf)
        search = _Search(tree, k)
        found = search.run()
        # The answer outlives the scratch tables.
        return stored(found), search.visited / max(1, search.n)


class _Search:
    def __init__(self, tree: BallTree, k: int):
        self.tree, self.k, self.scratch = tree, k, tree.scratch
        self.schema = f"id {tree.kind}, other {tree.kind}, distance double"
        self.visit = _visit(k, pa.string() if tree.kind == "string" else pa.int32() if tree.kind == "int" else pa.int64())
        self.n = self.visited = tree.placed.count()
        # Any two points of a ball are at most two radii apart: a bound while too few points are known.
        wide = tree.balls.filter(F.col("n") > k).select(F.col("node").alias("top"), (2 * F.col("radius")).alias("width"))
        chains = tree.balls.filter("leaf").select("node", F.explode(tree.ancestors()).alias("top"))
        self.reach = self.scratch.stored(
            chains.join(wide, "top", "left").groupBy("node").agg(F.coalesce(F.min("width"), F.lit(float("inf"))).alias("reach"))
        )

    def run(self) -> DataFrame:
        own = self.tree.placed
        hits = self.scratch.stored(
            own.groupBy("node")
            .cogroup(own.select(F.col("id").alias("other"), F.col("point").alias("place"), F.col("node").alias("of")).groupBy("of"))
            .applyInArrow(self.visit, self.schema)
        )
        rows = self.bounded(hits)
        left = self.pairs(rows)
        width = WIDEN
        while not left.isEmpty():
            order = Window.partitionBy("q").orderBy("gap", "t")
            ranked = self.scratch.stored(left.withColumn("turn", F.row_number().over(order)))
            hits = self.scratch.stored(self.best(hits.unionByName(self.visits(rows, ranked.filter(F.col("turn") <= width)))))
            rows = self.bounded(hits)
            limits = rows.groupBy(F.col("node").alias("q")).agg(F.max("bound").alias("limit"))
            rest = ranked.filter(F.col("turn") > width).drop("turn").join(limits, "q")
            left = self.scratch.stored(rest.filter(F.col("gap") <= F.col("limit") * (1 + SLACK)).drop("limit"))
            width *= WIDEN
        return hits

    def best(self, hits: DataFrame) -> DataFrame:
        order = Window.partitionBy("id").orderBy("distance", "other")
        return hits.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= self.k).drop("nth")

    def bounded(self, hits: DataFrame) -> DataFrame:
        """Points with the distance beyond which none of their neighbours can be."""
        known = hits.groupBy("id").agg(F.when(F.count("*") >= self.k, F.max("distance")).alias("known"))
        rows = self.tree.placed.join(known, "id", "left").join(self.reach, "node")
        return self.scratch.stored(
            rows.select("id", "point", "node", F.least(F.coalesce("known", F.lit(float("inf"))), "reach").alias("bound"))
        )

    def pairs(self, rows: DataFrame) -> DataFrame:
        """q, t, gap: leaves whose balls are near enough, found by walking down from (leaf, root)."""
        balls = self.tree.balls
        limits = rows.groupBy("node").agg(F.max("bound").alias("limit"))
        leaves = balls.filter("leaf").join(limits, "node").select(
            F.col("node").alias("q"), F.col("center").alias("q_center"), F.col("radius").alias("q_radius"), "limit"
        )
        front = leaves.withColumn("t", F.lit(0).cast("bigint"))
        children = balls.filter("parent is not null")
        found = None
        for _ in range(DEEPEST):
            near = front.join(children, front.t == children.parent).withColumn(
                "gap", F.greatest(F.lit(0.0), _distance("q_center", "center") - F.col("q_radius") - F.col("radius"))
            )
            near = near.filter((F.col("gap") <= F.col("limit") * (1 + SLACK)) & (F.col("q") != F.col("node")))
            near = self.scratch.stored(near.select("q", "q_center", "q_radius", "limit", F.col("node").alias("t"), "gap", "leaf"))
            ended = near.filter("leaf").select("q", "t", "gap")
            found = ended if found is None else found.unionByName(ended)
            front = near.filter("not leaf").drop("gap", "leaf")
            if front.isEmpty():
                break
        return self.scratch.stored(found)

    def visits(self, rows: DataFrame, pairs: DataFrame) -> DataFrame:
        """What the points of leaf q find in leaf t, for the pairs (q, t): only points into whose bound the ball reaches."""
        ball = self.tree.balls.filter("leaf").select(F.col("node").alias("t"), "center", "radius")
        asking = (
            rows.join(pairs.select("q", "t"), rows.node == F.col("q"))
            .join(ball, "t")
            .filter(_distance("point", "center") - F.col("radius") <= F.col("bound") * (1 + SLACK))
            .select("id", "point", "t")
        )
        asking = self.scratch.stored(asking)
        asked = asking.groupBy("t").agg(F.count("*").alias("n"))
        sized = self.scratch.stored(asked.select("t", "n", F.ceil(F.col("n") / ROWS_PER_CHUNK).cast("int").alias("parts")))
        self.visited += sized.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        left = asking.join(sized.drop("n"), "t").select(
            "id", "point", "t", F.pmod(F.xxhash64("id", F.lit(-2)), F.col("parts")).cast("int").alias("part")
        )
        right = self.tree.placed.join(sized, F.col("node") == F.col("t")).select(
            F.col("id").alias("other"),
            F.col("point").alias("place"),
            F.col("node").alias("of"),
            F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("in"),
        )
        return left.groupBy("t", "part").cogroup(right.groupBy("of", "in")).applyInArrow(self.visit, self.schema)
