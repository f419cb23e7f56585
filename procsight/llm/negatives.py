"""Hard negatives for contrastive training, by segment summary filtering.

Vectors become whole numbers, and each is stored with the mean and the deviation
(length of what is left of the mean) of its SEGMENTS segments. In a segment of
length l the inner product of two vectors is l times the product of the means,
plus or minus at most the product of the deviations, so the summaries bound
every score. Neighbouring segments are merged for a coarser summary: a pair is
bounded by one segment first, then by two, four and so on, and goes as soon as its
bounds rule it out; only pairs that outlast the finest segments are scored.

Anchors and rows are dealt into blocks of bounded size; a pair of blocks is one
cell, and cells emit only rows that can be among an anchor's best. Blocks are
visited in rounds, each GROWTH times as long as all before, and each round knows
the bounds that the earlier ones have found: an anchor collects a few rows for each
round instead of a few for each block. Positives are sought among the blocks of
the anchor's label only.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procsight.llm.tables import drop, new_path, written
from procsight.llm.whitening import EXACT, matrix_of, packed, unpacked

#: Segments of the finest summary at most.
SEGMENTS = 16
#: Anchors and rows of a block at most, about; least number of blocks of all rows; anchors and rows of a tile.
ANCHOR_BLOCK, ROW_BLOCK, LEAST_BLOCKS, TILE = 8192, 8192, 32, 1024
#: Blocks of the first round, and how much longer every further one is.
FIRST, GROWTH = 32, 8
#: Scale of entries.
SCALE = 256
#: Pairs that are scored at a time, and share of a tile's pairs under which they are taken one by one.
PAIRS, SPARSE = 1 << 16, 1 / 16
_LAST = (1 << 63) - 1

ROWS = "uid bigint, id bigint, label bigint, dim int, x binary, mean binary, dev binary"
HITS = "a bigint, p int, r bigint, id bigint, score bigint"


def edges(dim: int, segments: int = SEGMENTS) -> list[np.ndarray]:
    """Begins of the segments (with the end), from one segment of all entries to the finest; each level halves the one before."""
    levels = [np.array([0, dim])]
    while len(levels[-1]) - 1 < segments and np.diff(levels[-1]).max(initial=0) > 1:
        e = levels[-1]
        levels.append(np.unique(np.concatenate([e, (e[:-1] + e[1:] + 1) // 2])))
    return levels


def summaries(x: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each row's segments."""
    size = np.diff(edge)
    mean = np.add.reduceat(x.astype(np.float64), edge[:-1], axis=1) / size
    rest = x - np.repeat(mean, size, axis=1)
    return mean, np.sqrt(np.add.reduceat(rest * rest, edge[:-1], axis=1))


class Side:
    """Some vectors of one length with their summaries on every level."""

    def __init__(self, table: pa.Table, names: dict[str, str]):
        column = {k: table.column(v) for k, v in names.items()}
        self.dim = column["dim"][0].as_py()
        self.uid, self.id, self.label = (column[k].to_numpy() for k in ("uid", "id", "label"))
        self.x = unpacked(column["x"].to_pylist(), self.dim)
        self.top = int(max(self.x.max(), -int(self.x.min())))
        self.levels = edges(self.dim)
        finest = len(self.levels[-1]) - 1
        mean, dev = (np.frombuffer(b"".join(column[k].to_pylist()), np.float64).reshape(-1, finest) for k in ("mean", "dev"))
        self.mean, self.dev = [mean], [dev]
        for fine, coarse in zip(self.levels[:0:-1], self.levels[-2::-1], strict=True):
            self._merge(fine, coarse)
        self.mean.reverse()
        self.dev.reverse()

    def _merge(self, fine: np.ndarray, coarse: np.ndarray) -> None:
        """Summaries of longer segments from those of their parts."""
        mean, dev, size = self.mean[-1], self.dev[-1], np.diff(fine)
        first = np.searchsorted(fine, coarse[:-1])
        whole = np.add.reduceat(mean * size, first, axis=1) / np.diff(coarse)
        off = mean - np.repeat(whole, np.diff(np.append(first, len(size))), axis=1)
        self.mean.append(whole)
        self.dev.append(np.sqrt(np.add.reduceat(dev * dev + size * off * off, first, axis=1)))

    def part(self, at: slice) -> "Side":
        other = object.__new__(Side)
        other.dim, other.levels, other.top = self.dim, self.levels, self.top
        other.uid, other.id, other.label, other.x = self.uid[at], self.id[at], self.label[at], self.x[at]
        other.mean, other.dev = [m[at] for m in self.mean], [d[at] for d in self.dev]
        return other


def tiles(side: Side) -> list[slice]:
    return [slice(k, k + TILE) for k in range(0, len(side.id), TILE)]


def bounds(a: Side, r: Side, level: int, i: np.ndarray | None = None, j: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of all pairs, or of the pairs (i, j), by the summaries of one level."""
    size = np.diff(a.levels[level])
    mean, dev = a.mean[level] * size, a.dev[level]
    if i is None:
        middle, slack = mean @ r.mean[level].T, dev @ r.dev[level].T
    else:
        middle, slack = (mean[i] * r.mean[level][j]).sum(axis=1), (dev[i] * r.dev[level][j]).sum(axis=1)
    # Far more than sums in double precision can be off.
    slack = slack * (1 + 1e-9) + 1e-9 * np.abs(middle) + 1e-9 * float(a.top) * float(r.top) * a.dim + 1e-6
    return middle - slack, middle + slack


def scores(a: Side, r: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact scores of the pairs (i, j); beyond 64 bits the last number of 64 bits."""
    out = np.empty(len(i), np.int64)
    largest = a.top * r.top * a.dim
    if largest < EXACT and len(i) > len(a.x) * len(r.x) / 4:
        return (a.x.astype(np.float64) @ r.x.astype(np.float64).T)[i, j].astype(np.int64)
    for k in range(0, len(i), PAIRS):
        left, right = a.x[i[k : k + PAIRS]], r.x[j[k : k + PAIRS]]
        if largest < 1 << 62:
            out[k : k + PAIRS] = (left * right).sum(axis=1)
        else:
            whole = (left.astype(object) * right.astype(object)).sum(axis=1)
            out[k : k + PAIRS] = [min(max(int(v), -_LAST - 1), _LAST) for v in whole]
    return out


def filtered(a: Side, r: Side, alive: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of `alive` (a matrix) that outlast the bounds of all levels; keep(i, low, high) says which do.

    i is None for whole matrices of bounds, or gives the anchors of single pairs.
    """
    i = j = None
    for level in range(len(a.levels)):
        if i is None and alive.sum() < SPARSE * alive.size:
            i, j = np.nonzero(alive)
        if i is None:
            alive &= keep(None, *bounds(a, r, level))
        elif len(i):
            stays = np.concatenate(
                [keep(i[k : k + PAIRS], *bounds(a, r, level, i[k : k + PAIRS], j[k : k + PAIRS])) for k in range(0, len(i), PAIRS)]
            )
            i, j = i[stays], j[stays]
    return np.nonzero(alive) if i is None else (i, j)


class Best:
    """The k best (score, then the smaller id, then the smaller uid) of each owner so far."""

    def __init__(self, owners: int, k: int, floor: np.ndarray):
        self.k, self.owners = k, owners
        self.rows = np.zeros((0, 4), np.int64)
        #: Scores below the floor can't be among an owner's best.
        self.floor = floor

    def add(self, owner: np.ndarray, r: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        fits = score >= self.floor[owner]
        new = np.stack([owner[fits], r[fits], ids[fits], score[fits]], axis=1)
        rows = np.concatenate([self.rows, new])
        order = np.lexsort((rows[:, 1], rows[:, 2], ~rows[:, 3], rows[:, 0]))
        rows = rows[order]
        begin = np.searchsorted(rows[:, 0], np.arange(self.owners + 1))
        nth = np.arange(len(rows)) - begin[rows[:, 0]]
        self.rows = rows[nth < self.k]
        last = rows[nth == self.k - 1]
        self.floor[last[:, 0]] = np.maximum(self.floor[last[:, 0]], last[:, 3])


def _hits(anchors: np.ndarray, p: np.ndarray, best: np.ndarray) -> pa.Table:
    return pa.table(
        {"a": anchors, "p": pa.array(p, pa.int32()), "r": best[:, 1], "id": best[:, 2], "score": best[:, 3]}
    )


_NONE = _hits(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros((0, 4), np.int64))
_SIDES = [x.split()[0] for x in ROWS.split(", ")]
_LEFT, _RIGHT = {k: k for k in _SIDES}, {k: f"r_{k}" for k in _SIDES}


def _positive_cell(k: int):
    def cell(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return _NONE
        all_anchors, all_rows = Side(anchors, _LEFT), Side(rows, _RIGHT)
        floor = np.array(anchors.column("floor").to_numpy(), np.int64)
        found = []
        for some in tiles(all_anchors):
            a = all_anchors.part(some)
            found.append(tile_hits(a, all_rows, floor[some]))
        return pa.concat_tables(found)

    def tile_hits(a: Side, all_rows: Side, floor: np.ndarray) -> pa.Table:
        best = Best(len(a.id), k, floor)
        for at in tiles(all_rows):
            r = all_rows.part(at)

            def keep(i, low, high):
                if i is None:
                    if low.shape[1] > k:
                        # The k-th best lower bound is a bound for all. Rows of the anchor's own id don't count.
                        counted = np.where(a.id[:, None] == r.id[None, :], -np.inf, low)
                        least = np.ceil(np.partition(counted, -k, axis=1)[:, -k])
                        sure = np.isfinite(least) & (np.abs(least) < EXACT)
                        best.floor[sure] = np.maximum(best.floor[sure], least[sure].astype(np.int64))
                    return high >= best.floor[:, None]
                return high >= best.floor[i]

            i, j = filtered(a, r, a.id[:, None] != r.id[None, :], keep)
            best.add(i, r.uid[j], r.id[j], scores(a, r, i, j))
        return _hits(a.uid[best.rows[:, 0]], np.zeros(len(best.rows), np.int32), best.rows)

    return cell


def _negative_cell(k: int, positives: int):
    def cell(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return _NONE
        all_anchors, all_rows = Side(anchors, _LEFT), Side(rows, _RIGHT)
        n = len(all_anchors.id)
        low_end = np.full((positives, n), _LAST)
        high_end = np.full((positives, n), -_LAST - 1)
        for i, windows in enumerate(anchors.column("windows").to_pylist()):
            for p, window in enumerate(windows):
                # What earlier rounds have found is a bound; equal scores may still win by a smaller id.
                low_end[p, i], high_end[p, i] = max(window["low"], window["floor"]), window["high"]
        return pa.concat_tables([tile_hits(all_anchors.part(some), all_rows, low_end[:, some], high_end[:, some]) for some in tiles(all_anchors)])

    def tile_hits(a: Side, all_rows: Side, low_end: np.ndarray, high_end: np.ndarray) -> pa.Table:
        best = [Best(len(a.id), k, low_end[p]) for p in range(positives)]
        for at in tiles(all_rows):
            r = all_rows.part(at)

            def keep(i, low, high):
                out = np.zeros(high.shape, bool)
                for p in range(positives):
                    floor, top = best[p].floor, high_end[p]
                    out |= (high >= (floor[:, None] if i is None else floor[i])) & (low <= (top[:, None] if i is None else top[i]))
                return out

            alive = (a.id[:, None] != r.id[None, :]) & (a.label[:, None] != r.label[None, :])
            i, j = filtered(a, r, alive, keep)
            score = scores(a, r, i, j)
            for p in range(positives):
                inside = score <= high_end[p, i]
                best[p].add(i[inside], r.uid[j[inside]], r.id[j[inside]], score[inside])
        return pa.concat_tables([_hits(a.uid[b.rows[:, 0]], np.full(len(b.rows), p, np.int32), b.rows) for p, b in enumerate(best)])

    return cell


def prepared(rows: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """ROWS: whole entries and summaries of the rows that take part."""
    v = F.col(vector)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    usable = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(finite)
    x = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE))
    plain = usable.select(
        F.monotonically_increasing_id().alias("uid"), F.col(key).cast("bigint"), F.col(label).cast("bigint"), F.size(v).alias("dim"), x.alias("x")
    )

    def summarised(batches):
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for dim in np.unique(dims):
                own = batch.take(pa.array(np.flatnonzero(dims == dim)))
                m = matrix_of(own.column(4))
                mean, dev = summaries(m, edges(int(dim))[-1])
                binary = [pa.array(c, pa.binary()) for c in (packed(m), [b.tobytes() for b in mean], [b.tobytes() for b in dev])]
                yield pa.RecordBatch.from_arrays([own.column(i) for i in range(4)] + binary, _SIDES)

    return plain.mapInArrow(summarised, ROWS)


def _rounds(blocks: int):
    begin, end = 0, FIRST
    while begin < blocks:
        yield begin, min(end, blocks)
        begin, end = end, end * GROWTH


def _sequence(first, end):
    """The numbers first..end-1, none if there are none."""
    return F.explode(F.filter(F.sequence(first, F.greatest(first, end - 1)), lambda b: b < end))


def _block(count):
    return F.pmod(F.xxhash64(F.lit("block"), "uid"), count)


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("a", "p").orderBy(F.desc("score"), "id", "r")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(anchors: DataFrame, rows: DataFrame, blocks: int, on: list[str], bound, cell, k: int, name: str) -> tuple[DataFrame, str | None]:
    """The k best hits of each (a, p), and where they are stored.

    anchors and rows have their blocks (ab, abs; rb, rbs: the own one, and how many there are in its group `on`);
    bound(anchors, hits so far): the anchors with what is known of their best.
    """
    spark = anchors.sparkSession
    right = rows.select(*[F.col(c).alias(f"r_{c}") for c in rows.columns])
    found, path = None, None
    for turn, (begin, end) in enumerate(_rounds(blocks)):
        left = bound(anchors, found).withColumn("rb", _sequence(F.lit(begin).cast("bigint"), F.least(F.lit(end).cast("bigint"), F.col("rbs"))))
        here = right.where(F.col("r_rb").between(begin, end - 1)).withColumn("r_ab", _sequence(F.lit(0).cast("bigint"), F.col("r_abs")))
        keys = [*on, "dim", "ab", "rb"]
        hits = left.groupBy(*keys).cogroup(here.groupBy(*[f"r_{c}" for c in keys])).applyInArrow(cell, HITS)
        if found is not None:
            hits = hits.union(found.select("a", "p", "r", "id", "score"))
        old, path = path, new_path(spark, f"{name}-{turn}")
        found = written(_best(hits, k), path)
        if old:
            drop(spark, old)
    return (spark.createDataFrame([], f"{HITS}, rank int") if found is None else found), path


def mine(
    rows: DataFrame,
    every: int = 50,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    key: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose key `every` divides. Scores are inner products of
    the whole numbers floor(256 * entry); higher ones come first, ties by the
    smaller key. An anchor's positives are its first `positives` other rows of its
    label; for each of them the first `negatives` rows of other labels are given whose score is
    between `low` and `high` hundredths of the positive's.

    Rows with a null key, label, vector or entry, with a non-finite entry or an
    empty vector take no part; vectors of different length are not compared. Rows of
    the anchor's own key are neither positives nor negatives. Repeated rows are
    candidates each, and repeated anchors have their rows each. Entries and scores
    beyond 64 bits are the last number of 64 bits. Anchors without positives and
    positives without negatives give no rows, and so does an empty table; other
    columns are not read.
    """
    spark = rows.sparkSession
    paths = [new_path(spark, name) for name in ("vectors", "sizes")]
    vectors = written(prepared(rows, key, label, vector), paths[0])
    anchor = F.col("id") % every == 0
    sizes = vectors.groupBy("label", "dim").agg(F.count("*").alias("n"), F.count_if(anchor).alias("anchors"))
    # Of each label: rows and anchors, in blocks.
    sizes = written(
        sizes.where("anchors > 0").select(
            "label", "dim", "n", "anchors", F.ceil(F.col("n") / ROW_BLOCK).alias("rbs"), F.ceil(F.col("anchors") / ANCHOR_BLOCK).alias("abs")
        ),
        paths[1],
    )
    most = sizes.agg(F.coalesce(F.max("rbs"), F.lit(0)), F.coalesce(F.sum("anchors"), F.lit(0))).first()
    of_label = vectors.join(sizes.drop("n", "anchors"), ["label", "dim"]).withColumn("rb", _block(F.col("rbs"))).withColumn("ab", _block(F.col("abs")))

    def first_bounds(anchors: DataFrame, found: DataFrame | None) -> DataFrame:
        if found is None:
            return anchors.withColumn("floor", F.lit(-_LAST - 1))
        known = found.groupBy(F.col("a").alias("uid")).agg(F.min("score").alias("floor"), F.count("*").alias("n"))
        # Fewer than all are no bound yet.
        known = known.where(F.col("n") == positives).drop("n")
        return anchors.join(known, "uid", "left").withColumn("floor", F.coalesce("floor", F.lit(-_LAST - 1)))

    chosen, chosen_path = _search(
        of_label.where(anchor).drop("rb"), of_label.drop("ab"), most[0], ["label"], first_bounds, _positive_cell(positives), positives, "positives"
    )
    # 100 times a score may need more than 64 bits, decimals hold it.
    score = F.col("score").cast("decimal(38,0)")
    window = F.struct(
        F.col("rank").alias("p"),
        F.ceil(score * low / 100).cast("bigint").alias("low"),
        F.floor(score * high / 100).cast("bigint").alias("high"),
    )
    windows = chosen.groupBy(F.col("a").alias("uid")).agg(F.sort_array(F.collect_list(window)).alias("all"))
    n = vectors.count()
    rbs = max(-(-n // ROW_BLOCK), min(n, LEAST_BLOCKS))
    abs_ = max(-(-most[1] // ANCHOR_BLOCK), 1)
    numbered = vectors.select("*", F.lit(rbs).cast("bigint").alias("rbs"), F.lit(abs_).cast("bigint").alias("abs"))
    numbered = numbered.withColumn("rb", _block(F.col("rbs"))).withColumn("ab", _block(F.col("abs")))
    seekers = numbered.where(anchor).drop("rb").join(windows, "uid")

    def later_bounds(anchors: DataFrame, found: DataFrame | None) -> DataFrame:
        if found is None:
            with_floor = F.transform("all", lambda w: w.withField("floor", F.lit(-_LAST - 1)))
            return anchors.withColumn("windows", with_floor).drop("all")
        known = found.groupBy("a", "p").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") == negatives)
        known = known.groupBy(F.col("a").alias("uid")).agg(F.map_from_entries(F.collect_list(F.struct("p", "floor"))).alias("floors"))
        floor = lambda w: F.coalesce(F.try_element_at("floors", w["p"] - 1), F.lit(-_LAST - 1))
        with_floor = F.transform("all", lambda w: w.withField("floor", floor(w)))
        return anchors.join(known, "uid", "left").withColumn("windows", with_floor).drop("all", "floors")

    found, _ = _search(seekers, numbered.drop("ab"), rbs, [], later_bounds, _negative_cell(negatives, positives), negatives, "negatives")
    names = vectors.where(anchor).select(F.col("uid").alias("a"), F.col("id").alias("anchor_id"))
    first = chosen.select("a", (F.col("rank") - 1).alias("p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(first, ["a", "p"]).join(names, "a").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
