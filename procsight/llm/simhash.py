"""Near duplicates by SimHash: a self-join of the binary trie of all fingerprints.

The trie's nodes are kept level by level, four bits apart, each with the set of
its children and the number of fingerprints below it. The join walks down all
pairs of nodes at once, from the pair (root, root): a pair's children are those
pairs of children whose bits, added to the bits in which the pair already
differs, stay within the budget. Pairs beyond it go at once, and so does the
pair of a node with itself when one fingerprint is left below. At the last level
the pairs are the links. No node has more than 16 children, so no row of the
walk grows into more than 176, whatever the groups of copies.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procsight.llm.components import components
from procsight.llm.tables import drop, kept, new_path, utf8, written
from procsight.llm.words import NOT_SPACE, raw, slices, spans

SHINGLE, SEED, BITS, STEP = 3, 42, 64, 4
#: Shingles hashed at a time.
BLOCK = 1 << 14
#: Pairs of nodes (of some 30 bytes) that are broadcast to the trie's nodes; more are joined by shuffles.
FEW = 50_000

_LOW = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes, begin: np.ndarray, end: np.ndarray) -> int:
    """The SimHash of one text with these words, as a signed 64-bit number."""
    n = max(1, len(begin) - SHINGLE + 1) if len(begin) else 0
    if not n:
        return 0
    votes = np.zeros(BITS, np.int64)
    hash_of = xxhash.xxh64_intdigest
    for k in range(0, n, BLOCK):
        stop = min(n, k + BLOCK)
        last = min(stop + SHINGLE - 1, len(begin))
        words = [text[a:b] for a, b in zip(begin[k:last].tolist(), end[k:last].tolist(), strict=True)]
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(begin) >= SHINGLE else [b" ".join(words)]
        h = np.fromiter((hash_of(s, SEED) for s in shingles), "<u8", stop - k)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp for each row: whole texts; null, empty and wordless texts have fingerprint 0."""

    def marks(batches):
        for batch in batches:
            for some in slices(batch, 1):
                data, at = raw(some.column(1))
                begin, end, first = spans(data, at, NOT_SPACE)
                out = []
                for i in range(len(some)):
                    low = int(at[i])
                    own = data[low : int(at[i + 1])].tobytes().translate(_LOW)
                    out.append(fingerprint(own, begin[first[i] : first[i + 1]] - low, end[first[i] : first[i + 1]] - low))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(out, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), utf8(text).alias("text")).mapInArrow(marks, "doc_id bigint, fp bigint")


def _prefix(level: int):
    return F.shiftrightunsigned("fp", BITS - level) if level else F.lit(0).cast("bigint")


def trie(distinct: DataFrame) -> DataFrame:
    """level, node, children (bit set of the next four bits), below (fingerprints)."""
    levels = [
        F.struct(
            F.lit(level).alias("level"),
            _prefix(level).alias("node"),
            F.expr(f"shiftleft(1, cast(shiftrightunsigned(fp, {BITS - level - STEP}) & 15 as int))").alias("child"),
        )
        for level in range(0, BITS, STEP)
    ]
    each = distinct.select(F.explode(F.array(*levels)).alias("x")).select("x.*")
    return each.groupBy("level", "node").agg(F.bit_or("child").alias("children"), F.count("*").alias("below"))


#: (children's difference, its bits) within any budget, by its bits.
_DELTAS = {bits: [x for x in range(16) if x.bit_count() == bits] for bits in range(STEP + 1)}


def _descend(budget: int, last: bool):
    """From (a, b, d, ca, cb, single) rows to the pairs of children within the budget."""

    def walk(batches):
        for batch in batches:
            a, b, d, ca, cb, single = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            same = a == b
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for bits, deltas in _DELTAS.items():
                fits = d + bits <= budget
                if not fits.any():
                    continue
                for x in deltas:
                    # At a pair of equal nodes each pair of children counts once; a lone fingerprint has no partner.
                    for i in range(16):
                        j = i ^ x
                        ok = fits & (ca >> i & 1).astype(bool) & (cb >> j & 1).astype(bool)
                        ok &= ~same | (i < j) | ((i == j) & ~single if not last else False)
                        if ok.any():
                            out.append((a[ok] << STEP | i, b[ok] << STEP | j, d[ok] + bits))
            if out:
                left, right, differ = (np.concatenate(x) for x in zip(*out, strict=True))
                for k in range(0, len(left), 50_000):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(left[k : k + 50_000]), pa.array(right[k : k + 50_000]), pa.array(differ[k : k + 50_000], pa.int32())],
                        ["a", "b", "d"],
                    )

    return walk


def links(distinct: DataFrame, budget: int = 2) -> DataFrame:
    """a, b, d: all pairs of different fingerprints of distinct(fp) that differ in d <= budget bits, each once."""
    spark = distinct.sparkSession
    nodes_path = new_path(spark, "trie")
    nodes = written(trie(distinct).sortWithinPartitions("level", "node"), nodes_path)
    front = spark.createDataFrame([(0, 0, 0)], "a bigint, b bigint, d int")
    path, pairs = None, 1
    for level in range(0, BITS, STEP):
        here = nodes.where(F.col("level") == level)
        left = here.select(F.col("node").alias("a"), F.col("children").alias("ca"), (F.col("below") == 1).alias("single"))
        right = here.select(F.col("node").alias("b"), F.col("children").alias("cb"))
        # Each pair finds one node on either side, so the joins have as many rows as there are pairs.
        sized = F.broadcast if pairs <= FEW else lambda df: df
        both = sized(sized(front).join(left, "a")).join(right, "b").select("a", "b", "d", "ca", "cb", "single")
        old, path = path, new_path(spark, "front")
        front = written(both.mapInArrow(_descend(budget, level + STEP == BITS), "a bigint, b bigint, d int"), path)
        pairs = front.count()
        if old:
            drop(spark, old)
    drop(spark, nodes_path)
    return front


def near_duplicates(docs: DataFrame, budget: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of `docs`: doc_id, fingerprint (16 hex digits), component_id, n_copies, fp.

    component_id is the least doc_id among all rows whose fingerprints are
    connected by links: those that differ in at most `budget` bits. Texts are compared by fingerprint, so equal texts,
    repeated rows and all texts without words (fingerprint 0) fall together.
    Rows with a null key keep their row and never name a component that has
    another key. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    marks = kept(fingerprints(docs, key, text), "fingerprints")
    paths = [new_path(spark, name) for name in ("groups", "roots")]
    groups = written(marks.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies")), paths[0])
    found = links(groups.select("fp"), budget).select("a", "b")
    roots = written(components(found), paths[1])
    # Roots are fingerprints; the component is named by the least key in it.
    member = groups.join(roots, groups.fp == roots.node, "left").select(
        "fp", "least", "n_copies", F.coalesce("root", "fp").alias("root")
    )
    names = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = kept(member.join(names, "root").select("fp", "n_copies", "component_id"), "components")
    for old in paths:
        drop(spark, old)
    return marks.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_copies", "fp"
    )


def without_near_duplicates(docs: DataFrame, budget: int = 2) -> DataFrame:
    """`docs` with one row of each component: the one with the least doc_id; rows with a null doc_id all stay.

    Only the ids of rows that go, and of ids that come up repeatedly, are
    joined with the documents; Spark broadcasts them if they are few.
    """
    found = near_duplicates(docs, budget).where("doc_id is not null")
    per_id = found.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("n"))
    odd = kept(
        per_id.where("doc_id <> component_id or n > 1").select(F.col("doc_id").alias("__odd_id"), (F.col("doc_id") == F.col("component_id")).alias("stays")),
        "odd",
    )
    rest = docs.join(odd.select("__odd_id"), docs.doc_id == F.col("__odd_id"), "left_anti")
    again = docs.join(odd.where("stays").select("__odd_id"), docs.doc_id == F.col("__odd_id"), "left_semi").dropDuplicates(["doc_id"])
    return rest.union(again)
