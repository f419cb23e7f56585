"""Document fingerprints by spot signatures (SpotSigs), their likeness, and near duplicates by them.

Anchors are the corpus' common words: those that make up at least SHARE of all
words, so there are never more than 1 / SHARE of them. A signature is an anchor
and the chain of the next CHAIN content words (words that are not common), and a
text begins with an anchor of its own. Where no common word stands among GAP words,
as in languages that are rare in the corpus, content words of certain hashes are
anchors, which an insertion elsewhere doesn't move. A document's fingerprint names
the multiset of its signatures: the k-th use of a signature counts as a signature
of its own, so likeness is the Jaccard similarity of two sets.

Near duplicates are found as follows. Equal sets are one. Sets are partitioned by
length so that like sets lie in one partition or in neighbours; in a partition
only the least common signatures of a set are looked up, and a pair is compared
only if its lengths and the place of its first common signature leave room for the
similarity. In each list of sets that share a signature the sets are first compared
with one of them; pairs of sets that are already in one class are never built.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procsight.llm.components import components
from procsight.llm.order import Neighbours
from procsight.llm.tables import drop, new_path, utf8, written
from procsight.llm.words import hashes, raw, slices, spans

#: Share of all words that makes a word common; content words of a chain; words without a common one before others serve.
SHARE, CHAIN, GAP = 0.005, 2, 8
#: Of the content words in such a stretch, one in so many is an anchor.
ONE_IN = 4
#: Least likeness of near duplicates, and rounds of comparisons with one set of each list.
LEAST, ROUNDS = 0.8, 2
#: Counts of hashed signatures, by which rare ones are told from common ones.
BUCKETS = 1 << 16

_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xBF58476D1CE4E5B9)
_START = np.uint64(0x243F6A8885A308D3)
_AGAIN = np.uint64(0xD6E8FEB86659FD93)

RESULT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, n_signatures bigint"
)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _ODD
    return x ^ (x >> np.uint64(32))


def common_words(docs: DataFrame, text: str = "text", share: float = SHARE) -> np.ndarray:
    """Sorted hashes of the words that make up at least `share` of all words: at most 1 / share of them.

    Each task sends a row for each of its distinct words.
    """

    def count(batches):
        known: dict[int, int] = {}
        for batch in batches:
            for some in slices(batch, 0):
                data, at = raw(some.column(0))
                begin, end, _ = spans(data, at)
                for h, n in zip(*(x.tolist() for x in np.unique(hashes(data, begin, end), return_counts=True)), strict=True):
                    known[h] = known.get(h, 0) + n
        words = np.fromiter(known, np.uint64, len(known)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(list(known.values()), pa.int64())], ["word", "n"])

    spark = docs.sparkSession
    path = new_path(spark, "word-counts")
    parts = docs.select(utf8(text).alias("text")).mapInArrow(count, "word bigint, n bigint")
    counts = written(parts.groupBy("word").agg(F.sum("n").alias("n")), path)
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = [r.word for r in counts.where(F.col("n") >= max(1, share * total)).collect()]
    drop(spark, path)
    return np.sort(np.array(found, np.int64).view(np.uint64))


def signatures(column: pa.Array, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The signature sets of all texts of a binary column: sorted tokens of each text, and each text's first (with the end).

    Texts without signatures have one token for their words or, without words, for their bytes.
    """
    data, at = raw(column)
    begin, end, first = spans(data, at)
    h = hashes(data, begin, end)
    n = len(h)
    row = np.repeat(np.arange(len(column)), np.diff(first))
    place = np.arange(n)
    is_common = np.isin(h, common) if len(common) else np.zeros(n, bool)
    # The last common word before each word, or the text's begin.
    last = np.maximum.accumulate(np.where(is_common, place, -1)) if n else place
    before = np.maximum(np.concatenate([[-1], last])[:-1], first[:-1][row] - 1) if n else place
    spare = ~is_common & (place - before > GAP) & (_mixed(h) % np.uint64(ONE_IN) == 0)
    content = np.flatnonzero(~is_common)
    anchors = np.flatnonzero(is_common | spare)
    starts = np.flatnonzero(np.diff(first) > 0)
    where = np.concatenate([anchors, first[:-1][starts] - 1])
    value = np.concatenate([_mixed(h[anchors]), np.full(len(starts), _START)])
    owner = np.concatenate([row[anchors], starts])
    k = np.searchsorted(content, where, side="right")
    for i in range(CHAIN):
        inside = k + i < len(content)
        inside[inside] = content[k[inside] + i] < first[1:][owner[inside]]
        if i == 0:
            where, value, owner, k, inside = where[inside], value[inside], owner[inside], k[inside], inside[inside]
        value = value * _MIX
        value[inside] += h[content[k[inside] + i]]
    value = _mixed(value)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    # The k-th use of a signature.
    if len(value):
        new = np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]))
        head = np.flatnonzero(new)
        nth = (np.arange(len(value)) - np.repeat(head, np.diff(np.append(head, len(value))))).astype(np.uint64)
        value = np.where(nth > 0, _mixed(value + nth * _AGAIN), value)
    bare = np.setdiff1d(np.arange(len(column)), owner)
    if len(bare):
        whole = [
            xxhash.xxh64_intdigest(h[first[i] : first[i + 1]].tobytes() if first[i] < first[i + 1] else b"\0" + data[at[i] : at[i + 1]].tobytes())
            for i in bare
        ]
        value, owner = np.concatenate([value, np.array(whole, np.uint64)]), np.concatenate([owner, bare])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    return value, np.searchsorted(owner, np.arange(len(column) + 1))


def fingerprint(tokens: np.ndarray) -> str:
    """32 hex digits that name a set of signatures."""
    return xxhash.xxh3_128_hexdigest(tokens.tobytes())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of sorted tokens, neither empty."""
    if len(a) == len(b) and (a == b).all():
        return 1.0
    both = len(np.intersect1d(a, b))
    return both / (len(np.union1d(a, b)))


def _cut(text: bytes, points: int) -> bytes:
    """The first `points` code points."""
    if points <= 0:
        return b""
    begins = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return text if points >= len(begins) else text[: begins[points]]


def code_points(text: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def edited(text: bytes, following: bytes) -> bytes:
    """The text with the last half of its code points replaced by the first as many, or all, of the following one's."""
    n = code_points(text)
    return _cut(text, n - n // 2) + _cut(following, n // 2)


def _judge(common: np.ndarray):
    """From texts and the text that follows each (both compressed) to the rows of RESULT."""

    def rows(ids: list, texts: list[bytes], following: list[bytes]) -> pa.RecordBatch:
        changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
        n = len(texts)
        value, at = signatures(pa.array([*texts, *following[-1:], *changed], pa.binary()), common)
        sets = [value[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        own, new = sets[:n], sets[n + 1 :]
        # Texts that are followed by the next one of the list share its set.
        after = [own[i + 1] if i + 1 < n and following[i] is texts[i + 1] else None for i in range(n)]
        after[-1] = sets[n]
        for i in [i for i, x in enumerate(after) if x is None]:
            after[i] = signatures(pa.array([following[i]], pa.binary()), common)[0]
        columns = {
            "doc_id": pa.array(ids, pa.int64()),
            "n_chars": pa.array([code_points(t) for t in texts], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in changed]),
            "fingerprint": pa.array([fingerprint(x) for x in own]),
            "edited_fingerprint": pa.array([fingerprint(x) for x in new]),
            "near_edited": pa.array([likeness(a, b) for a, b in zip(own, new, strict=True)], pa.float64()),
            "near_next": pa.array([likeness(a, b) for a, b in zip(own, after, strict=True)], pa.float64()),
            "n_signatures": pa.array([len(x) for x in own], pa.int64()),
        }
        return pa.RecordBatch.from_pydict(columns)

    return rows


def fingerprints(docs: DataFrame, common: np.ndarray | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of RESULT, one for each row of `docs`: whole texts, compared with their edited text and the next document's.

    Null texts count as empty. Next is the row with the next larger key; of rows
    with the same key the one whose text has the next larger hash; null keys come
    first; after the last row the first one follows, a lone row follows itself.
    Texts that are equal have equal fingerprints and a likeness of 1; texts
    without words differ if their bytes differ. `common`: hashes of the anchors,
    by default the common words of `docs`. Texts are shuffled once, compressed. An
    empty table gives no rows; other columns are not read.
    """
    common = common_words(docs, text) if common is None else common
    rows = _judge(common)
    table = docs.select(F.col(key).cast("bigint").alias("doc_id"), utf8(text).alias("text"))
    return Neighbours(table).judged(rows, RESULT)


def signature_sets(docs: DataFrame, common: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint, tokens (array of 64-bit numbers, ascending) for each row."""

    def sets(batches):
        for batch in batches:
            for some in slices(batch, 1):
                value, at = signatures(some.column(1), common)
                marks = [fingerprint(value[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(marks), lists], ["doc_id", "fingerprint", "tokens"])

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), utf8(text).alias("text"))
    return rows.mapInArrow(sets, "doc_id bigint, fingerprint string, tokens array<bigint>")


def _bucket(token):
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS))


def near_duplicates(docs: DataFrame, least: float = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint, class_id for each row: class_id is the least doc_id among all rows that likenesses of at least `least` connect.

    Exact: every pair of different sets that is alike enough connects its rows,
    however many rows share a signature. Null texts count as empty; rows with a
    null key keep their row and name no class that has another key; an empty
    table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    paths = {name: new_path(spark, f"spot-{name}") for name in ("rows", "sets", "lists", "links", "roots")}
    rows = written(signature_sets(docs, common_words(docs, text), key, text), paths["rows"])
    once = rows.groupBy("fingerprint").agg(F.first("tokens").alias("tokens"), F.min("doc_id").alias("least"))
    each = once.select(F.explode("tokens").alias("token"))
    counts = each.groupBy(_bucket("token").alias("bucket")).agg(F.count("*").alias("n"))
    sets = written(once.withColumn("node", F.xxhash64("fingerprint")).withColumn("size", F.size("tokens")), paths["sets"])
    # Rare signatures first; a set's prefix holds one signature at least of every set that is alike enough.
    token = sets.select("node", "size", F.explode("tokens").alias("token"))
    ranked = token.withColumn("bucket", _bucket("token")).join(F.broadcast(counts), "bucket")
    ordered = ranked.groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("all"))
    prefix = ordered.select(
        "node",
        "size",
        F.floor(F.log("size") / F.lit(-np.log(least)) + 1e-9).alias("part"),
        F.posexplode(F.expr(f"slice(all, 1, cast(size - ceil({least} * size - 1e-9) + 1 as int))")).alias("place", "x"),
    )
    lists = written(
        prefix.select("node", "size", "place", F.col("x.token").alias("token"), F.explode(F.array("part", F.col("part") - 1)).alias("part")),
        paths["lists"],
    )
    links = None
    for turn in range(ROUNDS + 1):
        roots = None
        if links is not None:
            roots = written(components(links), f"{paths['roots']}-{turn}")
        here = lists if roots is None else lists.join(roots, "node", "left")
        here = here.withColumn("class", F.coalesce("root", "node") if roots is not None else F.col("node"))
        mixed = here.groupBy("token", "part").agg(
            F.min_by(F.struct("node", "class", "size", "place"), F.xxhash64("class", F.lit(turn))).alias("one"),
            (F.min("class") < F.max("class")).alias("open"),
        )
        open_lists = here.join(mixed.where("open"), ["token", "part"])
        if turn < ROUNDS:
            pairs = open_lists.where(F.col("one.class") != F.col("class")).select(
                F.struct(F.col("one.node").alias("node"), F.col("one.size").alias("size"), F.col("one.place").alias("place")).alias("x"),
                F.struct("node", "size", "place").alias("y"),
            )
        else:
            # What is left: pairs of different classes, each once.
            left = open_lists.select("token", "part", F.col("class").alias("c"), F.struct("node", "size", "place").alias("x"))
            right = open_lists.select("token", "part", F.col("class").alias("d"), F.struct("node", "size", "place").alias("y"))
            pairs = left.join(right, ["token", "part"]).where("c < d").select("x", "y")
        found = written(_alike(pairs, sets, least), f"{paths['links']}-{turn}")
        links = found if links is None else links.union(found)
    roots = written(components(links), paths["roots"])
    named = sets.select("fingerprint", "node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = named.groupBy("root").agg(F.min("least").alias("class_id"))
    return rows.join(named.join(classes, "root").select("fingerprint", "class_id"), "fingerprint").select("doc_id", "fingerprint", "class_id")


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """a, b: the pairs (x, y) whose sets are alike enough; lengths and places of their first common signature rule out most."""
    a, b = F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")
    sizes = F.col("x.size") + F.col("y.size")
    need = F.ceil(least / (1 + least) * sizes - 1e-9)
    rest = F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place"))
    fits = F.least("x.size", "y.size") >= least * F.greatest("x.size", "y.size") - 1e-9
    wanted = pairs.where(fits).select(a, b, need.alias("need"), rest.alias("rest"))
    # The first common signature of a pair leaves the most room.
    wanted = wanted.groupBy("a", "b", "need").agg(F.max("rest").alias("rest")).where("rest >= need")
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("s"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("t"))
    both = wanted.join(left, "a").join(right, "b")
    return both.where(F.size(F.array_intersect("s", "t")) >= F.col("need")).select("a", "b")
