"""Benchmark passages in documents, found by latent semantic retrieval and confirmed word by word.

Terms are the benchmark's own words; document frequencies over all documents
(counted in BUCKETS of hashed words) weigh them and the words that only documents
have, which count in a passage's length alone. Passages are windows of WORDS
words that overlap by half. A randomised SVD of the TF-IDF matrix of all the
benchmark's and all the documents' passages (one pass over it as a Spark job)
gives the latent axes, more of them for more passages; every window of every document is projected on them and compared with the
benchmark's passages by cosine. A candidate is confirmed by the longest common
subsequence of the item's words and the words around the window: a copy has COPY
of them, a paraphrase PARAPHRASE and the item's answer, its closing words, or
REWORDED of them where most of the answer's words still come up, in any order.
All of a document's search happens where the document is read; documents are
never shuffled.

Copies and paraphrases that the cosine misses are found by words alone: these
paraphrases hold the item's closing words, and a copy of COPY of the words misses
few of the item's rarest words in a stretch of bounded length. What is reworded
and has other closing words is found by the cosine only.

The benchmark is handled in parts of bounded size, each with axes of its own.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procsight.llm.memory import once
from procsight.llm.tables import kept_rows, utf8
from procsight.llm.words import hashes, raw, slices, spans

#: Of words whose document frequencies are counted.
BUCKETS = 1 << 16
#: Words of a block, blocks of a passage, blocks between two passages.
BLOCK, LONG, STRIDE = 8, 4, 2
WORDS = BLOCK * LONG
#: Least number of latent axes, passages for each further one, and columns that the randomised SVD has besides.
AXES, PER_AXIS, SPARE, SEED = 128, 64, 16, 11
#: The benchmark's weight among the documents in the matrix; as many documents as all of them together count for at most,
#: so that the benchmark's share in the axes doesn't fall as documents grow.
WEIGHT, MASS = 4.0, 1500
#: Least cosine on the axes of a candidate whose item fills a passage, and least cosine when the passage's other words
#: count too; items of fewer words need the less, by the root of their share.
COSINE, WHOLE = 0.6, 0.5
#: Weight of a word that all documents have.
LEAST_IDF = 0.1
#: Share of the item's words in their order that is a leak, and that is one if the answer is there too.
COPY, PARAPHRASE, ANSWER = 0.8, 0.6, 4
#: Share that is one if as many of the answer's words are near, in any order.
REWORDED, ANSWER_WORDS = 0.7, 3
#: Share of an item's words, its rarest, that a copy must hold besides those that it may miss.
RARE = 0.3
#: Words of the benchmark in one part, about.
PART_WORDS = 500_000
#: Words whose sums travel together; words projected at a time; bytes of text whose passages are summed at a time.
CHUNK, RUN, TEXT = 128, 1 << 12, 1 << 17
#: Uses of rare words counted at a time.
HITS = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(48)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Documents in all, and those that have a word in each bucket: one row for each task and bucket is shuffled."""

    def count(batches):
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for some in slices(batch, 0, TEXT):
                data, at = raw(some.column(0))
                begin, end, first = spans(data, at)
                row = np.repeat(np.arange(len(some)), np.diff(first))
                pairs = np.unique(_bucket(hashes(data, begin, end)) * len(some) + row)
                total += np.bincount(pairs // len(some), minlength=BUCKETS)
                n += len(some)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1)), pa.array(np.append(total[used], n))], ["bucket", "n"]
        )

    sums = docs.select(utf8("text").alias("text")).mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket")
    found = sums.agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS + 1, np.int64)
    df[found.bucket.to_numpy(np.int64)] = found.n.to_numpy(np.int64)
    return int(df[-1]), df[:-1]


def blocks_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of every block of BLOCK words (the last of a row may have fewer), and each row's first block (with the end)."""
    n = np.diff(first)
    parts = -(-n // BLOCK)
    edge = np.concatenate([[0], np.cumsum(parts)])
    nth = np.arange(edge[-1]) - np.repeat(edge[:-1], parts)
    return np.repeat(first[:-1], parts) + nth * BLOCK, edge


def windows_of(edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end block of every passage, and its row: a passage begins every STRIDE blocks, up to the row's end."""
    n = np.diff(edge)
    parts = np.where(n > 0, np.maximum(1, -(-(n - LONG) // STRIDE) + 1), 0)
    row = np.repeat(np.arange(len(n)), parts)
    nth = np.arange(parts.sum()) - np.repeat(np.concatenate([[0], np.cumsum(parts)])[:-1], parts)
    low = edge[:-1][row] + nth * STRIDE
    return low, np.minimum(low + LONG, edge[1:][row]), row


def projected(word: np.ndarray, count: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Sums of the matrix' rows over the words of each block; blocks have `count` words, few of them."""
    out = np.zeros((len(count), matrix.shape[1]), np.float32)
    begin = np.cumsum(count) - count
    order = np.argsort(-count, kind="stable")
    # Blocks of like counts are added up together, one word of each at a time, few enough to stay in the processor's cache.
    for k in range(0, len(order), RUN // BLOCK):
        some = order[k : k + RUN // BLOCK]
        total = np.zeros((len(some), matrix.shape[1]), np.float32)
        for i in range(int(count[some[0]])):
            n = int(np.searchsorted(-count[some], -i))
            total[:n] += matrix[word[begin[some[:n]] + i]]
        out[some] = total
    return out


def sums(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Sums of the blocks low..high of each passage (at most LONG)."""
    out = values[low].copy()
    for i in range(1, LONG):
        more = low + i < high
        out[more] += values[low[more] + i]
    return out


class Vocabulary:
    """The benchmark's words, as sorted hashes, and the idf of every word."""

    def __init__(self, words: np.ndarray, idf: np.ndarray):
        self.words, self.idf = words, idf.astype(np.float32)
        # Most words that the benchmark lacks are dismissed by one bit.
        bits = np.bincount((words >> np.uint64(44)).astype(np.int64), minlength=1 << 20)
        self.maybe = np.packbits(bits > 0)
        self.begin = (np.cumsum(bits) - bits).astype(np.int32)

    def __len__(self) -> int:
        return len(self.words)

    def rows(self, h: np.ndarray) -> np.ndarray:
        """Each word's number; a word of no number has that of the last one and one more."""
        out = np.full(len(h), len(self.words))
        high = h >> np.uint64(44)
        at = np.flatnonzero(self.maybe[high >> np.uint64(3)] >> (np.uint64(7) - (high & np.uint64(7))).astype(np.uint8) & 1)
        if not len(at):
            return out
        # Few words share their first bits, so a word is mostly the first one with its bits.
        own = h[at]
        row = self.begin[own >> np.uint64(44)]
        other = np.flatnonzero(self.words[row] != own)
        row[other] = np.searchsorted(self.words, own[other])
        same = self.words[np.minimum(row, len(self.words) - 1)] == own
        out[at[same]] = row[same]
        return out

    def inside(self, row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of words numbered by `rows`: the vocabulary's alone, and how many of them each block has."""
        at = np.flatnonzero(row < len(self.words))
        return row[at], np.diff(np.append(np.searchsorted(at, start), len(at)))

    def weights(self) -> np.ndarray:
        return self.idf[_bucket(self.words)]


class Axes:
    """Weighted latent axes: row i is the idf of the vocabulary's word i times its place on the axes."""

    def __init__(self, known: Vocabulary, axes: np.ndarray):
        self.known = known
        self.matrix = (known.weights()[:, None] * axes).astype(np.float32)

    def passages(self, h: np.ndarray, first: np.ndarray):
        """Unit latent vectors of all passages of rows, the share of each passage in the vocabulary, first and end word, row."""
        start, edge = blocks_of(first)
        low, high, row = windows_of(edge)
        if not len(low):
            return np.zeros((0, self.matrix.shape[1]), np.float32), np.zeros(0, np.float32), low, high, row
        word = self.known.rows(h)
        v = sums(projected(*self.known.inside(word, start), self.matrix), low, high)
        v /= np.maximum(np.linalg.norm(v, axis=1), 1e-9)[:, None]
        square = self.known.idf[_bucket(h)] ** 2
        inside = np.where(word < len(self.known), square, 0)
        both = sums(np.stack([np.add.reduceat(inside, start), np.add.reduceat(square, start)], axis=1), low, high)
        share = np.sqrt(both[:, 0] / np.maximum(both[:, 1], 1e-9))
        return v, share, start[low], np.minimum(start[high - 1] + BLOCK, first[1:][row]), row


def _gram(rows: DataFrame, known: Vocabulary, columns: int) -> np.ndarray:
    """A'(A q) for the TF-IDF matrix A of the passages of rows(text, weight): each task sums its own part.

    q is random; tasks draw it from the seed, so that it need not be sent.
    """
    size = len(known)

    def part(batches):
        q = np.random.default_rng(SEED).standard_normal((size, columns), np.float32)
        idf = known.weights()[:, None]
        weighted = (idf * q).astype(np.float32)
        total = np.zeros((size, columns), np.float32)
        for batch in batches:
            for some in slices(batch, 0, TEXT):
                h, first = _hash_rows(some.column(0))
                word = known.rows(h)
                start, edge = blocks_of(first)
                low, high, row = windows_of(edge)
                if not len(low):
                    continue
                weight = some.column(1).to_numpy(zero_copy_only=False)[row]
                square = np.add.reduceat(known.idf[_bucket(h)] ** 2, start)[:, None]
                scale = (weight / np.maximum(np.sqrt(sums(square, low, high)[:, 0]), 1e-9)).astype(np.float32)
                word, count = known.inside(word, start)
                y = sums(projected(word, count, weighted), low, high) * (scale**2)[:, None]
                # Back to the words: a block gives its words the sum of its passages.
                back = np.zeros((len(start), columns), np.float32)
                for i in range(LONG):
                    inside = low + i < high
                    back[low[inside] + i] += y[inside]
                word_block = np.repeat(np.arange(len(start)), count)
                if not len(word):
                    continue
                order = np.argsort(word.astype(np.uint16) if size < 1 << 16 else word, kind="stable")
                # A word's uses are summed in parts of up to BLOCK, then its parts.
                own, uses = np.unique(word[order], return_counts=True)
                parts = -(-uses // BLOCK)
                part_first = np.cumsum(parts) - parts
                part_uses = np.full(int(parts.sum()), BLOCK)
                part_uses[part_first + parts - 1] = uses - (parts - 1) * BLOCK
                total[own] += np.add.reduceat(projected(word_block[order], part_uses, back), part_first, axis=0)
        total *= idf
        for k in range(0, size, CHUNK):
            if total[k : k + CHUNK].any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k]), pa.array([total[k : k + CHUNK].tobytes()], pa.binary())], ["chunk", "sums"]
                )

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in parts:
            for x in batch.column("sums"):
                total = total + np.frombuffer(x.as_buffer(), np.float32).astype(np.float64)
            chunk = batch.column("chunk").slice(0, 1)
        yield pa.RecordBatch.from_arrays([chunk, pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["chunk", "sums"])

    kind = "chunk bigint, sums binary"
    out = np.zeros((size, columns), np.float32)
    for x in rows.mapInArrow(part, kind).groupBy("chunk").applyInArrow(add, kind).toLocalIterator():
        out[x.chunk : x.chunk + CHUNK] = np.frombuffer(bytes(x.sums), np.float32).reshape(-1, columns)
    return out


def latent_axes(passages: DataFrame, known: Vocabulary, axes: int = AXES) -> np.ndarray:
    """The leading right singular vectors of the passages' TF-IDF matrix, (words, axes), by randomised SVD."""
    sums_of_all = _gram(passages, known, min(len(known), axes + SPARE))
    return np.linalg.svd(sums_of_all, full_matrices=False)[0][:, :axes]


class Item:
    """An item's words, ready for comparisons by whole rows of bits."""

    def __init__(self, words: list[int]):
        self.n = len(words)
        self.tail = words[-ANSWER:]
        self.full = (1 << self.n) - 1
        self.at: dict[int, int] = {}
        for i, w in enumerate(words):
            self.at[w] = self.at.get(w, 0) | 1 << i

    def common(self, text: list[int]) -> int:
        """Length of the longest common subsequence."""
        get, full = self.at.get, self.full
        v = full
        for w in text:
            m = get(w)
            if m:
                u = v & m
                v = (v + u | v - u) & full
        return self.n - v.bit_count()

    def judge(self, text: list[int]) -> tuple[int, bool, bool]:
        """Common words in order, whether the item's closing words are in the text, and whether that is a copy or a paraphrase."""
        lcs = self.common(text)
        if lcs < PARAPHRASE * self.n or not lcs:
            return lcs, False, False
        size = len(self.tail)
        answer = any(text[i : i + size] == self.tail for i in range(len(text) - size + 1))
        return lcs, answer, answer or lcs >= COPY * self.n

    def reworded(self, text: list[int], lcs: int) -> bool:
        """REWORDED of the words in order, and most of the answer's words: a leak where the cosine is high."""
        return lcs >= REWORDED * self.n and len(set(text) & set(self.tail)) >= min(ANSWER_WORDS, len(set(self.tail)))


def _grams(h: np.ndarray) -> np.ndarray:
    """A hash of the ANSWER words from each word on (rows are not told apart)."""
    out = h[: max(0, len(h) - ANSWER + 1)].copy()
    for k in range(1, ANSWER):
        out = out * _MIX + h[k : k + len(out)]
    return out


class Lookup:
    """Which items have a hash; most hashes that none has are dismissed by one bit."""

    def __init__(self, key: np.ndarray, item: np.ndarray, weight: np.ndarray):
        order = np.lexsort((item, key))
        self.key, first = np.unique(key[order], return_index=True)
        self.first = np.append(first, len(key))
        self.item, self.weight = item[order], weight[order]
        self.known = np.zeros(1 << 20, bool)
        self.known[self.key >> np.uint64(44)] = True

    def found(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h that some item has, and their rows of `key`."""
        at = np.flatnonzero(self.known[h >> np.uint64(44)])
        row = np.searchsorted(self.key, h[at])
        same = self.key[np.minimum(row, len(self.key) - 1)] == h[at]
        return at[same], row[same]

    def uses(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the items of these rows: which of the rows, and the place in `item` and `weight`."""
        n = self.first[row + 1] - self.first[row]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(np.arange(len(row)), n), np.repeat(self.first[row], n) + nth


class Index:
    """The items by their closing words and by their rarest words.

    A leak that is a copy has all but `missing` of an item's words within the
    words around one passage, so it has all but `missing` of any of them.
    """

    def __init__(self, h: np.ndarray, first: np.ndarray, idf: np.ndarray):
        self.n = np.diff(first)
        self.span = WORDS + 2 * self.n
        need = np.ceil(COPY * self.n).astype(np.int64)
        missing = self.n - need
        chosen = np.minimum(self.n, missing + np.maximum(1, np.round(RARE * self.n).astype(np.int64)))
        self.least = chosen - missing
        self.need = {True: np.ceil(PARAPHRASE * self.n).astype(np.int64), False: need}
        item = np.repeat(np.arange(len(self.n)), self.n)
        order = np.lexsort((h, -idf[_bucket(h)], item))
        rare = order[np.arange(len(h)) - first[:-1][item] < chosen[item]]
        pairs = np.lexsort((h[rare], item[rare]))
        key, own = h[rare][pairs], item[rare][pairs]
        new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (own[1:] != own[:-1]))) if len(key) else np.zeros(0, np.int64)
        self.words = Lookup(key[new], own[new], np.diff(np.append(new, len(key))))
        ends = np.flatnonzero(self.n >= ANSWER)
        tails = _grams(h)[first[1:][ends] - ANSWER] if len(ends) else np.zeros(0, np.uint64)
        self.tails = Lookup(tails, ends, np.ones(len(ends), np.int64))

    def stretches(self, h: np.ndarray, first: np.ndarray):
        """(text row, item, stretch) wherever two stretches of the item's span have enough of its rarest words."""
        at, row = self.words.found(h) if len(self.words.key) else (np.zeros(0, np.int64),) * 2
        if not len(at):
            return
        text = np.searchsorted(first, at, side="right") - 1
        count = np.cumsum(self.words.first[row + 1] - self.words.first[row])
        size = int(np.diff(first).max()) // WORDS + 2
        keys, weights = [], []
        k = 0
        while k < len(at):
            stop = max(k + 1, int(np.searchsorted(count, (count[k - 1] if k else 0) + HITS, side="right")))
            which, use = self.words.uses(row[k:stop])
            item = self.words.item[use]
            place = (at - first[text])[k:stop][which] // self.span[item]
            key = (text[k:stop][which] * len(self.n) + item) * size + place
            # A word counts once in a stretch, as often as the item has it.
            order = np.lexsort((use, key))
            key, use = key[order], use[order]
            once = np.append(True, (key[1:] != key[:-1]) | (use[1:] != use[:-1]))
            key, use = key[once], use[once]
            cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            keys.append(key[cut])
            weights.append(np.add.reduceat(self.words.weight[use], cut))
            k = stop
        key, same = np.unique(np.concatenate(keys), return_inverse=True)
        weight = np.append(np.bincount(same, np.concatenate(weights)), 0)
        # The words around a passage lie in the stretch where they begin and the next one.
        begin = np.union1d(key, key[key % size > 0] - 1)

        def of(x):
            i = np.minimum(np.searchsorted(key, x), len(key) - 1)
            return weight[np.where(key[i] == x, i, -1)]

        pair, place = np.divmod(begin, size)
        text, item = np.divmod(pair, len(self.n))
        enough = of(begin) + of(begin + 1) >= self.least[item]
        yield from zip(text[enough].tolist(), item[enough].tolist(), place[enough].tolist(), strict=True)

    def closings(self, h: np.ndarray, first: np.ndarray):
        """(text row, item, word) wherever the item's closing words stand."""
        if not len(self.tails.key) or len(h) < ANSWER:
            return
        at, row = self.tails.found(_grams(h))
        text = np.searchsorted(first, at, side="right") - 1
        whole = at + ANSWER <= first[text + 1]
        at, row, text = at[whole], row[whole], text[whole]
        which, use = self.tails.uses(row)
        yield from zip(text[which].tolist(), self.tails.item[use].tolist(), at[which].tolist(), strict=True)

    def ranges(self, h: np.ndarray, first: np.ndarray, low: np.ndarray, high: np.ndarray, row: np.ndarray):
        """(item, first and end passage, words that must be in common): every leak is by one of these passages."""
        edge = np.searchsorted(row, np.arange(len(first)))
        for text, item, place in self.stretches(h, first):
            n, span = int(self.n[item]), int(self.span[item])
            begin = np.searchsorted(low, first[text] + place * span + n) if place else 0
            end = np.searchsorted(low, first[text] + (place + 1) * span + n)
            yield item, max(begin, edge[text]), min(end, edge[text + 1]), int(self.need[False][item])
        for text, item, word in self.closings(h, first):
            n = int(self.n[item])
            begin, end = np.searchsorted(high, word + ANSWER - n), np.searchsorted(low, word + n, side="right")
            yield item, max(begin, edge[text]), min(end, edge[text + 1]), int(self.need[True][item])


@dataclass
class Part:
    """Some of the benchmark: item ids, their words, and their passages on the axes."""

    axes: Axes
    ids: list[int]
    items: list[Item]
    vectors: np.ndarray
    owner: np.ndarray
    root: np.ndarray
    index: Index


def _hash_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, at = raw(column)
    begin, end, first = spans(data, at)
    return hashes(data, begin, end), first


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """doc_id, item_id, cosine, lcs, item_words, answer: one row for each document and item whose passage it holds.

    A document holds an item if COPY of the item's words come up in their order
    near one passage, or PARAPHRASE of them together with its closing ANSWER
    words, or REWORDED of them with ANSWER_WORDS of the answer's words where the
    passage's cosine is high. answer: the closing words stand there as they are.
    Null, empty and wordless texts and items match nothing; null keys
    are kept as null; repeated rows of documents give repeated rows, items of
    equal text one each. Empty tables give no rows; other columns are not read.
    """
    kind = "doc_id bigint, item_id bigint, cosine double, lcs int, item_words int, answer boolean"
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), utf8("text").alias("text"))
    found = None
    for part in _parts(docs, benchmark, item):
        hits = rows.mapInArrow(_search(part), kind)
        found = hits if found is None else found.union(hits)
    return docs.sparkSession.createDataFrame([], kind) if found is None else found


def _parts(docs: DataFrame, benchmark: DataFrame, item: str = "item_id") -> list:
    """The benchmark's parts, broadcast as plain bytes: workers need no installed copy of this package."""
    spark = docs.sparkSession
    texts = benchmark.select(F.col(item).cast("bigint").alias("item_id"), utf8("text").alias("text")).where("item_id is not null")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if not size:
        return []
    n, df = document_frequencies(docs)
    # Words of all documents weigh little, but enough for passages that have no others.
    idf = LEAST_IDF + np.log((1.0 + n) / (1.0 + df))
    parts = max(1, -(-size // (6 * PART_WORDS)))
    rows = docs.select(utf8("text").alias("text"), F.lit(min(1.0, MASS / max(1, n)) ** 0.5).alias("weight"))
    found = []
    for p in range(parts):
        own = texts.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == p)
        part = _part(own, rows, idf)
        if part:
            found.append(spark.sparkContext.broadcast(cloudpickle.dumps(part)))
    return found


def _part(own: DataFrame, rows: DataFrame, idf: np.ndarray) -> Part | None:
    """At most about PART_WORDS words of the benchmark come to the driver; None if there are none."""
    table = own.orderBy("item_id").toArrow()
    h, first = _hash_rows(table.column("text"))
    if not len(h):
        return None
    known = Vocabulary(np.unique(h), idf)
    low, high, row = windows_of(blocks_of(first)[1])
    weighted = rows.union(own.select("text", F.lit(WEIGHT).alias("weight")))
    axes = Axes(known, latent_axes(weighted, known, AXES + len(low) // PER_AXIS))
    items = [Item(h[a:b].tolist()) for a, b in zip(first[:-1], first[1:], strict=True)]
    vectors, _, low, high, row = axes.passages(h, first)
    root = np.sqrt(np.minimum(1, (high - low) / WORDS)).astype(np.float32)
    return Part(axes, table.column("item_id").to_pylist(), items, vectors, row, root, Index(h, first, idf))


def _loaded(broadcast) -> Part:
    data = broadcast.value
    return once("benchmark part", (len(data), zlib.crc32(data)), lambda: cloudpickle.loads(data))


def _search(broadcast):
    def search(batches):
        part = _loaded(broadcast)
        for batch in batches:
            for some in slices(batch, 1, 2 * TEXT):
                h, first = _hash_rows(some.column(1))
                vectors, share, low, high, row = part.axes.passages(h, first)
                best: dict[tuple[int, int], tuple] = {}
                tried: set[tuple[int, int]] = set()

                def near_passage(item, begin, end):
                    n = part.items[item].n
                    doc = int(row[begin])
                    return h[max(first[doc], low[begin] - n) : min(first[doc + 1], high[end - 1] + n)].tolist()

                def judged(item, at, cosine, near=False):
                    tried.add((item, at))
                    doc, words = int(row[at]), part.items[item]
                    text = near_passage(item, at, at + 1)
                    lcs, answer, leak = words.judge(text)
                    if not leak and near:
                        leak = words.reworded(text, lcs)
                    if leak and ((doc, item) not in best or best[doc, item][3] < lcs):
                        key = some.column(0)[doc].as_py()
                        best[doc, item] = (key, part.ids[item], float(cosine()), lcs, words.n, answer)

                for k in range(0, len(vectors), 2048):
                    cosine = vectors[k : k + 2048] @ part.vectors.T
                    near, which = np.nonzero(cosine >= COSINE * part.root)
                    whole = cosine[near, which] * share[k + near] >= WHOLE * part.root[which]
                    for i, q in zip(near[whole].tolist(), which[whole].tolist(), strict=True):
                        item, at = int(part.owner[q]), k + i
                        if (item, at) not in tried:
                            judged(item, at, lambda: cosine[i, q], near=True)
                for item, begin, end, need in part.index.ranges(h, first, low, high, row):
                    left = [at for at in range(begin, end) if (item, at) not in tried]
                    if left and part.items[item].common(near_passage(item, left[0], left[-1] + 1)) >= need:
                        own = slice(*np.searchsorted(part.owner, [item, item + 1]))
                        for at in left:
                            judged(item, at, lambda: (part.vectors[own] @ vectors[at]).max())
                columns = list(zip(*best.values(), strict=True)) or [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                    ["doc_id", "item_id", "cosine", "lcs", "item_words", "answer"],
                )

    return search


def _clean(broadcast):
    def clean(texts: pa.Array) -> np.ndarray:
        mask = np.ones(len(texts), bool)
        rows = pa.RecordBatch.from_arrays([pa.array(np.arange(len(texts))), texts], ["row", "text"])
        for found in _search(broadcast)([rows]):
            mask[found.column(0).to_numpy()] = False
        return mask

    return clean


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark passage: each row goes or stays by its own text, whatever its key."""
    for part in _parts(docs, benchmark):
        docs = kept_rows(docs, _clean(part))
    return docs
