"""Packs token ids into sequences of fixed size, with a controlled mixture of sources.

Every source is a queue of its documents' tokens. The stream is filled window
by window by deficit round-robin: in each window a source's deficit grows by
its share of the window, it sends as many whole tokens as the deficit holds,
and the fraction stays for the next window. A source that runs empty leaves its
share to the others. As documents may be cut anywhere, what a source has sent
after r windows is a plain formula of r, so every document finds its place in
the stream from its own place in its source's queue: no task sees the others'
documents, and the deficits pass from partition to partition by that formula.
The stream is cut into sequences; only the last one can be short.
"""

import zlib
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procsight.llm.encode import encoder
from procsight.llm.tables import kept, utf8
from procsight.llm.words import raw, slices

#: Ends every document.
END = (0).to_bytes(4, "little")
#: Tokens of a window; the mixture holds in each.
WINDOW = 1 << 18
#: A mixture is a list of sources with a weight for each; more are an error.
MOST_SOURCES = 100_000
#: Bytes of ids in a batch.
BATCH = 8 << 20

TOKENS = "doc_id bigint, queue string, part int, before bigint, n bigint, ids binary"
PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
    "offset bigint, queue string, window bigint"
)


class Schedule:
    """What each queue has sent after r windows, and where in the stream it stands.

    totals: tokens by queue; weights: the target proportions, whole numbers.
    The schedule has one phase for each time that queues run empty.
    """

    def __init__(self, totals: list[int], weights: list[int], window: int):
        self.totals, self.weights, self.window = totals, weights, window
        self.starts: list[int] = []
        self.phases: list[tuple[int, list[int], int]] = []
        sent, r = [0] * len(totals), 0
        while any(s < t for s, t in zip(sent, totals, strict=True)):
            live = sum(w for s, t, w in zip(sent, totals, weights, strict=True) if s < t)
            # Windows until the first live queue is empty: the least k with floor(k * quantum) >= rest.
            k = min(
                -(-(t - s) * live // (w * window)) for s, t, w in zip(sent, totals, weights, strict=True) if s < t
            )
            self.starts.append(r)
            self.phases.append((r, sent, live))
            r += k
            sent = [
                min(t, s + k * w * window // live) if s < t else t for s, t, w in zip(sent, totals, weights, strict=True)
            ]
        self.windows = r
        self.after = lru_cache(4096)(self._after)
        self.begin = lru_cache(4096)(self._begin)

    def one(self, q: int, r: int) -> int:
        """Tokens that queue q has sent after r windows; what its deficit holds beyond is less than one token."""
        if r >= self.windows:
            return self.totals[q]
        first, sent, live = self.phases[bisect_right(self.starts, r) - 1]
        s, t = sent[q], self.totals[q]
        return t if s >= t else min(t, s + (r - first) * self.weights[q] * self.window // live)

    def _after(self, r: int) -> list[int]:
        return [self.one(q, r) for q in range(len(self.totals))]

    def _begin(self, r: int) -> list[int]:
        """Where in the stream each queue's part of window r begins."""
        a, b = self.after(r), self.after(r + 1)
        return list(accumulate((y - x for x, y in zip(a, b, strict=True)), initial=sum(a)))

    def window_of(self, q: int, at: int) -> int:
        """The window in which queue q sends its token number `at`."""
        low, high = 0, self.windows - 1
        while low < high:
            mid = (low + high) // 2
            if self.one(q, mid + 1) > at:
                high = mid
            else:
                low = mid + 1
        return low

    def pieces(self, q: int, at: int, n: int):
        """(window, place in the stream, length) of the queue's tokens at..at+n."""
        r = self.window_of(q, at)
        while n > 0:
            from_, to = self.after(r)[q], self.after(r + 1)[q]
            if to > at:
                take = min(n, to - at)
                yield r, self.begin(r)[q] + at - from_, take
                at, n = at + take, n - take
            r += 1


def tokenized(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, queue, part, before (tokens of the queue earlier in this part), n, ids with the closing id 0."""

    def encode(batches):
        ids_of = encoder(tokenizer).column
        part, sent = TaskContext.get().partitionId(), {}
        for batch in batches:
            for some in slices(batch, 2, 1 << 22):
                queues = some.column(1).to_pylist()
                ids = ids_of(some.column(2), END)
                n, before = (np.diff(raw(ids)[1]) // 4).tolist(), []
                for q, k in zip(queues, n, strict=True):
                    before.append(sent.get(q, 0))
                    sent[q] = before[-1] + k
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0),
                        some.column(1),
                        pa.array([part] * len(ids), pa.int32()),
                        pa.array(before, pa.int64()),
                        pa.array(n, pa.int64()),
                        ids,
                    ],
                    ["doc_id", "queue", "part", "before", "n", "ids"],
                )

    queue = F.when(F.col(source).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source)))
    return docs.select(F.col(key).cast("bigint").alias("doc_id"), queue.alias("queue"), utf8(text).alias("text")).mapInArrow(
        encode, TOKENS
    )


def pack(
    docs: DataFrame,
    tokenizer: str,
    size: int = 1024,
    window: int = WINDOW,
    mixture: dict[str | None, float] | None = None,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row for each piece of a document, see PIECES; sequences have `size` tokens, the last one maybe fewer.

    mixture: target proportion by source, above 0; sources that it lacks have
    the least one given. Without it the sources' shares of all tokens are the
    targets, so that no queue runs empty early.

    Null and empty texts are the closing id alone. A null source is a queue of
    its own. Repeated rows are packed each. Null keys stay null. An empty table
    gives no rows. Only key, text and source are read.
    """
    tokens = kept(tokenized(docs, tokenizer, key, text, source), "tokens")
    sums = tokens.groupBy("queue", "part").agg(F.sum("n").alias("tokens"))
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A stored table has a known size, by which Spark chooses the join: tokens are not shuffled if it is small.
    first = kept(sums.select("queue", "part", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("first")), "first")
    found = sums.groupBy("queue").agg(F.sum("tokens").alias("tokens")).orderBy("queue").limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"a mixture has at most {MOST_SOURCES} sources")
    totals = [int(x.tokens) for x in found]
    weights = totals
    if mixture:
        least = min(mixture.values())
        share = {("" if k is None else f"={k}"): v for k, v in mixture.items()}
        weights = [max(1, round(share.get(x.queue, least) * 1e9)) for x in found]
    number = {x.queue: i for i, x in enumerate(found)}

    def place(batches):
        plan = Schedule(totals, weights, window)
        rows: list[tuple] = []
        for batch in batches:
            for doc, queue, at, n, ids in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                q, start, view = number[queue], 0, memoryview(ids)
                for r, stream, length in plan.pieces(q, at, n):
                    while length > 0:
                        offset = stream % size
                        take = min(length, size - offset)
                        crc = zlib.crc32(view[4 * start : 4 * (start + take)])
                        rows.append((doc, start, take, crc, n, stream // size, offset, queue, r))
                        start, stream, length = start + take, stream + take, length - take
                if len(rows) >= 20_000:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)

    placed = tokens.join(first, ["queue", "part"]).select(
        "doc_id", "queue", (F.col("first") + F.col("before")).alias("at"), "n", "ids"
    )
    return placed.mapInArrow(place, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in PIECES.split(", ")]
    columns = [
        pa.array(x, pa.string() if name == "queue" else pa.int64()) for name, x in zip(names, zip(*rows, strict=True), strict=True)
    ]
    return pa.RecordBatch.from_arrays(columns, names)
