"""Toxic passages by maximum-scoring segment search.

Token log-odds between toxic and other documents come from counts under an
informative Dirichlet prior (each word's share in all documents); words whose
log-odds are significant form the lexicon, each scored at its lower confidence
bound, and every other token has the small negative log-odds of not being in it.
A linear-time scan finds all maximal scoring segments of a text. A segment's
score S in a text of n tokens is judged by extreme-value statistics: K n
exp(-lambda S) such segments are expected by chance. The significant passages'
evidence is added up, and a logistic curve turns it into a probability.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procsight.llm.tables import drop, held_out, kept_rows, new_path, utf8, written
from procsight.llm.words import hashes, raw, slices, spans

#: Labels up to which they travel to every task; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Share of a word's count that is put to its prior in each class, and what every word has besides.
PRIOR, FLOOR = 0.05, 0.01
#: Least z-value of a lexicon word; expected number of chance passages up to which one is significant.
Z, CHANCE = 1.9, 0.1
THRESHOLD = 0.3


@dataclass
class Model:
    """Word hashes (sorted) with scores, the other tokens' score, and the calibration."""

    words: np.ndarray
    scores: np.ndarray
    other: float
    rate: float
    k: float
    base: float
    slope: float

    def evidence(self, n: int, s: float) -> float:
        """-log probability that n chance tokens hold a segment of score s."""
        if s <= 0:
            return 0.0
        expected = self.k * n * np.exp(-self.rate * s)
        return float(-np.log(-np.expm1(-expected))) if expected > 1e-12 else float(self.rate * s - np.log(self.k * n))

    def probability(self, evidence: float) -> float:
        return float(0.5 * (1 + np.tanh(0.5 * (self.base + self.slope * np.log1p(evidence)))))


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """(begin, end, score) of all maximal scoring segments, in order, in linear time (Ruzzo and Tompa).

    Every segment found has a positive score, no two overlap, and none can be
    prolonged or cut to a higher score. Ties keep the shorter segment.
    """
    # Each candidate: begin, end, the sum before it, the sum up to its end, and the last one with a smaller sum before.
    found: list[tuple[int, int, float, float, int]] = []
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        begin, left, right = i, total, total + s
        total = right
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                found.append((begin, i + 1, left, right, j))
                break
            begin, left = found[j][0], found[j][2]
            before = found[j][4]
            del found[j:]
            j = before
    return [(a, b, r - low) for a, b, low, r, _ in found]


def passages(model: Model, words: np.ndarray) -> tuple[list[tuple[int, int, float, float]], float]:
    """Significant passages (first word, end, score, expected by chance) of a text's word hashes, and all its evidence."""
    n = len(words)
    if not n or not len(model.words):
        return [], 0.0
    at = np.minimum(np.searchsorted(model.words, words), len(model.words) - 1)
    hits = np.flatnonzero(model.words[at] == words)
    if not len(hits):
        return [], 0.0
    # Runs of other tokens count as one item.
    items, where = [], []
    last = 0
    for i, s in zip(hits.tolist(), model.scores[at[hits]].tolist(), strict=True):
        if i > last:
            items.append((i - last) * model.other)
            where.append(last)
        items.append(s)
        where.append(i)
        last = i + 1
    where.append(last)
    found, best, total = [], 0.0, 0.0
    for a, b, s in segments(items):
        evidence = model.evidence(n, s)
        best = max(best, evidence)
        expected = model.k * n * float(np.exp(-model.rate * s))
        if expected <= CHANCE:
            found.append((where[a], where[b - 1] + 1, s, expected))
            total += evidence
    return found, total if found else best


def _counts(rows: DataFrame) -> DataFrame:
    """h, n1, n0 (toxic and other documents with the word), t1, t0 (its occurrences)."""

    def count(batches):
        for batch in batches:
            for some in slices(batch, 0):
                data, at = raw(some.column(0))
                begin, end, first = spans(data, at)
                h = hashes(data, begin, end)
                toxic = np.repeat(some.column(1).to_numpy(zero_copy_only=False) == 1, np.diff(first))
                row = np.repeat(np.arange(len(some)), np.diff(first))
                words, back = np.unique(h, return_inverse=True)
                pairs = np.unique(back * len(some) + row)
                in_toxic = some.column(1).to_numpy(zero_copy_only=False)[pairs % len(some)] == 1
                seen = pairs // len(some)
                n = len(words)
                columns = [words.view(np.int64)] + [
                    np.bincount(x, minlength=n).astype(np.int64)
                    for x in (seen[in_toxic], seen[~in_toxic], back[toxic], back[~toxic])
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "n1", "n0", "t1", "t0"])

    each = rows.select("text", "toxic").mapInArrow(count, "h bigint, n1 bigint, n0 bigint, t1 bigint, t0 bigint")
    return each.groupBy("h").agg(*(F.sum(c).alias(c) for c in ("n1", "n0", "t1", "t0")))


def training_rows(docs: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """text, toxic of all labelled rows outside the held-out quarter; of repeated labels the largest counts."""
    allowed = labels.where(~held_out(key) & F.col(key).isNotNull() & F.col("toxic").isNotNull())
    known = allowed.groupBy(key).agg(F.max("toxic").cast("int").alias("toxic"))
    if allowed.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    return docs.select(key, utf8("text").alias("text")).join(known, key).select("text", "toxic")


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> Model:
    """Fits lexicon and calibration on all labelled rows; without toxic or without other ones, scores are the share of toxic ones."""
    spark = docs.sparkSession
    paths = [new_path(spark, f"toxicity-{name}") for name in ("rows", "counts", "evidence")]
    try:
        return _learn(written(training_rows(docs, labels, key), paths[0]), *paths[1:])
    finally:
        for path in paths:
            drop(spark, path)


def _learn(train: DataFrame, counts_path: str, evidence_path: str) -> Model:
    seen = train.groupBy().agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    share = (seen.toxic or 0) / seen.n if seen.n else 0.0
    empty = Model(np.zeros(0, np.uint64), np.zeros(0), -0.01, 1.0, 1.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))), 0.0)
    if not seen.n or not seen.toxic or seen.toxic == seen.n:
        return empty
    counts = written(_counts(train), counts_path)
    total = counts.agg(*(F.sum(c).alias(c) for c in ("n1", "n0", "t1", "t0"))).first()
    if not total.n1 or not total.n0:
        return empty
    prior = PRIOR * (F.col("n1") + F.col("n0")) + FLOOR
    a, b = F.col("n1") + prior, F.col("n0") + prior
    mass = PRIOR * (total.n1 + total.n0)
    odds = F.log(a / (total.n1 + mass - a)) - F.log(b / (total.n0 + mass - b))
    error = F.sqrt(1 / a + 1 / b)
    lexicon = (
        counts.where("n1 > 0")
        .select("h", odds.alias("odds"), error.alias("error"), "t1", "t0", "n0", prior.alias("prior"))
        .where(F.col("odds") > Z * F.col("error"))
        .select("h", (F.col("odds") - F.col("error")).alias("score"), "t1", "t0", "prior")
        .toPandas()
    )
    if lexicon.empty:
        return empty
    words = lexicon.h.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    words, scores = words[order], lexicon.score.to_numpy(float)[order]
    # How often lexicon words come up in a token of either class.
    chance = (lexicon.t0.to_numpy(float)[order] + lexicon.prior.to_numpy(float)[order]) / (total.t0 + 1)
    p, q = min(0.5, chance.sum()), min(0.9, lexicon.t1.sum() / (total.t1 + 1))
    other = float(min(np.log((1 - q) / (1 - p)), -1e-3))
    rate = _rate(chance, scores, p, other)
    tail = np.argsort(-scores)
    k = float(np.max(np.exp(rate * scores[tail]) * np.cumsum(chance[tail])))
    model = Model(words, scores, other, rate, k, 0.0, 1.0)

    def measure(batches):
        for batch in batches:
            for some in slices(batch, 0):
                out = pa.array([e for _, _, e in _read(model, some.column(0))], pa.float64())
                yield pa.RecordBatch.from_arrays([out, some.column(1)], ["evidence", "toxic"])

    points = written(train.select("text", "toxic").mapInArrow(measure, "evidence double, toxic int"), evidence_path)
    model.base, model.slope = _logistic(points.select(F.log1p("evidence").alias("x"), F.col("toxic").alias("y")), share)
    return model


def _rate(chance: np.ndarray, scores: np.ndarray, p: float, other: float) -> float:
    """The lambda > 0 at which the mean of exp(lambda * score) of a chance token is 1."""

    def excess(x: float) -> float:
        return float((chance * np.exp(x * scores)).sum() + (1 - p) * np.exp(x * other) - 1)

    if (chance * scores).sum() + (1 - p) * other >= 0:
        return 1.0
    low, high = 1e-3, 1e-3
    while excess(high) <= 0 and high < 50:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) <= 0 else (low, mid)
    return high


def _logistic(points: DataFrame, share: float) -> tuple[float, float]:
    """Base and slope of a logistic curve through points(x, y), by Newton's steps with a small ridge; the slope isn't negative.

    `share` is the mean of y. Each step sums over the points in one Spark job.
    """
    w = np.array([np.log((share + 1e-6) / (1 - share + 1e-6)), 0.0])
    x = F.col("x")
    for _ in range(50):
        p = 0.5 * (1 + F.tanh(0.5 * (F.lit(float(w[0])) + F.lit(float(w[1])) * x)))
        both = points.select("x", (p * (1 - p)).alias("v"), (F.col("y") - p).alias("d"))
        s = both.agg(*(F.sum(c).alias(n) for n, c in (("v", F.col("v")), ("vx", x * F.col("v")), ("vxx", x * x * F.col("v")), ("d", F.col("d")), ("dx", x * F.col("d"))))).first()
        hessian = np.array([[s.v + 1e-3, s.vx], [s.vx, s.vxx + 0.1]])
        step = np.linalg.solve(hessian, np.array([s.d, s.dx - 0.1 * w[1]]))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(0.0, w[1]))


def _read(model: Model, column: pa.Array):
    """For each text: its passages in bytes, its number of words, its evidence."""
    data, at = raw(column)
    begin, end, first = spans(data, at)
    h = hashes(data, begin, end)
    for i in range(len(at) - 1):
        low, high = first[i], first[i + 1]
        found, evidence = passages(model, h[low:high])
        text = []
        for a, b, s, e in found:
            x, y = int(begin[low + a]), int(end[low + b - 1])
            # In characters: bytes that don't continue one.
            start = int(((data[at[i] : x] & 0xC0) != 0x80).sum())
            text.append((start, start + int(((data[x:y] & 0xC0) != 0x80).sum()), s, e))
        yield text, int(high - low), evidence


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())])


def score(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages, passages for each row: whole texts.

    passages: array of (start, end, score, expected), in characters of the
    text. Null, empty and wordless texts have no passage and the score of no
    evidence. Repeated rows and null keys keep their rows; other columns are
    not read; an empty table gives no rows.
    """
    rows = docs.select(F.col(key), held_out(key).alias("held_out"), utf8("text").alias("text"))

    def judge(batches):
        for batch in batches:
            for some in slices(batch, 2):
                read = [(x, model.probability(e)) for x, _, e in _read(model, some.column(2))]
                spots = [[dict(zip(("start", "end", "score", "expected"), x, strict=True)) for x in found] for found, _ in read]
                scores = [s for _, s in read]
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0),
                        some.column(1),
                        pa.array(scores, pa.float64()),
                        pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()),
                        pa.array([len(x) for x in spots], pa.int32()),
                        pa.array(spots, pa.list_(SPAN)),
                    ],
                    ["doc_id", "held_out", "score", "predicted", "n_passages", "passages"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(
        judge,
        f"`{key}` {kind}, held_out boolean, score double, predicted int, n_passages int, "
        "passages array<struct<start:bigint,end:bigint,score:double,expected:double>>",
    )


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not predicted toxic."""
    return kept_rows(docs, lambda texts: np.array([model.probability(e) < THRESHOLD for _, _, e in _read(model, texts)], bool))
