"""Language identification: a bidirectional gated recurrent network over bytes, in numpy.

A text's letters are read run by run (letters are A-Z, a-z and all bytes beyond
ASCII), in pieces of at most PIECE bytes, each between two border marks. One
gated recurrent layer reads a piece forwards and one backwards; from both states
every position gets a distribution over the languages. A piece's evidence is the
mean log probability of its positions, a document's the sum over its pieces.
As a piece is read from its border on, equal pieces have equal labels: each
worker runs the network once for each new piece and remembers the result.

The network learns from every piece of all rows that it may learn from: pieces
are counted, frequent ones are repeated by their share of their language, all
others come once. They are dealt into parts; in each epoch every part starts
from the same parameters, takes Adam's steps over its pieces in one task, and
the parts' parameters and moments are averaged.
"""

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procsight.llm.memory import once
from procsight.llm.tables import bounded_by, drop, held_out, kept_rows, new_path, utf8, written
from procsight.llm.words import IN_WORD, LOWER, hashes, raw, slices, spans

#: Pieces of each language among which frequent ones are repeated by their share; pieces that one task learns from in an epoch.
TRAIN_PIECES, PART = 6000, 1 << 16
PIECE, HIDDEN, EPOCHS, BATCH, RATE, SEED = 24, 16, 8, 256, 0.01, 7
#: Pieces that a worker remembers before it starts anew, and pieces run at a time.
REMEMBERED, RUN = 600_000, 4096

LETTER = IN_WORD.copy()
LETTER[48:58] = False
BORDER = 32
UNKNOWN = "und"


def pieces(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every piece, and for each row the number of its first piece (with the end)."""
    begin, end, first = spans(data, at, LETTER)
    parts = -(-(end - begin) // PIECE)
    total = np.concatenate([[0], np.cumsum(parts)])
    nth = np.arange(total[-1]) - np.repeat(total[:-1], parts)
    low = np.repeat(begin, parts) + nth * PIECE
    return low, np.minimum(low + PIECE, np.repeat(end, parts)), total[first]


def by_length(data: np.ndarray, begin: np.ndarray, end: np.ndarray, most: int):
    """(rows, codes with borders) for pieces of equal length, at most `most` at a time."""
    size = end - begin
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[order])) + 1
    for same in np.split(order, cuts):
        for k in range(0, len(same), most):
            rows = same[k : k + most]
            n = int(size[rows[0]]) if len(rows) else 0
            codes = np.full((len(rows), n + 2), BORDER, np.uint8)
            codes[:, 1:-1] = LOWER[data[begin[rows, None] + np.arange(n)[None, :]]]
            yield rows, codes


class Layer:
    """One gated recurrent layer: w by byte, u by state; the columns are update, reset and candidate.

    States stand as (steps, hidden, rows), so that a gate of all rows is one run of memory.
    """

    def __init__(self, random: np.random.Generator, hidden: int):
        self.w = random.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        self.u = random.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
        self.b = np.zeros(3 * hidden, np.float32)

    def forward(self, codes: np.ndarray, states: np.ndarray, keep: bool = False) -> list:
        """Writes the states after each position; what the way back needs."""
        rows, steps = codes.shape
        k = self.u.shape[0]
        w, u, b = np.ascontiguousarray(self.w.T), np.ascontiguousarray(self.u.T), self.b[:, None]
        h, memory = np.zeros((k, rows), np.float32), []
        for t in range(steps):
            x = w.take(codes[:, t], axis=1)
            s = u @ h
            s += b
            gates = x[: 2 * k]
            gates += s[: 2 * k]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            z, r = gates[:k], gates[k:]
            n = r * s[2 * k :]
            n += x[2 * k :]
            np.tanh(n, out=n)
            moved = h - n
            if keep:
                memory.append((moved, z, r, n, s[2 * k :]))
            h = z * moved
            h += n
            states[t] = h
        return memory

    def backward(self, codes: np.ndarray, states: np.ndarray, memory: list, grad: np.ndarray) -> list[np.ndarray]:
        """Gradients of w, u and b from those of the states, back through time."""
        rows, steps = codes.shape
        k = self.u.shape[0]
        # By step: of update, reset and candidate as the state enters them, and of the candidate as the byte does.
        d = np.empty((steps, 4 * k, rows), np.float32)
        dh = np.zeros((k, rows), np.float32)
        for t in reversed(range(steps)):
            moved, z, r, n, candidate = memory[t]
            dz, dr, ds, dn = d[t, :k], d[t, k : 2 * k], d[t, 2 * k : 3 * k], d[t, 3 * k :]
            dh = dh + grad[t]
            through = dh * z
            np.multiply(n, n, out=dn)
            np.subtract(1, dn, out=dn)
            dn *= dh - through
            np.multiply(dn, r, out=ds)
            np.multiply(through, moved, out=dz)
            dz *= 1 - z
            np.multiply(ds, candidate, out=dr)
            dr *= 1 - r
            dh = self.u @ d[t, : 3 * k]
            dh += through
        du = (states[:-1] @ d[1:, : 3 * k].transpose(0, 2, 1)).sum(axis=0)
        # Sums by byte, as a product with the few bytes that occur.
        used = np.flatnonzero(np.bincount(codes.reshape(-1), minlength=256))
        by_byte = ((codes.T[:, None, :] == used[:, None]).astype(np.float32) @ d.transpose(0, 2, 1)).sum(axis=0)
        dw = np.zeros_like(self.w)
        dw[used, : 2 * k], dw[used, 2 * k :] = by_byte[:, : 2 * k], by_byte[:, 3 * k :]
        return [dw, du, d[:, : 3 * k].sum(axis=(0, 2))]


class Network:
    """Labels every position of a piece; `languages` are the classes."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = SEED):
        random = np.random.default_rng(seed)
        self.languages = languages
        self.ahead, self.back = Layer(random, hidden), Layer(random, hidden)
        self.v = random.normal(0, 0.1, (2 * hidden, len(languages))).astype(np.float32)
        self.c = np.zeros(len(languages), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.ahead.w, self.ahead.u, self.ahead.b, self.back.w, self.back.u, self.back.b, self.v, self.c]

    def _run(self, codes: np.ndarray, keep: bool):
        """States and logits less their maximum, both (steps, hidden or languages, rows), and the layers' memories."""
        rows, steps = codes.shape
        k = self.ahead.u.shape[0]
        states = np.empty((steps, 2 * k, rows), np.float32)
        m = self.ahead.forward(codes, states[:, :k], keep)
        n = self.back.forward(codes[:, ::-1], states[::-1, k:], keep)
        logits = np.ascontiguousarray(self.v.T) @ states[1:-1]
        logits += self.c[:, None]
        logits -= logits.max(axis=1, keepdims=True)
        return states, logits, m, n

    def positions(self, codes: np.ndarray) -> np.ndarray:
        """Log probabilities of the languages at every position between the borders, (rows, steps, languages)."""
        _, logits, _, _ = self._run(codes, False)
        logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return logits.transpose(2, 0, 1)

    def gradients(self, codes: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over the positions, and its gradients in the order of `parameters`."""
        states, logits, m, n = self._run(codes, True)
        p = np.exp(logits, out=logits)
        p /= p.sum(axis=1, keepdims=True)
        steps, _, rows = p.shape
        loss = -np.log(np.maximum(p[:, labels, np.arange(rows)], 1e-12)).mean()
        p[:, labels, np.arange(rows)] -= 1
        p /= steps * rows
        grad = np.zeros_like(states)
        grad[1:-1] = self.v @ p
        k = self.ahead.u.shape[0]
        ahead = self.ahead.backward(codes, states[:, :k], m, grad[:, :k])
        back = self.back.backward(codes[:, ::-1], states[::-1, k:], n, grad[::-1, k:])
        return float(loss), [*ahead, *back, (states[1:-1] @ p.transpose(0, 2, 1)).sum(axis=0), p.sum(axis=(0, 2))]

    def moments(self) -> list[np.ndarray]:
        """Adam's first and second moments before the first step, in the order of `parameters`."""
        return [np.zeros_like(x) for _ in range(2) for x in self.parameters()]

    def epoch(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, labels: np.ndarray, moments: list[np.ndarray], rate: float, nth: int, part: int = 0) -> float:
        """One epoch of Adam over batches of pieces of equal length, in place; the sum of the pieces' losses."""
        random = np.random.default_rng([SEED, nth, part])
        mixed = random.permutation(len(begin))
        batches = list(by_length(data, begin[mixed], end[mixed], BATCH))
        total, own = 0.0, self.parameters()
        for done, b in enumerate(random.permutation(len(batches))):
            rows, codes = batches[b]
            loss, grads = self.gradients(codes, labels[mixed[rows]])
            total += loss * len(rows)
            step = nth * len(batches) + done + 1
            size = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for x, g, m, v in zip(own, grads, moments[: len(own)], moments[len(own) :], strict=True):
                g = g * (len(rows) / BATCH)
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x -= size * m / (np.sqrt(v) + 1e-8)
        return total

    def fit(self, parts: DataFrame, epochs: int = EPOCHS) -> list[float]:
        """Learns from parts(part, n, labels, sizes, pieces), one row each; the mean loss of each epoch."""
        moments, losses = self.moments(), []
        # So many sums come to the driver, and about as many parts to each: no task and not the driver holds all parts' states.
        blocks = max(1, math.isqrt(parts.count()))
        for nth in range(epochs):
            shapes = self.parameters() + moments
            trained = parts.mapInArrow(_epoch(self, moments, RATE * (1 - nth / epochs), nth), "part int, n bigint, loss double, state binary")
            # Grouped, not sorted: a sort would first train all parts once more to draw its borders.
            summed = trained.groupBy(F.pmod("part", F.lit(blocks)).alias("block")).applyInArrow(_summed, "part int, n bigint, loss double, state binary")
            sums = sorted(summed.collect(), key=lambda r: r.part)
            n = sum(r.n for r in sums)
            state, at = sum(np.frombuffer(r.state, np.float64) for r in sums) / n, 0
            for x in shapes:
                x[...] = state[at : at + x.size].reshape(x.shape)
                at += x.size
            losses.append(sum(r.loss for r in sums) / n)
        return losses


def _epoch(network: Network, moments: list[np.ndarray], rate: float, nth: int):
    begun = [x.copy() for x in network.parameters() + moments]

    def epoch(batches):
        for batch in batches:
            for r in batch.to_pylist():
                state = [x.copy() for x in begun]
                own = Network(network.languages)
                for x, y in zip(own.parameters(), state, strict=False):
                    x[...] = y
                edge = np.concatenate([[0], np.cumsum(np.frombuffer(r["sizes"], np.uint8), dtype=np.int64)])
                moved = state[len(own.parameters()) :]
                loss = own.epoch(np.frombuffer(r["pieces"], np.uint8), edge[:-1], edge[1:], np.frombuffer(r["labels"], np.int32), moved, rate, nth, r["part"])
                flat = np.concatenate([x.reshape(-1) for x in own.parameters() + moved])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["part"]], pa.int32()), pa.array([r["n"]], pa.int64()), pa.array([loss]), pa.array([flat.astype(np.float32).tobytes()], pa.binary())],
                    ["part", "n", "loss", "state"],
                )

    return epoch


def _summed(rows: pa.Table) -> pa.Table:
    """One row for some parts: the sum of their states, each as often as it has pieces, in their order so that it repeats."""
    rows = rows.sort_by("part")
    n = rows.column("n").to_pylist()
    state = sum(np.frombuffer(x.as_buffer(), np.float32) * np.float64(k) for x, k in zip(rows.column("state"), n, strict=True))
    return pa.table(
        {
            "part": rows.column("part").slice(0, 1),
            "n": pa.array([sum(n)], pa.int64()),
            "loss": pa.array([sum(rows.column("loss").to_pylist())], pa.float64()),
            "state": pa.array([state.tobytes()], pa.binary()),
        }
    )


def _counted(batches):
    """lang, piece, n of each slice of (lang, text): A-Z as a-z, as the network reads them."""
    for batch in batches:
        for some in slices(batch, 1, 1 << 22):
            data, at = raw(some.column(1))
            begin, end, first = pieces(data, at)
            names = pc.dictionary_encode(some.column(0))
            label = np.repeat(names.indices.to_numpy(zero_copy_only=False), np.diff(first))
            h = hashes(data, begin, end)
            for code, name in enumerate(names.dictionary.to_pylist()):
                own = np.flatnonzero(label == code)
                _, where, n = np.unique(h[own], return_index=True, return_counts=True)
                low, high = begin[own[where]], end[own[where]]
                edge = np.concatenate([[0], np.cumsum(high - low)])
                text = LOWER[data[np.repeat(low - edge[:-1], high - low) + np.arange(edge[-1])]]
                piece = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(edge.astype(np.int32).tobytes()), pa.py_buffer(text.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(n), pa.string()), piece, pa.array(n, pa.int64())], ["lang", "piece", "n"])


def _packed(languages: list[str]):
    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("lang", "ascending"), ("piece", "ascending")])
        data, at = raw(rows.column("piece"))
        labels = pc.index_in(rows.column("lang"), pa.array(languages)).to_numpy().astype(np.int32)
        return pa.table(
            {
                "part": rows.column("part").slice(0, 1),
                "n": pa.array([len(rows)], pa.int64()),
                "labels": pa.array([labels.tobytes()], pa.binary()),
                "sizes": pa.array([np.diff(at).astype(np.uint8).tobytes()], pa.binary()),
                "pieces": pa.array([data.tobytes()], pa.binary()),
            }
        )

    return pack


def learn(docs: DataFrame, rows: int | None = None, per_language: int = TRAIN_PIECES, key: str = "doc_id") -> Network | None:
    """The network fitted on all pieces of the rows that may be learned from; None without such rows.

    A piece comes once, and more often if its share of its language's pieces, over
    all rows, makes more of `per_language`; languages of fewer pieces repeat each as
    often as it stands in their rows, so that a rare language stays a class. Given
    `rows`, only about that many rows of each language are learned from.
    """
    spark = docs.sparkSession
    allowed = docs.where(~held_out(key) & F.col(key).isNotNull() & F.col("lang").isNotNull()).select(key, "lang", utf8("text").alias("text"))
    if rows is not None:
        allowed = bounded_by(allowed, "lang", key, rows)
    paths = [new_path(spark, f"pieces-{name}") for name in ("counts", "parts")]
    try:
        each = allowed.select("lang", "text").mapInArrow(_counted, "lang string, piece binary, n bigint")
        counts = written(each.groupBy("lang", "piece").agg(F.sum("n").alias("n")), paths[0])
        rates = {x.lang: min(1.0, per_language / x.n) for x in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        if not rates:
            return None
        network = Network(sorted(rates))
        if len(rates) > 1:
            rate = F.element_at(F.create_map(*[F.lit(x) for pair in rates.items() for x in pair]), F.col("lang"))
            times = counts.select("lang", "piece", F.greatest(F.lit(1), F.round(rate * F.col("n"))).cast("int").alias("times"))
            parts = -(-times.agg(F.sum("times")).first()[0] // PART)
            dealt = times.select("lang", "piece", F.explode(F.sequence(F.lit(1), "times")).alias("nth")).select(
                "lang", "piece", F.pmod(F.xxhash64("lang", "piece", "nth"), F.lit(parts)).cast("int").alias("part")
            )
            packed = dealt.groupBy("part").applyInArrow(_packed(network.languages), "part int, n bigint, labels binary, sizes binary, pieces binary")
            network.fit(written(packed.repartition(parts, "part"), paths[1]))
        return network
    finally:
        for path in paths:
            drop(spark, path)


class Reader:
    """The evidence of pieces, remembered by hash."""

    def __init__(self, network: Network):
        self.network = network
        self.known = np.zeros(0, np.uint64)
        self.value = np.zeros((0, len(network.languages)), np.float32)

    def evidence(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mean log probabilities over each piece's positions."""
        h, first, back = np.unique(hashes(data, begin, end), return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, h)
        new = np.ones(len(h), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != h[inside]
        if new.any():
            if len(self.known) + new.sum() > REMEMBERED:
                self.known, self.value, new = self.known[:0], self.value[:0], np.ones(len(h), bool)
            low, high = begin[first[new]], end[first[new]]
            value = np.empty((len(low), self.value.shape[1]), np.float32)
            for rows, codes in by_length(data, low, high, RUN):
                value[rows] = self.network.positions(codes).mean(axis=1)
            merged = np.concatenate([self.known, h[new]])
            order = np.argsort(merged, kind="stable")
            self.known, self.value = merged[order], np.concatenate([self.value, value])[order]
            at = np.searchsorted(self.known, h)
        return self.value[at][back]


def _reader(network: Network) -> Reader:
    """One reader for each worker and network."""
    mark = zlib.crc32(b"".join(x.tobytes() for x in network.parameters()))
    return once("readers", mark, lambda: Reader(network))


def _has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def identify(docs: DataFrame, network: Network | None, key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row: whole texts.

    `und` with score 0 where the text is null or has no letter, and everywhere
    without a network. score is the document's probability of lang_pred. Ties
    go to the language that sorts first. Repeated rows and null keys keep
    their rows; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(key), held_out(key).alias("held_out"), utf8("text").alias("text"))
    if network is None:
        return rows.select(key, "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def label(batches):
        names = np.array([*network.languages, UNKNOWN])
        for batch in batches:
            for some in slices(batch, 2):
                best, score = _judged(network, some.column(2))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(names[best].tolist(), pa.string()), pa.array(score, pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(label, f"`{key}` {kind}, held_out boolean, lang_pred string, score double")


def _judged(network: Network, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's language number (the last one is unknown) and its probability."""
    data, at = raw(texts)
    begin, end, first = pieces(data, at)
    total = np.zeros((len(begin) + 1, len(network.languages)))
    if len(begin):
        np.cumsum(_reader(network).evidence(data, begin, end), axis=0, out=total[1:])
    pooled = total[first[1:]] - total[first[:-1]]
    pooled -= pooled.max(axis=1, keepdims=True)
    best, score = pooled.argmax(axis=1), 1 / np.exp(pooled).sum(axis=1)
    for i in np.flatnonzero(~_any_ascii_letter(data, at)):
        if not _has_letter(data[at[i] : at[i + 1]].tobytes()):
            best[i], score[i] = len(network.languages), 0
    return best, score


def with_language(docs: DataFrame, network: Network | None, least: float = 0.3) -> DataFrame:
    """The documents whose language is known with a probability of at least `least`; all of them without a network."""
    if network is None:
        return docs

    def keep(texts: pa.Array) -> np.ndarray:
        best, score = _judged(network, texts)
        return (best < len(network.languages)) & (score >= least)

    return kept_rows(docs, keep)


def _any_ascii_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(LETTER[data] & (data < 128))])
    return total[at[1:]] > total[at[:-1]]


def label_positions(docs: DataFrame, network: Network, key: str = "doc_id") -> DataFrame:
    """doc_id, runs: array of (start, end, lang) byte ranges of letters with the same label, in order.

    Null, empty and letterless texts have no runs.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), utf8("text").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def label(batches):
        for batch in batches:
            for some in slices(batch, 1, 1 << 20):
                data, at = raw(some.column(1))
                begin, end, _ = pieces(data, at)
                mark = np.full(len(data) + 1, -1, np.int16)
                for rows, codes in by_length(data, begin, end, RUN):
                    where = begin[rows, None] + np.arange(codes.shape[1] - 2)[None, :]
                    mark[where] = network.positions(codes).argmax(axis=2)
                out = []
                for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    own = mark[low:high]
                    cut = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(own)]]) if len(own) else np.zeros(1, int)
                    out.append(
                        [
                            {"start": int(a), "end": int(b), "lang": network.languages[own[a]]}
                            for a, b in zip(cut[:-1], cut[1:], strict=True)
                            if own[a] >= 0
                        ]
                    )
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(out, kind)], ["doc_id", "runs"])

    return rows.mapInArrow(label, "doc_id bigint, runs array<struct<start:bigint,end:bigint,lang:string>>")
