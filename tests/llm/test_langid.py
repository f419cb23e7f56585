import collections
import zlib

import numpy as np
import pyarrow as pa

from procsight.llm import langid, tables
from procsight.llm.queries import op10_language_id
from tests.conftest import SF
from tests.llm.frames import AWKWARD, docs


def test_backpropagation_through_time_gives_the_gradient():
    network = langid.Network(["a", "b", "c"], hidden=3, seed=1)
    for name in ("ahead", "back"):
        layer = getattr(network, name)
        layer.w, layer.u, layer.b = (x.astype(np.float64) for x in (layer.w, layer.u, layer.b))
    network.v, network.c = network.v.astype(np.float64), network.c.astype(np.float64)
    random = np.random.default_rng(2)
    codes = random.integers(97, 100, (4, 6)).astype(np.uint8)
    codes[:, 0] = codes[:, -1] = langid.BORDER
    labels = np.array([0, 1, 2, 1])
    _, grads = network.gradients(codes, labels)
    for x, g in zip(network.parameters(), grads, strict=True):
        for _ in range(6):
            at = tuple(random.integers(0, n) for n in x.shape)
            if x.shape[0] == 256:
                at = (int(random.integers(97, 100)), at[1])
            keep = x[at]
            x[at] = keep + 1e-3
            up = network.gradients(codes, labels)[0]
            x[at] = keep - 1e-3
            down = network.gradients(codes, labels)[0]
            x[at] = keep
            assert abs((up - down) / 2e-3 - g[at]) < 2e-4


def test_pieces_cover_all_letters():
    text = "ab1cd éé!" + "x" * 60 + " 12"
    data = np.frombuffer(text.encode(), np.uint8)
    begin, end, first = langid.pieces(data, np.array([0, len(data)]))
    covered = np.zeros(len(data), int)
    for a, b in zip(begin, end, strict=True):
        covered[a:b] += 1
    assert (covered == langid.LETTER[data]).all() and (end - begin).max() <= langid.PIECE
    assert first.tolist() == [0, len(begin)]


WORDS = {"xx": "the and with from there", "yy": "der und mit von dort", "zz": "çé ñó áü êî ôû"}


def rows(n=240):
    random = np.random.default_rng(4)
    out = []
    for i in range(n):
        lang = list(WORDS)[i % 3]
        out.append((i, " ".join(random.choice(WORDS[lang].split(), 8)).upper() if i % 5 == 0 and lang != "zz" else " ".join(random.choice(WORDS[lang].split(), 8)), lang))
    return out


def test_held_out_accuracy_and_awkward_rows(spark):
    own = rows()
    learned = docs(spark, own)
    network = langid.learn(learned)
    assert network.languages == ["xx", "yy", "zz"]
    held = [r for r in langid.identify(learned, network).collect() if r.held_out]
    assert len(held) > 40 and all(r.lang_pred == own[r.doc_id][2] for r in held)
    found = langid.identify(docs(spark, AWKWARD), network).collect()
    assert len(found) == len(AWKWARD)
    unknown = {r.doc_id for r in found if r.lang_pred == "und"}
    assert unknown == {1, 2, 3, 11}
    assert all(0 <= r.score <= 1 for r in found) and {r.score for r in found if r.lang_pred == "und"} == {0.0}
    left = langid.with_language(docs(spark, AWKWARD), network)
    assert left.columns == docs(spark, []).columns
    assert sorted(r.doc_id or -1 for r in left.collect()) == [-1, 4, 5, 6, 7, 8, 8, 9, 10, 12]
    # Remembered pieces and pieces run anew give the same.
    data = np.frombuffer(b"the dort the und", np.uint8)
    begin, end, _ = langid.pieces(data, np.array([0, len(data)]))
    reader = langid.Reader(network)
    a, b = reader.evidence(data, begin, end), reader.evidence(data, begin, end)
    assert np.array_equal(a, b) and np.allclose(a[0], a[2])
    direct = [network.positions(codes).mean(axis=1) for _, codes in langid.by_length(data, begin[:1], end[:1], 10)][0]
    assert np.allclose(a[0], direct[0], atol=1e-5)


def test_every_letter_is_labelled(spark):
    network = langid.Network(["a", "b"], seed=3)
    table = docs(spark, AWKWARD)
    text = {i: (t or "").encode() for i, t in AWKWARD}
    for r in langid.label_positions(table, network).collect():
        data = np.frombuffer(text[r.doc_id], np.uint8) if r.doc_id is not None else None
        if data is not None:
            mark = np.zeros(len(data), bool)
            for a, b, lang in r.runs:
                assert lang in ("a", "b") and not mark[a:b].any()
                mark[a:b] = True
            assert (mark == langid.LETTER[data]).all()


def test_without_rows_to_learn_from(spark):
    empty = docs(spark, [])
    assert langid.learn(empty) is None
    assert langid.identify(empty, None).count() == 0
    assert {r.lang_pred for r in langid.identify(docs(spark, AWKWARD), None).collect()} == {"und"}


def test_whole_table(spark):
    found = op10_language_id(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in found if r.held_out]
    assert len(found) == len(lang)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_every_piece_of_every_row_is_learned_from(spark, monkeypatch):
    """5,000 rows, each with a word of its own, in several parts: each word is there, frequent ones by their share."""
    rows = [(i, f"Common {letters(i)} words", "aa" if i % 2 else "bb") for i in range(5000)]
    kept = [i for i in range(5000) if zlib.crc32(str(i).encode()) % 4 != 2]
    seen, fit = [], langid.Network.fit
    monkeypatch.setattr(langid, "PART", 3000)
    monkeypatch.setattr(langid.Network, "fit", lambda self, parts: seen.append(parts.collect()) or fit(self, parts, 2))
    network, again = (langid.learn(docs(spark, rows), per_language=300) for _ in range(2))
    assert all(np.array_equal(x, y) for x, y in zip(network.parameters(), again.parameters(), strict=True))
    found = collections.Counter()
    for r in seen[0]:
        edge = np.concatenate([[0], np.cumsum(np.frombuffer(r.sizes, np.uint8), dtype=int)])
        label = np.frombuffer(r.labels, np.int32)
        assert len(label) == len(edge) - 1 == r.n
        found.update((network.languages[x], bytes(r.pieces[a:b])) for x, a, b in zip(label, edge[:-1], edge[1:], strict=True))
    assert len(seen[0]) == 2
    own = {("aa" if i % 2 else "bb", letters(i).encode()) for i in kept}
    assert set(found) == own | {(x, w) for x in ("aa", "bb") for w in (b"common", b"words")}
    assert all(found[x] == 1 for x in own) and {found[x] for x in set(found) - own} == {100}


def test_each_part_is_trained_once_an_epoch(spark, monkeypatch, tmp_path):
    """Two epochs over several parts: every part is trained once in each, and the states are averaged by their pieces."""
    rows = [(i, f"Common {letters(i)} words", "aa" if i % 2 else "bb") for i in range(3000)]
    log, train, fit, seen = str(tmp_path / "log"), langid._epoch, langid.Network.fit, []

    def logged(network, moments, rate, nth):
        epoch = train(network, moments, rate, nth)

        def counted(batches):
            for out in epoch(batches):
                with open(log, "a") as file:
                    file.write(f"{nth} {out.column(0)[0]}\n")
                yield out

        return counted

    monkeypatch.setattr(langid, "PART", 500)
    monkeypatch.setattr(langid, "_epoch", logged)
    monkeypatch.setattr(langid.Network, "fit", lambda self, parts: seen.extend(parts.collect()) or fit(self, parts, 2))
    network = langid.learn(docs(spark, rows), per_language=300)
    with open(log) as file:
        trained = sorted(tuple(map(int, x.split())) for x in file)
    assert len(seen) > 4 and trained == [(nth, p) for nth in range(2) for p in sorted(r.part for r in seen)]
    # The same on one machine.
    want = langid.Network(network.languages)
    moments = want.moments()
    for nth in range(2):
        state = [np.zeros(x.shape) for x in want.parameters() + moments]
        for r in seen:
            for out in train(want, moments, langid.RATE * (1 - nth / 2), nth)([pa.RecordBatch.from_pylist([r.asDict()])]):
                flat, at = np.frombuffer(out.column(3)[0].as_py(), np.float32), 0
                for x in state:
                    x += flat[at : at + x.size].reshape(x.shape) * r.n
                    at += x.size
        for x, y in zip(want.parameters() + moments, state, strict=True):
            x[...] = y / sum(r.n for r in seen)
    for x, y in zip(network.parameters(), want.parameters(), strict=True):
        assert np.allclose(x, y, atol=1e-4)


def letters(i):
    return "".join(chr(97 + int(x)) for x in f"{i:05d}")


def test_a_rare_language_stays_a_class(spark):
    """The bound holds for each language: one row in a thousand is no less learned from."""
    rows = [(i, f"common words of a text number {i}", "aa") for i in range(3000)] + [(5000 + i, "ÿÿÿ þþþ rare", "zz") for i in range(8)]
    network = langid.learn(docs(spark, rows), rows=50)
    assert network.languages == ["aa", "zz"]
    drawn = tables.bounded_by(docs(spark, rows), "lang", "doc_id", 50).groupBy("lang").count().collect()
    assert dict(map(tuple, drawn))["zz"] == 8 and 20 < dict(map(tuple, drawn))["aa"] < 90
    assert tables.bounded_by(docs(spark, []), "lang", "doc_id", 50).count() == 0
