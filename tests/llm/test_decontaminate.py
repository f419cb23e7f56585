import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from procsight.llm import decontaminate as dc
from procsight.llm.queries import op9_decontamination
from tests.conftest import SF
from tests.llm.frames import AWKWARD, docs


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=20), st.lists(st.integers(0, 5), max_size=20))
def test_common_subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert dc.Item(a).common(b) == best[-1][-1]


def test_every_word_lies_in_a_passage():
    first = np.concatenate([[0], np.cumsum([0, 1, 7, 8, 9, 31, 32, 33, 48, 49, 100, 0])])
    start, edge = dc.blocks_of(first)
    low, high, row = dc.windows_of(edge)
    seen = np.zeros(first[-1], int)
    for a, b, r in zip(low, high, row, strict=True):
        assert edge[r] <= a < b <= edge[r + 1] and b - a <= dc.LONG
        seen[start[a] : min(start[b - 1] + dc.BLOCK, first[r + 1])] += 1
    assert seen.min() >= 1 and seen.max() <= 2


def passages(seed, n, size=30):
    rnd = random.Random(seed)
    return [" ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(size)) for _ in range(n)]


def test_axes_are_those_of_the_whole_matrix(spark):
    texts = passages(1, 40, 20)
    h, _ = dc._hash_rows(pa.array([t.encode() for t in texts]))
    known = dc.Vocabulary(np.unique(h), np.ones(dc.BUCKETS))
    axes = dc.latent_axes(spark.createDataFrame([(t.encode(), 1.0) for t in texts], "text binary, weight double").repartition(4), known, 40)
    matrix = np.zeros((40, len(known)))
    for i, t in enumerate(texts):
        h, _ = dc._hash_rows(pa.array([t.encode()]))
        np.add.at(matrix[i], known.rows(h), 1)
        matrix[i] /= np.sqrt(20)
    # All of the matrix' rows lie in the span of its leading axes.
    assert np.allclose(matrix @ axes @ axes.T, matrix, atol=1e-3)


def test_block_sums_pass_over_unknown_words():
    random = np.random.default_rng(3)
    known = dc.Vocabulary(np.arange(50, dtype=np.uint64) << np.uint64(40), np.ones(dc.BUCKETS))
    first = np.concatenate([[0], np.cumsum(random.integers(0, 40, 300))])
    row = random.integers(0, 51, first[-1])
    row[first[7] : first[30]] = 50
    start, _ = dc.blocks_of(first)
    matrix = random.standard_normal((50, 5)).astype(np.float32)
    want = [np.vstack([matrix, np.zeros(5)])[own].sum(axis=0) for own in np.split(row, start[1:])]
    assert np.allclose(dc.projected(*known.inside(row, start), matrix), want, atol=1e-4)


def test_axes_are_fitted_on_every_document(spark, monkeypatch):
    """4,000 documents, each with two of the benchmark's words: all enter the matrix, and together weigh as MASS do."""
    own = passages(8, 1, 60)[0].split()
    rows = [(i if i % 9 else None, " ".join(own[i % 15 * 2 :][:2])) for i in range(4000)]
    seen, fit = [], dc.latent_axes

    def fitted(passages, known, axes):
        seen.append((passages.collect(), known, fit(passages, known, 20)))
        return seen[-1][2]

    monkeypatch.setattr(dc, "latent_axes", fitted)
    dc._parts(docs(spark, rows), spark.createDataFrame([(1, " ".join(own))], "item_id bigint, text string"))
    ((used, known, axes),) = seen
    assert sorted(bytes(r.text).decode() for r in used) == sorted([t for _, t in rows] + [" ".join(own)])
    assert np.isclose(sum(r.weight**2 for r in used), dc.MASS + dc.WEIGHT**2)
    matrix = []
    for r in used:
        h, first = dc._hash_rows(pa.array([bytes(r.text)]))
        for low in range(0, max(1, len(h) - dc.WORDS // 2), dc.WORDS // 2):
            word = known.rows(h[low : low + dc.WORDS])
            line = np.bincount(word, minlength=len(known)) * known.weights()
            matrix.append(r.weight * line / np.linalg.norm(known.weights()[word]))
    gram = np.array(matrix).T @ np.array(matrix)
    best = np.sort(np.linalg.eigvalsh(gram))[::-1][:20].sum()
    assert np.trace(axes.T @ gram @ axes) > 0.999 * best


def planted():
    rnd = random.Random(9)
    items = passages(2, 8, 40) + passages(3, 4, 12)
    rows = []
    for i in range(120):
        words = passages(100 + i, 1, rnd.randint(5, 200))[0].split()
        if i % 4 == 0:
            own = items[i // 4 % 12].split()
            if i % 8 == 0:
                # A paraphrase: some words go or change, the closing words stay.
                own = [w if k >= len(own) - 4 or k % 5 else "other" for k, w in enumerate(own)]
            at = rnd.randint(0, len(words))
            words[at:at] = own
        elif i % 4 == 1:
            # Some words of an item are no leak.
            words += items[i % 12].split()[:5]
        rows.append((i, " ".join(words)))
    return items, rows


def plain(items, rows):
    out = set()
    for i, t in rows:
        text = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
        for j, item in enumerate(items):
            words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (item or "").lower())
            span = 2 * len(words) + dc.WORDS
            for k in range(0, max(1, len(text)), dc.BLOCK):
                near = text[max(0, k - span // 2) : k + span // 2]
                if words and dc.Item(words).judge(near)[2]:
                    out.add((i, j))
    return out


def test_planted_passages_against_all_windows(spark):
    items, rows = planted()
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    found = dc.leaks(docs(spark, rows), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == plain(items, rows) == {(i, i // 4 % 12) for i in range(0, 120, 4)}
    clean = dc.without_leaks(docs(spark, rows + AWKWARD[:1]), benchmark)
    assert clean.columns == docs(spark, []).columns and clean.count() == 91


def test_awkward_rows_and_parts(spark, monkeypatch):
    monkeypatch.setattr(dc, "PART_WORDS", 20)
    items = [(1, None), (2, ""), (3, "..."), (None, "one two three four five"), (4, "one two three four five"), (5, "one two three four five")]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, doc_id string")
    found = dc.leaks(docs(spark, AWKWARD), benchmark).collect()
    want = [(i, j) for i in (6, 7, 8, 8) for j in (4, 5)]
    assert sorted((r.doc_id, r.item_id) for r in found) == sorted(want)
    assert dc.leaks(docs(spark, []), benchmark).count() == 0
    assert dc.leaks(docs(spark, AWKWARD), benchmark.where("false")).count() == 0


def test_whole_table(spark):
    documents = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = {(r.doc_id, r.item_id) for r in op9_decontamination(spark, SF).collect()}
    assert {(i, j) for i, t in documents for j, b in benchmark if b in t} <= found
    for i, j in found:
        assert dict(benchmark)[j].split()[-4:][0] in dict(documents)[i]


def many_items():
    """1,203 items without any word in common, and documents that hold 400 of them, verbatim or changed."""
    rnd = random.Random(4)
    items = passages(5, 1000, 24) + passages(6, 200, 60) + ["one", "one two", "one two three four"]
    rows, want = [], set()
    for i in range(0, 1200, 3):
        own = items[i].split()
        if i % 2:
            # Every fourth word is another one; the closing words stay.
            own = [w if k >= len(own) - 4 or k % 4 else f"new{k}" for k, w in enumerate(own)]
        words = passages(10_000 + i, 1, rnd.randint(100, 300))[0].split()
        at = rnd.randint(0, len(words))
        rows.append((i, " ".join([*words[:at], *own, *words[at:]])))
        want.add((i, i))
    rows.append((5000, "begin one two three four end"))
    want |= {(5000, i) for i in (1200, 1201, 1202)}
    return items, rows, want


def test_no_leak_depends_on_the_axes(spark):
    """1,200 items need more axes than there are; every verbatim or changed item is found all the same."""
    items, rows, want = many_items()
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in dc.leaks(docs(spark, rows), benchmark).collect()} == want


def test_the_cosine_alone_finds_nine_in_ten(spark, monkeypatch):
    """Without the index, the latent search must reach 0.9 of all leaks and of the changed ones."""
    monkeypatch.setattr(dc.Index, "ranges", lambda *_: ())
    items, rows, want = many_items()
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in dc.leaks(docs(spark, rows), benchmark).collect()}
    changed = {(i, j) for i, j in want if i % 2 and i < 1200}
    print("recall of the cosine", len(found & want) / len(want), len(found & changed) / len(changed))
    assert found <= want and len(found & want) >= 0.9 * len(want) and len(found & changed) >= 0.9 * len(changed)


def test_reworded_items_are_found_by_the_cosine_alone(spark, monkeypatch):
    """Other closing words and one word in five replaced: no rule of the index reaches them."""
    rnd = random.Random(12)
    items = passages(7, 300, 40)
    rows = []
    for i, t in enumerate(items):
        own = [w if k % 5 != 2 else f"new{k}" for k, w in enumerate(t.split())]
        own[-6], own[-4:] = "extra", [own[-3], own[-4], own[-1], own[-2]]
        words = passages(20_000 + i, 1, 200)[0].split()
        at = rnd.randint(0, len(words))
        rows.append((i, " ".join([*words[:at], *own, *words[at:]])))
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    found = {(r.doc_id, r.item_id): r.answer for r in dc.leaks(docs(spark, rows), benchmark).collect()}
    assert set(found) <= {(i, i) for i in range(300)} and len(found) >= 270 and not any(found.values())
    monkeypatch.setattr(dc, "COSINE", 9.0)
    assert dc.leaks(docs(spark, rows), benchmark).count() == 0


def test_words_of_all_documents_still_weigh(spark):
    """Where every document holds the item, its words are in all documents and the item is found by the cosine too."""
    text = passages(3, 1, 30)[0]
    benchmark = spark.createDataFrame([(1, text)], "item_id bigint, text string")
    found = dc.leaks(docs(spark, [(i, text) for i in range(4)]), benchmark).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(i, 1) for i in range(4)] and min(r.cosine for r in found) > 0.99


def test_ranges_hold_every_leaking_window():
    rnd = random.Random(8)
    items = [" ".join(rnd.choice("abcdefghijklmnopqrst") for _ in range(rnd.randint(1, 40))) for _ in range(60)]
    texts = [" ".join(rnd.choice("abcdefghijklmnopqrst") for _ in range(rnd.randint(0, 200))) for _ in range(20)]
    texts += [f"{a} {b} {c}" for a, b, c in zip(texts, items, texts[1:], strict=False)]
    ih, ifirst = dc._hash_rows(pa.array([x.encode() for x in items]))
    h, first = dc._hash_rows(pa.array([x.encode() for x in texts]))
    start, edge = dc.blocks_of(first)
    low, high, row = dc.windows_of(edge)
    low, high = start[low], np.minimum(start[high - 1] + dc.BLOCK, first[1:][row])
    index = dc.Index(ih, ifirst, np.random.default_rng(1).random(dc.BUCKETS))
    listed = {(j, at) for j, a, b, _ in index.ranges(h, first, low, high, row) for at in range(a, b)}
    leaking = set()
    for j, (a, b) in enumerate(zip(ifirst[:-1], ifirst[1:], strict=True)):
        item = dc.Item(ih[a:b].tolist())
        for at in range(len(low)):
            around = h[max(first[row[at]], low[at] - item.n) : min(first[row[at] + 1], high[at] + item.n)]
            if item.judge(around.tolist())[2]:
                leaking.add((j, at))
    assert leaking and leaking <= listed


def test_clean_rows_stay_whatever_their_key(spark):
    items, rows = planted()
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    for one in (None, 7):
        clean = dc.without_leaks(docs(spark, [(one, t) for _, t in rows]), benchmark)
        assert sorted(r.text for r in clean.collect()) == sorted(t for i, t in rows if i % 4)
