import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from procsight.llm import order, spotsigs
from procsight.llm.queries import op11_document_fingerprints
from tests.conftest import SF
from tests.llm.frames import AWKWARD, docs


def plain_tokens(text, common):
    """The signature set of one text, word by word."""
    data = pa.array([text.encode()], pa.binary())
    raw, at = spotsigs.raw(data)
    begin, end, _ = spotsigs.spans(raw, at)
    h = [int(x) for x in spotsigs.hashes(raw, begin, end)]
    mask = (1 << 64) - 1
    mix = lambda x: int(spotsigs._mixed(np.array([x & mask], np.uint64))[0])
    is_common = [x in common for x in h]
    content = [i for i, c in enumerate(is_common) if not c]
    found, last = [], -1
    anchors = [(-1, int(spotsigs._START))]
    for i, x in enumerate(h):
        if is_common[i] or (i - last > spotsigs.GAP and mix(x) % spotsigs.ONE_IN == 0):
            anchors.append((i, mix(x)))
        if is_common[i]:
            last = i
    for i, value in anchors if h else []:
        chain = [j for j in content if j > i][: spotsigs.CHAIN]
        if chain:
            for step in range(spotsigs.CHAIN):
                value = value * int(spotsigs._MIX) & mask
                if step < len(chain):
                    value = (value + h[chain[step]]) & mask
            found.append(mix(value))
    out = set()
    for x in set(found):
        for nth in range(found.count(x)):
            out.add(mix(x + nth * int(spotsigs._AGAIN)) if nth else x)
    if not out:
        import xxhash

        out = {xxhash.xxh64_intdigest(np.array(h, np.uint64).tobytes() if h else b"\0" + text.encode())}
    return out


def expected(rows, common):
    """RESULT by a plain loop over all rows in order."""
    import xxhash

    place = lambda r: (r[0] is not None, r[0] or 0, r[2])
    ordered = sorted(((i, t or "", h) for i, t, h in rows), key=place)
    out = []
    for k, (i, text, _) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        n = len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        own, new, other = (plain_tokens(t, common) for t in (text, edited, after))
        jaccard = lambda a, b: len(a & b) / len(a | b)
        name = lambda s: xxhash.xxh3_128_hexdigest(np.array(sorted(s), np.uint64).tobytes())
        out.append((i, n, hashlib.sha256(edited.encode()).hexdigest(), name(own), name(new), jaccard(own, new), jaccard(own, other), len(own)))
    return out


def hashed(spark, rows):
    """The rows with the hash by which rows of equal keys are ordered."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return [tuple(r) for r in df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")).cast("binary"))).collect()]


def prose(seed, n, words=60):
    rnd = random.Random(seed)
    lexicon = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(400)] + ["the", "of", "and"] * 60
    return [(i, " ".join(rnd.choice(lexicon) for _ in range(rnd.randint(0, words)))) for i in range(n)]


KEY = lambda r: (r[0] is not None, r[0] or 0, *r[1:4])


@pytest.mark.parametrize("bytes_", [order.BUCKET_BYTES, 400])
def test_fingerprints_against_a_plain_loop(spark, monkeypatch, bytes_):
    """One bucket and many; null and repeated keys, repeated rows, empty, wordless and long texts."""
    monkeypatch.setattr(order, "BUCKET_BYTES", bytes_)
    monkeypatch.setattr(order, "PIECE", 300)
    rows = prose(1, 150) + [(1000 + i, t) for i, t in AWKWARD if i] + [(None, "the first of all"), (None, None), (70, "the other text of seventy")]
    rows += [rows[3]] * 40
    common = spotsigs.common_words(docs(spark, rows))
    found = spotsigs.fingerprints(docs(spark, rows)).collect()
    want = expected(hashed(spark, rows), set(common.tolist()))
    assert sorted((tuple(r) for r in found), key=KEY) == sorted(want, key=KEY)


def test_lone_rows_and_none(spark):
    assert spotsigs.fingerprints(docs(spark, [])).count() == 0
    (r,) = spotsigs.fingerprints(docs(spark, [(5, "the cat sat on the mat")])).collect()
    assert r.near_next == 1 and r.n_chars == 22
    assert spotsigs.near_duplicates(docs(spark, [])).count() == 0


def test_common_words_are_those_of_a_share(spark):
    rows = [(i, "the cat of the house " + " ".join(f"w{i}x{j}" for j in range(50))) for i in range(20)]
    common = spotsigs.common_words(docs(spark, rows), share=0.01)
    data, at = spotsigs.raw(pa.array([b"the cat of house w1x1"], pa.binary()))
    begin, end, _ = spotsigs.spans(data, at)
    assert [x in common for x in spotsigs.hashes(data, begin, end)] == [True, True, True, True, False]
    assert len(spotsigs.common_words(docs(spark, rows), share=0.5)) == 0


def test_an_insertion_moves_few_signatures():
    """Signatures hang on the words around them: an insertion leaves the rest as it is, with and without common words."""
    rnd = random.Random(3)
    for common_word in ("the", "zzz"):
        words = ["the" if common_word == "the" and k % 7 == 0 else "".join(rnd.choice("abcdefgh") for _ in range(6)) for k in range(400)]
        data, at = spotsigs.raw(pa.array([b"the"], pa.binary()))
        common = spotsigs.hashes(data, *spotsigs.spans(data, at)[:2])
        other = [*words[:100], "inserted", "words", *words[100:]]
        value, edge = spotsigs.signatures(pa.array([" ".join(words).encode(), " ".join(other).encode()], pa.binary()), common)
        assert spotsigs.likeness(value[: edge[1]], value[edge[1] :]) > 0.9


def copies(seed):
    """Groups of texts of which some words change, one of them large, among texts that stand alone."""
    rnd = random.Random(seed)
    rows = []
    for group, size in enumerate([2, 3, 5, 40, *[1] * 60]):
        base = prose(seed * 100 + group, 1, 1)[0][1].split() + [w for _, t in prose(seed * 100 + group, 6, 80) for w in t.split()]
        for _ in range(size):
            own = list(base)
            for _ in range(rnd.randint(0, 6)):
                own[rnd.randrange(len(own))] = "changed%d" % rnd.randint(0, 10**6)
            rows.append((len(rows) * 3, " ".join(own)))
    rnd.shuffle(rows)
    return rows + [(None, rows[0][1]), (1, rows[0][1]), (2, None), (4, ""), (5, "one"), (6, "two")]


def brute_classes(rows, common, least):
    sets = [frozenset(plain_tokens(t or "", common)) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    names = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            names[find(i)] = min(key, names.get(find(i), key))
    return sorted(((key, names.get(find(i))) for i, (key, _) in enumerate(rows)), key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("rounds", [0, 2])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, rounds):
    monkeypatch.setattr(spotsigs, "ROUNDS", rounds)
    rows = copies(5)
    common = set(spotsigs.common_words(docs(spark, rows)).tolist())
    found = sorted(((r.doc_id, r.class_id) for r in spotsigs.near_duplicates(docs(spark, rows)).collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    want = brute_classes(rows, common, spotsigs.LEAST)
    assert found == want
    assert 5 < len({c for _, c in want}) < len(want) - 10


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    table = spark.read.parquet(f"{SF}/documents.parquet")
    common = set(spotsigs.common_words(table).tolist())
    found = op11_document_fingerprints(spark, SF).collect()
    want = expected(hashed(spark, rows), common)
    assert sorted((tuple(r) for r in found), key=KEY) == sorted(want, key=KEY)
    by_text = {}
    for r in found:
        by_text.setdefault(dict(rows)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
