import re
from itertools import combinations

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from procsight.llm import simhash
from procsight.llm.components import components
from procsight.llm.queries import op1_simhash_near_dedup
from tests.conftest import SF
from tests.llm.frames import AWKWARD, docs


def plain_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(marks, budget=2):
    """The least key reachable for each row, by all pairs."""
    values = sorted({f for _, f in marks})
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in combinations(values, 2):
        if (a ^ b).bit_count() <= budget:
            parent[find(b)] = find(a)
    least = {}
    for key, f in marks:
        if key is not None:
            least[find(f)] = min(least.get(find(f), key), key)
    return sorted((key is None, key or 0, f, least.get(find(f))) for key, f in marks)


def rows_of(found):
    return sorted((r.doc_id is None, r.doc_id or 0, int(r.fingerprint, 16), r.component_id) for r in found)


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 100)
    marks = [(i, plain_fingerprint(t)) for i, t in AWKWARD]
    assert rows_of(simhash.near_duplicates(docs(spark, AWKWARD)).collect()) == plain_components(marks)


def test_whole_table(spark):
    marks = [(r.doc_id, plain_fingerprint(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows_of(op1_simhash_near_dedup(spark, SF).collect()) == plain_components(marks)


def test_links_are_all_pairs_within_the_budget(spark):
    random = np.random.default_rng(5)
    center = random.integers(-(2**63), 2**63, 3)
    flips = [np.int64(0)] + [np.bitwise_xor.reduce(np.left_shift(np.int64(1), random.integers(0, 64, 3))) for _ in range(60)]
    values = {int(c ^ f) for c in center for f in flips} | {0, -1, 1, 3, 7}
    found = simhash.links(spark.createDataFrame([(v,) for v in values], "fp bigint"), 2).collect()
    mask = (1 << 64) - 1
    want = {
        frozenset((a, b)): ((a ^ b) & mask).bit_count()
        for a, b in combinations(values, 2)
        if ((a ^ b) & mask).bit_count() <= 2
    }
    assert len(found) == len(want) and {frozenset((r.a, r.b)): r.d for r in found} == want


def test_one_row_of_each_group_stays(spark):
    table = docs(spark, AWKWARD)
    found = simhash.without_near_duplicates(table)
    assert found.columns == table.columns
    marks = [(i, plain_fingerprint(t)) for i, t in AWKWARD if i is not None]
    want = sorted({c for _, key, _, c in plain_components(marks) if key == c})
    assert sorted(r.doc_id for r in found.collect() if r.doc_id is not None) == want
    assert sum(r.doc_id is None for r in found.collect()) == 1


def test_empty_table(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components(spark, pairs):
    found = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    parent = {}
    for a, b in pairs:
        if a != b:
            group = {a, b} | {x for x, p in parent.items() if p in (parent.get(a, a), parent.get(b, b))}
            parent |= dict.fromkeys(group, min(min(group), *(parent.get(x, x) for x in group)))
    assert found == parent


def test_long_chain(spark):
    chain = spark.range(300).selectExpr("id as a", "id + 1 as b")
    assert {r.root for r in components(chain).collect()} == {0}
