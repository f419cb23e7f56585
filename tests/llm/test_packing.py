import zlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from procsight.llm import packing
from procsight.llm.queries import op8_packing, tokenizer_path
from tests.conftest import SF
from tests.llm.frames import AWKWARD, docs


def ids_by_row(rows):
    plain = Tokenizer.from_file(tokenizer_path())
    return [(i, [*plain.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows]


def check(found, rows, size):
    """Every id of every document lies in exactly one piece; sequences have no gap and are full but for the last."""
    want = defaultdict(list)
    for i, ids in ids_by_row(rows):
        want[i].append(ids)
    pieces = defaultdict(list)
    for r in found:
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(want)
    for i, own in pieces.items():
        if len(want[i]) == 1:
            ids, at = want[i][0], 0
            for r in sorted(own, key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids)
                part = b"".join(x.to_bytes(4, "little") for x in ids[at : at + r.length])
                assert r.ids_crc32 == zlib.crc32(part)
                at += r.length
            assert at == len(ids)
        else:
            assert sum(r.length for r in own) == sum(map(len, want[i]))
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for s, parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == size or s == len(sequences) - 1


def test_round_trip_of_awkward_rows(spark):
    rows = [(*r, "en", None if k % 3 == 0 else "a" if k % 2 else "") for k, r in enumerate(AWKWARD)]
    found = packing.pack(docs(spark, rows), tokenizer_path(), size=16, window=64).collect()
    check(found, AWKWARD, 16)


def test_round_trip_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(op8_packing(spark, SF).collect(), rows, 1024)


def test_windows_hold_the_mixture(spark):
    rows = [(i, "word " * 50, "en", "ab"[i % 4 == 0]) for i in range(400)]
    found = packing.pack(docs(spark, rows), tokenizer_path(), size=32, window=512).collect()
    tokens = defaultdict(lambda: defaultdict(int))
    for r in found:
        tokens[r.window][r.queue] += r.length
    last = max(tokens)
    for window, own in tokens.items():
        if window < last:
            assert abs(own["=a"] - 512 * 0.75) <= 1 and abs(own["=b"] - 512 * 0.25) <= 1


def test_targets_hold_until_a_queue_is_empty(spark):
    rows = [(i, "word " * 50, "en", "ab"[i % 2]) for i in range(200)]
    found = packing.pack(docs(spark, rows), tokenizer_path(), size=32, window=400, mixture={"a": 0.25, "b": 0.75}).collect()
    check(found, [r[:2] for r in rows], 32)
    tokens = defaultdict(lambda: defaultdict(int))
    for r in found:
        tokens[r.window][r.queue] += r.length
    assert tokens[0] == {"=a": 100, "=b": 300}
    assert set(tokens[max(tokens)]) == {"=a"}


def test_empty_table(spark):
    assert packing.pack(docs(spark, []), tokenizer_path()).count() == 0


def simulated(totals, weights, window):
    """Deficit round-robin, window by window, with fractions kept exactly."""
    left, deficit, sent, out = list(totals), [0] * len(totals), [0] * len(totals), []
    while any(left):
        live = sum(w for w, rest in zip(weights, left, strict=True) if rest)
        # Deficits are kept in parts of a token, `live` parts each; they are cleared when a queue has run empty.
        now = []
        for q, w in enumerate(weights):
            if not left[q]:
                now.append(0)
                continue
            deficit[q] += w * window
            take = min(left[q], deficit[q] // live)
            deficit[q] -= take * live
            now.append(take)
        emptied = [q for q in range(len(left)) if left[q] and now[q] == left[q]]
        left = [rest - t for rest, t in zip(left, now, strict=True)]
        sent = [s + t for s, t in zip(sent, now, strict=True)]
        if emptied:
            deficit = [0] * len(totals)
        out.append(list(sent))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 500), st.integers(1, 9)), min_size=1, max_size=5), st.integers(5, 60))
def test_formula_is_deficit_round_robin(queues, window):
    totals, weights = [t for t, _ in queues], [w for _, w in queues]
    plan = packing.Schedule(totals, weights, window)
    steps = simulated(totals, weights, window)
    assert [plan.after(r + 1) for r in range(plan.windows)] == steps
    # The pieces of each queue's tokens cover the stream once.
    places = []
    for q, t in enumerate(totals):
        for at in range(0, t, 7):
            places += [(p, n) for _, p, n in plan.pieces(q, at, min(7, t - at))]
    at = 0
    for p, n in sorted(places):
        assert p == at
        at += n
    assert at == sum(totals)
