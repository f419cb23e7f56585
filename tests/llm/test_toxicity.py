import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from procsight.llm import toxicity
from procsight.llm.queries import op3_toxicity
from tests.conftest import SF
from tests.llm.frames import AWKWARD, docs


def plain_segments(scores, low=0, high=None):
    """By definition: the segment of the highest sum, then the same to its left and right."""
    high = len(scores) if high is None else high
    best = max(((sum(scores[a:b]), -(b - a), -a, a, b) for a in range(low, high) for b in range(a + 1, high + 1)), default=(0,))
    if best[0] <= 1e-9:
        return []
    _, _, _, a, b = best
    return [*plain_segments(scores, low, a), (a, b, sum(scores[a:b])), *plain_segments(scores, b, high)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.floats(-5, 5).filter(lambda x: abs(x) > 1e-3), max_size=14))
def test_segments_are_those_of_the_definition(scores):
    # Small distinct shares keep sums from being equal.
    scores = [s + 1e-5 * (i + 1) ** 0.5 for i, s in enumerate(scores)]
    found, want = toxicity.segments(scores), plain_segments(scores)
    assert [x[:2] for x in found] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in found], [x[2] for x in want])


def test_segments_take_linear_time():
    random.seed(1)
    scores = [random.uniform(-1, 1.01) for _ in range(200_000)]
    assert toxicity.segments(scores)
    assert toxicity.segments([1.0] * 100_000) == [(0, 100_000, 100_000.0)]
    assert len(toxicity.segments([1.0, -2.0] * 100_000)) == 100_000


def labelled(spark, n=600):
    rnd = random.Random(2)
    common, bad = [f"w{i}" for i in range(60)], ["vile", "nasty", "foul"]
    rows, labels = [], []
    for i in range(n):
        words = [rnd.choice(common) for _ in range(rnd.randint(5, 80))]
        toxic = i % 7 == 0
        if toxic:
            at = rnd.randrange(len(words))
            words[at:at] = [rnd.choice(bad) for _ in range(4)]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_rows_are_told_apart_and_passages_found(spark):
    rows, labels = labelled(spark)
    table = docs(spark, rows)
    found = toxicity.score(table, toxicity.learn(table, labels)).collect()
    text = dict(rows)
    assert len(found) == len(rows)
    held = [r for r in found if r.held_out]
    assert 100 < len(held) < 200
    assert all(r.predicted == (r.doc_id % 7 == 0) for r in held)
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        if r.doc_id % 7 == 0:
            spans = " ".join(text[r.doc_id][p.start : p.end] for p in r.passages)
            assert sum(spans.split().count(w) for w in ("vile", "nasty", "foul")) == 4


def test_awkward_rows_and_labels(spark):
    rows, labels = labelled(spark, 200)
    table = docs(spark, [(i + 1000, t) for i, t in rows] + AWKWARD)
    shifted = labels.selectExpr("doc_id + 1000 as doc_id", "quality", "toxic")
    odd = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 1, 1), (2, 1, 0), (99999, 1, 1)], shifted.schema)
    model = toxicity.learn(table, shifted.union(odd))
    found = toxicity.score(docs(spark, AWKWARD), model).collect()
    assert len(found) == len(AWKWARD)
    none = {r.score for r in found if r.doc_id in (1, 2, 3)}
    assert len(none) == 1 and not any(r.passages for r in found)
    clean = toxicity.without_toxic(table, model)
    assert clean.columns == table.columns
    assert sum(r.doc_id is None or r.doc_id < 1000 for r in clean.collect()) == len(AWKWARD)


def test_without_labels_or_rows(spark):
    rows, labels = labelled(spark, 30)
    table = docs(spark, rows)
    none = toxicity.learn(table, labels.where("false"))
    assert {r.predicted for r in toxicity.score(table, none).collect()} == {0}
    assert toxicity.score(docs(spark, []), none).count() == 0
    assert toxicity.score(docs(spark, []), toxicity.learn(docs(spark, []), labels)).count() == 0


def test_all_labelled_rows_are_learned_from(spark, monkeypatch):
    """24,000 labelled rows; two words come up in every seventh of them, each in few other rows: all enter the counts."""
    rows = [(i, "plain word" if i % 7 else "plain vile" if i % 2 else "plain foul") for i in range(32_000)]
    labels = spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i, _ in rows], "doc_id bigint, quality int, toxic int")
    table = docs(spark, rows)
    learned = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    toxic = [i for i in learned if i % 7 == 0]
    seen, fit, sums = [], toxicity._logistic, toxicity._counts
    monkeypatch.setattr(toxicity, "_counts", lambda train: seen.append(sorted(sums(train).drop("h").collect())) or sums(train))
    monkeypatch.setattr(toxicity, "_logistic", lambda points, share: seen.append((points.collect(), fit(points, share))) or seen[-1][1])
    models = [toxicity.learn(table, labels)]
    foul = sum(i % 2 == 0 for i in toxic)
    n, k = len(learned), len(toxic)
    assert len(learned) > 23_000
    assert [tuple(r) for r in seen[0]] == sorted([(k, n - k, k, n - k), (0, n - k, 0, n - k), (foul, 0, foul, 0), (k - foul, 0, k - foul, 0)])
    points, (base, slope) = seen[1]
    assert len(points) == n and sum(r.y for r in points) == k
    # The gradient of the penalised likelihood is zero there.
    x, y = np.array([r.x for r in points]), np.array([r.y for r in points])
    left = y - 1 / (1 + np.exp(-base - slope * x))
    assert abs(left.sum()) < 1e-4 and abs((left * x).sum() - 0.1 * slope) < 1e-4
    # Joined by a shuffle, the labels give the same model.
    monkeypatch.setattr(toxicity, "BROADCAST_ROWS", 10)
    models.append(toxicity.learn(table, labels))
    assert (models[0].words == models[1].words).all() and np.isclose(models[0].base, models[1].base) and np.isclose(models[0].slope, models[1].slope)


def test_labels_of_held_out_rows_change_nothing(spark):
    rows, labels = labelled(spark, 200)
    table = docs(spark, rows)
    flipped = labels.selectExpr("doc_id", "quality", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 1 - toxic, toxic) as toxic")
    a, b = toxicity.learn(table, labels), toxicity.learn(table, flipped)
    assert (a.words == b.words).all() and np.allclose(a.scores, b.scores) and np.isclose(a.base, b.base)


def test_whole_table(spark):
    found = op3_toxicity(spark, SF)
    assert found.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert found.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
