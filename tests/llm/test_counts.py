import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from procsight.llm import counts
from procsight.llm.encode import Encoder
from procsight.llm.queries import tokenizer_path
from tests.conftest import SF
from tests.llm.frames import AWKWARD, docs


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(tokenizer_path())


def expected(plain, text):
    return len(plain.encode(text or "", add_special_tokens=False).ids)


def test_encoder_gives_the_library_s_ids(plain):
    rnd = random.Random(3)
    letters = "ab ABé'stremdvl 0123½²_-.,!\n\t\r\x0b\x1c\x85\xa0 漢字\U0001f600 　​ªⅣ٣"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    texts += [f"{t}<|endoftext|>{t}" for t in texts[:30]]
    encoder = Encoder(tokenizer_path())
    for k in range(0, len(texts), 500):
        for t, ids in zip(texts[k : k + 500], encoder.ids(texts[k : k + 500]), strict=True):
            assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == plain.encode(t, add_special_tokens=False).ids


def test_a_whole_column_has_the_library_s_ids(plain, monkeypatch):
    """Words are cut in Arrow's buffer, 500 rows at a time: borders, contractions, runs of spaces, characters of 1 to 4 bytes."""
    rnd = random.Random(5)
    letters = "ab ABé''stremdvl 0123½²_-.,!\n\t\r\x0b\x1c\x85\xa0 漢字\U0001f600\u3000\u200b\u2028ªⅣ٣"
    parts = ["'s", "'ll", "'re", "'ve", " 's", "\n's", "'" + "'s", "'", "'l", "  ", "\u3000\u3000", "<|endoftext|>", "<|endof", "text|>"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(rnd.choice([*parts, rnd.choice(letters)]) for _ in range(rnd.randint(0, 9))) for _ in range(3000)]
    plain_letters = [x for x in letters if x not in "\x1c½²ⅣªÄ"]
    texts += ["".join(rnd.choice([*parts[:11], *plain_letters]) for _ in range(rnd.randint(0, 12))) for _ in range(6000)]
    rnd.shuffle(texts)
    encoder, whole = Encoder(tokenizer_path()), []
    monkeypatch.setattr(encoder, "whole", lambda t: whole.append(t) or Encoder.whole(encoder, t))
    for k in range(0, len(texts), 500):
        some = texts[k : k + 500]
        for t, ids in zip(some, encoder.column(pa.array([t.encode() for t in some], pa.binary()), b"end!").to_pylist(), strict=True):
            assert ids[-4:] == b"end!"
            assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids) - 4, 4)] == plain.encode(t, add_special_tokens=False).ids, t
    assert 0 < len(whole) < len(texts) / 2
    # Sliced columns, empty ones, and bytes that are no UTF-8.
    assert encoder.column(pa.array([b"x", b"", b"a b", b"c"], pa.binary()).slice(1, 2)).to_pylist() == encoder.ids(["", "a b"])
    assert encoder.column(pa.array([], pa.binary()), b"e").to_pylist() == []
    assert encoder.column(pa.array([b"", b""], pa.binary()), b"e").to_pylist() == [b"e", b"e"]
    assert encoder.column(pa.array([b"a\xff b"], pa.binary())).to_pylist() == encoder.ids(["a\ufffd b"])


def test_encoder_forgets_and_stays_right(plain, monkeypatch):
    monkeypatch.setattr("procsight.llm.encode.REMEMBERED", 50)
    encoder = Encoder(tokenizer_path())
    for k in range(20):
        texts = [f"common words and w{i}x{k}" for i in range(20)]
        assert [len(x) // 4 for x in encoder.ids(texts)] == [expected(plain, t) for t in texts]


def test_counts_of_awkward_rows(spark, plain, tmp_path):
    table = docs(spark, AWKWARD)
    found = counts.token_counts(table, str(tmp_path / "cache"), tokenizer_path(), limit=4).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    want = [(i, len((t or "").encode()), expected(plain, t), expected(plain, t) > 4) for i, t in AWKWARD]
    assert sorted([tuple(r)[:4] for r in found], key=key) == sorted(want, key=key)


def test_cache_keeps_counts_and_takes_only_misses(spark, tmp_path):
    cache = str(tmp_path / "cache")
    first = docs(spark, [(1, "a b"), (2, "a b"), (3, "c")])
    counts.token_counts(first, cache, tokenizer_path()).collect()
    assert spark.read.parquet(cache).count() == 2
    # A stored count is used as it is: a changed one shows that the text isn't encoded again.
    marked = spark.read.parquet(cache).withColumn("n_tokens", F.col("n_tokens") + 100).collect()
    spark.createDataFrame(marked, counts.CACHE).write.parquet(str(tmp_path / "marked"))
    second = docs(spark, [(4, "c"), (5, "new text"), (6, None)])
    found = {r.doc_id: r.n_tokens for r in counts.token_counts(second, str(tmp_path / "marked"), tokenizer_path()).collect()}
    assert found == {4: 101, 5: 2, 6: 0}
    assert spark.read.parquet(str(tmp_path / "marked")).count() == 4


def test_empty_table(spark, tmp_path):
    assert counts.token_counts(docs(spark, []), str(tmp_path / "c"), tokenizer_path()).count() == 0


def test_whole_table_against_the_library(spark, plain, tmp_path):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in table.select("doc_id", "text").collect()}
    for r in counts.token_counts(table, str(tmp_path / "c"), tokenizer_path()).collect():
        assert r.n_tokens == expected(plain, texts[r.doc_id]) and r.n_bytes == len(texts[r.doc_id].encode())
