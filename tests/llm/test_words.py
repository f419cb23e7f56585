import re

import numpy as np
import pyarrow as pa

from procsight.llm import words


def column(texts):
    return pa.array([t.encode() for t in texts], pa.binary())


def test_spans_are_the_words_of_each_row():
    texts = ["", "a bc, d", "é-x", "  ", "end", "next", "12ab!cd"]
    data, at = words.raw(column(texts))
    begin, end, first = words.spans(data, at)
    for i, t in enumerate(texts):
        own = [data[a:b].tobytes() for a, b in zip(begin[first[i] : first[i + 1]], end[first[i] : first[i + 1]], strict=True)]
        assert own == re.findall(rb"[0-9A-Za-z\x80-\xff]+", t.encode())


def test_hashes_name_words_whatever_their_place(monkeypatch):
    texts = ["The cat", "the", "a cat the THE", "x" * 5000, "cat"]
    data, at = words.raw(column(texts))
    begin, end, _ = words.spans(data, at)
    h = words.hashes(data, begin, end)
    monkeypatch.setattr(words, "BLOCK", 7)
    assert (h == words.hashes(data, begin, end)).all()
    names = [data[a:b].tobytes().lower() for a, b in zip(begin, end, strict=True)]
    assert len(set(h.tolist())) == len(set(names))
    assert len(set(zip(h.tolist(), names, strict=True))) == len(set(names))


def test_sliced_and_empty_columns():
    whole = column(["ab", "cd ef", "gh"])
    data, at = words.raw(whole.slice(1, 2))
    assert data.tobytes() == b"cd efgh" and at.tolist() == [0, 5, 7]
    data, at = words.raw(column([]))
    begin, end, first = words.spans(data, at)
    assert len(begin) == len(end) == 0 and first.tolist() == [0]
    batch = pa.RecordBatch.from_arrays([whole], ["t"])
    assert [len(x) for x in words.slices(batch, 0, 3)] == [1, 1, 1]
    assert np.concatenate([x.column(0).to_pylist() for x in words.slices(batch, 0, 100)]).tolist() == [b"ab", b"cd ef", b"gh"]
