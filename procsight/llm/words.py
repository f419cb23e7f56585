"""Words of many texts at once, as numpy arrays over the Arrow buffer."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from procsight.llm.memory import give_back, remembered

#: Bytes hashed at a time.
BLOCK = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: A-Z become a-z; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters, digits and all bytes beyond ASCII are parts of words.
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[48:58] = IN_WORD[65:91] = IN_WORD[97:123] = IN_WORD[128:] = True
#: Everything but ASCII white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    known = remembered("powers")
    if not known or len(known["up"]) < n:
        size = max(n, BLOCK + 64)
        for name, by in (("up", _ODD), ("down", _INVERSE)):
            factors = np.full(size, by)
            factors[0] = 1
            known[name] = np.cumprod(factors)
    return known["up"], known["down"]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, and where each row begins, with the end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind, count=len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def spans(data: np.ndarray, at: np.ndarray, inside: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word, and for each row the number of its first word (with the end).

    A word ends where its row ends. Empty rows and rows without words have none.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    word = inside[data]
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    first = at[:-1][at[:-1] < at[1:]]
    begin[first] = word[first]
    last = at[1:][at[:-1] < at[1:]] - 1
    end[last] = word[last]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return begin, end, np.searchsorted(begin, at)


def hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, A-Z as a-z."""
    out = np.empty(len(begin), np.uint64)
    k = 0
    while k < len(begin):
        stop = max(k + 1, int(np.searchsorted(end, begin[k] + BLOCK, side="right")))
        low, high = begin[k], end[stop - 1]
        up, down = _powers(int(high - low) + 1)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum((LOWER[data[low:high]].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=total[1:])
        h = (total[end[k:stop] - low] - total[begin[k:stop] - low]) * down[begin[k:stop] - low]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        out[k:stop] = h ^ (h >> np.uint64(32))
        k = stop
    return out


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `most` bytes of `column`; a longer row is a piece of its own."""
    give_back()
    _, at = raw(batch.column(column))
    k = 0
    while k < len(batch):
        stop = max(k + 1, int(np.searchsorted(at, at[k] + most, side="right")) - 1)
        yield batch.slice(k, stop - k)
        k = stop
