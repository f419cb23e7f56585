"""`key_mark` for whole batches: MD5 in numpy, where a row needs many marks.

A mark is the MD5 of a row's text and an ending. Texts of one length fill the same bytes of
MD5's block, so all of them, with all endings, go through its 64 steps together.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa

_TABLE = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
# Bytes of a block that a text may fill: 1 ends it, 8 hold its length.
ROOM = 55


def _leading(words: list, shape: tuple) -> np.ndarray:
    """The first 60 bits of the MD5 of blocks of 16 words, each an array or a number that spreads to `shape`."""
    a, b, c, d = (np.full(shape, x, np.uint32) for x in _START)
    f, turned = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            g = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            g = (3 * i + 5) % 16
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
            g = 7 * i % 16
        f += a
        if isinstance(words[g], int):
            f += np.uint32((_TABLE[i] + words[g]) & 0xFFFFFFFF)
        else:
            f += np.uint32(_TABLE[i])
            f += words[g]
        np.left_shift(f, np.uint32(_TURNS[i]), out=turned)
        f >>= np.uint32(32 - _TURNS[i])
        f |= turned
        f += b
        a, b, c, d, f = d, f, b, c, a
    a += np.uint32(_START[0])
    b += np.uint32(_START[1])
    return ((a.byteswap().astype(np.uint64) << np.uint64(32)) | b.byteswap()) >> np.uint64(4)


def _slow(text: bytes) -> int:
    return int(hashlib.md5(text).hexdigest()[:15], 16)


class Texts:
    """The texts of a batch, by length."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        column = column if not column.null_count else column.fill_null(b"")
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        sizes = np.diff(ends)
        #: (length, rows, bytes of each row's text)
        self.groups = []
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            self.groups.append((int(size), rows, data[ends[rows][:, None] + np.arange(size)]))


def _block(size: int, ending: bytes) -> np.ndarray:
    """The words of a block without its text of the given size."""
    out = np.zeros(64, np.uint8)
    out[size : size + len(ending)] = np.frombuffer(ending, np.uint8)
    out[size + len(ending)] = 0x80
    out[56:] = np.frombuffer((8 * (size + len(ending))).to_bytes(8, "little"), np.uint8)
    return out.view("<u4")


def marks(size: int, texts: np.ndarray, endings: list[bytes], pairs: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Marks of texts of one size: of each with each ending, one row an ending, or of the given (ending, text) pairs only."""
    if size + max(map(len, endings)) > ROOM:
        plain = [x.tobytes() for x in texts]
        chosen = [(e, t) for e in range(len(endings)) for t in range(len(plain))] if pairs is None else zip(*pairs, strict=True)
        out = np.array([_slow(plain[t] + endings[e]) for e, t in chosen], np.uint64)
        return out.reshape(len(endings), len(plain)) if pairs is None else out
    filled = np.zeros((len(texts), 4 * (size // 4 + 1)), np.uint8)
    filled[:, :size] = texts
    own = np.ascontiguousarray(filled.view("<u4").T)
    fixed = np.array([_block(size, e) for e in endings])
    shape = (len(endings), len(texts)) if pairs is None else pairs[0].shape
    words = []
    for i in range(16):
        same = int(fixed[0, i]) if (fixed[:, i] == fixed[0, i]).all() else None
        rest = same if same is not None else fixed[:, i][:, None] if pairs is None else fixed[pairs[0], i]
        if i < len(own):
            text = own[i][None, :] if pairs is None else own[i][pairs[1]]
            words.append(text if same == 0 else text | (np.uint32(rest) if same is not None else rest))
        else:
            words.append(rest)
    return _leading(words, shape)
