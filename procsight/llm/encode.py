"""Token ids of whole texts, as the tokenizers library gives them."""

import os
from array import array

import numpy as np
import pyarrow as pa
import regex

from procsight.llm.memory import once, remembered
from procsight.llm.words import raw

#: The split of byte-level BPE, and the same in the faster standard engine.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FAST = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Split words whose ids a worker remembers; as many of the time before are at hand.
REMEMBERED = 250_000


class Words(dict):
    """Split words' ids: looked up among those of the time before, or merged by the library, when first asked for."""

    def __init__(self, merge, before: dict[str, bytes]):
        self.merge, self.before = merge, before

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = array("I", [t.id for t in self.merge(word.encode().decode("latin-1").translate(SHOWN))]).tobytes()
        self[word] = ids
        return ids


def _shown() -> dict[int, int]:
    """Byte-level models read bytes as characters: printable ones as themselves, the others from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in own)}


SHOWN = _shown()


class Encoder:
    """`ids(text)`: little-endian 32-bit ids, without begin, end or added special tokens.

    Where the tokenizer splits a text into words before it merges bytes, a
    word's ids are always the same, so each worker remembers them and has the
    library's model merge only new words. Texts that hold a special token's string or
    characters that the two regular-expression engines class differently, and
    tokenizers of another build, go to the library whole.
    """

    def __init__(self, path: str):
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        split = self.tokenizer.pre_tokenizer
        state = split.__getstate__() if split is not None else b""
        self.by_word = (
            isinstance(split, pre_tokenizers.ByteLevel)
            and b'"use_regex":true' in state
            and b'"add_prefix_space":false' in state
            and self.tokenizer.normalizer is None
        )
        self.split = re.compile(FAST).findall
        self.odd = _differing() if self.by_word else None
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))).search if added else None
        self.special_bytes = re.compile("|".join(map(re.escape, added)).encode()).finditer if added else None
        self.known = Words(self.tokenizer.model.tokenize, {})

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, text: str) -> bool:
        """May the text be split here?"""
        if not self.by_word or self.special and self.special(text):
            return False
        ascii_only = text.isascii()
        codes = np.frombuffer(text.encode("ascii" if ascii_only else "utf-32-le"), np.uint8 if ascii_only else "<u4")
        return not self.odd[codes].any()

    def ids(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.before = {}
            self.known = Words(self.known.merge, dict(self.known))
        get = self.known.__getitem__
        return [b"".join(map(get, self.split(t))) if self._plain(t) else self.whole(t) for t in texts]


    def column(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        """`ids` of each row of a binary column, as a binary column, each followed by `end`.

        The words of all rows are the buffer cut at the words' begins; Arrow numbers
        the distinct ones, whose ids are looked up once, and puts the rows' ids together.
        """
        data, at = raw(texts)
        text = data.tobytes()
        try:
            text.decode()
        except UnicodeDecodeError:
            return pa.array([x + end for x in self.ids([t.decode("utf-8", "replace") for t in texts.to_pylist()])], pa.binary())
        if len(self.known) > REMEMBERED:
            self.known.before = {}
            self.known = Words(self.known.merge, dict(self.known))
        begin, odd = _begins(data, at)
        whole = np.full(len(at) - 1, not self.by_word)
        whole[np.searchsorted(at, odd, side="right") - 1] = True
        for found in self.special_bytes(text) if self.special_bytes else ():
            first, last = np.searchsorted(at, [found.start(), found.end() - 1], side="right") - 1
            whole[first : last + 1] = True
        whole &= at[:-1] < at[1:]
        for i in np.flatnonzero(whole):
            begin[at[i] + 1 : at[i + 1]] = False
        cut = np.flatnonzero(begin)
        edge = np.append(cut, len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(edge), pa.py_buffer(text)]).dictionary_encode()
        number = words.indices.to_numpy()
        first = np.searchsorted(cut, at)
        alone = set(number[first[:-1][whole]].tolist())
        get = self.known.__getitem__
        ids = [self.whole(w.decode()) if k in alone else get(w.decode()) for k, w in enumerate(words.dictionary.to_pylist())]
        ids.append(end)
        # Each row's words, then `end`; the ids of all of them lie one after the other.
        number = np.insert(number, first[1:], len(ids) - 1)
        joined, place = raw(pa.array(ids, pa.binary()).take(pa.array(number)))
        edge = place[first + np.arange(len(first))].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(edge), pa.py_buffer(joined)])


#: Classes of code points: letters, digits, white space, others; ODD ones are classed differently by the engines.
LETTERS, DIGITS, SPACES, OTHERS, ODD = range(5)
#: What follows an apostrophe in the split's first alternatives.
CONTRACTED = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def _classes() -> np.ndarray:
    """The class of each code point."""
    known = remembered("classes")
    if not known:
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        kind = np.full(0x110000, OTHERS, np.uint8)
        for code, a in ((LETTERS, r"\p{L}"), (DIGITS, r"\p{N}"), (SPACES, r"\s")):
            kind[[ord(c) for c in regex.findall(a, every)]] = code
        kind[_differing()] = ODD
        known["points"] = kind
    return known["points"]


def _begins(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of the bytes with which PATTERN's words begin, row by row; and where odd characters stand. Valid UTF-8 only."""
    if not len(data):
        return np.zeros(0, bool), np.zeros(0, np.int64)
    points = _classes()
    kind = points[:128][np.minimum(data, 127)]
    lead = np.flatnonzero(data >= 0xC0)
    more = np.flatnonzero((data >= 0x80) & (data < 0xC0))
    size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0).astype(np.int64)
    code = data[lead] & np.array([0, 0, 0x1F, 0x0F, 0x07], np.uint8)[size]
    code = code.astype(np.int64)
    for k in (1, 2, 3):
        longer = size > k
        code[longer] = code[longer] << 6 | data[lead[longer] + k] & 0x3F
    kind[lead] = points[code]
    for k in (1, 2, 3):
        longer = lead[size > k]
        kind[longer + k] = kind[longer]
    blank, start = data == 32, at[:-1][at[:-1] < at[1:]]
    space = kind == SPACES
    begin = np.ones(len(data), bool)
    # A word begins where the class changes, but for a blank before it, with which it then begins.
    begin[1:] = kind[1:] != kind[:-1]
    begin[1:] &= ~blank[:-1] | space[1:]
    begin[start] = True
    # Of several spaces before another character the last is cut off; `last` is its first byte.
    last = np.zeros(len(data), bool)
    last[:-1] = space[:-1] & ~space[1:]
    last[start[start > 0] - 1] = False
    last = np.flatnonzero(last)
    while (inside := (data[last] & 0xC0) == 0x80).any():
        last = last - inside
    begin[last] = True
    # A contraction begins where its apostrophe begins a word.
    mark = np.flatnonzero((data == 39) & begin)
    if len(mark):
        stop = at[np.searchsorted(at, mark, side="right")]
        text = np.concatenate([data, np.zeros(2, np.uint8)])
        for letters in CONTRACTED:
            n = len(letters)
            fits = mark + n < stop
            for k, letter in enumerate(letters):
                fits &= text[np.minimum(mark + 1 + k, len(text) - 1)] == letter
            begin[mark[fits] + 1] = False
            after = mark[fits] + n + 1
            begin[after[after < len(data)]] = True
        # The begins of rows stay, and no word begins within a character.
    begin[more] = False
    return begin, np.flatnonzero(kind == ODD)


def _differing() -> np.ndarray:
    """By code point: is it in \\p{L}, \\p{N} or \\s for one engine only?"""
    known = remembered("differing")
    if not known:
        import re

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        odd = np.zeros(0x110000, dtype=bool)
        for a, b in ((r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d")):
            odd[[ord(c) for c in set(regex.findall(a, every)) ^ set(re.findall(b, every))]] = True
        # The separators U+001C to U+001F are white space for one engine only.
        odd[0x1C:0x20] = True
        known["points"] = odd
    return known["points"]


def encoder(path: str) -> Encoder:
    """One encoder for each worker and path."""
    return once("encoder", path, lambda: Encoder(path))
