"""License notices by conditional compression.

Candidates are the texts that speak of licensing. Their words are read across
line ends, so a notice may be wrapped or stand in a comment. Around the words of
licensing blocks are cut, short ones for notices, titles and tags, and long ones
for headers and bodies. Every block is compressed alone and with every template of
its kind as a raw zstandard dictionary; the templates are ranked by the bytes that
they save. In that order each template's place in the block is sought, and the
words in which place and template differ confirm or reject it; a confirmed place
is no other template's.
"""

import bisect
import difflib
import re
from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procsight.llm.tables import utf8
from procsight.llm.words import slices

# Short notices of common public licenses.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "Licensed under the Mozilla Public License, version 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC0-1.0": "Released under the CC0 1.0 Public Domain Dedication.",
    "ISC": "Released under the ISC License.",
    "Unlicense": "Released into the public domain under the Unlicense.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "EPL-2.0": "Licensed under the Eclipse Public License, version 2.0.",
    "EPL-1.0": "Licensed under the Eclipse Public License, version 1.0.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
}


def _gnu(kind: str, version: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by "
        f"the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty "
        f"of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details."
    )


_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission. "
)
_BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, '
    "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
    "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

# The licenses' own headers, titles and bodies. List numbers and holders' names are left out.
TEXTS = {
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        'law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES '
        "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License.",
        "Apache License Version 2.0, January 2004",
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        'shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY '
        "OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
        "THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "BSD-3-Clause": [_BSD + _BSD_NAMES + _BSD_AS_IS],
    "BSD-2-Clause": [_BSD + _BSD_AS_IS],
    "GPL-3.0": [_gnu("General Public License", "3"), "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "GPL-2.0": [_gnu("General Public License", "2"), "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "LGPL-3.0": [_gnu("Lesser General Public License", "3"), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "AGPL-3.0": [_gnu("Affero General Public License", "3"), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Mozilla Public License Version 2.0 1. Definitions",
    ],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International"],
    "CC-BY-ND-4.0": ["Creative Commons Attribution-NoDerivatives 4.0 International"],
    "CC-BY-NC-SA-4.0": ["Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International"],
    "CC-BY-NC-ND-4.0": ["Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International"],
    "EPL-2.0": ["Eclipse Public License - v 2.0"],
    "EPL-1.0": ["Eclipse Public License - v 1.0"],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "CC0-1.0": ["CC0 1.0 Universal", "has waived all copyright and related or neighboring rights to"],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "
        '"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
        "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE "
        "OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means.",
    ],
}
for _name, _texts in TEXTS.items():
    _texts += [f"SPDX-License-Identifier: {_name}", f"License: {_name}"]
    if "GPL" in _name:
        _kind, _version = _name[:-4], _name[-3:]
        _long = {"GPL": "General", "LGPL": "Lesser General", "AGPL": "Affero General"}[_kind] + " Public License"
        _texts += [f"SPDX-License-Identifier: {_name}-{which}" for which in ("only", "or-later")]
        # The version in short, the abbreviation, and the header of one version only.
        _texts += [f"GNU {_long} {v}" for v in (f"v{_version[0]}", f"v{_version}", _version, f"version {_version[0]}", f"version {_version}")]
        _texts += [f"{_kind}v{_version[0]}", f"{_kind}v{_version}", f"{_kind} version {_version[0]}", f"{_kind} v{_version[0]}"]
        _texts.append(
            f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU {_long} version "
            f"{_version[0]} as published by the Free Software Foundation."
        )
    elif _name.startswith("CC-BY"):
        _texts.append(_name.replace("-4.0", " 4.0").replace("CC-", "CC "))

#: Words of licensing, across line ends and comment signs; every template has some.
CUE = (
    r"(?i)licen[sc]|copyright|copyleft|public\W+domain|all\W+rights\W+reserved|permission\W+(?:is\W+hereby|to\W+use)|spdx|\bcc0\b|\bcc\W+by"
    r"|creative\W+commons|redistribution\W+and\W+use|free\W+and\W+unencumbered|\b[la]?gpl"
)
#: Single words of the same kind, around which blocks are cut.
_CUE_WORD = re.compile(r"licen[sc]|copyright|copyleft|spdx|^cc0?$|^cc-|^creative$|^permission$|^redistribution|^unencumbered$|^domain$|^[la]?gpl")
LEVEL = 3
#: Words before and after a cue in a block, and the most words of one block; for templates of few words and of many.
SHORT_BLOCK, LONG_BLOCK = (12, 24, 48), (48, 300, 640)
#: Bytes that a template must save to be compared, and least share of a place's compressed size that it must save.
#: Templates of EXACT words are too small to save anything surely: they are ranked, but need not save.
GAIN, SAVING = 1, 0.25
#: Words that may be exchanged without changing the license.
FREE = frozenset("a an the this work file software project content text document is are was under licensed license licence released by of version v".split())
#: Templates of more words may differ in a share of them, but not in these words, nor lack a number; those of EXACT words in none.
LONG, OTHER, EXACT = 20, 0.08, 3
TELLING = frozenset("gnu lesser affero library apache mozilla".split())
#: Words between a notice's parts that make them parts of different texts, and words around a place that are looked at.
APART, AROUND = 3, 8

_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


_SPDX, _JOIN = "spdx-license-identifier", frozenset(("or", "and", "with"))


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def numbered_words(text: str) -> tuple[list[str], list[int]]:
    """The words of a text, and the line of each. The identifiers of a tag's expression have a tag each."""
    own, line = [], []
    for i, one in enumerate(text.split("\n")):
        more = words(one)
        for k, w in enumerate(more):
            if w in _JOIN and k >= 2 and own[-2] == _SPDX:
                w = _SPDX
            own.append(w)
        line += [i] * len(more)
    return own, line


def blocks(text: list[str], before: int, after: int, most: int) -> list[tuple[int, int]]:
    """Begin and end of the blocks around the cues; longer stretches are cut into blocks that overlap by half."""
    out: list[list[int]] = []
    for p, w in enumerate(text):
        if _CUE_WORD.search(w):
            begin, end = max(0, p - before), min(len(text), p + after)
            if out and begin <= out[-1][1]:
                out[-1][1] = end
            else:
                out.append([begin, end])
    return [
        (k, min(k + most, end)) for begin, end in out for k in range(begin, max(begin + 1, end - most // 2), most // 2)
    ]


def difference(block: str, notice: str) -> tuple[list[str], list[str]]:
    """(words of the notice that the block lacks, words that it has besides near the notice's), in order."""
    missing, extra, _, _ = _compared(words(block), words(notice))
    return missing, extra


def _compared(b: list[str], a: list[str]) -> tuple[list[str], list[str], int, int]:
    """The difference of a place b and a template a, and where in b the template begins and ends."""
    matcher = difflib.SequenceMatcher(None, a, b, autojunk=False)
    same = [m for m in matcher.get_matching_blocks() if m.size]
    # Free words far from the others are other text.
    for end, step in ((0, 1), (-1, -1)):
        while len(same) > 1 and FREE.issuperset(a[same[end].a : same[end].a + same[end].size]):
            one, two = (same[end], same[end + step])[::step]
            if two.b - one.b - one.size <= APART and two.a - one.a - one.size <= APART:
                break
            same.pop(end)
    if not same:
        return a, b, 0, len(b)
    missing, extra = list(a[: same[0].a]), []
    for one, two in zip(same, same[1:], strict=False):
        missing += a[one.a + one.size : two.a]
        extra += b[one.b + one.size : two.b]
    missing += a[same[-1].a + same[-1].size :]
    return missing, extra, same[0].b, same[-1].b + same[-1].size


def _plain(text: str) -> bytes:
    return " ".join(words(text)).encode()


class Scanner:
    """Ranks the templates by what they save, and confirms by wording."""

    def __init__(self, notices: dict[str, str], texts: dict[str, list[str]] | None = None):
        #: Compressors without a template, for short blocks and for long ones.
        self.alone = [self._with("", long) for long in (False, True)]
        texts = {name: own for name, own in (texts or {}).items() if name in notices}
        each = [(name, text) for name, text in notices.items()] + [(name, text) for name, own in texts.items() for text in own]
        #: (license, words, compressor) of every notice, header and body.
        self.templates = [(name, words(text), self._with(text, len(words(text)) > LONG)) for name, text in each]
        #: Numbers of the templates of few words, and of those of many.
        self.kinds = [[t for t, x in enumerate(self.templates) if (len(x[1]) > LONG) == long] for long in (False, True)]
        #: Where the words of a short template, or two words of a long one, stand in it.
        self.single: list[dict[str, list[int]]] = []
        self.double: list[dict[tuple[str, str], list[int]]] = []
        for _, own, _ in self.templates:
            at: dict[str, list[int]] = defaultdict(list)
            pairs: dict[tuple[str, str], list[int]] = defaultdict(list)
            if len(own) > LONG:
                for i, pair in enumerate(zip(own, own[1:], strict=False)):
                    pairs[pair].append(i)
            else:
                for i, w in enumerate(own):
                    if w not in FREE or len(own) <= EXACT:
                        at[w].append(i)
            self.single.append(at)
            self.double.append(pairs)
        self.judged = lru_cache(1 << 14)(self._judged)
        self.ranked = lru_cache(1 << 12)(self._ranked)

    @staticmethod
    def _with(text: str, long: bool):
        """A compressor with the template as dictionary; matches of three bytes count where blocks are short."""
        # Dictionaries of a few bytes are not used at all.
        given = zstandard.ZstdCompressionDict(b"\n" * 12 + b" " + _plain(text) + b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        finer = {} if long else {"min_match": 3, "strategy": zstandard.STRATEGY_BTULTRA2}
        how = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, **finer)
        return zstandard.ZstdCompressor(compression_params=how, dict_data=given)

    def _ranked(self, block: tuple[str, ...], long: bool) -> list[tuple[int, int]]:
        """(bytes saved, template) of the templates of one kind that save some, most first; of equal ones the longer template."""
        data = " ".join(block).encode()
        size = len(self.alone[long].compress(data))
        saved = [(size - len(self.templates[t][2].compress(data)), t) for t in self.kinds[long]]
        return sorted((x for x in saved if x[0] >= GAIN or len(self.templates[x[1]][1]) <= EXACT), key=lambda x: (-x[0], -len(self.templates[x[1]][1]), x[1]))

    def _judged(self, t: int, around: tuple[str, ...]) -> tuple[int, int, float, list[str], list[str]] | None:
        """(begin, end, saving, missing, extra) of the template in these words, if it is there."""
        own = self.templates[t][1]
        if len(own) <= EXACT:
            at = [i for i in range(len(around)) if list(around[i : i + len(own)]) == own]
            return (at[0], at[0] + len(own), self._saving(own, t), [], []) if at else None
        if len(own) <= LONG and not set(around).issuperset(w for w in own if w not in FREE):
            return None
        missing, extra, begin, end = _compared(list(around), own)
        lost, more = [w for w in missing if w not in FREE], [w for w in extra if w not in FREE]
        if len(own) <= LONG:
            if lost or more:
                return None
        elif (
            len(lost) > OTHER * len(own)
            or len(more) > OTHER * len(own)
            or TELLING.intersection(lost + more)
            or any(c.isdigit() for w in lost for c in w)
        ):
            return None
        saving = self._saving(around[begin:end], t)
        return (begin, end, saving, missing, extra) if saving >= SAVING else None

    def _saving(self, place, t: int) -> float:
        """Share of the place's compressed size that the template saves."""
        data = " ".join(place).encode()
        size = len(self.alone[len(self.templates[t][1]) > LONG].compress(data))
        return (size - len(self.templates[t][2].compress(data))) / size

    def _windows(self, t: int, text: tuple[str, ...]):
        """Begin and end of the words of a block where template t may be."""
        n = len(self.templates[t][1])
        if self.single[t]:
            seen = set()
            for p, w in enumerate(text):
                for i in self.single[t].get(w, ()):
                    begin = max(0, p - i - AROUND)
                    if begin not in seen:
                        seen.add(begin)
                        yield begin, p - i + n + AROUND
            return
        pairs = enumerate(zip(text, text[1:], strict=False))
        shift = sorted(p - i for p, pair in pairs for i in self.double[t].get(pair, ()))
        slack, k = n // 5 + AROUND, 0
        while k < len(shift):
            stop = bisect.bisect_right(shift, shift[k] + slack)
            if 2 * (stop - k) >= n:
                yield max(0, shift[k] - AROUND), shift[stop - 1] + n + AROUND
                k = stop
            else:
                k += 1

    def scan(self, block: tuple[str, ...], long: bool) -> list[tuple[int, int, int, float, list[str], list[str]]]:
        """(begin, end, template, saving, missing, extra): in the order of the ranking, the places that the wording confirms."""
        taken: list[tuple[int, int]] = []
        out = []
        for _, t in self.ranked(block, long):
            for begin, end in self._windows(t, block):
                hit = self.judged(t, block[begin:end])
                if hit:
                    low, high = begin + hit[0], begin + hit[1]
                    if all(high <= a or b <= low for a, b in taken):
                        taken.append((low, high))
                        out.append((low, high, t, *hit[2:]))
        return out

    def places(self, text: str) -> list[tuple[int, str, float, list[str], list[str]]]:
        """(line, license, saving, missing, extra) of every license that the text gives, by its first line."""
        own, line = numbered_words(text)
        found = set()
        for long, sizes in ((False, SHORT_BLOCK), (True, LONG_BLOCK)):
            for begin, end in blocks(own, *sizes):
                for low, high, t, saving, missing, extra in self.scan(tuple(own[begin:end]), long):
                    found.add((begin + low, begin + high, t, saving, tuple(missing), tuple(extra)))
        # Of places that overlap, the one with the most words of its template counts, then the one that saves most.
        taken: list[tuple[int, int]] = []
        out = []
        for begin, end, t, saving, missing, extra in sorted(
            found, key=lambda x: (len(x[4]) - len(self.templates[x[2]][1]), -x[3], x[0], x[2])
        ):
            if all(end <= a or b <= begin for a, b in taken):
                taken.append((begin, end))
                out.append((line[begin], self.templates[t][0], saving, list(missing), list(extra)))
        return sorted(out, key=lambda x: x[:2])


def scan(docs: DataFrame, notices: dict[str, str] = NOTICES, key: str = "doc_id", texts: dict[str, list[str]] = TEXTS) -> DataFrame:
    """doc_id, line (from 0), license, saving, missing, extra: one row for each place that gives a license, by its first line.

    Whole texts are read, word by word across their lines; texts without a word
    of licensing are no candidates. A scanner remembers the blocks that it ranked
    and the places that it judged, so what many documents hold is compared once. Null and empty
    texts give nothing; null keys and repeated rows give their rows; an empty
    table gives none; other columns are not read.
    """
    candidates = docs.select(F.col(key), utf8("text").alias("text")).where(F.rlike(F.col("text").cast("string"), F.lit(CUE)))
    key_type = docs.schema[key].dataType.simpleString()
    kind = f"`{key}` {key_type}, line int, license string, saving double, missing array<string>, extra array<string>"

    def judge(batches):
        scanner = Scanner(notices, texts)
        for batch in batches:
            for some in slices(batch, 1):
                rows, out = [], []
                for i, text in enumerate(some.column(1)):
                    for x in scanner.places(text.as_py().decode("utf-8", "replace")):
                        rows.append(i)
                        out.append(x)
                columns = list(zip(*out, strict=True)) or [()] * 5
                kinds = (pa.int32(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
                    [key, "line", "license", "saving", "missing", "extra"],
                )

    return candidates.mapInArrow(judge, kind)
