"""License scans by conditional compression (operator 4).

Candidate blocks are the places where enough words of any template stand together,
over however many lines. A block is compressed by zstandard on its own and again with
each template as raw dictionary, and the templates are ranked by what they save. Those
that save enough are confirmed or refuted by the exact wording differences, word by
word: enough of the template's words must stand in order, all its deciding words
(versions, and what tells it from the templates like it) among them. Of passages that
share most of their words the one with the greatest reduction stays. A line with a cue
in which nothing is confirmed is named after the template that shrinks it most.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVEL = 19
LEAST_REDUCTION = 0.2    # of the template's own compressed size
LEAST_COVERAGE = 0.8     # of the template's words, in order, and of each part that decides
ALIKE = 0.75             # share of words in common from which templates are told apart word by word
SHORT, ALIKE_SHORT = 20, 0.5    # ... where both have at most SHORT words, which say little but the name
CLOSE = 2                # sizes are whole bytes: reductions this close tie
MEMORY = 20_000          # judged blocks a task remembers

#: A line is looked at if it holds one of these, whatever the case of ASCII letters.
#: One pattern for Spark and Python; "MIT" and "ISC" alone are no cue (mit is a German word).
SIGNS = (r"licen[sc]|copyright|warrant|permission|redistribut|public domain|spdx|all rights reserved|\(c\)|\u00a9"
         r"|(?<![a-z0-9])(?:apache|gnu|[al]?gpl|mozilla|mpl|bsd|creative commons|cc[ -]by|cc0|unlicense)(?![a-z])")
#: Words that stand in any text: the last to be taken as cue of a template.
COMMON = frozenset("""a above all an and any are as at author be but by charge can conditions following for form free from
    general has have if in including into is it law limitation limited made may mit must no not of on or other
    particular permitted possible provided public purpose released retain rights shall should software subject such
    terms that the this to under use version which with without work you your""".split())

_GPL = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as "
        "published by the Free Software Foundation, either version {} of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution. {}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY "
        "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
        "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
        "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED "
        "TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
        "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")

#: Short notices by which texts state a license, headers of files and short license
#: texts; a license may have several wordings, of any length (others by parameter).
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
        "language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions: The above copyright notice and this "
        "permission notice shall be included in all copies or substantial portions of the Software. THE "
        "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        _GPL.format("General Public License", 3, "General Public License"),
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        _GPL.format("General Public License", 2, "General Public License"),
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        _GPL.format("Lesser General Public License", 3, "Lesser General Public License"),
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        _GPL.format("Affero General Public License", 3, "Affero General Public License"),
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        _BSD.format("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
                    "or promote products derived from this software without specific prior written permission. "),
    ],
    "BSD-2-Clause": [
        "Licensed under the BSD 2-Clause License.",
        _BSD.format(""),
    ],
    "MPL-2.0": [
        "This work is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
        "the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all rights to this work under CC0 1.0.",
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in "
        "source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
        "means.",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee"
        " is hereby granted, provided that the above copyright notice and this permission notice appear in "
        "all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO "
        "THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE"
        " AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE"
        " OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE.",
    ],
    "Proprietary": "Copyright. All rights reserved.",
    "All-rights-reserved": "All rights reserved.",
}

#: Words by which a notice is put, of whatever license: they decide nothing.
PLAIN = COMMON - {"mit", "by"} | frozenset("author copyright covered distributed file files available license licensed licenses "
                           "obtain program released software source specified work works v".split())

_WORD = re.compile(r"\w+(?:[.\-]\w+)*")
_SIGNS = re.compile(SIGNS, re.I | re.A)
_VERSION = re.compile(r"v?([0-9]+(?:\.[0-9]+)*?)(?:\.0)*")
_LIST_MARK = re.compile(r"(?<=[:.;] )[0-9]+(?=\. )")


def normal(word: str) -> str:
    """A word in lower case; "2", "2.0" and "v2.0" are one version."""
    word = word.lower()
    m = _VERSION.fullmatch(word)
    return m.group(1) if m else word


def deciding(templates: dict[tuple[str, int], str]) -> dict[tuple[str, int], tuple[list[list[int]], list[list[str]]]]:
    """Per template the places of its words that decide, in parts that must stand,
    and the parts of other templates that must not stand between its words. Versions
    decide (numbers that are no marks of a list), and so does what is different in
    templates of other licenses that are alike."""
    words = {k: [normal(w) for w in _WORD.findall(t)] for k, t in templates.items()}
    counts = {k: Counter(w) for k, w in words.items()}
    out = {}
    for k, t in templates.items():
        marks = {m.start() for m in _LIST_MARK.finditer(t)}
        need = {(i,) for i, m in enumerate(_WORD.finditer(t)) if any(c.isdigit() for c in m.group()) and m.start() not in marks}
        alien = set()
        for j, other in words.items():
            alike = ALIKE_SHORT if max(len(words[k]), len(other)) <= SHORT else ALIKE
            if j[0] == k[0] or 2 * (counts[k] & counts[j]).total() < alike * (len(words[k]) + len(other)):
                continue
            for kind, a, b, c, d in difflib.SequenceMatcher(None, words[k], other, autojunk=False).get_opcodes():
                if kind in ("replace", "delete"):
                    need.add(tuple(i for i in range(a, b) if words[k][i] not in PLAIN))
                elif kind == "insert":
                    alien.add(tuple(w for w in other[c:d] if w not in PLAIN))
        out[k] = sorted(map(list, need - {()})), sorted(map(list, alien - {()}))
    return out


def cue_words(words: list[str]) -> set[str]:
    """Words of a template of which every text that covers LEAST_COVERAGE of it
    holds one: they make up more of its words than may be missing."""
    counts, most, found = Counter(words), int((1 - LEAST_COVERAGE) * len(words) + 1e-9), set()
    for w in sorted(counts, key=lambda w: (bool(_VERSION.fullmatch(w)), not _SIGNS.search(w), w in COMMON, -len(w), w)):
        if sum(counts[x] for x in found) > most:
            break
        found.add(w)
    return found


def wordings(templates: dict[str, str | list[str]]) -> dict[tuple[str, int], str]:
    """Templates by license and place in its list."""
    return {(k, i): t for k in sorted(templates)
            for i, t in enumerate([templates[k]] if isinstance(templates[k], str) else templates[k])}


def cues(templates: dict[str, str | list[str]]) -> str:
    """Pattern of all cues, for Spark and Python: the fixed ones and the
    templates' own."""
    own = set().union(*(cue_words([normal(w) for w in _WORD.findall(t)]) for t in wordings(templates).values()), ())
    own = sorted({x for w in own if not _SIGNS.search(w) for x in ({w} if w.isascii() else {w, w.upper(), w.title()})})
    own = [rf"v?{re.escape(w)}(?:\.0)*" if _VERSION.fullmatch(w) else re.escape(w) for w in own]
    return SIGNS + (rf"|(?<![a-z0-9])(?:{'|'.join(own)})(?![a-z0-9])" if own else "")


def _apart(a: int, b: int, taken: list[tuple[int, int]]) -> bool:
    return all(b <= x or y <= a for x, y in taken)


def blocks(text: str, around: int, taken: list[tuple[int, int]] = ()) -> list[tuple[int, str]]:
    """(start, block) of every line with a cue that is not taken; of a line longer
    than four times ``around``, what stands around its cues."""
    out, at = [], 0
    for line in text.split("\n"):
        met = [m.span() for m in _SIGNS.finditer(line)]
        if met and taken:
            met = [(a, b) for a, b in met if _apart(at + a, at + b, taken)]
        if met and len(line) <= 4 * around:
            out.append((at, line))
        else:
            runs: list[list[int]] = []
            for a, b in met:
                a, b = max(0, a - around), min(len(line), b + around)
                if runs and a <= runs[-1][1] and b - runs[-1][0] <= 4 * around:
                    runs[-1][1] = b
                else:
                    runs.append([a, b])
            out += [(at + a, line[a:b]) for a, b in runs]
        at += len(line) + 1
    return out


def _bounds(text: str, first: int, last: int, around: int) -> tuple[int, int]:
    """The lines over which text[first:last] goes; of a very long line, what
    stands around it."""
    a, b = text.rfind("\n", 0, first) + 1, text.find("\n", last)
    b = len(text) if b < 0 else b
    if b - a > 4 * around + last - first:
        a, b = max(a, first - around), min(b, last + around)
    return a, b


def _between(places: list[int], a: int, b: int) -> list[int]:
    return places[bisect_left(places, a):bisect_left(places, b)]


def _share_most(a: set[int], b: set[int]) -> bool:
    return 2 * len(a & b) > min(len(a), len(b))


class Scanner:
    def __init__(self, templates: dict[str, str | list[str]], decided: dict | None = None):
        self.templates = wordings(templates)
        self.decided = deciding(self.templates) if decided is None else decided
        self.around = max(map(len, self.templates.values()), default=0) // 2 + 100   # a cue's block can hold any template
        self.words = {k: [normal(w) for w in _WORD.findall(t)] for k, t in self.templates.items()}
        self.counts = {k: Counter(w) for k, w in self.words.items()}
        self.vocabulary = set().union(*self.counts.values(), ())
        self.alone = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
        self.given = {k: zstandard.ZstdCompressor(
            level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False,
            dict_data=zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            for k, t in self.templates.items() if len(t) >= 8}
        self.own = {k: len(self.alone.compress(self.templates[k].lower().encode())) for k in self.given}
        self.memory: dict[tuple, tuple] = {}

    def differences(self, have: list[str], name: tuple[str, int]) -> tuple[float, list[str], list[str], list[int], set[int]]:
        """Share of the template's words met in order, those missing, words that
        stand between them but not in the template, the places of those met, and
        the template's own places of those missing."""
        want = self.words[name]
        ops = difflib.SequenceMatcher(None, want, have, autojunk=False).get_opcodes()
        met = [i for t, _, _, a, b in ops if t == "equal" for i in range(a, b)]
        gone = [i for t, a, b, _, _ in ops if t in ("delete", "replace") for i in range(a, b)]
        first, last = (met[0], met[-1] + 1) if met else (0, 0)
        added = [w for t, _, _, a, b in ops if t in ("insert", "replace") and first <= a and b <= last for w in have[a:b]]
        return 1 - len(gone) / max(1, len(want)), [want[i] for i in gone], added, met, set(gone)

    def refuted(self, name: tuple[str, int], gone: set[int], added: list[str]) -> bool:
        """Whether a deciding part of the template is missing, or one of another
        license stands in its place."""
        need, alien = self.decided[name]
        have = Counter(added)
        return (any(sum(i in gone for i in part) > int((1 - LEAST_COVERAGE) * len(part) + 1e-9) for part in need)
                or any((Counter(part) & have).total() >= LEAST_COVERAGE * len(part) for part in alien))

    def dense(self, name: tuple[str, int], words: list[str], places: list[int]) -> list[tuple[int, int]]:
        """Ranges of words with enough of the template's words in one of its
        windows (any order): no other can cover LEAST_COVERAGE of it there.
        ``places`` are those of the template's words."""
        counts, n = self.counts[name], len(self.words[name])
        need, width = n - int((1 - LEAST_COVERAGE) * n + 1e-9), 2 * n + 8
        have, met, left, out = Counter(), 0, 0, []
        for p in places:
            w = words[p]
            have[w] += 1
            met += have[w] <= counts[w]
            while p - places[left] >= width:
                x = words[places[left]]
                met -= have[x] <= counts[x]
                have[x] -= 1
                left += 1
            if met >= need:
                if out and places[left] <= out[-1][1]:
                    out[-1] = (out[-1][0], p + 1)
                else:
                    out.append((places[left], p + 1))
        # What is met first may go on behind: by the rest of the window.
        return [(a, min(len(words), b + n)) for a, b in out]

    def passages(self, name: tuple[str, int], words: list[str], places: list[int], block: tuple[int, int]):
        """(coverage, missing, added, places of the words met) of every passage in
        the block whose wording confirms the template, with up to about as many
        words between as the template has."""
        want, slack = self.words[name], len(self.words[name]) // 2 + 4
        todo = [block]
        while todo:
            a, b = todo.pop()
            for x, y in self.dense(name, words, places[bisect_left(places, a):bisect_left(places, b)]):
                y = min(y, b)
                run = difflib.SequenceMatcher(None, want, words[x:y], autojunk=False).find_longest_match()
                start = x + run.b - run.a
                lo, hi = max(a, start - slack), min(b, start + len(want) + slack)
                coverage, missing, added, met, gone = self.differences(words[lo:hi], name)
                if coverage >= LEAST_COVERAGE:
                    met = [lo + i for i in met]
                    if not self.refuted(name, gone, added):
                        yield coverage, missing, added, met
                    todo += [(x, met[0]), (met[-1] + 1, y)]
                else:
                    todo += [(x, x + run.b), (x + run.b + run.size, y)]

    def candidates(self, words: list[str], at: dict[str, list[int]]) -> list[tuple[int, int]]:
        """Blocks of words with enough words of any template together. Long ones are
        cut into pieces that overlap by more than any passage is long."""
        found, longest = [], max(map(len, self.words.values()), default=0)
        for name in self.given:
            counts, n = self.counts[name], len(self.words[name])
            most = sum(min(c, len(at.get(w, ()))) for w, c in counts.items())
            if n and 1 - (n - most) / n >= LEAST_COVERAGE:
                found += [(max(0, a - n), b) for a, b in self.dense(name, words, sorted(i for w in counts for i in at.get(w, ())))]
        merged: list[list[int]] = []
        for a, b in sorted(found):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        step = 2 * longest + 16
        return [(x, min(b, x + 2 * step)) for a, b in merged for x in range(a, max(a + 1, b - step), step)]

    def saved(self, block: str) -> list[tuple[int, tuple[str, int]]]:
        """(bytes, template) for every template as dictionary, most bytes first."""
        if block not in self.memory:
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            data = block.lower().encode("utf-8", "surrogatepass")
            size = len(self.alone.compress(data))
            self.memory[block] = sorted(((size - len(c.compress(data)), k) for k, c in self.given.items()),
                                        key=lambda x: (-x[0], x[1]))
        return self.memory[block]

    def notices(self, text: str) -> list[tuple]:
        """(first, last, license, reduction, coverage, missing, added) of every
        passage of ``text`` whose wording confirms a template that saves enough. Of
        passages that share more than half of their words the one with the greatest
        reduction stays; reductions that tie are told apart by the words met, less
        those missing and added, then by coverage and name."""
        spans, words, at = [], [], {}
        for m in _WORD.finditer(text):
            w = normal(m.group())
            if w in self.vocabulary:
                at.setdefault(w, []).append(len(words))
            spans.append(m.span())
            words.append(w)
        found = {}
        for a, b in self.candidates(words, at):
            for gain, name in self.saved(text[spans[a][0]:spans[b - 1][1]]):
                # What else stands in the block may lessen a reduction: half is enough here.
                if 2 * gain < LEAST_REDUCTION * self.own[name]:
                    continue
                counts = self.counts[name]
                places = sorted(i for w in counts for i in _between(at.get(w, ()), a, b))
                for coverage, missing, added, met in self.passages(name, words, places, (a, b)):
                    first, last = spans[met[0]][0], spans[met[-1]][1]
                    own = dict((k, g) for g, k in self.saved(text[first:last]))[name]
                    if own >= LEAST_REDUCTION * self.own[name]:
                        apart = len(added) + len(missing) - len(met)
                        found[name, met[0], met[-1]] = (own, apart, -coverage, name, set(met),
                                                        (first, last, name[0], own / self.own[name], coverage, missing, added))
        kept, pool = [], sorted(found.values(), key=lambda f: (-f[0], f[1:4], min(f[4])))
        by_place: dict[int, list[int]] = {}
        for n, f in enumerate(pool):
            for i in f[4]:
                by_place.setdefault(i, []).append(n)
        gone = [False] * len(pool)
        for n, f in enumerate(pool):
            if gone[n]:
                continue
            rivals = self._sharing(pool, by_place, n, gone)
            best = min([m for m in rivals if pool[m][0] >= f[0] - CLOSE], key=lambda m: (pool[m][1:4], m))
            kept.append(pool[best])
            for m in {*rivals, *self._sharing(pool, by_place, best, gone)}:
                gone[m] = gone[m] or _share_most(pool[m][4], pool[best][4]) or m == n
        return [k[5] for k in kept]

    @staticmethod
    def _sharing(pool: list, by_place: dict[int, list[int]], n: int, gone: list[bool]) -> set[int]:
        near = {m for i in pool[n][4] for m in by_place[i]}
        return {m for m in near if not gone[m] and _share_most(pool[m][4], pool[n][4])}

    def judge(self, block: str) -> tuple[str | None, float, float, list[str], list[str]]:
        """Best template, size reduction, coverage, missing, added. Savings that tie
        are told apart by the wording: most words met, fewest added, then by name."""
        gains = self.saved(block)
        if not gains:
            return None, 0.0, 0.0, [], []
        have = [normal(w) for w in _WORD.findall(block)]
        close = [(self.differences(have, k), g / self.own[k], k) for g, k in gains if g >= gains[0][0] - CLOSE]
        (coverage, missing, added, *_), gain, name = min(close, key=lambda x: (-x[0][0], len(x[0][2]), -x[1], x[2]))
        return name[0], gain, coverage, missing, added

    def rows(self, text: str) -> list[tuple]:
        """(block_start, block_chars, license, reduction, coverage, missing,
        added, confirmed) in order of block_start."""
        out, taken = [], []
        for first, last, *verdict in self.notices(text):
            a, b = _bounds(text, first, last, self.around)
            taken.append((a, b))
            out.append((a, b - a, *verdict, True))
        out += [(at, len(block), *self.judge(block), False) for at, block in blocks(text, self.around, taken)]
        return sorted(out, key=lambda r: (r[0], r[2] or ""))


def scan(docs: DataFrame, templates: dict[str, str | list[str]] | None = None) -> DataFrame:
    """A row per confirmed notice, and per line with a cue that no notice has:
    doc_id, block_start, block_chars, license, reduction, coverage, missing, added
    (words), confirmed. The block is made of the lines over which the notice goes.

    Whole texts are looked through. Null and empty texts, and texts without a
    cue, have no rows; repeated rows have theirs again. Without templates nothing
    is named. Columns but doc_id and text are not read.
    """
    templates = dict(TEMPLATES if templates is None else templates)
    pattern, decided = cues(templates), deciding(wordings(templates))
    names = ["doc_id", "block_start", "block_chars", "license", "reduction", "coverage", "missing", "added", "confirmed"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(),
             pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_()]

    def run(batches):
        scanner = Scanner(templates, decided)
        for batch in batches:
            rows = []
            for d, t in zip(batch.column(0), batch.column(1)):
                rows += [(d.as_py(), *r) for r in scanner.rows(t.as_py() or "")]
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t_) for c, t_ in zip(zip(*rows), types)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t_) for c, t_ in zip(zip(*rows), types)], names)

    return (docs.where(F.col("text").rlike("(?i)" + pattern)).select(F.col("doc_id").cast("long"), "text")
            .mapInArrow(run, "doc_id long, block_start long, block_chars long, license string, reduction double, "
                             "coverage double, missing array<string>, added array<string>, confirmed boolean"))
