"""License scans by Dice coefficient over word bigrams.

Text is normalised (lower case, words of letters and digits only) and compared
with license templates: ``2 |A & B| / (|A| + |B|)`` over the sets of word
bigrams.  A template can reach the threshold only if its number of bigrams lies
within the size bounds the threshold gives, so most are pruned by size, and
a passage longer than every bound is not looked at.  A text falls into units, which end with a sentence
or a line; passages compared are the units and runs of units that begin at one sharing a bigram with
some template and go on while at least half the threshold's share of their bigrams is in templates, so notices inside prose, texts inside a long line and licenses set over many
lines are all found.
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwalk.llm.common import quoted, ready

THRESHOLD = 0.8
WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"(?<=[.!?])\s+")

# Names by which notices call licenses.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "MIT": ["MIT License", "MIT license"],
    "ISC": ["ISC License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GPL version 2", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GPL version 3", "GPLv3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPL version 2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPL version 3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPL version 3"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "MPL 2.0"],
    "EPL-2.0": ["Eclipse Public License, version 2.0", "EPL 2.0"],
    "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0 1.0 Universal", "CC0 1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
}
# The usual wordings of a notice.
NOTICES = [
    "Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "This work is licensed under {}.",
    "This work is licensed under the {}.", "This work is licensed under a {}.", "This software is released under the {}.",
    "This project is licensed under the {}.", "This program is distributed under the terms of the {}.",
]
# License texts and standard headers.
_BSD = ('Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following '
        'conditions are met: ')
_BSD_2 = ('1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. '
          '2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer '
          'in the documentation and/or other materials provided with the distribution. ')
_BSD_3 = ('3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived '
          'from this software without specific prior written permission. ')
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    'LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE '
    'COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES '
    '(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) '
    'HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) '
    'ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.')
_GNU = (
    'This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} Public License as published by the '
    'Free Software Foundation{3} either version {4} of the License, or (at your option) any later version. This {0} is distributed in the '
    'hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A '
    'PARTICULAR PURPOSE. See the GNU {2} Public License for more details.')
TEXTS = {
    "MIT": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation '
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        'modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software '
        'is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be '
        'included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, '
        'EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND '
        'NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER '
        'IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS '
        'IN THE SOFTWARE.'],
    "ISC": [
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided '
        'that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR '
        'DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT '
        'SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM '
        'LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN '
        'CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'],
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        'You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to '
        'in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY '
        'KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'],
    "MPL-2.0": [
        'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with '
        'this file, You can obtain one at https://mozilla.org/MPL/2.0/.'],
    "GPL-3.0": [
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as '
        'published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is '
        'distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or '
        'FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.'],
    "GPL-2.0": [
        'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as '
        'published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is '
        'distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or '
        'FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.'],
    "BSD-2-Clause": [_BSD + _BSD_2 + _BSD_END],
    "BSD-3-Clause": [_BSD + _BSD_2 + _BSD_3 + _BSD_END],
    "LGPL-2.1": [_GNU.format("library", ";", "Lesser General", ";", "2.1")],
    "LGPL-3.0": [_GNU.format("library", ":", "Lesser General", ",", "3")],
    "AGPL-3.0": [_GNU.format("program", ":", "Affero General", ",", "3")],
    "EPL-2.0": [
        'This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is '
        'available at https://www.eclipse.org/legal/epl-2.0/.'],
    "CC0-1.0": [
        'To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. To view a '
        'copy of the CC0 1.0 Universal legal code, visit https://creativecommons.org/publicdomain/zero/1.0/.'],
    **{f"CC-{short.upper()}-4.0": [
        f'This work is licensed under a Creative Commons {name} 4.0 International License. To view a copy of this license, visit '
        f'http://creativecommons.org/licenses/{short}/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.']
       for short, name in [("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nc", "Attribution-NonCommercial"),
                           ("by-nd", "Attribution-NoDerivatives"), ("by-nc-sa", "Attribution-NonCommercial-ShareAlike")]},
    "Unlicense": [
        'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, '
        'sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or '
        'non-commercial, and by any means.'],
}


def default_templates() -> list[tuple[str, str]]:
    """(license, text) of the notices and texts above."""
    return [(lic, n.format(name)) for lic, names in NAMES.items() for name in names for n in NOTICES] + [
        (lic, t) for lic, texts in TEXTS.items() for t in texts]


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def bigrams(words: list[str]) -> frozenset:
    return frozenset(zip(words, words[1:]))


class Scanner:
    """Templates sorted by size, with an index of their bigrams."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float = THRESHOLD):
        found = {(lic, bigrams(tokens(text))) for lic, text in templates}
        self.templates = sorted(((lic, b) for lic, b in found if b), key=lambda x: (len(x[1]), x[0], sorted(x[1])))
        self.threshold = threshold
        self.holders: dict = {}
        for k, (_, b) in enumerate(self.templates):
            for g in b:
                self.holders.setdefault(g, []).append(k)
        self.known = frozenset(self.holders)
        self.starts = frozenset(a for a, _ in self.holders)
        # dice >= t needs max(size) <= (2 - t) / t * min(size)
        self.ratio = (2 - threshold) / threshold + 1e-9  # not below the bound by rounding
        self.largest = self.ratio * max((len(b) for _, b in self.templates), default=0)

    def best(self, grams) -> tuple[float, str] | None:
        """Best (dice, license) of a passage at or over the threshold; ties go
        to the first license by name."""
        n = len(grams)
        if not n or n > self.largest or self.known.isdisjoint(grams):
            return None
        shared: dict[int, int] = {}
        for g in grams & self.known:
            for k in self.holders[g]:
                size = len(self.templates[k][1])
                if n <= self.ratio * size and size <= self.ratio * n:
                    shared[k] = shared.get(k, 0) + 1
        top = min(((-2 * c / (n + len(self.templates[k][1])), self.templates[k][0]) for k, c in shared.items()), default=None)
        return (-top[0], top[1]) if top and -top[0] >= self.threshold else None

    def scan(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """Matches (start, end, license, dice) by character position, longest
        passage kind first in case of nesting: a match inside a better or
        equal one of the same license is left out."""
        if not text:
            return []
        out = []
        # passages that may go on: start, last word, number of words, known and all bigrams
        runs: list[tuple[int, str, int, set, set]] = []
        bound = 2 * self.largest + 2
        for start, end, words in self._units(text):
            if len(words) > bound:  # longer than any bound
                runs = []
                continue
            grams = bigrams(words)
            known = grams & self.known
            going = []
            for at, last, n, inside, every in runs:
                inside |= known
                every |= grams
                every.add((last, words[0]))
                if (last, words[0]) in self.known:
                    inside.add((last, words[0]))
                n += len(words)
                if n <= bound and len(every) <= self.largest and self._worth(inside, every):
                    going.append((at, words[-1], n, inside, every))
                    self._match(at, end, inside, every, out)
            runs = going
            if known:
                self._match(start, end, known, grams, out)
            if (known or words[-1] in self.starts) and len(grams) <= self.largest and self._worth(known, grams):
                runs.append((start, words[-1], len(words), set(known), set(grams)))
        out.sort(key=lambda m: (-m[3], m[0] - m[1], m[0], m[2]))
        kept: list[tuple[int, int, str, float]] = []  # disjoint, in text order
        for m in out:
            i = bisect.bisect_left(kept, (m[0],))
            if (i == len(kept) or kept[i][0] >= m[1]) and (i == 0 or kept[i - 1][1] <= m[0]):
                kept.insert(i, m)
        return kept

    def _worth(self, known, grams) -> bool:
        """May a passage begin with these bigrams: a beginning of which less than half the
        threshold is known lowers the coefficient, so what follows it is a better passage."""
        return 2 * len(known) >= self.threshold * len(grams)

    def _match(self, start: int, end: int, known, grams, out: list) -> None:
        # with a template of s bigrams the coefficient is at most 2 c / (n + c) for c known ones of n
        if len(known) * self.ratio >= len(grams):
            hit = self.best(grams)
            if hit:
                out.append((start, end, hit[1], hit[0]))

    @staticmethod
    def _units(text: str):
        """(start, end, words) of the sentences of every line that have a word."""
        at = 0
        for line in text.split("\n"):
            pos = 0
            for left, right in [*((m.start(), m.end()) for m in SENTENCE.finditer(line)), (len(line), len(line))]:
                words = tokens(line[pos:left])
                if words:
                    yield at + pos, at + left, words
                pos = right
            at += len(line) + 1


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None,
         threshold: float = THRESHOLD) -> DataFrame:
    """One row per match: the id, start and end (character positions), license
    and dice.  Matches of a text don't overlap: of overlapping ones the better
    is kept, of equal ones the longer.  Null and empty texts and an empty table give no rows; rows with
    a null id keep it.  ``templates`` (license, text) may repeat; those of fewer than two words
    never match."""
    ready(docs.sparkSession)
    pair = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    given = list(templates if templates is not None else default_templates())
    schema = T.StructType([pair.schema["id"], T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                           T.StructField("license", T.StringType()), T.StructField("dice", T.DoubleType())])

    def run(batches):
        scanner = Scanner(given, threshold)
        for b in batches:
            rows = [(k, *m) for k, t in enumerate(b.column(1).to_pylist()) for m in scanner.scan(t)]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                                              pa.array(cols[3], pa.string()), pa.array(cols[4], pa.float64())], names=schema.names)
    return pair.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def licenses_digest(docs: DataFrame) -> DataFrame:
    """Query form: one row per document and license with the number of matches
    and the best coefficient."""
    return scan(docs.select("doc_id", "text")).groupBy("doc_id", "license").agg(
        F.count(F.lit(1)).alias("n_matches"), F.round(F.max("dice"), 6).alias("dice"), F.min("start").alias("first_at"))
