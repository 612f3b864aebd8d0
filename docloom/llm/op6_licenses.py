"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

The units of a text are its lines, its paragraphs (runs of lines between lines without words), the whole text, and windows
of words: for each template and each bigram of it, the best window that starts there and has at most 1 / least times the
template's bigrams. A window that starts or ends with a bigram the template lacks is worse than one without it, so this
is the best of all windows of that length, wherever lines and paragraphs end. Words are
lower-cased runs of letters and digits, which may hold inner points and hyphens; copyright lines, which differ between copies, are left out of
templates, of units of several lines and of windows. Dice = 2 * |A & B| / (|A| + |B|) over sets of bigrams (of a single word: the word
itself) can reach LEAST only if |A| lies between LEAST / (2 - LEAST) and its inverse times |B|; templates sorted by size
are pruned by that bound before anything is compared. Of units that overlap, the better match stays, then the longer, then
the earlier.

Defined results: null or empty text, or no match: no licence, dice 0. Ties between templates go to the name that sorts
first. Repeated rows are scanned each. Other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, strings, table

LEAST = 0.9
WORDS = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")
COPYRIGHT = re.compile(r"^\s*(?:copyright|\(c\)|©).*$", re.I | re.M)

# Texts and notices of common licences.
_BSD_3 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."],
    "BSD-2-Clause": [
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", _BSD_3],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."],
    "LGPL-3.0": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library. If not, see <https://www.gnu.org/licenses/>."],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
}


def bigrams(text: str) -> frozenset:
    words = WORDS.findall(text.lower())
    return frozenset(zip(words, words[1:], strict=False)) if len(words) > 1 else frozenset((w,) for w in words)


class Templates:
    def __init__(self, templates: dict[str, list[str]] = TEMPLATES):
        made = sorted((len(g), name, g) for name, texts in templates.items() for g in (bigrams(COPYRIGHT.sub("", t)) for t in texts))
        self.sizes, self.made = [m[0] for m in made], made
        # bigrams with repeats, by the set: what bounds a window
        self.long = {bigrams(COPYRIGHT.sub("", t)): len(WORDS.findall(COPYRIGHT.sub("", t).lower())) - 1 for texts in templates.values() for t in texts}
        self.known = frozenset().union(*(g for _, _, g in made))
        self.least, self.most = LEAST / (2 - LEAST), (2 - LEAST) / LEAST

    def best(self, grams: frozenset) -> tuple[float, str]:
        """The best Dice coefficient of at least LEAST, and its licence; (0, "") if there is none."""
        n = len(grams)
        shared = grams & self.known
        if not n or 2 * len(shared) < LEAST * n:
            return 0.0, ""
        top = (0.0, "")
        for size, name, g in self.made[bisect_left(self.sizes, self.least * n - 1e-9) : bisect_right(self.sizes, self.most * n + 1e-9)]:
            dice = 2 * len(shared & g) / (n + size)
            if dice >= LEAST and (dice > top[0] or (dice == top[0] and name < top[1])):
                top = (dice, name)
        return top

    def windows(self, text: str) -> list[tuple[float, int, int, str]]:
        """Dice coefficient, start, end and licence of the best window from each place, of at least LEAST."""
        low = COPYRIGHT.sub(lambda m: " " * len(m[0]), text)
        low = low.lower() if len(low.lower()) == len(low) else "".join(c.lower() if len(c.lower()) == 1 else c for c in low)
        words = [(m.start(), m.end(), m[0]) for m in WORDS.finditer(low)]
        grams = [(a[2], b[2]) for a, b in zip(words, words[1:], strict=False)]
        places = [i for i, g in enumerate(grams) if g in self.known]
        held = {grams[i] for i in places}
        out = []
        for size, name, template in self.made:
            need = self.least * size - 1e-9
            if len(held & template) < need:
                continue
            mine = [i for i in places if grams[i] in template]
            longest, spare = int(self.most * self.long[template] + 1e-9), (self.most - 1) * size + 1e-9
            for k, a in enumerate(mine):
                if bisect_right(mine, a + longest - 1) - k < need:
                    continue
                seen, shared, top, last = set(), 0, 0.0, 0
                for i in range(a, min(a + longest, len(grams))):
                    if grams[i] not in seen:
                        seen.add(grams[i])
                        shared += grams[i] in template
                        if len(seen) - shared > spare:
                            break  # even with the whole template it stays below LEAST
                    dice = 2 * shared / (len(seen) + size)
                    if dice >= LEAST and (dice > top or (dice == top and grams[i] in template)):
                        top, last = dice, i
                if top:
                    out.append((top, words[a][0], words[last + 1][1], name))
        return out

    def scan(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """start, end (code points), licence and Dice coefficient of each match, by start."""
        text = text or ""
        units: list[tuple[int, int, frozenset]] = []
        at, run, first = 0, set(), 0
        n_lines = 0

        def close(end: int) -> None:
            nonlocal run, n_lines
            if n_lines > 1:
                units.append((first, end, bigrams(COPYRIGHT.sub("", text[first:end]))))
            run, n_lines = set(), 0

        hits, last = False, ""
        for line in text.split("\n"):
            end = at + len(line)
            words = WORDS.findall(line.lower())
            g = frozenset(zip(words, words[1:], strict=False)) if len(words) > 1 else frozenset((w,) for w in words)
            if g:
                hits, last = hits or (last, words[0]) in self.known, words[-1]
                if not n_lines:
                    first = at
                n_lines += 1
                hits = hits or not g.isdisjoint(self.known)
                units.append((at, end, g))
            else:
                close(at)
            at = end + 1
        if not hits:
            return []
        close(len(text))
        if not units or (units[0][0], units[-1][1]) != (0, len(text)) or len(units) > 1:
            units.append((0, len(text), bigrams(COPYRIGHT.sub("", text))))
        found = [(-d, a - b, a, b, name) for a, b, g in units for d, name in [self.best(g)] if name]
        found += [(-d, a - b, a, b, name) for d, a, b, name in self.windows(text)]
        kept: list[tuple[int, int, str, float]] = []
        for d, _, a, b, name in sorted(found):
            if all(b <= x or y <= a for x, y, _, _ in kept):
                kept.append((a, b, name, -d))
        return sorted(kept)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, matches (start, end, license, dice) for docs (doc_id, text)."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("dice", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Templates()
        for b in batches:
            found = [[dict(zip(("start", "end", "license", "dice"), m, strict=True)) for m in t.scan(x)] for x in strings(b["text"])]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(found, kind)], ["doc_id", "matches"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, matches array<struct<start:long,end:long,license:string,dice:double>>")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.selectExpr("doc_id", "cast(size(matches) as long) as n_licenses", "array_join(array_sort(array_distinct(transform(matches, m -> m.license))), ',') as licenses", "coalesce(array_max(transform(matches, m -> m.dice)), 0D) as dice", "array_join(transform(matches, m -> concat_ws(':', m.license, m.start, m.end)), ',') as spans")
