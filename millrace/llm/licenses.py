"""License scans by conditional compression.

Blocks of a text (lines with a word that license notices use, and the paragraph around them) are
compared with the wording of every template: all of the template's words, in order, must be found in
the block as one run with at most ``MAX_DIFF`` of them changed, missing or added. Each run so
confirmed is compressed with zstandard on its own and with the template as raw dictionary; the
template's score is the share of the run's compressed size that it saves, and ranks the templates. The
score is of the run, not of the block, and drops none, so neither neighbouring notices nor a long line
around it hide a notice.

Templates may differ in a word only (a version, a licensor's name): of two whose runs lie one in the other,
the outer one with fewer changes, the inner one isn't confirmed.

Null and empty texts have no blocks. Very long texts and paragraphs are read whole. Ties between templates go to
the one that explains more words, then by name. Repeated rows, null and repeated ids are scanned one by one; other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Notices of public licenses and the paragraphs of short ones, as usually worded.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "Apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-3-Clause-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "proprietary": "All rights reserved.",
}
TRIGGER = re.compile(r"licen[sc]|permission|redistribut|copyright|rights reserved|free software|public domain|creative commons", re.I)
LEVEL, MAX_DIFF = 3, 0.1
#: Characters of a block, and blocks, whose result a worker remembers.
SHORT, REMEMBERED = 2_000, 10_000
_WORD = re.compile(r"[a-z0-9][a-z0-9.\-/]*[a-z0-9]|[a-z0-9]")


def wording(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def most_changes(n: int) -> int:
    """How many of n words may differ."""
    return max(k for k in range(n + 1) if k <= MAX_DIFF * n)


def nearest(template: list[str], words: list[str], k: int) -> tuple[int, int, int] | None:
    """(changes, from, to) of the run of the words with the fewest changes, k at most: the larger of the template's words it lacks and its own that the template lacks."""
    n, best = len(template), None
    # starts[i][a]: the last start of a run ending here that holds the first i words of the template but a of them, in order
    starts = [[0 if a == i else -1 for a in range(k + 1)] for i in range(n + 1)]
    for j, word in enumerate(words, 1):
        new = [row[:] for row in starts]
        for i in range(n + 1):
            for a in range(k + 1):
                if i == a:
                    new[i][a] = j
                    continue
                if i and template[i - 1] == word:
                    new[i][a] = max(new[i][a], starts[i - 1][a])
                if i and a:
                    new[i][a] = max(new[i][a], new[i - 1][a - 1])
        starts = new
        for a, lo in enumerate(starts[n]):
            if lo >= 0 and (changes := max(a, j - lo - n + a)) <= k and (best is None or changes < best[0]):
                best = changes, lo, j
    return best


class Wordings:
    """Finds every template in a block, by its words. A run with k changes has at most 2k + 1 stretches
    of the template, so the longest has a gram of a length that is known: only where one is found the
    words are compared, and no run within ``MAX_DIFF`` is passed over."""

    def __init__(self, templates: dict[str, str]):
        self.templates = {n: w for n, t in sorted(templates.items()) if (w := wording(t))}
        self.changes = {n: most_changes(len(w)) for n, w in self.templates.items()}
        self.grams: dict[int, dict[tuple, list]] = {}
        for name, w in self.templates.items():
            k = self.changes[name]
            size = -(-(len(w) - k) // (2 * k + 1))
            for at in range(len(w) - size + 1):
                self.grams.setdefault(size, {}).setdefault(tuple(w[at : at + size]), []).append((name, at))

    def find(self, words: list[str]) -> dict[str, tuple[int, int, int]]:
        """(changes, from, to) of the best run of each template that is in the words."""
        starts: dict[str, set[int]] = {}
        for size, grams in self.grams.items():
            for p in range(len(words) - size + 1):
                for name, at in grams.get(tuple(words[p : p + size]), ()):
                    starts.setdefault(name, set()).add(p - at)
        found = {}
        for name, at in starts.items():
            template, k = self.templates[name], self.changes[name]
            exact = [lo for lo in at if lo >= 0 and words[lo : lo + len(template)] == template]
            if exact:
                found[name] = 0, min(exact), min(exact) + len(template)
                continue
            best = None
            spans: list[list[int]] = []
            for lo in sorted(at):
                if spans and lo - k <= spans[-1][1]:
                    spans[-1][1] = lo + len(template) + k
                else:
                    spans.append([max(0, lo - k), lo + len(template) + k])
            for lo, hi in spans:
                # only a stretch with enough of the template's words can hold a run
                if sum((Counter(template) & Counter(words[lo:hi])).values()) < len(template) - k:
                    continue
                run = nearest(template, words[lo:hi], k)
                if run and (best is None or run[0] < best[0]):
                    best = run[0], lo + run[1], lo + run[2]
            if best:
                found[name] = best
        return found


def told(template: list[str], run: list[str]) -> str:
    """The differing words."""
    ops = difflib.SequenceMatcher(None, template, run, autojunk=False).get_opcodes()
    return "; ".join(f"{' '.join(template[a:b])} > {' '.join(run[c:d])}" for op, a, b, c, d in ops if op != "equal")


def blocks(text: str) -> list[str]:
    """Paragraphs (lines up to a blank one) that speak of licensing, whole."""
    out, held = [], []
    for line in [*text.split("\n"), ""]:
        if line.strip():
            held.append(line)
        elif held:
            out.append("\n".join(held))
            held = []
    return [b for b in out if TRIGGER.search(b)]


def confirmed(found: dict[str, tuple[int, int, int]]) -> dict[str, tuple[int, int, int]]:
    """Without the runs that lie in a run of fewer changes."""
    return {n: run for n, run in found.items() if not any(c < run[0] and lo <= run[1] and run[2] <= hi for c, lo, hi in found.values())}


class Scanner:
    def __init__(self, templates: dict[str, str]):
        import zstandard as z

        self.plain = z.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.wordings = Wordings(templates)
        self.given = {n: z.ZstdCompressor(level=LEVEL, write_content_size=False, dict_data=z.ZstdCompressionDict(templates[n].lower().encode(), dict_type=z.DICT_TYPE_RAWCONTENT)) for n in self.wordings.templates}
        self.seen: dict[str, list] = {}

    def scan(self, block: str) -> list[tuple[str, float, float, str]]:
        """(template, share saved, difference, differing words) of confirmed templates, best first."""
        if block in self.seen:
            return self.seen[block]
        lower, found = block.lower(), []
        at = [m.span() for m in _WORD.finditer(lower)]
        words = [lower[a:b] for a, b in at]
        for name, (changes, lo, hi) in confirmed(self.wordings.find(words)).items():
            template, run = self.wordings.templates[name], lower[at[lo][0] : at[hi - 1][1]].encode()
            share = 1 - len(self.given[name].compress(run)) / len(self.plain.compress(run))
            found.append((-share, -len(template), name, changes / len(template), told(template, words[lo:hi]) if changes else ""))
        found = [(name, round(-share, 6), round(diff, 6), text) for share, _, name, diff, text in sorted(found)]
        if len(self.seen) < REMEMBERED and len(block) <= SHORT:
            self.seen[block] = found
        return found


_OUT = pa.list_(pa.struct([("license", pa.string()), ("saved", pa.float64()), ("difference", pa.float64()), ("wording", pa.string())]))


def licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_blocks, n_licensed (blocks with a confirmed template), licenses (distinct names, sorted, comma-joined) and matches."""
    templates = dict(templates or TEMPLATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            n_blocks, n_licensed, names, matches = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = [scanner.scan(b) for b in blocks(text)] if text and TRIGGER.search(text) else []
                n_blocks.append(len(found))
                n_licensed.append(sum(map(bool, found)))
                names.append(",".join(sorted({m[0] for f in found for m in f})))
                matches.append([dict(zip(("license", "saved", "difference", "wording"), m, strict=True)) for f in found for m in f])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_blocks, pa.int64()), pa.array(n_licensed, pa.int64()), pa.array(names, pa.string()), pa.array(matches, _OUT)], names=["doc_id", "n_blocks", "n_licensed", "licenses", "matches"])

    schema = "doc_id long, n_blocks long, n_licensed long, licenses string, matches array<struct<license: string, saved: double, difference: double, wording: string>>"
    return common.arrow(docs.select("doc_id", "text"), run, schema)
