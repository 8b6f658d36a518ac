"""Licence scan by matching statistics over a suffix automaton.

The words of all licence templates form one generalised suffix automaton. A
text's words are streamed through it; at each word the automaton knows the
longest stretch ending there that stands in some template, and by its links the
shorter ones of other templates. Stretches that cannot be prolonged are matches;
those of one template that follow one another in both texts, with a limited gap,
are chained. A chain gives the template's
label if it covers enough of the template and, in one match, the template's
deciding words, those that tell its licence and version from others. Of chains
that overlap the one that covers most words wins, so a notice that is part of
another, or differs from it in a word, doesn't give both labels.

A template can only be found where its deciding words stand, so texts without
any are skipped. Only words of the templates can be part of a match, so
stretches between other words are looked at one by one; matches come out as if
every word had been streamed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import map_arrow, read_table
from ._text import LOWER, runs, slices, text_column, utf8
from .stats import _encoded

# Phrases that always count, and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = (
    "This {0} is free software: you can redistribute it and/or modify it under the terms of the {1} as published by the Free Software Foundation, either version {2} "
    "of the License, or (at your option) any later version. This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
    "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {1} for more details."
)
_GNU_FIRST = _GNU.split(" of the License")[0] + " of the License"
_PUBLIC, _LESSER, _AFFERO = "GNU General Public License", "GNU Lesser General Public License", "GNU Affero General Public License"
# Labels of identifiers in tags.
SPDX = (
    ("mit", "MIT"), ("apache-2", "Apache-2.0"), ("gpl-2", "GPL-2.0"), ("gpl-3", "GPL-3.0"), ("lgpl-2.1", "LGPL-2.1"), ("lgpl-3", "LGPL-3.0"),
    ("agpl-3", "AGPL-3.0"), ("bsd-2", "BSD-2-Clause"), ("bsd-3", "BSD-3-Clause"), ("isc", "ISC"), ("mpl-2", "MPL-2.0"), ("epl-2", "EPL-2.0"),
    ("zlib", "Zlib"), ("bsl-1", "BSL-1.0"), ("unlicense", "Unlicense"), ("artistic-2", "Artistic-2.0"), ("cc0", "CC0-1.0"), ("cc-by", "CC-BY-4.0"),
    ("cc-by-sa", "CC-BY-SA-4.0"), ("cc-by-nd", "CC-BY-ND-4.0"), ("cc-by-nc", "CC-BY-NC-4.0"), ("cc-by-nc-sa", "CC-BY-NC-SA-4.0"), ("cc-by-nc-nd", "CC-BY-NC-ND-4.0"),
)
# Labels, deciding words, and licence notices and texts.
TEMPLATES = (
    ("mit", "mit license", "Released under the MIT License."),
    ("mit", "mit license", "This project is licensed under the terms of the MIT License."),
    (
        "mit",
        "to use copy modify merge publish distribute sublicense",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software.",
    ),
    ("mit", "warranties of merchantability fitness for a particular purpose and noninfringement", _WARRANTY),
    ("apache-2", "apache license version 2", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2",
        "apache license version 2",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        "an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License.",
    ),
    (
        "apache-2",
        "perpetual worldwide non exclusive no charge royalty free irrevocable copyright license",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, "
        "royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute "
        "the Work and such Derivative Works in Source or Object form.",
    ),
    ("cc-by-nc", "cc by nc 4", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "cc by 4", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "cc by sa 4", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by", "creative commons attribution 4", "This work is licensed under the Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "creative commons attribution sharealike 4", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nd", "creative commons attribution noderivatives 4", "This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License"),
    (
        "cc0",
        "waived all copyright and related or neighboring rights",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    ),
    ("gpl-3", "gnu general public license version 3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2", "gnu general public license version 2", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl", "gnu general public license", "This work is licensed under the GNU General Public License."),
    ("lgpl-3", "gnu lesser general public license version 3", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("lgpl-2.1", "gnu lesser general public license version 2 1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("agpl-3", "gnu affero general public license version 3", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("gpl-3", "either version 3 of the license", _GNU.format("program", _PUBLIC, "3")),
    ("gpl-2", "either version 2 of the license", _GNU.format("program", _PUBLIC, "2")),
    ("lgpl-3", "either version 3 of the license", _GNU.format("library", _LESSER, "3")),
    ("lgpl-2.1", "either version 2 1 of the license", _GNU.format("library", _LESSER, "2.1")),
    ("agpl-3", "either version 3 of the license", _GNU.format("program", _AFFERO, "3")),
    (
        "mpl-2",
        "mozilla public license v 2 0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at",
    ),
    ("bsd-2", "redistributions in binary form must reproduce the above copyright notice", _BSD + _BSD_WARRANTY),
    (
        "bsd-3",
        "may be used to endorse or promote products derived from this software without specific prior written permission",
        _BSD + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission. " + _BSD_WARRANTY,
    ),
    (
        "isc",
        "use copy modify and or distribute this software for any purpose with or without fee",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "zlib",
        "altered source versions must be plainly marked as such",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to "
        "the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source "
        "versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any "
        "source distribution.",
    ),
    (
        "bsl-1",
        "use reproduce display distribute execute and transmit the software",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this "
        "license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to "
        "permit third-parties to whom the Software is furnished to do so",
    ),
    (
        "unlicense",
        "free and unencumbered software released into the public domain",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    ("cc-by-nc-sa", "cc by nc sa 4", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nc-nd", "cc by nc nd 4", "Licensed under CC BY-NC-ND 4.0"),
    ("cc-by-nd", "cc by nd 4", "Licensed under CC BY-ND 4.0"),
    ("cc-by-nc-sa", "creative commons attribution noncommercial sharealike 4", "This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nc-nd", "creative commons attribution noncommercial noderivatives 4", "This work is licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("gpl-3", "gnu general public license version 3", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("gpl-2", "gnu general public license version 2", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("lgpl-3", "gnu lesser general public license version 3", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("lgpl-2.1", "gnu lesser general public license version 2 1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("agpl-3", "gnu affero general public license version 3", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("gpl-3", "either version 3 of the license", _GNU_FIRST.format("program", _PUBLIC, "3")),
    ("gpl-2", "either version 2 of the license", _GNU_FIRST.format("program", _PUBLIC, "2")),
    ("lgpl-3", "either version 3 of the license", _GNU_FIRST.format("library", _LESSER, "3")),
    ("lgpl-2.1", "either version 2 1 of the license", _GNU_FIRST.format("library", _LESSER, "2.1")),
    ("agpl-3", "either version 3 of the license", _GNU_FIRST.format("program", _AFFERO, "3")),
    ("epl-2", "eclipse public license 2 0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("epl-2", "eclipse public license v 2 0", "Eclipse Public License - v 2.0"),
    ("mpl-2", "mozilla public license version 2 0", "Mozilla Public License Version 2.0"),
    ("artistic-2", "artistic license 2 0", "Licensed under the Artistic License 2.0"),
    *((label, f"spdx license identifier {' '.join(re.split('[-.]', name.lower()))}", f"SPDX-License-Identifier: {name}") for label, name in SPDX),
)
#: Words of the shortest match, words between two matches of a chain, and the share of a template that a chain covers.
SHORTEST, GAP, COVER = 3, 20, 0.75

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def words_of(text: str) -> list[bytes]:
    raw = LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = runs(_WORD[raw], np.array([0, len(raw)]))
    return [raw[a:b].tobytes() for a, b in zip(starts, ends)]


@dataclass
class Automaton:
    """Suffix automaton of several sequences of numbers, with a place of each state in each sequence that has it."""

    sequences: list[list[int]]
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    #: (sequence, end) of all occurrences of a state's strings.
    ends: list[set[tuple[int, int]]] = field(default_factory=lambda: [set()])

    def __post_init__(self) -> None:
        for number, sequence in enumerate(self.sequences):
            last = 0
            for end, symbol in enumerate(sequence, 1):
                last = self._extend(last, symbol)
                self.ends[last].add((number, end))
        for state in sorted(range(1, len(self.step)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[state]] |= self.ends[state]
        self.ends[0] = set()

    def _new(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.step) - 1

    def _extend(self, last: int, symbol: int) -> int:
        known = self.step[last].get(symbol)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        fresh = None if known is not None else self._new(self.length[last] + 1, {}, 0)
        at = last
        if fresh is not None:
            while at != -1 and symbol not in self.step[at]:
                self.step[at][symbol] = fresh
                at = self.link[at]
            if at == -1:
                return fresh
            known = self.step[at][symbol]
        if self.length[known] == self.length[at] + 1:
            target = known
        else:
            target = self._new(self.length[at] + 1, dict(self.step[known]), self.link[known])
            self.link[known] = target
            while at != -1 and self.step[at].get(symbol) == known:
                self.step[at][symbol] = target
                at = self.link[at]
        if fresh is None:
            return target
        self.link[fresh] = target
        return fresh

    def matches(self, symbols: list[int], shortest: int) -> Iterator[tuple[int, int, int, int]]:
        """(end, length, sequence, end in it) of each stretch of ``shortest`` symbols or more that stands in both and can't be prolonged.

        The state reached at a symbol has the longest stretch that ends there;
        the states that it links to have the shorter ones of other sequences.
        """
        state = length = 0
        for at in range(1, len(symbols) + 1):
            symbol, after = symbols[at - 1], symbols[at] if at < len(symbols) else None
            while state and symbol not in self.step[state]:
                state = self.link[state]
                length = self.length[state]
            if symbol in self.step[state]:
                state, length = self.step[state][symbol], length + 1
            else:
                state = length = 0
            here, size, longer = state, length, set()
            while size >= shortest:
                for sequence, end in self.ends[here] - longer:
                    known = self.sequences[sequence]
                    if end == len(known) or known[end] != after:
                        yield at, size, sequence, end
                longer = self.ends[here]
                here = self.link[here]
                size = self.length[here]


class Span(NamedTuple):
    """A template's best chain: words from ``first`` to before ``end``, of which ``covered`` are the template's."""

    template: int
    first: int
    end: int
    covered: int


class Scanner:
    """Phrases and templates made ready for scanning. Templates are (label, deciding words, text)."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES, shortest=SHORTEST, gap=GAP, cover=COVER):
        self.labels = [label for label, _, _ in templates]
        texts = [words_of(text) for _, _, text in templates]
        keys = [words_of(key) for _, key, _ in templates]
        self.phrases = [(words_of(phrase), label) for phrase, label in phrases]
        vocabulary = {w: None for words in [*texts, *(p for p, _ in self.phrases)] for w in words}
        number = {w: n for n, w in enumerate(vocabulary)}
        self.vocabulary = pa.array(list(vocabulary), pa.large_binary())
        sequences = [[number[w] for w in words] for words in texts]
        self.automaton = Automaton(sequences)
        self.sizes = [len(words) for words in texts]
        self.phrases = [([number[w] for w in words], label) for words, label in self.phrases]
        self.keys = [[number[w] for w in words] for words in keys]
        #: Where the deciding words stand in each template.
        self.decided = []
        for words, key in zip(sequences, self.keys):
            at = next((k for k in range(len(words) - len(key) + 1) if words[k : k + len(key)] == key), None)
            if at is None:
                raise ValueError("a template has its deciding words")
            self.decided.append((at, at + len(key)))
        self.shortest, self.gap, self.cover = shortest, gap, cover

    def spans(self, symbols: np.ndarray) -> list[Span]:
        """The best chain with the deciding words of each template that has one.

        ``symbols``: vocabulary numbers of one text's words, -1 for others.
        """
        known = symbols >= 0
        if not known.any():
            return []
        edge = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
        found: dict[int, list[tuple[int, int, int]]] = {}
        for a, b in zip(edge[::2], edge[1::2]):
            if b - a >= self.shortest:
                for end, length, template, at in self.automaton.matches(symbols[a:b].tolist(), self.shortest):
                    found.setdefault(template, []).append((a + end - length, a + end, at))
        chains = (self._chain(t, sorted(rows)) for t, rows in sorted(found.items()))
        return [c for c in chains if c is not None]

    def _chain(self, template: int, rows: list[tuple[int, int, int]]) -> Span | None:
        """The chain that covers most of a template, of those with a match that has the deciding words.

        Each match (start, end, end in the template) follows the best earlier
        one that ends at most ``gap`` words before it and earlier in the
        template; words they share count once.
        """
        low, high = self.decided[template]
        best: Span | None = None
        open_: list[tuple[int, int, int, int, bool]] = []
        for start, end, at in rows:
            open_ = [x for x in open_ if x[1] + self.gap >= start]
            decides = at - (end - start) <= low and high <= at
            chains = {decides: (end - start, start)}
            for s, e, t, c, d in open_:
                if e < end and t < at:
                    new = min(end - max(start, e), at - max(at - (end - start), t))
                    both = d or decides
                    if c + new > chains.get(both, (0, 0))[0]:
                        chains[both] = (c + new, s)
            for d, (covered, first) in chains.items():
                # of chains that end alike, the one that covers most is enough
                open_ = [x for x in open_ if not (x[1:3] == (end, at) and x[4] == d and x[3] <= covered)]
                open_.append((first, end, at, covered, d))
                if d and (best is None or covered > best.covered):
                    best = Span(template, first, end, covered)
        return best

    def share(self, span: Span) -> float:
        return min(span.covered / self.sizes[span.template], 1.0)

    def chosen(self, spans: list[Span]) -> list[Span]:
        """Spans that cover enough of their templates; of overlapping ones that which covers most words, then most of its template."""
        out: list[Span] = []
        for s in sorted(spans, key=lambda s: (-s.covered, -self.share(s), s.template)):
            if self.share(s) >= self.cover and all(s.end <= o.first or o.end <= s.first for o in out):
                out.append(s)
        return sorted(out, key=lambda s: s.first)

    def _places(self, ids: np.ndarray, owner: np.ndarray, phrase: list[int]) -> np.ndarray:
        """Where the words of ``phrase`` stand consecutively in one text."""
        k = len(phrase)
        here = np.ones(max(0, len(ids) - k + 1), bool)
        for j, symbol in enumerate(phrase):
            here &= ids[j : j + len(here)] == symbol
        at = np.flatnonzero(here)
        return at[owner[at] == owner[at + k - 1]] if len(at) else at

    def scan(self, texts: pa.Array) -> dict[str, list | np.ndarray]:
        """Columns of the result for each text."""
        raw, offs = utf8(texts)
        raw = LOWER[raw]
        starts, ends, first = runs(_WORD[raw], offs)
        coded = _encoded(raw, starts, ends)
        place = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False)
        ids = place[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int32)
        n = len(texts)
        counts = np.diff(first)
        owner = np.repeat(np.arange(n), counts)
        nth = np.arange(len(ids)) - first[:-1][owner]
        base = [set() for _ in range(n)]
        n_base, low, high = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        for phrase, label in self.phrases:
            at = self._places(ids, owner, phrase)
            np.add.at(n_base, owner[at], 1)
            np.minimum.at(low, owner[at], nth[at])
            np.maximum.at(high, owner[at], nth[at])
            for d in np.unique(owner[at]):
                base[d].add(label)
        decided = np.zeros(n, bool)
        for key in {tuple(k) for k in self.keys}:
            decided[owner[self._places(ids, owner, list(key))]] = True
        labels, scores, spans = [set(b) for b in base], np.zeros(n), [[] for _ in range(n)]
        for d in np.flatnonzero(decided):
            found = self.spans(ids[first[d] : first[d + 1]])
            scores[d] = max(map(self.share, found), default=0.0)
            for s in self.chosen(found):
                labels[d].add(self.labels[s.template])
                spans[d].append({"first": int(s.first), "end": int(s.end), "template": s.template, "label": self.labels[s.template], "share": self.share(s)})
        scores = np.where([bool(b) for b in base], 1.0, scores) if n else scores
        none = n_base == 0
        return {
            "n_words": counts,
            "n_base": n_base,
            "first_word": pa.array(low, mask=none),
            "last_word": pa.array(high.astype(np.int64), mask=none),
            "base_labels": [",".join(sorted(b)) for b in base],
            "labels": [",".join(sorted(x)) for x in labels],
            "score": np.minimum(scores, 1.0),
            "spans": pa.array(spans, SPANS),
        }


_SPAN = {"first": ("long", pa.int64()), "end": ("long", pa.int64()), "template": ("int", pa.int32()), "label": ("string", pa.string()), "share": ("double", pa.float64())}
SPANS = pa.list_(pa.struct([(name, kind) for name, (_, kind) in _SPAN.items()]))


def scan(docs: DataFrame, scanner: Scanner | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words, phrases, labels, score and spans of each row of ``docs``.

    Spans are the chosen chains: words from ``first`` to before ``end``, the
    template's number and label, and the share of it that they cover. Null and
    empty texts have no words, labels or spans and score 0. A very long text is
    one step of its worker. Null ids stay null and repeated rows repeated; other
    columns, whatever their names, are not read; an empty table gives an empty
    one. Chains that tie go by the lower number of their template.
    """
    used = scanner or Scanner()
    kinds = {"n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string", "labels": "string", "score": "double"}
    kinds["spans"] = f"array<struct<{', '.join(f'`{c}`: {k}' for c, (k, _) in _SPAN.items())}>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = used.scan(text_column(part))
                columns = [v if isinstance(v, pa.Array) else pa.array(v, pa.string() if isinstance(v, list) else None) for v in found.values()]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["id", *found])

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = ", ".join([f"id {kind}", *(f"{c} {k}" for c, k in kinds.items())])
    return map_arrow(chosen, run, schema).withColumnRenamed("id", id_col)


def op3_suffix_automaton_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``scan`` for each document; nulls, repeated rows, ties and long texts as there."""
    return scan(read_table(spark, sf_dir, "documents"))
