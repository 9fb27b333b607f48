"""License scans by template-markup matching.

Templates are license texts with markup: <<beginOptional>> ... <<endOptional>> may be left out as a whole,
<<var;name=N;original=O;match=R>> stands for one to some words of any wording. Each template is compiled
into an automaton over words; a place of a text is accepted when the automaton reads on from there through
all mandatory words, in exactly the template's wording. Words are runs of letters, digits and non-ASCII
characters in lower case, so punctuation, case and white space never matter.

Besides, fixed phrases label a text wherever their words stand consecutively. The score is the largest
share, in whole tenths, of a template's mandatory words that one place of the text reads through, and 1.0
where a phrase is found.

Null and empty texts have no words, no labels and score 0. Repeated rows give equal rows; labels found at
several places or by several templates are named once. An empty table gives an empty result. A very long
text is read whole, as one list of words; an automaton stops where no state is left. Only doc_id and text
are read, so other columns can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, slices, text_bytes

#: The word rule, and the phrases with their labels.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

_VAR = "<<var;name={};original={};match=.{{{},{}}}>>"
_HOLDERS = _VAR.format("holders", "the copyright holders and contributors", 1, 8)
#: License wordings as templates, with the label that each gives.
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "<<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "<<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = (
    f"<<beginOptional>>3.<<endOptional>> Neither the name of {_HOLDERS} nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
_BSD_TAIL = (
    f"THIS SOFTWARE IS PROVIDED BY {_HOLDERS} \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS "
    f"FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {_HOLDERS} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, "
    "BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES: dict[str, list[str]] = {
    "mit": [
        f"{_VAR.format('verb', 'Released', 1, 2)} under the <<beginOptional>>terms of the<<endOptional>> MIT License",
        f"Permission is hereby granted, free of charge, to any person obtaining a copy of {_VAR.format('work', 'this software and associated documentation files', 1, 8)} (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        "<<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        f"NONINFRINGEMENT. IN NO EVENT SHALL {_HOLDERS} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "apache-2": [
        "Licensed under the Apache License, <<beginOptional>>Version<<endOptional>> 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        f"{_VAR.format('url', 'http://www.apache.org/licenses/LICENSE-2.0', 1, 10)} Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "gpl-3": [
        "<<beginOptional>>This work is<<endOptional>> licensed under the GNU General Public License, <<beginOptional>>version<<endOptional>> 3",
        f"{_VAR.format('program', 'This program', 1, 4)} is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License<<beginOptional>>, or (at your option) any later version<<endOptional>>.",
    ],
    "gpl-2": [
        "licensed under the GNU General Public License, version 2",
        f"{_VAR.format('program', 'This program', 1, 4)} is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation; either version 2 of the License<<beginOptional>>, or (at your option) any later version<<endOptional>>.",
    ],
    "lgpl": ["licensed under the GNU Lesser General Public License"],
    "mpl-2": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        f"{_VAR.format('url', 'https://mozilla.org/MPL/2.0/', 1, 8)}",
        "licensed under the Mozilla Public License <<beginOptional>>version<<endOptional>> 2.0",
    ],
    "bsd": [f"{_VAR.format('verb', 'Released', 1, 2)} under the {_VAR.format('kind', '3-clause', 1, 3)} BSD License"],
    "bsd-2": [_BSD_HEAD + _BSD_TAIL],
    "bsd-3": [_BSD_HEAD + _BSD_NAMES + _BSD_TAIL],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        f"appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND {_VAR.format('author', 'THE AUTHOR', 1, 6)} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        f"WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {_VAR.format('author', 'THE AUTHOR', 1, 6)} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE "
        "OF THIS SOFTWARE.",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "<<beginOptional>>1.<<endOptional>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, "
        "an acknowledgment in the product documentation would be appreciated but is not required. <<beginOptional>>2.<<endOptional>> Altered source versions must be plainly marked as such, and must "
        "not be misrepresented as being the original software. <<beginOptional>>3.<<endOptional>> This notice may not be removed or altered from any source distribution.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form "
        "or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "cc-by": ["Licensed under <<beginOptional>>a Creative Commons<<endOptional>> CC BY 4.0"],
    "cc-by-sa": [f"Licensed under <<beginOptional>>a Creative Commons<<endOptional>> CC BY-SA {_VAR.format('version', '4.0', 2, 2)}"],
    "cc-by-nc": [f"Licensed under <<beginOptional>>a Creative Commons<<endOptional>> CC BY-NC {_VAR.format('version', '4.0', 2, 2)}"],
    "cc0": ["dedicated to the public domain under <<beginOptional>>the<<endOptional>> CC0 1.0"],
}
_MARKUP = re.compile(r"<<(beginOptional|endOptional|var;[^>]*)>>")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.translate(_LOWER))


@dataclass
class Automaton:
    """States are places in the template's word sequence.

    step: state to (word, next) for words that must match. free: states that any word may leave, with the
    next states. skip: states that may move on without a word. depth: mandatory words read by then.
    """

    label: str
    step: dict[int, tuple[str, int]] = field(default_factory=dict)
    free: dict[int, list[int]] = field(default_factory=dict)
    skip: dict[int, list[int]] = field(default_factory=dict)
    depth: dict[int, int] = field(default_factory=lambda: {0: 0})
    end: int = 0

    def closure(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for t in self.skip.get(todo.pop(), ()):
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return out

    def starts(self) -> set[str]:
        """The words that a match may begin with; empty if any may."""
        open_ = self.closure({0})
        return set() if open_ & self.free.keys() else {self.step[s][0] for s in open_ if s in self.step}

    def after(self, word: str) -> frozenset[str] | None:
        """The words of which one must follow a word that a match begins with, or None.

        It is None where another word may follow, or where the first word alone already tells: it ends a match or
        makes a tenth of the score. A place without such a second word changes neither labels nor score.
        """
        states, seen = self.closure({0}), set()
        while states:
            moved = self.closure({self.step[s][1] for s in states if s in self.step and self.step[s][0] == word})
            if moved & self.free.keys() or self.end in moved or any(10 * self.depth[s] >= self.mandatory() for s in moved):
                return None
            seen |= {self.step[s][0] for s in moved if s in self.step}
            states = self.closure({t for s in states for t in self.free.get(s, ())})
        return frozenset(seen)

    def mandatory(self) -> int:
        return self.depth[self.end]

    def read(self, words: list[str], at: int) -> tuple[int, int]:
        """(end of the match or -1, most mandatory words read) from a place of a text."""
        states, best, i = self.closure({0}), 0, at
        while states:
            best = max(best, *(self.depth[s] for s in states))
            if self.end in states:
                return i, best
            if i >= len(words):
                break
            moved = {self.step[s][1] for s in states if s in self.step and self.step[s][0] == words[i]}
            moved.update(t for s in states for t in self.free.get(s, ()))
            states, i = self.closure(moved), i + 1
        return -1, best


def compile_template(label: str, template: str) -> Automaton:
    """An automaton from a template's text; raises ValueError where markup doesn't nest."""
    auto, state, opened, last = Automaton(label), 0, [], 0

    def new(depth: int) -> int:
        auto.depth[len(auto.depth)] = depth
        return len(auto.depth) - 1

    def wording(text: str) -> None:
        nonlocal state
        for w in words_of(text):
            auto.step[state] = (w, new(auto.depth[state] + (not opened)))
            state = auto.step[state][1]

    for m in _MARKUP.finditer(template):
        wording(template[last : m.start()])
        last = m.end()
        if m[1] == "beginOptional":
            opened.append(state)
        elif m[1] == "endOptional":
            if not opened:
                raise ValueError("endOptional without beginOptional")
            begin, after = opened.pop(), new(auto.depth[state])
            auto.skip.setdefault(state, []).append(after)
            auto.skip.setdefault(begin, []).append(after)
            state = after
        else:
            least, most = (int(x) for x in re.search(r"match=\.\{(\d+),(\d+)\}", m[1]).groups())
            chain = [state] + [new(auto.depth[state]) for _ in range(most)]
            for a, b in zip(chain, chain[1:], strict=False):
                auto.free.setdefault(a, []).append(b)
            for x in chain[least:-1]:
                auto.skip.setdefault(x, []).append(chain[-1])
            state = chain[-1]
    wording(template[last:])
    if opened:
        raise ValueError("beginOptional without endOptional")
    auto.end = state
    return auto


class Scanner:
    """All templates and phrases; a place is tried only where a template's rarest fixed words may follow."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> None:
        self.autos = [compile_template(label, t) for label, many in templates.items() for t in many]
        self.phrases = [(p.split(), label) for p, label in phrases.items()]
        # Each template is anchored at its first mandatory word after any optional or free beginning.
        self.by_word: dict[str, list[tuple[Automaton, int, frozenset[str] | None]]] = {}
        for a in self.autos:
            state, reach = a.closure({0}), 0
            firsts, spread = set(), set()
            while state & a.free.keys():
                spread.add(reach)
                state, reach = a.closure({t for s in state for t in a.free.get(s, ())}), reach + 1
                firsts |= {(a.step[s][0], reach) for s in state if s in a.step}
            firsts |= {(w, 0) for w in (a.step[s][0] for s in a.closure({0}) if s in a.step)}
            for w, back in firsts:
                self.by_word.setdefault(w, []).append((a, back, a.after(w)))
        self.first_words = {p[0] for p, _ in self.phrases} | self.by_word.keys()

    def scan(self, text: str) -> tuple[int, int, int | None, int | None, list[str], list[str], float]:
        """n_words, n_base, first and last place, base labels, labels, score."""
        words = words_of(text)
        places, base, labels, score = [], set(), set(), 0.0
        for i, w in enumerate(words):
            if w not in self.first_words:
                continue
            for p, label in self.phrases:
                if words[i : i + len(p)] == p:
                    places.append(i)
                    base.add(label)
            following = words[i + 1] if i + 1 < len(words) else None
            for a, back, nexts in self.by_word.get(w, ()):
                if i >= back and (nexts is None or following in nexts):
                    end, read = a.read(words, i - back)
                    score = max(score, 10 * read // a.mandatory() / 10)
                    if end >= 0:
                        labels.add(a.label)
        if base:
            score = 1.0
        return len(words), len(places), min(places, default=None), max(places, default=None), sorted(base), sorted(base | labels), score


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """License labels of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for lo, hi in slices(texts, 4 * SLICE_BYTES):
                rows = [scanner.scan(t.decode("utf-8", "replace")) for t in texts[lo:hi]]
                numbers = [pa.array([r[c] for r in rows], pa.int64()) for c in range(4)]
                strings = [pa.array([",".join(r[c]) for r in rows]) for c in (4, 5)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *numbers, *strings, pa.array([float(r[6]) for r in rows])], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def op8(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return scan(docs)


def _sql_pattern(template: str, most: int | None = None) -> str:
    """A template as a regular expression over words that each end in a blank, for the check in SQL.

    With `most`, of its begin that ends with so many mandatory words.
    """
    out, last, read, inside = "", 0, 0, False

    def wording(text: str) -> bool:
        nonlocal out, read
        for w in words_of(text):
            out += f"{w} "
            read += not inside
            if read == most and not inside:
                return True
        return False

    for m in _MARKUP.finditer(template):
        if wording(template[last : m.start()]):
            return " " + out
        last = m.end()
        if m[1] == "beginOptional":
            out, inside = out + "(?:", True
        elif m[1] == "endOptional":
            out, inside = out + ")?", False
        else:
            least, longest = re.search(r"match=\.\{(\d+),(\d+)\}", m[1]).groups()
            out += f"(?:[^ ]+ ){{{least},{longest}}}"
    wording(template[last:])
    return " " + out


def _sql_share(template: str) -> str:
    """Tenths of the template's mandatory words that a line reads through; the next tenth is tried only after the last."""
    words = compile_template("", template).mandatory()
    steps = {-(-t * words // 10): t for t in range(1, 11)}  # words needed to the largest tenth that they give
    cases, done = "", 0
    for n, t in steps.items():
        cases += f" WHEN NOT regexp_matches(line, '{_sql_pattern(template, n)}') THEN {done}"
        done = t
    return f"CASE{cases} ELSE 10 END"


def _oracle() -> str:
    phrases = list(PHRASES.items())
    spots = ", ".join(f"CASE WHEN array_to_string(words[i + 1:i + {len(p.split())}], ' ') = '{p}' THEN i END AS p{n}" for n, (p, _) in enumerate(phrases))
    base = " || ".join(f"CASE WHEN count(p{n}) > 0 THEN ['{label}'] ELSE [] END" for n, (_, label) in enumerate(phrases))
    found = " || ".join(f"CASE WHEN {' OR '.join(f"regexp_matches(line, '{_sql_pattern(t)}')" for t in many)} THEN ['{label}'] ELSE [] END" for label, many in TEMPLATES.items())
    count = " + ".join(f"count(p{n})" for n in range(len(phrases)))
    least = ", ".join(f"min(p{n})" for n in range(len(phrases)))
    most = ", ".join(f"max(p{n})" for n in range(len(phrases)))
    share = ", ".join(_sql_share(t) for many in TEMPLATES.values() for t in many)
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
x AS (SELECT doc_id, words, unnest(range(0, greatest(len(words), 1))) AS i FROM w),
s AS (SELECT doc_id, i, {spots} FROM x),
b AS (SELECT doc_id, {count} AS n_base, least({least}) AS first_word, greatest({most}) AS last_word, {base} AS base FROM s GROUP BY doc_id),
m AS (SELECT doc_id, len(words) AS n_words, {found} AS own, greatest({share}) AS tenths FROM (SELECT *, ' ' || array_to_string(words, ' ') || ' ' AS line FROM w))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_base AS BIGINT) AS n_base, first_word, last_word,
       array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(base || own)), ',') AS labels,
       CASE WHEN n_base > 0 THEN CAST(1 AS DOUBLE) ELSE tenths / CAST(10 AS DOUBLE) END AS score
FROM b JOIN m USING (doc_id)
"""


#: For small tables.
ORACLE = _oracle()
