"""License scans by template markup.

A template is a license text or notice with markup for its optional parts
(``<<beginOptional>> ... <<endOptional>>``, which may nest) and its replaceable
ones (``<<var;name=...;match=a|b>>``: one of these words, ``<<var;name=...;max=9>>``:
up to that many words of any kind). It is compiled into an automaton over word
tokens. A text is accepted where the automaton runs from its start to an end,
that is where all mandatory wording stands exactly, optional wording stands
whole or not at all, and replaceable places hold what they may hold.

Words are runs of digits, a-z and non-ASCII characters after lower-casing A-Z;
case and punctuation are thereby ignored. Beside the templates a list of phrases
is counted (the base): every place where a phrase's words stand consecutively.

The score is 1 if a template is accepted, else 0.5 for one phrase and 0.1 more
for each further one up to 0.9, else 0.

Edge cases: null and empty texts have no words, no labels (an empty string) and
score 0; repeated rows are scanned each by itself, overlapping places all count;
where two templates fit overlapping words both give their labels;
an empty table gives no rows; other columns are ignored, whatever their names;
texts are scanned whole in memory proportional to the text.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame

from tilesieve.llm.common import keyed_text, map_rows

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Fixed wording of public licenses and their usual notices.
TEMPLATES = {
    "apache-2.0-notice": """
        Licensed under the Apache License, Version 2.0
        <<beginOptional>>(the "License")<<endOptional>>
        <<beginOptional>>; you may not use this file except in compliance with the License.
        You may obtain a copy of the License at
        <<beginOptional>>http://www.apache.org/licenses/LICENSE-2.0<<endOptional>><<endOptional>>""",
    "mit-notice": """
        <<var;name=verb;match=released|licensed|distributed|available|published>> under the
        <<beginOptional>>terms of the<<endOptional>> MIT License""",
    "gpl-notice": """
        <<beginOptional>>you can<<endOptional>>
        <<var;name=verb;match=released|licensed|distributed|available|published|redistribute>>
        <<beginOptional>>it and/or modify it<<endOptional>> under the
        <<beginOptional>>terms of the<<endOptional>> GNU <<beginOptional>><<var;name=kind;match=lesser|affero>><<endOptional>>
        General Public License
        <<beginOptional>>as published by the Free Software Foundation<<endOptional>>
        <<beginOptional>>, <<beginOptional>>either<<endOptional>> version <<var;name=version;match=1|2|3>>
        <<beginOptional>>of the License, or (at your option) any later version<<endOptional>><<endOptional>>""",
    "cc-by-notice": """
        <<var;name=verb;match=licensed|released|available|published>> under CC BY<<beginOptional>>-NC<<endOptional>><<beginOptional>>-SA<<endOptional>>
        <<var;name=version;match=1|2|3|4>>.<<var;name=minor;match=0|5>>""",
    "mit-text": """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions:
        The above copyright notice and this permission notice
        <<beginOptional>>(including the next paragraph)<<endOptional>>
        shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
        IN NO EVENT SHALL <<var;name=holder;max=12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
        WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc-text": """
        Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any
        purpose with or without fee is hereby granted, provided that the above copyright notice and this
        permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name=holder;max=12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
        SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL
        <<var;name=owner;max=12>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
        WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
        TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-text": """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met:
        <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer.
        <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials
        provided with the distribution.
        <<beginOptional>><<beginOptional>>3.<<endOptional>> Neither the name of <<var;name=organisation;max=12>> nor the
        names of its contributors may be used to endorse or promote products derived from this software without
        specific prior written permission.<<endOptional>>
        THIS SOFTWARE IS PROVIDED BY <<var;name=holders;max=12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
        ARE DISCLAIMED. IN NO EVENT SHALL <<var;name=holder;max=12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
        OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
        LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY
        WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "zlib-text": """
        This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
        held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and
        to alter it and redistribute it freely, subject to the following restrictions:
        <<beginOptional>>1.<<endOptional>> The origin of this software must not be misrepresented; you must not claim that
        you wrote the original software. If you use this software in a product, an acknowledgment in the product
        documentation would be appreciated but is not required.
        <<beginOptional>>2.<<endOptional>> Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software.
        <<beginOptional>>3.<<endOptional>> This notice may not be removed or altered from any source distribution.""",
    "unlicense-text": """
        This is free and unencumbered software released into the public domain.
        Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source
        code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
}

_table = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_table).split()


class Automaton:
    """Word automaton of one template, made deterministic as texts need it."""

    def __init__(self, template: str):
        self.edges: list[list[tuple[frozenset[bytes] | None, int]]] = [[]]
        self.skips: list[set[int]] = [set()]
        runs: list[list[bytes]] = [[]]
        open_at: list[int] = []
        for part in re.split(r"(<<[^>]*>>)", template):
            at = len(self.edges) - 1
            if part == "<<beginOptional>>":
                open_at.append(at)
                runs.append([])
            elif part == "<<endOptional>>":
                self.skips[open_at.pop()].add(at)
                runs.append([])
            elif part.startswith("<<var;"):
                given = dict(x.split("=", 1) for x in part[2:-2].split(";")[1:])
                if "match" in given:
                    self._step(frozenset(w.encode() for w in given["match"].split("|")))
                else:
                    for _ in range(int(given["max"])):
                        self._step(None)
                    for state in range(at, len(self.edges) - 1):
                        self.skips[state].add(len(self.edges) - 1)
                runs.append([])
            else:
                for w in words_of(part):
                    self._step(frozenset((w,)))
                    if not open_at:
                        runs[-1].append(w)
        if open_at:
            raise ValueError("an optional part is not closed")
        self.final = len(self.edges) - 1
        #: The longest mandatory run of words: a text without it needs no run of the automaton.
        self.needs = b" " + b" ".join(max(runs, key=len)) + b" "
        self.start = self._closed({0})
        if self.final in self.start:
            raise ValueError("a template needs mandatory wording")
        self.firsts = {w for s in self.start for ws, _ in self.edges[s] for w in ws or ()}
        self.any_first = any(ws is None for s in self.start for ws, _ in self.edges[s])
        self.moves: dict[tuple[frozenset[int], bytes], frozenset[int]] = {}

    def _step(self, words: frozenset[bytes] | None) -> None:
        self.edges[-1].append((words, len(self.edges)))
        self.edges.append([])
        self.skips.append(set())

    def _closed(self, states: set[int]) -> frozenset[int]:
        todo, out = list(states), set(states)
        while todo:
            new = self.skips[todo.pop()] - out
            out |= new
            todo += new
        return frozenset(out)

    def _move(self, states: frozenset[int], word: bytes) -> frozenset[int]:
        key = states, word
        if key not in self.moves:
            if len(self.moves) > 20_000:
                self.moves.clear()
            self.moves[key] = self._closed({to for s in states for ws, to in self.edges[s] if ws is None or word in ws})
        return self.moves[key]

    def longest(self, words: list[bytes], at: int) -> int:
        """The end of the longest accepted run of words from ``at``, or -1."""
        states, end = self.start, -1
        while at < len(words) and (states := self._move(states, words[at])):
            at += 1
            if self.final in states:
                end = at
        return end

    def find(self, words: list[bytes], joined: bytes) -> list[tuple[int, int]]:
        """Accepted (start, end), leftmost and longest, without overlaps."""
        if self.needs not in joined:
            return []
        out, free = [], 0
        for at, w in enumerate(words):
            if at >= free and (self.any_first or w in self.firsts) and (end := self.longest(words, at)) > 0:
                out.append((at, end))
                free = end
        return out


@lru_cache
def automata() -> dict[str, Automaton]:
    return {label: Automaton(t) for label, t in TEMPLATES.items()}


def phrase_places(joined: bytes) -> list[tuple[int, str]]:
    """(word index, label) of every place of every phrase."""
    out = []
    for phrase, label in PHRASES.items():
        key = b" " + phrase.encode() + b" "
        at, before, blanks = joined.find(key), 0, 0
        while at >= 0:
            blanks += joined.count(b" ", before, at)  # from the place before only
            out.append((blanks, label))
            before, at = at, joined.find(key, at + 1)
    return out


def scan_text(text: str) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    words = words_of(text)
    joined = b" " + b" ".join(words) + b" "
    places = phrase_places(joined)
    spans = [{"label": label, "start": a, "end": b} for label, auto in automata().items() for a, b in auto.find(words, joined)]
    base = {label for _, label in places}
    score = 1.0 if spans else min(9, 4 + len(places)) / 10 if places else 0.0
    starts = [at for at, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {s["label"] for s in spans})), score, spans


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``; ``spans`` are the accepted templates' places, in words."""

    def start():
        automata()

        def step(ids, texts):
            return [ids, *map(list, zip(*map(scan_text, texts)))]

        return step

    schema = "id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label:string,start:bigint,end:bigint>>"
    return map_rows(keyed_text(docs, id_col, text_col), schema, start).withColumnRenamed("id", id_col)
