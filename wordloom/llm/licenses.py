"""License scan: base phrases and template automata over a text's words.

A template is license wording with markup: ``<<beginOptional>>`` ..
``<<endOptional>>`` bounds words that may be absent, ``<<var;max=N>>`` stands
for up to N replaceable words, ``<<one;a|b>>`` for one of several words.  It is
compiled into an automaton over lower-cased words; a text is accepted where
the mandatory wording stands word by word.  Before the automaton runs, the
longest mandatory run of words is looked for as a plain byte string, which
every accepted text contains.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import alnum_words, map_text

#: The base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Wording of public licenses and of the notices that name them, in template markup.
TEMPLATES = {
    "MIT-notice": "<<one;released|licensed|distributed|available>> under the <<beginOptional>>terms of the<<endOptional>> MIT license",
    "Apache-2.0": "licensed under the Apache License <<beginOptional>>,<<endOptional>> version 2.0"
                  " <<beginOptional>>(the \"License\"); you may not use this file except in compliance with the License<<endOptional>>",
    "GPL-2.0": "licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License version 2"
               " <<beginOptional>>or <<beginOptional>>at your option<<endOptional>> any later version<<endOptional>>",
    "GPL-3.0": "licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License version 3"
               " <<beginOptional>>or <<beginOptional>>at your option<<endOptional>> any later version<<endOptional>>",
    "CC-BY-4.0": "licensed under <<beginOptional>>a <<beginOptional>>creative commons<<endOptional>><<endOptional>> CC BY 4.0",
    "CC-BY-SA-4.0": "licensed under <<beginOptional>>a <<beginOptional>>creative commons<<endOptional>><<endOptional>> CC BY-SA 4.0",
    "CC-BY-NC-4.0": "licensed under <<beginOptional>>a <<beginOptional>>creative commons<<endOptional>><<endOptional>> CC BY-NC 4.0",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>>
        shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
        THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
        <<var;max=12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, <<one;and>> <<beginOptional>>/or<<endOptional>> distribute this software for any purpose
        with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear
        in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;max=8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
        SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;max=8>> BE LIABLE
        FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
        DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
        CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain
        the above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>>
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY <<var;max=12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
        TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
        <<var;max=12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
        (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
        BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
        (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
        POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain
        the above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>>
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution.
        <<beginOptional>>3.<<endOptional>> Neither the name of <<var;max=12>> nor the names of its contributors may be used to
        endorse or promote products derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY <<var;max=12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
        TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
        <<var;max=12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
        (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
        BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
        (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
        POSSIBILITY OF SUCH DAMAGE.""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at <<one;http|https>>://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
        language governing permissions and limitations under the License.""",
    "GPL-2.0-header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any
        later version.""",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version.""",
    "LGPL-2.1": "licensed under the <<beginOptional>>terms of the<<endOptional>> GNU Lesser General Public License version 2.1"
                " <<beginOptional>>or <<beginOptional>>at your option<<endOptional>> any later version<<endOptional>>",
    "LGPL-3.0": "licensed under the <<beginOptional>>terms of the<<endOptional>> GNU Lesser General Public License version 3"
                " <<beginOptional>>or <<beginOptional>>at your option<<endOptional>> any later version<<endOptional>>",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at <<one;http|https>>://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means.""",
}

_MARK = re.compile(r"<<(.*?)>>", re.S)


class Automaton:
    """States are numbered; ``words[s]`` is a set of words (None: any word) leading to s + 1, ``free[s]`` where s may jump."""

    def __init__(self, label: str, template: str):
        self.label, self.words, self.free = label, [], {}
        opened, run, runs = [], [], [[]]
        for i, part in enumerate(_MARK.split(template)):
            if i % 2 == 0:
                for w in alnum_words(part.encode()):
                    self.words.append({w})
                    if not opened:
                        run.append(w)
                continue
            runs.append(run)
            run = []
            if part == "beginOptional":
                opened.append(len(self.words))
            elif part == "endOptional":
                self._jump(opened.pop(), len(self.words))
            elif part.startswith("one;"):
                self.words.append({w.encode() for w in part[4:].lower().split("|")})
            elif part.startswith("var;max="):
                start, most = len(self.words), int(part[8:])
                self.words += [None] * most
                for s in range(start, start + most):
                    self._jump(s, start + most)
            else:
                raise ValueError(f"unknown markup <<{part}>>")
        if opened:
            raise ValueError("an optional region is not closed")
        self.end = len(self.words)
        self.anchor = b" " + b" ".join(max([*runs, run], key=lambda r: sum(map(len, r)))) + b" "
        first = self._closed({0})
        self.starts = None if any(s < self.end and self.words[s] is None for s in first) else \
            set().union(*(self.words[s] for s in first if s < self.end))

    def _jump(self, a: int, b: int) -> None:
        self.free.setdefault(a, []).append(b)

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.free.get(todo.pop(), ()):
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def longest(self, words: list[bytes], at: int) -> int:
        """Words of the longest accepted stretch that starts at ``at``, or 0."""
        states, best, i = self._closed({0}), 0, at
        while states and i < len(words):
            w = words[i]
            states = self._closed({s + 1 for s in states if s < self.end and (self.words[s] is None or w in self.words[s])})
            i += 1
            if self.end in states:
                best = i - at
        return best

    def spans(self, words: list[bytes], joined: bytes) -> list[tuple[int, int]]:
        """Maximal accepted stretches (start, end) in words, none inside another."""
        if self.anchor not in joined:
            return []
        out, i = [], 0
        while i < len(words):
            n = self.longest(words, i) if self.starts is None or words[i] in self.starts else 0
            if n:
                out.append((i, i + n))
            i += n or 1
        return out


@lru_cache(maxsize=1)
def automata() -> tuple[Automaton, ...]:
    return tuple(Automaton(k, v) for k, v in TEMPLATES.items())


def base_places(joined: bytes) -> list[tuple[int, int, str]]:
    """(first word, words, label) of every place of a base phrase; ``joined``: words between single blanks."""
    out = []
    for phrase, label in BASE:
        p = b" " + phrase.encode() + b" "
        at, before, words = joined.find(p), 0, 0
        while at >= 0:
            words += joined.count(b" ", before, at)  # from the last place on, so that long texts stay linear
            out.append((words, phrase.count(" ") + 1, label))
            at, before = joined.find(p, at + 1), at
    return out


def scan_text(text: bytes | None) -> tuple:
    words = alnum_words(text)
    joined = b" " + b" ".join(words) + b" "
    base = base_places(joined)
    found = [(a, b, m.label) for m in automata() for a, b in m.spans(words, joined)]
    covered = set()
    for a, n, _ in base:
        covered.update(range(a, a + n))
    for a, b, _ in found:
        covered.update(range(a, b))
    labels = {x for *_, x in base}
    return (len(words), len(base), min((a for a, *_ in base), default=None), max((a for a, *_ in base), default=None),
            ",".join(sorted(labels)), ",".join(sorted(labels | {x for *_, x in found})),
            len(covered) / len(words) if words else 0.0, [f"{x}:{a}-{b}" for a, b, x in found])


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License labels of every text; one row per input row, null and empty texts without words.

    ``n_words``; ``n_base``, ``first_word``, ``last_word`` and ``base_labels``
    of the base phrases; ``labels`` with those of the templates; ``score``: the
    share of words in license wording; ``spans``: ``label:start-end`` in words
    for each accepted template.  Rows are independent of each other.
    """
    return map_text(docs, scan_text, {
        "n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string",
        "labels": "string", "score": "double", "spans": "array<string>"}, id_col=id_col, text_col=text_col)
