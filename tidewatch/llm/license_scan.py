r"""Operator 8, license scans: template markup compiled into token automata.

A template is license wording with markup: ``<<beginOptional>>...<<endOptional>>`` may be left
out, ``<<var;most=N>>`` stands for up to N words of any kind, ``<<match=a|b c>>`` for one of the wordings. :func:`compile_template` turns it into
a nondeterministic token automaton: word edges, branches for alternatives, free edges for optional regions, and chains of
bounded length for replaceable ones. Numbers of lists and marks like (c) are covered by short replaceable regions. A place matches if the automaton gets from its start to its end,
so all mandatory wording must stand there exactly, word for word. A ``text:`` template holds the whole license, conditions and disclaimer
included, so wording that is added or lost inside it (a field of use, a missing disclaimer) gives no match; ``notice:`` and ``-notice`` templates hold what
files say of a license that stands elsewhere. Spans do not overlap within a label:
from each start the longest match counts.

The base scan looks for short phrases as consecutive words; its labels stay, templates add theirs.
Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the text with A-Z in lower case.

Defined results: null and empty texts have no words, no labels and score 0; repeated rows are
scanned each; very long texts are scanned whole, and the automaton starts only at places of its first words. Extra columns
are carried if asked for; one named as a column of the result comes out with ``_in`` behind it.
"""

from __future__ import annotations

import pkgutil
import re
import string
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewatch.llm.common import carried, text_or_empty
from tidewatch.llm.tokens import blocks, column_texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)

# The phrases of the base scan and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

def _whole(name: str, notice: str) -> str:
    """The whole text of a license from this package; what stands behind its terms (``notice`` on) may be missing."""
    text = pkgutil.get_data("tidewatch.llm", f"licenses/{name}.txt").decode()
    terms, mark, rest = text.partition(notice)
    return f"{terms}<<beginOptional>>{mark}{rest}<<endOptional>>".replace("https://", "<<match=http|https>>://").replace("http://", "<<match=http|https>>://")


# Disclaimers that several licenses share.
_MIT_DENIED = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND <<match=NONINFRINGEMENT|NON INFRINGEMENT>>. '
    "IN NO EVENT SHALL <<beginOptional>>THE <<endOptional>><<var;most=12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_DENIED = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND <<var;most=12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL <<var;most=12>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_GIVEN = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<var;most=1>>Redistributions of source code must retain the above copyright notice, "
    "this list of conditions and the following disclaimer. <<var;most=1>>Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_DENIED = (
    'THIS SOFTWARE IS PROVIDED BY <<var;most=12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL <<beginOptional>>THE <<endOptional>><<var;most=12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = (
    "is free software<<var;most=2>> you can redistribute it and/or modify it under the terms of the GNU {0} General Public License as published by the Free Software Foundation, "
    "<<match=either version {1} of the License, or (at your option) any later version|version {1} of the License|version {1}>>"
)

# Wordings and notices of public licenses, with markup for what may be missing, replaced or said otherwise.
TEMPLATES = {
    "notice:mit": "<<match=released|licensed|distributed|available>> under the <<beginOptional>>terms of the <<endOptional>><<match=MIT License|MIT licence|Expat License>>",
    "notice:apache-2.0": "<<match=licensed|released|distributed|available>> under the <<beginOptional>>terms of the <<endOptional>>Apache License<<beginOptional>>, Version<<endOptional>> 2.0",
    "notice:gpl": "<<match=licensed|released|distributed|available>> under <<beginOptional>>the <<endOptional>><<beginOptional>>terms of the <<endOptional>>GNU <<beginOptional>><<match=Lesser|Affero|Library>> <<endOptional>>General Public License<<beginOptional>>, <<match=version|v>> <<var;most=2>><<endOptional>>",
    "notice:cc-by": "<<match=licensed|released|available|distributed>> under <<beginOptional>><<match=a|the>> <<endOptional>><<beginOptional>>Creative Commons <<endOptional>><<match=CC BY|Attribution>><<beginOptional>> NC<<endOptional>><<beginOptional>> NonCommercial<<endOptional>><<beginOptional>> SA<<endOptional>><<beginOptional>> ShareAlike<<endOptional>><<beginOptional>> ND<<endOptional>><<beginOptional>> NoDerivatives<<endOptional>><<beginOptional>> International<<endOptional>> <<match=4.0|3.0|2.5|2.0>>",
    "text:mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the <<beginOptional>><<var;most=1>> <<endOptional>>Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph) <<endOptional>>shall be included in all copies or substantial portions of the Software. " + _MIT_DENIED,
    "text:mit-0": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. " + _MIT_DENIED,
    "text:isc": "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_DENIED,
    "text:0bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_DENIED,
    "text:bsd-2-clause": _BSD_GIVEN + _BSD_DENIED,
    "text:bsd-3-clause": _BSD_GIVEN + "<<var;most=1>>Neither the name of <<var;most=12>> nor the names of <<match=its|the>> contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_DENIED,
    "text:apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at <<match=http|https>>://www.apache.org/licenses/LICENSE-2.0",
    "text:gpl-2.0-notice": _GNU.format("", "2"),
    "text:gpl-3.0-notice": _GNU.format("", "3"),
    "text:lgpl-2.1-notice": _GNU.format("Lesser", "2.1"),
    "text:lgpl-3.0-notice": _GNU.format("Lesser", "3"),
    "text:agpl-3.0-notice": _GNU.format("Affero", "3"),
    "text:mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at <<match=http|https>>://mozilla.org/MPL/2.0",
    "text:unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.<<beginOptional>> For more information, please refer to <<match=http|https>>://unlicense.org<<endOptional>>",
    "text:cc0-1.0-notice": "To the extent possible under law, <<var;most=12>> <<match=has|have>> waived all copyright and related or neighboring rights to <<var;most=12>>",
    "text:bsl-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "text:zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: <<var;most=1>>The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. <<var;most=1>>Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. <<var;most=1>>This notice may not be removed or altered from any source distribution.",
    "text:wtfpl": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION <<var;most=1>>You just DO WHAT THE FUCK YOU WANT TO.",
    "text:apache-2.0": _whole("apache-2.0", "END OF TERMS AND CONDITIONS"),
    "text:gpl-3.0": _whole("gpl-3.0", "END OF TERMS AND CONDITIONS"),
}

MARKUP = re.compile(r"<<(beginOptional|endOptional|var;most=(\d+)|match=([^>]*))>>")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.translate(LOWER))


@dataclass
class Automaton:
    """States are numbers; ``step[s]`` maps a word to the next state, ``skip[s]`` are free edges, and
    ``any_step[s]`` is the next state for any word."""

    label: str
    step: list[dict[str, int]]
    skip: list[set[int]]
    any_step: list[int | None]
    end: int
    first: set[str]
    n_words: int

    def closed(self, states: set[int]) -> set[int]:
        out, todo = set(states), list(states)
        while todo:
            for s in self.skip[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return out

    def match(self, words: list[str], at: int) -> int:
        """Where the longest match from ``at`` ends, or -1."""
        states, best = self.closed({0}), -1
        i = at
        while states:
            if self.end in states:
                best = i
            if i == len(words):
                break
            word = words[i]
            after = {self.step[s][word] for s in states if word in self.step[s]}
            after |= {self.any_step[s] for s in states if self.any_step[s] is not None}
            states = self.closed(after)
            i += 1
        return best


def compile_template(label: str, template: str) -> Automaton:
    """Parse markup and build the automaton; optional regions may nest."""
    step: list[dict[str, int]] = [{}]
    skip: list[set[int]] = [set()]
    any_step: list[int | None] = [None]

    def new() -> int:
        step.append({})
        skip.append(set())
        any_step.append(None)
        return len(step) - 1

    def edge(at: int, word: str) -> int:
        """A new state reached from ``at`` by a word; a state with several ways for one word gets a free edge first."""
        if word in step[at]:
            side = new()
            skip[at].add(side)
            at = side
        to = new()
        step[at][word] = to
        return to

    opened: list[int] = []
    at, n, pos = 0, 0, 0
    for found in [*MARKUP.finditer(template), None]:
        for word in words_of(template[pos : found.start() if found else len(template)]):
            at = edge(at, word)
            n += not opened
        if found is None:
            break
        pos = found.end()
        if found[1] == "beginOptional":
            opened.append(at)
        elif found[1] == "endOptional":
            skip[opened.pop()].add(at)
        elif found[3] is not None:
            start, at = at, new()
            for option in found[3].split("|"):
                here = start
                for word in words_of(option):
                    here = edge(here, word)
                skip[here].add(at)
        else:
            passed = [at]
            for _ in range(int(found[2])):
                to = new()
                any_step[at] = to
                at = to
                passed.append(at)
            to = new()
            for s in passed:
                skip[s].add(to)
            at = to
    if opened:
        raise ValueError(f"{label}: an optional region is not closed")
    made = Automaton(label, step, skip, any_step, at, set(), n)
    start = made.closed({0})
    if any(any_step[s] is not None for s in start) or at in start:
        raise ValueError(f"{label}: a template starts with wording of its own")
    made.first = {w for s in start for w in step[s]}
    return made


def scan(words: list[str], automata: list[Automaton]) -> list[tuple[str, int, int]]:
    """(label, start, end) of every match, in order of place for each automaton."""
    starts: dict[str, list[int]] = {}
    wanted = set().union(*(a.first for a in automata)) if automata else set()
    for i, w in enumerate(words):
        if w in wanted:
            starts.setdefault(w, []).append(i)
    out = []
    for a in automata:
        free = 0
        for at in sorted(i for w in a.first for i in starts.get(w, ())):
            if at >= free and (end := a.match(words, at)) > at:
                out.append((a.label, at, end))
                free = end
    return out


def base_places(words: list[str], phrases: dict[str, str]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase stands."""
    by_first: dict[str, list[tuple[list[str], str]]] = {}
    for phrase, label in phrases.items():
        parts = phrase.split()
        by_first.setdefault(parts[0], []).append((parts, label))
    out = []
    for first, options in by_first.items():
        at = -1
        while True:
            try:
                at = words.index(first, at + 1)
            except ValueError:
                break
            out += [(at, label) for parts, label in options if words[at : at + len(parts)] == parts]
    return sorted(out)


def license_scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, with_spans: bool = False) -> DataFrame:
    """Columns ``keep`` with word counts, base places, labels, score, and the matched spans if asked for.

    The score is the share of the text's words that lie in template matches or base phrases.
    """
    phrases = PHRASES if phrases is None else phrases
    automata = [compile_template(k, v) for k, v in (TEMPLATES if templates is None else templates).items()]
    lengths = {label: len(p.split()) for p, label in phrases.items()}
    source = docs.select(*carried(keep, ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]), text_or_empty(text).alias("__text"))
    keep = tuple(source.columns[:-1])
    span = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    extra = [
        T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()),
    ] + [T.StructField("spans", T.ArrayType(span))] * with_spans
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()] + [pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))] * with_spans

    def judged(text: str) -> tuple:
        words = words_of(text)
        places = base_places(words, phrases)
        spans = scan(words, automata)
        covered: set[int] = set()
        for at, label in places:
            covered.update(range(at, at + lengths[label]))
        for _, a, b in spans:
            covered.update(range(a, b))
        base = sorted({label for _, label in places})
        labels = sorted({*base, *(label for label, _, _ in spans)})
        row = (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(base), ",".join(labels), len(covered) / len(words) if words else 0.0)
        return (*row, [{"label": k, "start": a, "end": b} for k, a, b in spans]) if with_spans else row

    def scanned(batches):
        for batch in batches:
            rows = [judged(t) for block in blocks(column_texts(batch, "__text")) for t in block]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], names=[*keep, *[f.name for f in extra]])

    return source.mapInArrow(scanned, T.StructType([source.schema[k] for k in keep] + extra))
