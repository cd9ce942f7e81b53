"""License scans by template-markup matching.

A template is the wording of a license or notice with two kinds of marked regions, in the style of public
license-list templates:

* ``<<beginOptional>> ... <<endOptional>>`` may be left out;
* ``<<var;name="holder";match=".{0,12}">>`` stands for 0 to 12 arbitrary words.

Everything else is mandatory.  Each template is compiled to an automaton over words.  A text is accepted where,
from some word on, the mandatory words follow exactly, with marked regions skipped or replaced as the template
allows.  Case, punctuation and white space play no role, as a text is reduced to its words first.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from wayfare.llm.common import map_texts

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MARK = re.compile(r'<<(beginOptional|endOptional|var;[^>]*?match="\.\{(\d+),(\d+)\}"[^>]*)>>')


@dataclass(frozen=True)
class Template:
    label: str
    markup: str
    #: A base template's places are counted and located; others only add their label.
    base: bool = False


#: The phrases whose places are counted, and their labels.
BASE_TEMPLATES = (
    Template("gpl", "GNU General Public License", True),
    Template("apache", "Apache License", True),
    Template("cc-by", "CC BY", True),
    Template("mit", "MIT License", True),
)

#: Wordings of public license notices.
NOTICE_TEMPLATES = (
    Template("all-rights-reserved", "All rights reserved"),
    Template("apache-2.0", 'Licensed under the Apache License<<beginOptional>>, Version<<endOptional>> 2.0<<beginOptional>> (the "License")<<endOptional>>'),
    Template("cc-by-nc", 'Licensed under <<beginOptional>>the <<endOptional>><<beginOptional>>a <<endOptional>>CC BY-NC<<var;name="suffix";match=".{0,1}">> 4.0'),
    Template("cc-by-4.0", 'Licensed under <<beginOptional>>the <<endOptional>><<beginOptional>>a <<endOptional>>Creative Commons Attribution 4.0 International<<beginOptional>> Public<<endOptional>> License'),
    Template("gpl-3.0", 'Licensed under the<<beginOptional>> terms of the<<endOptional>> GNU General Public License<<beginOptional>> as published by the Free Software Foundation<<endOptional>><<var;name="either";match=".{0,1}">> version 3'),
    Template(
        "gpl-3.0",
        "free software<<beginOptional>> you can<<endOptional>> redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"
        '<<beginOptional>>, either<<endOptional>> version 3 of the License<<beginOptional>>, or (at your option) any later version<<endOptional>>',
    ),
    Template("mit-notice", '<<beginOptional>>Released<<endOptional>><<beginOptional>>Licensed<<endOptional>> under the<<beginOptional>> terms of the<<endOptional>> MIT License'),
    Template(
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;name=\"software\";match=\".{1,8}\">> and associated documentation files"
        '<<beginOptional>> (the "Software")<<endOptional>>, to deal in the Software without restriction',
    ),
    Template(
        "isc-text",
        "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted",
    ),
    Template(
        "bsd-text",
        "Redistribution and use in source and binary forms, with or without modification, are permitted<<var;name=\"scope\";match=\".{0,8}\">> provided that the following conditions are met",
    ),
    Template("mpl-2.0", 'subject to the terms of the Mozilla Public License<<var;name="version";match=".{0,1}">> 2.0'),
)

#: Whole bodies of public licenses, with the regions that their users replace or leave out.
BODY_TEMPLATES = (
    Template(
        "mit-body",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files<<beginOptional>> (the "Software")<<endOptional>>, to deal '
        "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice"
        "<<beginOptional>> (including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND '
        'NONINFRINGEMENT. IN NO EVENT SHALL <<var;name="holder";match=".{1,12}">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING '
        "FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    Template(
        "isc-body",
        "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
        'notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name="owner";match=".{1,8}">> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        'INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;name="holder";match=".{1,8}">> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL '
        "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION "
        "WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    Template(
        "bsd-body",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "<<beginOptional>>1. <<endOptional>>Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "<<beginOptional>>2. <<endOptional>>Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. "
        '<<beginOptional>><<beginOptional>>3. <<endOptional>>Neither the name of <<var;name="owner";match=".{1,12}">> nor the names of its contributors may be used to endorse or promote products '
        "derived from this software without specific prior written permission.<<endOptional>> "
        'THIS SOFTWARE IS PROVIDED BY <<var;name="provider";match=".{1,12}">> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY '
        'AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;name="holder";match=".{1,12}">> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR '
        "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
        "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
        "POSSIBILITY OF SUCH DAMAGE.",
    ),
    Template(
        "zlib-body",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the <<var;name=\"holder\";match=\".{1,3}\">> be held liable for any damages arising from the use "
        "of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions: <<beginOptional>>1. <<endOptional>>The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this "
        "software in a product, an acknowledgment in the product documentation would be appreciated but is not required. <<beginOptional>>2. <<endOptional>>Altered source versions must be plainly "
        "marked as such, and must not be misrepresented as being the original software. <<beginOptional>>3. <<endOptional>>This notice may not be removed or altered from any source distribution.",
    ),
)

TEMPLATES = BASE_TEMPLATES + NOTICE_TEMPLATES + BODY_TEMPLATES


def words_of(text: bytes) -> list[bytes]:
    """The words of a text, A-Z in lower case."""
    return WORD.findall(text.lower())


def parse(markup: str) -> list[tuple]:
    """A template's parts: ("word", w), ("optional", parts) and ("any", least, most)."""
    stack: list[list[tuple]] = [[]]
    at = 0

    def literal(piece: str) -> None:
        stack[-1].extend(("word", w) for w in words_of(piece.encode()))

    for mark in MARK.finditer(markup):
        literal(markup[at : mark.start()])
        at = mark.end()
        if mark[1] == "beginOptional":
            stack.append([])
        elif mark[1] == "endOptional":
            inner = stack.pop()
            if not stack:
                raise ValueError("endOptional without beginOptional")
            stack[-1].append(("optional", inner))
        else:
            stack[-1].append(("any", int(mark[2]), int(mark[3])))
    literal(markup[at:])
    if len(stack) != 1:
        raise ValueError("beginOptional without endOptional")
    return stack[0]


def mandatory(parts: list[tuple]) -> int:
    return sum(p[0] == "word" for p in parts)


class Automaton:
    """States with word edges, edges for any word, and empty edges; one final state."""

    def __init__(self, template: Template):
        self.label, self.base = template.label, template.base
        self.by_word: list[dict[bytes, int]] = [{}]
        self.by_any: list[int | None] = [None]
        self.empty: list[list[int]] = [[]]
        parts = parse(template.markup)
        self.mandatory = mandatory(parts)
        if not self.mandatory:
            raise ValueError(f"template {template.label} has no mandatory word")
        self.final = self._add(parts, 0)
        self.reach = [self._closure(s) for s in range(len(self.empty))]
        self.starts = {w for s in self.reach[0] for w in self.by_word[s]}
        if any(self.by_any[s] is not None for s in self.reach[0]):
            raise ValueError(f"template {template.label} begins with a replaceable region")

    def _state(self) -> int:
        self.by_word.append({})
        self.by_any.append(None)
        self.empty.append([])
        return len(self.empty) - 1

    def _add(self, parts: list[tuple], at: int) -> int:
        for part in parts:
            if part[0] == "word":
                nxt = self._state()
                self.by_word[at][part[1]] = nxt
                at = nxt
            elif part[0] == "any":
                end = self._state()
                for k in range(part[2]):
                    if k >= part[1]:
                        self.empty[at].append(end)
                    nxt = self._state()
                    self.by_any[at] = nxt
                    at = nxt
                self.empty[at].append(end)
                at = end
            else:
                begin, end = self._state(), self._state()
                self.empty[at] += [begin, end]
                self.empty[self._add(part[1], begin)].append(end)
                at = end
        return at

    def _closure(self, state: int) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            for nxt in self.empty[todo.pop()]:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return frozenset(seen)

    def accepts_at(self, words: list[bytes], start: int) -> bool:
        """Whether the template matches some run of words that begins at start."""
        states = self.reach[0]
        for k in range(start, len(words)):
            word, found = words[k], set()
            for s in states:
                if (nxt := self.by_word[s].get(word)) is not None:
                    found |= self.reach[nxt]
                if (nxt := self.by_any[s]) is not None:
                    found |= self.reach[nxt]
            if self.final in found:
                return True
            if not found:
                return False
            states = found
        return False


def scanner(templates: Iterable[Template]) -> Callable[[bytes | None], tuple]:
    automata = [Automaton(t) for t in templates]
    by_start: dict[bytes, list[Automaton]] = {}
    for a in automata:
        for w in a.starts:
            by_start.setdefault(w, []).append(a)

    def scan(text: bytes | None) -> tuple:
        words = words_of(text or b"")
        base: list[int] = []
        base_labels: set[str] = set()
        labels: set[str] = set()
        most = 0
        for at in [k for k, w in enumerate(words) if w in by_start]:
            for a in by_start[words[at]]:
                if not a.base and a.label in labels and a.mandatory <= most:
                    continue
                if a.accepts_at(words, at):
                    labels.add(a.label)
                    most = max(most, a.mandatory)
                    if a.base:
                        base.append(at)
                        base_labels.add(a.label)
        return (
            len(words), len(base), min(base, default=None), max(base, default=None),
            ",".join(sorted(base_labels)), ",".join(sorted(labels)), most / (most + 1),
        )

    return scan


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row for each row of docs: its id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of base templates, first_word and last_word are the smallest and largest of them
    (words from 0; null without any).  labels has those of all accepted templates.  score is m/(m+1) for the
    longest accepted template of m mandatory words, 0 where none is accepted.  Null and empty texts have no words
    and no labels; texts of any length are read whole; repeated rows and null ids stay as they are; an empty table gives
    no rows; other columns of docs are not read.
    """
    return map_texts(
        docs, [id_col], text_col, lambda: scanner(templates),
        "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double",
    )


def template_regex(template: Template) -> str:
    """The template as a regular expression over words that each follow one space (for checks in SQL)."""

    def of(parts: list[tuple]) -> str:
        out = ""
        for part in parts:
            if part[0] == "word":
                out += " " + part[1].decode()
            elif part[0] == "any":
                out += f"(?: [^ ]+){{{part[1]},{part[2]}}}"
            else:
                out += f"(?:{of(part[1])})?"
        return out

    return of(parse(template.markup)) + " "


def license_sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """DuckDB SQL for scan_licenses over documents."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    base = [t for t in templates if t.base]

    def places(t: Template) -> str:
        words = [w.decode() for _, w in parse(t.markup)]
        test = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))
        return f"list_filter(range(1, len(w) - {len(words) - 2}), lambda i: {test})"

    hit = lambda t: f"regexp_matches(j, '{template_regex(t)}')"
    labels = ", ".join(f"CASE WHEN {hit(t)} THEN '{t.label}' END" for t in templates)
    most = ", ".join(f"CASE WHEN {hit(t)} THEN {mandatory(parse(t.markup))} ELSE 0 END" for t in templates)
    base_labels = ", ".join(f"CASE WHEN {hit(t)} THEN '{t.label}' END" for t in base)
    joined = lambda x: f"array_to_string(list_sort(list_distinct(list_filter([{x}], lambda z: z IS NOT NULL))), ',')"
    return rf"""
WITH a AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS j, flatten([{", ".join(places(t) for t in base)}]) AS p FROM a),
c AS (SELECT *, greatest({most}) AS most FROM b)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base,
  CAST(list_min(p) - 1 AS BIGINT) AS first_word, CAST(list_max(p) - 1 AS BIGINT) AS last_word,
  {joined(base_labels)} AS base_labels, {joined(labels)} AS labels,
  CAST(most AS DOUBLE) / (most + 1) AS score
FROM c"""
