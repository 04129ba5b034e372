"""License scans by template-markup matching.

A template is text with markup: ``[[`` ... ``]]`` encloses an optional region, ``{{name:low-high}}`` a replaceable region of that many
words. ``compile_template`` turns it into an automaton over word tokens (states, word edges, free edges); a text has a template's license
where a run of its words takes the automaton from start to end, so all mandatory wording must match exactly, word for word. Beside the
templates, base phrases are looked up at every place of the text.

Words are runs of ``[0-9a-z]`` and of code points from 0x80 on after lower-casing A-Z, so case, punctuation and line breaks never matter.

Defined cases: a null text counts as empty (no words, null places, empty labels, score 0); texts are scanned whole; overlapping places of
one phrase all count; a text may carry several labels; of matches from one place the longest counts; repeated rows get equal results; an
empty table gives no rows. Only the named text column is read, so other columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens.llm.blocks import as_texts
from flowlens.llm.common import small_batches

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MARKUP = re.compile(r"\[\[|\]\]|\{\{\w+:(\d+)-(\d+)\}\}")

PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

_MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without "
    "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following "
    "conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software the software is provided as is "
    "without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the "
    "{{holders:1-12}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_ISC = (
    "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
    "the software is provided as is and {{holder:1-12}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {{holder:1-12}} be liable "
    "for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of "
    "or in connection with the use or performance of this software"
)
_BSD_HEAD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright "
    "notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
    "documentation and or other materials provided with the distribution"
)
_BSD_NAMES = "[[3]] neither the name of {{holder:1-12}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_TAIL = (
    "this software is provided by {{holders:1-12}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall {{holders:1-12}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data "
    "or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software "
    "even if advised of the possibility of such damage"
)
#: The wording of public license texts and notices, with their optional and replaceable regions marked. The first are whole
#: texts, those named "notice" what points to a license or to a part of one.
TEMPLATES = (
    ("mit", _MIT),
    ("isc", _ISC),
    ("bsd-2-clause", f"{_BSD_HEAD} {_BSD_TAIL}"),
    ("bsd-3-clause", f"{_BSD_HEAD} {_BSD_NAMES} {_BSD_TAIL}"),
    ("mit-notice", "[[this {{work:1-3}} is]] [[released]] [[licensed]] under the [[terms of the]] mit license"),
    ("bsd-names-notice", _BSD_NAMES),
    ("apache-notice", "licensed under the apache license version 2 0 [[the license]]"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at [[http]] [[https]] www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-notice", "licensed under the [[terms of the]] gnu [[lesser]] [[affero]] general public license [[as published by the free software foundation]] [[either]] version {{number:1-1}} [[0]]"),
    ("gpl-or-later", "{{work:1-6}} is free software you can redistribute it and or modify it under the terms of the gnu [[lesser]] [[affero]] general public license as published by the free software foundation either version {{number:1-1}} of the license or at your option any later version"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at [[http]] [[https]] mozilla org mpl 2 0"),
    ("cc-by-notice", "licensed under [[a]] [[the]] creative commons attribution {{number:1-3}} [[international]] [[unported]] license"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
)


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower())


@dataclass
class Automaton:
    """Per state: edges by word, whether any word leads to the next state, and states reached without a word. The last state accepts."""

    label: str
    edges: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    any_word: list[int] = field(default_factory=lambda: [-1])
    free: list[list[int]] = field(default_factory=lambda: [[]])

    def _add(self) -> int:
        self.edges.append({})
        self.any_word.append(-1)
        self.free.append([])
        return len(self.edges) - 1

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for nxt in self.free[todo.pop()]:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return seen

    def first_words(self) -> tuple[set[bytes], bool]:
        """The words a match may begin with, and whether any word may."""
        start = self.closure({0})
        return {w for s in start for w in self.edges[s]}, any(self.any_word[s] >= 0 for s in start)

    def match(self, words: list[bytes], at: int) -> int:
        """The end of the longest match that starts at word ``at``, or -1."""
        states, end, accept = self.closure({0}), -1, len(self.edges) - 1
        while at < len(words):
            word = words[at]
            states = self.closure({t for s in states for t in (self.edges[s].get(word, -1), self.any_word[s]) if t >= 0})
            at += 1
            if not states:
                break
            if accept in states:
                end = at
        return end


def compile_template(label: str, template: str) -> Automaton:
    auto, now, opened, at = Automaton(label), 0, [], 0

    def literal(part: str) -> None:
        nonlocal now
        for word in words_of(part):
            nxt = auto._add()
            auto.edges[now][word] = nxt
            now = nxt

    for mark in _MARKUP.finditer(template):
        literal(template[at : mark.start()])
        at = mark.end()
        if mark.group() == "[[":
            enter = auto._add()  # a state of its own, so that regions next to each other do not share edges
            auto.free[now].append(enter)
            opened.append(now)
            now = enter
        elif mark.group() == "]]":
            leave = auto._add()
            auto.free[now].append(leave)
            auto.free[opened.pop()].append(leave)
            now = leave
        else:
            low, high = map(int, mark.groups())
            skips = []
            for k in range(high):
                if k >= low:
                    skips.append(now)
                nxt = auto._add()
                auto.any_word[now] = nxt
                now = nxt
            leave = auto._add()
            for s in (*skips, now):
                auto.free[s].append(leave)
            now = leave
    if opened:
        raise ValueError(f"template {label}: an optional region is not closed")
    literal(template[at:])
    return auto


@dataclass
class Scanner:
    """Automata and phrases with an index from first word to those that may begin there.

    An automaton that may begin with any word is entered at its first mandatory literal instead: ``anchors`` holds how far before it the
    match may start.
    """

    phrases: list[tuple[tuple[bytes, ...], str]]
    automata: list[Automaton]
    by_first: dict[bytes, list[int]]
    anchored: dict[bytes, list[tuple[int, int, int]]]

    def scan(self, text: str) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str]]]:
        """Number of words, (start, label) of base phrases, (start, end, label) of templates."""
        words = words_of(text)
        known = set(words)
        base, found = [], []
        for phrase, label in self.phrases:
            if known.issuperset(phrase):
                base += [(i, label) for i in _places(words, phrase[0]) if tuple(words[i : i + len(phrase)]) == phrase]
        for word in known & self.by_first.keys():
            for i in _places(words, word):
                for a in self.by_first[word]:
                    end = self.automata[a].match(words, i)
                    if end >= 0:
                        found.append((i, end, self.automata[a].label))
        for word in known & self.anchored.keys():
            for i in _places(words, word):
                for a, low, high in self.anchored[word]:
                    for start in range(max(0, i - high), i - low + 1):
                        end = self.automata[a].match(words, start)
                        if end >= 0:
                            found.append((start, end, self.automata[a].label))
                            break
        return len(words), sorted(base), sorted(set(found))


def _places(words: list[bytes], word: bytes) -> Iterator[int]:
    at = -1
    while True:
        try:
            at = words.index(word, at + 1)
        except ValueError:
            return
        yield at


def scanner(templates=TEMPLATES, phrases=PHRASES) -> Scanner:
    automata = [compile_template(label, text) for label, text in templates]
    by_first: dict[bytes, list[int]] = {}
    anchored: dict[bytes, list[tuple[int, int, int]]] = {}
    for k, auto in enumerate(automata):
        first, anything = auto.first_words()
        if anything:  # the replaceable region comes first: its bounds and the literal after it
            lead = _MARKUP.match(templates[k][1])
            if not lead or not lead.group(1):
                raise ValueError(f"template {auto.label}: a replaceable region may only come first if nothing optional precedes it")
            low, high = map(int, lead.groups())
            anchored.setdefault(words_of(templates[k][1][lead.end() :])[0], []).append((k, low, high))
        else:
            for word in first:
                by_first.setdefault(word, []).append(k)
    return Scanner([(tuple(words_of(p)), label) for p, label in phrases], automata, by_first, anchored)


def scan_column(session, text: str | Column = "text", templates=TEMPLATES, phrases=PHRASES) -> Column:
    """struct<n_words, base array<struct<start, label>>, found array<struct<start, end, label>>> for a text column, in words from 0."""
    shared = small_batches(session).sparkContext.broadcast(scanner(templates, phrases))

    @F.pandas_udf("n_words long, base array<struct<start:long,label:string>>, found array<struct<start:long,end:long,label:string>>")
    def compute(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = [shared.value.scan(t) for t in as_texts(part)]
            yield pd.DataFrame({"n_words": [g[0] for g in got], "base": [[{"start": s, "label": v} for s, v in g[1]] for g in got], "found": [[{"start": s, "end": e, "label": v} for s, e, v in g[2]] for g in got]})

    return compute(text)
