"""License scans: templates with optional and replaceable regions, compiled into token automata.

A template is the wording of a license text or notice with markup: ``<<optional>> ... <</optional>>``
may be left out, ``<<any 0-20>>`` stands for that many words of any kind, ``<<or>>`` between
``<<choice>>`` and ``<</choice>>`` separates wordings of which one must stand.  All other words
are mandatory and must match exactly.  Words are taken as in the texts: case, punctuation and
line breaks do not matter.

A text is accepted where the automaton of a template gets from its start to its end over
consecutive words.  A template starts with a mandatory word, so an automaton is started only at
words that are such a first word, and it is given up at the first word that fits no way on: the
work for each start is bounded by the length of the template.

Base labels are those of fixed phrases; they are kept whatever the templates say.

Defined cases: a null text and an empty text have no words, no labels and score 0.  Repeated
rows are scanned one by one.  An empty table gives no rows.  Texts of any length are scanned
whole.  The key is passed on as it is, null or not.  Columns other than the two named are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexloom.llm.common import LOWER, UPPER

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrase and label.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

_FREE_USE = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
_NO_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
_AS_IS = """THIS SOFTWARE IS PROVIDED BY <<any 1-20>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL <<any 1-20>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: <<any 0-1>> Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer. <<any 0-1>> Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
provided with the distribution."""
_BSD_NAMES = """<<any 0-1>> Neither the name of <<any 1-20>> nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""

_ARTICLE = "<<optional>>a<</optional>> <<optional>>the<</optional>>"
_CC_VERSION = "<<choice>>1.0<<or>>2.0<<or>>2.5<<or>>3.0<<or>>4.0<</choice>>"

# Label and wording of public license texts and of the notices that name a license.
TEMPLATES = {
    "mit-text": f"""{_FREE_USE} The above copyright notice and this permission notice <<optional>>(including the next
paragraph)<</optional>> shall be included in all copies or substantial portions of the Software. {_NO_WARRANTY}
<<optional>>IN NO EVENT SHALL <<any 1-20>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.<</optional>>""",
    "mit-notice": """<<choice>>Released<<or>>Licensed<<or>>Distributed<<or>>Available<</choice>> under the <<optional>>terms
of the<</optional>> MIT License""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
PROVIDED "AS IS" AND <<any 1-20>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS.""",
    "bsd-2-clause-text": f"{_BSD} {_AS_IS}",
    "bsd-3-clause-text": f"{_BSD} {_BSD_NAMES} {_AS_IS}",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
following restrictions:""",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 <<optional>>(the "License"); you may not use this
file except in compliance with the License. You may obtain a copy of the License at <<any 1-12>> Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.<</optional>>""",
    "gpl-notice": """This <<choice>>work<<or>>program<<or>>software<<or>>file<</choice>> is licensed under the <<optional>>terms of
the<</optional>> GNU General Public License <<optional>>as published by the Free Software Foundation<</optional>> version
<<choice>>2<<or>>3<</choice>>""",
    "gpl-text": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version <<choice>>2<<or>>3<</choice>> of the License,
or (at your option) any later version.""",
    "cc-by-notice": f"Licensed under {_ARTICLE} CC BY {_CC_VERSION}",
    "cc-by-nc-notice": f"Licensed under {_ARTICLE} CC BY-NC {_CC_VERSION}",
    "cc-by-sa-notice": f"Licensed under {_ARTICLE} CC BY-SA {_CC_VERSION}",
    "unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy,
modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for
any purpose, commercial or non-commercial, and by any means.""",
}

MARK = r"<<(/?optional|/?choice|or|any \d+-\d+)>>"
MOST_ANY = 200

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.ArrayType(T.StringType())),
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField("score", T.DoubleType()),
        T.StructField("spans", T.ArrayType(T.StructType([
            T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)


def words_of(text: str | None) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER))) if text else []


@dataclass(frozen=True)
class Automaton:
    """States of a template.  ``on[s]`` leads from a state by a word, ``any_on[s]`` by any word;
    free ways are worked in already.  ``starts``: the states after each possible first word."""

    on: tuple[dict[str, frozenset[int]], ...]
    any_on: tuple[frozenset[int], ...]
    starts: Mapping[str, frozenset[int]]
    end: int

    def accept(self, words: Sequence[str], at: int) -> int:
        """The end of the longest accepted run of words that starts at ``at``; -1 if there is none."""
        states, last = self.starts.get(words[at], frozenset()), -1
        at += 1
        while states:
            if self.end in states:
                last = at
            if at == len(words):
                break
            word, after = words[at], set()
            for s in states:
                after |= self.any_on[s]
                to = self.on[s].get(word)
                if to:
                    after |= to
            states = after
            at += 1
        return last


def compile_template(template: str) -> Automaton:
    """An automaton over words; raises ``ValueError`` where the markup is not well formed or
    where the text of a template could begin with a replaceable region."""
    ways: list[dict[str, set[int]]] = []
    anyway: list[set[int]] = []
    free: list[set[int]] = []

    def state() -> int:
        ways.append({})
        anyway.append(set())
        free.append(set())
        return len(ways) - 1

    first = at = state()
    open_marks: list[tuple[str, int, int]] = []  # kind, state before, state after
    for piece in re.split(r"(<<[^>]*>>)", template):
        mark = re.fullmatch(MARK, piece)
        if piece.startswith("<<") and not mark:
            raise ValueError(f"unknown markup {piece}")
        if not mark:
            for word in words_of(piece):
                to = state()
                ways[at].setdefault(word, set()).add(to)
                at = to
        elif mark[1].startswith("any"):
            least, most = map(int, mark[1][4:].split("-"))
            if not least <= most <= MOST_ANY:
                raise ValueError(f"a region of {least} to {most} words is not supported")
            line = [at, *(state() for _ in range(most))]
            for one, two in zip(line, line[1:]):
                anyway[one].add(two)
            at = state()
            for one in line[least:]:
                free[one].add(at)
        elif mark[1] in ("optional", "choice"):
            open_marks.append((mark[1], at, state()))
            at = state()
            free[open_marks[-1][1]].add(at)
        else:
            kind = "choice" if mark[1] == "or" else mark[1][1:]
            if not open_marks or open_marks[-1][0] != kind:
                raise ValueError(f"<<{mark[1]}>> without its beginning")
            _, before, after = open_marks[-1]
            free[at].add(after)
            if mark[1] == "or":
                at = state()
                free[before].add(at)
            else:
                open_marks.pop()
                if kind == "optional":
                    free[before].add(after)
                at = after
    if open_marks:
        raise ValueError(f"<<{open_marks[-1][0]}>> is not closed")

    def closed(states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in free[todo.pop()] - seen:
                seen.add(s)
                todo.append(s)
        return frozenset(seen)

    starts: dict[str, frozenset[int]] = {}
    for s in closed({first}):
        if anyway[s] or s == at:
            raise ValueError("a template begins with a mandatory word")
        for word, to in ways[s].items():
            starts[word] = starts.get(word, frozenset()) | closed(to)
    return Automaton(
        tuple({w: closed(to) for w, to in on.items()} for on in ways),
        tuple(closed(to) if to else frozenset() for to in anyway),
        starts,
        at,
    )


def scanner(phrases: Mapping[str, str], templates: Mapping[str, str]):
    """A function from a text to the values of ``RESULT``."""
    automata = {label: compile_template(t) for label, t in templates.items()}
    beginning: dict[str, list[tuple[str, Automaton]]] = {}
    for label, automaton in automata.items():
        for word in automaton.starts:
            beginning.setdefault(word, []).append((label, automaton))
    runs: dict[str, list[tuple[list[str], str]]] = {}
    for phrase, label in phrases.items():
        words = words_of(phrase)
        runs.setdefault(words[0], []).append((words, label))
    firsts = beginning.keys() | runs.keys()

    def scan(text: str | None) -> dict:
        words = words_of(text)
        places, base, spans = [], set(), []
        if not firsts.isdisjoint(words):
            for at, word in enumerate(words):
                if word not in firsts:
                    continue
                for run, label in runs.get(word, ()):
                    if words[at : at + len(run)] == run:
                        places.append(at)
                        base.add(label)
                for label, automaton in beginning.get(word, ()):
                    end = automaton.accept(words, at)
                    if end > at:
                        spans.append({"label": label, "start": at, "end": end})
        accepted = {s["label"] for s in spans}
        return {
            "n_words": len(words),
            "n_base": len(places),
            "first_word": places[0] if places else None,
            "last_word": places[-1] if places else None,
            "base_labels": sorted(base),
            "labels": sorted(base | accepted),
            "score": 1.0 if accepted else 0.5 if base else 0.0,
            "spans": spans,
        }

    return scan


def scan_licenses(
    docs: DataFrame, key: str, text: str = "text", phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES
) -> DataFrame:
    """``key``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``,
    ``score`` and ``spans`` (label, first word, word after the last) of every text.

    The score is 1 where a template is accepted, 0.5 where a phrase alone stands, else 0.  No
    row is moved; the templates are checked here and go to the tasks with the function.
    """
    scanner(phrases, templates)
    named = pa.schema([
        ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
    ])

    def scan_parts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(phrases, templates)
        for part in parts:
            rows = pa.RecordBatch.from_pylist([scan(t) for t in part.column(1).to_pylist()], schema=named)
            yield pa.RecordBatch.from_arrays([part.column(0), *rows.columns], names=[key, *named.names])

    rows = docs.select(key, text)
    return rows.mapInArrow(scan_parts, T.StructType([rows.schema[key], *RESULT.fields]))
