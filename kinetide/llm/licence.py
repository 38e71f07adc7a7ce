"""License scans by template-markup matching.

A template is text with markup: ``<<beginOptional>> ... <<endOptional>>`` (nested at will) and ``<<var;name=x;least=0;most=9>>``
for a replaceable region of so many words. All templates are compiled into one automaton over words: optional regions are
jumps, replaceable ones are steps on any word. A place is accepted if the words from it on lead to a template's last state,
that is if its mandatory wording is there exactly. Sets of states are made into states of their own as they are met, and
each worker keeps them.

Texts go through in Arrow batches. Words are cut by numpy; only places whose first and second word can begin a template are
tried by the automaton, so most words cost no step of Python. No row is shuffled.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed_text, pieces, table
from .words import Words, cut

WORD = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
PATTERN = re.compile(rb"[0-9a-z\x80-\xff]+")
PIECE = 8 << 20
#: States that a worker keeps; beyond them it begins anew.
KEPT = 100_000
#: Words of fixed wording from which a match counts in full.
FULL = 8

#: Fixed phrases: the base labels.
PHRASES = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}

OPT, END = "<<beginOptional>>", "<<endOptional>>"
#: Notices and whole texts: label and template.
TEMPLATES = (
    ("mit", f"under {OPT}the terms of{END} the mit license"),
    ("mit", f"""{OPT}mit license{END} {OPT}copyright {OPT}(c){END} <<var;name=holder;least=1;most=30>>{END} permission is hereby granted, free of charge, to any person obtaining a copy of this
software and associated documentation files (the "software"), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions: the above copyright notice and
this permission notice {OPT}(including the next paragraph){END} shall be included in all copies or substantial portions of the software."""),
    ("apache-2.0", f"under the apache license{OPT}, version{END} 2.0"),
    ("apache-2.0", f"""licensed under the apache license, version 2.0 (the "license"); you may not use this file except in compliance with the license. {OPT}you may obtain a copy of the license at
<<var;name=address;least=1;most=12>>{END} unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an "as is" basis, without warranties
or conditions of any kind, either express or implied. {OPT}see the license for the specific language governing permissions and limitations under the license.{END}"""),
    ("gpl-2.0", f"under {OPT}the terms of{END} the gnu general public license {OPT}as published by the free software foundation{END} {OPT}either{END} version 2 {OPT}of the license{END}"),
    ("gpl-3.0", f"under {OPT}the terms of{END} the gnu general public license {OPT}as published by the free software foundation{END} {OPT}either{END} version 3 {OPT}of the license{END}"),
    ("lgpl", f"gnu {OPT}lesser{END} {OPT}library{END} lesser general public license"),
    ("cc-by-4.0", f"under {OPT}a creative commons{END} {OPT}the{END} cc by 4.0"),
    ("cc-by-nc-4.0", f"under {OPT}a creative commons{END} {OPT}the{END} cc by-nc 4.0"),
    ("cc-by-sa-4.0", f"under {OPT}a creative commons{END} {OPT}the{END} cc by-sa 4.0"),
    ("cc-by-4.0", f"creative commons attribution 4.0 {OPT}international{END} {OPT}public{END} license"),
    ("bsd", f"""redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: {OPT}1.{END} redistributions of source
code must retain the above copyright notice, this list of conditions and the following disclaimer. {OPT}2.{END} redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {OPT}{OPT}3.{END} neither the name of <<var;name=holder;least=1;most=20>> may be used
to endorse or promote products derived from this software without specific prior written permission.{END}"""),
    ("isc", f"""permission to use, copy, modify, and{OPT}/or{END} distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
permission notice appear in all copies."""),
    ("spdx", "spdx-license-identifier: <<var;name=id;least=1;most=1>>"),
)
#: All templates; those of the base come first.
RULES = (*PHRASES.items(), *TEMPLATES)


@dataclass(frozen=True)
class Fixed:
    word: bytes


@dataclass(frozen=True)
class Any:
    least: int
    most: int


@dataclass
class Optional:
    parts: list = field(default_factory=list)


def parsed(template: str) -> list:
    """Fixed words, replaceable and optional regions of a template, in order."""
    stack = [Optional()]
    for token in re.findall(r"<<.*?>>|[^<]+|<", template):
        if token == OPT:
            stack.append(Optional())
        elif token == END:
            done = stack.pop()
            if not stack:
                raise ValueError("an optional region ends that did not begin")
            stack[-1].parts.append(done)
        elif token.startswith("<<var"):
            given = dict(x.split("=", 1) for x in token[2:-2].split(";")[1:])
            stack[-1].parts.append(Any(int(given.get("least", 0)), int(given["most"])))
        elif token.startswith("<<"):
            raise ValueError(f"no such markup: {token}")
        else:
            stack[-1].parts += [Fixed(w) for w in words_of(token)]
    if len(stack) > 1:
        raise ValueError("an optional region does not end")
    return stack[0].parts


def words_of(text: str) -> list[bytes]:
    """Words of a text, A-Z in lower case."""
    return PATTERN.findall(text.encode().lower())  # of bytes: lower() changes A-Z only


def mandatory(parts: list) -> int:
    """How many words of a template are fixed and not optional."""
    return sum(isinstance(p, Fixed) for p in parts)


class Automaton:
    """Steps from word to word through all templates at once. A state of a template is a place between its parts; ``on`` and
    ``any`` are what a word and any word lead to, ``skip`` what needs none, ``last`` the template that ends there."""

    def __init__(self, templates: list[list]):
        self.on: list[dict[bytes, int]] = []
        self.any: list[int | None] = []
        self.skip: list[list[int]] = []
        self.last: dict[int, int] = {}
        begins = []
        for k, parts in enumerate(templates):
            begins.append(self._state())
            self.last[self._add(begins[-1], parts)] = k
        self.start = self._closed(begins)
        if any(s in self.last or self.any[s] is not None for s in self.start):
            raise ValueError("a template must begin with a fixed word")
        #: Sets of states by number, with the templates that end in each, and where each word leads.
        self.clear()

    def clear(self) -> None:
        self.numbers, self.sets, self.ends, self.go = {self.start: 0}, [self.start], [()], [{}]

    def _state(self) -> int:
        self.on.append({})
        self.any.append(None)
        self.skip.append([])
        return len(self.on) - 1

    def _add(self, at: int, parts: list) -> int:
        for p in parts:
            if isinstance(p, Fixed):
                to = self._state()
                self.on[at][p.word] = to
            elif isinstance(p, Any):
                own = [at]
                for _ in range(p.most):
                    own.append(self._state())
                    self.any[own[-2]] = own[-1]
                to = self._state()  # a place of its own, so that what follows does not step into the region
                for s in own[p.least :]:
                    self.skip[s].append(to)
            else:
                begin = self._state()
                self.skip[at].append(begin)
                end = self._add(begin, p.parts)
                to = self._state()
                self.skip[end].append(to)
                self.skip[at].append(to)
            at = to
        return at

    def _closed(self, states) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for s in self.skip[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return frozenset(found)

    def step(self, state: int, word: bytes) -> int:
        """The number of the set that a word leads to, -1 if it is empty."""
        to = self.go[state].get(word)
        if to is None:
            own = self.sets[state]
            some = {self.on[s][word] for s in own if word in self.on[s]} | {self.any[s] for s in own if self.any[s] is not None}
            some = self._closed(some)
            to = self.numbers.get(some, -1) if some else -1
            if some and to < 0:
                to = self.numbers[some] = len(self.sets)
                self.sets.append(some)
                self.ends.append(tuple(sorted(self.last[s] for s in some if s in self.last)))
                self.go.append({})
            if any(word in self.on[s] for s in own):  # other words are as good as any, and too many to keep
                self.go[state][word] = to
        return to

    def matches(self, words) -> dict[int, int]:
        """Templates that begin at the first of ``words``, each with the number of words of its longest match."""
        if len(self.sets) > KEPT:
            self.clear()
        found, state = {}, 0
        for n, w in enumerate(words, 1):
            state = self.step(state, w)
            if state < 0:
                break
            for k in self.ends[state]:
                found[k] = n
        return found

    def begins(self) -> tuple[set[tuple[bytes, bytes]], set[bytes]]:
        """First two words that can begin a match, and first words after which any may come."""
        pairs, free = set(), set()
        for first in {w for s in self.start for w in self.on[s]}:
            then = self.sets[self.step(0, first)]
            if any(s in self.last or self.any[s] is not None for s in then):
                free.add(first)
            pairs |= {(first, w) for s in then for w in self.on[s]}
        return pairs, free


def heads(words: Words) -> np.ndarray:
    """The first eight bytes of each word as a number."""
    data = np.concatenate([words.data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(words.data) + 1,), "<u8", data.tobytes(), strides=(1,))
    keep = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    return eight[words.start] & keep[np.minimum(words.end - words.start, 8)]


def head(word: bytes) -> int:
    return int.from_bytes(word[:8], "little")


class Scanner:
    """Places of a batch's words that an automaton accepts."""

    def __init__(self, rules: tuple):
        self.automaton = Automaton([parsed(t) for _, t in rules])
        pairs, free = self.automaton.begins()
        self.free = np.array([head(w) for w in free], np.uint64)
        self.seconds: dict[int, list[int]] = {}
        for a, b in pairs:
            if a not in free:
                self.seconds.setdefault(head(a), []).append(head(b))

    def places(self, w: Words) -> np.ndarray:
        """Words from which a template may begin: first and second word agree in their first eight bytes."""
        own = heads(w)
        found = [np.flatnonzero(np.isin(own, self.free))] if len(self.free) else []
        after = np.zeros_like(own)
        after[:-1] = np.where(w.row[1:] == w.row[:-1], own[1:], 0)
        for first, second in self.seconds.items():
            at = np.flatnonzero(own == np.uint64(first))
            found.append(at[np.isin(after[at], np.array(second, np.uint64))])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, int)

    def scan(self, w: Words, n: int) -> list[list[tuple[int, int, int]]]:
        """For each of ``n`` rows its spans: first word, rule, word after the last."""
        out: list[list] = [[] for _ in range(n)]
        begin = np.searchsorted(w.row, np.arange(n + 1))
        for at in self.places(w).tolist():
            row = int(w.row[at])
            for k, size in sorted(self.automaton.matches(w.bytes(i) for i in range(at, int(begin[row + 1]))).items()):
                out[row].append((at - int(begin[row]), k, at - int(begin[row]) + size))
        return out


@functools.lru_cache(2)
def scanner(rules: tuple) -> Scanner:
    """Kept by each worker."""
    return Scanner(rules)


FOUND = "key bigint, n_words bigint, spans array<struct<first:int,rule:int,next:int>>"


def scan(docs: DataFrame, rules: tuple = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row key, n_words and the spans of words that ``rules`` (label, template) accept: first, rule (its place in
    ``rules``), next, by first and rule; the longest for each first and rule.

    Null texts are empty and have no word; texts of any length are scanned whole; a null id stays null; repeated rows get a
    result each; an empty table gives no row; other columns are not read. A template that does not begin with fixed wording,
    or whose markup does not close, is an error."""
    Automaton([parsed(t) for _, t in rules])
    kind = pa.list_(pa.struct([("first", pa.int32()), ("rule", pa.int32()), ("next", pa.int32())]))

    def each(batches):
        own = scanner(rules)
        for batch in batches:
            for part in pieces(batch, 1, PIECE):
                w = cut(part.column(1), WORD)
                spans = [[dict(zip(("first", "rule", "next"), s, strict=True)) for s in x] for x in own.scan(w, part.num_rows)]
                n = np.bincount(w.row, minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(spans, kind)], ["key", "n_words", "spans"])

    return keyed_text(docs, id_col, text_col).mapInArrow(each, FOUND)


def labelled(found: DataFrame, rules: tuple = RULES, base: int = len(PHRASES)) -> DataFrame:
    """key, n_words, n_base, first_word, last_word (of spans of the first ``base`` rules), base_labels, labels and score: the
    fixed words of the fullest accepted template over FULL, at most 1; 0 without any."""
    names = F.array(*[F.lit(label) for label, _ in rules])
    fixed = F.array(*[F.lit(min(1.0, mandatory(parsed(t)) / FULL)) for _, t in rules])
    of_base = F.filter("spans", lambda s: s["rule"] < base)
    places = F.transform(of_base, lambda s: s["first"])
    said = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: F.element_at(names, s["rule"] + 1)))), ",")
    return found.select(
        "key", "n_words", F.size(of_base).cast("bigint").alias("n_base"), F.array_min(places).cast("bigint").alias("first_word"), F.array_max(places).cast("bigint").alias("last_word"),
        said(of_base).alias("base_labels"), said(F.col("spans")).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda s: F.element_at(fixed, s["rule"] + 1))), F.lit(0.0)).alias("score"),
    )


def op11_licence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(scan(table(spark, sf_dir, "documents"))).withColumnRenamed("key", "doc_id")


def regex(parts: list) -> str:
    """A template as a regular expression over words that each follow one space."""
    out = ""
    for p in parts:
        if isinstance(p, Fixed):
            out += f" {p.word.decode()}"
        elif isinstance(p, Any):
            out += f"(?: [^ ]+){{{p.least},{p.most}}}"
        else:
            out += f"(?:{regex(p.parts)})?"
    return out


def _sql() -> str:
    """The same by regular expressions, and the base by comparing words one by one."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    at = [" AND ".join(f"w[i + {j}] = '{x}'" for j, x in enumerate(p.split())) for p in PHRASES.values()]
    places = [f"list_filter(range(1, len(w) + 1), lambda i: {c})" for c in at]
    base = ", ".join(f"CASE WHEN len({p}) > 0 THEN '{label}' END" for label, p in zip(PHRASES, places, strict=True))
    hit = [f"regexp_matches(s, '{regex(parsed(t))} ')" for _, t in RULES]
    label = ", ".join(f"CASE WHEN {h} THEN '{name}' END" for (name, _), h in zip(RULES, hit, strict=True))
    score = ", ".join(f"CASE WHEN {h} THEN {min(1.0, mandatory(parsed(t)) / FULL)} ELSE 0.0 END" for (_, t), h in zip(RULES, hit, strict=True))
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
e AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s, list_concat({", ".join(places)}) AS p FROM d)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base, list_min(p) - 1 AS first_word, list_max(p) - 1 AS last_word,
array_to_string(list_sort(list_distinct([{base}])), ',') AS base_labels, array_to_string(list_sort(list_distinct([{label}])), ',') AS labels, CAST(greatest({score}) AS DOUBLE) AS score FROM e"""


OP11_SQL = _sql()
