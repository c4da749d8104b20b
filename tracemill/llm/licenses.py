"""Licence scans: a suffix automaton over the tokens of all templates gives matching statistics, long matches are chained into spans.

The automaton holds every run of consecutive words of every template and phrase. A text runs through it once, word by word; at each
word it tells the longest run of template words that ends there. Runs that can't grow any more and are long enough are matches; those
that follow each other in both text and template are chained, and a chain that covers enough of its template is a span of that licence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tracemill.llm.tables import id_and_text

#: Phrases and their labels; a phrase that stands anywhere gives its label.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)
#: Sentences of public licence notices and their labels.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under cc by 4 0", "cc-by"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
)
#: Words of a match at least; share of a template that a chain covers at least; words of text or template between two matches at most.
LEAST_MATCH, LEAST_COVER, MOST_GAP = 3, 0.8, 4

#: A-Z become a-z; every other ASCII byte but digits and a-z becomes a blank; bytes of other letters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


@dataclass
class Automaton:
    """Generalised suffix automaton of word sequences. State 0 is the empty run."""

    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    longest: list[int] = field(default_factory=lambda: [0])
    #: Of each state: (sequence, place of its last word) of every run that it stands for.
    ends: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])

    def _state(self, like: int | None, longest: int) -> int:
        self.step.append(dict(self.step[like]) if like is not None else {})
        self.link.append(self.link[like] if like is not None else 0)
        self.longest.append(longest)
        self.ends.append([])
        return len(self.step) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """The state of the runs of q that are p and a word; parts it from the longer ones of q."""
        if self.longest[q] == self.longest[p] + 1:
            return q
        part = self._state(q, self.longest[p] + 1)
        self.link[q] = part
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = part
            p = self.link[p]
        return part

    def add(self, words: list[int]) -> None:
        """Adds one sequence; the runs of earlier ones stay apart from it."""
        last = 0
        for word in words:
            p = last
            if word in self.step[p]:
                last = self._split(p, self.step[p][word], word)
                continue
            last = self._state(None, self.longest[p] + 1)
            while p >= 0 and word not in self.step[p]:
                self.step[p][word] = last
                p = self.link[p]
            self.link[last] = self._split(p, self.step[p][word], word) if p >= 0 else 0

    def mark(self, number: int, words: list[int]) -> None:
        """Notes the ends of a sequence's runs in the states on the way and in all that their links lead to."""
        state = 0
        for place, word in enumerate(words):
            state = self.step[state][word]
            at = state
            while at > 0:
                self.ends[at].append((number, place))
                at = self.link[at]


class Scanner:
    """The automaton of phrases and templates, and the scan of one text."""

    def __init__(self, phrases: tuple = PHRASES, templates: tuple = TEMPLATES, least_match: int = LEAST_MATCH, least_cover: float = LEAST_COVER, most_gap: int = MOST_GAP):
        self.sequences = [(text.encode().translate(FOLD).split(), label) for text, label in (*phrases, *templates)]
        self.phrases, self.least_match, self.least_cover, self.most_gap = len(phrases), least_match, least_cover, most_gap
        self.words = {w: k for k, w in enumerate(dict.fromkeys(w for ws, _ in self.sequences for w in ws))}
        self.automaton = Automaton()
        coded = [[self.words[w] for w in ws] for ws, _ in self.sequences]
        for ws in coded:
            self.automaton.add(ws)
        for number, ws in enumerate(coded):
            self.automaton.mark(number, ws)
        #: Of each state, the phrases that end where it is reached, with the words that must have matched: its own and those of its links.
        self.whole: list[list[tuple[int, int]]] = [[] for _ in self.automaton.step]
        for number, ws in enumerate(coded[: self.phrases]):
            state = 0
            for w in ws:
                state = self.automaton.step[state][w]
            self.whole[state].append((number, len(ws)))
        for state in sorted(range(1, len(self.whole)), key=self.automaton.longest.__getitem__):
            self.whole[state] += self.whole[self.automaton.link[state]]

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, int, float]]]:
        """Number of words; (start, phrase) of each place of a phrase; (start, end, sequence, covered share) of each chained span."""
        words = (text or "").encode().translate(FOLD).split()
        known = self.words
        codes = list(map(known.get, words))
        step, link, longest, whole = self.automaton.step, self.automaton.link, self.automaton.longest, self.whole
        places: list[tuple[int, int]] = []
        matches: list[tuple[int, int, int]] = []  # start, words, state
        state = matched = 0
        for i in [k for k, c in enumerate(codes) if c is not None]:
            code = codes[i]
            if matched and codes[i - 1] is None:
                if matched >= self.least_match:
                    matches.append((ended - matched, matched, state))
                state = matched = 0
            if matched and code not in step[state]:
                if matched >= self.least_match:
                    matches.append((i - matched, matched, state))
                while state and code not in step[state]:
                    state = link[state]
                    matched = longest[state]
            state = step[state].get(code, 0)
            matched = matched + 1 if state else 0
            ended = i + 1
            for number, size in whole[state]:
                if matched >= size:
                    places.append((i + 1 - size, number))
        if matched >= self.least_match:
            matches.append((ended - matched, matched, state))
        return len(words), places, self._spans(matches)

    def _spans(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """Chains of matches that follow each other in text and template, and cover enough of it."""
        by_sequence: dict[int, list[tuple[int, int, int]]] = {}
        for start, size, state in matches:
            for number, place in self.automaton.ends[state]:
                if number >= self.phrases and place + 1 >= size:
                    by_sequence.setdefault(number, []).append((start, size, place + 1 - size))
        out = []
        for number, found in by_sequence.items():
            need = len(self.sequences[number][0])
            chains: list[list[int]] = []  # text start and end, template end, covered words
            for start, size, at in found:
                best = None
                for chain in reversed(chains):
                    if start - chain[1] > self.most_gap:
                        break
                    skip = max(0, chain[1] - start, chain[2] - at)
                    if skip < size and start > chain[0] and at > chain[4] and at - chain[2] <= self.most_gap and (best is None or chain[3] - skip > best[0][3] - best[1]):
                        best = (chain, skip)
                if best:
                    (begin, _, _, covered, first), skip = best
                    chains.append([begin, start + size, at + size, covered + size - skip, first])
                else:
                    chains.append([start, start + size, at + size, size, at])
            out += [(c[0], c[1], number, c[3] / need) for c in chains if c[3] >= self.least_cover * need]
        return out


@lru_cache(4)
def scanner(*settings) -> Scanner:
    return Scanner(*settings)


def scan_licenses(
    docs: DataFrame,
    phrases: tuple = PHRASES,
    templates: tuple = TEMPLATES,
    least_match: int = LEAST_MATCH,
    least_cover: float = LEAST_COVER,
    most_gap: int = MOST_GAP,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: doc_id, n_words, n_base (places of phrases), first_word and last_word (smallest and largest start of those, null without),
    base_labels and labels (of phrases; of phrases and spans; distinct, sorted, joined by commas), score (1 with a phrase, else the
    largest covered share of a template, 0 without) and spans (array of start, end, label, covered).

    Words are counted from 0. A null text counts as empty: no words, empty labels, score 0. Repeated rows and null ids are kept; an empty
    table gives none; other columns are not read.
    """
    settings = (phrases, templates, least_match, least_cover, most_gap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(*settings)
        label_of = [label for _, label in scan.sequences]
        for batch in batches:
            columns: list[list] = [[] for _ in kinds]
            for text in batch.column("text"):
                n, places, spans = scan.scan(text.as_py())
                starts = [s for s, _ in places]
                base = {label_of[k] for _, k in places}
                found = [{"start": s, "end": e, "label": label_of[k], "covered": c} for s, e, k, c in spans]
                score = 1.0 if places else max([0.0, *(min(1.0, c) for _, _, _, c in spans)])
                row = (n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x["label"] for x in found})), score, found)
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names)

    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("covered", pa.float64())]))]
    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:long,end:long,label:string,covered:double>>")
