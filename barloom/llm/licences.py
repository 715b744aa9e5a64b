"""License scans: matching statistics against a generalised suffix automaton of licence words, chained into spans.

The automaton holds every run of words of every template. Reading a text's words through it gives, at each word and for
each place of each template, the longest run that ends at both. Runs that cannot be extended are matches; long matches
of one template that follow one another in text and template, with small gaps, make a span. Words outside the templates
reset the automaton, so it is only stepped through runs of template words as long as the shortest phrase.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import LOWER, joined, pieces, same_words, span_hashes, spans
from barloom.llm.licence_texts import BODIES

# Phrases whose places are counted, and their labels (fixed values)
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Short notices by which licences are applied, and their labels (public licence texts; fixed values)
TEMPLATES = [
    ("gpl-notice", "this work is licensed under the gnu general public license version 3"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-notice", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("apache-notice", "licensed under the apache license version 2 0"),
    ("apache-notice", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("cc-by-nc-notice", "licensed under cc by nc 4 0"),
    ("cc-by-notice", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mit-notice", "released under the mit license"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-notice", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc-notice", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
]

# Bytes of the word rule [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


@dataclass
class Automaton:
    """A generalised suffix automaton over word sequences.

    moves, link and length are of states; ends: templates and the places in them after the state's runs; phrases: those
    that end wherever the state is reached with at least their length.
    """

    moves: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[set[tuple[int, int]]] = field(default_factory=lambda: [set()])  # of each state, templates and places after a run
    phrases: list[list[int]] = field(default_factory=lambda: [[]])

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.moves.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        self.phrases.append([])
        return len(self.moves) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The state of q's runs that are p's with the word; q keeps the longer ones."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.moves[q]))
        self.link[q] = clone
        while p >= 0 and self.moves[p].get(word) == q:
            self.moves[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[int]) -> list[int]:
        """Adds a sequence; the states of its prefixes."""
        last, path = 0, []
        for word in words:
            q = self.moves[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
            else:
                new, p = self._state(self.length[last] + 1, 0, {}), last
                while p >= 0 and word not in self.moves[p]:
                    self.moves[p][word] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.moves[p][word]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
                last = new
            path.append(last)
        return path

    def walk(self, words: list[int], state: int = 0) -> int:
        for word in words:
            state = self.moves[state][word]
        return state


@dataclass
class Scanner:
    """Templates and phrases compiled for scanning.

    least: words of a match that counts; gap: words that may lie between chained matches; cover: the share of a template
    that a span must have for its label.
    """

    templates: list[tuple[str, str]]
    phrases: dict[str, str]
    least: int = 3
    gap: int = 4
    cover: float = 0.6

    def __post_init__(self) -> None:
        texts = [t.split() for _, t in self.templates] + [p.split() for p in self.phrases]
        self.names = {w: k for k, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        raw = " ".join([*self.names, ""]).encode()
        size = np.array([len(w.encode()) for w in self.names], np.int64)
        begin = np.concatenate(([0], np.cumsum(size + 1)[:-1])).astype(np.int64)
        self.raw = np.frombuffer(raw, np.uint8)
        hashes = span_hashes(self.raw, begin, begin + size)
        self.order = np.argsort(hashes)
        self.hashes, self.begin, self.end = hashes[self.order], begin[self.order], (begin + size)[self.order]
        self.sizes = [len(t) for t in texts]
        self.automaton = auto = Automaton()
        coded = [[self.names[w] for w in t] for t in texts]
        for words in coded:
            auto.add(words)
        for k, words in enumerate(coded[: len(self.templates)]):  # states are final now
            state = 0
            for i, word in enumerate(words):
                state = auto.moves[state][word]
                auto.ends[state].add((k, i + 1))
        # a state's runs also end where longer runs of states that link to it do
        for s in sorted(range(1, len(auto.link)), key=lambda s: -auto.length[s]):
            if auto.link[s]:
                auto.ends[auto.link[s]] |= auto.ends[s]
        # all places at which a state's runs or ends of them stand, each with the words of the longest one
        self.spots: list[list[tuple[int, int, int]]] = [[] for _ in auto.link]
        for s in sorted(range(1, len(auto.link)), key=lambda s: auto.length[s]):
            if auto.length[s] >= self.least:
                shorter = [x for x in self.spots[auto.link[s]] if x[:2] not in auto.ends[s]]
                self.spots[s] = [*((k, place, auto.length[s]) for k, place in sorted(auto.ends[s])), *shorter]
        offset = len(self.templates)
        for k, words in enumerate(coded[offset:]):
            auto.phrases[auto.walk(words)].append(k)
        for s in sorted(range(1, len(auto.link)), key=lambda s: auto.length[s]):
            auto.phrases[s] = [*auto.phrases[s], *auto.phrases[auto.link[s]]]
        self.shortest = min([self.least, *self.sizes[offset:]])
        self.phrase_sizes, self.phrase_labels = self.sizes[offset:], list(self.phrases.values())

    def scan(self, run: list[int], at: int, found: dict) -> None:
        """Adds the phrase places and the matches of one run of template words that begins at word `at`.

        A match (end, words, template, place) is a run of `least` words or more that the text and the template share, up to
        these places, and that goes on in neither direction; there is one for each place of each template.
        """
        auto, state, length = self.automaton, 0, 0
        moves, link, lengths, phrases = auto.moves, auto.link, auto.length, auto.phrases
        open_: dict[tuple[int, int], int] = {}  # words of the matches that end here, by template and place
        matches = found["matches"]
        for i, word in enumerate(run):
            to = moves[state].get(word)
            while state > 0 and to is None:
                state = link[state]
                length = lengths[state]
                to = moves[state].get(word)
            state, length = (to, length + 1) if to is not None else (0, 0)
            now = {(k, place): n if n < length else length for k, place, n in self.spots[state]} if length >= self.least else {}
            for (k, place), n in open_.items():
                if (k, place + 1) not in now:
                    matches.append((at + i, n, k, place))
            open_ = now
            for k in phrases[state]:
                if length >= self.phrase_sizes[k]:
                    found["places"].append((at + i + 1 - self.phrase_sizes[k], k))
        matches += [(at + len(run), n, k, place) for (k, place), n in open_.items()]

    def chain(self, matches: list[tuple[int, int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Spans (label, first word, past the last, covered share): of each template the chains that cover enough, best
        first, that do not overlap.

        Matches chain if they follow in text and template and at most `gap` words lie between them in the text.
        """
        by: dict[int, list[tuple[int, int, int]]] = {}
        for end, n, k, place in matches:
            by.setdefault(k, []).append((end - n, place - n, n))
        out = []
        for k, pieces_ in by.items():
            left, more = sorted(pieces_), True
            while left and more:
                more = sorted((c for c in self._ends_of_chains(left) if c[0] >= self.cover * self.sizes[k]), reverse=True)
                taken: list[tuple[int, int]] = []  # in ascending order
                for total, first, end in more:
                    at = bisect_right(taken, (first, end))
                    if (at == 0 or taken[at - 1][1] <= first) and (at == len(taken) or end <= taken[at][0]):
                        taken.insert(at, (first, end))
                        out.append((self.templates[k][0], first, end, total / self.sizes[k]))
                if more:
                    firsts = [a for a, _ in taken]
                    kept = []
                    for piece in left:
                        at = bisect_left(firsts, piece[0] + piece[2]) - 1  # the last span that begins before the piece ends
                        if at < 0 or taken[at][1] <= piece[0]:
                            kept.append(piece)
                    left = kept
        return sorted(out, key=lambda s: (s[1], s[2], s[0]))

    def _ends_of_chains(self, pieces_: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
        """For each piece (first word, place, words), in order, the best chain that ends with it: words covered, first word, end."""
        chains: list[tuple[int, int, int, int]] = []  # words covered, text end, template end, first word
        for start, place, n in pieces_:
            chains = [c for c in chains if start - c[1] <= self.gap]
            total, first = max(((c[0], c[3]) for c in chains if c[1] <= start and c[2] <= place), default=(0, start))
            chains.append((total + n, start + n, place + n, first))
            yield total + n, first, start + n


def scan_texts(scanner: Scanner, column: pa.Array) -> tuple[np.ndarray, dict[int, dict]]:
    """Words of each text, and for texts that have any, their phrase places and matches."""
    data, starts = joined(column)
    raw = LOWER[np.frombuffer(data, np.uint8)]
    begin, end, first = spans(WORD[raw], starts)
    hashes = span_hashes(raw, begin, end)
    at = np.minimum(np.searchsorted(scanner.hashes, hashes), len(scanner.hashes) - 1)
    word = np.where(scanner.hashes[at] == hashes, scanner.order[at], -1) if len(scanner.hashes) else np.full(len(hashes), -1)
    hit = np.flatnonzero(word >= 0)
    word[hit[~same_words(raw, begin[hit], end[hit], scanner.raw, scanner.begin[at[hit]], scanner.end[at[hit]])]] = -1
    known = word >= 0
    edge = np.zeros(len(word) + 1, bool)
    edge[first[first <= len(word)]] = True  # runs do not cross texts
    begins = np.flatnonzero(known & (edge[:-1] | ~np.concatenate(([False], known[:-1]))))
    if not len(begins):
        return np.diff(first), {}
    ends = np.flatnonzero(known & (edge[1:] | ~np.concatenate((known[1:], [False])))) + 1
    two = ends - begins >= scanner.shortest
    found: dict[int, dict] = {}
    owner = np.searchsorted(first, begins[two], "right") - 1
    for a, b, d in zip(begins[two].tolist(), ends[two].tolist(), owner.tolist(), strict=True):
        one = {"places": [], "matches": []}
        scanner.scan(word[a:b].tolist(), a - int(first[d]), one)
        if one["places"] or one["matches"]:
            into = found.setdefault(d, {"places": [], "matches": []})
            into["places"] += one["places"]
            into["matches"] += one["matches"]
    return np.diff(first), found


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label string, first_word long, end_word long, share double>>"


def scan(df: DataFrame, scanner: Scanner | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: word count, phrase places (n_base, first_word, last_word, base_labels), all labels,
    score (the largest covered share of a template's span, 0 without one) and the spans.

    Null and empty texts have no words and empty labels. Every place counts, also overlapping ones. Repeats stay repeats.
    """
    scanner = scanner or Scanner([*TEMPLATES, *BODIES], PHRASES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            n, found = scan_texts(scanner, b.column(1))
            rows = []
            for d in range(b.num_rows):
                got = found.get(d, {"places": [], "matches": []})
                places = [p for p, _ in got["places"]]
                base = {scanner.phrase_labels[k] for _, k in got["places"]}
                chained = scanner.chain(got["matches"])
                rows.append((len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | {s[0] for s in chained})), min(1.0, max((s[3] for s in chained), default=0.0)), [dict(zip(("label", "first_word", "end_word", "share"), s, strict=True)) for s in chained]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("share", pa.float64())]))]
            yield pa.record_batch([b.column(0), pa.array(n), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
