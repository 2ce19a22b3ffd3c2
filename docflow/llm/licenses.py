"""License scans with a generalised suffix automaton of licence tokens.

The words of all templates go into one suffix automaton. A text is streamed
through it and gives its matching statistics: at each word, the longest suffix
that stands in some template. Matches that cannot be continued are chained, per
template, where they follow each other in the text and in the template; the
words of the template that a chain covers, as a share of its length, decide on
the label and are the score.

Base phrases are templates too: a phrase ends wherever the match is at least as
long and the phrase is a suffix of it, which the automaton's suffix links tell.
Only stretches of words that occur in a template enter the automaton, so the
cost per text is that of hashing its words. The scan is row-local; the automaton
is a fixed few hundred states.

Defined results: null and empty texts have no words, no labels and score 0;
rows come back as often as they go in; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm import words

# Phrases whose places are counted.
BASE = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
# The wording of common licence notices.
NOTICES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software "
            "and associated documentation files the software to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the "
            "gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
            "provided that the following conditions are met"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("proprietary", "all rights reserved"),
]
MIN_COVERED = 0.75
MIN_MATCH = 3
MAX_GAP = 8


class Automaton:
    """Suffix automaton of several sequences of word numbers."""

    def __init__(self, sequences: list[list[int]], phrases: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        # Per state, where its strings end: (sequence, place after the last word).
        self.ends: list[set] = [set()]
        for number, sequence in enumerate(sequences):
            last = 0
            for place, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].add((number, place + 1))
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            self.ends[self.link[state]] |= self.ends[state]
        # Phrases that are a suffix of a state's strings, with their lengths.
        own = {}
        for number in phrases:
            state = 0
            for word in sequences[number]:
                state = self.next[state][word]
            own.setdefault(state, []).append((number, len(sequences[number])))
        self.suffixes: list[list] = [[] for _ in self.link]
        for state in sorted(range(1, len(self.link)), key=lambda s: self.length[s]):
            self.suffixes[state] = self.suffixes[self.link[state]] + own.get(state, [])

    def _new(self, length: int, steps: dict, link: int) -> int:
        self.next.append(steps)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.link) - 1

    def _split(self, state: int, word: int) -> int:
        """The target of a step, divided where it stands for longer strings too."""
        target = self.next[state][word]
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._new(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new = self._new(self.length[last] + 1, {}, 0)
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, word)
        return new

    def statistics(self, sequence: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length of the longest match that ends here) at each word."""
        state = length = 0
        for word in sequence:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            yield state, length


class Scanner:
    """Templates, their automaton, and the look-up of their words by hash."""

    def __init__(self, base: dict[str, str], notices: list[tuple[str, str]]):
        self.labels = [*base.values(), *(label for label, _ in notices)]
        self.phrases = len(base)
        texts = [t.encode() for t in [*base, *(text for _, text in notices)]]
        hashes, _, _, bounds = words.words(texts, words.NOT_ALNUM)
        self.known, numbers = np.unique(hashes, return_inverse=True)
        sequences = [numbers[s:e].tolist() for s, e in zip(bounds[:-1], bounds[1:])]
        self.sizes = [len(s) for s in sequences]
        self.automaton = Automaton(sequences, list(range(self.phrases)))

    def scan(self, group: list[bytes]) -> list[tuple]:
        """Per lower-cased text: n_words, n_base, first, last, base labels, labels, score."""
        hashes, _, _, bounds = words.words(group, words.NOT_ALNUM)
        place = np.searchsorted(self.known, hashes)
        place[place == len(self.known)] = 0
        known = self.known[place] == hashes
        # Stretches of two or more known words, none across two texts.
        border = np.zeros(len(hashes) + 1, bool)
        border[bounds] = True
        joined = known[1:] & known[:-1] & ~border[1 : len(hashes)]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], joined, [False]])))
        starts, ends = edges[0::2], edges[1::2] + 1
        texts = np.searchsorted(bounds, starts, side="right") - 1
        found: dict[int, list] = defaultdict(list)
        for text, start, end in zip(texts.tolist(), starts.tolist(), ends.tolist()):
            found[text].append((start - int(bounds[text]), place[start:end].tolist()))
        counts = np.diff(bounds).tolist()
        return [
            (counts[i], *self._text(found[i])) if i in found else (counts[i], 0, None, None, "", "", 0.0)
            for i in range(len(group))
        ]

    def _text(self, stretches: list) -> tuple:
        places, base = [], set()
        matches: dict[int, list] = defaultdict(list)
        for offset, sequence in stretches:
            before = None
            for i, (state, length) in enumerate([*self.automaton.statistics(sequence), (0, 0)]):
                # A match that the next word does not continue.
                if before and before[1] >= MIN_MATCH and length <= before[1]:
                    for number, end in self.automaton.ends[before[0]]:
                        matches[number].append((offset + i - before[1], before[1], end - before[1]))
                for number, size in self.automaton.suffixes[state]:
                    if size <= length:
                        places.append(offset + i + 1 - size)
                        base.add(self.labels[number])
                before = state, length
        labels, best = set(base), 0.0
        for number, parts in matches.items():
            covered = self._chain(sorted(parts)) / self.sizes[number]
            best = max(best, covered)
            if covered >= MIN_COVERED:
                labels.add(self.labels[number])
        if base:
            best = 1.0
        return (
            len(places),
            min(places, default=None),
            max(places, default=None),
            ",".join(sorted(base)),
            ",".join(sorted(labels)),
            min(1.0, best),
        )

    @staticmethod
    def _chain(parts: list[tuple[int, int, int]]) -> int:
        """Most template words covered by matches in order, with small gaps in the text."""
        ends: list[tuple[int, int, int]] = []  # text end, template end, covered
        best = 0
        for start, length, place in parts:
            covered = length
            for text_end, template_end, before in reversed(ends):
                if start - text_end > MAX_GAP:
                    break
                if text_end <= start and template_end <= place:
                    covered = max(covered, before + length)
            ends.append((start + length, place + length, covered))
            best = max(best, covered)
        return best


def scan(docs: DataFrame, base: dict[str, str] = BASE, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """One row per row of ``docs``: words, places of base phrases, labels and score."""

    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    @F.pandas_udf(
        "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(base, notices)
        for part in parts:
            rows = [row for _, group in words.chunks(part.tolist()) for row in scanner.scan(group)]
            out = pd.DataFrame(rows, columns=names)
            out["first_word"] = out["first_word"].astype("Int64")
            out["last_word"] = out["last_word"].astype("Int64")
            yield out

    words.small_batches(docs.sparkSession)
    # Texts alone go to Python: a null among the ids would turn them into doubles there.
    return docs.select("doc_id", run("text").alias("_found")).select("doc_id", "_found.*")
