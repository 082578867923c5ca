"""Substring dedup on words: matching statistics over suffix automata of reference shards."""

from __future__ import annotations

from itertools import groupby

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from quotelens.llm.windows import Scheme, remove_covered

WINDOW = 13
GRAM = 4


class SuffixAutomaton:
    """Suffix automaton of several word sequences, grown one sequence at a time."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, following: dict) -> int:
        self.next.append(following)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: object) -> int:
        """The part of state q that p reaches by `word` becomes a state of its own."""
        clone = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[clone], self.link[q] = self.link[q], clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list) -> None:
        last = 0
        for word in words:
            known = self.next[last].get(word)
            if known is not None:
                last = known if self.length[known] == self.length[last] + 1 else self._split(last, known, word)
                continue
            fresh = self._state(self.length[last] + 1, {})
            p = last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = fresh
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[fresh] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
            last = fresh

    def matching_statistics(self, words: list) -> list[int]:
        """Per word, the length of the longest match that ends there."""
        state, length, out = 0, 0, []
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            out.append(length)
        return out


def judge(rows: list[tuple[int, int, int, bytes]]) -> list[np.ndarray]:
    """Windows of each row that also start in a row of a smaller rank.

    Rows stream by rank: those of one rank are matched against the automaton of all smaller
    ranks, and then added to it.
    """
    automaton = SuffixAutomaton()
    words = [content.split(b" ") for *_, content in rows]
    covered: list[np.ndarray] = [np.zeros(0, bool)] * len(rows)
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    for _, same in groupby(order, key=lambda i: rows[i][0]):
        members = list(same)
        for i in members:
            covered[i] = np.array(automaton.matching_statistics(words[i])[WINDOW - 1:]) >= WINDOW
        for i in members:
            automaton.add(words[i])
    return covered


def _codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


SCHEME = Scheme(
    window=WINDOW, gram=GRAM, step=1, by_place=False, units=bytes.split, codes=_codes,
    parts=lambda words, codes: codes, piece=b" ".join,
)


def remove_shared_words(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, row_key, n_units (words), n_removed, n_spans, kept_sha256, removed.

    Words are runs of anything but ASCII white space. A word goes if a window of 13 consecutive
    words over it also starts in a document with a smaller doc_id, judged on the input. A null
    text has no words; a null id is the smallest; rows that share an id never cover each other.
    kept_sha256 is of the kept words, joined by one space. An empty table gives no rows.
    """
    return remove_covered(docs, SCHEME, judge, b" ")
