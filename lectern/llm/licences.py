"""Licence scans (operator 7): matching statistics against a generalised suffix automaton of licence notices.

The automaton holds every run of words of all notices. Walking a document through it word by word gives, at each word,
the longest run ending there that some notice contains, and by the links from its state the longest one of each notice.
Long matches that a notice doesn't go on with are chained: per notice, in the order of both
the document and the notice, into spans of the notice that the document covers. A notice is found when a chain covers
enough of it. Short phrases that name a licence outright are notices, too; each of their occurrences is counted.

Words are digits, a-z (after lower-casing A-Z) and anything outside ASCII. Pairs of neighbouring words that no notice has
can't be inside a match of two words or more, so only runs of notices' pairs are walked, which is a small part of a
corpus. The automaton's size depends on the notices alone; a document is worked on by itself in linear time.

Null texts have no words. Repeated or null ids are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm._common import LOWER, WORDLIKE, pieces, prints, words
from lectern.llm.licence_texts import NOTICES, PHRASES

#: Least words of a match that is chained; most words between two matches of a chain; least share of a notice.
LEAST, GAP, COVER = 4, 12, 0.6
_FOUND = "label string, notice int, first_word long, last_word long, notice_from int, notice_to int, covered double"
_ROWS = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, spans array<struct<{_FOUND.replace(' ', ':').replace(',:', ',')}>>"


class SuffixAutomaton:
    """All runs of symbols of several sequences. ends[state]: by sequence, the ends of all its occurrences."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, list[int]]] = [{}]

    def _state(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        self.ends.append({})
        return len(self.next) - 1

    def _after(self, last: int, symbol: int) -> int:
        """The state of the sequence so far with one more symbol, made if need be."""
        known = self.next[last].get(symbol)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        if known is not None:
            return self._split(last, symbol, known)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][symbol]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, symbol, q)
        return new

    def _split(self, p: int, symbol: int, q: int) -> int:
        short = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = short
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = short
            p = self.link[p]
        return short

    def add(self, number: int, sequence: list[int]) -> list[int]:
        """Adds a sequence; returns the state after each of its symbols."""
        states, last = [], 0
        for symbol in sequence:
            last = self._after(last, symbol)
            states.append(last)
        return states

    def close(self, added: dict[int, list[int]]) -> None:
        """Fills ends once all sequences are in: a state's occurrences are those of the states it is the link of."""
        for number in added:
            last = 0
            for end, symbol in enumerate(added[number], 1):
                last = self.next[last][symbol]
                self.ends[last].setdefault(number, []).append(end)
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if (up := self.link[state]) > 0:
                for number, ends in self.ends[state].items():
                    self.ends[up].setdefault(number, []).extend(ends)

    def walk(self, symbols: list[int]) -> Iterator[tuple[int, int]]:
        """Matching statistics: after each symbol the length of the longest match that ends there, and its state."""
        state = length = 0
        for symbol in symbols:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if symbol in self.next[state]:
                state, length = self.next[state][symbol], length + 1
            yield length, state


class Notices:
    def __init__(self, notices: list[tuple[str, str]], phrases: dict[str, str]):
        self.labels = [*phrases, *(label for label, _ in notices)]
        self.base = len(phrases)
        split = [self._words(t) for t in [*phrases.values(), *(text for _, text in notices)]]
        vocabulary = sorted({w for ws in split for w in ws})
        code = {w: i + 1 for i, w in enumerate(vocabulary)}
        at = np.cumsum([0, *map(len, vocabulary)])
        names = prints(np.frombuffer(b"".join(vocabulary), np.uint8), at[:-1], at[1:])
        self.order = np.argsort(names)
        self.names = names[self.order]
        self.vocabulary = [b"", *vocabulary]
        self.sequences = [[code[w] for w in ws] for ws in split]
        self.stride = len(vocabulary) + 1
        self.pairs = np.unique([a * self.stride + b for s in self.sequences for a, b in zip(s, s[1:], strict=False)])
        self.automaton = SuffixAutomaton()
        for i, s in enumerate(self.sequences):
            self.automaton.add(i, s)
        self.automaton.close(dict(enumerate(self.sequences)))
        # the phrases that end wherever a state's longest run does: those on its path of links
        ends_at: dict[int, list[int]] = {}
        for i in range(self.base):
            state = 0
            for symbol in self.sequences[i]:
                state = self.automaton.next[state][symbol]
            ends_at.setdefault(state, []).append(i)
        self.phrases: list[list[int]] = [[] for _ in self.automaton.next]
        for state in sorted(range(1, len(self.automaton.next)), key=self.automaton.length.__getitem__):
            self.phrases[state] = [*ends_at.get(state, []), *self.phrases[self.automaton.link[state]]]
        # per state, of each notice the longest run on the path of links that it has: words at most, and its ends
        self.longest: list[dict[int, tuple[int, list[int]]]] = [{} for _ in self.automaton.next]
        for state in sorted(range(1, len(self.automaton.next)), key=self.automaton.length.__getitem__):
            if (size := self.automaton.length[state]) >= LEAST:
                self.longest[state] = self.longest[self.automaton.link[state]] | {i: (size, sorted(ends)) for i, ends in self.automaton.ends[state].items()}

    @staticmethod
    def _words(text: str) -> list[bytes]:
        low = LOWER[np.frombuffer(text.encode(), np.uint8)]
        starts, ends, _ = words(low, np.array([0, len(low)]), WORDLIKE)
        raw = low.tobytes()
        return [raw[a:b] for a, b in zip(starts, ends, strict=True)]

    def codes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The notices' codes of words, 0 for words that none has. Names of words find them; long words are compared themselves."""
        names = prints(data, starts, ends)
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        out = np.where(self.names[at] == names, self.order[at] + 1, 0)
        for i in np.flatnonzero((out > 0) & (ends - starts > 8)):  # up to eight bytes the name tells all
            if data[starts[i] : ends[i]].tobytes() != self.vocabulary[out[i]]:
                out[i] = 0
        return out

    def runs(self, codes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximal runs of words in which all neighbours are a pair that some notice has."""
        pair = codes[:-1] * self.stride + codes[1:]
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        both = np.zeros(len(codes) + 1, bool)  # word i - 1 and word i
        both[1:-1] = (self.pairs[at] == pair) & (doc[1:] == doc[:-1])
        heads = np.flatnonzero(~both[:-1] & both[1:])
        tails = np.flatnonzero(both[:-1] & ~both[1:]) + 1
        return heads, tails


@lru_cache(1)
def _default() -> Notices:
    return Notices(NOTICES, PHRASES)


def _chains(matches: list[tuple[int, int, int]], least: float = 0.0) -> list[tuple[int, int, int, int, int]]:
    """The best chains of matches (start in the document, start in the notice, words), none of which overlap in the document.

    A chain goes forward in both, with at most GAP words left out between two matches; where these overlap, only the words that
    are new in both count. Of all chains that end with a match the one that covers most is known from those that end with the
    matches before it, so that one taken early on doesn't stand in the way of a better one. Matches further back than GAP words
    can't go on and are let go. least: words that a chain must cover.

    Per chain: first and last word in the document, first and last in the notice (ends excluded), words covered.
    """
    ends: list[tuple[int, int, int, int, int]] = []  # of the best chain to each match: words covered, and where it lies
    live: list[tuple[int, int, int, int, int, int, int]] = []  # the same, and the last match's own starts
    for d, t, n in sorted(matches):
        live = [x for x in live if d - x[2] <= GAP]
        best = (n, d, d + n, t, t + n)
        for covered, d0, d1, t0, t1, from_d, from_t in live:
            if t >= from_t and d >= from_d and t + n > t1 and d + n > d1 and t - t1 <= GAP:
                more = covered + min(n, d + n - d1, t + n - t1)
                if more > best[0]:
                    best = (more, d0, d + n, t0, t + n)
        ends.append(best)
        live.append((*best, d, t))
    out: list[tuple[int, int, int, int, int]] = []
    for covered, d0, d1, t0, t1 in sorted(ends, key=lambda x: (-x[0], x[2] - x[1], x)):
        if covered < least:
            break
        if all(d1 <= a or b <= d0 for a, b, *_ in out):
            out.append((d0, d1, t0, t1, covered))
    return sorted(out)


def scan(codes: list[int], runs: list[tuple[int, int]], those: Notices) -> tuple[list[tuple[int, int]], list[dict]]:
    """Of one document: occurrences of phrases (phrase, first word), and the notices found, with their spans."""
    places: list[tuple[int, int]] = []
    matches: dict[int, list[tuple[int, int, int]]] = {}
    automaton = those.automaton
    for a, b in runs:
        walked = list(automaton.walk(codes[a:b]))
        for i, (length, state) in enumerate(walked):
            for phrase in those.phrases[state]:
                n = len(those.sequences[phrase])
                if n <= length:
                    places.append((phrase, a + i + 1 - n))
            # matches that their notice can't make longer to the right, at each place where it has them
            if length >= LEAST:
                after, follow = walked[i + 1] if i + 1 < len(walked) else (0, 0)
                for notice, (most, ends) in those.longest[state].items():
                    n = min(length, most)
                    going = those.longest[follow].get(notice) if follow else None
                    on = {e - 1 for e in going[1]} if going and min(after, going[0]) > n else ()
                    own = matches.setdefault(notice, [])
                    own += [(a + i + 1 - n, end - n, n) for end in ends if end not in on]
    found = []
    for notice, own in matches.items():
        size = len(those.sequences[notice])
        if notice >= those.base:
            for d0, d1, t0, t1, covered in _chains(own, COVER * size):
                found.append({"label": those.labels[notice], "notice": notice, "first_word": d0, "last_word": d1 - 1, "notice_from": t0, "notice_to": t1, "covered": min(1.0, covered / size)})
    for phrase, at in places:
        n = len(those.sequences[phrase])
        found.append({"label": those.labels[phrase], "notice": phrase, "first_word": at, "last_word": at + n - 1, "notice_from": 0, "notice_to": n, "covered": 1.0})
    return places, found


def _scan(batches: Iterator[pa.RecordBatch], notices: list | None, phrases: dict | None) -> Iterator[pa.RecordBatch]:
    those = _default() if notices is None else Notices(notices, phrases)
    span = pa.struct([("label", pa.string()), ("notice", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("notice_from", pa.int32()), ("notice_to", pa.int32()), ("covered", pa.float64())])
    for rows, data, at in pieces(batches):
        low = LOWER[data]
        starts, ends, first = words(low, at, WORDLIKE)
        n = len(rows)
        n_base, low_word, high_word, score = [0] * n, [None] * n, [None] * n, [0.0] * n
        base: list[list[str]] = [[] for _ in range(n)]
        labels: list[list[str]] = [[] for _ in range(n)]
        spans: list[list[dict]] = [[] for _ in range(n)]
        if len(starts) > 1:
            codes = those.codes(low, starts, ends)
            doc = np.repeat(np.arange(n), np.diff(first))
            heads, tails = those.runs(codes, doc)
            of = doc[heads] if len(heads) else heads
            for i in np.unique(of):
                here = of == i
                a, b = first[i], first[i + 1]
                places, found = scan(codes[a:b].tolist(), [(int(x - a), int(y - a)) for x, y in zip(heads[here], tails[here], strict=True)], those)
                if places:
                    at_words = [p for _, p in places]
                    n_base[i], low_word[i], high_word[i] = len(places), min(at_words), max(at_words)
                    base[i] = sorted({those.labels[p] for p, _ in places})
                if found:
                    labels[i] = sorted({f["label"] for f in found})
                    score[i] = max(f["covered"] for f in found)
                    spans[i] = sorted(found, key=lambda f: (f["first_word"], f["notice"]))
        strings = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(n_base, pa.int64()), pa.array(low_word, pa.int64()), pa.array(high_word, pa.int64()), pa.array(base, strings), pa.array(labels, strings), pa.array(score, pa.float64()), pa.array(spans, pa.list_(span))],
            names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
        )


def licences(docs: DataFrame, notices: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """Per document the phrases' places, all labels, the found notices' spans (words from 0), and the best cover as score."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(lambda b: _scan(b, notices, phrases), _ROWS)
