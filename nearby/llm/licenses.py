"""License scans by a generalised suffix automaton of licence texts.

All licence texts and the base phrases are one automaton over their words. A text streams through it word by word:
the state tells how many of the last words stand in a row in some licence (the matching statistics) and where. The
longest such stretches of ``LEAST`` words or more are anchors. For each licence the anchors, in the order of the
text, are chained where they also follow each other in the licence; going back in the licence costs ``RESTART`` words
(half the licence at most), so copies in a row become chains of their own. A chain that covers enough of its licence is a span; of spans that
overlap by half, the one with more words covered stays. Only words next to each other that are so in a licence are
streamed: nothing longer than a word can match elsewhere.

The base phrases are texts of the automaton too: a phrase ends where the state's suffixes have it.

Words are runs of ASCII letters (A-Z lowered), digits and non-ASCII characters. Defined results: a null or empty text
has no words and no places, empty labels and score 0; repeated rows are scanned each; an empty table gives no rows; the
score is 1 where a base phrase stands, else the largest share of a licence that a chain covers.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearby.llm.common import annotate, texts
from nearby.llm.licence_texts import TEMPLATES

#: Fixed by the contract of the base labels: (label, phrase).
PHRASES = (("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license"))
#: Words of an anchor at least; words of text between anchors of a chain at most; words that a step back costs at most.
LEAST, GAP, RESTART = 4, 40, 8
#: A span covers this share of its licence, and this many words of it (or all).
SHARE, WHOLE = 0.5, 12
BREAKS = bytes(b for b in range(128) if not chr(b).isalnum())
FOLD = bytes.maketrans(BREAKS + bytes(range(65, 91)), b" " * len(BREAKS) + bytes(range(97, 123)))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(FOLD).split()


class SuffixAutomaton:
    """Smallest automaton of all substrings of several sequences of numbers."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.length, self.link, ends = [0], [-1], [[]]
        for number, sequence in enumerate(sequences):
            last = 0
            for i, c in enumerate(sequence):
                last = self.extend(last, c)
                ends += [[] for _ in range(len(self.length) - len(ends))]
                ends[last].append((number, i))
        self.order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        #: Where the sequences of a state end: (sequence, place). Kept for states of long sequences, which are few places each.
        self.ends = ends
        for s in self.order:
            if self.length[self.link[s]] >= LEAST:
                ends[self.link[s]] += ends[s]

    def clone(self, state: int, length: int) -> int:
        self.next.append(dict(self.next[state]))
        self.length.append(length)
        self.link.append(self.link[state])
        return len(self.length) - 1

    def extend(self, last: int, c: int) -> int:
        """The state of ``last``'s sequences with ``c`` behind them."""
        if c in self.next[last]:
            q = self.next[last][c]
            if self.length[q] == self.length[last] + 1:
                return q
            return self.split(last, c, q)
        new = len(self.length)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        at = last
        while at >= 0 and c not in self.next[at]:
            self.next[at][c] = new
            at = self.link[at]
        if at >= 0:
            q = self.next[at][c]
            self.link[new] = q if self.length[q] == self.length[at] + 1 else self.split(at, c, q)
        return new

    def split(self, at: int, c: int, q: int) -> int:
        """A state for the shorter sequences of ``q``, those that ``at`` leads to."""
        half = self.clone(q, self.length[at] + 1)
        self.link[q] = half
        while at >= 0 and self.next[at].get(c) == q:
            self.next[at][c] = half
            at = self.link[at]
        return half

    def step(self, state: int, length: int, c: int) -> tuple[int, int]:
        """State and matched words after one more word."""
        while state and c not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        to = self.next[state].get(c)
        return (0, 0) if to is None else (to, length + 1)


@dataclass(frozen=True)
class Span:
    """Words ``first`` to ``last`` of a text that cover ``covered`` words of a licence's text, ``share`` of it."""

    label: str
    template: int
    first: int
    last: int
    covered: int
    share: float


class Scanner:
    """The automaton of licence texts and phrases, and what is read from it."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES):
        self.labels = [label for label, _ in templates]
        self.phrases = [(label, words_of(p)) for label, p in phrases]
        licences = [words_of(t) for _, t in templates]
        self.sizes = [len(w) for w in licences]
        whole = licences + [p for _, p in self.phrases]
        self.ids = {w: i for i, w in enumerate(dict.fromkeys(w for ws in whole for w in ws))}
        numbers = [[self.ids[w] for w in ws] for ws in whole]
        self.automaton = a = SuffixAutomaton(numbers)
        self.pair = np.zeros((len(self.ids) + 1, len(self.ids) + 1), bool)  # the last stands for unknown words
        for ws in numbers:
            self.pair[ws[:-1], ws[1:]] = True
        #: Phrases that end in a state: (words, phrase).
        self.phrase_ends: list[tuple[tuple[int, int], ...]] = [()] * len(a.length)
        for k, ws in enumerate(numbers[len(licences) :]):
            state = 0
            for c in ws:
                state = a.next[state][c]
            self.phrase_ends[state] += ((len(ws), k),)
        for s in reversed(a.order):
            self.phrase_ends[s] += self.phrase_ends[a.link[s]]
        #: Where licences have a state's words: (licence, place of the last word).
        self.places = [tuple((t, i) for t, i in e if t < len(licences)) for e in a.ends]

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Words, base places (first word, phrase), and anchors (last word, words, state) of a text."""
        words = words_of(text)
        n, base, anchors = len(words), [], []
        if n < 2:
            return n, base, anchors
        unknown = len(self.ids)
        get = self.ids.get
        numbers = np.fromiter((get(w, unknown) for w in words), np.int64, n)
        at = np.flatnonzero(self.pair[numbers[:-1], numbers[1:]])
        if not len(at):
            return n, base, anchors
        breaks = np.flatnonzero(np.diff(at) > 1)
        step, phrase_ends = self.automaton.step, self.phrase_ends
        for i, j in zip(at[np.concatenate([[0], breaks + 1])].tolist(), (at[np.concatenate([breaks, [len(at) - 1]])] + 1).tolist()):
            state = length = 0
            for k, c in enumerate(numbers[i : j + 1].tolist(), i):
                before = state, length
                state, length = step(state, length, c)
                if before[1] >= LEAST and length <= before[1]:
                    anchors.append((k - 1, before[1], before[0]))
                for size, phrase in phrase_ends[state]:
                    if length >= size:
                        base.append((k - size + 1, phrase))
            if length >= LEAST:
                anchors.append((j, length, state))
        return n, base, anchors

    def chains(self, anchors: list[tuple[int, int, int]]) -> list[Span]:
        """All chains of anchors, licence by licence. An anchor loses the words that the licence's anchor before has."""
        by_template: dict[int, list[tuple[int, int, list[int]]]] = {}
        for last, length, state in anchors:
            found: dict[int, list[int]] = {}
            for t, place in self.places[state]:
                found.setdefault(t, []).append(place)
            for t, places in found.items():
                own = by_template.setdefault(t, [])
                own.append((last, min(length, last - own[-1][0]) if own else length, places))
        out = []
        for t, own in by_template.items():
            near: list[tuple[int, int, list[int]]] = []
            for anchor in own:
                if near and anchor[0] - anchor[1] - near[-1][0] > GAP:
                    out += self.chained(t, near)
                    near = []
                near.append(anchor)
            out += self.chained(t, near)
        return out

    def chained(self, t: int, anchors: list[tuple[int, int, list[int]]]) -> list[Span]:
        """The chains of the way through the anchors that covers most words, steps back paid for."""
        best: list[tuple[int, int, int, int, int, bool]] = []  # value, first and last word, words, the one before, goes on
        tops, values = [], []  # ends in the licence, rising, and the places in ``best`` of ever larger values
        high, cost = -1, min(RESTART, self.sizes[t] // 2)  # of the largest value so far; of a step back
        for last, length, places in anchors:
            fresh_ones = []
            for place in places:
                k = bisect_right(tops, place - length) - 1
                options = [(0, -1, False)]
                if k >= 0:
                    options.append((best[values[k]][0], values[k], True))
                if high >= 0:
                    options.append((best[high][0] - cost, high, False))
                value, before, on = max(options, key=lambda o: (o[0], o[2]))
                best.append((value + length, last - length + 1, last, length, before, on))
                fresh_ones.append((place, len(best) - 1))
            for place, i in fresh_ones:
                if high < 0 or best[i][0] > best[high][0]:
                    high = i
                k = bisect_right(tops, place)
                if k and best[values[k - 1]][0] >= best[i][0]:
                    continue
                if k and tops[k - 1] == place:
                    k -= 1
                stop = k
                while stop < len(tops) and best[values[stop]][0] <= best[i][0]:
                    stop += 1
                tops[k:stop], values[k:stop] = [place], [i]
        out, i = [], high
        while i >= 0:
            _, first, last, covered, before, on = best[i]
            end = last
            while on:
                _, first, _, words, before, on = best[before]
                covered += words
            out.append(Span(self.labels[t], t, first, end, covered, covered / self.sizes[t]))
            i = before
        return out

    def spans(self, chains: list[Span]) -> list[Span]:
        """The chains that cover enough of their licences; of two that overlap by half of one, that with more words."""
        enough = [s for s in chains if s.covered >= max(SHARE * self.sizes[s.template], min(WHOLE, self.sizes[s.template]))]
        kept: list[Span] = []  # by first word
        longest = max((s.last - s.first for s in enough), default=0)
        for s in sorted(enough, key=lambda s: (-s.covered, -s.share, s.first, s.template)):
            beside = kept[bisect_left(kept, s.first - longest, key=lambda x: x.first) : bisect_right(kept, s.last, key=lambda x: x.first)]
            if all(2 * (min(s.last, x.last) - max(s.first, x.first) + 1) <= s.last - s.first + 1 for x in beside):
                kept.insert(bisect_right(kept, s.first, key=lambda x: x.first), s)
        return kept


@lru_cache(maxsize=4)
def scanner(templates: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(templates, phrases)


SPAN = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("covered", T.LongType()), T.StructField("share", T.DoubleType())]))
PLACE = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("word", T.LongType())]))


def scan(docs: DataFrame, text_col: str = "text", names: tuple[str, str, str, str] = ("n_words", "phrases", "spans", "coverage"), templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES) -> DataFrame:
    """``docs`` with the number of words, the places of base phrases, the covered licence spans and the score. No shuffle."""

    def compute(column: pa.Array) -> list[pa.Array]:
        s = scanner(templates, phrases)
        counts, base, spans, scores = [], [], [], []
        for text in texts(column):
            n, places, anchors = s.scan(text)
            chains = s.chains(anchors) if anchors else []
            counts.append(n)
            base.append([{"label": s.phrases[k][0], "word": i} for i, k in places])
            spans.append([{"label": x.label, "first_word": x.first, "last_word": x.last, "covered": x.covered, "share": x.share} for x in s.spans(chains)])
            scores.append(1.0 if places else max((x.share for x in chains), default=0.0))
        kinds = [pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())])), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())]))]
        return [pa.array(counts, pa.int64()), pa.array(base, kinds[0]), pa.array(spans, kinds[1]), pa.array(scores, pa.float64())]

    return annotate(docs, [text_col], [T.StructField(n, k) for n, k in zip(names, (T.LongType(), PLACE, SPAN, T.DoubleType()))], compute)


def label_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """The digest of a scan for each row of ``docs``: base places, labels and score."""
    found = scan(docs.select("doc_id", "text"), templates=templates).drop("text")
    base, spans = F.col("phrases"), F.col("spans")
    joined = lambda *parts: F.array_join(F.array_sort(F.array_distinct(F.concat(*(p["label"] for p in parts)))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(base["word"]).alias("first_word"), F.array_max(base["word"]).alias("last_word"),
        joined(base).alias("base_labels"), joined(base, spans).alias("labels"), F.col("coverage").alias("score"), F.size(spans).cast("long").alias("n_spans"),
    )
