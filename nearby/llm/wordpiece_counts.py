"""Token counts by a linear longest-match automaton.

The vocabulary's pieces form a trie with two roots, one for the start of a word and one for its
continuation. Every node has a failure link and the number of pieces that are popped when the link
is taken, both computed once, so a word's greedy longest-match piece count takes one pass over its
characters and no piece is built.

Words are runs of characters other than space and U+0009..U+000D. A word that can't be covered is
one unknown token. Defined results: null and empty texts have 0 words and 0 tokens; repeated rows
are counted each.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from nearby.llm.common import annotate, texts
from nearby.llm.vocab import WordCache, public_path

#: Bytes of a worker's cache.
CACHE_BYTES = 96 << 20
#: Marks the start of a word in the vocabulary file.
WORD_START = "▁"
UNKNOWN = 1 << 32


class Automaton:
    """Failure links and popped counts over ``initial`` pieces and ``continued`` pieces."""

    START, INSIDE = 0, 1

    def __init__(self, initial: Iterable[str], continued: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        final = {*()}
        for root, pieces in ((self.START, initial), (self.INSIDE, continued)):
            for piece in pieces:
                node = root
                for c in piece:
                    node = self.next[node].setdefault(c, len(self.next))
                    if node == len(self.next):
                        self.next.append({})
                final.add(node)
        self.fail: list[int | None] = [None] * len(self.next)
        self.popped = [0] * len(self.next)
        level = [(root, c, node) for root in (self.START, self.INSIDE) for c, node in self.next[root].items()]
        while level:  # by depth: links lead to shallower nodes
            for parent, c, node in level:
                if node in final:
                    self.fail[node], self.popped[node] = self.INSIDE, 1
                    continue
                at, count = self.fail[parent], self.popped[parent]
                while at is not None and c not in self.next[at]:
                    count, at = count + self.popped[at], self.fail[at]
                if at is not None:
                    self.fail[node], self.popped[node] = self.next[at][c], count
            level = [(node, c, child) for _, _, node in level for c, child in self.next[node].items()]

    def count(self, word: str) -> int:
        """Pieces of the greedy longest match; 1 + ``UNKNOWN`` if there is none."""
        nxt, fail, popped = self.next, self.fail, self.popped
        node, total = self.START, 0
        for c in word:
            while (to := nxt[node].get(c)) is None:
                total += popped[node]
                if (node := fail[node]) is None:
                    return 1 + UNKNOWN
            node = to
        while node != self.INSIDE:
            total += popped[node]
            if (node := fail[node]) is None:
                return 1 + UNKNOWN
        return total


def pieces(path: str) -> tuple[list[str], list[str]]:
    """Initial and continued pieces of a sentencepiece file; control and byte pieces are neither."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))]
    initial = [x[1:] for x in names if x.startswith(WORD_START) and WORD_START not in x[1:] and len(x) > 1]
    return initial, [x for x in names if WORD_START not in x]


@lru_cache(maxsize=2)
def worker(path: str) -> WordCache:
    automaton = Automaton(*pieces(path))
    return WordCache(lambda words: (automaton.count(w.decode("utf-8", "replace")) for w in words), CACHE_BYTES, 0)


def count_tokens(docs: DataFrame, vocabulary: str | None = None, text_col: str = "text", names: tuple[str, str, str] = ("n_words", "n_tokens", "n_unknown")) -> DataFrame:
    """``docs`` with the number of words, of tokens and of unknown words of each whole text. No shuffle."""
    vocabulary = vocabulary or public_path("piece_bpe_32k.model")

    def compute(column: pa.Array) -> list[pa.Array]:
        rows = [t.encode("utf-8", "replace").split() for t in texts(column)]
        known = worker(vocabulary).of({w for row in rows for w in row})
        sums = [int(np.fromiter(map(known.__getitem__, row), np.int64, len(row)).sum()) for row in rows]
        return [pa.array([len(r) for r in rows], pa.int64()), pa.array([s % UNKNOWN for s in sums], pa.int64()), pa.array([s // UNKNOWN for s in sums], pa.int64())]

    return annotate(docs, [text_col], [T.StructField(x, T.LongType()) for x in names], compute)
