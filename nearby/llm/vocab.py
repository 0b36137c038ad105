"""Readers of public vocabulary files, and the cache of encoded words that tasks share."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from pathlib import Path

#: White space by the Unicode property, which is what the tokenizers mean by \\s.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def public_path(name: str) -> str:
    """Where the installed package of public vocabularies keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read_json(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


class WordCache:
    """Word -> encoded form. Keeps entries of about ``most`` bytes in all (frequent words come early); words
    beyond that are encoded again in each batch, so that memory is bounded. ``unit``: bytes of an item of a form, 0 for numbers."""

    #: Bytes of an entry besides its letters and items, about.
    ENTRY = 170

    def __init__(self, encode: Callable[[list], Iterable], most: int, unit: int):
        self.encode, self.left, self.unit, self.known = encode, most, unit, {}

    def of(self, words: set) -> dict:
        """A mapping that has at least ``words``."""
        missing = [w for w in words if w not in self.known]
        if not missing:
            return self.known
        made = dict(zip(missing, self.encode(missing)))
        if self.left > 0:
            self.left -= self.ENTRY * len(made) + sum(map(len, made)) + (self.unit * sum(map(len, filter(None, made.values()))) if self.unit else 0)
            self.known.update(made)
            return self.known
        return {w: made[w] if w in made else self.known[w] for w in words}

    def in_order(self, words: list) -> list:
        """The forms of distinct words, one for each."""
        out = list(map(self.known.get, words))
        at = [i for i, form in enumerate(out) if form is None]
        if at:
            missing = [words[i] for i in at]
            made = list(self.encode(missing))
            for i, form in zip(at, made):
                out[i] = form
            if self.left > 0:
                self.left -= self.ENTRY * len(made) + sum(map(len, missing)) + (self.unit * sum(map(len, filter(None, made))) if self.unit else 0)
                self.known.update(zip(missing, made))
        return out
