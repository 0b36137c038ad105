"""The words that patterns can begin with, so that a text is read once and only the patterns whose words it has are tried."""

from __future__ import annotations

import re
from re import _constants as K
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of a beginning.
MOST = 7
#: What equals s or i whatever its case and stays when it is lower-cased, and the dot that a lower-cased I with a dot leaves.
ODD = "\u017f\u0131"
#: Ways of a tree that are tried one by one.
WAYS = 5
#: Letters beyond ASCII that have one other case and equal nothing else, and what ``\\s`` is besides a space.
ACCENTED, GAPS = "áéíóúüñ", "\t\n\x0b\f\r"
Heads = set[tuple[str, bool]]


def letters(op, arg) -> set[str] | None:
    """The lower-case letters that one place of a pattern can be, a space for white space; None if they are many."""
    if op is K.LITERAL:
        return {chr(arg).lower()} if (arg < 128 or chr(arg) in ACCENTED) and chr(arg) not in GAPS else None
    if op is K.CATEGORY and arg is K.CATEGORY_SPACE:
        return {" "}
    if op is K.RANGE and arg[1] < 128 and arg[1] - arg[0] < 12:
        return {chr(i).lower() for i in range(arg[0], arg[1] + 1)}
    if op is K.IN and arg[0][0] is not K.NEGATE:
        each = [letters(*x) for x in arg]
        return None if None in each else set().union(*each)
    return None


def step(op, arg) -> Heads:
    """What one item of a pattern can begin with, and whether that is all of it."""
    if op in (K.AT, K.ASSERT, K.ASSERT_NOT):
        return {("", True)}
    if op is K.SUBPATTERN:
        return heads(arg[-1])
    if op is K.BRANCH:
        return set().union(*map(heads, arg[1]))
    if op in (K.MAX_REPEAT, K.MIN_REPEAT):
        low, high, what = arg
        if high == 1:
            return heads(what) | (set() if low else {("", True)})
        more = {(h, False) for h, _ in heads(what)}
        return more if low else more | {("", True)}
    one = letters(op, arg)
    return {("", False)} if one is None else {(c, True) for c in one}


def heads(items) -> Heads:
    out: Heads = {("", True)}
    for op, arg in items:
        if not any(live for _, live in out):
            break
        here = step(op, arg)
        out = {x for x in out if not x[1]} | {((h + t)[:MOST], live and len(h + t) < MOST) for h, more in out if more for t, live in here}
    return out


def beginnings(pattern: str) -> set[str] | None:
    """Lower-case texts one of which stands at a word's edge wherever the pattern matches; None if that can't be said."""

    def of(items) -> set[str] | None:
        items = list(items)
        if items and items[0] == (K.AT, K.AT_BOUNDARY):
            found = {h for h, _ in heads(items[1:])}
            return None if "" in found else found
        if len(items) == 1 and items[0][0] is K.BRANCH:
            each = [of(x) for x in items[0][1][1]]
            return None if None in each else set().union(*each)
        return None

    return of(_parser.parse(pattern))


def shortest(texts: set[str]) -> set[str]:
    """The texts that no other one begins."""
    return {x for x in texts if not any(x[:i] in texts for i in range(1, len(x)))}


def place(letter: str) -> str:
    """A letter as a lower-cased text may have it."""
    return {" ": r"\s", "s": "[s\u017f]", "i": "[i\u0131]\u0307?+"}.get(letter, re.escape(letter))


def any_of(first: list[str]) -> str:
    return "(?=[" + "".join({" ": r"\s", "s": "s\u017f", "i": "i\u0131"}.get(c, re.escape(c)) for c in first) + "])"


def tree(texts: set[str]) -> str:
    """A pattern of texts of which none begins another. Of many ways those that can't be are left out several at once."""
    if texts == {""}:
        return ""
    first = sorted({x[0] for x in texts})
    ways = {c: place(c) + tree({x[1:] for x in texts if x[0] == c}) for c in first}
    one = lambda some: "(?:" + "|".join(ways[c] for c in some) + ")"
    if len(first) <= WAYS:
        return ways[first[0]] if len(first) == 1 else one(first)
    return "(?:" + "|".join(any_of(first[i : i + WAYS]) + one(first[i : i + WAYS]) for i in range(0, len(first), WAYS)) + ")"


def found_beginnings(text: Column, wanted: set[str]) -> Column:
    """Which of the wanted texts, none of which begins another, stand at a word's edge."""
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"{any_of(sorted({w[0] for w in wanted}))}\b(?=({tree(wanted)}))"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.translate(x, ODD + GAPS + "\u0307", "si" + " " * len(GAPS))))
