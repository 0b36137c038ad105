"""Rules that are tried only where a text has what they begin with give what all rules tried give."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from nearby.functions import classify as C
from nearby.functions import heads
from nearby.functions import vocab as V
from nearby.functions.text import has

RULES = (*V.TYPES, *V.LEGACY_CATEGORIES, C.OUTSIDE, C.INSIDE, C.FOOD, C.HINT)
ODD = {"s": "sſS", "k": "kKK", "i": "iıİI", "o": "oOó", " ": " \n\t "}


def test_beginnings():
    assert heads.beginnings(r"\b(trivia|pub quiz|dj\b|q\s*&\s*a|c[oó]mo)\b|\bmarch(es|ing)? for") == {"trivia", "pub qui", "dj", "q&a", "q& ", "q ", "como", "cómo", "march f", "marches", "marchin"}
    assert heads.beginnings(r"(?<!\w)55\+") is None and heads.beginnings(r"\b\w*fest") is None
    assert all(heads.beginnings(p) for _, p in RULES)


def test_rules_of_texts_with_odd_letters(spark):
    rng, begun = random.Random(7), sorted(set().union(*(heads.beginnings(p) for _, p in RULES)))
    known = ["q & a", "Q&A", "meet the owls", "a new play reading", "fair trade", "fair", "make-your-own", "sign-up table", "sign\nup fair", "programa de", "presentación", "craft beer", "craft night", "jumu'ah", "5k", "every", "hike", "cash bar", "open-mic", "live\tmusic", "diy"]
    texts = [None, "", "exhibitſ", "İmprov", "muſicals", "Kayak", "i̇mprov", "_yoga yoga_", "éyoga yogaé", "playplay film."]
    for _ in range(600):
        words = [rng.choice(rng.choice((known, begun))) for _ in range(rng.randint(1, 6))]
        text = rng.choice((" ", "", ", ", "-", "\n")).join(words)
        texts.append("".join(rng.choice(ODD.get(c, c + c.upper())) if rng.random() < 0.15 else c for c in text))
    t = F.col("t")
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    plain = F.array_compact(F.array(*(F.when(has(t, p), n) for n, p in RULES)))
    rows = df.select("t", C.all_matches(t, RULES).alias("got"), plain.alias("want"), C.text_reading(t).alias("r"), C.setting_of(t).alias("setting"), C.has_food(t).alias("food"), C.activity_hint(t).alias("hint"), C.categorise(t).alias("categories")).collect()
    assert [r["t"] for r in rows if r["got"] != r["want"]] == []
    assert [r["t"] for r in rows if tuple(r["r"][n] for n in ("setting", "food", "hint", "categories")) != (r["setting"], r["food"], r["hint"], r["categories"])] == []
    assert sum(len(r["want"]) for r in rows) > 500
