"""Ordered rules as columns: event types, audience, place kinds, cuisines, recurrence words, prices."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearby.functions import heads
from nearby.functions import vocab as V
from nearby.functions.text import has, let


def all_matches(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """Names of all rules that match, in their order. The text is read once for what rules begin with; only rules it has a beginning of are tried."""
    begun = [heads.beginnings(p) for _, p in rules]
    wanted = heads.shortest(set().union(*(b for b in begun if b)))

    def tried(t: Column, found: Column) -> Column:
        own = [None if b is None else sorted(w for w in wanted if any(x.startswith(w) for x in b)) for b in begun]
        hits = (has(t, p) if k is None else F.arrays_overlap(found, F.array(*map(F.lit, k))) & has(t, p) for k, (_, p) in zip(own, rules))
        return F.array_compact(F.array(*(F.when(hit, n) for hit, (n, _) in zip(hits, rules))))

    return let(text, lambda t: let(heads.found_beginnings(t, wanted), lambda found: tried(t, found)))


def any_match(text: Column, pattern: str) -> Column:
    """Whether a long text matches."""
    return F.size(all_matches(text, ((".", pattern),))) > 0


def first_match(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The first rule that matches, or null."""
    return F.coalesce(*(F.when(has(text, p), n) for n, p in rules))


def venue_type(venue: Column) -> Column:
    return first_match(venue, V.VENUE_TYPES)


def types_of(title: Column, description: Column, venue: Column, limit: int = 3) -> Column:
    """Up to ``limit`` types: the title's, one more from the description, else the venue's, a fixture, or other."""
    return types_from(title, all_matches(description, V.TYPES), venue, limit)


def types_from(title: Column, described: Column, venue: Column, limit: int = 3) -> Column:
    """The same of the types that the description says."""
    more = lambda own: F.slice(F.array_except(described, own), 1, 1)
    found = let(F.slice(all_matches(title, V.TYPES), 1, limit), lambda own: F.when(F.size(own) < limit, F.concat(own, more(own))).otherwise(own))
    fixture = has(title, r"^[A-Z][\w.'-]*(?:\s+[\w.&'-]+){0,4}\s+vs\.?\s+[A-Z]", False)
    implied = F.coalesce(venue_type(venue), F.when(fixture, "sporting event"), F.lit("other"))
    return let(found, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(implied)))


def type_of(title: Column, description: Column, venue: Column) -> Column:
    return F.element_at(types_of(title, description, venue), 1)


#: What a whole text is asked besides its types or categories.
OUTSIDE, INSIDE, FOOD, HINT = ((f"#{n}", p) for n, p in (("outdoor", V.OUTDOOR), ("indoor", V.INDOOR), ("food", V.FOOD_WORDS), ("hint", V.ACTIVITY_HINTS)))


def setting_in(found: Column) -> Column:
    out, inside = (F.array_contains(found, n) for n, _ in (OUTSIDE, INSIDE))
    return F.when(out & ~inside, "outdoor").when(inside & ~out, "indoor").otherwise("unknown")


def setting_of(text: Column) -> Column:
    return let(all_matches(text, (OUTSIDE, INSIDE)), setting_in)


def has_food(text: Column) -> Column:
    return any_match(text, V.FOOD_WORDS)


def activity_hint(text: Column) -> Column:
    return any_match(text, V.ACTIVITY_HINTS)


def named(found: Column) -> Column:
    """The types or categories among what a text was asked."""
    return F.filter(found, lambda n: ~n.startswith("#"))


def event_reading(title: Column, description: Column, venue: Column) -> Column:
    """struct(types, setting, food) of an event, from one reading of its description."""

    def told(found: Column) -> Column:
        return F.struct(types_from(title, named(found), venue).alias("types"), setting_in(found).alias("setting"), F.array_contains(found, FOOD[0]).alias("food"))

    return let(all_matches(description, (*V.TYPES, OUTSIDE, INSIDE, FOOD)), told)


def text_reading(text: Column) -> Column:
    """struct(hint, food, setting, categories) of a text, from one reading."""

    def told(found: Column) -> Column:
        return F.struct(F.array_contains(found, HINT[0]).alias("hint"), F.array_contains(found, FOOD[0]).alias("food"), setting_in(found).alias("setting"), categories_in(named(found)).alias("categories"))

    return let(all_matches(text, (*V.LEGACY_CATEGORIES, OUTSIDE, INSIDE, FOOD, HINT)), told)


def time_of_day(local: Column) -> Column:
    """Day until 17:00 of the local clock, night after."""
    return F.when(F.hour(local) < 17, "daytime").otherwise("nighttime")


def categories_in(found: Column) -> Column:
    return F.when(F.size(found) > 0, F.slice(found, 1, 4)).otherwise(F.array(F.lit("community")))


def categorise(text: Column) -> Column:
    """Up to four coarse categories."""
    return let(all_matches(text, V.LEGACY_CATEGORIES), categories_in)


def audience_of(text: Column, title: Column, kind: Column) -> Column:
    """seniors, adults, family or all. Prices are no ages, and scores of a fixture no seniors' age."""
    scrubbed = F.regexp_replace(text, "(?iu)" + V.PRICE_CLAUSE, " ")
    heading = F.coalesce(title, text)
    stage = kind.isin("concert", "dj", "open-mic") & ~has(heading, V.FOR_CHILDREN)
    return (
        F.when(has(scrubbed, V.SENIORS) & ~has(heading, V.FIXTURE), "seniors")
        .when(has(text, V.ADULTS_ONLY), "adults")
        .when(has(scrubbed, V.KIDS_ONLY), "family")
        .when(has(heading, V.CHILD_FOCUSED) & ~F.coalesce(stage, F.lit(False)), "family")
        .otherwise("all")
    )


def public_on_campus(title: Column) -> Column:
    """Whether someone from outside would come: no students' affair; of sports, home games."""
    home = has(title, V.HOME_GAME) & ~has(title, V.AWAY_GAME, False)
    return F.when(has(title, V.STUDENT_ONLY), False).when(has(title, V.SPORT), home).otherwise(has(title, V.CAMPUS_PUBLIC))


def is_noise(title: Column) -> Column:
    return has(title, V.NOISE) | has(title, V.SCHOOL_INTERNAL) | has(title, V.CLOSURE)


def place_kind_by_name(name: Column) -> Column:
    return first_match(name, V.NAME_RULES)


def selector(tags: Column, text: str) -> Column:
    """A tag selector as a condition: "k" is presence, "k"="v" equality, "k"~"p" a search."""
    key, op, value = re.fullmatch(r'"([^"]+)"(?:([=~])"([^"]+)")?', text).groups()
    at = tags[key]
    hit = at.isNotNull() if not op else at == value if op == "=" else at.rlike(value)
    return F.coalesce(hit, F.lit(False))


def classify_tags(tags: Column) -> Column:
    """All kinds whose selectors match, in the vocabulary's order."""
    hits = []
    for kind, selectors in V.TAG_RULES:
        if selectors:
            any_of = selector(tags, selectors[0])
            for s in selectors[1:]:
                any_of = any_of | selector(tags, s)
            hits.append(F.when(any_of, kind))
    return F.array_compact(F.array(*hits))


def cuisines(value: Column) -> Column:
    """Cuisine groups of a tag's tokens, first named first."""
    known = F.create_map(*(F.lit(x) for group, tokens in V.CUISINE_TOKENS.items() for t in tokens for x in (t, group)))
    tokens = F.split(F.lower(F.coalesce(value, F.lit(""))), "[;,]")
    return F.array_distinct(F.array_compact(F.transform(tokens, lambda t: known[F.regexp_replace(F.trim(t), " +", "_")])))


def tri_state(value: Column) -> Column:
    return F.when(F.lower(value).isin("yes", "only", "designated"), True).when(F.lower(value) == "no", False)


def diets(tags: Column) -> Column:
    """Diets that a place serves."""
    names = ("vegetarian", "vegan", "halal", "kosher", "gluten_free")
    return F.array_compact(F.array(*(F.when(tri_state(tags[f"diet:{n}"]), n) for n in names)))


WEEKDAYS = "monday|tuesday|wednesday|thursday|friday|saturday|sunday"


def cadence_of(recurrence: Column, repeats: Column) -> Column:
    """How often a stated recurrence comes round, as a word of the filter."""
    t = F.lower(recurrence)
    return (
        F.when(F.coalesce(recurrence, F.lit("")) == "", F.when(repeats, "occasional"))
        .when(t.contains("every day") | t.contains("runs most days"), "daily")
        .when(t.contains("weekday"), "weekday")
        .when(t.contains("every other week"), "fortnightly")
        .when(t.contains("of the month") | t.contains("every month") | t.contains("monthly"), "monthly")
        .when(t.rlike(f"every (other )?({WEEKDAYS})"), F.when(t.contains("every other"), "fortnightly").otherwise("weekly"))
        .when(t.rlike(rf"\b({'|'.join(d + 's?' for d in WEEKDAYS.split('|'))})\b"), "weekly")
        .when(t.contains("bookable"), "bookable")
        .otherwise("occasional")
    )


def type_aliases(types: Column) -> Column:
    """Today's names of older types, without repeats."""
    names = F.create_map(*(F.lit(x) for pair in V.TYPE_ALIASES.items() for x in pair))
    return F.array_distinct(F.transform(types, lambda t: F.coalesce(names[t], t)))


def price_known(low: Column) -> Column:
    return low.isNotNull()


def is_free(low: Column, high: Column | None = None) -> Column:
    """Stated to cost nothing; unknown is not free."""
    top = F.coalesce(high, low) if high is not None else low
    return F.coalesce((low == 0) & (top == 0), F.lit(False))


def price_label(low: Column, high: Column) -> Column:
    money = lambda c: F.concat(F.lit("$"), F.regexp_replace(F.format_string("%.2f", c), r"\.00$", ""))
    return F.when(low.isNull(), "See listing").when(is_free(low, high), "Free").when(high.isNull() | (high == low), money(low)).otherwise(F.concat(money(low), F.lit("–"), money(high)))


def price_range(offers: Column) -> Column:
    """struct(min, max) of an array of price texts; only a stated number counts."""
    numbers = F.array_compact(F.transform(offers, lambda x: F.regexp_extract(x, r"^\s*\$?(\d+(?:\.\d+)?)", 1).try_cast("double")))
    return F.when(F.size(numbers) > 0, F.struct(F.array_min(numbers).alias("min"), F.array_max(numbers).alias("max")))
