"""Texts that a reader sees, and kinds of stops on a drive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearby.functions.text import has

#: Stop type, place kinds, the tags that make it, and the pattern of its name; first match.
DRIVE_TYPES = (
    ("castle", ("castle",), (), ""),
    ("memorial", ("historic site", "landmark", "park"), ("historic=memorial", "historic=monument"), r"\b(memorial|monument|statue|veterans?|soldiers?|sailors|war|obelisk|cenotaph|plaque|marker|tablet|honor roll)\b"),
    ("lighthouse", ("historic site", "landmark", "lookout"), ("man_made=lighthouse", "historic=lighthouse"), r"\b(light(house)?|lights)\b"),
    ("fort", ("historic site", "landmark", "park"), ("historic=fort", "historic=battlefield"), r"\b(fort|battle(field)?|redoubt|encampment|garrison)\b"),
    ("district", ("historic site",), (), r"\bdistrict\b"),
    ("church", ("historic site", "landmark"), (), r"\b(church|chapel|meeting ?house|synagogue|cathedral|parish)\b"),
    ("building", ("historic house", "historic site"), (), ""),
    ("landmark", ("landmark",), (), ""),
    ("society", ("museum",), (), r"histor(ical|ic) (society|association)|heritage (society|association)"),
    ("kids-museum", ("museum",), (), r"\b(children'?s|kids)\b|discovery (center|museum)"),
    ("museum", ("museum",), (), ""),
    ("gallery", ("gallery",), (), ""),
    ("garden", ("garden",), (), ""),
    ("lookout", ("lookout",), (), ""),
    ("wild", ("park",), ("leisure=nature_reserve",), r"wildlife|management area|sanctuary|refuge|forest|preserve|reservation|woods"),
    ("big-park", ("park",), (), r"\b(state|national)\b"),
    ("park", ("park",), (), ""),
    ("zoo", ("zoo",), (), ""),
    ("winery", ("winery",), (), ""),
    ("brewery", ("brewery",), (), ""),
    ("farm", ("farm",), (), ""),
    ("restaurant", ("restaurant",), (), ""),
    ("cafe", ("cafe",), (), ""),
    ("theme-park", ("theme park",), (), ""),
    ("antiques", ("antique shop",), (), ""),
    ("books", ("bookshop",), (), ""),
    ("thrift", ("shop",), (), r"goodwill|thrift|salvation army|savers|consign|second.?hand|vintage"),
    ("garden-centre", ("shop",), (), r"garden (center|centre)|nursery|greenhouse"),
    ("market", ("mall",), (), ""),
    ("shop", ("shop",), (), ""),
    ("library", ("library",), (), ""),
    ("music", ("music venue",), (), ""),
    ("theatre", ("theatre",), (), ""),
    ("cinema", ("cinema",), (), ""),
    ("event", ("event",), (), ""),
)
#: Interest of each stop type, and what the type counts in it where that isn't 1.
INTERESTS = {
    "history": ("castle", "memorial", "lighthouse", "fort", "district", "church", "building", "landmark"), "museums": ("society", "kids-museum", "museum", "gallery"), "gardens": ("garden",),
    "views": ("lookout", "wild", "big-park", "park"), "animals": ("zoo",), "tasting": ("winery", "brewery", "farm"), "eating": ("restaurant", "cafe"), "thrills": ("theme-park",),
    "browsing": ("antiques", "books", "thrift", "garden-centre", "market", "shop", "library"), "shows": ("music", "theatre", "cinema"), "events": ("event",),
}
FACTORS = {"memorial": 0.6, "district": 0.5, "church": 0.7, "landmark": 0.8, "society": 0.7, "kids-museum": 0.5, "wild": 0.5, "park": 0.35, "restaurant": 0.6, "cafe": 0.5, "thrift": 0.5, "garden-centre": 0.5, "market": 0.5, "shop": 0.4, "library": 0.3, "cinema": 0.5}
LEVELS = {"love": 3.0, "some": 1.5, "skip": 0.0}
DEFAULT_LEVELS = {"history": "some", "museums": "some", "gardens": "some", "views": "some", "animals": "some", "tasting": "some", "eating": "some", "thrills": "skip", "browsing": "skip", "shows": "skip", "events": "some"}


def drive_type(kind: Column, name: Column, tag: Column, designation: Column) -> Column:
    """The stop type of a place: by its deciding tag, then its official designation, then its name; null if it is never one."""
    by_tag = [F.when(kind.isin(*ks) & tag.isin(*tags), t) for t, ks, tags, _ in DRIVE_TYPES if tags]
    by_designation = [F.when(kind.isin(*ks) & has(designation, p), t) for t, ks, _, p in DRIVE_TYPES if p]
    by_name = [F.when(kind.isin(*ks) & (has(name, p) if p else F.lit(True)), t) for t, ks, _, p in DRIVE_TYPES]
    return F.coalesce(*by_tag, *by_designation, *by_name)


def type_weights(levels: dict[str, str] = DEFAULT_LEVELS) -> dict[str, float]:
    """Stop type -> weight under a reader's levels of interest."""
    return {t: LEVELS[levels.get(i, "some")] * FACTORS.get(t, 1.0) for i, types in INTERESTS.items() for t in types}


def clock(at: Column) -> Column:
    """"7 PM", "7:30 PM"."""
    return F.regexp_replace(F.date_format(at, "h:mm a"), ":00", "")


def day_heading(day: Column, today: Column) -> Column:
    diff = F.datediff(day, today)
    return F.when(diff == 0, "Today").when(diff == 1, "Tomorrow").when(diff.between(2, 6), F.date_format(day, "EEEE")).otherwise(F.date_format(day, "EEEE, MMM d"))


def when_label(day: Column, start: Column, end: Column, ongoing: Column, underway: Column, all_day: Column, today: Column) -> Column:
    """The day and time of a listing on a card that stands alone."""
    diff = F.datediff(day, today)
    head = F.when(diff == 0, "Today").when(diff == 1, "Tomorrow").otherwise(F.date_format(day, "EEE, MMM d"))
    later = F.to_date(end) > F.to_date(start)
    tail = (
        F.when(ongoing, F.concat(F.lit("on now, through "), F.date_format(end, "MMM d"))).when(later, F.concat(clock(start), F.lit(", through "), F.date_format(end, "MMM d")))
        .when(underway, F.concat(F.lit("on now, until "), clock(end))).when(all_day, "all day").otherwise(clock(start))
    )
    return F.concat(head, F.lit(", "), tail)


def duration_label(minutes: Column) -> Column:
    h, m = F.floor(minutes / 60), F.round(minutes % 60).cast("int")
    return F.when(minutes < 60, F.concat(F.round(minutes).cast("int").cast("string"), F.lit(" min"))).when(m == 0, F.concat(h.cast("string"), F.lit(" h"))).otherwise(F.concat(h.cast("string"), F.lit(" h "), m.cast("string"), F.lit(" min")))


def facts_label(detour: Column, ahead: Column) -> Column:
    """What a stop costs and where it is, on a card: "+9 min · 3 mi"."""
    minutes = F.round(detour).cast("int")
    cost = F.when(minutes < 1, "On the way").otherwise(F.concat(F.lit("+"), minutes.cast("string"), F.lit(" min")))
    miles = F.abs(ahead)
    short = F.when(miles < 10, F.format_string("%.1f", miles)).otherwise(F.round(miles).cast("int").cast("string"))
    where = F.concat(short, F.lit(" mi"))
    return F.concat(cost, F.lit(" · "), F.when(ahead < -0.15, F.concat(where, F.lit(" back"))).when(ahead < 0.15, "beside you").otherwise(where))
