"""JSON records of known services to candidate rows.

Each shape takes records (source_id, payload) and gives source_id, uid, title, start_at (instant), end_at, all_day, url,
venue, city, address, lat, lon, price_min, price_max, types, description, recurrence. What a service doesn't
state is null; records without a title or a start give no row. Payloads that aren't JSON give no row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearby.functions.text import clean_text, squeeze, unescape
from nearby.operators.recur import join_and

ZONE = "America/New_York"
COLUMNS = {
    "uid": "string", "title": "string", "start_at": "timestamp", "end_at": "timestamp", "all_day": "boolean", "url": "string", "venue": "string", "city": "string", "address": "string", "lat": "double",
    "lon": "double", "price_min": "double", "price_max": "double", "types": "array<string>", "description": "string", "recurrence": "string",
}
#: A ticket platform's classes and the types they are.
SEGMENTS = {"Music": "concert", "Sports": "sporting event", "Arts & Theatre": "play", "Film": "film"}
GENRES = {
    "Comedy": "comedy show", "Theatre": "play", "Dance": "dance", "Musical": "musical", "Opera": "musical", "Classical": "concert", "Film": "film", "Fairs & Festivals": "festival",
    "Art": "art exhibit", "Museum": "museum exhibit", "Food & Drink": "tasting", "Community/Civic": "club", "Lecture": "talk", "Circus & Specialty Acts": "celebration",
}
REACHABLE = ("NY", "CT", "MA", "NJ", "PA", "VT", "NH", "RI", "ME")


def at(v: str | Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def items(records: DataFrame, *paths: str) -> DataFrame:
    """(source_id, v): the objects of the first of the payload's arrays that is there and isn't empty."""
    *others, last = (at("p", p, "array<variant>") for p in paths)
    lists = [*(F.when(F.size(x) > 0, x) for x in others), last]
    parsed = records.select("source_id", F.explode(F.array(F.try_parse_json("payload"))).alias("p"))  # exploded, it is parsed once whatever is asked of it
    return parsed.select("source_id", F.explode(F.coalesce(*lists)).alias("v"))


def rows(df: DataFrame, **cols: Column) -> DataFrame:
    """The columns of a shape, null where it has none. Title and start are made once for each record, before others are made."""
    made = {n: cols.get(n, F.lit(None)).cast(t).alias(n) for n, t in COLUMNS.items()}
    needed = F.explode(F.array(F.struct(made["title"], made["start_at"]))).alias("_needed")
    kept = df.select("*", needed).where("_needed.title is not null and _needed.title <> '' and _needed.start_at is not null")
    return kept.select("source_id", *(F.col(f"_needed.{n}") if n in ("title", "start_at") else c for n, c in made.items()))


def local(text: Column, zone: Column | str = ZONE, *formats: str) -> Column:
    """An instant of a wall clock in a zone."""
    wall = F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats or ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd")))
    return F.to_utc_timestamp(wall, zone)


def instant(text: Column, zone: Column | str = ZONE) -> Column:
    """An instant of a text with an offset, else of a wall clock."""
    return F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(text)).otherwise(local(text, zone))


def joined(*parts: Column) -> Column:
    return F.nullif(F.concat_ws(", ", *(F.nullif(p, F.lit("")) for p in parts)), F.lit(""))


def collection(records: DataFrame) -> DataFrame:
    """Site-builder collections: epoch milliseconds, upcoming items else all."""
    v = "v"
    when = lambda p: F.timestamp_millis((F.floor(at(v, p, "double") / 1000) * 1000).cast("long"))
    return rows(items(records, "$.upcoming", "$.items"), uid=at(v, "$.id"), title=at(v, "$.title"), start_at=when("$.startDate"), end_at=when("$.endDate"), all_day=F.lit(False), url=at(v, "$.fullUrl"), address=at(v, "$.location.addressLine1"), description=clean_text(F.coalesce(at(v, "$.excerpt"), at(v, "$.body"))))


def calendar_plugin(records: DataFrame, horizon: Column | None = None) -> DataFrame:
    """Calendar-plugin rows: overlapping pages repeat rows, told apart by post, event and date."""
    v, start = "v", at("v", "$.start")
    uid = F.concat_ws("-", F.lit("wpfc"), at(v, "$.post_id"), at(v, "$.event_id"), F.substring(start, 1, 10))
    out = rows(items(records, "$"), uid=uid, title=unescape(F.trim(at(v, "$.title"))), start_at=local(start), end_at=local(at(v, "$.end")), all_day=at(v, "$.allDay", "boolean"), url=at(v, "$.url"))
    out = out if horizon is None else out.where(F.to_date("start_at") <= horizon)
    return out.dropDuplicates(["source_id", "uid"])


def events_rest(records: DataFrame) -> DataFrame:
    """Events-calendar REST pages: own zone, venue in parts."""
    v = "v"
    zone = F.coalesce(F.when(at(v, "$.timezone").rlike(r"^[A-Za-z]+/[A-Za-z_/]+$"), at(v, "$.timezone")), F.lit(ZONE))
    hall = at(v, "$.venue", "struct<venue string,address string,city string,stateprovince string,state string>")  # read once; a path that isn't there costs Spark an exception
    place = joined(hall["venue"], hall["address"], hall["city"], F.coalesce(hall["stateprovince"], hall["state"]))
    return rows(items(records, "$.events"), uid=F.concat(F.lit("tribe-"), at(v, "$.id")), title=unescape(F.trim(at(v, "$.title"))), start_at=local(at(v, "$.start_date"), zone), end_at=local(at(v, "$.end_date"), zone), all_day=at(v, "$.all_day", "boolean"), url=at(v, "$.url"), venue=hall["venue"], city=hall["city"], address=place, description=clean_text(F.coalesce(at(v, "$.description"), at(v, "$.excerpt"))))


def ticketing(records: DataFrame) -> DataFrame:
    """Ticket-platform events: types from the finest class up, 0 to 0 is no stated price, states out of reach go."""
    v = "v"
    table = lambda m: F.create_map(*(F.lit(x) for pair in m.items() for x in pair))
    classes = F.coalesce(at(v, "$.classifications", "array<variant>"), F.array().cast("array<variant>"))
    named = F.flatten(F.transform(classes, lambda c: F.array(table(GENRES)[at(c, "$.subGenre.name")], table(GENRES)[at(c, "$.genre.name")], table(SEGMENTS)[at(c, "$.segment.name")])))
    types = F.slice(F.array_distinct(F.array_compact(named)), 1, 3)
    ranges = F.coalesce(at(v, "$.priceRanges", "array<variant>"), F.array().cast("array<variant>"))
    low, high = F.array_min(F.transform(ranges, lambda r: at(r, "$.min", "double"))), F.array_max(F.transform(ranges, lambda r: at(r, "$.max", "double")))
    stated = ~((low == 0) & (high == 0))
    venue = lambda p, k="string": at(v, f"$._embedded.venues[0].{p}", k)
    state = F.upper(venue("state.stateCode"))
    out = items(records, "$._embedded.events").where(state.isNull() | state.isin(*REACHABLE))
    return rows(out, uid=at(v, "$.id"), title=at(v, "$.name"), start_at=instant(at(v, "$.dates.start.dateTime")), all_day=F.lit(False), url=at(v, "$.url"), venue=venue("name"), city=joined(venue("city.name"), venue("state.stateCode")), address=venue("address.line1"), lat=venue("location.latitude", "double"), lon=venue("location.longitude", "double"), price_min=F.when(stated, F.round(low, 2)), price_max=F.when(stated, F.round(high, 2)), types=F.when(F.size(types) > 0, types), description=F.coalesce(at(v, "$.info"), at(v, "$.pleaseNote")))


def rsvp(records: DataFrame) -> DataFrame:
    """Ticketing and RSVP events: wall clock in a stated zone; more than three sessions are bookable."""
    v = "v"
    zone = F.coalesce(F.when(at(v, "$.timezone").rlike(r"^[A-Za-z]+/[A-Za-z_/]+$"), at(v, "$.timezone")), F.lit(ZONE))
    when = lambda n: local(F.concat_ws("T", at(v, f"$.{n}_date"), at(v, f"$.{n}_time")), zone)
    n, free = F.coalesce(at(v, "$.num_children", "int"), F.lit(0)), at(v, "$.ticket_availability.is_free", "boolean")
    low = at(v, "$.ticket_availability.minimum_ticket_price.major_value", "double")
    high = F.coalesce(at(v, "$.ticket_availability.maximum_ticket_price.major_value", "double"), low)
    said = F.when(n > 60, "Bookable — runs most days").when(n > 3, F.concat(F.lit("Bookable — "), n.cast("string"), F.lit(" upcoming dates")))
    price = lambda p: F.when(free, 0.0).when(~free, p)
    place = lambda p, k="string": at(v, f"$.primary_venue.address.{p}", k)
    return rows(items(records, "$.events", "$.events.results"), uid=at(v, "$.id"), title=at(v, "$.name"), start_at=when("start"), end_at=when("end"), all_day=at(v, "$.start_time").isNull(), url=at(v, "$.url"), venue=at(v, "$.primary_venue.name"), city=joined(place("city"), place("region")), address=place("address_1"), lat=place("latitude", "double"), lon=place("longitude", "double"), price_min=price(low), price_max=price(high), description=at(v, "$.summary"), recurrence=said)


def groups(records: DataFrame) -> DataFrame:
    """Group-meeting caches: nodes by key, linked by references. A link is looked up in its own record's nodes."""
    m = records.select("source_id", F.try_variant_get(F.try_parse_json("payload"), "$", "map<string,variant>").alias("m")).where("m is not null")
    linked = lambda e, n: F.try_element_at("m", at(e["value"], f"$.{n}.__ref"))
    events = F.filter(F.map_entries("m"), lambda e: e["key"].startswith("Event:"))
    nodes = F.transform(events, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("v"), linked(e, "venue").alias("venue"), linked(e, "series").alias("series")))
    e, v = m.select("source_id", F.explode(nodes).alias("e")).select("source_id", "e.*"), "v"
    week = F.create_map(*(F.lit(x) for pair in {1: "first", 2: "second", 3: "third", 4: "fourth", 5: "last", -1: "last"}.items() for x in pair))[at("series", "$.monthlyRecurrence.monthlyWeekOfMonth", "int")]
    day = F.initcap(at("series", "$.monthlyRecurrence.monthlyDayOfWeek"))
    days = F.transform(at("series", "$.weeklyRecurrence.weeklyDaysOfWeek", "array<string>"), lambda d: F.initcap(d))
    every = F.when(F.coalesce(at("series", "$.weeklyRecurrence.weeklyInterval", "int"), F.lit(1)) == 1, "Every ").otherwise("Every other ")
    said = F.when(day.isNotNull() & week.isNotNull(), F.concat(F.lit("Every "), week, F.lit(" "), day, F.lit(" of the month"))).when(day.isNotNull(), F.concat(F.lit("Every month on a "), day)).when(F.size(days) > 0, F.concat(every, join_and(days))).otherwise(F.nullif(F.trim(at("series", "$.description")), F.lit("")))
    where = F.coalesce(at("venue", "$.name"), F.when(at(v, "$.eventType") == "ONLINE", "Online"))
    return rows(e, uid=F.col("key"), title=at(v, "$.title"), start_at=instant(at(v, "$.dateTime")), end_at=instant(at(v, "$.endTime")), all_day=F.lit(False), url=at(v, "$.eventUrl"), venue=where, city=joined(at("venue", "$.city"), at("venue", "$.state")), address=at("venue", "$.address"), lat=at("venue", "$.lat", "double"), lon=F.coalesce(at("venue", "$.lng", "double"), at("venue", "$.lon", "double")), description=at(v, "$.description"), recurrence=said)


def library(records: DataFrame) -> DataFrame:
    """Library day lists ({day, publisher, town, events}): a clock on the asked day, always free, rooms in the address."""
    p = records.select("source_id", F.try_parse_json("payload").alias("p"))
    e = p.select("source_id", at("p", "$.day").alias("day"), at("p", "$.publisher").alias("publisher"), at("p", "$.town").alias("town"), F.explode(at("p", "$.events", "array<variant>")).alias("v"))
    clock = F.lower(F.regexp_replace(F.coalesce(at("v", "$.start"), F.lit("")), " ", ""))
    h, m, half = (F.regexp_extract(clock, r"^(\d{1,2})(?::(\d{2}))?([ap]m)?$", i) for i in (1, 2, 3))
    timed = clock.rlike(r"^(\d{1,2}(:\d{2})?[ap]m|\d{1,2}:\d{2})$")
    hour = F.when(half == "", h.try_cast("int")).otherwise(h.try_cast("int") % 12 + F.when(half == "pm", 12).otherwise(0))
    start = F.concat(F.col("day"), F.lit("T"), F.when(timed, F.format_string("%02d:%02d:00", hour, F.coalesce(m.try_cast("int"), F.lit(0)))).otherwise("00:00:00"))
    room = F.trim(at("v", "$.location"))
    return rows(e, uid=at("v", "$.id"), title=at("v", "$.title"), start_at=local(start), all_day=~timed, url=at("v", "$.url"), venue=F.col("publisher"), city=F.col("town"), address=joined(room, F.col("publisher"), F.col("town")), price_min=F.lit(0.0), price_max=F.lit(0.0), description=at("v", "$.description"))


def concerts(records: DataFrame) -> DataFrame:
    """Concert listings as structured data: a link, a point and a timed start are needed."""
    v = "v"
    e = items(records, "$").where(at(v, "$['@type']").contains("Event") & at(v, "$.url").isNotNull() & at(v, "$.location.geo.latitude").isNotNull() & at(v, "$.location.geo.longitude").isNotNull() & at(v, "$.startDate").contains("T"))
    return rows(e, uid=at(v, "$.url"), title=at(v, "$.name"), start_at=instant(at(v, "$.startDate")), all_day=F.lit(False), url=at(v, "$.url"), venue=at(v, "$.location.name"), city=joined(at(v, "$.location.address.addressLocality"), at(v, "$.location.address.addressRegion")), address=at(v, "$.location.address.streetAddress"), lat=at(v, "$.location.geo.latitude", "double"), lon=at(v, "$.location.geo.longitude", "double"), types=F.array(F.lit("concert")))


SHAPES: dict[str, Callable[[DataFrame], DataFrame]] = {"collection": collection, "calendar plugin": calendar_plugin, "events rest": events_rest, "ticketing": ticketing, "rsvp": rsvp, "groups": groups, "library": library, "concerts": concerts}


def shape(records: DataFrame, kind: str) -> DataFrame:
    return SHAPES[kind](records)


def first_seen(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row of each key, the first in ``order``; rows without a key stay."""
    from nearby.operators.resolve import first_by

    return first_by(df.where(F.col(key).isNotNull()), [key], *order).unionByName(df.where(F.col(key).isNull()))


def union_tiers(*tiers: DataFrame) -> DataFrame:
    """All tiers' rows, missing columns null."""
    out = tiers[0]
    for t in tiers[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


# Showtimes

ITEM = r"(?s)<li class=['\"][^'\"]*schedule-item[^'\"]*['\"]>(.*?)</li>"
HEADER = r"(?i)^\s*(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?(?:\s+(?:thru|through|-)\s+[a-z]+\.?)?\s+(\d{1,2})/(\d{1,2})(?:\s*-\s*(\d{1,2})/(\d{1,2}))?"
TIMES = r"(?i)^([a-z&/.\s]*?)\s*((?:\d{1,2}:\d{2}\s*)+)$"
#: Days of the week (0 is Monday) of the qualifiers of showtimes that are known; none for every day. Others are no guess of ours.
QUALIFIED = {"": (), "daily": (), "sat & sun": (5, 6), "sat and sun": (5, 6), "sat/sun": (5, 6)}


def schedule_items(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, title, url, starts): screenings of pages that list items with a title and stated times."""
    b = pages.select(key, F.explode(F.regexp_extract_all("html", F.lit(ITEM), F.lit(1))).alias("b"))
    head = lambda i: F.regexp_extract("b", r"(?s)<h3[^>]*>\s*<a href=\"([^\"]+)\">(.*?)</a>", i)
    t = b.select(key, squeeze(unescape(F.regexp_replace(head(2), "<[^>]+>", ""))).alias("title"), head(1).alias("url"), F.explode(F.regexp_extract_all("b", F.lit("data-showtime=['\"]([^'\"]+)['\"]"), F.lit(1))).alias("at"))
    return t.select(key, "title", "url", instant(F.col("at")).alias("starts")).where("title <> '' and starts is not null")


#: Fixed patterns of a month's grid: a day with what follows to the next; a card, whole in an attribute whose own quotes are escaped; what a card holds.
GRID_DAY = r'(?s)id="calendar-day-(\d{4}-\d{2}-\d{2})"(.*?)(?=id="calendar-day-|<div class="calendar-footer|\z)'
CARD, CARD_TITLE = r'data-show-card="([^"]*)"', r"(?s)<h2>(.*?)</h2>"
CARD_LINK, CARD_NOTE = r'href="(https://[^"/]+/movies/[^"]+)"', r'(?s)<span class="show__subtitle"><p>(.*?)</p>'
CARD_TIME = r'class="showtime(?: [^"]*)?">\s*([0-9]{1,2}:[0-9]{2}\s*[apAP]\.?[mM])\s*<'


def month_grid(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, day, title, url, note, starts): screenings of pages that are a grid of a month's days.

    A day holds cards, each an attribute with a page of its own inside, its quotes and brackets escaped. So the grid is cut into
    days and attributes first, and a card is unescaped only once it stands alone; unescaped sooner, its quotes would end
    the attribute. A card needs a title and a film's address; each of its times is a screening.
    """
    groups = lambda i: F.regexp_extract_all("html", F.lit(GRID_DAY), F.lit(i))
    days = pages.select(key, F.explode(F.arrays_zip(groups(1).alias("day"), groups(2).alias("body"))).alias("d"))
    cards = days.select(key, F.col("d.day").alias("day"), F.explode(F.regexp_extract_all("d.body", F.lit(CARD), F.lit(1))).alias("raw")).withColumn("card", unescape(F.col("raw")))
    plain = lambda p: squeeze(unescape(F.regexp_replace(F.regexp_extract("card", p, 1), "<[^>]+>", "")))
    shows = cards.select(key, "day", plain(CARD_TITLE).alias("title"), F.regexp_extract("card", CARD_LINK, 1).alias("url"), F.nullif(plain(CARD_NOTE), F.lit("")).alias("note"), F.explode(F.regexp_extract_all("card", F.lit(CARD_TIME), F.lit(1))).alias("clock"))
    clock = F.upper(F.regexp_replace("clock", r"[.\s]", ""))
    at = F.try_to_timestamp(F.concat_ws(" ", "day", clock), F.lit("yyyy-MM-dd h:mma")).cast("timestamp_ntz")
    return shows.where("title <> '' and url <> ''").select(key, "day", "title", "url", "note", at.alias("starts")).where("starts is not null")


def near_year(month: Column, day: Column, as_of: Column) -> Column:
    """A bare month and day in the year that brings it nearest ahead (120 days back to 245 on)."""
    options = [F.try_make_timestamp(F.year(as_of) + k, month, day, F.lit(0), F.lit(0), F.lit(0.0)).cast("date") for k in (0, 1, -1)]
    return F.coalesce(*(F.when(F.datediff(d, as_of).between(-120, 245), d) for d in options))


def headed_screenings(pages: DataFrame, as_of: Column, key: str = "page_id") -> DataFrame:
    """(key, title, day, clocks): screenings of pages whose lines are a range of days, titles, and times under them.

    Headers and titles are carried forward over a page's lines; the times of a film and day are united. Clocks are afternoon
    times; ten and eleven o'clock say neither and are left out.
    """
    from pyspark.sql import Window

    body = F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    lines = F.filter(F.transform(F.split(unescape(F.regexp_replace(body, r"(?s)<[^>]+>", "\n")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    x = pages.select(key, F.posexplode(lines).alias("pos", "line"))
    part = lambda p, i: F.regexp_extract("line", p, i)
    is_head, is_times = F.col("line").rlike(HEADER), F.col("line").rlike(TIMES)
    num = lambda i: part(HEADER, i).try_cast("int")
    d0 = near_year(num(1), num(2), as_of)
    d1 = F.when(num(3).isNotNull(), near_year(num(3), num(4), as_of)).otherwise(d0)
    soon = F.lower("line").startswith("coming soon")
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("span", F.last(F.when(is_head | soon, F.struct(F.when(is_head, d0).alias("a"), F.when(is_head, d1).alias("b"))), ignorenulls=True).over(w))
    x = x.withColumn("title", F.last(F.when(~is_head & ~is_times, F.col("line")), ignorenulls=True).over(w)).where(is_times & F.col("span.a").isNotNull() & (F.col("span.b") >= F.col("span.a")) & F.col("title").isNotNull())
    q = squeeze(F.lower(part(TIMES, 1)))
    days = F.explode(F.sequence("span.a", "span.b"))
    x = x.select(key, "title", q.alias("q"), part(TIMES, 2).alias("times"), days.alias("day"))
    ok = F.lit(False)
    for name, wanted in QUALIFIED.items():
        ok = ok | (F.col("q") == name) & (F.weekday("day").isin(*wanted) if wanted else F.lit(True))
    x = x.where(ok).select(key, "title", "day", F.explode(F.regexp_extract_all("times", F.lit(r"\d{1,2}:\d{2}"), F.lit(0))).alias("c"))
    hour = F.substring_index("c", ":", 1).cast("int")
    clock = F.format_string("%02d:%s", F.when(hour == 12, hour).otherwise(hour + 12), F.substring_index("c", ":", -1))
    x = x.where(~hour.isin(10, 11)).select(key, "title", "day", clock.alias("c")).distinct()
    return x.groupBy(key, "title", "day").agg(F.array_join(F.sort_array(F.collect_list("c")), ",").alias("clocks"))
