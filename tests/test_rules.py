"""Cases of the rule columns, and edges of the joins."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from nearby.functions import classify as C
from nearby.functions import text as X
from nearby.functions import labels as L
from nearby.functions import vocab as V
from nearby.operators import audit, hours, places, quality, recur, resolve, search, spatial, web
from nearby.sources import sinks


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def s(x):
    return F.lit(x).cast("string")


@pytest.mark.parametrize("title,description,venue,want", [
    ("Pub Trivia Night", None, None, ["trivia"]), ("180th County Fair", "grandstand concert nightly", None, ["festival", "concert"]), ("Untitled", None, "Bowdoin Music Hall", ["concert"]),
    ("Yankees vs. Mets", None, None, ["sporting event"]), ("Hello", None, None, ["other"]), ("Paint and Sip Workshop", None, None, ["class"]), (None, None, None, ["other"]),
])
def test_types(spark, title, description, venue, want):
    assert value(spark, C.types_of(s(title), s(description), s(venue))) == want


def test_vocabulary_is_closed(spark):
    types = {t for t, _ in V.TYPES} | {"other"}
    assert {t for t, _ in V.VENUE_TYPES} <= types and set(V.KIND_FROM_TYPE) <= types
    kinds = {k for k, _ in V.PLACE_KINDS}
    assert {k for k, _ in V.NAME_RULES} <= kinds and {k for k, _ in V.TAG_RULES} <= kinds and set(V.KIND_FROM_TYPE.values()) <= kinds
    assert set(V.CUISINE_TOKENS) <= {c for c, _ in V.CUISINES}


@pytest.mark.parametrize("text,title,kind,want", [
    ("Senior lunch", None, None, "seniors"), ("Tickets $65 and up for all", None, None, "all"), ("Must be 21", None, None, "adults"), ("Ages 3-5", None, None, "family"),
    ("Puppet show", "Puppet show", "play", "family"), ("Baby Boomer concert", "Baby Boomers", "concert", "all"), ("", None, None, "all"),
])
def test_audience(spark, text, title, kind, want):
    assert value(spark, C.audience_of(s(text), s(title), s(kind))) == want


@pytest.mark.parametrize("tags,want", [
    ({"tourism": "museum"}, ["museum"]), ({"historic": "fort"}, ["historic site"]), ({"shop": "art"}, ["gallery", "shop"]), ({"heritage": "2"}, ["historic site"]), ({"shop": "bicycle"}, []), ({"craft": "brewery", "amenity": "pub"}, ["brewery", "restaurant"]),
])
def test_tags(spark, tags, want):
    df = spark.createDataFrame([(tags,)], "tags map<string,string>")
    assert df.select(C.classify_tags(F.col("tags")).alias("v")).first()["v"] == want


def test_small_rules(spark):
    assert value(spark, C.cuisines(s("Pizza; sushi, ice cream"))) == ["pizza", "japanese", "dessert"]
    assert value(spark, C.cadence_of(s("Every other Tuesday"), F.lit(True))) == "fortnightly"
    assert value(spark, C.cadence_of(s("Thursdays at noon"), F.lit(True))) == "weekly"
    assert value(spark, C.cadence_of(s(None), F.lit(True))) == "occasional"
    assert value(spark, C.public_on_campus(s("Soccer vs. Bard"))) and not value(spark, C.public_on_campus(s("Soccer at Bard"))) and not value(spark, C.public_on_campus(s("Registration")))
    assert value(spark, C.is_noise(s("Library closed for the holiday"))) and not value(spark, C.is_noise(s("Closed-toe shoe walk")))
    assert value(spark, C.place_kind_by_name(s("Howland Public Library"))) == "library"
    assert value(spark, C.price_label(F.lit(0.0), F.lit(None).cast("double"))) == "Free" and value(spark, C.price_label(F.lit(None).cast("double"), F.lit(None).cast("double"))) == "See listing"
    assert value(spark, X.building_of(s("Stern Auditorium, Carnegie Hall"), s("Berliner Philharmoniker"), s(None))) == "Carnegie Hall"
    assert value(spark, X.building_of(s("Community Room"), s("Mahopac Public Library"), s(None))) == "Mahopac Public Library"
    assert not value(spark, X.is_a_venue(s("NY"))) and not value(spark, X.is_a_venue(s("Beacon"))) and value(spark, X.is_a_venue(s("Dia Beacon")))
    assert value(spark, X.iso_duration_seconds(s("PT1H30M"))) == 5400 and value(spark, X.iso_duration_seconds(s("PT1800S"))) == 1800 and value(spark, X.iso_duration_seconds(s("1h"))) is None
    assert value(spark, X.split_postal(s("1 Main St, Beacon, NY 12508"))) == ("1 Main St", "Beacon", "NY")
    assert value(spark, X.split_location(s("Towne Crier, Beacon, NY"))) == ("Towne Crier", "Beacon, NY")
    assert value(spark, X.clean_text(s("<p>A &amp;amp; B</p><script>x</script> it\\'s"))) == "A & B it's"
    assert value(spark, X.canon_url(s("https://www.A.com/x/?utm=1"))) == "a.com/x" and value(spark, X.domain_of(s(None))) is None
    assert value(spark, X.titles_match(s("180th Dutchess County Fair"), s("180th Dutchess County Fair in Rhinebeck (Aug 25-30)")))
    assert value(spark, web.resolve(s("https://a.com/b/c"), s("d.jpg"))) == "https://a.com/b/d.jpg" and value(spark, web.resolve(s("https://a.com"), s("/x"))) == "https://a.com/x"
    assert not value(spark, web.picture_ok(s("https://a.com/logo.png"), F.lit(None).cast("int"))) and value(spark, web.picture_ok(s("https://a.com/p-800x600.jpg"), F.lit(None).cast("int")))


@pytest.mark.parametrize("text,at,want", [
    ("Mo-Su 11:00-22:00", "2024-01-17 21:40", 20.0), ("Tu-Th 17:00-22:00, Fr,Sa 17:00-01:00, Mo off", "2024-01-20 00:30", 30.0), ("Mo-Fr 09:00-17:00; PH off", "2024-01-17 12:00", None), ("24/7", "2024-01-17 12:00", float("inf")),
    ("10:00-26:00", "2024-01-17 01:00", 60.0), ("Mo-Su 09:00-17:00; We off", "2024-01-17 12:00", 0.0), ("Sa-Mo 09:00-17:00", "2024-01-14 16:00", 60.0), ("", "2024-01-14 16:00", None), (None, "2024-01-14 16:00", None),
])
def test_hours(spark, text, at, want):
    p = spark.createDataFrame([("a", text)], "id string, opening_hours string")
    assert hours.minutes_open(p, hours.hours_intervals(p), F.lit(at).cast("timestamp_ntz")).first()["minutes_left"] == want


def test_monthly_clamps_to_the_month(spark):
    t = dt.datetime
    df = spark.createDataFrame([(t(2024, 1, 31, 19), "monthly"), (t(2024, 1, 5, 9), "weekday"), (t(2024, 1, 5, 9), "occasional")], "at timestamp_ntz, cadence string")
    out = df.select(recur.next_occurrence(F.col("at"), F.lit(True), F.col("cadence"), F.lit("2024-02-10 10:00:00").cast("timestamp_ntz")).alias("n")).collect()
    assert [r["n"] for r in out] == [t(2024, 2, 29, 19), t(2024, 2, 12, 9), t(2024, 1, 5, 9)]


def test_weekends(spark):
    days = [(dt.date(2024, 1, d),) for d in range(15, 22)]
    a, b = search.weekend(F.col("d"))
    got = spark.createDataFrame(days, "d date").select(a.alias("a"), b.alias("b")).collect()
    assert [(r["a"].day, r["b"].day) for r in got] == [(19, 21)] * 4 + [(19, 21), (20, 21), (21, 21)]


def test_unknown_is_not_no(spark):
    df = spark.createDataFrame([("a", None, None), ("b", 500.0, 1.0), ("c", 1.0, 900.0)], "id string, price_min double, miles double").withColumn("day", F.current_date()).withColumn("end_at", F.lit(None).cast("timestamp"))
    assert [r["id"] for r in search.search_listings(df, search.Query(price_cap=10, radius=5), F.current_timestamp()).collect()] == ["a"]


def test_empty_and_null_places(spark):
    none = spark.createDataFrame([], "id string, lat double, lon double")
    towns = spark.createDataFrame([("T", 41.0, -73.0, 1)], "name string, lat double, lon double, town_rank int")
    assert spatial.nearest_town(none, towns).count() == 0
    some = spark.createDataFrame([("a", None, None), ("b", 41.01, -73.0)], "id string, lat double, lon double")
    assert [tuple(r) for r in spatial.nearest_town(some, towns).collect()] == [("b", "T")]
    assert [r["id"] for r in spatial.within_radius(some, 41.0, -73.0, 5).collect()] == ["b"]


def test_chain_of_duplicates_is_one(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [("c", "Big County Fair", 41.0, -73.0, day, None), ("a", "Big County Fair opening", 41.02, -73.0, day, None), ("b", "Big County Fair opening (Part 2)", 41.04, -73.0, day, None), ("d", "Other", 41.0, -73.0, day, None)]
    df = spark.createDataFrame(rows, "id string, title string, lat double, lon double, start_at timestamp, end_at timestamp")
    out = {r["id"]: r["cluster"] for r in resolve.clusters(df, resolve.duplicate_pairs(df)).collect()}
    assert out == {"a": "a", "b": "a", "c": "a", "d": "d"}


def test_osm_places(spark):
    rows = [("node", 1, 41.1234567, -73.5, None, {"name": "Dia", "tourism": "museum", "website": "dia.org"}), ("way", 2, None, None, (41.0, -73.0), {"name": "P", "leisure": "park", "wikipedia": "en:P"}), ("node", 3, 41.0, -73.0, None, {"name": "No kind"}), ("node", 4, 41.0, -73.0, None, {"tourism": "museum"})]
    df = spark.createDataFrame(rows, "type string, id long, lat double, lon double, center struct<lat:double,lon:double>, tags map<string,string>")
    got = {r["id"]: r for r in places.osm_places(df).collect()}
    assert set(got) == {"osm-node-1", "osm-way-2"} and got["osm-node-1"]["url"] == "https://dia.org" and got["osm-node-1"]["lat"] == 41.123457


def site(spark, *pages):
    """An audit of one site's pages (url, html)."""
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return audit.audit_domains(df).first()


@pytest.mark.parametrize("html,dates,eventish", [
    ("<p>Open Mon-Fri 9:00 am to 5:00 pm</p>", 0, False), ("<p>Now playing: Cars, approx 7:45 pm</p>", 1, True), ("<p>Every Thursday, 7pm</p>", 1, False), ("<p>Closed October 3, 2026-10-04 and 5 May</p>", 3, False),
])
def test_signals(spark, html, dates, eventish):
    r = audit.signals(spark.createDataFrame([(1, "https://x.test/", html)], "page_id long, url string, html string")).first()
    assert r["eventish"] == eventish and (dates is None or r["dates"] == dates)


def test_audit_cases(spark):
    long = "<p>" + "A quiet place by the river with a view. " * 60 + "</p>"
    assert site(spark, ("https://a.com/", long))["verdict"] == "none"
    assert site(spark, ("https://a.com/", "<p>x</p>"))["verdict"] == "unreadable"
    assert site(spark, ("https://a.com/", long), ("https://a.com/events/", "<p>Events</p>"))["verdict"] == "unreadable"
    assert site(spark, ("https://a.com/", long), ("https://a.com/events/", "<p>Family day October 3. Halloween October 31</p>"))["verdict"] == "listings"
    assert site(spark, ("https://a.com/", long), ("https://a.com/about/", "<p>A concert on October 3 and October 31</p>"))["verdict"] == "none"
    assert site(spark, ("https://a.com/", long + "<p>Trivia 3/4 and 4/5</p>"))["verdict"] == "specials"
    assert site(spark, ("https://a.com/", "Caddy works! " + long))["verdict"] == "parked"
    assert site(spark, ("https://a.com/", long + "<p>togel bandar maxwin</p>"))["verdict"] == "suspect"
    assert site(spark, ("https://a.com/", "<p>" + "中文" * 400 + "</p>"))["verdict"] == "suspect" and site(spark, ("https://a.ru/", "<p>" + "Москва " * 400 + "</p>"))["verdict"] == "none"
    assert site(spark, ("https://a.com/", None))["verdict"] == "unreachable"
    linked = site(spark, ("https://a.com/", long + "<a href='https://patrons.org/calendar'>See</a>"))
    assert (linked["verdict"], linked["found"], linked["url"]) == ("listings", ["linked calendar"], "https://patrons.org/calendar")


@pytest.mark.parametrize("text,name,named", [
    ("Montgomery Place Orchards ~ closed ~ thank you", "Montgomery Place Farm Stand", True), ("Kopi77 daftar akun gaming gratis", "Elite Cinema 6", False), ("gardenofideas.com is for sale", "Garden Of Ideas", False), ("The Park", "The Park Club", False),
])
def test_venue_named(spark, text, name, named):
    fronts, names = spark.createDataFrame([("d", text.lower())], "domain string, head string"), spark.createDataFrame([("d", name)], "domain string, name string")
    assert audit.named_sites(fronts, names).count() == named


def test_signature_takes_links_in_page_order(spark):
    """The first 40 candidates, events before deals; a photograph changes nothing, the 40th link does, the 41st doesn't."""
    anchors = [f"<a href='/events/{99 - i}'>e</a>" for i in range(45)]
    sign = lambda links: audit.site_signature(spark.createDataFrame([(1, "https://a.com/", "".join(links))], "page_id long, url string, html string")).first()["sig"]
    whole = sign(["<a href='/specials'>d</a>", *anchors])
    assert whole == sign([*anchors, "<img src='/new.jpg'>"]) == sign(anchors[:40]) != sign(anchors[:39])
    assert sign([]) == sign(["<a href='/about'>About us</a>"])


def test_feed_addresses(spark):
    pages = [(1, "https://a.com/", "<iframe src='https://calendar.google.com/calendar/embed?src=me%40group.org&x'>"), (2, "https://b.com/", "https://town.libcal.com/x"), (3, "https://c.com/", "tockify.com/t <div data-tockify-calendar=\"our.cal\">"), (4, "https://d.com/", "trumba.com/calendars/x"), (5, "https://e.com/", "https://calendar.google.com/calendar/embed?src=%zz")]
    got = {r["domain"]: (r["platform"], r["feed"]) for r in web.calendar_platforms(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {"a.com": ("google", "https://calendar.google.com/calendar/ical/me%40group.org/public/basic.ics"), "b.com": ("libcal", "https://town.libcal.com/calendar?cid=-1&t=d&d=0000-00-00&cal=-1&ical=1"), "c.com": ("tockify", "https://tockify.com/api/feeds/ics/our.cal"), "d.com": ("trumba", None), "e.com": ("google", None)}


def test_gates(spark):
    whole = dict(center_lat="41", center_lon="-73", radius_miles="75", timezone="UTC", scraped_at="2024-01-01T00:00:00Z")
    meta = lambda **k: sorted(r["rule"] for r in quality.check_meta(spark.createDataFrame([whole | k])).collect())
    assert meta() == [] and meta(scraped_at="2024-01-01", timezone="") == ["no timezone", "scraped at without a zone"]
    rows = [("a", "T", 41.0, -73.0, dt.datetime(2024, 1, 1), "talk", ["film", "film"], True, "", True, dt.datetime(2023, 1, 1), "x <b>", None), ("b", "T", 41.0, -73.0, dt.datetime(2024, 1, 1), "film", ["film", "odd"], False, "https://s", False, None, None, "https://u")]
    df = spark.createDataFrame(rows, "id string, title string, lat double, lon double, start_at timestamp, type string, types array<string>, signup_required boolean, signup_url string, repeats boolean, until_at timestamp, description string, url string")
    found = quality.check_listings(df.withColumn("cadence", F.lit("weekly")), F.lit("2024-01-01").cast("date"), 41.0, -73.0, 10).collect()
    assert sorted((r["id"], r["rule"], r["detail"]) for r in found) == [
        ("a", "markup in the description", None), ("a", "no link", None), ("a", "repeated type", None), ("a", "signup without an address", None), ("a", "type isn't the first of types", "talk"), ("a", "until before start", "2023-01-01"), ("b", "unknown type", "odd"),
    ]
    places_ = spark.createDataFrame([("p", "P", 41.0, -73.0, "museum", 0.5, "http://x/y.jpg"), ("q", "Q", 50.0, -73.0, "museum", None, None)], "id string, name string, lat double, lon double, kind string, stars double, image string")
    regions = spark.createDataFrame([("r", 41.0, -73.0, 10.0)], "id string, lat double, lon double, radius_miles double")
    errors = sorted((r["id"], r["rule"]) for r in quality.check_places(places_, regions).where("severity = 'error'").collect())
    assert errors == [("p", "image not by https"), ("p", "rating without a count or source"), ("p", "stars out of range"), ("q", "outside every region")]


def test_ids_are_stable(spark):
    """The same input has the same id in any run and process; other inputs have others."""
    ids = spark.createDataFrame([("src", "u1", "2024-01-01"), ("src", "u2", "2024-01-01"), ("src", "u1", "2024-01-02")], "s string, u string, t string").select(X.stable_id(F.col("s"), F.col("u"), F.col("t")).alias("v"))
    import hashlib

    assert [r["v"] for r in ids.collect()] == ["src-" + hashlib.sha1(x.encode()).hexdigest()[:8] for x in ("u12024-01-01", "u22024-01-01", "u12024-01-02")]


def test_names_and_labels(spark):
    assert value(spark, X.headline(s("INSIDIOUS: OUT OF THE FURTHER"))) == "Insidious: Out of the Further" and value(spark, X.headline(s("Up"))) == "Up" and value(spark, X.headline(s("SPIDER-MAN"))) == "Spider-Man"
    assert value(spark, X.normalise_city(s("New York  (NYC), NY"))) == "New York, NY" and value(spark, X.normalise_city(s(" "))) is None
    assert value(spark, X.titlecase(s("the war of the worlds"))) == "The War of the Worlds"
    assert value(spark, L.facts_label(F.lit(8.6), F.lit(3.0))) == "+9 min · 3.0 mi" and value(spark, L.facts_label(F.lit(0.2), F.lit(-12.3))) == "On the way · 12 mi back" and value(spark, L.facts_label(F.lit(1.0), F.lit(0.0))) == "+1 min · beside you"
    assert value(spark, L.duration_label(F.lit(59))) == "59 min" and value(spark, L.duration_label(F.lit(125))) == "2 h 5 min"
    assert L.type_weights()["park"] == 0.35 * 1.5 and L.type_weights({"views": "skip"}) != L.type_weights()


def test_long_lines_are_folded_whole(spark):
    text = "long text, " * 120_000
    df = spark.createDataFrame([("a", "T", dt.datetime(2024, 1, 1), text)], "id string, title string, start_at timestamp, description string")
    ics = sinks.ics_export(df, F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-01").cast("timestamp")).first()["ics"]
    lines = ics.split("\r\n")
    assert max(map(len, lines)) <= 75 and ics.replace("\r\n ", "").count("long text\\, ") == 120_000
