"""Addresses, pictures, the directory's ladder, routes that cross themselves, towns on the way and answers with memory."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from nearby.operators import drive, listings, places, resolve, search, spatial, web

BASE = "http://a/b/c/d;p?q"
#: The examples of RFC 3986, section 5.4.
EXAMPLES = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s",
    ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y#s", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g",
    "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h",
    "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x", "g#s/./x": "http://a/b/c/g#s/./x", "g#s/../x": "http://a/b/c/g#s/../x", "http:g": "http:g",
}


def test_references_are_resolved(spark):
    df = spark.createDataFrame([(BASE, r, w) for r, w in EXAMPLES.items()] + [("https://a.example", "x/../y", "https://a.example/y"), ("https://a.example", "?p=2", "https://a.example?p=2"), ("https://a.example/b/c", "https://o.example/x/./y/../z?a/../b", "https://o.example/x/z?a/../b")], "base string, ref string, want string")
    assert [tuple(r) for r in df.select("ref", web.resolve(F.col("base"), F.col("ref")).alias("got"), "want").where("not got <=> want").collect()] == []


def test_destination_cases(spark):
    cases = [
        ("historic site", {"man_made": "lighthouse"}, False), ("historic site", {"man_made": "lighthouse", "wikipedia": "en:x"}, True), ("restaurant", {"amenity": "restaurant"}, False), ("restaurant", {"cuisine": "seafood"}, True), ("restaurant", {"phone": "555"}, True),
        ("restaurant", {"amenity": "fast_food", "cuisine": "burger", "brand": "M"}, False), ("restaurant", {"amenity": "fast_food", "cuisine": "burger", "operator:brand": "M"}, False), ("restaurant", {"amenity": "fast_food", "cuisine": "seafood"}, True), ("park", {"protection_title": "State Park"}, True), ("park", {"website": "https://x"}, False),
        ("lookout", {"tower:type": "fire", "man_made": "tower"}, True), ("lookout", {"man_made": "tower", "website": "https://x"}, False), ("garden", {"heritage": "2"}, True), ("landmark", {"railway": "", "website": "x"}, False), ("museum", {}, True), ("nowhere", {"wikipedia": "x"}, False), (None, {"wikipedia": "x"}, False), ("museum", None, True),
    ]
    df = spark.createDataFrame(cases, "kind string, tags map<string,string>, want boolean")
    assert [tuple(r) for r in df.where(places.substantial(F.col("kind"), F.col("tags")) != F.col("want")).collect()] == []


def test_a_route_that_crosses_itself_does_not_jump(spark):
    """Out and back along the same road, and a figure of eight: the plain nearest point is wrong, the followed one isn't."""
    out = [(1, i, 41.0 + 0.01 * i, -73.0) for i in range(40)] + [(1, 40 + i, 41.39 - 0.01 * i, -72.9995) for i in range(40)]
    eight = [(2, i, 41.0 + 0.1 * math.sin(2 * math.pi * i / 60 * 2), -75.0 + 0.2 * math.sin(2 * math.pi * i / 60)) for i in range(61)]
    seg = spatial.route_segments(spark.createDataFrame(out + eight, "route_id long, seq long, lat double, lon double"))
    rows = {(r["route_id"], r["seq"]): r for r in seg.collect()}
    t, fixes, want = dt.datetime(2024, 1, 1), [], {}
    for route, points in ((1, out), (2, eight)):
        for k, (_, seq, lat, lon) in enumerate(points[:-1]):
            if route == 2 and k < 3:
                continue  # where the figure starts it also crosses itself
            # far from the turn the fixes are nearer to the other way
            side = 0.0 if route == 2 else 0.0004 if 0 < k < 15 else -0.0004 if k > 50 else 0.0
            fixes.append((route * 10, route, t + dt.timedelta(seconds=k), k, lat, lon + side))
            want[(route * 10, k)] = rows[(route, seq)]["cum0"]
    fixes += [(30, 9, t, 0, 41.0, -73.0), (31, 1, t, 0, None, None), (32, 1, t, 0, 0.0, 100.0)]  # no such route, no position, far away
    df = spark.createDataFrame(fixes, "car long, route_id long, fix_at timestamp, event_id long, lat double, lon double").repartition(5)
    got = {(r["car"], r["event_id"]): r["along"] for r in drive.follow_route(df, seg).collect()}
    assert set(got) == {*want, (32, 0)}
    assert all(abs(got[k] - want[k]) < 0.2 for k in want)
    plain = {(r["id"]["car"], r["id"]["event_id"]): r["along"] for r in spatial.segment_hits(df.where("lat is not null").select(F.struct("car", "event_id").alias("id"), "route_id", "lat", "lon"), seg, 1.0, True).groupBy("id").agg(F.min(F.struct("off", "along"))["along"].alias("along")).collect()}
    assert sum(abs(plain[k] - want[k]) > 5 for k in want) > 10


def test_towns_on_the_way(spark, monkeypatch):
    rng = random.Random(3)
    samples = [(r, i * 0.5, rng.choice(["A", "B", None, "C"]) if rng.random() < 0.3 or i % 7 else "A") for r in range(3) for i in range(300)] + [(9, 0.0, None)]
    marks = [(r, rng.uniform(-5, 170)) for r in (0, 1, 2, 9, 10) for _ in range(60)] + [(0, None), (None, 3.0)]
    s = spark.createDataFrame(samples, "route_id long, at double, town string")
    p = spark.createDataFrame(marks, "route_id long, along double")
    got = sorted(((r["route_id"], r["along"], r["town"]) for r in spatial.current_town(p, s).collect()), key=repr)

    def last(route, along):
        held = [(at, town) for r, at, town in samples if route is not None and along is not None and r == route and town and at <= along + 0.05]
        return max(held)[1] if held else None

    assert got == sorted(((r, a, last(r, a)) for r, a in marks), key=repr)
    monkeypatch.setattr(drive, "STRETCH_MILES", 7.0)
    lines = sorted((r["route_id"], r["at"], r["town"]) for r in drive.town_lines(s).collect())
    want = []
    for r in (0, 1, 2):
        own = [(at, town) for x, at, town in samples if x == r and town]
        want += [(r, (a + b) / 2, v) for (a, u), (b, v) in zip(own, own[1:]) if u != v and b - a <= 2]
    assert lines == sorted(want) != []


def test_trailing_misses(spark):
    rng, log = random.Random(1), []
    for host in range(30):
        for n in range(rng.randint(1, 20)):
            log.append((f"h{host}", dt.date(2024, 1, 1) + dt.timedelta(days=n // 3), n, 5.0 if rng.random() < 0.3 else None))
    want = {}
    for host, _, _, price in log:
        want[host] = 0 if price is not None else want.get(host, 0) + 1
    df = spark.createDataFrame(log, "host string, asked_at date, n long, price_min double").repartition(4)
    assert {r["host"]: r["misses"] for r in listings.trailing_misses(df).collect()} == want


def test_on_now_and_interest(spark):
    now = dt.datetime(2024, 5, 4, 20, 0)
    at = lambda h, m=0: now.replace(hour=h, minute=m)
    rows = [("soon", at(20, 50), None), ("late", at(21, 10), None), ("begun", at(19, 50), None), ("over", at(17, 30), None), ("vague", at(0), None), ("fair", at(0) - dt.timedelta(days=1), at(23)), ("short", at(19), at(20, 10)), ("series", at(19, 50), None)]
    df = spark.createDataFrame([(*r, r[0] == "series", 41.0, -73.0) for r in rows], "id string, start_at timestamp_ntz, end_at timestamp_ntz, repeats boolean, lat double, lon double")
    ids = lambda t, **k: {r["id"] for r in drive.on_now(df, F.lit(t.isoformat(" ")).cast("timestamp_ntz"), **k).collect()}
    assert ids(now) == {"soon", "begun"} and ids(now, hidden=spark.createDataFrame([("soon",)], "id string")) == {"begun"}
    assert "fair" in ids(at(12)) and "fair" not in ids(at(18))
    p = spark.createDataFrame([("a", "park", True, None), ("b", "park", False, None), ("c", "cafe", False, ["pizza"]), ("d", "cafe", False, ["pizza", "thai"]), ("e", "cafe", True, None)], "id string, drive_type string, liked boolean, cuisine array<string>").withColumn("chain", F.lit(None).cast("string"))
    score = lambda **k: {r["id"]: r["score"] for r in drive.interest(p, {"park": 0.0}, {}, **k).collect()}
    assert score() == {"a": 4.0, "c": 1.0, "d": 1.0, "e": 4.0} and score(cuisines_off=("pizza",)) == {"a": 4.0, "d": 1.0, "e": 4.0} and score(hungry=False) == {"a": 4.0, "e": 4.0} and score(liked_rescues=False, hungry=False) == {}


def test_search_by_cuisine_and_resting_filters(spark):
    df = spark.createDataFrame([("t", "Baan", None, "restaurant", None, ["thai"], None), ("m", "Old Mill", "Kent", "museum", "X", None, None)], "id string, name string, city string, kind string, brand string, cuisine array<string>, minutes_left double")
    ids = lambda **k: {r["id"] for r in search.search_places(df, search.PlaceQuery(**k)).collect()}
    assert ids(text="thai") == {"t"} and ids(text="japanese & s") == set() and ids(scope="visit", open_now=True, independents=True) == {"m"} and ids(scope="all", open_now=True) == set() and ids(text="baan restaurants") == set()


@pytest.mark.parametrize("n", [1, 50])
def test_a_hot_cluster_merges_by_aggregates(spark, n):
    held = spark.createDataFrame([("h", "County Fair", 41.0, -73.0, dt.datetime(2024, 1, 1), None, 5)], "id string, title string, lat double, lon double, start_at timestamp, end_at timestamp, pos long")
    new = spark.createDataFrame([(f"n{i}", f"County Fair (Part {i})", 41.0, -73.0, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1) if i == 0 else None, 10 + i) for i in range(n)], held.schema)
    rows = resolve.merge_listings(held, new, F.lit(1), F.col("pos"), ["end_at"]).collect()
    assert [(r["id"], r["title"], r["end_at"]) for r in rows] == [("h", "County Fair", dt.datetime(2024, 1, 1))]
