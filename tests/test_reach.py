"""Grid joins against brute force where degrees of longitude are short."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from nearby.operators import components, drive, resolve, search, spatial, title_index


@pytest.mark.parametrize("lat", [45.0, 60.0])
def test_ahead_by_heading_at_speed(spark, lat):
    cars = [(n, lat + 0.01, -73.0 + dx, float(h), 70.0) for n, (dx, h) in enumerate((dx, h) for dx in (-0.001, 0.001) for h in range(0, 360, 45))]
    places = [(i * 200 + j, lat - 0.6 + 0.03 * i, -74.2 + 0.03 * j) for i in range(40) for j in range(80)]
    want = set()
    for car, y0, x0, h, speed in cars:
        hx, hy = math.sin(math.radians(h)), math.cos(math.radians(h))
        for p, y1, x1 in places:
            x, y = (x1 - x0) * 69.172 * math.cos(math.radians(y0)), (y1 - y0) * 69.172
            ahead, off = x * hx + y * hy, abs(x * hy - y * hx)
            if 0.5 <= ahead <= 17.5 and off <= 7 + 0.15 * ahead:
                want.add((car, p))
    got = drive.ahead_by_heading(spark.createDataFrame(cars, "car long, lat double, lon double, heading double, speed double"), spark.createDataFrame(places, "id long, lat double, lon double"))
    rows = [(r["car"], r["id"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_match_items_far_north(spark):
    places = spark.createDataFrame([("p", "Arctic Cathedral Museum", None, 69.0, 18.049)], "id string, name string, brand string, lat double, lon double")
    items = spark.createDataFrame([("Q1", "Arctic Cathedral Museum", 69.0, 18.11, "museum")], "qid string, label string, lat double, lon double, description string")
    assert [tuple(r) for r in resolve.match_items(places, items).collect()] == [("p", "Q1")]


def test_look_ahead(spark):
    speeds = [(None, 7.5), (0.0, 7.5), (10.0, 4.0), (60.0, 15.0), (140.0, 25.0)]
    df = spark.createDataFrame(speeds, "speed double, want double")
    assert df.where(drive.look_ahead(F.col("speed")) != F.col("want")).count() == 0


def haversine(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 3958.8 * math.asin(min(1.0, math.sqrt(h)))


@pytest.mark.parametrize("lat,crowd,rows", [(41.0, 256, 2048), (64.0, 0, 2048), (80.0, 5, 3)])
def test_duplicate_pairs_at_any_latitude(spark, monkeypatch, lat, crowd, rows):
    """Against all pairs: titles equal, one in the other, or alike; short and long runs; crowded blocks by the index, its keys in parts."""
    monkeypatch.setattr(resolve, "CROWD", crowd)
    monkeypatch.setattr(title_index, "ROWS", rows)
    rng, t = random.Random(int(lat)), dt.datetime(2024, 1, 1)
    titles = ["County Fair", "County Fair Opening Night", "Quiet Reading Hour", "Reading Hour Quiet", "Art", "Party", "of it", "(aside)", "Kids Quiet Reading Hour", "ounty fa"]
    rows = []
    for i in range(90):
        start = t + dt.timedelta(days=rng.randrange(4))
        end = start + dt.timedelta(days=rng.choice([0, 2, 60])) if rng.random() < 0.5 else None
        rows.append((f"e{i:02}", rng.choice(titles), lat + rng.random() * 0.08, -73.0 + rng.random() * 0.08 / math.cos(math.radians(lat)), start, end))
    words = lambda s: {w for w in s.lower().split() if len(w) > 2}
    want = set()
    for a in rows:
        for b in rows:
            if a[0] < b[0] and haversine(a[2], a[3], b[2], b[3]) < 2:
                (a0, a1), (b0, b1) = ((x[4], max(x[5] or x[4], x[4])) for x in (a, b))
                days = a0 == b0 or (a0 < a1 or b0 < b1) and a0 <= b1 and b0 <= a1
                x, y = ("" if "(" in t[1] else t[1].lower() for t in (a, b))
                inside = x == y or x and y and (x in y or y in x)
                if days and (inside or words(x) and words(y) and len(words(x) & words(y)) / len(words(x) | words(y)) >= 0.6):
                    want.add((a[0], b[0]))
    df = spark.createDataFrame(rows, "id string, title string, lat double, lon double, start_at timestamp, end_at timestamp")
    got = [(r["a"], r["b"]) for r in resolve.duplicate_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_preset_towns_beyond_the_busiest(spark):
    """250 busy towns close together hide none of the distant ones."""
    rows = [(f"Near {i:03}", 41.0 + i * 1e-5, -73.0) for i in range(250) for _ in range(3)] + [(f"Far {i} (aside)", 45.0 + i, -80.0) for i in range(9)]
    df = spark.createDataFrame(rows, "city string, lat double, lon double")
    got = [(r["town"], r["n"], r["pos"]) for r in search.preset_towns(df).orderBy("pos").collect()]
    assert got == [("Near 000", 3, 1), *((f"Far {i}", 1, i + 2) for i in range(7))]
    regions = spark.createDataFrame([("Maine", 45.2, -69.0), ("Coast", 41.0, -73.0)], "name string, lat double, lon double")
    near = search.preset_towns(df, regions, (45.0, -69.0), slots=3).orderBy("pos").collect()
    assert [r["town"] for r in near] == ["Maine", "Coast", "Far 0"]


def test_day_plan_in_stretches(spark):
    rng, t = random.Random(1), dt.datetime(2024, 1, 1)
    rows = [(f"l{i}", t.date() + dt.timedelta(days=i % 2), t + dt.timedelta(days=i % 2, minutes=rng.randrange(0, 1440, 7)), i % 5 == 0, float(rng.randrange(9)) if i % 3 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "id string, day date, next_at timestamp, all_day boolean, miles double")
    got = {r["id"]: (r["day_count"], r["day_pos"]) for r in search.day_plan(df).collect()}
    for day in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == day), key=lambda r: (dt.datetime.combine(r[2].date(), dt.time(23, 59, 59)) if r[3] else r[2], r[4] is None, r[4] or 0, r[0]))
        assert [got[r[0]] for r in own] == [(len(own), i + 1) for i in range(len(own))]


def test_route_in_stretches(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(1, i * rng.choice([1, 1]) + (i > 30) * 50, 41 + rng.random(), -73 + rng.random()) for i in range(60)]
    df = spark.createDataFrame(rows, "route_id long, seq long, lat double, lon double")
    whole = spatial.route_segments(df).orderBy("seq").collect()
    monkeypatch.setattr(spatial, "STRETCH", 7)
    parts = spatial.route_segments(df).orderBy("seq").collect()
    total = 0.0
    for (a, b), x, y in zip(zip(sorted(rows, key=lambda r: r[1]), sorted(rows, key=lambda r: r[1])[1:]), whole, parts, strict=True):
        total += math.hypot((b[3] - a[3]) * 69.172 * math.cos(math.radians(a[2])), (b[2] - a[2]) * 69.172)
        assert (x["seq"], x["lat1"], x["lon1"]) == (y["seq"], y["lat1"], y["lon1"]) == (a[1], b[2], b[3])
        assert math.isclose(x["cum1"], total) and math.isclose(y["cum1"], total)


def test_a_slow_car_gets_a_heading(spark):
    """Steps too short for a bearing add up from the last trusted fix; the device's own heading counts at speed."""
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t + dt.timedelta(seconds=i), i, 41.0 + i * 0.0002, -73.0, None, None) for i in range(30)]
    rows += [(2, t + dt.timedelta(seconds=i), i, 41.0, -73.0, 123.0, 10.0 if i > 1 else 1.0) for i in range(4)]
    df = spark.createDataFrame(rows, "car long, fix_at timestamp, event_id long, lat double, lon double, gps_heading double, gps_speed double")
    got = {(r["car"], r["event_id"]): r for r in drive.track(df).collect()}
    assert got[(1, 0)]["heading"] is None and all(got[(1, i)]["heading"] == 0 for i in range(3, 30))
    assert 0.4 < got[(1, 29)]["odometer"] < 0.41 and math.isclose(got[(1, 29)]["speed"], 0.0002 * math.pi / 180 * 3958.8 * 3600, rel_tol=1e-6)
    assert [got[(2, i)]["heading"] for i in range(4)] == [None, None, 123.0, 123.0] and math.isclose(got[(2, 3)]["speed"], 22.3694)


def test_alerts_come_again_after_a_minute(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t + dt.timedelta(seconds=10 * i), i, 1.0, 9.0) for i in range(14)] + [(1, t + dt.timedelta(seconds=200 + i), 20 + i, 0.0, 0.1) for i in range(3)]
    df = spark.createDataFrame(rows, "car long, fix_at timestamp, event_id long, off double, left double")
    assert [(r["event_id"], r["alert"]) for r in drive.route_alerts(df).orderBy("event_id").collect()] == [(2, "off route"), (9, "off route"), (20, "arrived")]


def test_chains_and_cuisines(spark):
    df = spark.createDataFrame([("a", "restaurant", "X", ["thai"]), ("b", "restaurant", "Y", ["pizza"]), ("c", "restaurant", None, None)], "id string, drive_type string, chain string, cuisine array<string>")
    score = lambda **k: {r["id"]: r["score"] for r in drive.interest(df, {"restaurant": 1.0}, {}, **k).collect()}
    assert score(chains_off=("X",), cuisines={"pizza": 2.0}) == {"b": 3.0, "c": 1.0} and set(score(keep_chains=False)) == {"c"}


@pytest.mark.parametrize("many", [2, 1000])
def test_components_with_hubs(spark, monkeypatch, many):
    """Hubs go another way than other nodes, to the same components."""
    monkeypatch.setattr(components, "MANY", many)
    rng = random.Random(many)
    edges = [(0, i) for i in range(1, 40)] + [(100 + i, 101 + i) for i in range(30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7), (None, 3)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(df).collect()}
    assert got == {i: find(i) for i in root}


def test_unlike_titles_of_a_crowded_block_rarely_meet(spark):
    """Thousands of unlike titles at one place and day: under 1 % of all pairs are compared, and the few matches found."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(5000)]
    titles = [" ".join(["evening", "with", *rng.sample(words, 3)]) for _ in range(4000)]
    titles[7], titles[8] = titles[0] + " again", " ".join(titles[1].split()[2:])
    df = spark.createDataFrame([(i, t, t.split(), 1) for i, t in enumerate(titles)], "id long, norm string, words array<string>, b int")
    left = df.select(*(F.col(c).alias(f"l_{c}") for c in ("id", "norm", "words")), "b")
    keys = title_index.keys_of(df.select("norm", F.filter("words", lambda w: F.length(w) > 2).alias("words"))).collect()
    by_gram, by_word = {}, {}
    for r in keys:
        for g in {r["norm"][i : i + 4] for i in range(len(r["norm"]) - 3)}:
            by_gram[g] = by_gram.get(g, 0) + 1
        for w in r["prefix"]:
            by_word[w] = by_word.get(w, 0) + 1
    compared = sum(by_gram[r["gram"]] for r in keys) + sum(n * n for n in by_word.values())
    assert compared < 0.01 * len(titles) ** 2
    alike, longer, short = title_index.candidates(left, df, ["b"])
    got = {(r["l_id"], r["id"]) for r in longer.collect() if r["l_id"] != r["id"]}
    assert got == {(0, 7), (8, 1)} and short.count() == 0


def circle(rng, lat, lon, miles):
    """A point about ``miles`` off, by the same haversine."""
    a, b = rng.uniform(0, 2 * math.pi), miles / 3958.8
    y = math.asin(math.sin(math.radians(lat)) * math.cos(b) + math.cos(math.radians(lat)) * math.sin(b) * math.cos(a))
    x = math.radians(lon) + math.atan2(math.sin(a) * math.sin(b) * math.cos(math.radians(lat)), math.cos(b) - math.sin(math.radians(lat)) * math.sin(y))
    return math.degrees(y), (math.degrees(x) + 180) % 360 - 180


ODD_ENDS = [(10.0, 179.95), (-40.0, -179.99), (89.0, 30.0), (-89.5, 100.0), (84.9, 179.0), (0.0, 180.0), (0.0, -180.0), (90.0, 0.0)]


@pytest.mark.parametrize("lat,lon", ODD_ENDS)
def test_circles_on_a_round_earth(spark, lat, lon):
    rng = random.Random(int(lat))
    places = [(i, *circle(rng, lat, lon, rng.uniform(0, 60))) for i in range(150)] + [(900, lat, lon), (901, 0.0, 0.0), (902, None, 3.0)]
    df = spark.createDataFrame(places, "id long, lat double, lon double")
    known = [p for p in places if p[1] is not None]
    assert {r["id"] for r in spatial.within_radius(df, lat, lon, 25).collect()} == {i for i, a, b in known if haversine(lat, lon, a, b) <= 25}
    circles = [("A", lat, lon, 20.0), ("B", *circle(rng, lat, lon, 15), 30.0)]
    regions = spark.createDataFrame(circles, "id string, lat double, lon double, radius_miles double")
    want = {}
    for i, a, b in known:
        gaps = sorted((haversine(y, x, a, b) - r, n) for n, y, x, r in circles if haversine(y, x, a, b) - r <= 3)
        if gaps:
            want[i] = gaps[0][1]
    rows = spatial.coverage(df, regions, 3.0).collect()
    assert {r["id"]: r["region"] for r in rows} == want and len(rows) == len(want) > 20
    totals = {r["region"]: r["to_visit"] for r in spatial.region_totals(df, regions, F.lit(False)).collect()}
    assert totals == {n: sum(haversine(y, x, a, b) <= r for _, a, b in known) for n, y, x, r in circles}


@pytest.mark.parametrize("lat,lon,crowd", [(*x, 256 * (i % 2)) for i, x in enumerate(ODD_ENDS[:6])])
def test_duplicates_and_items_on_a_round_earth(spark, monkeypatch, lat, lon, crowd):
    monkeypatch.setattr(resolve, "CROWD", crowd)
    rng, t = random.Random(3), dt.datetime(2024, 1, 1)
    at = [circle(rng, lat, lon, rng.uniform(0, 4)) for _ in range(25)]
    df = spark.createDataFrame([(f"e{i:02}", "County Fair", a, b, t, None) for i, (a, b) in enumerate(at)], "id string, title string, lat double, lon double, start_at timestamp, end_at timestamp")
    want = {(f"e{i:02}", f"e{j:02}") for i in range(25) for j in range(i + 1, 25) if haversine(*at[i], *at[j]) < 2}
    got = [(r["a"], r["b"]) for r in resolve.duplicate_pairs(df).collect()]
    assert set(got) == want and len(got) == len(want)
    places = df.select("id", F.lit("Olana Museum").alias("name"), F.lit(None).cast("string").alias("brand"), "lat", "lon")
    items = spark.createDataFrame([("Q1", "Olana Museum", lat, lon, "museum")], "qid string, label string, lat double, lon double, description string")
    assert {r["id"] for r in resolve.match_items(places, items).collect()} == {f"e{i:02}" for i, p in enumerate(at) if haversine(lat, lon, *p) <= 2}


def test_drives_across_the_date_line(spark):
    rng = random.Random(5)
    route = spark.createDataFrame([(1, i, 52.0 + 0.01 * i, (179.8 + 0.05 * i + 180) % 360 - 180) for i in range(12)], "route_id long, seq long, lat double, lon double")
    seg = spatial.route_segments(route)
    assert max(r["cum1"] for r in seg.collect()) < 30
    places = [(i, 52.0 + rng.uniform(-0.1, 0.2), (180 + rng.uniform(-0.3, 0.5) + 180) % 360 - 180) for i in range(120)]
    df = spark.createDataFrame(places, "id long, lat double, lon double")
    got = {r["id"]: (r["along"], r["off"]) for r in spatial.locate_on_route(df, seg, 5.0).collect()}
    short = lambda x: (x + 180) % 360 - 180
    for i, lat, lon in places:
        best = None
        for s in seg.collect():
            k = 69.172 * math.cos(math.radians(s["lat0"]))
            px, py, sx, sy = short(lon - s["lon0"]) * k, (lat - s["lat0"]) * 69.172, short(s["lon1"] - s["lon0"]) * k, (s["lat1"] - s["lat0"]) * 69.172
            f = max(0.0, min(1.0, (px * sx + py * sy) / (sx * sx + sy * sy)))
            off = math.hypot(px - f * sx, py - f * sy)
            best = min(best or (off, 1e9), (off, s["cum0"] + f * (s["cum1"] - s["cum0"])))
        assert (i in got) == (best[0] <= 5) and (i not in got or math.isclose(got[i][1], best[0], abs_tol=1e-6))
    cars = spark.createDataFrame([(1, 52.0, 179.95, 90.0, 60.0)], "car long, lat double, lon double, heading double, speed double")
    k = 69.172 * math.cos(math.radians(52.0))
    want = {i for i, a, b in places if 0.5 <= short(b - 179.95) * k <= 15 and abs((a - 52.0) * 69.172) <= 7 + 0.15 * short(b - 179.95) * k}
    assert {r["id"] for r in drive.ahead_by_heading(cars, df).collect()} == want != set()
