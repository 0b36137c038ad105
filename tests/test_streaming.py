"""Streams give the rows of their batch forms."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from nearby.operators import drive
from nearby.plans.fixtures import view
from nearby.streaming import live


def run(spark, stream, name):
    q = stream.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", tempfile.mkdtemp()).trigger(availableNow=True).start()
    q.awaitTermination(180)
    q.stop()
    return spark.table(name)


def source(spark, df, by):
    """Files in time order, one for each part of it, read one by one."""
    d = tempfile.mkdtemp()
    for k in range(3):
        df.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(d)
    return spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(d)


def test_track(spark, small):
    fixes = view(spark, small, "v_fixes").select("car", F.col("fix_at").cast("timestamp").alias("fix_at"), "event_id", "lat", "lon", "gps_heading", "gps_speed").where("car < 6")
    parts = fixes.withColumn("part", F.when(F.dayofmonth("fix_at") <= 10, 0).when(F.dayofmonth("fix_at") <= 20, 1).otherwise(2))
    got = run(spark, live.track_stream(source(spark, parts, "fix_at")), "tracked")
    pick = lambda df: sorted((r["car"], r["event_id"], round(r["step"], 6), round(r["odometer"], 4), round(r["speed"], 3), None if r["heading"] is None else round(r["heading"], 4)) for r in df.collect())
    assert pick(got) == pick(drive.track(fixes))


def test_alerts(spark, small):
    t = drive.track(view(spark, small, "v_fixes")).where("car < 6").select("car", F.col("fix_at").cast("timestamp").alias("fix_at"), "event_id", F.col("step").alias("off"), (5.0 - F.col("step")).alias("left"))
    parts = t.withColumn("part", F.when(F.dayofmonth("fix_at") <= 10, 0).when(F.dayofmonth("fix_at") <= 20, 1).otherwise(2))
    got = run(spark, live.alert_stream(source(spark, parts, "fix_at")), "alerts")
    pick = lambda df: sorted((r["car"], r["event_id"], r["alert"]) for r in df.collect())
    assert pick(got) == pick(drive.route_alerts(t)) != []


def test_deck(spark):
    rows = [(1, t, f"s{t}-{i}", float((i * 7 + t) % 11), float(i + 4)) for t in range(3) for i in range(6)]
    df = spark.createDataFrame(rows, "car long, tick long, id string, value double, ahead double").withColumn("part", F.col("tick").cast("int"))
    moves = run(spark, live.deck_stream(source(spark, df, "tick"), k=4), "deck").collect()
    size = sum(1 if m["move"] == "in" else -1 for m in moves)
    assert size == 4 and any(m["move"] == "out" for m in moves)


def test_refresh(spark, tmp_path):
    import datetime as dt

    from nearby.functions import text as X

    schema = "id string, title string, lat double, lon double, start_at timestamp, end_at timestamp, pos long"
    t = dt.datetime(2024, 1, 1)
    held = [("l-1", "Big County Fair", 41.0, -73.0, t, None, 1), ("l-2", "Quiet Reading", 41.0, -73.0, t, None, 2)]
    table, source = f"{tmp_path}/table", f"{tmp_path}/in"
    spark.createDataFrame(held, schema).write.parquet(f"{table}/version=0")
    rich, order = (lambda: X.richness({"end": F.col("end_at")})), (lambda: F.col("pos"))

    def feed(rows):
        spark.createDataFrame(rows, schema + ", seen_at timestamp").write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema + ", seen_at timestamp").parquet(source)
        q = live.refresh_stream(stream, table, rich, order, ["end_at"], f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(180)
        return {r["id"]: (r["title"], r["end_at"]) for r in live.newest(spark, table).collect()}

    end = t + dt.timedelta(days=2)
    # the richer report takes the place under the held id; the new one is appended, once
    rows = feed([("m-1", "Big County Fair (Part 2)", 41.001, -73.0, t, end, 3, t), ("m-3", "Film Night", 41.5, -73.5, t, None, 4, t), ("m-3", "Film Night", 41.5, -73.5, t, None, 4, t)])
    assert rows == {"l-1": ("Big County Fair (Part 2)", end), "l-2": ("Quiet Reading", None), "m-3": ("Film Night", None)}
    # a richer update of an id soon after counts
    assert feed([("m-3", "Film Night", 41.5, -73.5, t, end, 4, t + dt.timedelta(hours=1))])["m-3"] == ("Film Night", end)
    # a half-written version is none, and a repeated batch starts from the same version
    (tmp_path / "table" / "version=9").mkdir()
    assert live.versions(spark, table) == [0, 1, 2] and live.newest(spark, table, 2).where("id = 'm-3'").first()["end_at"] is None


def sequential_deck(rows, k, margin, far):
    """Moves of a deck, row by row: passed stops leave, then candidates ask in, the best first."""
    held, odometer, out = {}, {}, []
    for car, tick, kind, odo, i, value, ahead in sorted(rows, key=lambda r: (r[0], r[1], r[2], -(r[5] or 0), r[4] or "")):
        h = held.setdefault(car, {})
        if kind == 0:
            odometer[car] = max(odometer.get(car, 0.0), odo)
            for x in sorted(x for x, (_, mark) in h.items() if mark <= odometer[car]):
                del h[x]
                out.append((car, tick, x, "passed"))
            continue
        at = odometer.get(car, 0.0)
        if ahead <= 0 or i in h:
            continue
        if len(h) < k:
            h[i] = (value, at + ahead)
            out.append((car, tick, i, "in"))
            continue
        open_ = sorted((v, x) for x, (v, mark) in h.items() if mark - at > far)
        if open_ and value > open_[0][0] + margin:
            del h[open_[0][1]]
            h[i] = (value, at + ahead)
            out += [(car, tick, open_[0][1], "out"), (car, tick, i, "in")]
    return sorted(out)


def test_deck_forgets_what_is_passed(spark):
    """Two streams feed a car's state; what it moves equals the batch form and a plain loop."""
    import random

    rng = random.Random(2)
    positions = [(car, t, 0, t * 1.5 + car, None, None, None) for car in range(3) for t in range(40)]
    candidates = [(car, t, 1, None, f"s{rng.randrange(30)}", float(rng.randrange(10)), float(rng.randrange(-1, 16))) for car in range(4) for t in range(40) for _ in range(rng.randrange(4))]
    want = sequential_deck(positions + candidates, 3, 1.0, 7.0)
    p = spark.createDataFrame([(r[0], r[1], r[3]) for r in positions], "car long, tick long, odometer double")
    c = spark.createDataFrame([(r[0], r[1], *r[4:]) for r in candidates], "car long, tick long, id string, value double, ahead double")
    pick = lambda df: sorted(tuple(r) for r in df.collect())
    assert pick(drive.deck_moves(c, p, k=3).select("car", "tick", "id", "move")) == want and {m[3] for m in want} == {"in", "out", "passed"}
    part = F.least(F.floor(F.col("tick") / 14), F.lit(2)).cast("int")
    got = run(spark, live.deck_stream(source(spark, c.withColumn("part", part), "tick"), source(spark, p.withColumn("part", part), "tick"), k=3), "decks")
    assert pick(got) == want


def test_a_passed_stop_makes_room(spark):
    p = spark.createDataFrame([(1, t, t * 2.0) for t in range(6)], "car long, tick long, odometer double")
    c = spark.createDataFrame([(1, t, f"p{t}", 1.0, 1.5) for t in range(6)], "car long, tick long, id string, value double, ahead double")
    rows = {(r["id"], r["move"]) for r in drive.deck_moves(c, p, k=2).collect()}
    assert {(f"p{t}", "in") for t in range(6)} <= rows and ("p0", "passed") in rows
