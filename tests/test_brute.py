"""Rules that SQL can't say, against plain Python over whole tables of the smallest size."""

from __future__ import annotations

import datetime as dt
import html
import re

from pyspark.sql import functions as F

from nearby.functions import classify as C
from nearby.functions import text as X
from nearby.functions import vocab as V
from nearby.operators import listings as L
from nearby.plans.fixtures import view


def types(title, text):
    found = [n for n, p in V.TYPES if re.search(p, title, re.I)][:3]
    more = [n for n, p in V.TYPES if n not in found and re.search(p, text, re.I)][:1]
    found = (found + more)[:3]
    if found:
        return found
    return ["sporting event"] if re.match(r"[A-Z][\w.'-]*(?:\s+[\w.&'-]+){0,4}\s+vs\.?\s+[A-Z]", title, re.A) else ["other"]


def test_event_types(spark, small):
    docs = view(spark, small, "documents").where("text is not null")
    spice = F.when(F.col("doc_id") % 4 == 0, "Jazz concert and puppet show. Bring a picnic for the farmers market").when(F.col("doc_id") % 4 == 1, "Yankees vs Mets at noon. ").when(F.col("doc_id") % 4 == 2, "Pub trivia night and yoga class. ").otherwise("")
    docs = docs.withColumn("text", F.concat(spice, "text"))
    title = F.substring_index("text", ".", 1)
    rows = docs.select("text", C.types_of(title, F.col("text"), F.lit(None).cast("string")).alias("types"), C.setting_of(F.col("text")).alias("setting"), C.has_food(F.col("text")).alias("food")).collect()
    says = lambda p, t: bool(re.search(p, t, re.I))
    for r in rows:
        t = r["text"]
        assert r["types"] == types(t.split(".")[0], t)
        out, inside = says(V.OUTDOOR, t), says(V.INDOOR, t)
        assert r["setting"] == ("outdoor" if out and not inside else "indoor" if inside and not out else "unknown") and r["food"] == says(V.FOOD_WORDS, t)
    assert len({tuple(r["types"]) for r in rows}) > 3


def clean(raw, limit):
    t = re.sub(r"(?is)<(script|style)[^>]*>.*?</\1>", " ", raw)
    t = re.sub("<[^>]+>", "", re.sub(r"(?i)<br\s*/?>|</p>", " ", t))
    t = html.unescape(html.unescape(t))
    t = re.sub(r"\\[nrt]", " ", re.sub(r"""\\(['"\\])""", r"\1", t))
    t = re.sub(r"[\s\xa0]+", " ", t, flags=re.A).strip(" ")
    if len(t) <= limit:
        return t or None
    cut = t[:limit]
    stop = max((m.end() for m in re.finditer(r"[.!?](?= )", cut)), default=0)
    if stop > limit * 0.55 + 1:
        return cut[:stop]
    return re.sub("[ ,;:—-]+$", "", cut.rsplit(" ", 1)[0] if " " in cut[1:] else cut) + "…"


def test_clean_text(spark, small):
    rows = view(spark, small, "pages").select("html", X.clean_text(F.col("html"), 180).alias("text"), X.clean_text(F.col("html"), 20_000_000).alias("whole")).collect()
    for r in rows:
        assert r["text"] == clean(r["html"], 180) and r["whole"] == clean(r["html"], 20_000_000)


def test_refresh_in_its_order(spark):
    """Noise out, repeats collapsed, duplicates folded, rows derived, ended and linkless rows out, ids unique; curated rows stay as they are."""
    t = dt.datetime(2024, 6, 3, 19)
    row = lambda i, title, day=0, url="https://x", end=None, venue="Town Hall", lat=41.0, source="s": (i, source, title, lat, -73.0, t + dt.timedelta(days=day), end, url, venue, None)
    rows = [row("n", "Board Meeting"), row("manual-1", "Board Meeting"), *(row(f"w{k}", "Open Mic Night", 7 * k) for k in range(4)), row("d1", "Big County Fair", source="a"), row("d2", "Big County Fair (Part 2)", source="b", end=t + dt.timedelta(days=1), lat=41.001),
            row("old", "Film Night", -400), row("bare", "Pottery Class", url=""), row("u", "Poetry", 1), row("u", "Poetry slam at the far inn", 2, lat=45.0)]
    df = spark.createDataFrame(rows, "id string, source string, title string, lat double, lon double, start_at timestamp, end_at timestamp, url string, venue string, price_min double").withColumn("venue_key", F.col("venue"))
    rich = X.richness({"end": F.col("end_at")})
    got = {r["id"]: r for r in L.finalize(df, F.lit("2024-06-01").cast("date"), rich, F.col("start_at")).collect()}
    assert set(got) == {"manual-1", "w0", "d1", "u"}
    assert got["w0"]["repeats"] and got["w0"]["recurrence"] == "Every Monday, through Jun 24" and got["w0"]["cadence"] == "weekly" and got["w0"]["type"] == "open mic"
    assert got["d1"]["title"] == "Big County Fair (Part 2)" and got["u"]["title"] == "Poetry"
