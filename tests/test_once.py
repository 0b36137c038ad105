"""What a row's many columns share is made once for each row."""

from __future__ import annotations

from pyspark.sql import functions as F

from nearby.functions import text as X
from nearby.operators import audit, places
from nearby.plans import queries_feeds as feeds
from nearby.sources import shapes


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tags_once(spark):
    tags = F.map_filter(F.create_map(F.lit("name"), F.col("n"), F.lit("tourism"), F.lit("museum")), lambda _, v: v.isNotNull())
    df = spark.createDataFrame([(1, "Hall"), (2, None)], "id int, n string").select(F.lit("node").alias("type"), "id", F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), F.lit(None).cast("struct<lat:double,lon:double>").alias("center"), tags.alias("tags"))
    out = places.osm_places(df)
    assert optimized(out).count("map_filter") == 1
    assert [(r["id"], r["name"], r["kind"]) for r in out.collect()] == [("osm-node-1", "Hall", "museum")]


def test_titles_once(spark):
    payload = '{"events":[{"id":1,"title":" A &amp; B ","start_date":"2026-01-02 10:00:00","timezone":"Etc/UTC"},{"id":2,"title":" ","start_date":"2026-01-02 10:00:00"},{"id":3,"title":"x","start_date":"?"},{"id":4,"start_date":"2026-01-02 10:00:00"}]}'
    records = spark.createDataFrame([("s", payload), ("s", "no json"), ("s", '{"events":[]}'), ("s", None)], "source_id string, payload string")
    out = shapes.shape(records, "events rest").select("source_id", "uid", "title", "start_at", "address")
    assert optimized(out).count("$.title") == 1 and optimized(out).count("$.start_date") <= 4
    assert [(r["uid"], r["title"], str(r["start_at"])[:10], r["address"]) for r in out.collect()] == [("tribe-1", "A & B", "2026-01-02", None)]


def test_venue_once(spark):
    venues = ["", ',"venue":[]', ',"venue":"Hall"', ',"venue":null', ',"venue":{}', ',"venue":{"venue":"Hall","city":5,"state":"NY"}', ',"venue":{"stateprovince":"CT","state":"NY"}', ',"venue":{"venue":"","address":{"a":1},"stateprovince":null,"state":"NY"}']
    events = ",".join(f'{{"id":{i},"title":"t","start_date":"2026-01-02 10:00:00"{v}}}' for i, v in enumerate(venues))
    out = shapes.shape(spark.createDataFrame([("s", f'{{"events":[{events}]}}')], "source_id string, payload string"), "events rest").select("uid", "venue", "city", "address")
    assert optimized(out).count("$.venue.") == 0  # not a path for each of its parts
    got = {r["uid"]: tuple(r)[1:] for r in out.collect()}
    nothing = (None, None, None)
    assert [got[f"tribe-{i}"] for i in range(len(venues))] == [nothing] * 5 + [("Hall", "5", "Hall, 5, NY"), (None, None, "CT"), ("", None, '{"a":1}, NY')]


def test_records_hold_many_listings(spark, small):
    def sizes(*span):
        return [n for n, in feeds.payloads(spark, small, feeds.obj(id=feeds.key()), ("[", "]"), *span).select(F.size(F.from_json("payload", "array<struct<id:string>>"))).collect()]

    rows = feeds.listings(spark, small)
    n, venues = rows.count(), rows.select("venue_key").distinct().count()
    assert n <= feeds.RECORD * feeds.VENUES  # so a venue's listings are all in one record
    assert sum(sizes()) == n and len(sizes()) == venues
    assert sum(sizes(4)) == n and max(sizes(4)) <= 4


def test_unescape(spark):
    texts = [None, "", "plain", "&", "&amp;", "&amp;lt; &#38;lt; &#038;amp;lt;", "&#39;&#0039;&#x27;&#x027;&#160;|&nbsp;|", "&#8217;&#8211;&ndash;&mdash;&hellip;&eacute;&copy;&middot;", "&AMP; &lt &bogus; &lt;&gt;&quot;&apos;", "a &# b &amp;#39;"]

    def plain(t):
        for name, char in (("#0*39", "'"), ("#x0*27", "'"), ("#0*160", " "), ("#0*8217", "’"), ("#0*8211", "–"), ("#0*38", "&"), *X.ENTITIES.items()):
            t = F.regexp_replace(t, f"&{name};", char)
        return t

    t = F.col("t")
    df = spark.createDataFrame([(x,) for x in texts], "t string").select("t", X.unescape(t).alias("got"), plain(t).alias("want"))
    assert [(r["t"], r["got"], r["want"]) for r in df.collect() if r["got"] != r["want"]] == []
    assert optimized(df.select("got")).count("regexp_replace") == 6


def site(i: int, links: int) -> tuple:
    many = "".join(f'<a href="/events/{n % 5}#{n}">Event {n}</a><a href="/deals/{n % 3}">Deal</a>' for n in range(links))
    return i, f"https://www.hall{i % 3}.example/{'x' * i}", f'<p>Concerts: January 3, 2025-02-03 and 4/5 Grand Lyceum</p>{many}<a href="https://cal.example.net/calendar">all events</a>'


def test_pages_once(spark):
    pages = spark.createDataFrame([site(i, 4) for i in range(6)], "page_id int, url string, html string")
    names = spark.createDataFrame([("hall0.example", "The Grand Lyceum Hall"), ("hall0.example", "Elsewhere"), ("hall1.example", "Elsewhere Cinema"), ("hall1.example", None)], "domain string, name string")
    plan = optimized(audit.signals(pages))
    assert plan.count("<a\\s") <= 2 and plan.count("noscript") <= 4  # links are read once by address and once by label
    verdicts = audit.audit_domains(pages, names)
    assert optimized(verdicts).count("<a\\s") <= 2
    assert sorted((r["domain"], r["verdict"], r["pages"], r["found"]) for r in verdicts.collect()) == [(f"hall{i}.example", "listings", 2, ["linked calendar", "dated listings", "dated specials"]) for i in range(3)]
    leads = audit.audit_leads(verdicts, names)
    assert optimized(leads).count("<a\\s") <= 2 and leads.columns == ["domain", "lead", "detail"]
    fronts = pages.select(F.lit("hall0.example").alias("domain"), F.lit("grand old lyceum").alias("head")).limit(1)
    assert [r["domain"] for r in audit.named_sites(fronts, names).collect()] == ["hall0.example"]


def test_leads_of_each_kind(spark):
    verdicts = spark.createDataFrame([("a", "feed", "u", False), ("b", "listings", "v", True), ("c", "parked", "w", False), ("d", "suspect", None, False), ("e", "none", None, None)], "domain string, verdict string, url string, spammed boolean")
    places_of = spark.createDataFrame([("c", "Z"), ("c", "Y"), ("c", "X"), ("c", "X"), ("a", "Q")], "domain string, name string")
    want = [("a", "feed", "u"), ("b", "spammed", None), ("c", "bad", "X; Y"), ("d", "bad", None)]
    assert sorted(tuple(r) for r in audit.audit_leads(verdicts, places_of).collect()) == want
    assert sorted(tuple(r) for r in audit.audit_leads(verdicts).collect()) == [x if x[0] != "c" else ("c", "bad", None) for x in want]


def test_candidates_of_a_page_with_many_links(spark):
    pages = spark.createDataFrame([(*site(1, 300),)], "page_id int, url string, html string")
    got = pages.select(audit.candidates(F.col("url"), F.col("html")).alias("c"), audit.linked_calendars(F.col("url"), F.col("html")).alias("l")).first()
    assert got["c"] == [f"https://www.hall1.example/events/{n}" for n in range(5)] + [f"https://www.hall1.example/deals/{n}" for n in range(3)] and got["l"] == ["https://cal.example.net/calendar"]
