"""Listings, places, towns and positions derived from the general test tables.

Each view is one text that Spark SQL and DuckDB read alike, so a query and its SQL see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_places": """select concat('osm-node-', cast(c_custkey as varchar(20))) as id, concat(c_mktsegment, ' ', cast(c_custkey % 40 as varchar(20))) as name,
  case c_mktsegment when 'AUTOMOBILE' then 'museum' when 'BUILDING' then 'historic site' when 'FURNITURE' then 'antique shop' when 'HOUSEHOLD' then 'restaurant' else 'park' end as kind,
  41.5 + (cast((c_custkey * 7919) % 2000 as double) - 1000) / 1000 as lat, -73.9 + (cast((c_custkey * 104729) % 2000 as double) - 1000) / 1000 as lon,
  case when c_custkey % 5 = 0 then concat('brand', cast(c_custkey % 7 as varchar(20))) end as brand,
  case cast(c_custkey % 6 as int) when 0 then 'Mo-Su 11:00-22:00' when 1 then 'Tu-Th 17:00-22:00, Fr,Sa 17:00-01:00, Mo off' when 2 then '24/7' when 3 then 'Mo-Fr 09:00-17:00; PH off' when 4 then '10:00-26:00' end as opening_hours,
  case when c_custkey % 9 = 0 then cast(null as varchar(20)) else concat('Town ', cast(c_custkey % 23 as varchar(20))) end as city,
  case when c_custkey % 4 = 0 then concat('https://www.site', cast(c_custkey % 300 as varchar(20)), '.example.com/visit/') end as url,
  c_acctbal as score, c_custkey from customer""",
    "v_towns": """select s_name as name, cast(s_suppkey % 4 as int) as town_rank, 41.5 + (cast((s_suppkey * 6007) % 2000 as double) - 1000) / 1000 as lat,
  -73.9 + (cast((s_suppkey * 3571) % 2000 as double) - 1000) / 1000 as lon from supplier""",
    "v_regions": """select r_name as id, 40.9 + 0.3 * cast(r_regionkey as double) as lat, -74.5 + 0.3 * cast(r_regionkey as double) as lon, 25.0 + 5.0 * cast(r_regionkey as double) as radius_miles from region""",
    "v_listings": """select concat('l-', cast(o_orderkey as varchar(20))) as id, case when p_name is null then concat('Evening ', cast(o_orderkey % 50 as varchar(20))) else concat(p_name, ' ', p_type) end as title, concat(c_mktsegment, ' ', cast(c_custkey % 40 as varchar(20))) as venue_key,
  cast(o_orderdate as timestamp) as start_at, case when o_orderkey % 11 = 0 then cast(o_orderdate as timestamp) + interval '3' day end as end_at,
  case when o_orderkey % 3 = 0 then null when o_orderkey % 7 = 0 then 0.0e0 else floor(o_totalprice / 10) / 1e2 end as price_min,
  o_orderkey % 2 = 0 as has_food, case o_orderstatus when 'O' then 'family' when 'F' then 'all' else 'seniors' end as audience,
  case cast(o_orderkey % 5 as int) when 0 then 'outdoor' when 1 then 'indoor' else 'unknown' end as setting, o_orderkey % 6 = 0 as signup_required,
  o_orderkey % 4 = 0 as repeats, case when o_orderkey % 4 = 0 then case cast(o_orderkey % 7 as int) when 0 then 'daily' when 1 then 'weekday' when 2 then 'weekly' when 3 then 'fortnightly' when 4 then 'monthly' when 5 then 'occasional' else 'bookable' end end as cadence,
  case when o_orderkey % 8 = 0 then cast(o_orderdate as timestamp) + interval '60' day end as until_at,
  case cast(o_orderkey % 4 as int) when 0 then 'concert' when 1 then 'talk' when 2 then 'film' else 'market' end as type_1, case when o_orderkey % 3 = 0 then 'class' end as type_2,
  41.5 + (cast((c_custkey * 7919) % 2000 as double) - 1000) / 1000 as lat, -73.9 + (cast((c_custkey * 104729) % 2000 as double) - 1000) / 1000 as lon,
  o_orderkey, o_custkey from orders join customer on o_custkey = c_custkey left join part on p_partkey = o_orderkey % 2000""",
    "v_occurrences": """select cast(user_id as varchar(20)) as source, event_type as title, cast(ts as timestamp) as start_at, cast(ts as date) as day, event_id from events""",
    "v_fixes": """select user_id as car, cast(ts as timestamp) as fix_at, event_id, 41.5 + cast(user_id % 50 as double) / 100 + cast(extract(day from ts) as double) / 500 + value / 100000 as lat,
  -73.9 + cast(extract(hour from ts) as double) / 1000 as lon,
  case when event_id % 3 = 0 then cast((event_id * 37) % 360 as double) end as gps_heading, case when event_id % 4 < 2 then cast(event_id % 30 as double) end as gps_speed from events""",
    "v_decisions": """select concat('l-', cast(o_orderkey as varchar(20))) as id, case when o_orderkey % 2 = 0 then 'hidden' else 'saved' end as verdict from orders where o_orderkey % 13 = 0""",
    # Pages of sites as an audit meets them: refused, broken, parked, empty, spammed, with calendars of all sorts, and as they are.
    "v_site_pages": """select page_id, url, case page_id % 20 when 0 then cast(null as varchar(20)) when 1 then cast(null as varchar(20)) when 2 then '<html><body>Welcome to nginx! All good.</body></html>' when 3 then '<html><div id="app"></div></html>'
  when 4 then concat('<p>situs slot gacor togel bandar</p>', html) when 5 then concat('<h1>Elsewhere Cinema</h1><p>situs slot gacor togel bandar</p>', html)
  when 6 then concat('<iframe src="https://calendar.google.com/calendar/embed?ctz=x&src=a', cast(page_id as varchar(20)), '%40group.example"></iframe>', html)
  when 7 then concat('<a class="x" href="https://patrons.example.net/calendar?id=', cast(page_id as varchar(20)), '">Our <b>events</b></a><a href="https://www.facebook.com/events/">Events</a>', html)
  when 8 then concat('<script type="application/ld+json">{"@type":"MusicEvent"}</script>', html) when 9 then concat('<p>Concerts: January 3, 2025-02-03 and 4/5</p>', html)
  when 10 then concat('<p>Karaoke on March 3 and 4/5</p><a href="/specials">Deals</a><a href="/events/b">b</a><a href="/events/a/#x">a</a><a href="/events/a/">again</a>', html)
  when 11 then '<html><p>Our events</p><a href="/events/">Calendar</a></html>' when 12 then concat('<p>Workshop every Thursday, doors open at 7 pm, or 8:30 p.m. on Fridays at 9 am</p>', html)
  when 13 then concat('<p>', repeat('中文字', 900), '</p>') when 14 then concat('<div data-tockify-calendar="tock', cast(page_id as varchar(20)), '">tockify.com/town</div><a href="https://hall.libcal.com/x">x</a>', html) else html end as html,
  case page_id % 20 when 0 then 403 when 1 then 500 else 200 end as status from pages""",
    "v_site_names": """select distinct regexp_extract(url, '^[a-z]+://(www[.])?([^/?#]*)', 2) as domain, case when page_id % 2 = 0 then 'Elsewhere Cinema' else 'The Grand Lyceum Hall' end as name from pages""",
    "v_site_feeds": """select regexp_extract(url, '^[a-z]+://(www[.])?([^/?#]*)', 2) as domain, concat('https://feeds.example/', cast(page_id as varchar(20))) as url, case when page_id % 15 = 14 then page_id % 6 else 0 end as n_future from pages""",
    "v_muted": """select concat(c_mktsegment, ' ', cast(c_custkey % 40 as varchar(20))) as venue_key from customer where c_custkey % 97 = 0 group by 1""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, or a table by its own name."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    for t in TABLES:
        if f"from {t}" in text or f"join {t}" in text:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(text)


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the views it uses in front."""
    own = ", ".join(f"{n} as ({VIEWS[n]})" for n in names)
    body = sql.strip()
    return f"with {own}, {body[5:]}" if body.lower().startswith("with ") else f"with {own} {body}"
