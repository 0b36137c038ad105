"""Queries of answers kept from sites (prices, pictures, links, grids of showtimes), of the directory's ladder, and of the refresh, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from nearby.functions import classify as C
from nearby.functions import text as X
from nearby.operators import listings as L
from nearby.operators import places, resolve, search, web
from nearby.plans.fixtures import view
from nearby.plans.queries_search import CLUSTERS, NORM, STOP, haversine, listings, query, rich, two
from nearby.sources import shapes
from nearby.streaming import refresh

#: Answers to questions for prices in the order they were asked; some hosts answer rarely.
LOG = "select concat('pay', cast(o_orderkey % 37 as varchar(20)), '.example') as host, o_orderdate as asked_at, o_orderkey as n, case when (o_orderkey * 13) % (o_orderkey % 37 + 2) = 0 then 5.0e0 end as price_min from orders"


def answers_log(s, d):
    view(s, d, "orders").createOrReplaceTempView("orders")
    return s.sql(LOG)


TRAILING = f"lg as ({LOG}), ht as (select host, max((asked_at, n)) as h from lg where price_min is not null group by 1), ms as (select lg.host, count(*) filter (where price_min is null and (h is null or (asked_at, n) > h)) as misses from lg left join ht on lg.host = ht.host group by 1)"


@query("trailing_misses", f"with {TRAILING} select host, misses from ms")
def _(s, d):
    return L.trailing_misses(answers_log(s, d))


@query("price_worklist_budget", f"""with {TRAILING}, p as (select *, 'http://' || case when o_orderkey % 50 = 7 then 'www.ticketmaster.com' else 'pay' || (o_orderkey % 37) || '.example' end || '/e/' || (o_orderkey % 400) as url from v_listings), c as (select * from p where price_min is null and start_at::date >= date '1996-01-01' and url not like '%ticketmaster%'), w as (select venue_key, count(*) as weight from c group by 1),
t as (select url, max(weight) as weight, min(start_at) as start_at from c join w using (venue_key) where (o_orderkey % 400) % 4 <> 0 and regexp_extract(url, '//([^/]*)', 1) not in (select host from ms where misses >= 3) group by url) select url, weight from t order by weight desc, start_at, url limit 200""", "v_listings")
def _(s, d):
    k = F.col("o_orderkey")
    host = F.when(k % 50 == 7, "www.ticketmaster.com").otherwise(F.concat(F.lit("pay"), (k % 37).cast("string"), F.lit(".example")))
    df = listings(s, d).withColumn("url", F.concat(F.lit("http://"), host, F.lit("/e/"), (k % 400).cast("string")))
    # an answer without a price is an answer: it isn't asked again while fresh
    cache = df.select("url", (k % 400).alias("e")).distinct().select("url", F.when(F.col("e") % 4 == 0, F.lit("1995-12-20")).otherwise("1990-01-01").cast("date").alias("checked"))
    return L.price_worklist(df, cache, F.lit("1996-01-01").cast("date"), 200, log=answers_log(s, d), most_misses=3).select("url", "weight")


PAID = "concat('https://pay.example/e/', cast(o_orderkey % 500 as varchar(20)))"
NODES = "select concat('http://www.pay.example/e/', cast(o_orderkey % 350 as varchar(20)), '/') as page_url, concat('https://pay.example/e/', cast((o_orderkey * 7) % 500 as varchar(20)), '?utm=1') as node_url, case when o_orderkey % 40 = 0 then floor(o_totalprice / 10) / 1e2 end as price_min from orders where o_orderkey % 9 <> 0"
ANSWERS = "select distinct concat('https://pay.example/e/', cast(o_orderkey % 500 as varchar(20))) as url, case when o_orderkey % 500 % 3 = 0 then cast(o_orderkey % 500 as double) end as price_min, case when o_orderkey % 500 % 2 = 0 then date '1995-12-20' else date '1995-11-01' end as checked from orders where o_orderkey % 500 % 7 = 0"


@query("price_sources", f"""with nd as ({NODES}), pg as (select 'pay.example/e/' || regexp_extract(page_url, '([0-9]+)/$', 1) as page, 'pay.example/e/' || regexp_extract(node_url, '/([0-9]+)[?]', 1) as node, price_min as p from nd),
o as (select page, min(p) as own from pg where node = page and p is not null group by 1), so as (select page, min(p) as sole from pg where p is not null group by 1 having count(*) = 1), sb as (select node as page, min(p) as sibling from pg where node <> page and p is not null group by 1),
aw as ({ANSWERS}), fr as (select url, price_min as answer, 'pay.example/e/' || regexp_extract(url, '([0-9]+)$', 1) as page from aw where date '1996-01-01' - checked < 30), asked as (select page from pg union select page from fr),
j as (select l.id, l.price_min, fr.answer, own, sole, sibling, asked.page is not null as asked from (select *, {PAID} as url, 'pay.example/e/' || (o_orderkey % 500) as page from v_listings) l left join fr on fr.url = l.url left join o on o.page = l.page left join so on so.page = l.page left join sb on sb.page = l.page left join asked on asked.page = l.page)
select id, coalesce(price_min, answer, own, sole, sibling) as price_min, case when price_min is not null then 'stated' when answer is not null then 'answer' when own is not null then 'own page' when sole is not null then 'only one' when sibling is not null then 'other page' when asked then 'asked none' else 'unknown' end as price_from from j""", "v_listings")
def _(s, d):
    view(s, d, "orders").createOrReplaceTempView("orders")
    ls = listings(s, d).withColumn("url", F.expr(PAID.replace("varchar(20)", "string")))
    return places.backfill_prices(ls, s.sql(NODES), s.sql(ANSWERS), F.lit("1996-01-01").cast("date")).select("id", "price_min", "price_from")


@query("price_answers", f"""with nd as ({NODES}), pg as (select 'pay.example/e/' || regexp_extract(page_url, '([0-9]+)/$', 1) as page, 'pay.example/e/' || regexp_extract(node_url, '/([0-9]+)[?]', 1) as node, price_min as p from nd), o as (select page, min(p) as own from pg where node = page and p is not null group by 1), so as (select page, min(p) as sole from pg where p is not null group by 1 having count(*) = 1)
select url, coalesce(own, sole) as price_min, '1996-01-01' as checked from (select distinct page_url as url, 'pay.example/e/' || regexp_extract(page_url, '([0-9]+)/$', 1) as page from nd) left join o using (page) left join so using (page)""")
def _(s, d):
    view(s, d, "orders").createOrReplaceTempView("orders")
    n = s.sql(NODES)
    return places.price_answers(n.select(F.col("page_url").alias("url")), n, F.lit("1996-01-01").cast("date"))


#: A month's grid: two cards on days that are multiples of three, one without an address, one without a title.
def grid_pages(s, d):
    n = F.col("page_id").cast("string")
    quoted = lambda text: F.replace(F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    whole = F.concat(F.lit('<h2>Film &amp; <i>"'), n, F.lit('"</i></h2><a href="https://screen.example/movies/f-'), n, F.lit('">more</a><span class="show__subtitle"><p>With a talk</p></span><span class="showtime sold">7:15 p.m</span><span class="showtime">12:05 AM</span><span class="showtime">25:99 PM</span>'))
    lost = F.lit('<h2>No address</h2><span class="showtime">1:00 PM</span>')
    nameless = F.concat(F.lit('<a href="https://screen.example/movies/x-'), n, F.lit('">x</a><span class="showtime">2:00 PM</span>'))
    card = lambda c: F.concat(F.lit('<div data-show-card="'), quoted(c), F.lit('"></div>'))
    day = lambda k: F.concat(F.lit(f'<td id="calendar-day-2024-05-{k:02}">'), *([card(whole), card(lost), card(nameless)] if k % 3 == 0 else [F.lit("&nbsp;")]), F.lit("</td>"))
    return view(s, d, "pages").withColumn("html", F.concat(*(day(k) for k in range(1, 10)), F.lit('<div class="calendar-footer">'), card(whole), F.lit("</div>"), F.coalesce("html", F.lit(""))))


@query("month_grid", """select page_id, (date '2024-05-01' + (3 * k - 1)::int)::varchar as day, 'Film & "' || page_id || '"' as title, 'https://screen.example/movies/f-' || page_id as url, 'With a talk' as note, timestamp '2024-05-01 00:00:00' + to_days((3 * k - 1)::int) + to_minutes(m) as starts from pages, range(1, 4) t(k), (values (1155), (5)) z(m)""")
def _(s, d):
    return shapes.month_grid(grid_pages(s, d))


REFS = ("?p=2", "../x", "./x", "x/../../y", "/a/./b/..", "#top", "//other.example/p?q", "mailto:x@y", "z;v=1?w#f")


@query("link_resolution", """with b as (select page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') as root from pages)
select page_id, i, case i when 0 then root || '/b/c?p=2' when 1 then root || '/x' when 2 then root || '/b/x' when 3 then root || '/y' when 4 then root || '/a/' when 5 then root || '/b/c?q=' || page_id || '#top' when 6 then regexp_extract(root, '^[a-z]+') || '://other.example/p?q' when 7 then 'mailto:x@y' else root || '/b/z;v=1?w#f' end as href from b, range(0, 9) t(i)""")
def _(s, d):
    p = view(s, d, "pages").select("page_id", F.concat(F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0), F.lit("/b/c?q="), F.col("page_id").cast("string")).alias("base"), F.posexplode(F.array(*map(F.lit, REFS))).alias("i", "ref"))
    return p.select("page_id", F.col("i").cast("long").alias("i"), web.resolve(F.col("base"), F.col("ref")).alias("href"))


#: What a page's head says of its picture, and the answer.
HEADS = (
    ('<meta property=og:image content=https://img.example/a.jpg>', None), ('<meta property="og:image" content="/pics/a.jpg">', None), ("<link rel='image_src' href='b.png'>", None), ('<meta name="description" content="x">', "no og:image"),
    ('<meta property="og:image" content="https://logo-cdn.example/iconic-view.jpg">', None), ('<meta property="og:image" content="https://img.example/site-icon.png">', "looks like a logo"), ('<meta property="og:image" content="https://img.example/stock/a.jpg">', "looks like a logo"),
    ('<meta property="og:image" content="https://www.facebook.com/a.jpg">', "facebook asset"), ('<meta property="og:image" content="https://img.example/fill/w_20,h_14/a.jpg">', "too small in the address"), ('<meta property="og:image" content="https://img.example/a.jpg?width=900">', None),
    ('<meta property="og:image" content="https://img.example/a.svg">', "icon format"), ('<meta property="og:image" content="https://img.example/a.jpg"><meta property="og:image:width" content="120.0">', "too small"), ('<meta property="og:image" content="data:image/png;base64,AA">', "not a web address"),
    ('<meta name="twitter:image" content="https://img.example/t.jpg"><meta property="og:image" content="http://img.example/o.jpg">', None),
)
IMAGES = {0: "'https://img.example/a.jpg'", 1: "root || '/pics/a.jpg'", 2: "root || '/b.png'", 4: "'https://logo-cdn.example/iconic-view.jpg'", 9: "'https://img.example/a.jpg?width=900'", 13: "'https://img.example/o.jpg'"}


@query("picture_reasons", f"""with b as (select page_id, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*'), '^http:', 'https:') as root, page_id % {len(HEADS)} as k from pages)
select page_id, case k {' '.join(f'when {k} then {x}' for k, x in IMAGES.items())} end as image, case k {' '.join(f"when {k} then '{why}'" for k, (_, why) in enumerate(HEADS) if why)} end as why from b""")
def _(s, d):
    n = (F.col("page_id") % len(HEADS)).cast("int")
    head = F.get(F.array(*(F.lit(h) for h, _ in HEADS)), n)
    p = view(s, d, "pages").select("page_id", F.concat(F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0), F.lit("/")).alias("url"), F.concat(F.lit("<head>"), head, F.lit("</head><body><meta property='og:image' content='https://img.example/late.jpg'>")).alias("html"))
    return web.declared_pictures(p)


#: Elements of a map and whether they are somewhere to go.
ELEMENTS = (
    ({"leisure": "garden"}, False), ({"leisure": "garden", "garden:type": "botanical"}, True), ({"leisure": "garden", "website": "garden.example"}, False), ({"leisure": "garden", "website:official": "https://garden.example"}, True), ({"tourism": "viewpoint"}, False),
    ({"tourism": "viewpoint", "description": "wide"}, True), ({"tourism": "viewpoint", "man_made": "tower", "wikipedia": "en:x"}, False), ({"tourism": "viewpoint", "man_made": "tower", "tower:type": "observation"}, True), ({"leisure": "park", "wikidata": "Q1"}, False),
    ({"leisure": "park", "wikipedia": "en:x"}, True), ({"leisure": "park", "protection_title": "State Park"}, True), ({"leisure": "park", "protection_title": "Watershed Recreation Unit"}, False), ({"historic": "fort", "wikidata": "Q1"}, False), ({"historic": "fort", "fee": "yes"}, True),
    ({"historic": "fort", "fee": "yes", "highway": "track"}, False), ({"tourism": "museum"}, True), ({"amenity": "restaurant"}, False), ({"amenity": "restaurant", "addr:street": "Main"}, False), ({"amenity": "restaurant", "cuisine": "thai"}, True),
    ({"amenity": "fast_food", "cuisine": "burger", "brand:wikidata": "Q2"}, False), ({"amenity": "fast_food", "cuisine": "seafood"}, True), ({"shop": "antiques"}, True),
)


@query("destinations", f"select concat('osm-node-', c_custkey) as id from v_places where c_custkey % {len(ELEMENTS)} in ({', '.join(str(i) for i, (_, ok) in enumerate(ELEMENTS) if ok)})", "v_places")
def _(s, d):
    tags = F.array(*(F.create_map(*(F.lit(x) for pair in {"name": "A place", **t}.items() for x in pair)) for t, _ in ELEMENTS))
    e = view(s, d, "v_places").select(F.lit("node").alias("type"), F.col("c_custkey").alias("id"), "lat", "lon", F.lit(None).cast("struct<lat:double,lon:double>").alias("center"), F.get(tags, (F.col("c_custkey") % len(ELEMENTS)).cast("int")).alias("tags"))
    return places.osm_places(e).select("id")


@query("search_food", """select id from v_places where kind = 'restaurant' and brand is null and (contains(lower(name), 'thai') or contains(lower(city), 'thai') or c_custkey % 4 = 0) and c_custkey % 6 in (0, 2, 4)""", "v_places")
def _(s, d):
    n = F.col("c_custkey")
    cuisine = F.when(n % 4 == 0, F.array(F.lit("pizza"), F.lit("thai"))).when(n % 4 == 1, F.array(F.lit("asian")))
    p = view(s, d, "v_places").withColumn("cuisine", cuisine).withColumn("minutes_left", F.when(n % 6 != 5, F.when(n % 2 == 0, 30.0).otherwise(0.0)))
    return search.search_places(p, search.PlaceQuery(scope="eat", independents=True, open_now=True, text=" Thai ")).select("id")


@query("new_domains", "select distinct 'site' || (c_custkey % 300) || '.example.com' as domain from v_places where url is not null and c_custkey % 300 % 16 <> 0", "v_places")
def _(s, d):
    sites = view(s, d, "v_places").select(X.domain_of(F.col("url")).alias("domain")).where("domain is not null").distinct()
    known = s.range(0, 300, 16).select(F.concat(F.lit("site"), F.col("id").cast("string"), F.lit(".example.com")).alias("domain"))
    return places.exclude_known(sites, known.union(known))


@query("feed_only_venues", f"""with l as (select *, {haversine('41.5', '-73.9', 'lat', 'lon')} <= 40 as near from v_listings where venue_key like '% 5'), c as (select venue_key as vk, count(*) filter (where near) as events from l group by 1)
select 'venue-' || trim(regexp_replace(lower(vk), '[^a-z0-9]+', '-', 'g'), '-') as id, events from c where events >= 2""", "v_listings")
def _(s, d):
    ls = listings(s, d).where("venue_key like '% 5'")
    return places.attach_events(view(s, d, "v_places").where("name not like '% 5'"), ls, around=(41.5, -73.9, 40.0)).where("from_feed").select("id", "events")


@query("descriptions", """select c_custkey, case cast(c_custkey % 3 as int) when 0 then 'A quiet place by the river.' when 1 then 'Plain & simple' else null end as text from customer""")
def _(s, d):
    k = F.col("c_custkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit("<p>A quiet  place by the river.</p> https://x.example/"), k.cast("string"))).when(k % 3 == 1, "Plain &amp;amp; <b>simple</b>").otherwise("http://only.example/a?b=c")
    return view(s, d, "customer").select("c_custkey", X.describe(raw).alias("text"))


@query("buildings", """select c_custkey, case cast(c_custkey % 5 as int) when 0 then 'Howland Library' when 1 then 'Howland Library' when 2 then 'Room 12' when 3 then 'Beacon Theatre' else 'Grange Hall' end as building from customer""")
def _(s, d):
    k = F.col("c_custkey")
    pick = lambda *x: F.get(F.array(*map(F.lit, x)), (k % 5).cast("int"))
    venue = pick("Room 12, Howland Library", "Room 12", "Room 12", "Beacon Theatre", "Grange Hall")
    host, address = pick("Somebody", "Howland Library", None, None, "Somebody Else"), pick(None, None, None, "1 Main St", "5 Elm St")
    return view(s, d, "customer").select("c_custkey", X.building_of(venue, host, address).alias("building"))


@query("audiences", """select c_custkey, case cast(c_custkey % 5 as int) when 0 then 'family' when 1 then 'adults' when 2 then 'seniors' else 'all' end as audience from customer""")
def _(s, d):
    k = F.col("c_custkey")
    pick = lambda *x: F.get(F.array(*map(F.lit, x)), (k % 5).cast("int"))
    title = pick("Story time for toddlers", "Wine tasting, 21+", "Senior citizens' lunch", "Jazz concert", "Open house")
    text = pick("Songs and crafts for kids", "For ages 21 and over", "For seniors aged 60 and up", "$20, seniors and students $10", "All are welcome")
    return view(s, d, "customer").select("c_custkey", C.audience_of(F.concat_ws(" ", title, text), title, F.lit("talk")).alias("audience"))


#: All orders of two months at one of three places, and so in few, crowded blocks.
CROWD = """select id, title, 41.5 + (o_orderkey % 3) / 10.0 as lat, -73.9 as lon, cast(date '1995-01-01' as timestamp) + to_days((o_orderkey % 40)::int) as start_at, cast(null as timestamp) as end_at, o_orderkey from v_listings"""


@query("crowded_duplicates", f"""with c as ({CROWD}), sp as (select id, lat, start_at::date as d0, {NORM.format('title')} as nt from c), one as (select lat, d0, nt, min(id) as id, list_distinct(list_filter(string_split(nt, ' '), lambda w: length(w) > 2 and not list_contains({STOP}, w))) as tk from sp group by lat, d0, nt)
select least(a.id, b.id) as a, greatest(a.id, b.id) as b from one a join one b on a.d0 = b.d0 and a.lat = b.lat and a.id < b.id where (a.nt <> '' and b.nt <> '' and (contains(a.nt, b.nt) or contains(b.nt, a.nt))) or (len(a.tk) > 0 and len(b.tk) > 0 and len(list_intersect(a.tk, b.tk)) / (len(list_distinct(list_concat(a.tk, b.tk))))::double >= 0.6)
union all select one.id, sp.id from sp join one using (lat, d0, nt) where sp.id <> one.id""", "v_listings")
def _(s, d):
    k = F.col("o_orderkey")
    start = F.date_add(F.lit("1995-01-01").cast("date"), (k % 40).cast("int")).cast("timestamp_ntz")
    ls = listings(s, d).select("id", "title", (41.5 + (k % 3) / 10.0).alias("lat"), F.lit(-73.9).alias("lon"), start.alias("start_at"), F.lit(None).cast("timestamp_ntz").alias("end_at"))
    return resolve.class_links(ls)


@query("refreshed_table", f"""with {CLUSTERS}, x as (select t.*, coalesce(c.cluster, t.id) as cluster, case when end_at is not null then 1 else 0 end as rich, t.id like 'l-%' as held from two t left join comp c on t.id = c.n),
r as (select *, row_number() over (partition by cluster order by rich desc, held desc, o_orderkey, id) as k from x),
h as (select cluster, arg_min(id, (o_orderkey, id)) filter (where held) as hid, arg_min(id, (o_orderkey, id)) as eid, arg_min(end_at, k) filter (where not held and end_at is not null) as new_end from r group by cluster)
select coalesce(hid, eid) as id, r.title, case when r.held then coalesce(r.end_at, new_end) else r.end_at end as end_at from r join h using (cluster) where k = 1""", "v_listings")
def _(s, d):
    """A table of blocks, refreshed by a batch in the shared folder."""
    from uuid import uuid4

    from nearby.plans.session import shared_dir

    t = two(s, d)
    folder = f"{shared_dir(s).rstrip('/')}/refresh-{uuid4().hex}"
    refresh.start(t.where("id like 'l-%'"), folder)
    refresh.refresh(folder, 0, t.where("id like 'm-%'"), X.richness({"end": F.col("end_at")}), F.col("o_orderkey"), ["end_at"])
    out = refresh.newest(s, folder).select("id", "title", "end_at").checkpoint()
    fs, path = refresh.folders(s, folder)
    fs.delete(path(folder), True)
    return out
