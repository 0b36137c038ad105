"""The places directory: map elements to rows, events attached, chains, stamps of audits and pictures, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearby.functions import geo
from nearby.functions import vocab as V
from nearby.functions import text as X
from nearby.functions.classify import classify_tags, cuisines, diets, place_kind_by_name, tri_state


def website_of(tags: Column) -> Column:
    """The first of an element's addresses that is one of the web."""
    return F.coalesce(*(F.when(F.regexp_like(tags[k], F.lit("^https?://")), tags[k]) for k in V.WEBSITE_TAGS))


def substantial(kind: Column, tags: Column) -> Column:
    """Whether a named map element is somewhere to go, and not a feature inside another place.

    Food needs something to act on and is no branded fast food. A garden that says it is botanical counts, towers to climb
    do and other towers don't, a park is public land or has an article, a historic thing can be visited and is no road. Other
    thin kinds need a site, an article or a description. All else counts by its kind.
    """
    says = lambda *keys: F.coalesce(reduce(Column.__or__, (F.coalesce(tags[k], F.lit("")) != "" for k in keys)), F.lit(False))
    has_key = lambda *keys: reduce(Column.__or__, (F.coalesce(F.map_contains_key(tags, k), F.lit(False)) for k in keys))
    is_ = lambda key, *values: F.coalesce(tags[key].isin(*values), F.lit(False))
    site = website_of(tags).isNotNull()
    food = says(*V.FOOD_SIGNALS) & ~(is_("amenity", "fast_food") & says(*V.CHAIN_TAGS))
    lookout = is_("tower:type", "observation", "fire") | ~is_("man_made", "tower") & (site | says("wikipedia", "description", "wikidata"))
    worth = (
        F.when(kind.isin(*V.FOOD_KINDS), food).when((kind == "garden") & is_("garden:type", *V.VISITABLE_GARDENS), True).when(kind == "lookout", lookout)
        .when(kind == "park", is_("protection_title", *V.PUBLIC_LAND) | says("wikipedia")).when(kind.isin("historic site", "historic house", "landmark"), ~has_key(*V.LINEAR_TAGS) & says(*V.VISIT_SIGNALS))
        .when(~kind.isin(*V.THIN_KINDS), True).otherwise(site | says("wikidata", "wikipedia", "heritage", "description", "opening_hours", "tourism"))
    )
    return F.coalesce(kind.isin(*V.DESTINATIONS) & worth, F.lit(False))


def osm_places(elements: DataFrame) -> DataFrame:
    """Place rows of map elements (type, id, lat, lon, center, tags): named, with a point (their own or their centre's) and a kind."""
    t = F.col("tags")
    first = lambda *keys: F.coalesce(*(F.nullif(F.trim(t[k]), F.lit("")) for k in keys))
    address = F.nullif(F.concat_ws(" ", first("addr:housenumber"), first("addr:street")), F.lit(""))
    url = first("website", "contact:website", "url")
    # Exploded, tags and kinds are made once for each row, not once for each of the many keys that are asked for.
    df = elements.select(*(c for c in elements.columns if c != "tags"), F.explode(F.array("tags")).alias("tags"))
    df = df.select("*", F.explode(F.array(classify_tags(t))).alias("kinds")).where("size(kinds) > 0")
    lat, lon = F.coalesce("lat", F.col("center.lat")), F.coalesce("lon", F.col("center.lon"))
    out = df.select(
        F.concat_ws("-", F.lit("osm"), "type", F.col("id").cast("string")).alias("id"), first("name").alias("name"), F.get("kinds", 0).alias("kind"), "kinds",
        F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"), first("addr:city").alias("city"), address.alias("address"),
        F.when(url.rlike("^https?://"), url).when(url.isNotNull(), F.concat(F.lit("https://"), url)).alias("url"), first("phone", "contact:phone").alias("phone"),
        first("opening_hours").alias("opening_hours"), first("brand").alias("brand"), t["second_hand"].isin("yes", "only").alias("second_hand"),
        F.when(tri_state(t["fee"]), False).when(~tri_state(t["fee"]), True).alias("free"), tri_state(t["wheelchair"]).alias("wheelchair"), X.describe(first("description")).alias("description"),
        cuisines(t["cuisine"]).alias("cuisine"), diets(t).alias("diet"), tri_state(t["outdoor_seating"]).alias("outdoor_seating"), tri_state(t["takeaway"]).alias("takeaway"), "tags",
    )
    return out.where("name is not null and lat is not null and lon is not null").where(substantial(F.col("kind"), F.col("tags"))).drop("tags")


def unmapped_cuisines(elements: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` most frequent cuisine tokens that no group knows."""
    tokens = elements.select(F.explode(F.split(F.lower(F.col("tags")["cuisine"]), "[;,]")).alias("t")).select(F.regexp_replace(F.trim("t"), " +", "_").alias("token")).where("token <> ''")
    known = [t for ts in V.CUISINE_TOKENS.values() for t in ts]
    return tokens.where(~F.col("token").isin(known)).groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(k)


def attach_events(places: DataFrame, listings: DataFrame, min_events: int = 2, around: tuple[float, float, float] | None = None) -> DataFrame:
    """Places with ``events``, the listings whose venue key is their name, and rows for venues the directory lacks.

    Of places that share a name the first (smallest id) takes the count. A missing venue becomes a row
    if its name says a kind or it has ``min_events`` listings; with ``around`` (lat, lon, miles) only listings in that circle make one.
    Listings without a point count for none. They are counted before any join.
    """
    known = listings.where("venue_key is not null and lat is not null and lon is not null")
    inside = geo.haversine_miles(F.lit(around[0]), F.lit(around[1]), F.col("lat"), F.col("lon")) <= around[2] if around else F.lit(True)
    counts = known.groupBy("venue_key").agg(F.count("*").alias("events"), F.count_if(inside).alias("inside"), F.avg(F.when(inside, F.col("lat"))).alias("v_lat"), F.avg(F.when(inside, F.col("lon"))).alias("v_lon"))
    heads = places.groupBy(F.col("name").alias("h_name")).agg(F.min("id").alias("h_id"))
    named = heads.join(counts, F.col("h_name") == F.col("venue_key")).select("h_id", "events")
    own = places.join(named, F.col("id") == F.col("h_id"), "left").drop("h_id").withColumn("events", F.coalesce("events", F.lit(0)).cast("long"))
    lost = counts.where("inside > 0").drop("events").withColumnRenamed("inside", "events").join(heads.select("h_name"), F.col("venue_key") == F.col("h_name"), "left_anti")
    kind = place_kind_by_name(F.col("venue_key"))
    rows = lost.where(kind.isNotNull() | (F.col("events") >= min_events)).select(F.concat(F.lit("venue-"), X.slug(F.col("venue_key"))).alias("id"), F.col("venue_key").alias("name"), F.coalesce(kind, F.lit("club")).alias("kind"), F.col("v_lat").alias("lat"), F.col("v_lon").alias("lon"), "events")
    return own.withColumn("from_feed", F.lit(False)).unionByName(rows.withColumn("from_feed", F.lit(True)), allowMissingColumns=True)


def place_or_fallback(listings: DataFrame, places: DataFrame) -> DataFrame:
    """venue_key, found, place_id, lat, lon, events for each venue: the directory's row, else one made of its listings."""
    venues = listings.where("venue_key is not null").groupBy("venue_key").agg(F.count("*").alias("events"), F.min_by(F.struct("lat", "lon"), "id").alias("own"))
    heads = places.groupBy(F.col("name").alias("h_name")).agg(F.min(F.struct("id", "lat", "lon")).alias("p"))
    j = venues.join(heads, F.col("venue_key") == F.col("h_name"), "left")
    return j.select("venue_key", F.col("p").isNotNull().alias("found"), F.coalesce("p.id", F.concat(F.lit("venue-"), X.slug(F.col("venue_key")))).alias("place_id"), F.coalesce("p.lat", "own.lat").alias("lat"), F.coalesce("p.lon", "own.lon").alias("lon"), "events")


def mark_chains(places: DataFrame) -> DataFrame:
    """``places`` with ``chain``: the brand, or the brand whose name is exactly the place's."""
    brands = places.where("brand is not null").groupBy(F.lower("brand").alias("b_key")).agg(F.max("brand").alias("b_name"))
    return places.join(brands, F.lower("name") == F.col("b_key"), "left").withColumn("chain", F.coalesce("brand", "b_name")).drop("b_key", "b_name")


def chain_counts(places: DataFrame) -> DataFrame:
    return mark_chains(places).where("chain is not null").groupBy("chain").agg(F.count("*").alias("n"))


def apply_audit(places: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Audit verdicts (domain, verdict, checked) on places by domain: suspect or parked sites lose their url; sites without events say so of places that have none (``none``)."""
    v = verdicts.select("domain", "verdict", "checked")
    j = places.withColumn("_domain", X.domain_of(F.col("url"))).join(v, F.col("_domain") == F.col("domain"), "left")
    quiet = (F.col("verdict") == "none") & (F.coalesce("events", F.lit(0)) == 0)
    out = j.withColumn("event_info", F.when(quiet, "none")).withColumn("event_checked", F.when(quiet, F.col("checked")))
    return out.withColumn("url", F.when(~F.coalesce(F.col("verdict").isin("suspect", "parked"), F.lit(False)), F.col("url"))).drop("_domain", "domain", "verdict", "checked")


def apply_pictures(places: DataFrame, pictures: DataFrame, most: int = 2) -> DataFrame:
    """Page pictures (page, image) on places by page; a picture that more than ``most`` places carry is a logo and goes.

    Bearers are counted by a map-side combined aggregate, so a logo on very many pages is no hot window.
    """
    j = places.withColumn("_page", X.page_key(F.col("url"))).join(pictures.select("page", "image"), F.col("_page") == F.col("page"), "left").drop("page", "_page")
    common = j.where("image is not null").groupBy(F.col("image").alias("_img")).agg(F.count("*").alias("n")).where(F.col("n") > most).select("_img")
    return j.join(common, F.col("image") == F.col("_img"), "left").withColumn("image", F.when(F.col("_img").isNull(), F.col("image"))).drop("_img")


def best_picture(kind: Column, site: Column, wiki: Column) -> Column:
    """Food shows its own page's picture first, all else the encyclopedia's."""
    return F.when(kind.isin(*V.FOOD_KINDS), F.coalesce(site, wiki)).otherwise(F.coalesce(wiki, site))


def apply_items(places: DataFrame, matches: DataFrame, items: DataFrame) -> DataFrame:
    """Encyclopedia fields of the matched item on each place."""
    m = matches.join(items.select("qid", F.col("label").alias("wiki_title"), F.col("image").alias("_image"), F.col("description").alias("wiki_desc")), "qid").select("id", "wiki_title", "_image", "wiki_desc")
    file = F.regexp_replace("_image", " ", "_")
    link = F.when(F.col("_image").isNotNull(), F.concat(F.lit("https://commons.wikimedia.org/wiki/Special:FilePath/"), F.url_encode(file), F.lit("?width=640")))
    return places.join(m, "id", "left").withColumn("wiki_image", link).drop("_image")


def place_summary(places: DataFrame) -> DataFrame:
    """total, kinds, with_events, top_kinds (six, most first)."""
    by_kind = places.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.coalesce("events", F.lit(0)) > 0).alias("e"))
    top = F.transform(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), F.col("kind")))), 1, 6), lambda x: x["kind"])
    return by_kind.agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("e").alias("with_events"), F.array_join(top, ",").alias("top_kinds"))


def food_summary(places: DataFrame) -> DataFrame:
    """Of places that serve food: how many, and the shares that state a cuisine, hours and a chain."""
    f = places.where(F.col("kind").isin(*V.FOOD_KINDS))
    share = lambda c: F.round(100 * F.avg(F.when(c, 1.0).otherwise(0.0)), 1)
    cuisine = F.coalesce(F.size("cuisine") > 0, F.lit(False)) if "cuisine" in f.columns else F.lit(False)
    return f.agg(F.count("*").alias("n"), share(cuisine).alias("with_cuisine"), share(F.col("opening_hours").isNotNull()).alias("with_hours"), share(F.col("brand").isNotNull()).alias("branded"))


def exclude_known(df: DataFrame, known: DataFrame, key: str = "domain") -> DataFrame:
    """The rows of ``df`` whose site isn't among those known already (``known``: key). Rows without one stay."""
    return df.join(known.select(key).distinct(), key, "left_anti")


def place_domains(places: DataFrame, known: DataFrame, k: int = 4) -> DataFrame:
    """domain, n, names (the first ``k`` by id) of sites that ``known`` (domain) lacks. Only ``k`` names of a domain are gathered."""
    d = places.withColumn("domain", X.domain_of(F.col("url"))).where("domain is not null")
    d = exclude_known(d, known)
    n = d.groupBy("domain").agg(F.count("*").alias("n"))
    few = d.withColumn("r", F.row_number().over(Window.partitionBy("domain").orderBy("id"))).where(F.col("r") <= k)
    names = few.groupBy("domain").agg(F.sort_array(F.collect_list(F.struct("r", "name"))).alias("x"))
    return n.join(names, "domain").select("domain", "n", F.array_join(F.transform("x", lambda t: t["name"]), "; ").alias("names"))


def stale(subjects: DataFrame, answers: DataFrame, policy: dict[str, int], as_of: Column, key: str = "domain") -> DataFrame:
    """``subjects`` (key) whose answer (key, verdict, checked) is missing or older than its verdict's days."""
    days = F.create_map(*(F.lit(x) for pair in policy.items() for x in pair))
    j = subjects.join(answers.select(key, "verdict", "checked"), key, "left")
    due = F.col("checked").isNull() | (F.datediff(as_of, "checked") >= F.coalesce(days[F.col("verdict")], F.lit(0)))
    return j.where(due).select(key, "verdict")


#: Days that a price answer holds.
PRICE_DAYS = 30


def price_nodes(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(page, own), (page, sole), (page, sibling): the prices that pages state of themselves, that are a page's only one, and that other pages state."""
    n = nodes.where("price_min is not null").select(X.canon_url(F.col("page_url")).alias("page"), X.canon_url(F.col("node_url")).alias("node"), F.col("price_min").alias("p"))
    own = n.where("node = page").groupBy("page").agg(F.min("p").alias("own"))
    sole = n.groupBy("page").agg(F.count("*").alias("k"), F.min("p").alias("sole")).where("k = 1").select("page", "sole")
    return own, sole, n.where("node <> page").groupBy(F.col("node").alias("page")).agg(F.min("p").alias("sibling"))


def backfill_prices(listings: DataFrame, nodes: DataFrame, answers: DataFrame | None = None, as_of: Column | None = None) -> DataFrame:
    """Unpriced listings take a price, and ``price_from`` says whose: stated, answer, own page, only one, other page, asked none, unknown.

    An answer (``answers``: url, price_min, checked) of up to ``PRICE_DAYS`` days stands before a page's nodes (page_url,
    node_url, price_min). A node about the listing's own address wins; else the only priced node of its page; else the
    lowest of nodes that name it from other pages. A page that was asked and has no price (a fresh answer without one, or
    nodes without one) is ``asked none``, which is an answer. A stated price stays.
    """
    j = listings.withColumn("page", X.canon_url(F.col("url")))
    for part in price_nodes(nodes):
        j = j.join(part, "page", "left")
    asked = nodes.select(X.canon_url(F.col("page_url")).alias("page")).where("page is not null")
    if answers is not None:
        fresh = answers.where(F.datediff(as_of, "checked") < PRICE_DAYS)
        latest = fresh.groupBy(F.col("url").alias("_url")).agg(F.max_by("price_min", "checked").alias("_answer"))
        j = j.join(latest, F.col("url") == F.col("_url"), "left").drop("_url")
        asked = asked.union(fresh.select(X.canon_url(F.col("url"))))
    else:
        j = j.withColumn("_answer", F.lit(None).cast("double"))
    j = j.join(asked.distinct().withColumn("_asked", F.lit(True)), "page", "left")
    said = (("stated", "price_min"), ("answer", "_answer"), ("own page", "own"), ("only one", "sole"), ("other page", "sibling"))
    source = F.coalesce(*(F.when(F.col(c).isNotNull(), n) for n, c in said), F.when(F.col("_asked"), "asked none"), F.lit("unknown"))
    return j.withColumn("price_from", source).withColumn("price_min", F.coalesce(*(c for _, c in said))).drop("page", "own", "sole", "sibling", "_answer", "_asked")


def price_answers(asked: DataFrame, nodes: DataFrame, as_of: Column) -> DataFrame:
    """url, price_min, checked: what to keep of pages asked today (``asked``: url), a null price where they state none."""
    j = asked.select("url").distinct().withColumn("page", X.canon_url(F.col("url")))
    own, sole, _ = price_nodes(nodes)
    return j.join(own, "page", "left").join(sole, "page", "left").select("url", F.coalesce("own", "sole").alias("price_min"), as_of.alias("checked"))


def geocode(candidates: DataFrame, gazetteer: DataFrame, registry: DataFrame | None = None, variants: str = "variants") -> DataFrame:
    """id, lat, lon, precision, reason: the first of a candidate's ordered queries that the gazetteer (query, lat, lon) knows.

    Where none does, the venue of the candidate's source (``registry``: source_id, lat, lon) stands in, with precision null.
    """
    asked = candidates.select("id", F.posexplode_outer(variants).alias("pos", "query"))
    hit = asked.join(gazetteer.select("query", "lat", "lon"), "query").groupBy("id").agg(F.min(F.struct("pos", "lat", "lon")).alias("b"))
    keep = ["source_id"] if registry is not None else []
    out = candidates.select("id", *keep, F.size(variants).alias("n")).join(hit, "id", "left")
    if registry is not None:
        home = registry.where("lat is not null and lon is not null").select("source_id", F.struct("lat", "lon").alias("home"))
        out = out.join(home, "source_id", "left")
    else:
        out = out.withColumn("home", F.lit(None).cast("struct<lat:double,lon:double>"))
    reason = F.when(F.col("b").isNotNull(), "found").when(F.col("home").isNotNull(), "source venue").when(F.col("n") < 1, "no location").otherwise("not found")
    return out.select("id", F.coalesce("b.lat", "home.lat").alias("lat"), F.coalesce("b.lon", "home.lon").alias("lon"), F.col("b.pos").alias("precision"), reason.alias("reason"))
