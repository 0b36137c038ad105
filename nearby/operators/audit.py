"""Audit of venues' sites: does a site say what is on? One verdict for each domain, from its pages.

Pages are measured one by one, where they are; a domain's verdict is a ladder over its front page's measures and over
sums and firsts of all its pages, which are combined before the shuffle, so a hot domain is no hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearby.functions import site_marks as M
from nearby.functions import text as X
from nearby.operators.web import anchors, full_host, strip_html

VERDICTS = tuple(M.RECHECK_DAYS)


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit("(?i)" + pattern))


def candidates(url: Column, html: Column) -> Column:
    """Addresses of same-site pages worth opening, events before deals, each once, in page order."""
    return candidates_of(url, anchors(url, html))


def candidates_of(url: Column, links: Column) -> Column:
    """The same of a page's links."""
    full = F.transform(links, lambda a: F.struct(F.regexp_replace(a["href"], "#.*$", "").alias("href"), a["label"].alias("label")))
    hay = lambda a: F.concat_ws(" ", X.path(a["href"]), a["label"])
    kind = lambda a: X.let(hay(a), lambda h: F.when(X.has(h, M.EVENT_LINK), 1).when(X.has(h, M.DEAL_LINK), 2))

    def kept(page: Column) -> Column:
        own = F.filter(full, lambda a: a["href"].rlike("^https?://") & (full_host(a["href"]) == page["host"]) & (F.regexp_replace(a["href"], "/+$", "") != page["home"]))
        return F.filter(F.transform(own, lambda a: F.struct(a["href"].alias("href"), kind(a).alias("kind"))), lambda a: a["kind"].isNotNull())

    def once(found: Column) -> Column:
        # The first link of an address tells its kind; the order is that of kinds, then of first links.
        firsts = F.transform(F.array_distinct(found["href"]), lambda h: F.element_at(found, F.array_position(found["href"], h).cast("int")))
        of = lambda f, k: F.filter(f, lambda a: a["kind"] == k)["href"]
        return X.let(firsts, lambda f: F.concat(of(f, 1), of(f, 2)))

    return X.let(F.struct(full_host(url).alias("host"), F.regexp_replace(url, "/+$", "").alias("home")), lambda page: X.let(kept(page), once))


def linked_calendars(url: Column, html: Column) -> Column:
    """Addresses of calendars on other hosts that a page links to; social and ticket hosts are none."""
    return linked_of(url, anchors(url, html))


def linked_of(url: Column, links: Column) -> Column:
    """The same of a page's links."""
    skipped = r"^(.*\.)?(" + "|".join(h.replace(".", r"\.") for h in M.SKIP_HOSTS) + ")$"
    bare = lambda u: F.regexp_replace(full_host(u), r"^www\.|:\d*$", "")
    query = lambda a: F.regexp_extract(a["href"], r"\?([^#]*)", 1)
    says = lambda a: X.has(F.concat_ws(" ", X.path(a["href"]), query(a), a["label"]), M.OFFSITE_CALENDAR)
    ok = lambda a, home: a["href"].rlike("^https?://[^/]") & X.let(bare(a["href"]), lambda h: (h != home) & ~h.rlike(skipped)) & says(a)
    return X.let(bare(url), lambda home: F.array_distinct(F.transform(F.filter(links, lambda a: ok(a, home)), lambda a: F.regexp_replace(a["href"], "#.*$", ""))))


def offsite_calendars(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, href) of calendars that a page links to on another host."""
    return pages.select(key, F.explode(linked_calendars(F.col("url"), F.col("html"))).alias("href"))


def signature_of(links: Column) -> Column:
    """A hash of the shape of a site: the paths of its first ``SIGNED`` candidate pages, sorted."""
    paths = F.array_sort(F.array_distinct(F.transform(F.slice(links, 1, M.SIGNED), lambda u: F.lower(F.regexp_replace(X.path(u), "/+$", "")))))
    return F.substring(F.sha1(F.array_join(paths, "\n")), 1, 16)


def platforms_of(html: Column) -> Column:
    """Names of the platforms that a page carries; each is looked for only where a mark of any is."""
    carried = F.array_compact(F.array(*(F.when(X.has(html, p), n) for n, p in M.PLATFORMS)))
    return F.when(X.has(html, M.ANY_PLATFORM), carried).otherwise(F.array().cast("array<string>"))


def signals(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """What each page (key, url, html, and status if known) says about whether anything happens there."""
    status = F.col("status") if "status" in pages.columns else F.lit(None).cast("int")
    once = lambda name, value: F.explode(F.array(value)).alias(name)  # noqa: E731  (exploded, a value is made once whatever is asked of it)
    read = pages.select(key, "url", "html", status.alias("status"), X.domain_of(F.col("url")).alias("domain")).where("domain is not null")
    read = read.select("*", once("_page", F.struct(F.coalesce(strip_html(F.col("html")), F.lit("")).alias("text"), anchors(F.col("url"), F.col("html")).alias("links"))))
    read = read.select("*", F.col("_page.text").alias("text"), once("candidates", candidates_of(F.col("url"), F.col("_page.links"))))
    path, t = F.lower(X.path(F.col("url"))), F.col("text")
    eventish = X.has(path, M.EVENT_LINK) | X.has(t, M.EVENT_WORDS)
    dates = count_of(t, M.DATED) + count_of(t, M.RECURRING) + F.when(eventish, count_of(t, M.CLOCK)).otherwise(0)
    foreign = F.when(t.rlike(M.FOREIGN_SCRIPT), F.regexp_count(t, F.lit(M.FOREIGN_SCRIPT))).otherwise(0) / F.greatest(F.length(t), F.lit(1))
    return read.select(
        key, "url", "status", "domain", F.col("html").isNotNull().alias("answered"), F.length(t).alias("chars"), eventish.alias("eventish"), (X.has(path, M.DEAL_LINK) | X.has(t, M.DEAL_WORDS)).alias("dealish"),
        X.has(path, M.CALENDAR_PATH).alias("calendar_page"), dates.cast("long").alias("dates"), X.has(F.col("html"), M.JSONLD_EVENT).alias("jsonld"), count_of(t, M.SUSPECT).alias("spam"), foreign.alias("foreign"),
        X.has(F.substring(t, 1, 4000), M.PARKED).alias("parked"), F.size("candidates").alias("n_links"), signature_of(F.col("candidates")).alias("sig"), F.lower(F.substring(t, 1, 2000)).alias("head"),
        platforms_of(F.col("html")).alias("platforms"), linked_of(F.col("url"), F.col("_page.links")).alias("linked"), F.struct(F.length(path), F.col(key)).alias("place"),
    )


def site_signature(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(domain, sig) of each site's front page: the page with the shortest path, the first of equals."""
    c = pages.where("html is not null").select(X.domain_of(F.col("url")).alias("domain"), signature_of(candidates(F.col("url"), F.col("html"))).alias("sig"), F.struct(F.length(X.path(F.col("url"))), F.col(key)).alias("place"))
    return c.where("domain is not null").groupBy("domain").agg(F.min_by("sig", "place").alias("sig"))


def with_named(fronts: DataFrame, names: DataFrame) -> DataFrame:
    """``fronts`` (domain, front with a head) and whether its text says a name (domain, name) of theirs: two of its telling words, or the
    only one. A site's row meets its names where it is, so pages are measured once."""
    words = F.filter(F.regexp_extract_all(F.lower("name"), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) >= 4) & ~w.isin(*M.NAME_STOPWORDS))
    told = names.where("name is not null").select("domain", words.alias("_words")).where("size(_words) > 0").distinct()
    hit = X.let(F.regexp_extract_all("front.head", F.lit("[a-z0-9_]+"), F.lit(0)), lambda said: F.size(F.filter("_words", lambda w: F.array_contains(said, w))) >= F.least(F.lit(2), F.size("_words")))
    met = fronts.join(told, "domain", "left").withColumn("_named", F.col("_words").isNotNull() & hit)
    rest = [c for c in fronts.columns if c != "domain"]
    return met.groupBy("domain").agg(F.first(F.struct(*rest)).alias("_site"), F.max("_named").alias("named")).select("domain", *(F.col(f"_site.{c}") for c in rest), "named")


def named_sites(fronts: DataFrame, names: DataFrame) -> DataFrame:
    """Domains of ``fronts`` (domain, head) whose text says a name of theirs."""
    return with_named(fronts.select("domain", F.struct("head").alias("front")), names).where("named").select("domain").distinct()


def audit_domains(pages: DataFrame, names: DataFrame | None = None, feeds: DataFrame | None = None, key: str = "page_id") -> DataFrame:
    """domain, pages, verdict, found, sig, url, spammed, note: what a site's pages say about events, and why.

    ``names`` (domain, name) are the venues of a site, ``feeds`` (domain, url, n_future) the calendar feeds that it answers
    with; a feed counts only where nothing else is found. A site's front page is that of the shortest path.
    """
    p = signals(pages, key)
    listing = F.col("eventish") & (F.col("dates") >= F.when(F.col("calendar_page"), M.CALENDAR_DATES).otherwise(M.LISTING_DATES))
    first = lambda cond: F.min(F.when(cond, F.struct("place", "url")))
    front = F.struct("url", "status", "answered", "chars", "spam", "foreign", "parked", "n_links", "sig", "head", "platforms", "linked")
    thin = (F.col("calendar_page") | F.col("eventish")) & (F.col("chars") < M.THIN_PAGE) & (F.col("dates") == 0)
    read = F.col("answered")
    d = p.groupBy("domain").agg(
        F.count("*").alias("pages"), F.min_by(front, F.struct(~F.col("answered"), F.col("place"))).alias("front"), first(read & F.col("jsonld")).alias("jsonld"), first(read & listing).alias("listing"),
        F.bool_or(read & F.col("dealish") & (F.col("dates") >= M.DEAL_DATES)).alias("deals"), F.min(F.when(read & thin, F.struct("place", "calendar_page"))).alias("thin_page"),
    )
    d = d.withColumn("thin", F.col("thin_page").isNotNull())
    if names is not None:
        d = with_named(d, names)
    else:
        d = d.withColumn("named", F.lit(False))
    if feeds is not None:
        best = feeds.where("n_future > 0").groupBy("domain").agg(F.min_by("url", F.struct(-F.col("n_future"), F.col("url"))).alias("feed"), F.max("n_future").alias("n_future"))
        d = d.join(best, "domain", "left")
    else:
        d = d.withColumn("feed", F.lit(None).cast("string")).withColumn("n_future", F.lit(None).cast("long"))
    f, end = F.col("front"), F.regexp_extract("domain", r"([^.]*)$", 1)
    spammed = f["spam"] >= M.SPAM_HITS
    foreign = (f["foreign"] > M.FOREIGN_SHARE) & ~((F.length(end) == 2) & (end != "us"))
    found = F.concat(
        F.transform(f["platforms"], lambda n: F.concat(n, F.lit(" embed"))), F.array_compact(F.array(
            F.when(F.size(f["linked"]) > 0, "linked calendar"), F.when(F.col("jsonld").isNotNull(), "schema.org events"), F.when(F.col("listing").isNotNull(), "dated listings"), F.when(F.col("deals"), "dated specials"))),
    )
    hijacked = (spammed | foreign) & ~F.coalesce("named", F.lit(False))
    verdict = (
        F.when(~f["answered"], F.when(f["status"].isin(*M.BLOCKED), "blocked").otherwise("unreachable")).when(f["parked"], "parked").when((f["chars"] < M.SHELL) & (f["n_links"] == 0), "unreadable").when(hijacked, "suspect")
        .when((F.size("found") == 0) & F.col("feed").isNotNull(), "feed").when((F.size("found") == 0) & F.col("thin"), "unreadable").when(F.size("found") == 0, "none")
        .when(F.array_join("found", "|") == "dated specials", "specials").otherwise("listings")
    )
    d = d.withColumn("found", found).withColumn("verdict", verdict)
    shown = F.col("verdict").isin("none", "specials", "listings")
    best_url = F.coalesce(F.when(F.size(f["platforms"]) > 0, f["url"]), F.get(f["linked"], 0), F.col("jsonld.url"), F.col("listing.url"), f["url"])
    return d.select(
        "domain", "pages", "verdict", F.when(F.col("verdict") == "suspect", F.array(F.lit("off-topic content"))).when(F.col("verdict") == "feed", F.array(F.lit("ical feed"))).when(shown, F.col("found")).otherwise(F.array().cast("array<string>")).alias("found"),
        F.when(shown | (F.col("verdict") == "feed") | (F.col("verdict") == "unreadable") & ((f["chars"] >= M.SHELL) | (f["n_links"] > 0)), f["sig"]).alias("sig"),
        F.when(F.col("verdict") == "feed", F.col("feed")).when(F.col("verdict").isin("listings", "specials"), best_url).when(F.col("verdict").isin("parked", "suspect", "unreadable"), f["url"]).alias("url"), (spammed & shown).alias("spammed"), note_of(F.col("verdict"), f["status"], F.col("n_future"), F.col("pages"), (f["chars"] < M.SHELL) & (f["n_links"] == 0), F.col("thin_page.calendar_page")).alias("note"),
    )


def note_of(verdict: Column, status: Column, n_future: Column, pages: Column, shell: Column, calendar: Column) -> Column:
    """Why a site has its verdict, in a few words; null for sites with listings or specials."""
    said = lambda *parts: F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in parts))
    drawn = "drawn in the browser, nothing to read"
    return (
        F.when(verdict == "blocked", said("HTTP ", status.cast("string"), " to a declared reader")).when(verdict == "unreachable", said("no answer", F.coalesce(said(" (", status.cast("string"), ")"), F.lit(""))))
        .when(verdict == "parked", "a page of the server or registrar").when(verdict == "suspect", "what it shows isn't the venue's").when(verdict == "feed", said(n_future.cast("string"), " events ahead in its feed"))
        .when((verdict == "unreadable") & ~shell & F.coalesce(calendar, F.lit(False)), "its events page is " + drawn).when(verdict == "unreadable", drawn).when(verdict == "none", said(pages.cast("string"), " pages without dates or a calendar"))
    )


def audit_progress(verdicts: DataFrame, domains: DataFrame) -> DataFrame:
    """One row: how many of the directory's sites (``domains``: domain) have a verdict, how many haven't yet, and how many verdicts are on file."""
    asked = domains.select("domain").where("domain is not null").distinct().join(verdicts.select("domain", F.lit(True).alias("_done")).distinct(), "domain", "left")
    counts = asked.agg(F.count_if("_done").alias("done"), F.count_if(F.col("_done").isNull()).alias("to_go")).withColumn("_one", F.lit(1))
    return counts.join(verdicts.agg(F.count("*").alias("on_file")).withColumn("_one", F.lit(1)), "_one").drop("_one")


def audit_leads(verdicts: DataFrame, places: DataFrame | None = None, k: int = 2) -> DataFrame:
    """domain, lead, detail: what an audit leaves to do. ``feed`` with its address is worth registering, ``spammed`` is worth telling the
    site, ``bad`` names the first ``k`` places (``places``: domain, name) whose link leads to something else now."""
    lead = lambda when, name, detail=None: F.when(when, F.struct(F.lit(name).alias("lead"), F.lit(detail).cast("string").alias("detail") if detail is None else detail.alias("detail")))
    v = F.col("verdict")
    leads = F.array_compact(F.array(lead(v == "feed", "feed", F.col("url")), lead(F.col("spammed"), "spammed"), lead(v.isin("suspect", "parked"), "bad")))
    out = verdicts.select("domain", F.explode(leads).alias("l")).select("domain", "l.lead", "l.detail")
    if places is None:
        return out
    few = places.select("domain", "name").distinct().withColumn("_nth", F.row_number().over(Window.partitionBy("domain").orderBy("name"))).where(F.col("_nth") <= k)
    few = few.groupBy("domain").agg(F.array_join(F.sort_array(F.collect_list("name")), "; ").alias("_names")).withColumn("lead", F.lit("bad"))
    return out.join(few, ["domain", "lead"], "left").select("domain", "lead", F.coalesce("detail", "_names").alias("detail"))


def changed_sites(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Domains that were quiet (verdict none) and whose signature is another now."""
    return stored.where("verdict = 'none'").select("domain", F.col("sig").alias("old")).join(new, "domain").where("sig <> old").select("domain", "sig")


def audit_report(verdicts: DataFrame) -> DataFrame:
    """verdict, n, pages, spammed, recheck_days: how many sites have each verdict, and when they are read again."""
    days = F.create_map(*(F.lit(x) for pair in M.RECHECK_DAYS.items() for x in pair))
    return verdicts.groupBy("verdict").agg(F.count("*").alias("n"), F.sum("pages").alias("pages"), F.count_if("spammed").alias("spammed")).withColumn("recheck_days", days[F.col("verdict")])
