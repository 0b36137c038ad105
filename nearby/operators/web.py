"""Pages as evidence: pictures, links, text, calendar platforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearby.functions import site_marks as M
from nearby.functions import text as X


def strip_html(html: Column) -> Column:
    """Visible text: without scripts, styles and tags, runs of spaces squeezed."""
    t = F.regexp_replace(html, r"(?is)<(script|style|noscript)[^>]*>.*?</\1>", " ")
    return F.regexp_replace(X.unescape(F.regexp_replace(t, "<[^>]+>", " ")), r"\s{2,}", " ")


def full_host(url: Column) -> Column:
    """Host with its port, lower-case, ``www.`` and all."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def anchors(url: Column, html: Column) -> Column:
    """Array of (href, label) of a page's links in page order: absolute addresses, labels without tags. Links within the page and to mail, phone or script are none."""
    raw = F.arrays_zip(F.regexp_extract_all(html, F.lit(M.ANCHOR), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(M.ANCHOR), F.lit(2)).alias("label"))
    real = F.filter(raw, lambda a: ~F.lower(F.trim(a["href"])).rlike("^(#|mailto:|tel:|javascript:)"))
    return F.transform(real, lambda a: F.struct(resolve(url, F.trim(a["href"])).alias("href"), F.trim(strip_html(a["label"])).alias("label")))


def links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, pos, href, label, kind, same_site) of a page's links; kind is event, deal or other, by path and label."""
    a = pages.select(key, "url", F.posexplode(anchors(F.col("url"), F.col("html"))).alias("pos", "a")).select(key, "pos", "url", "a.href", "a.label")
    hay = F.concat_ws(" ", X.path(F.col("href")), F.col("label"))
    kind = F.when(X.has(hay, M.EVENT_LINK), "event").when(X.has(hay, M.DEAL_LINK), "deal").otherwise("other")
    return a.select(key, "pos", "href", "label", kind.alias("kind"), (full_host(F.col("href")) == full_host(F.col("url"))).alias("same_site"))


def without_dots(path: Column) -> Column:
    """A path that starts with a slash, with its ``.`` and ``..`` steps taken; none leads above the root."""
    steps = F.split(F.substring(path, F.lit(2), F.length(path)), "/")
    here, up = lambda x: x == ".", lambda x: x == ".."
    taken = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, x: F.when(here(x), acc).when(up(x), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x)))
    last = F.element_at(steps, -1)
    return F.concat(F.lit("/"), F.array_join(F.when(here(last) | up(last), F.array_append(taken, F.lit(""))).otherwise(taken), "/"))


def resolve(base: Column, href: Column) -> Column:
    """The absolute address of a reference on a page, by RFC 3986: other schemes as they are, else scheme, host, path, query and
    fragment, each the reference's own or the page's. Addresses of the web have their dots taken too."""
    of = lambda text, i: F.regexp_extract(text, r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?", i)
    page = F.when(base.contains("://"), base).otherwise(F.concat(F.lit("https://"), base))
    host, path, query, fragment = (of(href, i) for i in (2, 3, 4, 5))
    tidy = lambda p: F.when(p == "", "").when(p.startswith("/"), without_dots(p)).otherwise(p)
    root, home = F.concat(of(page, 1), F.lit("://"), of(page, 2)), of(page, 3)
    folder = F.when(home == "", "/").otherwise(F.regexp_extract(home, r"^(.*/)[^/]*$", 1))
    own_host = href.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//")
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & ~own_host, href)
        .when(own_host, F.concat(F.when(of(href, 1) != "", of(href, 1)).otherwise(of(page, 1)), F.lit("://"), host, tidy(path), query, fragment))
        .when(path == "", F.concat(root, home, F.when(query != "", query).otherwise(of(page, 4)), fragment))
        .otherwise(F.concat(root, without_dots(F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))), query, fragment))
    )


def why_not(url: Column, width: Column) -> Column:
    """Why an address isn't a picture of a place, or null: no web address, an icon's format, a logo's words in its path, a host that has none,
    a width stated by the page or in the address that is too small. The first that holds."""
    host = F.regexp_extract(url, r"^https://([^/?#]*)", 1)
    path = F.lower(F.coalesce(F.try_url_decode(F.regexp_replace(X.path(url), r"\+", "%2B")), X.path(url)))
    icon = F.greatest(*(path.endswith(x) for x in M.ICON_FORMATS))
    said = F.regexp_extract(url, r"[/,_?&](?:w_|width=|w=)(\d+)", 1).try_cast("int")
    return (
        F.when(F.coalesce(host, F.lit("")) == "", "not a web address").when(icon, "icon format").when(X.has(path, M.NOT_A_PICTURE), "looks like a logo")
        .when(F.replace(host, F.lit("www."), F.lit("")).isin(*M.NOT_PICTURE_HOSTS), "facebook asset").when(F.coalesce(width < M.LEAST_WIDTH, F.lit(False)), "too small").when(F.coalesce(said < M.LEAST_WIDTH, F.lit(False)), "too small in the address")
    )


def picture_ok(url: Column, width: Column) -> Column:
    """Whether an address may be a photograph of a place."""
    return F.coalesce(url, F.lit("")).startswith("https://") & why_not(url, width).isNull()


def declared_pictures(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, image, why): the picture that each page's head names, the first of the best key it has, or why it has none.

    Values may stand in quotes of either kind or in none. A link to a picture counts where no key is there. ``og:image:width`` is
    the stated width of the page's picture. If the named picture isn't one of a place, no other is looked for.
    """
    head = F.regexp_extract("html", r"(?is)^(.*?)(?:</head|<body\b|$)", 1)
    tags = pages.select(key, "url", F.posexplode_outer(F.regexp_extract_all(head, F.lit(r"(?is)<(?:meta|link)\b[^>]*>"), F.lit(0))).alias("pos", "m"))
    attr = lambda n: F.coalesce(*(F.nullif(F.regexp_extract("m", rf"""(?is)[\s"']{n}\s*=\s*{v}""", 1), F.lit("")) for v in ('"([^"]*)"', "'([^']*)'", r"""([^\s>"']+)""")), F.lit(""))
    meta = F.lower("m").startswith("<meta")
    name = F.lower(F.when(attr("property") != "", attr("property")).otherwise(attr("name")))
    rank = F.array_position(F.array(*map(F.lit, M.PICTURE_KEYS)), name)
    rank = F.when(meta & (rank > 0), rank).when(~meta & (F.lower(attr("rel")) == "image_src"), len(M.PICTURE_KEYS) + 1)
    value = F.when(meta, attr("content")).otherwise(attr("href"))
    image = F.regexp_replace(resolve(F.col("url"), F.trim(X.unescape(value))), "^http://", "https://")
    found = tags.select(key, "pos", rank.alias("rank"), image.alias("image"), (value != "").alias("said"), F.when(meta & (name == "og:image:width"), F.floor(value.try_cast("double"))).alias("width"))
    best = F.min(F.when((F.col("rank") > 0) & F.col("said"), F.struct("rank", "pos", "image"))).alias("b")
    page = found.groupBy(key).agg(best, F.max_by("width", F.when(F.col("width").isNotNull(), F.col("pos"))).alias("width"))
    why = F.when(F.col("b").isNull(), "no og:image").otherwise(why_not(F.col("b.image"), F.col("width")))
    return page.select(key, F.when(why.isNull(), F.col("b.image")).alias("image"), why.alias("why"))


def page_pictures(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, image) of the pages whose heads name a picture of a place."""
    return declared_pictures(pages, key).where("image is not null").select(key, "image")


def picture_report(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """verdict, why, n: what became of the pages asked for a picture (page); ``answers`` has (page, verdict, why). No answer is ``unread``."""
    j = asked.select("page").join(answers.select("page", "verdict", "why"), "page", "left")
    return j.groupBy(F.coalesce("verdict", F.lit("unread")).alias("verdict"), F.when(F.col("verdict") == "none", F.col("why")).alias("why")).agg(F.count("*").alias("n"))


def feed_address(platform: Column, mark: Column, html: Column) -> Column:
    """The feed that follows from a platform's mark in a page; null where none does."""
    cal, tock = F.trim(F.try_url_decode(mark)), F.regexp_extract(html, r'(?i)data-tockify-calendar="([^"]+)"', 1)
    return (
        F.when((platform == "google") & cal.contains("@"), F.concat(F.lit("https://calendar.google.com/calendar/ical/"), F.replace(F.url_encode(cal), F.lit("+"), F.lit("%20")), F.lit("/public/basic.ics")))
        .when((platform == "libcal") & (mark != ""), F.concat(F.lit("https://"), mark, F.lit("/calendar?cid=-1&t=d&d=0000-00-00&cal=-1&ical=1")))
        .when((platform == "tockify") & (tock != ""), F.concat(F.lit("https://tockify.com/api/feeds/ics/"), tock))
    )


def calendar_platforms(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(domain, platform, key, feed) of each platform a site's pages carry, with the first page that does and the feed its mark leads to.

    Pages with structured events count as ``jsonld``.
    """
    hit = lambda n, p: F.when(X.has(F.col("html"), p), F.struct(F.lit(n).alias("platform"), (F.regexp_extract("html", "(?i)" + p, 1) if "(" in p else F.lit("")).alias("mark")))
    hits = F.explode(F.array_compact(F.array(*(hit(n, p) for n, p in M.PLATFORMS), F.when(X.has(F.col("html"), M.JSONLD_EVENT), F.struct(F.lit("jsonld").alias("platform"), F.lit("").alias("mark")))))).alias("h")
    found = pages.select(X.domain_of(F.col("url")).alias("domain"), key, "html", hits).where("domain is not null")
    found = found.select("domain", key, F.col("h.platform").alias("platform"), feed_address(F.col("h.platform"), F.col("h.mark"), F.col("html")).alias("feed"))
    return found.groupBy("domain", "platform").agg(F.min(key).alias(key), F.min_by("feed", key).alias("feed"))


def best_feed(feeds: DataFrame) -> DataFrame:
    """The feed (domain, path_pos, path, n_future) of each domain with most events ahead, the first of equals."""
    return feeds.groupBy("domain").agg(F.min_by(F.struct("path", "n_future"), F.struct(-F.col("n_future"), F.col("path_pos"))).alias("b")).select("domain", "b.path", "b.n_future")


def venue_domains(places: DataFrame) -> DataFrame:
    """(domain, id): sites of places, each with its first place (smallest id)."""
    return places.select(X.domain_of(F.col("url")).alias("domain"), "id").where("domain is not null").groupBy("domain").agg(F.min("id").alias("id"))
