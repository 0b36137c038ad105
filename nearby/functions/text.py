"""Text, names, addresses and scores as columns. Nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearby.functions import vocab as V


def has(text: Column, pattern: str, fold: bool = True) -> Column:
    """Whether a text matches; a null text doesn't."""
    return F.coalesce(text.rlike(("(?iu)" if fold else "") + pattern), F.lit(False))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once for each row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def norm_title(title: Column) -> Column:
    """Lower case, without brackets, numbering and punctuation."""
    t = F.regexp_replace(F.lower(title), r"\(.*?\)", "")
    t = F.regexp_replace(t, r"\b(session|part|day|week|no\.?|#)\s*\d+\b", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[^a-z0-9 ]+", " "), " +", " "))


def norm_name(name: Column) -> Column:
    """A place's name for comparison: lower-case letters and digits between single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", " "))


def title_tokens(title: Column) -> Column:
    return norm_tokens(norm_title(title))


def norm_tokens(norm: Column) -> Column:
    """The words of a title that ``norm_title`` has been through."""
    words = F.array_distinct(F.split(norm, " "))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*V.TITLE_STOP_WORDS))


def name_tokens(name: Column, least: int, generic: tuple[str, ...]) -> Column:
    """Distinctive words of a name."""
    words = F.array_distinct(F.split(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", " "), " "))
    return F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*generic))


def item_tokens(title: Column) -> Column:
    return name_tokens(F.regexp_replace(title, r"\([^)]*\)", " "), 4, V.ITEM_GENERIC)


def rating_tokens(name: Column) -> Column:
    return name_tokens(name, 3, V.NAME_GENERIC)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def norms_match(na: Column, nb: Column, ta: Column, tb: Column) -> Column:
    """Whether two titles are of one event, by their normal forms and words: equal, one in the other, or mostly the same words."""
    inside = (na != "") & (nb != "") & (na.contains(nb) | nb.contains(na))
    return (na == nb) | inside | ((F.size(ta) > 0) & (F.size(tb) > 0) & (jaccard(ta, tb) >= 0.6))


def titles_match(a: Column, b: Column) -> Column:
    return norms_match(norm_title(a), norm_title(b), title_tokens(a), title_tokens(b))


#: Entities that occur in feeds; the others are left as they are.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "hellip": "…", "eacute": "é", "copy": "©", "middot": "·", "amp": "&"}


def unescape(text: Column) -> Column:
    """Numbered entities first, then named ones, each through the whole text; texts that have none aren't searched for each."""

    def numbered(t: Column) -> Column:
        for name, char in (("#0*39", "'"), ("#x0*27", "'"), ("#0*160", " "), ("#0*8217", "’"), ("#0*8211", "–"), ("#0*38", "&")):
            t = F.regexp_replace(t, f"&{name};", char)
        return t

    def named(t: Column) -> Column:
        for name, char in ENTITIES.items():
            t = F.replace(t, F.lit(f"&{name};"), F.lit(char))
        return t

    numbers = lambda t: F.when(t.contains("&#"), numbered(t)).otherwise(t)
    return let(text, lambda t: F.when(t.contains("&"), named(numbers(t))).otherwise(t))


def clean_text(raw: Column, limit: int = 400) -> Column:
    """Plain text of a fragment of HTML, cut at a sentence or word; null if nothing is left."""
    t = F.regexp_replace(raw, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)<br\s*/?>|</p>", " "), "<[^>]+>", "")
    t = unescape(unescape(t))
    t = F.regexp_replace(F.regexp_replace(t, r"""\\(['"\\])""", "$1"), r"\\[nrt]", " ")
    t = squeeze(t)
    cut = F.substring(t, 1, limit)
    sentence = F.regexp_extract(cut, r"(?s)^(.*[.!?]) ", 1)
    word = F.regexp_extract(cut, r"(?s)^(.+) ", 1)
    shorter = F.concat(F.regexp_replace(F.when(word != "", word).otherwise(cut), "[ ,;:—-]+$", ""), F.lit("…"))
    return F.when(t == "", None).when(F.length(t) <= limit, t).when(F.length(sentence) > limit * 0.55 + 1, sentence).otherwise(shorter)


def describe(raw: Column, limit: int = 180) -> Column:
    """A short description without addresses of pages."""
    return clean_text(F.regexp_replace(raw, r"https?://\S+", ""), limit)


def host(url: Column) -> Column:
    """Lower-case host without a leading ``www.``; addresses without a scheme are read as https."""
    full = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("https://"), url))
    return F.regexp_replace(F.lower(F.regexp_extract(full, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)), r"^www\.", "")


def path(url: Column) -> Column:
    full = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("https://"), url))
    return F.regexp_extract(full, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def canon_url(url: Column) -> Column:
    """Host and path as a match key; null if neither is there."""
    return F.nullif(F.concat(host(url), F.regexp_replace(path(url), "/+$", "")), F.lit(""))


def page_key(url: Column) -> Column:
    return F.concat(host(url), F.regexp_replace(path(url), "/+$", ""))


def domain_of(url: Column) -> Column:
    """The host without port; null without one."""
    return F.nullif(F.regexp_replace(host(F.coalesce(url, F.lit(""))), ":.*$", ""), F.lit(""))


def is_a_venue(name: Column) -> Column:
    """Whether a name is of somewhere: no placeholder, bare town, state code or street corner."""
    slug = norm_title(name)
    bad = slug.isin(*V.NOT_A_VENUE, *V.BARE_TOWNS) | has(F.trim(name), "^[A-Z]{2}$", False) | has(name, V.CROSSROADS)
    return F.coalesce(name.isNotNull() & ~bad & (F.length(slug) > 2), F.lit(False))


def building_of(venue: Column, host_name: Column, address: Column) -> Column:
    """The building of a room: the venue's own tail, the host, or the host that the address names."""
    room = lambda c: has(c, V.ROOM_NAME)
    tail = F.trim(F.regexp_extract(venue, r",([^,]*)$", 1))
    a, h = norm_title(F.coalesce(address, F.lit(""))), norm_title(host_name)
    other = host_name.isNotNull() & (host_name != "") & (host_name != venue)
    named = other & (a != "") & (h != "") & a.contains(h) & ~has(host_name, V.STREET_ONLY) & is_a_venue(host_name)
    return (
        F.when(venue.isNull() | ~is_a_venue(venue), venue)
        .when(room(venue) & venue.contains(",") & (tail != "") & ~room(tail), tail)
        .when(room(venue) & other & ~room(host_name), host_name)
        .when(room(venue), venue)
        .when(named, host_name)
        .otherwise(venue)
    )


def place_name(venue: Column, *fallbacks: Column) -> Column:
    """The first candidate that is neither a platform, a placeholder nor a street address."""
    ok = lambda c: F.when(c.isNotNull() & (F.trim(c) != "") & ~F.lower(F.trim(c)).isin(*V.NOT_A_PLACE) & ~has(F.trim(c), V.STREET_ONLY), F.trim(c))
    return F.coalesce(*map(ok, (venue, *fallbacks)))


def split_location(line: Column) -> Column:
    """struct(venue, city) of a free location line; the town is the part before a state."""
    parts = F.filter(F.transform(F.split(F.coalesce(line, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")
    at = F.array_position(F.transform(parts, lambda p, i: has(p, r"^(NY|New York|NJ|CT|MA|PA)$") & (i > 0)), True).cast("int")
    town, state = F.get(parts, at - 2), F.upper(F.get(parts, at - 1))
    city = F.when(at > 1, F.when(has(town, r"\d"), town).otherwise(F.concat_ws(", ", town, F.when(state == "NEW YORK", "NY").otherwise(state))))
    return F.struct(F.get(parts, 0).alias("venue"), city.alias("city"))


def split_postal(line: Column) -> Column:
    """struct(street, city, state) of "street, city, ST zip"."""
    parts = F.filter(F.transform(F.split(line, ","), lambda p: F.trim(p)), lambda p: p != "")
    n = F.size(parts)
    state = F.nullif(F.regexp_extract(F.get(parts, n - 1), r"^([A-Z]{2})(?:\s+\d{5}(?:-\d{4})?)?$", 1), F.lit(""))
    city_at = F.when(state.isNotNull(), n - 1).otherwise(n)
    street = F.when(city_at > 1, F.array_join(F.slice(parts, F.lit(1), F.greatest(city_at - 1, F.lit(1))), ", "))
    return F.struct(street.alias("street"), F.when(city_at >= 1, F.get(parts, city_at - 1)).alias("city"), state.alias("state"))


def titlecase(text: Column) -> Column:
    words = F.split(squeeze(text), " ")
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & w.isin(*V.SMALL_WORDS), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w))))), " ")


def headline(text: Column) -> Column:
    """A title in capitals as a title: minor words small, but for the first and those after a colon. Other titles stay."""
    words = F.split(squeeze(F.lower(text)), " ")
    cased = lambda w: F.array_join(F.transform(F.split(w, "-"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), "-")
    opening = lambda i: (i == 0) | F.get(words, i - 1).endswith(":")
    out = F.array_join(F.transform(words, lambda w, i: F.when(~opening(i) & F.regexp_replace(w, "^[.,:]+|[.,:]+$", "").isin(*V.MINOR_WORDS), w).otherwise(cased(w))), " ")
    return F.when((text == F.upper(text)) & text.rlike(r"\p{Lu}"), out).otherwise(text)


def query_variants(venue: Column, address: Column, city: Column) -> Column:
    """Places to look up for a location, most exact first."""
    full, town = F.concat_ws(", ", venue, address, city), F.concat_ws(", ", venue, city)
    return F.array_distinct(F.filter(F.array(full, F.concat_ws(", ", address, city), town, city), lambda x: x.isNotNull() & (x != "")))


def haystack(*columns: Column) -> Column:
    return F.lower(F.concat_ws(" ", *columns))


def richness(c: dict[str, Column]) -> Column:
    """How much a listing tells: scored fields, less for text that carries markup's leftovers."""
    texts = F.concat_ws("\u0001", *(c[x] for x in ("title", "description", "venue", "city", "address", "host") if x in c))
    part = lambda name, n: F.when(c[name].isNotNull(), n).otherwise(0) if name in c else F.lit(0)
    full = lambda name, n: F.when(F.coalesce(c[name], F.lit("")) != "", n).otherwise(0) if name in c else F.lit(0)
    length = F.least(F.floor(F.length(F.coalesce(c["description"], F.lit(""))) / 120), F.lit(3)).cast("int") if "description" in c else F.lit(0)
    setting = F.when(F.coalesce(c["setting"], F.lit("unknown")) != "unknown", 1).otherwise(0) if "setting" in c else F.lit(0)
    return F.when(has(texts, V.UNCLEAN), -4).otherwise(0) + part("price", 6) + full("signupUrl", 2) + length + part("end", 1) + full("recurrence", 1) + full("host", 1) + setting


def filled(*columns: Column) -> Column:
    """How many of the columns say something."""
    return sum((F.when(F.coalesce(c.cast("string"), F.lit("")) != "", 1).otherwise(0) for c in columns), F.lit(0))


def stable_id(source: Column, uid: Column, start: Column) -> Column:
    return F.concat(source, F.lit("-"), F.substring(F.sha1(F.concat_ws("", uid, start)), 1, 8))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def iso_duration_seconds(text: Column) -> Column:
    """Seconds of PnDTnHnMnS; null if it is no duration."""
    part = lambda p: F.coalesce(F.regexp_extract(text, p, 1).try_cast("double"), F.lit(0.0))
    ok = text.rlike(r"^P(?=.)(\d+D)?(T(?=.)(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?$")
    return F.when(ok, (part(r"(\d+)D") * 86400 + part(r"T.*?(\d+)H") * 3600 + part(r"T.*?(\d+)M") * 60 + part(r"([\d.]+)S$")).cast("long"))


def normalise_city(city: Column) -> Column:
    """A town's name without asides in brackets and spaces around; null if nothing is left."""
    return F.nullif(squeeze(F.regexp_replace(city, r"\s*\([^)]*\)", "")), F.lit(""))
