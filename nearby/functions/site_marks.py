"""What tells a venue's site apart: links, words, dates, hosts, platforms, verdicts."""

from __future__ import annotations

# The patterns and bounds that verdicts depend on.
EVENT_LINK = (
    r"event|calendar|whats?[-_ ]?on|upcoming|happening|programme?s?\b|schedule|exhibit|shows?\b|performances?|concerts?|gigs?|screenings?|workshops?|classes|tastings?|live[-_ ]?music|tickets?|festival|what-to-do|visit/|"
    r"movies?\b|films?\b|now[-_ ]?(?:playing|showing)|showtimes?"
)
DEAL_LINK = r"special|deals?\b|happy[-_ ]?hour|promotion|offers?\b|sales?\b|discount|trivia|karaoke|bingo|open[-_ ]?mic|book[-_ ]?club|story[-_ ]?time"
EVENT_WORDS = r"\b(event|events|calendar|upcoming|schedule|programme|program|exhibition|performance|concert|screening|workshop|class|tasting|festival|matinee|showtimes?|now (?:playing|showing)|doors\s+(?:open|at)|rsvp|tickets?)\b"
DEAL_WORDS = r"\b(special|specials|deal|deals|happy hour|promotion|sale|clearance|discount|prix[- ]fixe|tap takeover|trivia|karaoke|bingo|open mic|story ?time|book club|farmers.? market|pick[- ]your[- ]own)\b"
MONTHS = r"jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t|tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
DATED = rf"\b(?:{MONTHS})\.?\s+\d{{1,2}}\b|\b\d{{1,2}}/\d{{1,2}}(?:/\d{{2,4}})?\b|\b\d{{4}}-\d{{2}}-\d{{2}}\b|\b\d{{1,2}}\s+(?:{MONTHS})\b"
CLOCK = r"\b\d{1,2}(?::\d{2})?\s*(?:a\.?m|p\.?m)\b"
RECURRING = r"\b(?:every|each)\s+(?:mon|tues?|wednes|thurs?|fri|satur|sun)day\b|\b(?:mon|tues?|wednes|thurs?|fri|satur|sun)days?\b[^.]{0,40}?\b\d{1,2}(?::\d{2})?\s*(?:a\.?m|p\.?m)\b"
FOREIGN_SCRIPT = "[\u0400-\u04ff\u0590-\u08ff\u0e00-\u0e7f\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af]"
SUSPECT = r"\b(situs|slot ?gacor|judi bola|togel|bandar|casino online|taruhan|bahis|deneme bonusu|canl[ıi] casino|rtp slot|maxwin|pragmatic play)\b"
PARKED = (
    r"caddy works|welcome to nginx|apache2? (?:ubuntu |debian )?default page|it works!|future home of something quite cool|this domain (?:name )?is for sale|buy this domain|domain (?:is )?parked|"
    r"godaddy\.com/domainsearch|sedoparking|hugedomains|under construction|coming soon\b.{0,40}stay tuned"
)
SKIP_HOSTS = (
    "facebook.com", "m.facebook.com", "instagram.com", "twitter.com", "x.com", "linktr.ee", "linkedin.com", "youtube.com", "tiktok.com", "yelp.com", "eventbrite.com", "meetup.com", "sites.google.com", "wixsite.com",
    "squarespace.com", "wordpress.com", "blogspot.com", "google.com", "tripadvisor.com", "patch.com", "weebly.com", "wix.com", "ticketmaster.com", "ticketweb.com", "livenation.com", "seetickets.us",
    "eventbrite.co.uk", "opentable.com", "toasttab.com", "square.site", "shopify.com", "etsy.com", "airbnb.com", "booking.com", "doordash.com",
)
OFFSITE_CALENDAR = r"\bcalendar\b|\bevents?\b|whats?[-_ ]?on|showtimes?|schedule|\btickets?\b|upcoming"
CALENDAR_PATH = r"/(events?|calendar|whats?[-_]?on|upcoming|shows?|showtimes?|programs?([-_]and)?[-_]events?|programme|performances?)(/|$|\?)"
JSONLD_EVENT = r"\"@type\"\s*:\s*\"?\[?\"?(Event|MusicEvent|TheaterEvent|ScreeningEvent|FoodEvent|SocialEvent|ExhibitionEvent|Festival)"
NAME_STOPWORDS = ("the", "and", "of", "at", "inc", "llc", "company", "center", "centre", "shop", "store", "house", "club", "park", "museum")
FOREIGN_SHARE, SPAM_HITS, LISTING_DATES, CALENDAR_DATES, DEAL_DATES, THIN_PAGE, SHELL, SIGNED = 0.15, 3, 3, 2, 2, 1200, 400, 40
BLOCKED = (401, 403, 405, 406, 429, 451)
#: Verdict -> days until a site is read again. No other verdict exists.
RECHECK_DAYS = {"none": 365, "specials": 240, "listings": 180, "feed": 180, "suspect": 365, "unreadable": 120, "blocked": 120, "parked": 180, "unreachable": 45}
# Calendar platforms, best known by these marks in a page.
PLATFORMS = (
    ("google", r"""calendar\.google\.com/calendar/(?:embed|u/\d+/embed)\?[^"'<>]*src=([^"'&<>]+)"""), ("libcal", r"https?://([a-z0-9-]+\.libcal\.com)"), ("localist", r"https?://([a-z0-9.-]+)/api/2/events|localist\.com"),
    ("tockify", r"tockify\.com/api/feeds/[a-z0-9]+|tockify\.com/([a-z0-9_-]+)"), ("trumba", r"trumba\.com/calendars/([a-z0-9._-]+)"), ("eventbrite", r"eventbrite\.com/o/([a-z0-9-]+)"),
    ("bandsintown", r"bandsintown\.com/v/(\d+)|bandsintown\.com/a/(\d+)"), ("dice", r"dice\.fm/(?:venue|partner)/([a-z0-9-]+)"),
)
#: What stands in every page that one of the platforms' marks is in.
ANY_PLATFORM = r"calendar\.google\.com|\.libcal\.com|/api/2/events|localist\.com|tockify\.com|trumba\.com|eventbrite\.com|bandsintown\.com|dice\.fm"

#: Fixed values. Links of a page: address and label.
ANCHOR = r"""(?is)<a\s[^>]*href=["']([^"'>]+)["'][^>]*>(.*?)</a>"""
#: Keys of page pictures, best first.
PICTURE_KEYS = ("og:image:secure_url", "og:image", "og:image:url", "twitter:image", "twitter:image:src")
#: Fixed values. Words of a picture's path that say it is no photograph of a place, hosts whose pictures aren't, and the least width.
NOT_A_PICTURE = r"(logo|favicon|site-?icon|[-_]icon\b|apple-touch|/icons?/|placeholder|default|blank\.|spacer|avatar|badge|sprite|gravatar|/stock/|unsplash|shutterstock|istock|wordmark|stacked|/google\.(?:jpe?g|png))"
ICON_FORMATS = (".svg", ".ico", ".gif")
NOT_PICTURE_HOSTS = ("facebook.com", "fbcdn.net", "static.xx.fbcdn.net")
LEAST_WIDTH = 300
