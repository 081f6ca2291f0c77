"""URL identity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that never define an article (beside utm_*): fixed values.
TRACKING_PARAMETERS = ["fbclid", "gclid", "mc_cid", "mc_eid", "ref"]
#: Endings of files that are no articles, and path parts of pages that are none: fixed values.
MEDIA_ENDINGS = [".jpg", ".png", ".svg", ".pdf"]
OTHER_PAGES = ["/about", "/contact", "/privacy", "/terms", "/newsletters", "/podcasts", "/video"]
LEAST_PATH = 24
#: A host in brackets and what may follow it; and an http(s) URL with a host in the characters of RFC 3986.
IPV6 = r"^\[([0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*)(?:%[^\]]*)?\]"
UNIT = r"(?:[A-Za-z0-9._~!$&'()*+,;=-]|%[0-9A-Fa-f]{2})"
STANDARD = (
    rf"(?i)\Ahttps?://(?:(?:{UNIT}|:)*@)?(?:\[[0-9A-F:.]+\]|{UNIT}+)(?::[0-9]*)?"
    rf"(?:/(?:{UNIT}|[:@/])*)?(?:\?(?:{UNIT}|[:@/?])*)?(?:#(?:{UNIT}|[:@/?])*)?\z"
)
PARTS = r"(?is)^(https?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def form_decode(text: Column) -> Column:
    """A part of a query without its encoding; what is no valid encoding stays as it is."""
    plus = F.replace(text, F.lit("+"), F.lit(" "))
    # A stray percent sign is escaped first, so that the built-in decoder takes it literally.
    safe = F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(safe), plus)


def form_encode(text: Column) -> Column:
    """Letters, digits and _.-~ stay; a space is '+', anything else is percent-encoded."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column) -> Column:
    """Identity of an http(s) URL, or null: lower-case scheme and host, no default port, credentials,
    fragment or tracking parameters, single slashes, no slash at the end, and the query decoded, sorted
    and encoded again with blank values kept. A port that is no number up to 65535 makes the URL invalid.
    The brackets of an IPv6 host are dropped."""
    text = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|\s+$", ""), r"[\t\r\n]", "")
    part = lambda i: F.regexp_extract(text, PARTS, i)
    scheme, authority = F.lower(part(1)), F.regexp_replace(part(2), "^.*@", "")
    bracketed = authority.startswith("[")
    host = F.lower(F.when(bracketed, F.regexp_extract(authority, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(authority, "^([^:]*)", 1)))
    rest = F.when(bracketed, F.regexp_extract(authority, r"^\[[^\]]*\](.*)$", 1)).otherwise(F.regexp_extract(authority, "^[^:]*(.*)$", 1))
    number = F.try_to_number(F.nullif(F.regexp_extract(rest, r"^:([0-9]{1,9})$", 1), F.lit("")), F.lit("999999999")).cast("int")
    sound = rest.isin("", ":") | F.coalesce(number <= 65535, F.lit(False))
    usual = number.isNull() | (number == 0) | ((scheme == "http") & (number == 80)) | ((scheme == "https") & (number == 443))
    path = F.regexp_replace(F.regexp_replace(part(3), "/{2,}", "/"), "/$", "")
    pairs = F.transform(
        F.filter(F.split(part(4), "&"), lambda p: p != ""),
        lambda p: F.struct(
            form_decode(F.regexp_extract(p, "^([^=]*)", 1)).alias("key"),
            form_decode(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("value"),
        ),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["key"]).startswith("utm_") & ~F.lower(p["key"]).isin(TRACKING_PARAMETERS)))
    query = F.array_join(F.transform(kept, lambda p: F.concat(form_encode(p["key"]), F.lit("="), form_encode(p["value"]))), "&")
    made = F.concat(
        scheme,
        F.lit("://"),
        host,
        F.when(usual, "").otherwise(F.concat(F.lit(":"), number.cast("string"))),
        F.when(path == "", "/").otherwise(path),
        F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
    )
    return F.when(text.rlike(PARTS) & (host != "") & sound, made)


def experiment_url(url: Column) -> Column:
    """The experiment's identity of an http(s) URL, or null: scheme and host in lower case, port kept, no
    query, fragment or parameters of the last segment, no slash at the end (the root is empty)."""
    text = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    part = lambda i: F.regexp_extract(text, r"(?is)^(https?)://([^/?#]*)([^?#]*)", i)
    path = F.regexp_replace(F.regexp_replace(part(3), r"(?s);[^/]*\z", ""), r"/+\z", "")
    return F.when(part(2) != "", F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), path))


def authority(url: Column) -> Column:
    """Host and port of a URL as they are written, without credentials; '' where there is none."""
    text = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    return F.regexp_replace(F.regexp_extract(text, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), "(?s)^.*@", "")


def url_host(url: Column) -> Column:
    """The host of any URL in lower case, or null: what stands before the port, whatever its characters and
    those of the path are. An IPv6 host comes without its brackets; other brackets make the URL invalid."""
    place = authority(url)
    plain = F.when(~place.rlike(r"[\[\]]"), F.regexp_extract(place, "^([^:]*)", 1))
    host = F.when(place.rlike(IPV6), F.regexp_extract(place, IPV6, 1)).otherwise(plain)
    return F.nullif(F.lower(host), F.lit(""))


def http_url(url: Column) -> Column:
    """The URL itself if it is an http(s) URL of the standard's characters with a host, else null."""
    return F.when(url.rlike(STANDARD), url)


def http_host(url: Column) -> Column:
    """The host of a URL that ``http_url`` accepts, in lower case, an IPv6 host in its brackets."""
    return F.lower(F.regexp_extract(authority(http_url(url)), r"^(\[[^\]]*\]|[^:]*)", 1))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def same_site(candidate: Column, homepage: Column) -> Column:
    """Whether the candidate's host is the homepage's or below it; ``www.`` does not count."""
    host, home = bare_host(candidate), bare_host(homepage)
    return (host == home) | F.endswith(host, F.concat(F.lit("."), home))


def likely_article(url: Column, homepage: Column, least_path: int = LEAST_PATH) -> Column:
    """Whether a URL of the homepage's site looks like an article: a long path that is no file and no service page."""
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    media = [F.endswith(path, F.lit(e)) for e in MEDIA_ENDINGS]
    service = [F.contains(F.lower(path), F.lit(p)) for p in OTHER_PAGES]
    wrong = media[0]
    for test in [*media[1:], *service]:
        wrong = wrong | test
    return F.startswith(url, F.lit("http")) & same_site(url, homepage) & (F.char_length(path) >= least_path) & ~wrong


def date_in_path(url: Column) -> Column:
    """A /2026/08/09/ or /2026/aug/9/ date of the path, or null."""
    path = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    numeric = F.try_to_date(F.regexp_replace(F.regexp_extract(path, r"/(20\d{2}/\d{2}/\d{2})/", 1), "/", "-"), "yyyy-MM-dd")
    named = F.try_to_date(
        F.initcap(F.regexp_extract(path, r"(?i)/(20\d{2}/(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)/\d{1,2})/", 1)),
        "yyyy/MMM/d",
    )
    return F.coalesce(numeric, named)
