"""URL expressions. WHATWG rules where they decide identity: scheme and host case, default ports, dot segments,
percent-encoding of what isn't ASCII, form encoding of the query."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that are dropped (tracking and session marks) and parameters that are kept whatever else says.
DROP_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_reader",
    "gclid", "gclsrc", "dclid", "fbclid", "msclkid", "yclid", "igshid", "ttclid", "twclid", "li_fat_id",
    "ref", "referrer", "source", "src", "spm", "scm", "trk", "trk_contact", "mkt_tok",
    "_ga", "_gl", "_hsenc", "_hsmi", "mc_cid", "mc_eid", "oly_enc_id", "vero_id", "wickedid",
    "n_media", "n_query", "n_rank", "n_ad_group", "n_ad", "n_keyword", "NaPm",
    "sessionid", "session_id", "phpsessid", "jsessionid", "aspsessionid", "sid",
    "cfid", "cftoken", "zenid", "_sid", "ssid",
)
KEEP_PARAMS = (
    "id", "no", "idx", "seq", "pid", "goodsno", "goodsid", "productno", "productid",
    "p", "page", "offset", "start", "cate", "category", "cateno", "code", "sku", "variant", "v",
    "q", "query", "keyword", "lang", "locale", "hl", "country", "currency", "size", "color",
)

# Path and query words that mark endless listings, and the names of page parameters.
FACET_PATH = "(calendar|search|filter|tag|archive|date)"
FACET_KEY = "^(q|query|keyword|search|page|date|year|month|day|from|to|min|max|sort|order|filter|tag|category|cat|color|size|price)$"
PAGE_KEYS = ("page", "p", "pageno", "page_no", "pagenum", "pageindex")
OFFSET_KEYS = ("offset", "start")
KIND_LISTING = "(list|listing|collections?|products?$|catalog|goods$|mcard|category)"
KIND_DETAIL = "(/products?/[^/]+|/detail(/[^/]+)?|/goods/[^/]+|/item/[^/]+|/p/[^/]+)$"
KIND_LISTING_LAST = "^(list|listing|all|index|category|categories|collection|collections|product|products|goods|catalog)$"

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, _SCHEME + r"[/\\]*([^/?#\\]*)", 2)


def host(url: Column) -> Column:
    """Lower-cased host without port and final dot."""
    return host_of(authority(url))


def host_of(authority: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(authority, r"^.*@|:[0-9]*$", "")), r"\.$", "")


def path(url: Column) -> Column:
    """The path as written; empty where there is none."""
    return F.regexp_extract(url, _SCHEME + r"[/\\]*[^/?#\\]*([^?#]*)", 2)


def query(url: Column) -> Column:
    """The query without its question mark; empty where there is none."""
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def decoded(part: Column) -> Column:
    """A form-encoded part decoded; as written where it isn't valid. Most parts have nothing to decode and are left alone."""
    return F.when(part.contains("%") | part.contains("+"), F.coalesce(F.try_url_decode(part), part)).otherwise(part)


def form_encoded(part: Column) -> Column:
    """A part form-encoded; most parts have nothing to encode and are left alone."""
    return F.when(part.rlike(r"[^A-Za-z0-9.*_\-]"), F.url_encode(part)).otherwise(part)


def params(url: Column) -> Column:
    """The query's parameters as array<struct<k, v>>, decoded, in order."""
    return params_of(query(url))


def params_of(query: Column) -> Column:
    """The parameters of a query without its question mark."""
    pieces = F.filter(F.split(query, "&"), lambda p: p != "")
    value = lambda p: F.when(p.contains("="), F.substr(p, F.instr(p, "=") + 1)).otherwise("")
    found = F.transform(pieces, lambda p: F.struct(decoded(F.substring_index(p, "=", 1)).alias("k"), decoded(value(p)).alias("v")))
    # F.when: most addresses have no query, and lambdas are interpreted.
    return F.when(query == "", F.array().cast("array<struct<k:string,v:string>>")).otherwise(found)


def percent_encoded(text: Column) -> Column:
    """Characters that can't stand in a path, as percent-encoded UTF-8."""
    one = lambda c: F.when(c.rlike(r'[^\x21-\x7e]|["<>`{}]'), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c)
    return F.when(text.rlike(r'[^\x21-\x7e]|["<>`{}]'), F.array_join(F.transform(F.split(text, ""), one), "")).otherwise(text)


def plain_path(raw: Column) -> Column:
    """A path with forward slashes, dot segments resolved and unsafe characters encoded."""
    slashed = F.regexp_replace(raw, r"\\", "/")
    segments = F.split(slashed, "/")
    walked = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda seen, s: F.when(F.lower(s).isin(".", "%2e"), seen)
        .when(F.lower(s).isin("..", ".%2e", "%2e.", "%2e%2e"), F.when(F.size(seen) > 1, F.slice(seen, 1, F.size(seen) - 1)).otherwise(seen))
        .otherwise(F.concat(seen, F.array(s))),
        lambda seen: F.array_join(seen, "/"),
    )
    # A final dot segment leaves the slash before it.
    final = F.when(slashed.rlike(r"(^|/)\.{1,2}$"), F.concat(walked, F.lit("/"))).otherwise(walked)
    return percent_encoded(F.when(slashed.rlike(r"(^|/)\.{1,2}(/|$)|%2[eE]"), final).otherwise(slashed))


def same_host(a: Column, b: Column) -> Column:
    """Whether two host names are equal but for a leading www."""
    bare = lambda h: F.regexp_replace(F.lower(h), r"^www\.", "")
    return bare(a) == bare(b)


def url_id(url: Column, length: int = 20) -> Column:
    return F.substring(F.sha2(url, 256), 1, length)


def path_shape(url: Column) -> Column:
    """The path with segments of digits, of eight or more hexadecimal digits, or ending in a date as *."""
    segment = lambda s: F.when(s.rlike(r"^[0-9]+$|^[0-9a-fA-F]{8,}$|[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), F.lit("*")).otherwise(s)
    shape = F.array_join(F.transform(F.split(path(url), "/"), segment), "/")
    return F.when(shape == "", F.lit("/")).otherwise(shape)


def query_combo(url: Column) -> Column:
    """Lower-cased parameter names in order, joined by &; duplicates stay."""
    return F.array_join(F.array_sort(F.transform(params(url), lambda p: F.lower(p["k"]))), "&")


def facet_keys(url: Column) -> Column:
    """Evidence of facets: path:word, then query:key for each matching parameter."""
    word = F.lower(F.regexp_extract(path(url), f"(?i){FACET_PATH}", 1))
    keys = F.transform(F.filter(params(url), lambda p: F.lower(p["k"]).rlike(FACET_KEY)), lambda p: F.concat(F.lit("query:"), F.lower(p["k"])))
    return F.when(word != "", F.concat(F.array(F.concat(F.lit("path:"), word)), keys)).otherwise(keys)


def facet_kind(url: Column) -> Column:
    """path, query or null."""
    return F.when(path(url).rlike(f"(?i){FACET_PATH}"), F.lit("path")).when(F.exists(params(url), lambda p: F.lower(p["k"]).rlike(FACET_KEY)), F.lit("query"))


def kind(url: Column, cards: Column | None = None) -> Column:
    """struct<kind, status, evidence>: sitemap, listing, detail or unknown from the path and, if given, the number of cards."""
    p = F.lower(F.when(path(url) == "", "/").otherwise(path(url)))
    last = F.element_at(F.split(F.regexp_replace(p, "/+$", ""), "/"), -1)
    count = F.lit(0) if cards is None else F.coalesce(cards, F.lit(0))
    detail = p.rlike(KIND_DETAIL) & ~last.rlike(KIND_LISTING_LAST)
    listing = p.rlike(KIND_LISTING)
    evidence = F.filter(
        F.array(
            F.when(count >= 2, F.concat(F.lit("cards:"), count.cast("string"))),
            F.when(listing, F.lit("path_looks_listing")),
            F.when(detail, F.lit("path_looks_detail")),
        ),
        lambda e: e.isNotNull(),
    )
    like_list = (count >= 2) | listing
    bad = ~F.coalesce(url.rlike(_SCHEME + "[/]{2}[^/?#]"), F.lit(False))
    sitemap = p.rlike(r"\.xml$") | p.contains("sitemap")
    answer = lambda k, s, e: F.struct(F.lit(k).alias("kind"), F.lit(s).alias("status"), e.alias("evidence"))
    return (
        F.when(bad, answer("unknown", "needs_review", F.array(F.lit("bad_url"))))
        .when(sitemap, answer("sitemap", "proposed", F.array(F.lit("path_looks_sitemap"))))
        .when(like_list & ~detail, answer("listing", "proposed", evidence))
        .when(detail & ~like_list, answer("detail", "proposed", evidence))
        .otherwise(answer("unknown", "needs_review", F.when(F.size(evidence) > 0, evidence).otherwise(F.array(F.lit("no_signal")))))
    )


def slug(text: Column, length: int, default: str = "untitled") -> Column:
    """Runs of anything but letters and digits as one hyphen, cut, trimmed of hyphens."""
    cut = F.substring(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "-"), 1, length)
    out = F.regexp_replace(cut, "^-+|-+$", "")
    return F.when(F.coalesce(out, F.lit("")) == "", F.lit(default)).otherwise(out)


def ipv4_number(address: Column) -> Column:
    """An IPv4 address as a number, or null."""
    parts = F.transform(F.split(address, r"\."), lambda x: x.cast("int"))
    good = address.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$") & F.forall(parts, lambda x: x.between(0, 255))
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    return F.when(good, number)


# IPv4 ranges that aren't public, in the order in which they are tried.
IPV4_CLASSES = (
    ("unspecified", "0.0.0.0", 8), ("loopback", "127.0.0.0", 8), ("private", "10.0.0.0", 8), ("private", "172.16.0.0", 12),
    ("private", "192.168.0.0", 16), ("link_local", "169.254.0.0", 16), ("shared_cgnat", "100.64.0.0", 10), ("benchmark", "198.18.0.0", 15),
    ("documentation", "192.0.2.0", 24), ("documentation", "198.51.100.0", 24), ("documentation", "203.0.113.0", 24),
    ("reserved", "192.0.0.0", 24), ("reserved", "192.88.99.0", 24), ("multicast", "224.0.0.0", 4), ("reserved", "240.0.0.0", 4),
)


# IPv6 ranges that aren't public. An address that wraps an IPv4 address has the class of that.
IPV6_CLASSES = (
    ("unspecified", "::", 128), ("loopback", "::1", 128), ("private", "fc00::", 7), ("link_local", "fe80::", 10),
    ("multicast", "ff00::", 8), ("nat64", "64:ff9b::", 32), ("documentation", "2001:db8::", 32),
)
_WRAPPED = (("::ffff:0:0", 96), ("::", 96))


def _let(value: Column, then) -> Column:
    """then(value), with value computed once: an expression that is used in many places would be copied to all of them."""
    return F.get(F.transform(F.array(value), then), 0)


def ipv6_number(address: Column) -> Column:
    """An IPv6 address as its 128 bits, 32 hexadecimal digits, which sort as the numbers do; null if it is none. Brackets and a zone don't count, the last 32 bits may be written as an IPv4 address."""
    none = F.array().cast("array<string>")

    def without_tail(text: Column) -> Column:
        """The last four bytes as two groups, if they are written as an IPv4 address."""
        tail = F.regexp_extract(text, r"([0-9]{1,3}(?:\.[0-9]{1,3}){3})$", 1)
        as_groups = lambda four: F.concat(F.regexp_replace(text, r"[0-9]+(?:\.[0-9]+){3}$", ""), F.lower(F.hex(F.shiftright(four, 16))), F.lit(":"), F.lower(F.hex(four.bitwiseAND(F.lit(65535)))))
        return F.when(text.contains("."), _let(ipv4_number(tail), as_groups)).otherwise(text)

    def filled(halves: Column) -> Column:
        """Groups, with zeros where the double colon stands; null where there aren't eight."""
        groups = lambda half: F.when(half == "", none).otherwise(F.split(half, ":", -1))
        left, right = groups(F.get(halves, 0)), F.when(F.size(halves) == 2, groups(F.get(halves, 1))).otherwise(none)
        whole = _let(F.struct(left.alias("l"), right.alias("r")), lambda p: F.when(F.size(halves) == 1, p["l"]).otherwise(F.concat(p["l"], F.array_repeat(F.lit("0"), 8 - F.size(p["l"]) - F.size(p["r"])), p["r"])))
        return F.when(F.size(halves) <= 2, whole)

    def digits(groups: Column) -> Column:
        good = (F.size(groups) == 8) & F.forall(groups, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(good, F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), ""))

    bare = F.lower(F.regexp_replace(address, r"^\[|\]$|%.*$", ""))
    return F.when(bare.contains(":"), _let(_let(F.split(_let(bare, without_tail), "::", -1), filled), digits))


def _range(first: str, bits: int) -> tuple[int, int]:
    address = ipaddress.ip_address(first)
    low = int(address)
    return low, low + (1 << address.max_prefixlen - bits) - 1


def ip_class(address: Column) -> Column:
    """Class of an IPv4 or IPv6 address, by the range that its number is in; public, or null where it is no address."""

    def of_four(n: Column) -> Column:
        out = F.lit("public")
        for name, first, bits in reversed(IPV4_CLASSES):
            out = F.when(n.between(*_range(first, bits)), F.lit(name)).otherwise(out)
        return out

    def of_six(n: Column) -> Column:
        between = lambda first, bits: n.between(*(f"{x:032x}" for x in _range(first, bits)))
        wrapped = F.lit(False)
        for first, bits in _WRAPPED:
            wrapped = wrapped | between(first, bits)
        out = F.when(wrapped, _let(F.conv(F.substring(n, 25, 8), 16, 10).cast("long"), of_four)).otherwise(F.lit("public"))
        for name, first, bits in reversed(IPV6_CLASSES):
            out = F.when(between(first, bits), F.lit(name)).otherwise(out)
        return F.when(n.isNotNull(), out)

    number = _let(ipv4_number(address), lambda n: F.when(n.isNotNull(), of_four(n)))
    return F.coalesce(number, _let(ipv6_number(address), of_six))
