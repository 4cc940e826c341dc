"""Queries of the URL operators over pages (and documents, customer for names)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomledger.functions import urls as U
from loomledger.operators import ledger, reviews
from loomledger.operators import urls as ops
from loomledger.sources.tables import PAGE_LINKS_SQL, URL_RECORDS_SQL, page_links, table, url_records

_DOMAIN_RULES = [("spam-farm.example.org", "page", "drop"), ("spam-farm.example.org", "ref", "keep"), ("ththin.example.com", "utm_source", "keep")]
_PATTERNS = [("listing", "/*/*.html", None), ("detail", "/en/*", None), ("detail", "/fr/*", None), ("listing", "/en/**", "spam-farm.example.org"), ("listing", "bad pattern", None)]
_EXCLUDED_PATHS = ["/fr/*", "/es/*"]
_EXCLUDED_KEYS = ["ref", "utm_source"]
_LISTED = ["example.org", "www.cheap-pills.example.com", "ththin.example.com"]
_ROBOTS = [
    ("thther.example.org", 1, ["*"], "disallow", "/en/*"), ("thther.example.org", 1, ["*"], "allow", "/en/6"), ("thther.example.org", 2, ["loom"], "disallow", "/*?page=2"),
    ("spam-farm.example.org", 1, ["loom", "*"], "disallow", "/en/"), ("spam-farm.example.org", 1, ["loom", "*"], "allow", "/en/7"), ("blog.tionsh.example.net", 1, ["*"], "disallow", "/es/*/$"),
    ("blog.tionsh.example.net", 1, ["*"], "disallow", "/fr"), ("blog.tionsh.example.net", 1, ["*"], "allow", "/fr"), ("blog.ththan.example.net", 1, ["other"], "disallow", "/"),
]


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url")


def canonicalize(spark, sf_dir):
    out = ops.canonicalize(url_records(spark, sf_dir))
    return out.select("line", "original_url", "canonical_url", "domain", F.array_join("dropped", ",").alias("dropped"), "reject")


def canonicalize_by_domain(spark, sf_dir):
    rules = spark.createDataFrame(_DOMAIN_RULES, "domain string, param string, action string")
    return ops.canonicalize(url_records(spark, sf_dir), per_domain=rules).select("line", "canonical_url", F.array_join("dropped", ",").alias("dropped"))


def first_wins(spark, sf_dir):
    out = ops.canonicalize(url_records(spark, sf_dir))
    return ops.first_wins(out, "canonical_url", "line").select("canonical_url", "original_url", "line", "n_rows")


def url_shapes(spark, sf_dir):
    out = ops.path_shapes(_pages(spark, sf_dir))
    return out.select("page_id", "shape", "combo", F.coalesce("facet", F.lit("-")).alias("facet"), F.array_join("facet_keys", ",").alias("facet_keys"))


def url_kinds(spark, sf_dir):
    return ops.classify_kind(_pages(spark, sf_dir)).select("page_id", "kind", "kind_status", F.array_join("evidence", ",").alias("evidence"))


def url_kinds_with_cards(spark, sf_dir):
    cards = page_links(spark, sf_dir).groupBy("page_id").agg(F.count(F.lit(1)).cast("int").alias("cards"))
    out = ops.classify_kind(_pages(spark, sf_dir).join(cards, "page_id", "left"), cards="cards")
    return out.select("page_id", "kind", F.array_join("evidence", ",").alias("evidence"))


def kind_by_patterns(spark, sf_dir):
    patterns = spark.createDataFrame(_PATTERNS, "side string, pattern string, scope string")
    return ops.classify_by_patterns(_pages(spark, sf_dir), patterns).select("page_id", F.coalesce("kind_by_pattern", F.lit("-")).alias("kind_by_pattern"), F.coalesce("kind_why", F.lit("-")).alias("kind_why"), "kind", "kind_source")


def page_series(spark, sf_dir):
    pages = _pages(spark, sf_dir).withColumns({"kind": F.lit("listing"), "kind_source": F.lit("policy")})
    return ops.page_of(pages).select("page_id", "series", "page_index")


def same_hosts(spark, sf_dir):
    hosts = _pages(spark, sf_dir).select("page_id", U.host(F.col("url")).alias("host"))
    bare = hosts.withColumn("bare", F.regexp_replace("host", r"^www\.", ""))
    return bare.withColumn("same", U.same_host(F.col("host"), F.col("bare"))).groupBy("bare").agg(F.count_if("same").alias("pages"), F.count_distinct("host").alias("hosts"))


def url_ids(spark, sf_dir):
    out = ops.canonicalize(_pages(spark, sf_dir))
    return out.select("page_id", U.url_id(F.col("canonical_url"), 20).alias("url_id"), U.url_id(F.col("domain"), 12).alias("origin_id"))


def url_priority(spark, sf_dir):
    pages = ops.classify_kind(_pages(spark, sf_dir)).withColumns({"depth": F.size(F.split(U.path(F.col("url")), "/")) - 2, "lastmod": F.when(F.col("url").contains("utm"), F.lit("x"))})
    return ops.priority(pages).select("page_id", "kind", "priority")


def queue_order(spark, sf_dir):
    pages = ops.priority(ops.classify_kind(_pages(spark, sf_dir)).withColumns({"depth": F.size(F.split(U.path(F.col("url")), "/")) - 2, "lastmod": F.lit(None).cast("string"), "domain": U.host(F.col("url"))}))
    return reviews.queue_order(pages, "page_id").select("page_id", "priority", "domain")


def slugs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", U.slug(F.regexp_extract("text", r"^([^\n]*)", 1), 40).alias("slug"))


def name_patterns(spark, sf_dir):
    from loomledger.operators import text

    return text.parse_names(table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("2024-"), F.lpad(((F.col("c_custkey") % 14)).cast("string"), 2, "0"), F.lit("-03 "), F.col("c_name"), F.lit(" ["), F.lower("c_mktsegment"), F.lit("]")).alias("name")), "name", "{date} {title} [{tag}]", ["building", "machinery", "household"]).select(
        "c_custkey", F.coalesce("name_month", F.lit("-")).alias("name_month"), F.coalesce("name_title", F.lit("-")).alias("name_title"), F.coalesce("reject", F.lit("-")).alias("reject")
    )


def domains_listed(spark, sf_dir):
    listed = spark.createDataFrame([(d,) for d in _LISTED], "domain string")
    return ops.domain_in(_pages(spark, sf_dir).withColumn("domain", U.host(F.col("url"))), listed).select("page_id", "domain")


def exclusions(spark, sf_dir):
    return ops.match_exclusions(_pages(spark, sf_dir), _EXCLUDED_PATHS, _EXCLUDED_KEYS).select("page_id", F.coalesce("why", F.lit("-")).alias("why"), F.coalesce("why_evidence", F.lit("-")).alias("why_evidence"))


def _excluded(spark, sf_dir):
    out = ops.match_exclusions(_pages(spark, sf_dir).withColumns({"canonical_url": F.col("url"), "domain": U.host(F.col("url"))}), _EXCLUDED_PATHS, _EXCLUDED_KEYS)
    return out.where("why is not null")


def excluded_by(spark, sf_dir):
    """Exclusions by rule and domain; a later policy lets in the addresses of every third page."""
    out = _excluded(spark, sf_dir)
    return reviews.excluded_by(out, 20, out.where("page_id % 3 = 0").select("canonical_url"))


def robots(spark, sf_dir):
    rules = spark.createDataFrame(_ROBOTS, "host string, group_id int, agents array<string>, rule_type string, path string")
    return ops.robots_decide(_pages(spark, sf_dir), rules, "LoomBot").select("page_id", "allowed", F.coalesce("rule_type", F.lit("-")).alias("rule_type"), F.coalesce("rule_path", F.lit("-")).alias("rule_path"))


def add_urls(spark, sf_dir):
    """Records against a ledger that has the plain addresses already: what is new, what is no address, and the counts."""
    mails = _pages(spark, sf_dir).where("page_id % 10 = 0").select(F.concat(F.lit("mailto:a@"), U.host(F.col("url"))).alias("url"))
    records = ops.canonicalize(url_records(spark, sf_dir).select("url").unionByName(mails))
    known = ops.canonicalize(_pages(spark, sf_dir).where(F.col("url").contains("/en/"))).select("canonical_url").distinct()
    _, _, counts = ledger.add_urls(known.withColumn("domain", F.lit("x")), spark.createDataFrame([], "canonical_url string, source_kind string, source_value string"), records, "seed", "list")
    return counts


def unvisited(spark, sf_dir):
    """Distinct links seen on pages that are no pages of the ledger, by the link's domain."""
    links = ops.canonicalize(page_links(spark, sf_dir).select("from_url", "href"), url="href", base="from_url").where("reject is null")
    return reviews.unvisited(links, ops.canonicalize(_pages(spark, sf_dir)).select("canonical_url"))


def link_counts(spark, sf_dir):
    """Links by kind of pages on which every seventh link writes a mail, every eleventh leads elsewhere and every thirteenth to a place on the page."""
    from loomledger.operators import html

    rows = page_links(spark, sf_dir).withColumn("k", F.col("page_id") * 3 + F.col("n"))
    href = F.when(F.col("k") % 7 == 0, "mailto:a@b.example").when(F.col("k") % 11 == 0, "https://elsewhere.example.com/x").when(F.col("k") % 13 == 0, "#top").when(F.col("k") % 17 == 0, "").otherwise(F.col("href"))
    tags = rows.select("page_id", "from_url", "n", F.concat(F.lit('<a href="'), href, F.lit('">x</a>')).alias("a"))
    made = tags.groupBy("page_id", F.col("from_url").alias("url")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "a"))), lambda x: x["a"]), "").alias("html"))
    return html.link_counts(html.extract_links(html.parse_pages(made)))


def _discovered(spark, sf_dir):
    """Pages as addresses of sitemaps, declared ones and conventional ones, links of every page, and a link list of earlier pages; some sources failed."""
    pages = ops.canonicalize(_pages(spark, sf_dir).select("page_id", "url"))
    links = ops.canonicalize(page_links(spark, sf_dir), url="href", base="from_url").where("reject is null")
    failed = table(spark, sf_dir, "pages").where("page_id % 9 = 0").select(F.when(F.col("page_id") % 2 == 0, "sitemap").otherwise("internal_link").alias("source_kind"), F.col("url").alias("source"), F.lit("http_503").alias("code"))
    return reviews.discover({"robots": pages.where("page_id % 3 = 0"), "sitemap": pages.where("page_id % 2 = 0"), "internal_link": links}, failed)


def discovered(spark, sf_dir):
    """Counts of addresses by the kinds that found them."""
    items, _, _ = _discovered(spark, sf_dir)
    return items.groupBy(F.array_join("kinds", "+").alias("kinds")).agg(F.count(F.lit(1)).alias("items"), F.sum("times").alias("sources"))


def discovery_kinds(spark, sf_dir):
    """What each kind of source found, and how many of its sources failed."""
    return _discovered(spark, sf_dir)[1]


def external_hops(spark, sf_dir):
    """Links of the pages, and a way out from every fifth: to a first host, from there on to a second and a third, and to pages of their own."""
    pages = _pages(spark, sf_dir)
    links = ops.canonicalize(page_links(spark, sf_dir), url="href", base="from_url").where("reject is null").select("from_url", F.col("canonical_url").alias("to_url"))
    k = (F.col("page_id") % 7).cast("string")
    at = lambda n, end="": F.concat(F.lit(f"https://hop{n}.example.com/"), k, F.lit(end))
    ways = pages.where("page_id % 5 = 0").select(F.explode(F.array(*(F.struct(a.alias("from_url"), b.alias("to_url")) for a, b in ((F.col("url"), at(1)), (at(1), at(2)), (at(2), at(3)), (at(1), at(1, "/in")), (at(2), F.concat(F.lit("https://free.example.com/"), k)))))).alias("e")).select("e.*")
    return ops.external_hops(links.unionByName(ways), pages.select("url"), ["free.example.com"], 2).select("url", "domain", "hops")


def top_domains(spark, sf_dir):
    return reviews.top_domains(ops.canonicalize(_pages(spark, sf_dir)))


def domain_profile(spark, sf_dir):
    """The five most frequent shapes, combinations of parameters, facets and exclusions of every domain, and its number of addresses."""
    urls = ops.path_shapes(_pages(spark, sf_dir).withColumn("domain", U.host(F.col("url"))), "url")
    return reviews.domain_profile(urls.select("domain", "shape", "combo", "facet_keys"), 5, _excluded(spark, sf_dir))


def capped_admission(spark, sf_dir):
    """First-come admission under one cap of ten addresses a domain."""
    return ledger.admit_capped(ops.canonicalize(url_records(spark, sf_dir)).select("line", "canonical_url", "domain"), "domain", "line", 10).groupBy("domain").agg(F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("parked"))


def batches(spark, sf_dir):
    """Work batches of 25 pages in order of their ids."""
    return ledger.assign_batches(_pages(spark, sf_dir), "page_id", 25).select("page_id", "batch_id", "place")


# --- the SQL side, written for the tables' plain ASCII addresses --------------------------------------------------

_HOST, _PATH, _QUERY = "lower(regexp_extract({u}, '^https?://([^/?#]*)', 1))", "regexp_extract({u}, '^https?://[^/?#]*([^?#]*)', 1)", "regexp_extract({u}, '\\?([^#]*)', 1)"


def _host(u: str) -> str:
    return _HOST.format(u=u)


def _path(u: str) -> str:
    return _PATH.format(u=u)


def _some_path(u: str) -> str:
    return f"CASE WHEN {_path(u)} = '' THEN '/' ELSE {_path(u)} END"


def _query(u: str) -> str:
    return _QUERY.format(u=u)


_GONE = ", ".join(f"'{p.lower()}'" for p in U.DROP_PARAMS if p.lower() not in U.KEEP_PARAMS)
_PARAMS = "list_filter(string_split({q}, '&'), lambda p: p <> '')"
_KEY = "lower(split_part(p, '=', 1))"


def _canonical(u: str, gone: str = f"{_KEY} IN ({_GONE})") -> str:
    q = _PARAMS.format(q=_query(u))
    kept = f"array_to_string(list_transform(list_sort(list_filter({q}, lambda p: NOT ({gone}))), lambda p: split_part(p, '=', 1) || '=' || split_part(p, '=', 2)), '&')"
    path = f"regexp_replace({_path(u)}, '/+$', '')"
    return f"regexp_extract({u}, '^(https?)', 1) || '://' || {_host(u)} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN {kept} = '' THEN '' ELSE '?' || {kept} END"


def _dropped(u: str, gone: str = f"{_KEY} IN ({_GONE})") -> str:
    return f"array_to_string(list_transform(list_filter({_PARAMS.format(q=_query(u))}, lambda p: {gone}), lambda p: split_part(p, '=', 1)), ',')"


_SHAPE = f"""CASE WHEN {_path('url')} = '' THEN '/' ELSE array_to_string(list_transform(string_split({_path('url')}, '/'), lambda s: CASE WHEN regexp_matches(s, '^[0-9]+$|^[0-9a-fA-F]{{8,}}$|[0-9]{{4}}-[0-9]{{2}}(-[0-9]{{2}})?$') THEN '*' ELSE s END), '/') END"""
_KEYS = f"list_transform({_PARAMS.format(q=_query('url'))}, lambda p: {_KEY})"
_FACETS = f"list_filter({_KEYS}, lambda k: regexp_matches(k, '{U.FACET_KEY}'))"
_WORD = f"lower(regexp_extract({_path('url')}, '(?i){U.FACET_PATH}', 1))"
_LOWER_PATH = f"lower({_some_path('url')})"
_IS_LISTING = f"regexp_matches({_LOWER_PATH}, '{U.KIND_LISTING}')"
_IS_DETAIL = f"(regexp_matches({_LOWER_PATH}, '{U.KIND_DETAIL}') AND NOT regexp_matches(list_extract(string_split(regexp_replace({_LOWER_PATH}, '/+$', ''), '/'), -1), '{U.KIND_LISTING_LAST}'))"
_IS_SITEMAP = f"(regexp_matches({_LOWER_PATH}, '\\.xml$') OR contains({_LOWER_PATH}, 'sitemap'))"


def _kind(cards: str = "0") -> str:
    listing = f"({cards} >= 2 OR {_IS_LISTING})"
    return f"CASE WHEN {_IS_SITEMAP} THEN 'sitemap' WHEN {listing} AND NOT {_IS_DETAIL} THEN 'listing' WHEN {_IS_DETAIL} AND NOT {listing} THEN 'detail' ELSE 'unknown' END"


def _evidence(cards: str = "0") -> str:
    found = f"list_filter([CASE WHEN {cards} >= 2 THEN 'cards:' || {cards} END, CASE WHEN {_IS_LISTING} THEN 'path_looks_listing' END, CASE WHEN {_IS_DETAIL} THEN 'path_looks_detail' END], lambda e: e IS NOT NULL)"
    return f"CASE WHEN {_IS_SITEMAP} THEN 'path_looks_sitemap' WHEN len({found}) = 0 THEN 'no_signal' ELSE array_to_string({found}, ',') END"


def _glob(pattern: str) -> str:
    return "^" + "/".join(".+" if s == "**" else "[^/]+" if s == "*" else s.replace(".", r"\.") for s in pattern.split("/")) + "/?$"


def _hit(side: str, own: bool) -> str:
    parts = [f"(regexp_matches({_some_path('url')}, '{_glob(p)}')" + (f" AND {_host('url')} = '{scope}')" if scope else ")") for s, p, scope in _PATTERNS if s == side and bool(scope) == own and p.startswith("/")]
    return "(" + (" OR ".join(parts) or "false") + ")"


def _robots_sql() -> str:
    groups = {}
    for host, group, agents, kind, path in _ROBOTS:
        groups.setdefault(host, {}).setdefault(group, (agents, []))[1].append((kind, path))
    rows = []
    for host, found in groups.items():
        named = [(max(len(a) for a in agents if a != "*" and "loombot".startswith(a)), -g, rules) for g, (agents, rules) in found.items() if any(a != "*" and "loombot".startswith(a) for a in agents)]
        stars = [(0, -g, rules) for g, (agents, rules) in found.items() if "*" in agents]
        for kind, path in max(named or stars or [(0, 0, [])])[2]:
            escaped = "".join("\\" + c if c in ".+?^${}()|[]\\" else c for c in path)
            escaped = (escaped[:-2] + "$" if escaped.endswith("\\$") else escaped).replace("*", ".*")
            rows.append(f"('{host}', '{kind}', '{path}', '^{escaped}')")
    target = f"{_some_path('url')} || CASE WHEN {_query('url')} = '' THEN '' ELSE '?' || {_query('url')} END"
    return f"""
WITH rules(host, kind, path, regex) AS (VALUES {', '.join(rows)}),
hits AS (SELECT page_id, kind, path, row_number() OVER (PARTITION BY page_id ORDER BY length(path) DESC NULLS LAST, kind = 'allow' DESC) AS r
  FROM pages LEFT JOIN rules ON {_host('url')} = host AND regexp_matches({target}, regex))
SELECT page_id, coalesce(kind = 'allow', true) AS allowed, coalesce(kind, '-') AS rule_type, coalesce(path, '-') AS rule_path FROM hits WHERE r = 1"""


_DOMAIN_GONE = (
    f"({_KEY} IN ({_GONE}) OR ({_host('url')} = 'spam-farm.example.org' AND {_KEY} IN ('page') AND {_KEY} NOT IN ({', '.join(repr(k) for k in U.KEEP_PARAMS)})))"
    f" AND NOT ({_host('url')} = 'spam-farm.example.org' AND {_KEY} = 'ref') AND NOT ({_host('url')} = 'ththin.example.com' AND {_KEY} = 'utm_source')"
)
_LINK_URL = "CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href ELSE regexp_extract(from_url, '^(https?://[^/?#]*)', 1) || href END"
_ENCODED = "array_to_string(list_transform(string_split({u}, ''), lambda c: CASE WHEN regexp_matches(c, '[^\\x21-\\x7e]|[\"<>`{{}}]') THEN url_encode(c) ELSE c END), '')"
_LINK_CANONICAL = f"({_canonical('(' + _ENCODED.format(u='u') + ')')})"
_LINKS = f"links AS (SELECT page_id, from_url, {_LINK_URL} AS u FROM ({PAGE_LINKS_SQL}) WHERE href <> ''), canon AS (SELECT page_id, from_url, {_LINK_CANONICAL} AS canonical_url, {_host('u')} AS domain FROM links)"

_EXCLUDED_SQL = f"""SELECT page_id, CASE WHEN g IS NOT NULL THEN 'excluded_path_pattern:' || g ELSE 'excluded_query_key:' || k END AS rule, domain FROM (
  SELECT page_id, CASE WHEN regexp_matches({_some_path('url')}, '{_glob('/fr/*')}') THEN '/fr/*' WHEN regexp_matches({_some_path('url')}, '{_glob('/es/*')}') THEN '/es/*' END AS g,
    list_extract(list_filter({_KEYS}, lambda k: k IN ('ref', 'utm_source')), 1) AS k, {_host('url')} AS domain FROM pages) WHERE g IS NOT NULL OR k IS NOT NULL"""
_DISCOVERED_SQL = f"""WITH {_LINKS}, every AS (SELECT {_canonical('url')} AS c, 'robots' AS k FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT {_canonical('url')}, 'sitemap' FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT canonical_url, 'internal_link' FROM canon)"""

QUERIES = {
    "ur01_canonicalize": canonicalize,
    "ur02_canonicalize_by_domain": canonicalize_by_domain,
    "wn01_first_wins": first_wins,
    "ur03_04_05_url_shapes": url_shapes,
    "ur06_url_kinds": url_kinds,
    "ur06_url_kinds_with_cards": url_kinds_with_cards,
    "ur07_kind_by_patterns": kind_by_patterns,
    "ur09_page_series": page_series,
    "ur10_same_hosts": same_hosts,
    "ur11_url_ids": url_ids,
    "ur12_url_priority": url_priority,
    "tk03_queue_order": queue_order,
    "ur14_slugs": slugs,
    "ur15_name_patterns": name_patterns,
    "jn05_domains_listed": domains_listed,
    "fl05_exclusions": exclusions,
    "ag26_excluded_by": excluded_by,
    "jn03_robots": robots,
    "jn01_add_urls": add_urls,
    "ag28_unvisited": unvisited,
    "ag18_link_counts": link_counts,
    "so01_discovered": discovered,
    "so01_discovery_kinds": discovery_kinds,
    "it02_external_hops": external_hops,
    "ag10_top_domains": top_domains,
    "ag12_domain_profile": domain_profile,
    "wn09_capped_admission": capped_admission,
    "wn03_batches": batches,
}

ORACLE = {
    "ur01_canonicalize": f"SELECT line, url AS original_url, {_canonical('url')} AS canonical_url, {_host('url')} AS domain, {_dropped('url')} AS dropped, CAST(NULL AS VARCHAR) AS reject FROM ({URL_RECORDS_SQL})",
    "ur02_canonicalize_by_domain": f"SELECT line, {_canonical('url', _DOMAIN_GONE)} AS canonical_url, {_dropped('url', _DOMAIN_GONE)} AS dropped FROM ({URL_RECORDS_SQL})",
    "wn01_first_wins": f"SELECT canonical_url, arg_min(url, line) AS original_url, min(line) AS line, count(*) AS n_rows FROM (SELECT *, {_canonical('url')} AS canonical_url FROM ({URL_RECORDS_SQL})) WHERE canonical_url IS NOT NULL GROUP BY canonical_url",
    "ur03_04_05_url_shapes": f"""SELECT page_id, {_SHAPE} AS shape, array_to_string(list_sort({_KEYS}), '&') AS combo,
        CASE WHEN {_WORD} <> '' THEN 'path' WHEN len({_FACETS}) > 0 THEN 'query' ELSE '-' END AS facet,
        array_to_string(list_concat(CASE WHEN {_WORD} <> '' THEN ['path:' || {_WORD}] ELSE [] END, list_transform({_FACETS}, lambda k: 'query:' || k)), ',') AS facet_keys FROM pages""",
    "ur06_url_kinds": f"SELECT page_id, {_kind()} AS kind, CASE WHEN {_kind()} = 'unknown' THEN 'needs_review' ELSE 'proposed' END AS kind_status, {_evidence()} AS evidence FROM pages",
    "ur06_url_kinds_with_cards": f"SELECT page_id, {_kind('cards')} AS kind, {_evidence('cards')} AS evidence FROM (SELECT page_id, url, len(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) AS cards FROM pages)",
    "ur07_kind_by_patterns": f"""SELECT page_id, coalesce(own, general, '-') AS kind_by_pattern,
        CASE WHEN clash THEN 'both_matched' ELSE '-' END AS kind_why, coalesce(own, general, 'unknown') AS kind,
        CASE WHEN own IS NOT NULL THEN 'domain' WHEN general IS NOT NULL THEN 'policy' ELSE 'default' END AS kind_source FROM (
          SELECT page_id, CASE WHEN {_hit('listing', True)} AND NOT {_hit('detail', True)} THEN 'listing' WHEN {_hit('detail', True)} AND NOT {_hit('listing', True)} THEN 'detail' END AS own,
            CASE WHEN {_hit('listing', False)} AND NOT {_hit('detail', False)} THEN 'listing' WHEN {_hit('detail', False)} AND NOT {_hit('listing', False)} THEN 'detail' END AS general,
            ({_hit('listing', True)} AND {_hit('detail', True)}) OR ({_hit('listing', False)} AND {_hit('detail', False)}) AS clash FROM pages)""",
    "ur09_page_series": f"""WITH p AS (SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) AS rest, {_path('url')} AS path, {_PARAMS.format(q=_query('url'))} AS params, {_query('url')} AS q FROM pages),
        n AS (SELECT *, list_extract(list_filter(params, lambda p: {_KEY} = 'page' AND regexp_matches(split_part(p, '=', 2), '^[0-9]+$')), 1) AS hit,
          array_to_string(list_filter(params, lambda p: {_KEY} <> 'page'), '&') AS others, regexp_extract(path, '/([0-9]+)$', 1) AS tail FROM p)
        SELECT page_id, CASE WHEN hit IS NOT NULL THEN rest || CASE WHEN others = '' THEN '' ELSE '?' || others END
            WHEN tail <> '' THEN regexp_replace(rest, '/[0-9]+$', '') || CASE WHEN regexp_replace(path, '/[0-9]+$', '') = '' THEN '/' ELSE '' END || CASE WHEN q = '' THEN '' ELSE '?' || q END END AS series,
          CASE WHEN hit IS NOT NULL THEN CAST(split_part(hit, '=', 2) AS BIGINT) WHEN tail <> '' THEN CAST(tail AS BIGINT) END AS page_index FROM n""",
    "ur10_same_hosts": f"SELECT regexp_replace(h, '^www\\.', '') AS bare, count(*) AS pages, count(DISTINCT h) AS hosts FROM (SELECT {_host('url')} AS h FROM pages) GROUP BY 1",
    "ur11_url_ids": f"SELECT page_id, substr(sha256({_canonical('url')}), 1, 20) AS url_id, substr(sha256({_host('url')}), 1, 12) AS origin_id FROM pages",
    "ur12_url_priority": f"""SELECT page_id, kind, CAST(CASE kind WHEN 'listing' THEN 100 WHEN 'sitemap' THEN 90 WHEN 'detail' THEN 10 ELSE 50 END - 10 * (len(string_split(path, '/')) - 2) + CASE WHEN contains(url, 'utm') THEN 1 ELSE 0 END AS INTEGER) AS priority
        FROM (SELECT page_id, url, {_path('url')} AS path, {_kind()} AS kind FROM pages)""",
    "tk03_queue_order": f"""SELECT page_id, CAST(CASE kind WHEN 'listing' THEN 100 WHEN 'sitemap' THEN 90 WHEN 'detail' THEN 10 ELSE 50 END - 10 * (len(string_split(path, '/')) - 2) AS INTEGER) AS priority, domain
        FROM (SELECT page_id, {_path('url')} AS path, {_kind()} AS kind, {_host('url')} AS domain FROM pages) ORDER BY priority DESC, domain, page_id""",
    "ur14_slugs": r"SELECT doc_id, CASE WHEN s = '' THEN 'untitled' ELSE s END AS slug FROM (SELECT doc_id, regexp_replace(substr(regexp_replace(regexp_extract(text, '^([^\n]*)', 1), '[^\p{L}\p{N}]+', '-', 'g'), 1, 40), '^-+|-+$', '', 'g') AS s FROM documents)",
    "ur15_name_patterns": """SELECT c_custkey, CASE WHEN ok THEN '2024-' || m ELSE '-' END AS name_month, CASE WHEN ok THEN c_name ELSE '-' END AS name_title,
        CASE WHEN ok THEN '-' WHEN NOT tagged THEN 'unknown_tag' ELSE 'bad_date' END AS reject FROM (
          SELECT *, tagged AND CAST(m AS INTEGER) BETWEEN 1 AND 12 AS ok FROM (SELECT c_custkey, c_name, lpad(CAST(c_custkey % 14 AS VARCHAR), 2, '0') AS m, lower(c_mktsegment) IN ('building', 'machinery', 'household') AS tagged FROM customer))""",
    "jn05_domains_listed": f"""SELECT page_id, d AS domain FROM (SELECT page_id, {_host('url')} AS d, regexp_replace({_host('url')}, '^www\\.', '') AS b FROM pages)
        WHERE b = 'example.org' OR ends_with(b, '.example.org') OR b = 'cheap-pills.example.com' OR ends_with(b, '.cheap-pills.example.com') OR b = 'ththin.example.com' OR ends_with(b, '.ththin.example.com')""",
    "fl05_exclusions": f"""SELECT page_id, CASE WHEN g IS NOT NULL THEN 'excluded_path_pattern' WHEN k IS NOT NULL THEN 'excluded_query_key' ELSE '-' END AS why, coalesce(g, k, '-') AS why_evidence FROM (
        SELECT page_id, CASE WHEN regexp_matches({_some_path('url')}, '{_glob('/fr/*')}') THEN '/fr/*' WHEN regexp_matches({_some_path('url')}, '{_glob('/es/*')}') THEN '/es/*' END AS g,
          list_extract(list_filter({_KEYS}, lambda k: k IN ('ref', 'utm_source')), 1) AS k FROM pages)""",
    "ag26_excluded_by": f"""SELECT rule, domain, count(*) FILTER (page_id % 3 <> 0) AS active, count(*) FILTER (page_id % 3 = 0) AS resolved FROM ({_EXCLUDED_SQL}) GROUP BY ALL ORDER BY active DESC, rule, domain LIMIT 20""",
    "jn03_robots": _robots_sql(),
    "jn01_add_urls": f"""WITH r AS (SELECT {_canonical('url')} AS c FROM ({URL_RECORDS_SQL})), known AS (SELECT DISTINCT {_canonical('url')} AS c FROM pages WHERE contains(url, '/en/'))
        SELECT count(*) + any_value(m) AS received, count(DISTINCT c) FILTER (c NOT IN (SELECT c FROM known)) AS added, count(*) - count(DISTINCT c) FILTER (c NOT IN (SELECT c FROM known)) AS duplicates, any_value(m) AS rejected, count(DISTINCT c) AS sources_added FROM r, (SELECT count(*) FILTER (page_id % 10 = 0) AS m FROM pages)""",
    "ag28_unvisited": f"""WITH {_LINKS}, p AS (SELECT {_canonical('url')} AS c FROM pages)
        SELECT domain, count(*) AS links_seen, count(DISTINCT canonical_url) FILTER (canonical_url NOT IN (SELECT c FROM p)) AS unvisited FROM canon GROUP BY domain""",
    "ag18_link_counts": f"""SELECT page_id, count(*) AS total, count(*) FILTER (f IN ('top', 'own')) AS internal, count(*) FILTER (f = 'away') AS external, count(*) FILTER (f = 'mail') AS non_http, CAST(0 AS BIGINT) AS unresolvable, count(*) FILTER (f = 'none') AS no_href, count(*) FILTER (f = 'top') AS fragment_only
        FROM (SELECT page_id, CASE WHEN k % 7 = 0 THEN 'mail' WHEN k % 11 = 0 THEN 'away' WHEN k % 13 = 0 THEN 'top' WHEN k % 17 = 0 THEN 'none' ELSE 'own' END AS f FROM (SELECT page_id, page_id * 3 + n AS k FROM ({PAGE_LINKS_SQL}))) GROUP BY page_id""",
    "so01_discovered": f"""{_DISCOVERED_SQL}, items AS (SELECT c, array_to_string(list_sort(list_distinct(list(k))), '+') AS kinds, count(*) AS n FROM every GROUP BY c) SELECT kinds, count(*) AS items, CAST(sum(n) AS BIGINT) AS sources FROM items GROUP BY kinds""",
    "so01_discovery_kinds": f"""{_DISCOVERED_SQL}, k AS (SELECT unnest(['robots', 'sitemap', 'internal_link', 'import']) AS k), b AS (SELECT CASE WHEN page_id % 2 = 0 THEN 'sitemap' ELSE 'internal_link' END AS k, count(*) AS n FROM pages WHERE page_id % 9 = 0 GROUP BY 1)
        SELECT k.k AS source_kind, count(DISTINCT c) AS items, count(c) AS sources, coalesce(any_value(b.n), 0) AS failed, coalesce(any_value(b.n), 0) > 0 AS partial FROM k LEFT JOIN every e ON e.k = k.k LEFT JOIN b ON b.k = k.k GROUP BY k.k""",
    "it02_external_hops": f"""WITH {_LINKS}, k AS (SELECT DISTINCT page_id % 7 AS k FROM pages WHERE page_id % 5 = 0), reached AS (SELECT url, 0 AS h FROM pages UNION ALL SELECT canonical_url, 0 FROM canon
          UNION ALL SELECT 'https://hop1.example.com/' || k, 1 FROM k UNION ALL SELECT 'https://hop1.example.com/' || k || '/in', 1 FROM k UNION ALL SELECT 'https://hop2.example.com/' || k, 2 FROM k UNION ALL SELECT 'https://free.example.com/' || k, 2 FROM k)
        SELECT url, {_host('url')} AS domain, CAST(min(h) AS INTEGER) AS hops FROM reached GROUP BY url""",
    "ag10_top_domains": f"SELECT {_host('url')} AS domain, count(*) AS urls FROM pages GROUP BY 1 ORDER BY urls DESC, domain LIMIT 20",
    "ag12_domain_profile": f"""WITH f AS (SELECT {_host('url')} AS domain, {_SHAPE} AS shape, array_to_string(list_sort({_KEYS}), '&') AS combo, list_concat(CASE WHEN {_WORD} <> '' THEN ['path:' || {_WORD}] ELSE [] END, list_transform({_FACETS}, lambda k: 'query:' || k)) AS facets FROM pages),
        v AS (SELECT domain, 'shape' AS part, shape AS value FROM f UNION ALL SELECT domain, 'combo', combo FROM f WHERE combo <> '' UNION ALL SELECT domain, 'facet_key', unnest(facets) FROM f UNION ALL SELECT domain, 'excluded_by', rule FROM ({_EXCLUDED_SQL})),
        c AS (SELECT domain, part, value, count(*) AS n FROM v GROUP BY ALL)
        SELECT domain, part, CAST(rank AS INTEGER) AS rank, value, n, urls FROM (SELECT *, row_number() OVER (PARTITION BY domain, part ORDER BY n DESC, value) AS rank FROM c) JOIN (SELECT domain, count(*) AS urls FROM f GROUP BY domain) USING (domain) WHERE rank <= 5""",
    "wn09_capped_admission": f"""SELECT domain, count(*) FILTER (r <= 10) AS admitted, count(*) FILTER (r > 10) AS parked FROM (SELECT domain, row_number() OVER (PARTITION BY domain ORDER BY line) AS r FROM (SELECT line, {_host('url')} AS domain FROM ({URL_RECORDS_SQL}))) GROUP BY domain""",
    "wn03_batches": "SELECT page_id, (row_number() OVER (ORDER BY page_id) - 1) // 25 AS batch_id, CAST((row_number() OVER (ORDER BY page_id) - 1) % 25 AS BIGINT) AS place FROM pages",
}
