"""Queries of page text, links, images, data blocks, card groups and verdicts, with SQL that takes the same pages apart by patterns.

The given pages link from a navigation list and have no images. ``_illustrated`` derives pages from them in which that list is a grid of
illustrated links, so that images, cards, layouts and profiles have something to find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomledger.functions import urls as U
from loomledger.operators import html as ops
from loomledger.operators import text as text_ops
from loomledger.operators import urls as url_ops
from loomledger.plans.url_queries import _host, _kind, _path
from loomledger.sources.tables import checkpointed, table

_JSONLD = '<script type="application/ld+json">{"@type": "ItemList", "itemListElement": ["a", "b", "c"]}</script>'
_COUNT = " results</p>"


def _illustrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with an illustrated grid: images named by their link's first letter, every fourth page with a JSON-LD list, every third with a stated number."""
    p = table(spark, sf_dir, "pages")
    html = F.regexp_replace("html", '<a href="/?([^"])([^"]*)">', '<a href="/$1$2"><img src="$1.png" width="80">')
    html = F.replace(F.replace(html, F.lit("<nav>"), F.lit('<div class="list  wide main">')), F.lit("</nav>"), F.lit("</div>"))
    number = F.concat(F.lit("<p>"), (F.col("page_id") % 9).cast("string"), F.lit(_COUNT))
    html = F.when(F.col("page_id") % 3 == 0, F.replace(html, F.lit("<article>"), F.concat(F.lit("<article>"), number))).otherwise(html)
    return p.withColumn("html", F.when(F.col("page_id") % 4 == 0, F.replace(html, F.lit("</head>"), F.lit(_JSONLD + "</head>"))).otherwise(html))


def extracted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.extract_text(ops.parse_pages(table(spark, sf_dir, "pages")))
    return out.select("page_id", "title", F.sha2("text", 256).alias("text_hash"), "chars", "lines", "skipped_hidden", "skipped_script_style")


def extracted_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.extract_links(ops.parse_pages(table(spark, sf_dir, "pages"))).select("page_id", "index", "raw_href", "text", "landmark", "internal", "kind")


def extracted_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images by address, with the number of places that use them."""
    images = ops.extract_images(ops.parse_pages(_illustrated(spark, sf_dir)))
    return images.select("page_id", "kind", F.array_join("raw", ",").alias("raw"), F.size("references").alias("uses"), F.element_at("references", 1)["dom_index"].alias("first"), F.element_at("references", 1)["landmark"].alias("landmark"))


def jsonld_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.jsonld_items(_illustrated(spark, sf_dir)).select("page_id", F.col("jsonld").cast("int").alias("jsonld"))


def grouped_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of every page: members, whether their paths are alike, and its signature."""
    groups, _ = ops.card_groups(ops.parse_pages(_illustrated(spark, sf_dir)))
    return groups.where("best").select("page_id", "members", "linked", "similar_path", "signature")


def card_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card ids of every page's links, as if each carried an image named by its text."""
    links = ops.extract_links(ops.parse_pages(table(spark, sf_dir, "pages"))).join(table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("source_url")), "page_id")
    cards = links.select("page_id", "source_url", U.host(F.col("source_url")).alias("domain"), F.col("index").alias("position"), F.when(F.col("index") % 2 == 0, F.col("href")).alias("href"), F.when(F.col("index") % 3 != 0, F.substring("text", 1, 1)).alias("img"))
    return ops.card_ids(cards).select("page_id", "position", "card_id", "id_confidence", F.coalesce("id_why", F.lit("-")).alias("id_why"))


def page_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged: some were not found, some led to the start page, some have a profile that fits or has changed, some are Markdown."""
    n = F.col("page_id")
    pages = _illustrated(spark, sf_dir)
    parsed = checkpointed(ops.parse_pages(pages))  # one parse for text and cards
    groups, _ = ops.card_groups(parsed)
    best = groups.where("best").select("page_id", F.col("members").alias("cards"), "similar_path", "signature")
    rows = url_ops.classify_kind(ops.jsonld_items(pages)).join(ops.extract_text(parsed).select("page_id", "title", "text"), "page_id").join(best, "page_id", "left")
    rows = text_ops.declared_count(rows, "text").withColumns({
        "status": F.when(n % 10 == 7, 404).otherwise(200),
        "requested": F.col("url"),
        "final": F.when(n % 13 == 5, F.concat(F.lit("https://"), U.host(F.col("url")), F.lit("/"))).when(n % 13 == 6, F.lit("https://elsewhere.example/x")).otherwise(F.col("url")),
        "has_image": F.lit(True),
        "accepted_signature": F.when(n % 5 == 1, F.col("signature")).when(n % 5 == 2, F.lit("li.>ul.>div.other|0|n=1")),
        "markdown": n % 7 == 3,
        "text": F.when(n % 17 == 4, F.substring("text", 1, 120)).otherwise(F.col("text")),
    })
    out = ops.page_verdict(rows)
    return out.select("page_id", "kind", "validity", "extraction", F.array_join("negatives", ",").alias("negatives"), F.array_join("evidence", ",").alias("evidence"))


QUERIES = {
    "ht01_extracted_text": extracted_text,
    "ht03_extracted_links": extracted_links,
    "ht05_extracted_images": extracted_images,
    "ht07_jsonld_items": jsonld_items,
    "ht08_card_groups": grouped_cards,
    "ht09_page_verdicts": page_verdicts,
    "ht10_card_identities": card_identities,
}

_BLOCK = "p|div|article|h1|ul|li|nav|footer|body|html|head|br"


def _plain(expr: str) -> str:
    return f"replace(replace(replace(replace({expr}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"


def _text(html: str) -> str:
    """The visible lines: comments and the head's elements go, block elements end lines, other elements vanish, entities are read."""
    bare = rf"regexp_replace(regexp_replace({html}, '<!--.*?-->', '', 'gs'), '<head>.*</head>', '', 's')"
    cut = rf"regexp_replace(regexp_replace(regexp_replace({bare}, '\s+', ' ', 'g'), '</?({_BLOCK})( [^>]*)?>', chr(10), 'g'), '<[^>]*>', '', 'g')"
    return rf"array_to_string(list_filter(list_transform(string_split({_plain(cut)}, chr(10)), lambda s: trim(regexp_replace(s, '[ \t]+', ' ', 'g'))), lambda s: s <> ''), chr(10))"


_TITLE = _plain("trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1))")
_LIST_SQL = r"""SELECT * REPLACE (CASE WHEN page_id % 4 = 0 THEN replace(html, '</head>', '{jsonld}</head>') ELSE html END AS html) FROM (
  SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN replace(h, '<article>', '<article><p>' || page_id % 9 || '{count}') ELSE h END AS html FROM (
    SELECT page_id, url, replace(replace(regexp_replace(html, '<a href="/?([^"])([^"]*)">', '<a href="/\1\2"><img src="\1.png" width="80">', 'g'), '<nav>', '<div class="list  wide main">'), '</nav>', '</div>') AS h FROM pages))"""
_ILLUSTRATED_SQL = _LIST_SQL.format(jsonld=_JSONLD, count=_COUNT)
_HREFS = "regexp_extract_all(html, '<li><a href=\"([^\"]*)\">', 1)"
_LINKS_SQL = rf"""SELECT page_id, url, unnest(range(len(h)))::INTEGER AS index, unnest(h) AS raw_href, unnest(t) AS text
  FROM (SELECT page_id, url, {_HREFS} AS h, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1) AS t FROM pages)"""
#: A page's path with percent signs, as canonical addresses have it: bytes that aren't plain are written in hexadecimal.
_ENCODED = "array_to_string(list_transform(string_split(raw_href, ''), lambda c: CASE WHEN ord(c) > 127 THEN regexp_replace(hex(encode(c)), '(..)', '%\\1', 'g') ELSE c END), '')"
_TREE = "sha256('li(' || sha256('a(' || sha256('img()') || ')') || ')')"
_GROUPS_SQL = rf"""SELECT page_id, count(DISTINCT raw_href) AS members, true AS linked, count(DISTINCT regexp_replace(raw_href, '[^/]+$', '*')) <= greatest(1, ceil(count(DISTINCT raw_href) / 4)) AS similar_path,
    'li.>ul.>div.list.wide|' || {_TREE} || '|n=' || count(DISTINCT raw_href) AS signature FROM ({_LINKS_SQL}) GROUP BY page_id HAVING count(DISTINCT raw_href) >= 2"""
_MARKS = "[" + ", ".join("'" + m + "'" for m in ops.ERROR_MARKS) + "]"

ORACLE = {
    "ht01_extracted_text": f"""SELECT page_id, title, sha256(text) AS text_hash, length(text)::INTEGER AS chars, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END::INTEGER AS lines, 0::INTEGER AS skipped_hidden,
        (len(regexp_extract_all(html, '<(style|script)[ >]')))::INTEGER AS skipped_script_style FROM (SELECT page_id, html, {_TITLE} AS title, {_text('html')} AS text FROM pages)""",
    "ht03_extracted_links": f"SELECT page_id, index, {_plain('raw_href')} AS raw_href, {_plain('text')} AS text, 'nav' AS landmark, true AS internal, 'http' AS kind FROM ({_LINKS_SQL})",
    "ht05_extracted_images": f"""SELECT page_id, 'http' AS kind, raw, count(*)::INTEGER AS uses, min(index)::INTEGER AS first, 'body' AS landmark FROM (SELECT page_id, index, {_plain('raw_href')}[2] || '.png' AS raw FROM ({_LINKS_SQL})) GROUP BY page_id, raw""",
    "ht07_jsonld_items": "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 3 ELSE 0 END::INTEGER AS jsonld FROM pages",
    "ht08_card_groups": _GROUPS_SQL,
    "ht10_card_identities": f"""WITH l AS (SELECT page_id, {_host('url')} AS domain, {_path('url')} AS path, index, CASE WHEN index % 2 = 0 THEN regexp_extract(url, '^(https?)', 1) || '://' || {_host('url')} || {_ENCODED} END AS href, CASE WHEN index % 3 <> 0 THEN {_plain('text')}[1] END AS img FROM ({_LINKS_SQL})),
        u AS (SELECT *, coalesce(img, '') <> '' AS named, count(*) OVER (PARTITION BY page_id, img) > 1 AS reused FROM l)
        SELECT page_id, index AS position, CASE WHEN href IS NOT NULL THEN sha256(href)[1:20] ELSE 'fb-' || sha256(CASE WHEN named AND NOT reused THEN domain || '|img:' || img ELSE domain || '|src:' || path || '|pos:' || index || '|img:' || coalesce(img, '') END)[1:18] END AS card_id,
        CASE WHEN href IS NOT NULL THEN 'detail_url' WHEN named AND NOT reused THEN 'image_url' ELSE 'position_fallback' END AS id_confidence,
        CASE WHEN href IS NOT NULL OR (named AND NOT reused) THEN '-' WHEN named THEN 'same_image_reused_on_page' ELSE 'no_image_url' END AS id_why FROM u""",
    "ht09_page_verdicts": rf"""WITH p AS (SELECT page_id, url, html, {_TITLE} AS title, {_text('html')} AS whole FROM ({_ILLUSTRATED_SQL})), g AS ({_GROUPS_SQL}),
        f AS (SELECT p.page_id, url, title, {_kind()} AS kind, CASE WHEN page_id % 17 = 4 THEN substr(whole, 1, 120) ELSE whole END AS text, page_id % 7 = 3 AS md, coalesce(members, 0) AS found, similar_path, signature,
            CASE WHEN page_id % 5 = 1 THEN signature WHEN page_id % 5 = 2 THEN 'li.>ul.>div.other|0|n=1' END AS accepted, CASE WHEN page_id % 10 = 7 THEN 404 ELSE 200 END AS status,
            TRY_CAST(nullif(replace(regexp_extract(substr(whole, 1, 3000), '(?i)([0-9,]+)\s*(?:items|products|results)\b', 1), ',', ''), '') AS BIGINT) AS stated, CASE WHEN page_id % 4 = 0 THEN 3 ELSE 0 END AS ld,
            page_id % 13 = 5 AND url <> 'https://' || {_host('url')} || '/' AS home, page_id % 13 = 6 AS away FROM p LEFT JOIN g USING (page_id)),
        c AS (SELECT *, CASE WHEN md THEN 0 ELSE found END AS cards, CASE WHEN NOT md THEN stated END AS declared, CASE WHEN md THEN 0 ELSE ld END AS jsonld, length(trim(text)) AS chars, (home OR away) AND NOT md AS moved, signature IS NOT NULL AND accepted IS NOT NULL AND NOT md AS profiled,
            list_filter({_MARKS}, lambda m: contains(lower(CASE WHEN md THEN text ELSE title || chr(10) || text END), m)) AS marks FROM f),
        e AS (SELECT *, list_filter([CASE WHEN status = 404 THEN 'http_404' END, CASE WHEN len(marks) > 0 THEN 'error_phrase:' || marks[1] END, CASE WHEN chars < 200 AND cards < 2 THEN 'thin_text:' || chars END,
            CASE WHEN moved AND home AND {_path('url')} NOT IN ('', '/') THEN 'redirected_to_root' END, CASE WHEN moved AND away THEN 'redirected_offsite' END,
            CASE WHEN cards > 0 AND declared < cards THEN 'declared_overcount:' || declared || 'vs' || cards END, CASE WHEN profiled AND signature <> accepted THEN 'profile_signature_changed' END], lambda x: x IS NOT NULL) AS negatives,
          list_filter([CASE WHEN jsonld >= 2 THEN 'jsonld_items:' || jsonld END, CASE WHEN cards >= 2 THEN 'repeated_image_links:' || cards END, CASE WHEN similar_path AND NOT md THEN 'similar_path_shape' END, CASE WHEN cards > 0 AND declared = cards THEN 'declared_matches:' || declared END,
            CASE WHEN cards > 0 AND declared > cards THEN 'declared_partial:' || cards || '/' || declared END, CASE WHEN profiled AND signature = accepted THEN 'profile_signature_match' END, CASE WHEN md THEN 'markdown_text:' || chars END], lambda x: x IS NOT NULL) AS evidence FROM c),
        s AS (SELECT *, len(list_filter(evidence, lambda x: x NOT IN ('similar_path_shape'))) AS strong, kind = 'listing' OR cards >= 2 AS listish FROM e)
        SELECT page_id, kind, CASE WHEN len(negatives) > 0 THEN 'invalid' WHEN md THEN CASE WHEN kind = 'listing' THEN 'needs_visual_review' ELSE 'content_validated' END WHEN listish THEN CASE WHEN strong >= 2 THEN 'content_validated' ELSE 'needs_visual_review' END
            WHEN kind = 'detail' THEN CASE WHEN title <> '' AND chars >= 200 THEN 'content_validated' ELSE 'needs_visual_review' END WHEN moved THEN 'needs_visual_review' ELSE 'content_validated' END AS validity,
          CASE WHEN len(negatives) > 0 THEN CASE WHEN cards > 0 THEN 'incomplete' ELSE 'uncertain' END WHEN NOT md AND listish AND strong >= 1 THEN CASE WHEN declared IS NULL THEN CASE WHEN cards > 0 THEN 'uncertain' ELSE 'incomplete' END WHEN cards > 0 AND declared = cards THEN 'complete' ELSE 'incomplete' END ELSE 'uncertain' END AS extraction,
          array_to_string(negatives, ',') AS negatives, array_to_string(evidence, ',') AS evidence FROM s""",
}
