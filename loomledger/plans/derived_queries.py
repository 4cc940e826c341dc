"""Queries of operators whose inputs are derived from the given tables: references, evidence, hosts, sections, reports, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomledger.functions import urls as U
from loomledger.operators import docs as doc_ops
from loomledger.operators import graph, ledger, recon, stats
from loomledger.operators import text as text_ops
from loomledger.operators import urls as url_ops
from loomledger.sources.tables import table

def _hexed(text: str) -> str:
    return text.encode().hex().upper()


#: How the files begin, in hexadecimal, and what they are.
_BEGINNINGS = (
    ("89504E47", "image/png"), ("FFD8FF", "image/jpeg"), ("47494638", "image/gif"), ("424D", "image/bmp"), ("00000100", "image/x-icon"), ("", None),
    (_hexed("RIFFxxxxWEBP"), "image/webp"), (_hexed("xxxxftypavif"), "image/avif"), (_hexed("xxxxftypheic"), "image/heic"), (_hexed("<svg>"), "image/svg+xml"),
    (_hexed("\n<?xml version='1.0'?>\n<!-- a\n> <b> -->\n<!DOCTYPE svg PUBLIC 'x' [<!ENTITY y 'z'>]>\n<SVG width='1'>"), "image/svg+xml"), (_hexed("<!-- <svg> -->text"), None), (_hexed(" " * 300 + "<svg>"), None),
)
_MAGIC = tuple(b for b, _ in _BEGINNINGS)
_DECLARED = ("image/png", "image/jpg; q=1", "text/plain")
#: What screens show, and the state that it means. The first two say working with other times, the third says it without one.
_SHOWN = (
    ("Working (3s", "working"), ("Working (14s", "working"), ("esc to interrupt", "working"), ("Do you want to go on", "blocked"), ("model is at capacity", "capacity"), ("Context compacted", "done"),
    ("\u23fa Brewed for 3m\n\u276f ", "done"), ("Worked for 9s\nAsk Codex to do anything", "done"), ("\u276f fix it", "stuck-input"), ("tab to queue message", "stuck-input"), ("nothing here", "unknown"), ("\u23fa Brewed for 3m", "unknown"),
)
_SCREENS = tuple(text for text, _ in _SHOWN)


def _pick(values: tuple, n):
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def sniffed_types(spark, sf_dir):
    """Parts as files that begin as image formats do, with a declared type."""
    p = table(spark, sf_dir, "part")
    files = p.select("p_partkey", F.unhex(F.concat(_pick(_MAGIC, F.col("p_partkey")), F.hex("p_name"))).alias("content"), _pick(_DECLARED, F.col("p_partkey")).alias("declared"))
    return text_ops.sniff_mime(files, "content", "declared").select("p_partkey", F.coalesce("mime", F.lit("-")).alias("mime"), "mime_mismatch")


def _screens(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("surface"), F.col("event_id").alias("at"), _pick(_SCREENS, F.floor(F.col("event_id") / 150)).alias("text"))


def screen_states(spark, sf_dir):
    return _screens(spark, sf_dir).withColumn("state", text_ops.screen_state(F.col("text"))).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def screen_progress(spark, sf_dir):
    return text_ops.screen_progress(_screens(spark, sf_dir)).select("at", "surface", "state")


def compiled_globs(spark, sf_dir):
    """Paths of pages as path globs, some of them broken."""
    p = table(spark, sf_dir, "pages").withColumn("p", F.regexp_extract("url", "^https?://[^/?#]*([^?#]*)", 1))
    form = F.col("page_id") % 5
    pattern = F.when(form == 0, F.concat("p", F.lit("/*"))).when(form == 1, F.concat("p", F.lit("?x"))).when(form == 2, F.concat(F.lit("x"), "p")).when(form == 3, F.lit("/en/a*b")).otherwise(F.concat(F.lit("/**"), "p"))
    return url_ops.compile_globs(p.select("page_id", pattern.alias("pattern"))).select("page_id", F.coalesce("reject", F.lit("-")).alias("reject"), F.coalesce("regex", F.lit("-")).alias("regex"))


def robots_states(spark, sf_dir):
    """Hosts of pages with answers of their robots files by the length of their names."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    hosts = pages.select(U.host(F.col("url")).alias("host")).distinct()
    files = hosts.withColumn("http_status", F.when(F.length("host") % 4 == 0, 200).when(F.length("host") % 4 == 1, 404).when(F.length("host") % 4 == 2, 500))
    return url_ops.robots_state(pages, files, pages.withColumn("allowed", F.col("page_id") % 2 == 0)).select("page_id", "robots_state", "allowed")


def host_verdicts(spark, sf_dir):
    """Nations as hosts with suppliers' addresses."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    host = lambda key: F.concat(F.lit("h"), F.col(key).cast("string"))
    kind = F.col("s_nationkey") % 4
    address = F.when(kind == 0, F.concat(F.lit("8.8."), (F.col("s_suppkey") % 250).cast("string"), F.lit(".8"))).when((kind == 1) & (F.col("s_suppkey") % 2 == 0), "10.0.0.1").when(kind == 2, "127.0.0.1").otherwise("8.8.4.4")
    return url_ops.host_verdict(n.select(host("n_nationkey").alias("host")), s.select(host("s_nationkey").alias("host"), address.alias("address")))


def evidence_states(spark, sf_dir):
    """Orders as artifacts, customers as the files that they name."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    path = lambda key: F.concat(F.lit("f/"), F.col(key).cast("string"))
    artifacts = o.select(F.col("o_orderkey").alias("artifact_id"), F.col("o_orderkey").alias("attempt_id"), path("o_custkey").alias("path"), (F.col("o_custkey") * 10).alias("byte_size"), F.col("o_orderstatus").alias("sha256"))
    attempts = o.select(F.col("o_orderkey").alias("attempt_id"), F.col("o_custkey").alias("item_id"))
    files = c.where("c_custkey % 7 <> 0").select(path("c_custkey").alias("path"), (F.col("c_custkey") * 10 + (F.col("c_custkey") % 5 == 0).cast("int")).alias("byte_size"), F.lit("O").alias("sha256"))
    return recon.evidence_states(artifacts, attempts, files)


def resolved_references(spark, sf_dir):
    """Orders that name nations as labels, which name regions as files."""
    o, n, r = (table(spark, sf_dir, t) for t in ("orders", "nation", "region"))
    entries = o.select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderpriority")).otherwise(F.concat(F.lit("@label:"), (F.col("o_custkey") % 30).cast("string"))).alias("text"))
    body = F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit("@file:"), F.col("n_regionkey").cast("string"))).when(F.col("n_nationkey") % 4 == 1, "@label:x").otherwise(F.col("n_name"))
    labels = n.select(F.col("n_nationkey").cast("string").alias("label"), body.alias("body"))
    files = r.where("r_regionkey <> 2").select(F.col("r_regionkey").cast("string").alias("file"), F.col("r_name").alias("content"))
    return recon.resolve_refs(entries, labels, files).select("o_orderkey", "resolved", F.coalesce("problem", F.lit("-")).alias("problem"))


def expanded_groups(spark, sf_dir):
    """Suppliers as groups of two nations, of which some aren't there."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    groups = s.select(F.col("s_suppkey").alias("group"), F.array(F.col("s_nationkey").cast("string"), (F.col("s_suppkey") % 40).cast("string")).alias("members"))
    out = recon.expand_groups(groups, n.select(F.col("n_nationkey").cast("string").alias("label"), F.col("n_name").alias("body")))
    return out.select("group", "place", "member", F.coalesce("body", F.lit("-")).alias("body"), "missing")


def matched_boxes(spark, sf_dir):
    """Events as cards of their user's page, every second one also as a box."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    cards = e.select(F.col("user_id").alias("page"), F.col("event_id").alias("position"), F.col("k").cast("string").alias("href"), F.col("event_type").alias("img"))
    boxes = e.where("event_id % 2 = 0").select(F.col("user_id").alias("page"), F.col("event_id").alias("box"), (F.col("k") + 1).cast("string").alias("href"), F.when(F.col("k") % 2 == 0, F.col("event_type")).alias("img"))
    return recon.match_boxes(cards, boxes).select("page", "position", F.coalesce("box", F.lit(-1)).alias("box"))


def declared_counts(spark, sf_dir):
    """Orders as pages that declare a number of cards, their lines as cards, customers as series."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    pages = o.select(F.col("o_orderkey").alias("page"), F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey")).alias("series"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderkey") % 6).alias("declared"))
    return stats.declared_check(pages, li.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("card")))


def completions(spark, sf_dir):
    """Open work of every customer: open orders of the last year, and partial ones, which aren't known of every third customer."""
    o = table(spark, sf_dir, "orders")
    work = o.groupBy(F.col("o_custkey").cast("string").alias("customer")).agg(F.count_if((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") >= "1998-06-01")).alias("open"), F.max(F.when(F.col("o_custkey") % 3 != 0, (F.col("o_orderstatus") == "P").cast("int"))).alias("partial"))
    return stats.completion(work).select("customer", "complete", F.array_join("reasons", ",").alias("reasons"))


def image_counts(spark, sf_dir):
    """Events as images of their user's page."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "ok").otherwise("known")
    images = e.select(F.col("user_id").alias("page_id"), F.col("k").cast("string").alias("url"), _pick(("img", "srcset", "picture", "meta"), F.col("k")).alias("origin"), status.alias("status"), F.col("k").alias("byte_size"), (F.col("k") % 7 == 0).alias("mime_mismatch"), (F.col("k") % 3 + 1).alias("n_references"))
    return stats.image_counts(images).withColumn("warnings", F.array_join("warnings", ","))


def discovery_counts(spark, sf_dir):
    """Orders as files of a discovery run, pages as what they list, some errors and two limits that were met."""
    o = table(spark, sf_dir, "orders")
    files = o.select(_pick(("urlset", "sitemapindex", "unreadable", "skipped"), F.col("o_orderkey")).alias("kind"), (F.col("o_custkey") % 5).alias("depth"))
    errors = o.where("o_orderkey % 4 = 2 or o_orderstatus = 'P'").select(F.lit("unreadable").alias("code"))
    limits = o.select(_pick(("max_files", "max_urls"), F.col("o_orderkey")).alias("limit_hit"))
    out = stats.sitemap_run_counts(files, table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^([^?#]*)", 1).alias("canonical_url")), errors, limits)
    return out.withColumn("limits_hit", F.array_join("limits_hit", ","))


def applied_reports(spark, sf_dir):
    """A batch of judgments of all orders, half of them leased by its worker."""
    o = table(spark, sf_dir, "orders")
    items = o.select(F.col("o_orderkey").alias("item_id"), F.lit("leased").alias("work_state"), F.concat(F.lit("l"), (F.col("o_orderkey") % 2).cast("string")).alias("lease_id"))
    attempts = o.select(F.col("o_orderkey").alias("item_id"), F.when(F.col("o_orderkey") % 5 == 0, "failed").otherwise("success").alias("result"))
    batch = o.select(F.col("o_orderkey").alias("item_id"), F.col("o_orderpriority").alias("label"), F.when(F.col("o_orderstatus") == "P", "no_label").alias("reason"))
    reports = spark.createDataFrame([], "report_key string")
    after, _, rejected = ledger.apply_reports(items, attempts, reports, batch, "l1")
    return after.join(rejected.select("item_id", "why"), "item_id", "left").select("item_id", "work_state", F.coalesce("lease_id", F.lit("-")).alias("lease_id"), F.coalesce("why", F.lit("-")).alias("why"))


def next_cycle(spark, sf_dir):
    """The cycle after the nations', with the orders' last number as version."""
    state = table(spark, sf_dir, "orders").agg(F.max("o_orderkey").alias("version"), F.count_if(F.col("o_orderstatus") == "O").alias("woken"))
    return recon.cycle_report(state, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cycle"), F.col("n_regionkey").cast("long").alias("version")))


def _sitemaps(spark, sf_dir):
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    name = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    seeds = r.select(name("r", "r_regionkey").alias("url"), F.lit("robots").alias("kind"))
    indexes = r.select(name("r", "r_regionkey").alias("url"), name("r", "r_regionkey").alias("final_url"), F.lit("sitemapindex").alias("kind"))
    lists = n.select(name("n", "n_nationkey").alias("url"), name("n", "n_nationkey").alias("final_url"), F.when(F.col("n_nationkey") % 5 == 4, "unreadable").otherwise("urlset").alias("kind"))
    below = n.select(name("r", "n_regionkey").alias("file"), name("n", "n_nationkey").alias("loc"), F.lit(None).cast("string").alias("lastmod"))
    listed = c.select(name("n", "c_nationkey").alias("file"), name("c", "c_custkey").alias("loc"), F.col("c_mktsegment").alias("lastmod"))
    return graph.sitemap_closure(seeds, indexes.unionByName(lists), below.unionByName(listed), most_urls=1 << 30)


def sitemap_files(spark, sf_dir):
    """Regions as indexes of nations, which list customers: the files that were opened."""
    return _sitemaps(spark, sf_dir)[0].select("url", "depth", "outcome")


def sitemap_urls(spark, sf_dir):
    return _sitemaps(spark, sf_dir)[1].select("url", "source_kind", "depth", "lastmod", "times")


def document_sections(spark, sf_dir):
    """Sections of documents whose third lines are headers of two levels in turn."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    head = F.when(F.col("line") == 0, "# title").when(F.col("line") % 6 == 3, "## h").when(F.col("line") % 6 == 0, "### h").otherwise(F.concat(F.lit("."), "content"))
    return doc_ops.sections(doc_ops.doc_lines(d).withColumn("content", head)).select("path", "address", "level", "start_line", "end_line", "line_count")


QUERIES = {
    "tx10_screen_states": screen_states,
    "wn14_screen_progress": screen_progress,
    "tx11_sniffed_types": sniffed_types,
    "ur08_compiled_globs": compiled_globs,
    "jn04_robots_states": robots_states,
    "jn06_host_verdicts": host_verdicts,
    "jn07_evidence_states": evidence_states,
    "jn14_resolved_references": resolved_references,
    "jn15_expanded_groups": expanded_groups,
    "jn16_matched_boxes": matched_boxes,
    "ag15_declared_counts": declared_counts,
    "ag17_completions": completions,
    "ag19_image_counts": image_counts,
    "ag20_discovery_counts": discovery_counts,
    "lt02_applied_reports": applied_reports,
    "lt09_next_cycle": next_cycle,
    "it01_sitemap_files": sitemap_files,
    "it01_sitemap_urls": sitemap_urls,
    "wn05_document_sections": document_sections,
}

_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
_HOST = "regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), ':[0-9]*$', '')"
_SCREEN = "SELECT user_id AS surface, event_id AS \"at\", (event_id // 150) % 12 AS f FROM events"
_STATES = "CASE f " + " ".join(f"WHEN {i} THEN '{state}'" for i, (_, state) in enumerate(_SHOWN)) + " END"

ORACLE = {
    "tx10_screen_states": f"SELECT {_STATES} AS state, count(*) AS n FROM ({_SCREEN}) GROUP BY 1",
    "wn14_screen_progress": f"SELECT \"at\", surface, CASE WHEN f <= 2 AND lag(f) OVER (PARTITION BY surface ORDER BY \"at\") = f THEN 'stalled' ELSE {_STATES} END AS state FROM ({_SCREEN})",
    "tx11_sniffed_types": """
SELECT p_partkey, coalesce(m, '-') AS mime, coalesce(m <> CASE p_partkey % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' ELSE 'text/plain' END, false) AS mime_mismatch
FROM (SELECT p_partkey, CASE p_partkey % """ + str(len(_BEGINNINGS)) + "".join(f" WHEN {i} THEN '{m}'" for i, (_, m) in enumerate(_BEGINNINGS) if m) + """ END AS m FROM part)""",
    "ur08_compiled_globs": r"""
SELECT page_id, CASE f WHEN 1 THEN 'not_a_path' WHEN 2 THEN 'no_leading_slash' WHEN 3 THEN 'mixed_star' ELSE '-' END AS reject,
  CASE f WHEN 0 THEN '^' || replace(p, '.', '\.') || '/[^/]+/?$' WHEN 4 THEN '^/.+' || replace(p, '.', '\.') || '/?$' ELSE '-' END AS regex
FROM (SELECT page_id, page_id % 5 AS f, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS p FROM pages)""",
    "jn04_robots_states": f"""
SELECT page_id, s AS robots_state, s <> 'read' OR page_id % 2 = 0 AS allowed
FROM (SELECT page_id, CASE length({_HOST}) % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'no_file' ELSE 'unknown' END AS s FROM pages)""",
    "jn06_host_verdicts": """
SELECT 'h' || n_nationkey AS host, CASE WHEN count(s_suppkey) = 0 THEN 'no_public_address' WHEN n_nationkey % 4 = 1 AND bool_or(s_suppkey % 2 = 0) THEN 'ip_private' WHEN n_nationkey % 4 = 2 THEN 'ip_loopback' ELSE 'allowed' END AS verdict, count(s_suppkey) AS addresses
FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_nationkey""",
    "jn07_evidence_states": """
SELECT o_orderkey AS artifact_id, o_custkey AS item_id, CASE WHEN c_custkey IS NULL OR c_custkey % 7 = 0 THEN 'missing' WHEN c_custkey % 5 = 0 THEN 'size_mismatch' WHEN o_orderstatus <> 'O' THEN 'sha_mismatch' ELSE 'ok' END AS state
FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "jn14_resolved_references": """
WITH e AS (SELECT *, o_custkey % 30 AS l FROM orders), j AS (SELECT * FROM e LEFT JOIN nation ON l = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority WHEN n_nationkey IS NULL THEN '[missing_label: ' || l || ']' WHEN l % 4 = 1 THEN '[nested_label: ' || l || ']' WHEN l % 4 <> 0 THEN n_name WHEN n_regionkey = 2 OR r_regionkey IS NULL THEN '[missing_file: ' || n_regionkey || ']' ELSE r_name END AS resolved,
  CASE WHEN o_orderkey % 5 = 0 THEN '-' WHEN n_nationkey IS NULL THEN 'missing_label' WHEN l % 4 = 1 THEN 'nested_label' WHEN l % 4 = 0 AND (n_regionkey = 2 OR r_regionkey IS NULL) THEN 'missing_file' ELSE '-' END AS problem FROM j""",
    "jn15_expanded_groups": """
SELECT s_suppkey AS "group", place, CAST(m AS VARCHAR) AS member, coalesce(n_name, '-') AS body, n_name IS NULL AS missing
FROM (SELECT s_suppkey, 0 AS place, s_nationkey AS m FROM supplier UNION ALL SELECT s_suppkey, 1, s_suppkey % 40 FROM supplier) LEFT JOIN nation ON m = n_nationkey""",
    "jn16_matched_boxes": f"""
WITH e AS (SELECT user_id AS page, event_id, {_K} AS k, event_type AS t FROM events),
h AS (SELECT page, k + 1 AS href, min(event_id) AS box FROM e WHERE event_id % 2 = 0 GROUP BY 1, 2), i AS (SELECT page, t, min(event_id) AS box FROM e WHERE event_id % 2 = 0 AND k % 2 = 0 GROUP BY 1, 2),
c AS (SELECT e.page, event_id AS position, coalesce(h.box, i.box) AS box FROM e LEFT JOIN h ON e.page = h.page AND e.k = h.href LEFT JOIN i ON e.page = i.page AND e.t = i.t)
SELECT page, position, CASE WHEN position = min(position) OVER (PARTITION BY page, box) AND box IS NOT NULL THEN box ELSE -1 END AS box FROM c""",
    "ag15_declared_counts": """
WITH p AS (SELECT o_orderkey AS page, CASE WHEN o_custkey % 3 = 0 THEN o_custkey END AS series, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 6 END AS declared FROM orders),
b AS (SELECT l_orderkey AS page, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1), s AS (SELECT series, count(DISTINCT l_linenumber) AS n FROM p JOIN lineitem ON page = l_orderkey WHERE series IS NOT NULL GROUP BY 1),
f AS (SELECT p.*, CASE WHEN declared = coalesce(b.n, 0) THEN declared ELSE coalesce(s.n, b.n, 0) END AS found FROM p LEFT JOIN b USING (page) LEFT JOIN s USING (series) WHERE declared IS NOT NULL)
SELECT page, declared, found, CASE WHEN declared = found THEN 'match' WHEN series IS NULL THEN 'mismatch' ELSE 'scope_unknown' END AS verdict FROM f""",
    "ag17_completions": """
SELECT customer, o = 0 AND coalesce(p, 1) = 0 AS complete, concat_ws(',', CASE WHEN o > 0 THEN 'open:' || o END, CASE WHEN p > 0 THEN 'partial:1' WHEN p IS NULL THEN 'partial:unknown' END) AS reasons
FROM (SELECT CAST(o_custkey AS VARCHAR) AS customer, count(*) FILTER (o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1998-06-01') AS o, CASE WHEN any_value(o_custkey) % 3 <> 0 THEN count(*) FILTER (o_orderstatus = 'P') END AS p FROM orders GROUP BY 1)""",
    "ag19_image_counts": f"""
WITH e AS (SELECT user_id AS page_id, {_K} AS k, event_type AS t FROM events),
c AS (SELECT page_id, count(DISTINCT k) AS "unique", {", ".join(f"CAST(coalesce(sum(k % 3 + 1) FILTER (k % 4 = {n}), 0) AS BIGINT) AS from_{o}" for n, o in enumerate(("img", "srcset", "picture", "meta")))},
  count(*) FILTER (t = 'view') AS downloaded, count(*) FILTER (t = 'error') AS failed, CAST(coalesce(sum(k) FILTER (t = 'view'), 0) AS BIGINT) AS bytes, count(*) FILTER (k % 7 = 0) AS mismatches FROM e GROUP BY page_id)
SELECT *, concat_ws(',', CASE WHEN failed > 0 AND downloaded > 0 THEN 'image_fetch_partial' END, CASE WHEN failed > 0 AND downloaded = 0 THEN 'image_fetch_none' END, CASE WHEN mismatches > 0 THEN 'image_mime_mismatch' END) AS warnings FROM c""",
    "ag20_discovery_counts": """
SELECT f.*, u.*, (SELECT count(*) FROM orders WHERE o_orderkey % 4 = 2 OR o_orderstatus = 'P') AS errors, (SELECT array_to_string(list_sort(list_distinct(list(CASE WHEN o_orderkey % 2 = 0 THEN 'max_files' ELSE 'max_urls' END))), ',') FROM orders) AS limits_hit, unreadable > 0 OR skipped > 0 AS partial
FROM (SELECT count(*) FILTER (k <> 3) AS opened, count(*) FILTER (k = 3) AS skipped, count(*) FILTER (k = 1) AS indexes, count(*) FILTER (k = 0) AS urlsets, count(*) FILTER (k = 2) AS unreadable, max(d) AS max_depth FROM (SELECT o_orderkey % 4 AS k, o_custkey % 5 AS d FROM orders)) f,
  (SELECT count(DISTINCT c) AS urls, count(*) - count(DISTINCT c) AS duplicates FROM (SELECT regexp_extract(url, '^([^?#]*)', 1) AS c FROM pages)) u""",
    "lt02_applied_reports": """
SELECT item_id, CASE WHEN why = '-' THEN 'done' ELSE 'leased' END AS work_state, CASE WHEN why = '-' THEN '-' ELSE 'l' || item_id % 2 END AS lease_id, why
FROM (SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 2 = 0 THEN 'not_in_this_lease' WHEN o_orderkey % 5 = 0 THEN 'not_collected' WHEN o_orderstatus = 'P' THEN 'no_label' ELSE '-' END AS why FROM orders)""",
    "lt09_next_cycle": "SELECT CAST(c.m + 1 AS INTEGER) AS cycle, version, woken FROM (SELECT max(o_orderkey) AS version, count(*) FILTER (o_orderstatus = 'O') AS woken FROM orders), (SELECT max(n_nationkey) AS m, max_by(n_regionkey, n_nationkey) AS v FROM nation) c WHERE version IS DISTINCT FROM v",
    "it01_sitemap_files": "SELECT 'r' || r_regionkey AS url, CAST(0 AS INTEGER) AS depth, 'opened' AS outcome FROM region UNION ALL SELECT 'n' || n_nationkey, 1, CASE WHEN n_nationkey % 5 = 4 THEN 'unreadable' ELSE 'opened' END FROM nation",
    "it01_sitemap_urls": "SELECT 'c' || c_custkey AS url, 'robots' AS source_kind, CAST(1 AS INTEGER) AS depth, max(c_mktsegment) AS lastmod, count(*) AS times FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 5 <> 4 GROUP BY c_custkey",
    "wn05_document_sections": r"""
WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS path, len(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS n FROM documents), h AS (SELECT path, n, unnest(range(3, n, 3)) AS line FROM l)
SELECT path, CASE WHEN line % 6 = 3 THEN CAST((line + 3) // 6 AS VARCHAR) ELSE (line // 6) || '-1' END AS address, CAST(CASE WHEN line % 6 = 3 THEN 2 ELSE 3 END AS INTEGER) AS level, CAST(line + 1 AS INTEGER) AS start_line,
  CAST(least(n, line + CASE WHEN line % 6 = 3 THEN 6 ELSE 3 END) AS INTEGER) AS end_line, CAST(least(n, line + CASE WHEN line % 6 = 3 THEN 6 ELSE 3 END) - line AS INTEGER) AS line_count FROM h""",
}
