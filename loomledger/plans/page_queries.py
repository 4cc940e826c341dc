"""Queries of the page and document operators over pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomledger.operators import docs as doc_ops
from loomledger.operators import html as ops
from loomledger.operators import reviews
from loomledger.sources.tables import PAGE_LINKS_SQL, table

_QUERIES = [("thanedble", False), ("src3", False), ("en", True), ("queen", True)]


def _parsed(spark, sf_dir):
    return ops.parse_pages(table(spark, sf_dir, "pages"))


def link_totals(spark, sf_dir):
    return ops.link_counts(ops.extract_links(_parsed(spark, sf_dir))).select("page_id", "total", "internal", "external", "fragment_only")


def searched(spark, sf_dir):
    """Documents found by four queries, strongest first."""
    d = table(spark, sf_dir, "documents")
    docs = d.select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"), F.concat_ws("/", "source", "lang").alias("folder"), F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("file_name"), F.regexp_extract("text", r"^([^\n]*)", 1).alias("title"), "text", F.col("n_chars").alias("modified"))
    queries = spark.createDataFrame(_QUERIES, "query string, alias boolean")
    return doc_ops.search_docs(docs, queries, limit=100).select("path", "strength", "alias", F.array_join("matched", ",").alias("matched"))


def section_hits(spark, sf_dir):
    """Lines of documents as sections of themselves: which hold a query, and whether in the first line."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    lines = doc_ops.doc_lines(d)
    found = lines.where("line % 3 = 0").select("path", F.concat(F.lit("s"), F.col("line").cast("string")).alias("address"), F.col("content").alias("title"), (F.col("line") + 1).alias("start_line"))
    return doc_ops.section_matches(lines, found, "licensed").select("path", "address", "strength", F.size("snippets").alias("snippets"))


def assembled_sections(spark, sf_dir):
    """Text of every section of every document, each third line being a section's head."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    lines = doc_ops.doc_lines(d)
    found = lines.where("line % 3 = 0").select("path", F.concat(F.lit("s"), F.col("line").cast("string")).alias("address"), (F.col("line") + 1).alias("start_line"), (F.col("line") + 3).alias("end_line"))
    ids = found.select(F.lit(1).alias("ord"), "path", "address")
    return doc_ops.section_text(lines, found, ids).select("path", "address", F.sha2("text", 256).alias("text_hash"))


def capped_page(spark, sf_dir):
    """The second page of fifty documents by source and id, after the cursor of the first."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    first, cursor_of = doc_ops.page(d, ["source", "doc_id"], 50, {"q": "all"})
    rows = first.collect()  # a page
    return doc_ops.page(d, ["source", "doc_id"], 50, {"q": "all"}, cursor_of(rows[-1]))[0] if rows else first


def folder_order(spark, sf_dir):
    """Sources as folders, by their measures."""
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"))
    return reviews.sort_map(counts, "documents", "source")


QUERIES = {
    "ht03_link_totals": link_totals,
    "tk01_searched": searched,
    "tk02_capped_page": capped_page,
    "tk05_folder_order": folder_order,
    "wn06_section_hits": section_hits,
    "jn21_assembled_sections": assembled_sections,
}


def _search_sql() -> str:
    values = ", ".join(f"('{q}', {str(a).lower()})" for q, a in _QUERIES)
    return f"""
WITH q(query, alias) AS (VALUES {values}), d AS (SELECT source || '/' || lang || '/' || doc_id || '.md' AS path, source || '/' || lang AS folder, CAST(doc_id AS VARCHAR) AS stem, lower(regexp_extract(text, '^([^\\n]*)', 1)) AS title, lower(text) AS t, n_chars, source, lang FROM documents),
h AS (SELECT path, n_chars, query, alias, CASE WHEN stem = query OR source = query OR lang = query THEN 0 WHEN contains(folder, query) THEN 1 WHEN contains(stem || '.md', query) THEN 2 WHEN contains(title, query) THEN 3 WHEN contains(t, query) THEN 4 END AS s FROM d, q),
b AS (SELECT path, n_chars, bool_and(alias) AS alias, array_to_string(list_sort(list_distinct(list(query))), ',') AS matched, min(s) FILTER (NOT alias) AS direct, min(s) AS any_ FROM h WHERE s IS NOT NULL GROUP BY path, n_chars)
SELECT path, CAST(coalesce(direct, any_) AS INTEGER) AS strength, alias, matched FROM b ORDER BY alias, coalesce(direct, any_), n_chars DESC, path LIMIT 100"""


ORACLE = {
    "ht03_link_totals": f"""SELECT page_id, count(*) AS total, count(*) FILTER (starts_with(href, '/') OR starts_with(href, '#')) AS internal, CAST(0 AS BIGINT) AS external, count(*) FILTER (starts_with(href, '#')) AS fragment_only FROM ({PAGE_LINKS_SQL}) GROUP BY page_id""",
    "tk01_searched": _search_sql(),
    "tk02_capped_page": "SELECT source, doc_id, n_chars FROM documents ORDER BY source, doc_id LIMIT 50 OFFSET 50",
    "tk05_folder_order": "SELECT source, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source ORDER BY documents DESC, source",
    "wn06_section_hits": r"""
WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS path, unnest(range(len(a))) AS line, unnest(a) AS content FROM (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS a FROM documents)),
o AS (SELECT path, 's' || (line - line % 3) AS address, line % 3 = 0 AS head FROM l WHERE contains(lower(content), 'licensed'))
SELECT path, address, CAST(min(CASE WHEN head THEN 3 ELSE 4 END) AS INTEGER) AS strength, CAST(least(2, count(*) FILTER (NOT head)) AS INTEGER) AS snippets FROM o GROUP BY path, address""",
    "jn21_assembled_sections": r"""
WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS path, unnest(range(len(a))) AS line, unnest(a) AS content FROM (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS a FROM documents)),
i AS (SELECT *, line - line % 3 AS head, max(CASE WHEN NOT regexp_matches(content, '^\s*(<a [^>]*></a>)?\s*$') THEN line END) OVER (PARTITION BY path, line - line % 3) AS last FROM l)
SELECT path, 's' || head AS address, sha256(string_agg(content, chr(10) ORDER BY line)) AS text_hash FROM i WHERE line <= last GROUP BY path, head""",
}
