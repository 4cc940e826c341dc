"""Queries of addresses as numbers, of sitemaps as bytes, of export lines and of content digests, over data derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomledger.functions import urls as U
from loomledger.sources import onefile, scans
from loomledger.sources.digests import table_digest
from loomledger.sources.tables import table

#: Numbers that spread an order's key over all addresses.
_SPREAD, _OTHER = 2654435761, 40503


def ip_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as an address: IPv4, IPv6 in full and in short, IPv4 inside IPv6 in both spellings, and some that are none."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.pmod(F.col("o_orderkey") * _SPREAD, F.lit(1 << 32)).alias("n"), (F.col("o_orderkey") % 10).alias("form"), F.pmod(F.col("o_custkey") * _OTHER, F.lit(1 << 16)).alias("g"))
    byte = lambda shift: (F.shiftright("n", shift).bitwiseAND(F.lit(255))).cast("string")
    four = F.concat_ws(".", *(byte(s) for s in (24, 16, 8, 0)))
    hex_ = lambda c: F.lower(F.hex(c))
    high, low = hex_(F.shiftright("n", 16)), hex_(F.col("n").bitwiseAND(F.lit(65535)))
    address = (
        F.when(F.col("form") < 4, four)
        .when(F.col("form") == 4, F.concat(F.lit("::ffff:"), four))
        .when(F.col("form") == 5, F.concat(F.lit("0:0:0:0:0:FFFF:"), high, F.lit(":"), low))
        .when(F.col("form") == 6, F.concat(F.lit("["), hex_(F.col("g")), F.lit("::"), low, F.lit("]")))
        .when(F.col("form") == 7, F.concat(hex_(F.col("g")), F.lit(":db8:0:0:0:0:"), high, F.lit(":"), low))
        .when(F.col("form") == 8, F.concat(hex_(F.shiftright("g", 12) + 0xFE80), F.lit("::"), low, F.lit("%eth0")))
        .otherwise(F.concat(four, F.lit(".1")))
    )
    return o.select("o_orderkey", F.coalesce(U.ip_class(address), F.lit("-")).alias("class"))


def sitemap_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sitemap for every host of the pages, with comments, entities and dates, cut into entries by the stream reader."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", "^https?://[^/?#]+([^?#]*)", 1).alias("path"))
    date = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<lastmod>2024-01-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"), F.lit("</lastmod>"))).otherwise("")
    entry = F.concat(F.lit("<url><loc>"), "path", F.lit("?a=1&amp;p="), F.col("page_id").cast("string"), F.lit("</loc>"), date, F.lit("</url><!-- <url><loc>no</loc></url> -->"))
    bodies = p.groupBy("host").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", entry.alias("e")))), lambda x: x["e"]), "\n").alias("all"))
    bodies = bodies.select(F.concat(F.lit("https://"), "host", F.lit("/sitemap.xml")).alias("url"), F.concat(F.lit("<urlset>"), "all", F.lit("</urlset>")).cast("binary").alias("body"))
    _, entries = scans.read_sitemaps(bodies, "body", "url")
    return entries.select("file", F.col("at").alias("place"), "raw", F.coalesce("lastmod", F.lit("-")).alias("lastmod"), "unresolvable")


def sitemap_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared sitemaps of the hosts with a page whose number ends in 0, conventional places for all others."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"))
    hosts = p.select("host").distinct().withColumn("root", F.concat(F.lit("https://"), "host", F.lit("/")))
    declared = p.where("page_id % 10 = 0").select("host", F.concat(F.lit("/maps/"), (F.col("page_id") % 20).cast("string"), F.lit(".xml")).alias("sitemap"))
    return scans.sitemap_seeds(declared, hosts)


def export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as CSV lines: cells with commas, quotes and line ends are quoted, arrays are JSON."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lang"), F.array("lang", "source").alias("tags"))
    _, line = onefile.csv_lines(d)
    return d.select("doc_id", F.sha2(line, 256).alias("line_hash"), F.length(line).alias("chars"))


def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root of the hash tree over lineitem's keys and flags."""
    rows, digest = table_digest(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"))
    return spark.createDataFrame([(rows, digest)], "rows long, digest string")


QUERIES = {"ur13_ip_classes": ip_classes, "sc07_sitemap_entries": sitemap_entries, "so04_sitemap_seeds": sitemap_seeds, "sk01_export_lines": export_lines, "sk03_content_digest": content_digest}


def _four_sql(n: str) -> str:
    """The class of an IPv4 number: the first range that has it."""
    def number(first: str) -> int:
        a, b, c, d = map(int, first.split("."))
        return ((a * 256 + b) * 256 + c) * 256 + d

    return "CASE " + " ".join(f"WHEN {n} // {1 << 32 - bits} = {number(first) >> 32 - bits} THEN '{name}'" for name, first, bits in U.IPV4_CLASSES) + " ELSE 'public' END"


_CELL = "CASE WHEN regexp_matches({c}, '[\",\\r\\n]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END"

ORACLE = {
    # The first 16 bits decide what isn't an IPv4 address in disguise; 64:ff9b and ::/96 need an exact second group, which these forms give.
    "ur13_ip_classes": f"""WITH o AS (SELECT o_orderkey, (o_orderkey * {_SPREAD}) % 4294967296 AS n, o_orderkey % 10 AS form, (o_custkey * {_OTHER}) % 65536 AS g FROM orders),
        s AS (SELECT *, CASE WHEN form = 8 THEN 65152 + g // 4096 ELSE g END AS first, form = 7 AS db8 FROM o)
        SELECT o_orderkey, CASE WHEN form < 6 THEN {_four_sql('n')} WHEN form = 9 THEN '-'
          WHEN first = 0 AND NOT db8 THEN CASE WHEN n % 65536 = 0 THEN 'unspecified' WHEN n % 65536 = 1 THEN 'loopback' ELSE {_four_sql('(n % 65536)')} END
          WHEN first // 512 = 126 THEN 'private' WHEN first // 64 = 1018 THEN 'link_local' WHEN first // 256 = 255 THEN 'multicast' WHEN first = 8193 AND db8 THEN 'documentation' ELSE 'public' END AS class FROM s""",
    "sc07_sitemap_entries": r"""SELECT 'https://' || host || '/sitemap.xml' AS file, (row_number() OVER (PARTITION BY host ORDER BY page_id) - 1)::INTEGER AS place, path || '?a=1&p=' || page_id AS raw,
        CASE WHEN page_id % 3 = 0 THEN '2024-01-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') ELSE '-' END AS lastmod, false AS unresolvable
        FROM (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages)""",
    "so04_sitemap_seeds": r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages), d AS (SELECT DISTINCT host, 'https://' || host || '/maps/' || page_id % 20 || '.xml' AS url FROM p WHERE page_id % 10 = 0)
        SELECT host, url, 'declared' AS origin FROM d UNION ALL SELECT host, 'https://' || host || unnest(['/sitemap.xml', '/sitemap_index.xml']), 'guess' FROM (SELECT DISTINCT host FROM p) WHERE host NOT IN (SELECT host FROM d)""",
    "sk01_export_lines": f"""SELECT doc_id, sha256(line) AS line_hash, length(line)::INTEGER AS chars FROM (SELECT doc_id, doc_id || ',' || {_CELL.format(c="coalesce(text, '')")} || ',' || CASE WHEN doc_id % 3 <> 0 THEN lang ELSE '' END || ',"[""' || lang || '"",""' || source || '""]"' AS line FROM documents)""",
    "sk03_content_digest": """WITH r AS (SELECT sha256('{"l_linenumber":' || l_linenumber || ',"l_orderkey":' || l_orderkey || ',"l_partkey":' || l_partkey || ',"l_returnflag":"' || l_returnflag || '","l_suppkey":' || l_suppkey || '}') AS h FROM lineitem),
        n AS (SELECT count(*) AS rows, CASE WHEN count(*) > 65536 THEN 2 ELSE 0 END AS digits FROM r), e AS (SELECT h, count(*) AS k FROM r GROUP BY h),
        l AS (SELECT h[1:digits] AS prefix, sha256(array_to_string(list_sort(list(h || ':' || k)), ',')) AS digest FROM e, n GROUP BY ALL),
        t AS (SELECT CASE WHEN max(digits) = 0 THEN max(digest) ELSE sha256(array_to_string(list_sort(list(prefix || ':' || digest)), ',')) END AS root FROM l, n)
        SELECT rows, sha256(rows || ':l_linenumber,l_orderkey,l_partkey,l_returnflag,l_suppkey:' || root) AS digest FROM n, t""",
}
