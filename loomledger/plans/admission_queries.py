"""Queries of admission under several caps, of re-admission and of woken details, with their SQL: a walk along each domain's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomledger.operators import graph, ledger
from loomledger.operators import urls as url_ops
from loomledger.plans.url_queries import _FACETS, _KEYS, _SHAPE, _WORD, _canonical, _host
from loomledger.sources.tables import URL_RECORDS_SQL, table, url_records

_POLICY = {"domain_url_cap": 12, "path_shape_cap": 8, "query_combo_cap": 3, "faceted_cap": 4, "external_hop_max": 2, "deny_domains": ["cheap-pills.example.com"]}
_WIDER = _POLICY | {"domain_url_cap": 30, "path_shape_cap": 12, "query_combo_cap": 5}


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = url_ops.path_shapes(url_ops.canonicalize(url_records(spark, sf_dir)), "canonical_url")
    excluded = F.when(F.col("canonical_url").contains("/es/"), "excluded_path_pattern").alias("excluded")
    return records.select("line", "canonical_url", "domain", "shape", "combo", "facet", (F.col("line") % 4).cast("int").alias("hops"), excluded)


def multi_cap_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every address in order of its line, under caps that interact."""
    return ledger.admit(_records(spark, sf_dir), _POLICY).select("line", "domain", "why")


def readmitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What wider caps let in of the addresses that were parked, and what stays parked in each domain."""
    judged = ledger.admit(_records(spark, sf_dir), _POLICY)
    accepted = judged.where("why is null").select("domain", "shape", "combo", "facet")
    admitted, remaining = ledger.readmit(judged.where("why is not null").drop("why"), accepted, _WIDER)
    came = admitted.groupBy("domain").agg(F.count(F.lit(1)).alias("admitted"))
    return came.join(remaining, "domain", "full_outer").select("domain", F.coalesce("admitted", F.lit(0)).alias("admitted"), F.coalesce("remaining", F.lit(0)).alias("remaining"), "why")


def woken_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card for every address; the ledger has those of two pages in five, one of them asleep."""
    records = _records(spark, sf_dir).withColumn("page_id", F.expr("line div 3"))
    cards = records.select(F.col("line").alias("card_id"), F.when(F.col("line") % 11 != 0, F.col("canonical_url")).alias("detail_url"), "domain", "shape", "combo", "facet", "hops")
    kept = records.where("page_id % 5 < 2")
    urls = kept.groupBy("canonical_url").agg(F.min(F.when(F.col("page_id") % 5 == 0, "known_deferred").when(F.col("page_id") % 2 == 0, "queued").otherwise("fetched")).alias("state"))
    accepted = kept.groupBy("canonical_url").agg(F.min(F.struct("line", "domain", "shape", "combo", "facet")).alias("r")).select("r.domain", "r.shape", "r.combo", "r.facet")
    chosen = records.select(F.col("line").alias("card_id"), F.col("line").alias("ord")).unionByName(table(spark, sf_dir, "pages").select((-F.col("page_id") - 1).alias("card_id"), F.col("page_id").alias("ord")))
    return graph.wake_details(cards, urls, chosen, _POLICY, accepted).select("card_id", "outcome")


QUERIES = {"wn09_multi_cap_admission": multi_cap_admission, "wn10_readmitted": readmitted, "it03_woken_details": woken_details}

_RECORDS_SQL = f"""SELECT line, url AS canonical_url, domain, {_SHAPE} AS shape, array_to_string(list_sort({_KEYS}), '&') AS combo,
    CASE WHEN {_WORD} <> '' THEN 'path' WHEN len({_FACETS}) > 0 THEN 'query' END AS facet, line % 4 AS hops, CASE WHEN contains(url, '/es/') THEN 'excluded_path_pattern' END AS excluded
  FROM (SELECT line, {_canonical('url')} AS url, {_host('url')} AS domain FROM ({URL_RECORDS_SQL}))"""


def _walk(name: str, rows: str, policy: dict, seeds: str | None = None) -> str:
    """A recursive table: rows (domain, line, shape, combo, facet, hops, excluded) in order, each domain from the rows that were accepted before."""
    start = f"(SELECT domain, count(*) AS total, list(shape) AS shapes, list(combo) FILTER (combo <> '') AS combos, count(facet) AS faceted FROM {seeds} GROUP BY domain)" if seeds else "(SELECT NULL::VARCHAR AS domain, 0 AS total, []::VARCHAR[] AS shapes, []::VARCHAR[] AS combos, 0 AS faceted)"
    denied = " OR ".join(f"domain = '{d}' OR ends_with(domain, '.{d}')" for d in policy["deny_domains"])
    return f"""
{name}_rows AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY line) AS n FROM {rows}),
{name} AS (
  SELECT r.domain, 0::BIGINT AS n, NULL::BIGINT AS line, NULL::VARCHAR AS why, coalesce(s.total, 0)::BIGINT AS total, coalesce(s.shapes, []::VARCHAR[]) AS shapes, coalesce(s.combos, []::VARCHAR[]) AS combos, coalesce(s.faceted, 0)::BIGINT AS faceted
  FROM (SELECT DISTINCT domain FROM {rows}) r LEFT JOIN {start} s ON s.domain = r.domain
  UNION ALL
  SELECT domain, n, line, why, total + (why IS NULL)::BIGINT, CASE WHEN why IS NULL THEN list_append(shapes, shape) ELSE shapes END,
         CASE WHEN why IS NULL AND combo <> '' THEN list_append(combos, combo) ELSE combos END, faceted + (why IS NULL AND facet IS NOT NULL)::BIGINT
  FROM (
    SELECT r.domain, r.n, r.line, r.shape, r.combo, r.facet, w.total, w.shapes, w.combos, w.faceted,
           CASE WHEN {denied.replace('domain', 'r.domain')} THEN 'denied_domain' WHEN r.excluded IS NOT NULL THEN r.excluded WHEN r.hops > {policy['external_hop_max']} THEN 'external_hop_exceeded'
                WHEN w.total >= {policy['domain_url_cap']} THEN 'domain_url_cap' WHEN len(list_filter(w.shapes, lambda x: x = r.shape)) >= {policy['path_shape_cap']} THEN 'path_shape_cap'
                WHEN r.combo <> '' AND len(list_filter(w.combos, lambda x: x = r.combo)) >= {policy['query_combo_cap']} THEN 'query_combo_cap'
                WHEN r.facet IS NOT NULL AND w.faceted >= {policy['faceted_cap']} THEN 'faceted_cap' END AS why
    FROM {name} w JOIN {name}_rows r ON r.domain = w.domain AND r.n = w.n + 1)
)"""


ORACLE = {
    "wn09_multi_cap_admission": f"WITH RECURSIVE records AS ({_RECORDS_SQL}), {_walk('walk', 'records', _POLICY)} SELECT line, domain, why FROM walk WHERE n > 0",
    "wn10_readmitted": f"""WITH RECURSIVE records AS ({_RECORDS_SQL}), {_walk('walk', 'records', _POLICY)},
        parked AS (SELECT r.* FROM records r JOIN walk w USING (line) WHERE w.why IS NOT NULL), accepted AS (SELECT r.* FROM records r JOIN walk w USING (line) WHERE w.why IS NULL), {_walk('again', 'parked', _WIDER, 'accepted')},
        counted AS (SELECT domain, why, count(*) AS n FROM again WHERE again.n > 0 GROUP BY ALL)
        SELECT domain, coalesce(sum(n) FILTER (why IS NULL), 0)::BIGINT AS admitted, coalesce(sum(n) FILTER (why IS NOT NULL), 0)::BIGINT AS remaining,
               (list(why ORDER BY n DESC, why) FILTER (why IS NOT NULL))[1] AS why FROM counted GROUP BY domain""",
    "it03_woken_details": f"""WITH RECURSIVE records AS (SELECT *, line // 3 AS page_id FROM ({_RECORDS_SQL})), kept AS (SELECT * FROM records WHERE page_id % 5 < 2),
        urls AS (SELECT canonical_url, min(CASE WHEN page_id % 5 = 0 THEN 'known_deferred' WHEN page_id % 2 = 0 THEN 'queued' ELSE 'fetched' END) AS state FROM kept GROUP BY ALL),
        accepted AS (SELECT domain, shape, combo, facet FROM kept QUALIFY row_number() OVER (PARTITION BY canonical_url ORDER BY line) = 1),
        cards AS (SELECT *, CASE WHEN line % 11 <> 0 THEN canonical_url END AS detail_url FROM records),
        new AS (SELECT c.* REPLACE (NULL::VARCHAR AS excluded) FROM cards c LEFT JOIN urls u ON c.detail_url = u.canonical_url WHERE detail_url IS NOT NULL AND u.state IS NULL QUALIFY row_number() OVER (PARTITION BY detail_url ORDER BY line) = 1),
        {_walk('walk', 'new', _POLICY, 'accepted')}, judged AS (SELECT new.detail_url, coalesce(why, 'queued') AS verdict FROM walk JOIN new USING (line))
        SELECT line AS card_id, CASE WHEN c.detail_url IS NULL THEN 'no_detail_url' WHEN state = 'queued' THEN 'already_queued' WHEN state = 'known_deferred' THEN 'queued' WHEN state IS NOT NULL THEN 'already_fetched' ELSE verdict END AS outcome
        FROM cards c LEFT JOIN urls u ON c.detail_url = u.canonical_url LEFT JOIN judged j ON j.detail_url = c.detail_url
        UNION ALL SELECT -page_id - 1, 'unknown_card' FROM pages""",
}
