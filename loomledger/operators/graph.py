"""Iterative operators: the closure of sitemaps, and waking deferred detail pages. Every level ends in a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomledger.operators.ledger import admit
from loomledger.sources.tables import checkpointed


def sitemap_closure(seeds: DataFrame, files: DataFrame, entries: DataFrame, depth: int = 4, most_files: int = 50, most_urls: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """(opened, urls): the sitemap files reached from seeds, with depth and outcome, and the addresses they list.

    seeds: url, kind (robots, sitemap); files: url, final_url, kind (urlset, sitemapindex, unknown, unreadable), and limit_hit where known (max_bytes: a file that
    was read in part); entries: file, loc, lastmod. An index leads on to its children, up to a depth; a file met by its requested or its final
    address isn't opened again; the limits on files, addresses and sizes are features of the run, and what
    they cut is told: files beyond the limit, by depth and address, have the outcome skipped and lead nowhere, an index at the
    last depth has max_depth, a file over the size limit too_large."""
    frontier = seeds.select("url", F.col("kind").alias("origin"), F.lit(0).alias("depth")).groupBy("url").agg(F.min("origin").alias("origin"), F.min("depth").alias("depth"))
    opened, left = None, most_files
    for level in range(depth + 1):
        hit = F.col("limit_hit") if "limit_hit" in files.columns else F.lit(None).cast("string")
        known = files.select(F.col("url").alias("_url"), F.col("final_url"), F.col("kind").alias("file_kind"), hit.alias("limit_hit"))
        now = frontier.join(known, F.col("url") == F.col("_url"), "left").drop("_url")
        now = now.withColumn("final_url", F.coalesce("final_url", "url")).withColumn("file_kind", F.coalesce("file_kind", F.lit("unreadable")))
        first = Window.partitionBy("final_url").orderBy("url")
        now = now.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
        if opened is not None:
            seen = opened.select(F.explode(F.array("url", "final_url")).alias("_seen")).distinct()
            now = now.join(seen, F.col("url") == F.col("_seen"), "left_anti").join(seen, F.col("final_url") == F.col("_seen"), "left_anti")
        now = checkpointed(now)
        if now.isEmpty():
            break
        within = now.select("url").distinct().orderBy("url").limit(left).withColumn("_in", F.lit(True))
        now = checkpointed(now.join(within, "url", "left").withColumn("_in", F.coalesce("_in", F.lit(False))))
        left = max(0, left - now.where("_in").count())
        opened = now if opened is None else checkpointed(opened.unionByName(now))
        if level == depth:
            break
        children = now.where("_in and file_kind = 'sitemapindex'").join(entries.select("file", "loc"), F.col("final_url") == F.col("file"))
        frontier = children.where("loc is not null").groupBy(F.col("loc").alias("url")).agg(F.min("origin").alias("origin"), (F.min("depth") + 1).alias("depth"))
    if opened is None:
        opened = frontier.select("url", "origin", "depth", F.col("url").alias("final_url"), F.lit("unreadable").alias("file_kind"), F.lit(None).cast("string").alias("limit_hit"), F.lit(False).alias("_in")).limit(0)
    deep = (F.col("file_kind") == "sitemapindex") & (F.col("depth") >= depth)
    outcome = F.when(~F.col("_in"), "skipped").when(F.col("file_kind").isin("unreadable", "unknown"), "unreadable").when(F.col("limit_hit").isNotNull(), "too_large").when(deep, "max_depth").otherwise("opened")
    opened = opened.withColumn("outcome", outcome).drop("_in")
    lists = opened.where("outcome in ('opened', 'too_large') and file_kind = 'urlset'").select("final_url", "origin", "depth")
    urls = entries.join(lists, F.col("file") == F.col("final_url")).where("loc is not null").groupBy(F.col("loc").alias("url")).agg(F.min("origin").alias("source_kind"), F.min("depth").alias("depth"), F.max("lastmod").alias("lastmod"), F.count(F.lit(1)).alias("times"))
    return opened, urls.orderBy("depth", "url").limit(most_urls)


def discovery_errors(opened: DataFrame, entries: DataFrame) -> DataFrame:
    """url, depth and code of everything that a sitemap run couldn't use: files by their outcome (unreadable, too_large, max_depth), and an entry without a usable
    address (bad_loc) of a file that was opened."""
    files = opened.where("outcome in ('unreadable', 'too_large', 'max_depth')").select("url", "depth", F.col("outcome").alias("code"))
    read = opened.where("outcome in ('opened', 'too_large')").select("url", "final_url", "depth")
    bad = entries.where("loc is null").select("file").join(read, F.col("file") == F.col("final_url")).select("url", "depth", F.lit("bad_loc").alias("code"))
    return files.unionByName(bad)


def limits_hit(opened: DataFrame, urls: DataFrame, most_urls: int = 50_000) -> DataFrame:
    """The limits that a sitemap run has met, each once: max_files, max_bytes, max_depth, max_urls."""
    of = F.create_map(*(F.lit(x) for pair in (("skipped", "max_files"), ("too_large", "max_bytes"), ("max_depth", "max_depth")) for x in pair))
    files = opened.select(F.try_element_at(of, F.col("outcome")).alias("limit_hit")).where("limit_hit is not null").distinct()
    full = urls.limit(most_urls).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= most_urls).select(F.lit("max_urls").alias("limit_hit"))
    return files.unionByName(full)


def wake_details(cards: DataFrame, urls: DataFrame, chosen: DataFrame, policy: dict, accepted: DataFrame | None = None) -> DataFrame:
    """card_id, detail_url and outcome of chosen cards: queued, or why not.

    cards: card_id, detail_url, domain, shape, combo, facet, and hops where known; urls: canonical_url, state; chosen: card_id, and ord, the order in which
    they were asked for (else by card_id). A detail that is deferred in the ledger was admitted before and only wakes; one that the
    ledger doesn't have passes admission under caps that the accepted rows fill (accepted: domain, shape, combo, facet). Cards with one
    detail address share its answer."""
    ask = chosen.groupBy("card_id").agg(F.min("ord" if "ord" in chosen.columns else "card_id").alias("_ord"))
    asked = ask.join(cards, "card_id", "left").join(urls.select(F.col("canonical_url").alias("_u"), "state"), F.col("detail_url") == F.col("_u"), "left").drop("_u")
    known = (
        F.when(F.col("domain").isNull(), "unknown_card")
        .when(F.col("detail_url").isNull(), "no_detail_url")
        .when(F.col("state").isin("queued", "leased"), "already_queued")
        .when(F.col("state") == "known_deferred", "queued")
        .when(F.col("state").isNotNull(), "already_fetched")
    )
    asked = checkpointed(asked.withColumn("outcome", known))
    hops = F.coalesce("hops", F.lit(0)) if "hops" in cards.columns else F.lit(0)
    new = asked.where("outcome is null").groupBy("detail_url").agg(F.min_by(F.struct("_ord", "domain", "shape", "combo", "facet", hops.alias("hops")), F.struct("_ord", "card_id")).alias("c"))
    open_ = new.select(F.col("c._ord").alias("line"), F.col("detail_url").alias("canonical_url"), *(f"c.{x}" for x in ("domain", "shape", "combo", "facet", "hops")), F.lit(None).cast("string").alias("excluded"))
    judged = admit(open_, policy, accepted).select(F.col("canonical_url").alias("detail_url"), F.coalesce("why", F.lit("queued")).alias("_verdict"))
    return asked.join(judged, "detail_url", "left").select("card_id", "detail_url", F.coalesce("outcome", "_verdict").alias("outcome"))
