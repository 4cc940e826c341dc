"""Filters and reviews that people ask for: inboxes, groups, searches of notes and transcripts, queues, domains, exclusions, unvisited links, discovery."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomledger.operators.text import cleaned


def _holds(columns: list[str], needle: str) -> Column:
    """Whether any of the texts holds the needle, whatever the case; null texts hold nothing."""
    return reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(c), F.lit(needle.lower())), F.lit(False)) for c in columns))


def filter_inbox(messages: DataFrame, unread: bool = False, query: str | None = None) -> DataFrame:
    """Messages, only unread ones if asked for, of which text, file or sender holds the query. messages: read, and text, file, sender as far as they are there."""
    out = messages.where(~F.coalesce("read", F.lit(False))) if unread else messages
    return out.where(_holds([c for c in ("text", "file", "sender") if c in messages.columns], query)) if query else out


def filter_groups(dashboard: DataFrame, hide_done: bool = False, hide_empty: bool = False, campaign=None, mine: DataFrame | None = None) -> DataFrame:
    """Groups of a dashboard (group_id, campaign, done, total): without finished ones, without empty ones, of one campaign, with an open task of one's own (mine: group_id)."""
    out = dashboard
    if hide_done:
        out = out.where((F.col("total") == 0) | (F.col("done") < F.col("total")))
    if hide_empty:
        out = out.where(F.col("total") > 0)
    if campaign is not None:
        out = out.where(F.col("campaign") == campaign)
    if mine is not None:
        out = out.join(mine.select("group_id").distinct(), "group_id", "left_semi").select(dashboard.columns)
    return out


def search_notes(notes: DataFrame, needle: str, limit: int, order: str, texts: list[str]) -> DataFrame:
    """The newest notes (largest order first) of which a text holds the needle, limit of them, with the total of all that do."""
    hits = notes.where(_holds(texts, needle))
    return hits.crossJoin(F.broadcast(hits.agg(F.count(F.lit(1)).alias("total")))).orderBy(F.desc(order)).limit(limit)


def search_transcripts(turns: DataFrame, needle: str, before: int = 20, length: int = 60) -> DataFrame:
    """file, line, speaker and snippet of turns whose cleaned text holds the needle; side chains are left out. turns: file, line, speaker, text, and sidechain where known."""
    main = turns.where(~F.coalesce("sidechain", F.lit(False))) if "sidechain" in turns.columns else turns
    text = main.select("file", "line", "speaker", cleaned(F.col("text")).alias("text")).withColumn("_at", F.instr(F.lower("text"), needle.lower())).where("_at > 0")
    return text.select("file", "line", "speaker", F.substring(F.col("text"), F.greatest(F.lit(1), F.col("_at") - before), F.lit(length)).alias("snippet"))


def queue_order(items: DataFrame, key: str) -> DataFrame:
    """The queue: highest priority first, then by domain and key."""
    return items.orderBy(F.desc("priority"), "domain", key)


def sort_map(folders: DataFrame, sort: str = "name", name: str = "folder") -> DataFrame:
    """Folders by name, or by one of their measures, largest first, ties by name."""
    if sort != "name" and sort not in folders.columns:
        raise ValueError(f"no such order: {sort}")
    return folders.orderBy(name) if sort == "name" else folders.orderBy(F.desc_nulls_last(sort), name)


def top_domains(items: DataFrame, n: int = 20) -> DataFrame:
    return items.groupBy("domain").agg(F.count(F.lit(1)).alias("urls")).orderBy(F.desc("urls"), "domain").limit(n)


def domain_profile(urls: DataFrame, n: int = 5, excluded: DataFrame | None = None) -> DataFrame:
    """domain, part (shape, combo, facet_key, excluded_by), rank, value, count and urls: what fills a domain's caps, the n most frequent values of each part.

    urls: domain, shape, combo, facet_keys (array); excluded: domain, why, why_evidence. Empty combos don't count. Values are counted by domain and value
    before the exchange, and no task keeps more than n of a domain's part."""
    value = lambda part, column: F.struct(F.lit(part).alias("part"), column.alias("value"))
    facets = F.transform(F.coalesce("facet_keys", F.array().cast("array<string>")), lambda k: value("facet_key", k))
    parts = F.concat(F.array(value("shape", F.col("shape"))), F.when(F.col("combo") != "", F.array(value("combo", F.col("combo")))).otherwise(F.array().cast("array<struct<part: string, value: string>>")), facets)
    rows = urls.select("domain", F.explode(parts).alias("v")).select("domain", "v.part", "v.value")
    if excluded is not None:
        rows = rows.unionByName(excluded.select("domain", F.lit("excluded_by").alias("part"), F.concat_ws(":", "why", "why_evidence").alias("value")))
    counted = rows.where("value is not null").groupBy("domain", "part", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counted.withColumn("rank", F.row_number().over(Window.partitionBy("domain", "part").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= n)
    total = urls.groupBy("domain").agg(F.count(F.lit(1)).alias("urls"))
    return best.join(total, "domain", "left").select("domain", "part", "rank", "value", "n", F.coalesce("urls", F.lit(0)).alias("urls"))


def excluded_by(excluded: DataFrame, n: int = 20, resolved: DataFrame | None = None) -> DataFrame:
    """rule (why:evidence), domain, active and resolved, the n pairs with most active exclusions. excluded: canonical_url, domain, why, why_evidence; resolved: canonical_url of those that a
    later policy let in."""
    done = F.lit(False)
    rows = excluded
    if resolved is not None:
        rows = excluded.join(resolved.select("canonical_url", F.lit(True).alias("_done")).distinct(), "canonical_url", "left")
        done = F.coalesce("_done", F.lit(False))
    counts = rows.groupBy(F.concat_ws(":", "why", "why_evidence").alias("rule"), "domain").agg(F.count_if(~done).alias("active"), F.count_if(done).alias("resolved"))
    return counts.orderBy(F.desc("active"), "rule", "domain").limit(n)


def unvisited(links: DataFrame, items: DataFrame, by: str = "domain") -> DataFrame:
    """Per domain: links_seen, all of them, and unvisited, the different addresses among them that are no items. links: canonical_url and by; items: canonical_url.

    Links are counted by address first, so one pass and one exchange of addresses give both numbers."""
    seen = links.groupBy(by, "canonical_url").agg(F.count(F.lit(1)).alias("_n"))
    met = seen.join(items.select("canonical_url", F.lit(True).alias("_item")).distinct(), "canonical_url", "left")
    return met.groupBy(by).agg(F.sum("_n").alias("links_seen"), F.count_if(F.col("_item").isNull()).alias("unvisited"))


#: Where a discovered address can come from, in the order in which they are named.
DISCOVERED_BY = ("robots", "sitemap", "internal_link", "import")


def discover(found: dict[str, DataFrame], failed: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, counts, failures): every address once with its kinds; addresses and sources of each kind, kinds without any too; the sources that failed.

    found: addresses (canonical_url) by kind of DISCOVERED_BY, robots for sitemaps that robots files declare, sitemap for conventional ones, internal_link for links of entry
    pages, import for earlier link lists. failed: source_kind, source, code. A kind with a failed source is partial: its counts say what was seen, not what there is."""
    if unknown := set(found) - set(DISCOVERED_BY):
        raise ValueError(f"unknown kinds: {sorted(unknown)}")
    rows = reduce(DataFrame.unionByName, (df.select("canonical_url", F.lit(kind).alias("source_kind")) for kind, df in found.items()))
    rows = rows.where("canonical_url is not null")
    by_kind = rows.groupBy("canonical_url", "source_kind").agg(F.count(F.lit(1)).alias("n"))
    items = by_kind.groupBy("canonical_url").agg(F.array_sort(F.collect_set("source_kind")).alias("kinds"), F.sum("n").alias("times"))
    counts = by_kind.groupBy("source_kind").agg(F.count(F.lit(1)).alias("items"), F.sum("n").alias("sources"))
    spark = rows.sparkSession
    failures = failed if failed is not None else spark.createDataFrame([], "source_kind string, source string, code string")
    every = spark.createDataFrame([(k,) for k in DISCOVERED_BY], "source_kind string")
    broken = failures.groupBy("source_kind").agg(F.count(F.lit(1)).alias("failed"))
    counts = every.join(counts, "source_kind", "left").join(broken, "source_kind", "left").na.fill(0, ["items", "sources", "failed"])
    return items, counts.withColumn("partial", F.col("failed") > 0), failures
