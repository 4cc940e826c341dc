"""Ordered computations: page series, pace, backoff, caps, revisions, overlays, sections, task queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_per(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key."""
    rank = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_r", F.row_number().over(rank)).where("_r = 1").drop("_r")


def series_novelty(observed: DataFrame) -> DataFrame:
    """series, index, unknown, novelty (ids no earlier known page gave; null for unknown pages). observed: series, index, emitted, unknown."""
    ids = observed.where("not unknown").select("series", "index", F.explode(F.array_distinct("emitted")).alias("id"))
    first = ids.groupBy("series", "id").agg(F.min("index").alias("index"))
    fresh = first.groupBy("series", "index").agg(F.count(F.lit(1)).alias("fresh"))
    out = observed.select("series", "index", "unknown").join(fresh, ["series", "index"], "left")
    return out.select("series", "index", "unknown", F.when(~F.col("unknown"), F.coalesce("fresh", F.lit(0))).alias("novelty"))


def series_dryness(observed: DataFrame, needed: int = 3) -> DataFrame:
    """Per series: pages, unique ids, current and longest run of pages without anything new, dry, dry_from, gaps.

    A gap in the index and an unknown page end a run: what wasn't seen isn't zero. Runs are islands: pages between two
    breaks, a break being a page with news, an unknown page, or a page after a gap."""
    pages = series_novelty(observed)
    order = Window.partitionBy("series").orderBy("index")
    gap = F.coalesce(F.col("index") != F.lag("index").over(order) + 1, F.lit(False))
    pages = pages.withColumn("gap", gap).withColumn("dry", F.coalesce(F.col("novelty") == 0, F.lit(False)))
    # A dry page after a gap opens an island of its own; any page that isn't dry ends the one before.
    pages = pages.withColumn("island", F.sum((F.col("gap") | ~F.col("dry")).cast("int")).over(order))
    runs = pages.withColumn("run", F.sum(F.col("dry").cast("int")).over(Window.partitionBy("series", "island").orderBy("index")))
    last = F.max_by(F.struct("run", "dry", "island"), "index").alias("last")
    totals = runs.groupBy("series").agg(F.count(F.lit(1)).alias("pages"), F.max("run").alias("longest_dry_streak"), F.count_if("gap").alias("gaps"), F.count_if("unknown").alias("unknown_pages"), last)
    starts = runs.where("dry").groupBy("series", "island").agg(F.min("index").alias("dry_from"))
    unique = observed.where("not unknown").select("series", F.explode("emitted").alias("id")).groupBy("series").agg(F.count_distinct("id").alias("unique_details"))
    out = totals.withColumn("dry_streak", F.when(F.col("last.dry"), F.col("last.run")).otherwise(0)).withColumn("island", F.col("last.island"))
    out = out.join(starts, ["series", "island"], "left").join(unique, "series", "left")
    dry = F.col("dry_streak") >= needed
    return out.select("series", "pages", F.coalesce("unique_details", F.lit(0)).alias("unique_details"), "dry_streak", "longest_dry_streak", dry.alias("dry"), F.when(dry, F.col("dry_from")).alias("dry_from"), "gaps", "unknown_pages")


def pace_schedule(requests: DataFrame, domain: str, now_ms: str, order: str, gap_ms: str) -> DataFrame:
    """Add slot, allowed_at and wait_ms: requests of a domain in order, each allowed no earlier than the one before plus its gap.

    Closed form: with G the sum of the gaps before a request, allowed = G + max over it and earlier ones of (now - G). Order
    decides within a domain, so a domain is one sorted partition of a window; domains are dealt out."""
    window = Window.partitionBy(domain).orderBy(order)
    before = F.coalesce(F.sum(gap_ms).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = requests.withColumn("_g", before)
    out = out.withColumn("allowed_at", F.col("_g") + F.max(F.col(now_ms) - F.col("_g")).over(window.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("slot", F.row_number().over(window)).withColumn("wait_ms", F.col("allowed_at") - F.col(now_ms)).drop("_g")


def backoff(results: DataFrame, domain: str, order: str, result: str, base_ms: int = 1000, most_ms: int = 300_000) -> DataFrame:
    """Add failures (in a row; ok ends the row, blocked counts) and backoff_ms (doubling, capped; null after ok)."""
    window = Window.partitionBy(domain).orderBy(order)
    bad = F.col(result) != "ok"
    out = results.withColumn("_island", F.sum((~bad).cast("int")).over(window))
    run = F.sum(bad.cast("int")).over(Window.partitionBy(domain, "_island").orderBy(order))
    out = out.withColumn("failures", run).drop("_island")
    return out.withColumn("backoff_ms", F.when(bad, F.least(F.lit(most_ms), base_ms * F.pow(F.lit(2), F.least(F.col("failures") - 1, F.lit(40)))).cast("long")))


def daily_cap(requests: DataFrame, domain: str, at: str, order: str, cap: int) -> DataFrame:
    """Add allowed and wait_s: the first cap requests of a domain and UTC day; others wait until midnight. Refused requests don't count."""
    day = F.to_date(at)
    rank = F.row_number().over(Window.partitionBy(domain, day).orderBy(order))
    out = requests.withColumn("allowed", rank <= cap)
    return out.withColumn("wait_s", F.when(~F.col("allowed"), F.unix_seconds(F.date_add(day, 1).cast("timestamp")) - F.unix_seconds(F.col(at))))


def block_sleep(results: DataFrame, domain: str, at: str, order: str, blocked: str, every: int, sleep_s: int) -> DataFrame:
    """Blocked results with their number; every k-th puts its domain to sleep until sleep_until."""
    hit = results.where(F.col(blocked)).withColumn("blocks", F.row_number().over(Window.partitionBy(domain).orderBy(order)))
    return hit.withColumn("sleep_until", F.when(F.col("blocks") % every == 0, F.unix_seconds(at) + sleep_s))


def overlay(layers: DataFrame, name: str, layer: str) -> DataFrame:
    """Of rows with one name the one of the highest layer."""
    rank = Window.partitionBy(name).orderBy(F.desc(layer))
    return layers.withColumn("_r", F.row_number().over(rank)).where("_r = 1").drop("_r")


def revisions(commits: DataFrame, path: str, date: str, tie: str, n: int = 5) -> DataFrame:
    """The last n revisions of each path, numbered from the oldest, with their number and the first and last date."""
    order = Window.partitionBy(path).orderBy(date, tie)
    whole = Window.partitionBy(path)
    out = commits.withColumns({"revision": F.row_number().over(order), "total": F.count(F.lit(1)).over(whole), "first_date": F.min(date).over(whole), "last_date": F.max(date).over(whole)})
    return out.where(F.col("revision") > F.col("total") - n)


def last_user_line(turns: DataFrame, file: str, line: str, role: str, text: str) -> DataFrame:
    """The last line a person wrote in each transcript; empty ones don't count."""
    said = turns.where((F.col(role) == "user") & (F.trim(text) != ""))
    return said.groupBy(file).agg(F.max(line).alias(line), F.max_by(text, line).alias(text))


def retain_last(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    rank = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= n).drop("_r")


# --- tasks ---------------------------------------------------------------------------------------------------------


def dependencies(tasks: DataFrame) -> DataFrame:
    """group_id, number and unresolved (sorted numbers of dependencies that aren't completed) of every pending task."""
    wanted = tasks.where("status = 'pending'").select("group_id", "number", F.explode_outer("depends_on").alias("needs"))
    done = tasks.where("status = 'completed'").select("group_id", F.col("number").alias("needs"), F.lit(True).alias("_done"))
    met = wanted.join(done, ["group_id", "needs"], "left")
    return met.groupBy("group_id", "number").agg(F.array_sort(F.collect_list(F.when(F.col("_done").isNull(), F.col("needs")))).alias("unresolved"))


def eligible_tasks(tasks: DataFrame) -> DataFrame:
    ready = dependencies(tasks).where(F.size("unresolved") == 0).select("group_id", "number")
    return tasks.join(ready, ["group_id", "number"], "left_semi")


def blocked_tasks(tasks: DataFrame) -> DataFrame:
    return dependencies(tasks).where(F.size("unresolved") > 0)


def next_tasks(tasks: DataFrame) -> DataFrame:
    """One task a group: the one in progress, else the eligible one of highest priority, smallest number first."""
    going = tasks.where("status = 'in_progress'").withColumn("_first", F.lit(0))
    ready = eligible_tasks(tasks).withColumn("_first", F.lit(1))
    rank = Window.partitionBy("group_id").orderBy("_first", F.desc("priority"), "number")
    return going.unionByName(ready).withColumn("_r", F.row_number().over(rank)).where("_r = 1").drop("_r", "_first")


def group_dashboard(groups: DataFrame, tasks: DataFrame, notes: DataFrame | None = None, plans: DataFrame | None = None) -> DataFrame:
    """group_id, done, total and next_open (smallest open number) of every group, groups without tasks included; with notes and plans (group_id) their numbers too."""
    counts = tasks.groupBy("group_id").agg(F.count_if(F.col("status") == "completed").alias("done"), F.count(F.lit(1)).alias("total"), F.min(F.when(F.col("status") != "completed", F.col("number"))).alias("next_open"))
    out, named = groups.join(counts, "group_id", "left"), ["done", "total"]
    for name, table in (("notes", notes), ("plans", plans)):
        if table is not None:
            out = out.join(table.groupBy("group_id").agg(F.count(F.lit(1)).alias(name)), "group_id", "left")
            named.append(name)
    return out.na.fill(0, named)


def campaign_summary(dashboard: DataFrame, campaign: str) -> DataFrame:
    """Per campaign: groups, open and total tasks, groups hidden because they are finished or empty."""
    hidden = (F.col("total") == 0) | (F.col("done") == F.col("total"))
    return dashboard.groupBy(campaign).agg(F.count(F.lit(1)).alias("groups"), F.sum(F.col("total") - F.col("done")).alias("open_tasks"), F.sum("total").alias("total_tasks"), F.count_if(hidden).alias("hidden_groups"))
