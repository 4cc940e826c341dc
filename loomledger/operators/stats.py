"""Aggregations over the ledger: states, problems, artifacts, judgments, coverage, folders, revisions, completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomledger.operators.ledger import WORK_STATES
from loomledger.sources.tables import checkpointed


def state_counts(items: DataFrame) -> DataFrame:
    """total and one count for each state; the states always add up to the total, unknown ones are counted as other."""
    known = [F.count_if(F.col("work_state") == s).alias(s) for s in WORK_STATES]
    return items.agg(F.count(F.lit(1)).alias("total"), *known, F.count_if(F.col("work_state").isNull() | ~F.col("work_state").isin(*WORK_STATES)).alias("other"))


def status(items: DataFrame, artifacts: DataFrame, now: Column) -> DataFrame:
    """One row of measures of the ledger; artifacts: byte_size."""
    expired = (F.col("work_state") == "leased") & (F.col("lease_expires_at") <= now)
    counts = items.agg(
        F.count(F.lit(1)).alias("total"),
        *(F.count_if(F.col("work_state") == s).alias(s) for s in WORK_STATES),
        F.count_if((F.col("work_state") == "leased") & F.col("collected_at").isNotNull()).alias("awaiting_report"),
        F.count_if("review_required").alias("review_required"),
        F.count_if(expired).alias("expired_leases"),
    )
    files = artifacts.agg(F.count(F.lit(1)).alias("files"), F.round(F.coalesce(F.sum("byte_size"), F.lit(0)), 2).alias("bytes"))
    return counts.crossJoin(files).withColumn("workspace_drained", (F.col("queued") == 0) & (F.col("leased") == 0))


def top_errors(attempts: DataFrame, n: int = 5) -> DataFrame:
    """Failures by stage and code (null: unknown), most frequent first, with the latest one as a sample."""
    keys = [F.coalesce(c, F.lit("unknown")).alias(c) for c in ("error_stage", "error_code")]
    out = attempts.where("result = 'failed'").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max_by("attempt_id", F.struct("started_at", "attempt_id")).alias("sample"))
    return out.orderBy(F.desc("n"), "error_code", "error_stage").limit(n)


def top_warnings(attempts: DataFrame, n: int = 5) -> DataFrame:
    return attempts.select(F.explode("warning_codes").alias("warning")).groupBy("warning").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "warning").limit(n)


def artifact_totals(artifacts: DataFrame, kind: str = "kind", size: str = "byte_size") -> DataFrame:
    """kind, files, bytes, and a row of kind null for the whole."""
    return artifacts.rollup(kind).agg(F.count(F.lit(1)).alias("files"), F.round(F.sum(size), 2).alias("bytes"))


def conflicts(judgments: DataFrame) -> DataFrame:
    """Items with several different labels."""
    out = judgments.where("label is not null").groupBy("item_id").agg(F.count_distinct("label").alias("labels"))
    return out.where("labels > 1")


def judgment_counts(judgments: DataFrame) -> DataFrame:
    counts = judgments.agg(F.count(F.lit(1)).alias("total"), F.count("label").alias("labelled"), F.count_if(F.col("label").isNull()).alias("abstained"), F.count_distinct("item_id").alias("items_judged"))
    return counts.crossJoin(conflicts(judgments).agg(F.count(F.lit(1)).alias("conflicts")))


def summarize_rejects(rejects: DataFrame, n: int = 5) -> DataFrame:
    """Reject reasons with their numbers as N, cut to 60 characters: count and first line, most frequent first."""
    reason = F.substring(F.regexp_replace("reason", "[0-9]+", "N"), 1, 60)
    return rejects.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first_line")).orderBy(F.desc("n"), "reason").limit(n)


def domain_states(items: DataFrame) -> DataFrame:
    return items.groupBy("domain").pivot("work_state", list(WORK_STATES)).agg(F.count(F.lit(1))).na.fill(0)


def folder_map(docs: DataFrame, path: str, measures: dict[str, str], dates: dict[str, str] | None = None, title: str | None = None) -> DataFrame:
    """folder, depth, documents, subfolders (direct ones) and the sums of measures (name to column) of every folder at every level above the documents' paths; the largest of dates (name to column); with
    title (a column), readme_title: the title of the folder's own README, or null."""
    parts = F.split(path, "/")
    levels = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    own = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")
    dates = dates or {}
    readme = F.when(F.lower(F.element_at(parts, -1)) == "readme.md", F.col(title)) if title else F.lit(None).cast("string")
    rows = docs.where(F.size(parts) > 1).select(F.explode(levels).alias("folder"), own.alias("_own"), readme.alias("_title"), *dict.fromkeys([*measures.values(), *dates.values()]))
    out = rows.groupBy("folder").agg(
        F.count(F.lit(1)).alias("documents"),
        *(F.sum(c).alias(name) for name, c in measures.items()),
        *(F.max(c).alias(name) for name, c in dates.items()),
        *([F.min(F.when(F.col("_own") == F.col("folder"), F.col("_title"))).alias("readme_title")] if title else []),
    )
    children = out.select(F.regexp_replace("folder", "/?[^/]*$", "").alias("folder")).where("folder <> ''").groupBy("folder").agg(F.count(F.lit(1)).alias("subfolders"))
    return out.join(children, "folder", "left").na.fill(0, ["subfolders"]).withColumn("depth", F.size(F.split("folder", "/")))


def revision_stats(commits: DataFrame, path: str, date: str) -> DataFrame:
    return commits.groupBy(path).agg(F.max(date).alias("last_revision"), F.count(F.lit(1)).alias("revisions"))


def speaker_counts(turns: DataFrame, first: int, last: int) -> DataFrame:
    return turns.where(F.col("line").between(first, last)).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def lease_health(items: DataFrame, now: Column, soon_minutes: int = 5) -> DataFrame:
    leased = F.col("work_state") == "leased"
    over = F.col("lease_expires_at") <= now
    soon = ~over & (F.col("lease_expires_at") <= now + F.make_interval(mins=F.lit(soon_minutes)))
    return items.agg(F.count_if(leased & over).alias("expired"), F.count_if(leased & soon).alias("expiring"), F.count_distinct(F.when(leased & ~over, F.col("lease_id"))).alias("active_leases"))


def lease_overlaps(items: DataFrame) -> DataFrame:
    return items.where("lease_id is not null").groupBy("item_id").agg(F.count_distinct("lease_id").alias("leases")).where("leases > 1")


def attempts_per_item(attempts: DataFrame) -> DataFrame:
    """How many items have how many attempts."""
    return attempts.groupBy("item_id").agg(F.count(F.lit(1)).alias("attempts")).groupBy("attempts").agg(F.count(F.lit(1)).alias("items"))


def retry_history(retries: DataFrame) -> DataFrame:
    return retries.groupBy("item_id").agg(F.count(F.lit(1)).alias("retries"), F.max("created_at").alias("last_retry"))


def run_manifests(attempts: DataFrame, artifacts: DataFrame) -> DataFrame:
    """attempt_id, requested, produced, missing, extra and files of every attempt. attempts: requested_outputs; artifacts: attempt_id, kind."""
    made = artifacts.groupBy("attempt_id").agg(F.array_sort(F.collect_set("kind")).alias("produced"), F.count(F.lit(1)).alias("files"))
    nothing = F.array().cast("array<string>")
    out = attempts.select("attempt_id", F.array_sort("requested_outputs").alias("requested")).join(made, "attempt_id", "left")
    out = out.withColumns({"produced": F.coalesce("produced", nothing), "files": F.coalesce("files", F.lit(0))})
    return out.withColumns({"missing": F.array_except("requested", "produced"), "extra": F.array_except("produced", "requested"), "kept": F.array_intersect("requested", "produced")})


def declared_check(pages: DataFrame, cards: DataFrame) -> DataFrame:
    """page, declared, found and verdict: match, mismatch, or scope_unknown where a series is counted as a whole. pages: page, series, declared; cards: page, card."""
    by_page = cards.groupBy("page").agg(F.count_distinct("card").alias("on_page"))
    by_series = cards.join(pages.select("page", "series"), "page").where("series is not null").groupBy("series").agg(F.count_distinct("card").alias("in_series"))
    out = pages.where("declared is not null").join(by_page, "page", "left").join(by_series, "series", "left").na.fill(0, ["on_page"])
    found = F.when(F.col("declared") == F.col("on_page"), F.col("on_page")).otherwise(F.coalesce("in_series", "on_page"))
    verdict = F.when(F.col("declared") == found, "match").when(F.col("series").isNull(), "mismatch").otherwise("scope_unknown")
    return out.select("page", "declared", found.alias("found"), verdict.alias("verdict"))


def coverage(found: DataFrame, targets: DataFrame, axis: str, value: str) -> DataFrame:
    """Per axis: targets, found values, blanks (targets without a finding), sorted."""
    have = found.where(F.col(value).isNotNull()).groupBy(axis).agg(F.array_sort(F.collect_set(value)).alias("found"))
    want = targets.groupBy(axis).agg(F.array_sort(F.collect_set(value)).alias("targets"))
    out = want.join(have, axis, "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    return out.withColumn("blanks", F.array_except("targets", "found"))


def presence_matrix(keys: DataFrame, settings: DataFrame) -> DataFrame:
    """env, key, presence: filled, filled_by_scope, empty_required or empty_optional. keys: env, key, app, required; settings: env, key (KEY or KEY@app); names only."""
    scoped = settings.select("env", F.col("key").alias("_k")).distinct()
    own = keys.join(scoped.withColumnRenamed("_k", "_scoped"), (keys["env"] == scoped["env"]) & (F.col("_scoped") == F.concat(keys["key"], F.lit("@"), keys["app"])), "left").drop(scoped["env"])
    plain = settings.select(F.col("env").alias("_env"), F.col("key").alias("_plain")).distinct()
    out = own.join(plain, (F.col("env") == F.col("_env")) & (F.col("key") == F.col("_plain")), "left")
    presence = F.when(F.col("_scoped").isNotNull(), "filled_by_scope").when(F.col("_plain").isNotNull(), "filled").when(F.col("required"), "empty_required").otherwise("empty_optional")
    return out.select("env", "key", "app", presence.alias("presence"))


def completion(measures: DataFrame) -> DataFrame:
    """complete and reasons: every measure of open work (all numeric columns) that isn't zero is a reason; null is unknown, and a reason too."""
    names = [c for c, t in measures.dtypes if t in ("int", "bigint", "double")]
    reasons = F.filter(
        F.array(*(F.when(F.col(c).isNull(), F.lit(f"{c}:unknown")).when(F.col(c) > 0, F.concat(F.lit(f"{c}:"), F.col(c).cast("string"))) for c in names)), lambda r: r.isNotNull()
    )
    return measures.withColumn("reasons", reasons).withColumn("complete", F.size("reasons") == 0)


def image_counts(images: DataFrame) -> DataFrame:
    """Per page: unique images, references by origin, downloaded, failed, bytes, mismatches, and the warnings these give. images: page_id, url, origin, status, byte_size, mime_mismatch, n_references."""
    origins = ("img", "srcset", "picture", "meta")
    counts = images.groupBy("page_id").agg(
        F.count_distinct("url").alias("unique"),
        *(F.sum(F.when(F.col("origin") == o, F.col("n_references")).otherwise(0)).alias(f"from_{o}") for o in origins),
        F.count_if(F.col("status") == "ok").alias("downloaded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.sum(F.when(F.col("status") == "ok", F.col("byte_size"))), F.lit(0)).alias("bytes"),
        F.count_if("mime_mismatch").alias("mismatches"),
    )
    warnings = F.array(
        F.when((F.col("failed") > 0) & (F.col("downloaded") > 0), "image_fetch_partial"), F.when((F.col("failed") > 0) & (F.col("downloaded") == 0), "image_fetch_none"), F.when(F.col("mismatches") > 0, "image_mime_mismatch")
    )
    return counts.withColumn("warnings", F.filter(warnings, lambda w: w.isNotNull()))


def sitemap_run_counts(files: DataFrame, urls: DataFrame, errors: DataFrame | None = None, limits: DataFrame | None = None) -> DataFrame:
    """One row for a discovery run. files: kind (urlset, sitemapindex, unreadable, skipped), depth; urls: canonical_url; errors: code, one row each; limits: limit_hit.

    A run with an error, a limit that was met, or a file that wasn't read is partial: what it found is not all there is."""
    opened = files.agg(
        F.count_if(F.col("kind") != "skipped").alias("opened"),
        F.count_if(F.col("kind") == "skipped").alias("skipped"),
        F.count_if(F.col("kind") == "sitemapindex").alias("indexes"),
        F.count_if(F.col("kind") == "urlset").alias("urlsets"),
        F.count_if(F.col("kind") == "unreadable").alias("unreadable"),
        F.max("depth").alias("max_depth"),
    )
    found = urls.agg(F.count_distinct("canonical_url").alias("urls"), (F.count(F.lit(1)) - F.count_distinct("canonical_url")).alias("duplicates"))
    out = opened.crossJoin(found)
    out = out.crossJoin(errors.agg(F.count(F.lit(1)).alias("errors"))) if errors is not None else out.withColumn("errors", F.lit(0).cast("long"))
    out = out.crossJoin(limits.agg(F.array_sort(F.collect_set("limit_hit")).alias("limits_hit"))) if limits is not None else out.withColumn("limits_hit", F.array().cast("array<string>"))
    return out.withColumn("partial", (F.col("unreadable") > 0) | (F.col("skipped") > 0) | (F.col("errors") > 0) | (F.size("limits_hit") > 0))


def inventory(items: DataFrame, collection: str, month: str, current: str, index: DataFrame | None = None, key: str = "path") -> DataFrame:
    """Per collection: items, and those older than the current month (yyyy-MM); with an index (collection and key of what it lists) also index_missing, items that it doesn't list, and
    index_stale, entries without an item. A collection that only the index knows has no items."""
    if index is None:
        return items.groupBy(collection).agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col(month) < current).alias("untidied"))
    have = items.groupBy(collection, key).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(month) < current).alias("_old"))
    listed = index.select(F.col(collection).alias("_c"), F.col(key).alias("_k")).distinct()
    both = have.join(listed, F.col(collection).eqNullSafe(F.col("_c")) & (F.col(key) == F.col("_k")), "full_outer")
    lost, stale = F.col("_n").isNotNull() & F.col("_k").isNull(), F.col("_n").isNull()
    return both.groupBy(F.coalesce(collection, "_c").alias(collection)).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("items"), F.coalesce(F.sum("_old"), F.lit(0)).alias("untidied"), F.count_if(lost).alias("index_missing"), F.count_if(stale).alias("index_stale"))


def fit_budget(rows: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """Rows of each key, in order, whose sizes fit a budget together, and on each row how many its key lost."""
    window = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("used", F.sum(size).over(window))
    lost = F.count_if(F.col("used") > budget).over(Window.partitionBy(key))
    return out.withColumn("dropped", lost).where(F.col("used") <= budget)


def list_notes(notes: DataFrame, kind: str, date: str, key: str, limit: int) -> DataFrame:
    """All topic notes, and the newest date notes, limit of them; rank is the place among the newest of the kind. Of date notes no task keeps more than limit before the exchange; topic
    notes are sorted in ranges and numbered in each, so a kind that many notes have is the work of many tasks. key has to be unique in its kind."""
    newest = (F.desc(date), F.desc(key))
    dated = notes.where(F.col(kind) == "date").withColumn("rank", F.row_number().over(Window.partitionBy(kind).orderBy(*newest))).where(F.col("rank") <= limit)
    topics = notes.where(~F.col(kind).eqNullSafe(F.lit("date"))).repartitionByRange(F.col(kind), *newest).sortWithinPartitions(F.col(kind), *newest)
    placed = checkpointed(topics.withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}))
    ranges = placed.groupBy(F.col(kind).alias("_kind"), F.col("_range").alias("_of")).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_kind").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A row for each kind and range.
    starts = ranges.select("_kind", "_of", (before + 1 - F.col("_first")).alias("_shift"))
    ranked = placed.join(F.broadcast(starts), (F.col("_range") == F.col("_of")) & F.col(kind).eqNullSafe(F.col("_kind"))).withColumn("rank", (F.col("_place") + F.col("_shift")).cast("int"))
    return ranked.select(*notes.columns, "rank").unionByName(dated)
