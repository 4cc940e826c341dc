"""Queries of the aggregations and ordered computations over events, lineitem, orders, labels, documents, conversations and the small tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomledger.operators import ledger, reviews, series, stats
from loomledger.sources.tables import ATTEMPTS_SQL, JUDGMENTS_SQL, TASKS_SQL, attempts, judgments, table, tasks

_NOW_SQL = "TIMESTAMP '2024-01-10 00:00:00'"


def _now():
    return F.lit("2024-01-10 00:00:00").cast("timestamp")


def items(spark, sf_dir):
    """Items from events: the state by type, leases by the property k."""
    a = attempts(spark, sf_dir)
    state = F.when(a["kind"] == "view", "queued").when(a["kind"].isin("click", "signup"), "leased").when(a["kind"] == "purchase", "done").otherwise("failed")
    a = a.withColumn("work_state", state)
    leased = F.col("work_state") == "leased"
    return a.select(
        F.col("attempt_id").alias("item_id"),
        "work_state",
        F.concat(F.lit("d"), F.col("item_id").cast("string")).alias("domain"),
        F.when(leased, F.concat(F.lit("l"), (F.col("k") % 13).cast("string"))).alias("lease_id"),
        F.when(leased, F.col("started_at")).alias("lease_expires_at"),
        F.when(leased & (F.col("k") % 3 == 0), F.col("started_at")).alias("collected_at"),
        (F.col("k") % 10 == 0).alias("review_required"),
        (F.col("k") % 4).alias("attempts"),
    )


ITEMS_SQL = f"""
SELECT attempt_id AS item_id, s AS work_state, 'd' || item_id AS domain, CASE WHEN s = 'leased' THEN 'l' || (k % 13) END AS lease_id, CASE WHEN s = 'leased' THEN started_at END AS lease_expires_at,
  CASE WHEN s = 'leased' AND k % 3 = 0 THEN started_at END AS collected_at, k % 10 = 0 AS review_required, k % 4 AS attempts
FROM (SELECT *, CASE WHEN kind = 'view' THEN 'queued' WHEN kind IN ('click', 'signup') THEN 'leased' WHEN kind = 'purchase' THEN 'done' ELSE 'failed' END AS s FROM ({ATTEMPTS_SQL}))
"""


def state_counts(spark, sf_dir):
    """Items by state; some are in a state that the ledger doesn't know, some in none."""
    lost = F.when(F.col("item_id") % 97 == 5, "lost").when(F.col("item_id") % 89 != 3, F.col("work_state"))
    return stats.state_counts(items(spark, sf_dir).withColumn("work_state", lost))


def status(spark, sf_dir):
    return stats.status(items(spark, sf_dir), attempts(spark, sf_dir), _now())


def top_errors(spark, sf_dir):
    return stats.top_errors(attempts(spark, sf_dir))


def top_warnings(spark, sf_dir):
    return stats.top_warnings(attempts(spark, sf_dir))


def artifact_totals(spark, sf_dir):
    return stats.artifact_totals(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity").select(F.coalesce("l_returnflag", F.lit("all")).alias("kind"), "files", "bytes")


def conflicts(spark, sf_dir):
    j = judgments(spark, sf_dir).withColumn("label", F.coalesce("label", F.when(F.col("worker_id") == "toxic", "no")))
    return stats.conflicts(j)


def _told(spark, sf_dir):
    """Judgments of which the toxicity worker says no where it sees nothing, for two documents in three."""
    return judgments(spark, sf_dir).withColumn("label", F.coalesce("label", F.when((F.col("worker_id") == "toxic") & (F.col("item_id") % 3 != 0), "no")))


def judgment_counts(spark, sf_dir):
    return stats.judgment_counts(_told(spark, sf_dir))


def reject_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type in ('error', 'signup')")
    return stats.summarize_rejects(e.select(F.col("event_id").alias("line"), F.concat(F.lit("bad value "), F.col("value").cast("int").cast("string"), F.lit(" in "), F.col("event_type"), F.lit(" of "), (F.col("user_id") % 3).cast("string")).alias("reason")))


def ledger_rows(spark, sf_dir):
    """Documents as items, found by two ways, with judgments, the runs of events and a file for every third run."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "lang", "source")
    ways = F.explode(F.array(F.struct(F.when(F.col("lang") == "en", "seed").otherwise("import").alias("k"), F.col("source").alias("v")), F.struct(F.lit("internal_link").alias("k"), F.col("lang").alias("v"))))
    sources = docs.select("item_id", ways.alias("w")).select("item_id", F.col("w.k").alias("source_kind"), F.col("w.v").alias("source_value"))
    runs = attempts(spark, sf_dir).withColumn("operation", F.when(F.col("attempt_id") % 4 == 0, "map").otherwise("collect"))
    files = runs.where("attempt_id % 3 = 0").select("attempt_id", F.concat(F.lit("artifacts/"), F.col("attempt_id").cast("string")).alias("path"))
    out = ledger.ledger_rows(docs.select("item_id"), sources, judgments(spark, sf_dir), runs, files)
    return out.select("item_id", *(F.array_join(c, ",").alias(c) for c in ("source_kinds", "sources", "labels", "warnings", "errors", "attempt_ids", "manifest_paths", "artifact_paths")), "judgments", "attempts")


def filtered_ledger(spark, sf_dir):
    out = ledger.filter_ledger(
        items(spark, sf_dir).withColumn("item_id", F.col("item_id")), None, judgments(spark, sf_dir), attempts(spark, sf_dir).withColumn("item_id", F.col("attempt_id")), state="queued, leased", label="yes", warning="redirected,thin_text"
    )
    return out.select("item_id", "work_state")


def domain_states(spark, sf_dir):
    return stats.domain_states(items(spark, sf_dir))


def folder_map(spark, sf_dir):
    """Documents in folders of source and language; every 50th is its folder's README."""
    name = F.when(F.col("doc_id") % 50 == 7, "README.md").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    docs = table(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", F.lit("corpus"), "source", "lang", name)).withColumn("title", F.substring_index("text", "\n", 1))
    return stats.folder_map(docs.withColumn("lines", F.size(F.split("text", "\n"))), "path", {"lines": "lines", "chars": "n_chars"}, {"newest": "doc_id"}, "title")


def revision_stats(spark, sf_dir):
    return stats.revision_stats(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate")


def speaker_counts(spark, sf_dir):
    return stats.speaker_counts(table(spark, sf_dir, "conversations").withColumn("line", F.col("turn") + 1), 2, 5)


def lease_health(spark, sf_dir):
    return stats.lease_health(items(spark, sf_dir), _now(), 24 * 60)


def lease_overlaps(spark, sf_dir):
    return stats.lease_overlaps(items(spark, sf_dir).withColumn("item_id", F.col("domain"))).withColumnRenamed("item_id", "domain")


def attempts_per_item(spark, sf_dir):
    return stats.attempts_per_item(attempts(spark, sf_dir))


def retry_history(spark, sf_dir):
    a = attempts(spark, sf_dir).where("result = 'failed'")
    return stats.retry_history(a.select("item_id", F.col("started_at").alias("created_at"))).withColumn("last_retry", F.unix_micros("last_retry"))


def run_manifests(spark, sf_dir):
    a = attempts(spark, sf_dir)
    kinds = F.array(F.lit("html"), F.lit("images"), F.lit("links"), F.lit("text"))
    asked = a.select("attempt_id", F.filter(kinds, lambda x: F.length(x) % 5 <= F.col("k") % 5).alias("requested_outputs"))
    made = a.select("attempt_id", F.explode(F.filter(kinds, lambda x: (F.length(x) + F.col("k")) % 3 == 0)).alias("kind"))
    return stats.run_manifests(asked, made).select("attempt_id", "files", *(F.array_join(c, ",").alias(c) for c in ("requested", "produced", "missing", "extra", "kept")))


def coverage(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("axis"), F.col("n_name").alias("value"), "n_nationkey")
    found = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("axis", "value")
    return stats.coverage(found, nation, "axis", "value").select("axis", *(F.array_join(c, ",").alias(c) for c in ("targets", "found", "blanks")))


def presence_matrix(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    keys = n.crossJoin(table(spark, sf_dir, "region").select(F.col("r_name").alias("env"), "r_regionkey")).select("env", F.col("n_name").alias("key"), F.lit("app").alias("app"), (F.col("n_nationkey") % 2 == 0).alias("required"))
    settings = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    named = settings.select(F.col("r_name").alias("env"), F.when(F.col("s_acctbal") > 3000, F.col("n_name")).otherwise(F.concat("n_name", F.lit("@app"))).alias("key"))
    return stats.presence_matrix(keys, named)


def inventory(spark, sf_dir):
    """Orders by priority; an index that lists those of two customers in three, and some orders that aren't there."""
    o = table(spark, sf_dir, "orders").withColumns({"month": F.date_format("o_orderdate", "yyyy-MM"), "path": F.col("o_orderkey").cast("string")})
    listed = o.where("o_custkey % 3 <> 0").select("o_orderpriority", "path").unionByName(o.where("o_orderkey % 100 = 1").select("o_orderpriority", F.concat("path", F.lit("-gone")).alias("path")))
    return stats.inventory(o, "o_orderpriority", "month", "1997-06", listed)


def fit_budget(spark, sf_dir):
    return stats.fit_budget(attempts(spark, sf_dir).withColumn("size", F.col("k") + 20), "item_id", "attempt_id", "size", 1500).select("attempt_id", "item_id", "used", "dropped")


def list_notes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "en", "date").otherwise(F.col("lang")).alias("kind"), "n_chars")
    return stats.list_notes(docs, "kind", "n_chars", "doc_id", 30).select("doc_id", "kind", "rank")


def latest_per(spark, sf_dir):
    return series.latest_per(attempts(spark, sf_dir), "item_id", ["started_at", "attempt_id"]).select("item_id", "attempt_id", "result")


def _observed(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_suppkey").alias("series"), (F.col("l_linenumber") * (1 + F.col("l_suppkey") % 2)).cast("int").alias("index"), (F.col("l_partkey") % (2 + F.col("l_suppkey") % 9) * F.col("l_linenumber").cast("long")).alias("id"))
    return rows.groupBy("series", "index").agg(F.array_sort(F.collect_set(F.col("id") % 12)).alias("emitted")).withColumn("unknown", (F.col("series") + F.col("index")) % 11 == 0)


_OBSERVED_SQL = """
SELECT series, idx, list_sort(list_distinct(list(id % 12))) AS emitted, (series + idx) % 11 = 0 AS unknown FROM (
  SELECT l_suppkey AS series, CAST(l_linenumber * (1 + l_suppkey % 2) AS INTEGER) AS idx, l_partkey % (2 + l_suppkey % 9) * l_linenumber AS id FROM lineitem) GROUP BY series, idx
"""


def series_novelty(spark, sf_dir):
    return series.series_novelty(_observed(spark, sf_dir)).select("series", F.col("index").alias("page"), F.coalesce("novelty", F.lit(-1)).alias("novelty"))


def series_dryness(spark, sf_dir):
    return series.series_dryness(_observed(spark, sf_dir)).withColumn("dry_from", F.coalesce("dry_from", F.lit(-1)))


def pace_schedule(spark, sf_dir):
    e = attempts(spark, sf_dir).withColumns({"now_ms": F.unix_millis("started_at"), "gap_ms": F.lit(600_000) + F.col("attempt_id") * 37 % 90_000})
    return series.pace_schedule(e, "item_id", "now_ms", "attempt_id", "gap_ms").select("attempt_id", "slot", "allowed_at", "wait_ms")


def backoff(spark, sf_dir):
    e = attempts(spark, sf_dir).withColumn("r", F.when(F.col("result") == "success", F.when(F.col("k") % 2 == 0, "blocked").otherwise("ok")).otherwise(F.col("result")))
    return series.backoff(e, "item_id", "attempt_id", "r").select("attempt_id", "failures", "backoff_ms")


def daily_cap(spark, sf_dir):
    out = series.daily_cap(attempts(spark, sf_dir), "item_id", "started_at", "attempt_id", 3)
    return out.select("attempt_id", "allowed", "wait_s")


def block_sleep(spark, sf_dir):
    e = attempts(spark, sf_dir).withColumn("blocked", F.col("result") == "failed")
    return series.block_sleep(e, "item_id", "started_at", "attempt_id", "blocked", 3, 3600).select("attempt_id", "blocks", "sleep_until")


def overlay(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("name"), F.lit(1).alias("layer"), F.col("c_custkey").alias("id"))
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("name"), F.lit(2).alias("layer"), F.col("s_suppkey").alias("id"))
    both = c.unionByName(s).groupBy("name", "layer").agg(F.min("id").alias("id"))
    return series.overlay(both, "name", "layer")


def revisions(spark, sf_dir):
    out = series.revisions(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey", 5)
    return out.select("o_custkey", "o_orderkey", "revision", "total", F.date_format("first_date", "yyyy-MM-dd").alias("first_date"), F.date_format("last_date", "yyyy-MM-dd").alias("last_date"))


def last_user_line(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("line", F.col("turn") + 1)
    return series.last_user_line(c, "conv_id", "line", "role", "text").select("conv_id", "line", F.sha2("text", 256).alias("text_hash"))


def retained(spark, sf_dir):
    return series.retain_last(attempts(spark, sf_dir), "item_id", "attempt_id", 200).select("item_id", "attempt_id")


def eligible_tasks(spark, sf_dir):
    return series.eligible_tasks(tasks(spark, sf_dir)).select("group_id", "number", "priority")


def blocked_tasks(spark, sf_dir):
    return series.blocked_tasks(tasks(spark, sf_dir)).select("group_id", "number", F.array_join(F.transform("unresolved", lambda x: x.cast("string")), ",").alias("unresolved"))


def next_tasks(spark, sf_dir):
    return series.next_tasks(tasks(spark, sf_dir)).select("group_id", "number", "priority")


def _dashboard(spark, sf_dir):
    groups = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("group_id"), F.col("o_custkey").alias("campaign"))
    return series.group_dashboard(groups, tasks(spark, sf_dir))


def group_dashboard(spark, sf_dir):
    """Orders as groups of tasks, events as their notes, returned parts as plans."""
    notes = table(spark, sf_dir, "events").select(F.col("user_id").alias("group_id"))
    plans = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("group_id"))
    groups = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("group_id"))
    return series.group_dashboard(groups, tasks(spark, sf_dir), notes, plans).select("group_id", "done", "total", "next_open", "notes", "plans")


def campaign_summary(spark, sf_dir):
    return series.campaign_summary(_dashboard(spark, sf_dir), "campaign")


def filtered_groups(spark, sf_dir):
    """Groups that aren't finished or empty, with a task of priority over 40 of one's own."""
    mine = tasks(spark, sf_dir).where("priority > 40 and status <> 'completed'").select("group_id")
    return reviews.filter_groups(_dashboard(spark, sf_dir), hide_done=True, hide_empty=True, mine=mine).select("group_id", "campaign")


def campaign_groups(spark, sf_dir):
    """All groups of one campaign that aren't finished."""
    return reviews.filter_groups(_dashboard(spark, sf_dir), hide_done=True, campaign=7).select("group_id", "done", "total")


def existing_items(spark, sf_dir):
    """Customers without an order (NOT EXISTS) and with one (EXISTS), counted by market segment."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    tag = lambda negate, name: ledger.exists_in(c, o, ["c_custkey"], negate).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(name))
    return tag(False, "exists").unionByName(tag(True, "not_exists"))


def reclaimed(spark, sf_dir):
    out = ledger.reclaim(items(spark, sf_dir), _now(), 3)
    return out.select("item_id", "work_state", F.coalesce("lease_id", F.lit("-")).alias("lease_id"))


def retried(spark, sf_dir):
    asked = attempts(spark, sf_dir).where("k % 5 = 0").select((F.col("attempt_id") + 5).alias("item_id"))
    return ledger.apply_retries(items(spark, sf_dir), asked, "again")[1].select("item_id", "outcome")


def applied_results(spark, sf_dir):
    results = attempts(spark, sf_dir).select((F.col("attempt_id") % 5000).alias("item_id"), "result", F.col("started_at").alias("ended_at"))
    return ledger.apply_results(items(spark, sf_dir), results).select("item_id", "work_state", F.coalesce("lease_id", F.lit("-")).alias("lease_id"))


def finished_attempts(spark, sf_dir):
    a = attempts(spark, sf_dir)
    open_ = a.select("attempt_id", F.when(F.col("k") % 9 == 0, F.lit("success")).alias("result"), F.lit(None).cast("string").alias("error_stage"), F.lit(None).cast("string").alias("error_code"), F.lit(None).cast("timestamp").alias("finished_at"))
    results = a.select((F.col("attempt_id") - F.col("attempt_id") % 2).alias("attempt_id"), "result", "error_stage", "error_code", F.col("started_at").alias("finished_at"))
    return ledger.finish_attempts(open_, results)[1].groupBy("why").agg(F.count(F.lit(1)).alias("n"))


def judgment_reasons(spark, sf_dir):
    """Labels as judgments written in JSON, some of them with a field that is missing or of another type."""
    n = F.col("doc_id")
    labels = table(spark, sf_dir, "labels")
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    label = F.when(n % 13 == 1, F.lit("7")).when(n % 5 == 0, F.lit('" "')).when(F.col("toxic") == 1, F.lit('"bad"')).when(F.col("quality") == 1, F.lit('"good"')).otherwise(F.lit("null"))
    confidence = F.when(n % 19 == 2, F.lit('"high"')).when(n % 7 == 0, F.lit("1.5")).when(n % 3 == 0, F.lit("0.5")).otherwise(F.lit("null"))
    note = F.when(n % 23 == 3, F.lit("[]")).when(n % 4 == 0, F.lit('"seen"')).otherwise(F.lit('""'))
    evidence = F.when(n % 11 == 0, F.lit("null")).otherwise(F.concat(F.lit("["), (n * 2).cast("string"), F.lit(","), (n + 1).cast("string"), F.lit("]")))
    item = F.when(n % 29 == 4, F.lit('"x"')).when(n % 2 == 0, (n * 2).cast("string")).otherwise(text((n * 2).cast("string")))
    fields = F.concat(F.lit('"item_id":'), item, F.lit(',"label":'), label, F.lit(',"confidence":'), confidence, F.when(n % 31 == 5, F.lit("")).otherwise(F.concat(F.lit(',"note":'), note)), F.lit(',"evidence_artifact_ids":'), evidence)
    j = ledger.typed_judgments(labels.select("doc_id", F.when(n % 37 == 6, F.lit("{broken")).otherwise(F.concat(F.lit("{"), fields, F.lit("}"))).alias("json")))
    docs = table(spark, sf_dir, "documents")
    artifacts = docs.select(F.col("doc_id").alias("artifact_id"), F.col("doc_id").alias("item_id"), F.when(F.col("doc_id") % 17 == 0, "size_mismatch").otherwise("ok").alias("state"))
    return ledger.check_judgments(j, docs.select(F.col("doc_id").alias("item_id")), artifacts).select("doc_id", F.coalesce("reason", F.lit("-")).alias("reason"))


def audited(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    it = items(spark, sf_dir).select("item_id", F.concat(F.lit("u"), (F.col("item_id") % 9000).cast("string")).alias("canonical_url"), F.when(F.col("item_id") % 100 == 3, "lost").otherwise(F.col("work_state")).alias("work_state"), F.when(F.col("item_id") % 50 != 1, F.col("lease_id")).alias("lease_id"))
    sources = pages.select((F.col("page_id") * 50).alias("item_id"), F.when(F.col("page_id") % 20 == 0, "rumour").otherwise("seed").alias("source_kind"), F.lit("x").alias("source_value")).unionByName(pages.select((F.col("page_id") - F.col("page_id") % 25).alias("item_id"), F.lit("seed").alias("source_kind"), F.lit("y").alias("source_value")))
    j = judgments(spark, sf_dir).select("item_id", "label", F.when(F.col("worker_id") == "toxic", F.lit(0.5)).alias("confidence"), F.when(F.col("item_id") % 2 == 0, "n").alias("note"))
    return ledger.audit_constraints(it, sources, j, attempts(spark, sf_dir)).groupBy("table_name", "rule").agg(F.count(F.lit(1)).alias("n"))


def order_snapshot(spark, sf_dir):
    from loomledger.operators import recon

    o = table(spark, sf_dir, "orders")
    before = o.where("o_orderdate < '1998-01-01'").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_totalprice").alias("lastmod"))
    after = o.where("o_orderdate >= '1995-01-01'").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_totalprice").alias("lastmod"))
    return recon.snapshot_diff(before, after).select("key", "change")


QUERIES = {
    "ag01_state_counts": state_counts,
    "ag02_status": status,
    "ag03_top_errors": top_errors,
    "ag04_top_warnings": top_warnings,
    "ag05_artifact_totals": artifact_totals,
    "ag06_conflicts": conflicts,
    "ag07_judgment_counts": judgment_counts,
    "ag08_reject_summary": reject_summary,
    "ag09_ledger_rows": ledger_rows,
    "fl01_filtered_ledger": filtered_ledger,
    "ag10_domain_states": domain_states,
    "ag13_folder_map": folder_map,
    "ag23_revision_stats": revision_stats,
    "ag24_speaker_counts": speaker_counts,
    "ag25_lease_health": lease_health,
    "ag25_lease_overlaps": lease_overlaps,
    "ag27_attempts_per_item": attempts_per_item,
    "ag27_retry_history": retry_history,
    "sk04_run_manifests": run_manifests,
    "ag16_coverage": coverage,
    "ag29_presence_matrix": presence_matrix,
    "ag30_inventory": inventory,
    "tk07_fit_budget": fit_budget,
    "tk08_list_notes": list_notes,
    "wn02_latest_per": latest_per,
    "wn04_series_novelty": series_novelty,
    "wn04_series_dryness": series_dryness,
    "wn07_pace_schedule": pace_schedule,
    "wn08_backoff": backoff,
    "wn15_daily_cap": daily_cap,
    "wn16_block_sleep": block_sleep,
    "wn11_overlay": overlay,
    "wn12_revisions": revisions,
    "wn13_last_user_line": last_user_line,
    "sm07_retained": retained,
    "jn17_eligible_tasks": eligible_tasks,
    "jn17_blocked_tasks": blocked_tasks,
    "tk04_next_tasks": next_tasks,
    "ag21_group_dashboard": group_dashboard,
    "ag22_campaign_summary": campaign_summary,
    "fl07_filtered_groups": filtered_groups,
    "fl07_campaign_groups": campaign_groups,
    "jn02_existing": existing_items,
    "lt01_reclaimed": reclaimed,
    "lt03_retried": retried,
    "lt04_applied_results": applied_results,
    "lt05_finished_attempts": finished_attempts,
    "val02_judgment_reasons": judgment_reasons,
    "val01_audited": audited,
    "jn09_order_snapshot": order_snapshot,
}

_STATES = ", ".join(f"count(*) FILTER (work_state = '{s}') AS {s}" for s in ledger.WORK_STATES)
_TASK_NEEDS = f"""t AS ({TASKS_SQL}), u AS (SELECT p.group_id, p.number, list_sort(list(p.need) FILTER (p.need IS NOT NULL AND c.number IS NULL)) AS unresolved
  FROM (SELECT group_id, number, CASE WHEN len(depends_on) > 0 THEN depends_on[1] END AS need FROM t WHERE status = 'pending') p LEFT JOIN (SELECT group_id, number FROM t WHERE status = 'completed') c ON p.group_id = c.group_id AND p.need = c.number GROUP BY p.group_id, p.number)"""
_DASH = f"""t AS ({TASKS_SQL}), d AS (SELECT o_orderkey AS group_id, o_custkey AS campaign, coalesce(done, 0) AS done, coalesce(total, 0) AS total, next_open FROM orders LEFT JOIN (
  SELECT group_id, count(*) FILTER (status = 'completed') AS done, count(*) AS total, min(number) FILTER (status <> 'completed') AS next_open FROM t GROUP BY group_id) ON o_orderkey = group_id)"""
_NOVEL = f"""o AS ({_OBSERVED_SQL}), e AS (SELECT series, idx, unnest(emitted) AS id FROM o WHERE NOT unknown), f AS (SELECT series, id, min(idx) AS idx FROM e GROUP BY series, id),
  n AS (SELECT o.series, o.idx, o.unknown, CASE WHEN NOT o.unknown THEN coalesce(c, 0) END AS novelty FROM o LEFT JOIN (SELECT series, idx, count(*) AS c FROM f GROUP BY 1, 2) g ON o.series = g.series AND o.idx = g.idx)"""
_YES = "CASE WHEN label IS NULL AND worker_id = 'toxic' THEN 'no' ELSE label END"

ORACLE = {
    "ag01_state_counts": f"SELECT count(*) AS total, {_STATES}, count(*) FILTER (work_state IS NULL OR work_state = 'lost') AS other FROM (SELECT CASE WHEN item_id % 97 = 5 THEN 'lost' WHEN item_id % 89 <> 3 THEN work_state END AS work_state FROM ({ITEMS_SQL}))",
    "ag02_status": f"""SELECT i.*, a.*, queued = 0 AND leased = 0 AS workspace_drained FROM (SELECT count(*) AS total, {_STATES}, count(*) FILTER (work_state = 'leased' AND collected_at IS NOT NULL) AS awaiting_report,
        count(*) FILTER (review_required) AS review_required, count(*) FILTER (work_state = 'leased' AND lease_expires_at <= {_NOW_SQL}) AS expired_leases FROM ({ITEMS_SQL})) i,
        (SELECT count(*) AS files, round(sum(value), 2) AS bytes FROM events) a""",
    "ag03_top_errors": f"SELECT coalesce(error_stage, 'unknown') AS error_stage, coalesce(error_code, 'unknown') AS error_code, count(*) AS n, arg_max(attempt_id, (started_at, attempt_id)) AS sample FROM ({ATTEMPTS_SQL}) WHERE result = 'failed' GROUP BY 1, 2 ORDER BY n DESC, error_code, error_stage LIMIT 5",
    "ag04_top_warnings": f"SELECT warning, count(*) AS n FROM (SELECT unnest(warning_codes) AS warning FROM ({ATTEMPTS_SQL})) GROUP BY warning ORDER BY n DESC, warning LIMIT 5",
    "ag05_artifact_totals": "SELECT coalesce(l_returnflag, 'all') AS kind, count(*) AS files, round(sum(l_quantity), 2) AS bytes FROM lineitem GROUP BY ROLLUP (l_returnflag)",
    "ag06_conflicts": f"SELECT item_id, count(DISTINCT l) AS labels FROM (SELECT item_id, {_YES} AS l FROM ({JUDGMENTS_SQL})) WHERE l IS NOT NULL GROUP BY item_id HAVING count(DISTINCT l) > 1",
    "ag07_judgment_counts": f"""WITH j AS (SELECT item_id, CASE WHEN label IS NULL AND worker_id = 'toxic' AND item_id % 3 <> 0 THEN 'no' ELSE label END AS label FROM ({JUDGMENTS_SQL}))
        SELECT count(*) AS total, count(label) AS labelled, count(*) - count(label) AS abstained, count(DISTINCT item_id) AS items_judged, (SELECT count(*) FROM (SELECT item_id FROM j GROUP BY item_id HAVING count(DISTINCT label) > 1)) AS conflicts FROM j""",
    "ag08_reject_summary": "SELECT reason, count(*) AS n, min(event_id) AS first_line FROM (SELECT event_id, 'bad value N in ' || event_type || ' of N' AS reason FROM events WHERE event_type IN ('error', 'signup')) GROUP BY reason ORDER BY n DESC, reason LIMIT 5",
    "ag09_ledger_rows": f"""WITH s AS (SELECT doc_id AS item_id, unnest([CASE WHEN lang = 'en' THEN 'seed' ELSE 'import' END, 'internal_link']) AS k, unnest([source, lang]) AS v FROM documents),
        ss AS (SELECT item_id, array_to_string(list_sort(list_distinct(list(k))), ',') AS source_kinds, array_to_string(list_sort(list_distinct(list(k || ':' || v))), ',') AS sources FROM s GROUP BY item_id),
        a AS (SELECT *, attempt_id::VARCHAR AS aid FROM ({ATTEMPTS_SQL})),
        aa AS (SELECT item_id, array_to_string(list_sort(list_distinct(flatten(list(warning_codes)))), ',') AS w, array_to_string(list_sort(list_distinct(list(error_code) FILTER (error_code IS NOT NULL))), ',') AS e, count(*) AS n, array_to_string(list_sort(list(aid)), ',') AS ids,
          array_to_string(list_sort(list('artifacts/pages/' || item_id || '/' || aid || '/manifest.json') FILTER (attempt_id % 4 <> 0)), ',') AS m, array_to_string(list_sort(list('artifacts/' || aid) FILTER (attempt_id % 3 = 0)), ',') AS f FROM a GROUP BY item_id),
        jj AS (SELECT item_id, array_to_string(list_sort(list_distinct(list(label) FILTER (label IS NOT NULL))), ',') AS l, count(*) AS j FROM ({JUDGMENTS_SQL}) GROUP BY item_id)
        SELECT ss.item_id, source_kinds, sources, coalesce(l, '') AS labels, coalesce(w, '') AS warnings, coalesce(e, '') AS errors, coalesce(ids, '') AS attempt_ids, coalesce(m, '') AS manifest_paths, coalesce(f, '') AS artifact_paths, coalesce(j, 0) AS judgments, coalesce(n, 0) AS attempts
        FROM ss LEFT JOIN jj ON ss.item_id = jj.item_id LEFT JOIN aa ON ss.item_id = aa.item_id""",
    "fl01_filtered_ledger": f"""SELECT i.item_id, work_state FROM ({ITEMS_SQL}) i WHERE work_state IN ('queued', 'leased') AND i.item_id IN (SELECT item_id FROM ({JUDGMENTS_SQL}) WHERE label = 'yes')
        AND i.item_id IN (SELECT attempt_id FROM ({ATTEMPTS_SQL}) WHERE list_has_any(warning_codes, ['redirected', 'thin_text']))""",
    "ag10_domain_states": f"SELECT domain, {_STATES} FROM ({ITEMS_SQL}) GROUP BY domain",
    "ag13_folder_map": """WITH d AS (SELECT 'corpus/' || source || '/' || lang AS own, len(string_split(text, chr(10))) AS lines, n_chars, doc_id, CASE WHEN doc_id % 50 = 7 THEN string_split(text, chr(10))[1] END AS title FROM documents),
        f AS (SELECT *, unnest(['corpus', regexp_extract(own, '^corpus/[^/]*'), own]) AS folder FROM d), g AS (SELECT folder, count(*) AS documents, sum(lines)::BIGINT AS lines, sum(n_chars)::BIGINT AS chars, max(doc_id) AS newest, min(title) FILTER (own = folder) AS readme_title FROM f GROUP BY folder)
        SELECT g.*, (SELECT count(*) FROM g c WHERE regexp_replace(c.folder, '/?[^/]*$', '') = g.folder) AS subfolders, len(string_split(folder, '/'))::INTEGER AS depth FROM g""",
    "ag23_revision_stats": "SELECT o_custkey, max(o_orderdate) AS last_revision, count(*) AS revisions FROM orders GROUP BY o_custkey",
    "ag24_speaker_counts": "SELECT role, count(*) AS n FROM conversations WHERE turn + 1 BETWEEN 2 AND 5 GROUP BY role",
    "ag25_lease_health": f"SELECT count(*) FILTER (lease_expires_at <= {_NOW_SQL}) AS expired, count(*) FILTER (lease_expires_at > {_NOW_SQL} AND lease_expires_at <= {_NOW_SQL} + INTERVAL 1 DAY) AS expiring, count(DISTINCT lease_id) FILTER (lease_expires_at > {_NOW_SQL}) AS active_leases FROM ({ITEMS_SQL}) WHERE work_state = 'leased'",
    "ag25_lease_overlaps": f"SELECT domain, count(DISTINCT lease_id) AS leases FROM ({ITEMS_SQL}) GROUP BY domain HAVING count(DISTINCT lease_id) > 1",
    "ag27_attempts_per_item": "SELECT n AS attempts, count(*) AS items FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) GROUP BY n",
    "ag27_retry_history": "SELECT user_id AS item_id, count(*) AS retries, epoch_us(max(ts)) AS last_retry FROM events WHERE event_type = 'error' GROUP BY user_id",
    "sk04_run_manifests": f"""WITH a AS (SELECT attempt_id, list_filter(['html', 'images', 'links', 'text'], lambda x: length(x) % 5 <= k % 5) AS r, list_filter(['html', 'images', 'links', 'text'], lambda x: (length(x) + k) % 3 = 0) AS p FROM ({ATTEMPTS_SQL}))
        SELECT attempt_id, CAST(len(p) AS BIGINT) AS files, array_to_string(r, ',') AS requested, array_to_string(p, ',') AS produced, array_to_string(list_filter(r, lambda x: NOT list_contains(p, x)), ',') AS missing,
          array_to_string(list_filter(p, lambda x: NOT list_contains(r, x)), ',') AS extra, array_to_string(list_filter(r, lambda x: list_contains(p, x)), ',') AS kept FROM a""",
    "ag16_coverage": """WITH f AS (SELECT DISTINCT n_regionkey AS axis, n_name AS value FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 5000)
        SELECT n_regionkey AS axis, string_agg(n_name, ',' ORDER BY n_name) AS targets, coalesce(string_agg(f.value, ',' ORDER BY f.value), '') AS found, coalesce(string_agg(CASE WHEN f.value IS NULL THEN n_name END, ',' ORDER BY n_name), '') AS blanks
        FROM nation LEFT JOIN f ON n_regionkey = f.axis AND n_name = f.value GROUP BY n_regionkey""",
    "ag29_presence_matrix": """WITH s AS (SELECT DISTINCT r_name AS env, n_name AS k, s_acctbal > 3000 AS plain FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
        SELECT r_name AS env, n_name AS key, 'app' AS app, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.env = r_name AND s.k = n_name AND NOT plain) THEN 'filled_by_scope' WHEN EXISTS (SELECT 1 FROM s WHERE s.env = r_name AND s.k = n_name AND plain) THEN 'filled'
          WHEN n_nationkey % 2 = 0 THEN 'empty_required' ELSE 'empty_optional' END AS presence FROM nation, region""",
    "ag30_inventory": "SELECT o_orderpriority, count(*) AS items, count(*) FILTER (strftime(o_orderdate, '%Y-%m') < '1997-06') AS untidied, count(*) FILTER (o_custkey % 3 = 0) AS index_missing, count(*) FILTER (o_orderkey % 100 = 1) AS index_stale FROM orders GROUP BY 1",
    "tk07_fit_budget": f"""SELECT attempt_id, item_id, CAST(used AS BIGINT) AS used, dropped FROM (SELECT *, count(*) FILTER (used > 1500) OVER (PARTITION BY item_id) AS dropped FROM (
        SELECT attempt_id, item_id, sum(k + 20) OVER (PARTITION BY item_id ORDER BY attempt_id ROWS UNBOUNDED PRECEDING) AS used FROM ({ATTEMPTS_SQL}))) WHERE used <= 1500""",
    "tk08_list_notes": "SELECT doc_id, kind, CAST(r AS INTEGER) AS rank FROM (SELECT doc_id, kind, row_number() OVER (PARTITION BY kind ORDER BY n_chars DESC, doc_id DESC) AS r FROM (SELECT *, CASE WHEN lang = 'en' THEN 'date' ELSE lang END AS kind FROM documents)) WHERE kind <> 'date' OR r <= 30",
    "wn02_latest_per": f"SELECT item_id, arg_max(attempt_id, (started_at, attempt_id)) AS attempt_id, arg_max(result, (started_at, attempt_id)) AS result FROM ({ATTEMPTS_SQL}) GROUP BY item_id",
    "wn04_series_novelty": f"WITH {_NOVEL} SELECT series, idx AS page, coalesce(novelty, -1) AS novelty FROM n",
    "wn04_series_dryness": f"""WITH RECURSIVE {_NOVEL}, p AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY idx) AS r FROM n),
        w AS (SELECT series, r, idx, unknown, CASE WHEN novelty = 0 THEN 1 ELSE 0 END AS streak, CASE WHEN novelty = 0 THEN 1 ELSE 0 END AS best, CASE WHEN novelty = 0 THEN idx END AS since, 0 AS gaps FROM p WHERE r = 1
          UNION ALL SELECT p.series, p.r, p.idx, p.unknown, CASE WHEN p.novelty = 0 THEN CASE WHEN p.idx = w.idx + 1 THEN w.streak ELSE 0 END + 1 ELSE 0 END,
            greatest(w.best, CASE WHEN p.novelty = 0 THEN CASE WHEN p.idx = w.idx + 1 THEN w.streak ELSE 0 END + 1 ELSE 0 END),
            CASE WHEN p.novelty = 0 THEN CASE WHEN p.idx = w.idx + 1 AND w.streak > 0 THEN w.since ELSE p.idx END END, w.gaps + CASE WHEN p.idx = w.idx + 1 THEN 0 ELSE 1 END FROM w JOIN p ON p.series = w.series AND p.r = w.r + 1)
        SELECT w.series, c.pages, coalesce(u.n, 0) AS unique_details, CAST(streak AS BIGINT) AS dry_streak, CAST(best AS BIGINT) AS longest_dry_streak, streak >= 3 AS dry, CASE WHEN streak >= 3 THEN since ELSE -1 END AS dry_from, CAST(gaps AS BIGINT) AS gaps, c.unknown_pages
        FROM w JOIN (SELECT series, count(*) AS pages, count(*) FILTER (unknown) AS unknown_pages FROM n GROUP BY series) c ON w.series = c.series AND w.r = c.pages LEFT JOIN (SELECT series, count(DISTINCT id) AS n FROM e GROUP BY series) u ON w.series = u.series""",
    "wn07_pace_schedule": f"""WITH RECURSIVE r AS (SELECT attempt_id, item_id, epoch_us(started_at) // 1000 AS now_ms, 600000 + attempt_id * 37 % 90000 AS gap, row_number() OVER (PARTITION BY item_id ORDER BY attempt_id) AS slot FROM ({ATTEMPTS_SQL})),
        w AS (SELECT attempt_id, item_id, slot, now_ms, gap, now_ms AS allowed FROM r WHERE slot = 1 UNION ALL SELECT r.attempt_id, r.item_id, r.slot, r.now_ms, r.gap, greatest(r.now_ms, w.allowed + w.gap) FROM w JOIN r ON r.item_id = w.item_id AND r.slot = w.slot + 1)
        SELECT attempt_id, CAST(slot AS INTEGER) AS slot, allowed AS allowed_at, allowed - now_ms AS wait_ms FROM w""",
    "wn08_backoff": f"""WITH r AS (SELECT attempt_id, item_id, result <> 'success' OR k % 2 = 0 AS bad FROM ({ATTEMPTS_SQL})), i AS (SELECT *, count(*) FILTER (NOT bad) OVER (PARTITION BY item_id ORDER BY attempt_id) AS island FROM r),
        f AS (SELECT *, count(*) FILTER (bad) OVER (PARTITION BY item_id, island ORDER BY attempt_id) AS failures FROM i)
        SELECT attempt_id, failures, CASE WHEN bad THEN CAST(least(300000, 1000 * pow(2, least(failures - 1, 40))) AS BIGINT) END AS backoff_ms FROM f""",
    "wn15_daily_cap": f"SELECT attempt_id, r <= 3 AS allowed, CASE WHEN r > 3 THEN CAST(epoch(date_trunc('day', started_at) + INTERVAL 1 DAY) AS BIGINT) - CAST(floor(epoch(started_at)) AS BIGINT) END AS wait_s FROM (SELECT *, row_number() OVER (PARTITION BY item_id, CAST(started_at AS DATE) ORDER BY attempt_id) AS r FROM ({ATTEMPTS_SQL}))",
    "wn16_block_sleep": "SELECT event_id AS attempt_id, CAST(b AS INTEGER) AS blocks, CASE WHEN b % 3 = 0 THEN CAST(floor(epoch(ts)) AS BIGINT) + 3600 END AS sleep_until FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events WHERE event_type = 'error')",
    "wn11_overlay": "SELECT coalesce(s.k, c.k) AS name, CAST(CASE WHEN s.k IS NOT NULL THEN 2 ELSE 1 END AS INTEGER) AS layer, coalesce(s.id, c.id) AS id FROM (SELECT c_nationkey AS k, min(c_custkey) AS id FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, min(s_suppkey) AS id FROM supplier WHERE s_acctbal > 9000 GROUP BY 1) s ON c.k = s.k",
    "wn12_revisions": """SELECT o_custkey, o_orderkey, CAST(r AS INTEGER) AS revision, total, strftime(f, '%Y-%m-%d') AS first_date, strftime(l, '%Y-%m-%d') AS last_date FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r,
        count(*) OVER (PARTITION BY o_custkey) AS total, min(o_orderdate) OVER (PARTITION BY o_custkey) AS f, max(o_orderdate) OVER (PARTITION BY o_custkey) AS l FROM orders) WHERE r > total - 5""",
    "wn13_last_user_line": "SELECT conv_id, max(turn) + 1 AS line, sha256(arg_max(text, turn)) AS text_hash FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY conv_id",
    "sm07_retained": "SELECT user_id AS item_id, event_id AS attempt_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 200",
    "jn17_eligible_tasks": f"WITH {_TASK_NEEDS} SELECT t.group_id, CAST(t.number AS INTEGER) AS number, t.priority FROM t JOIN u ON t.group_id = u.group_id AND t.number = u.number WHERE coalesce(len(unresolved), 0) = 0",
    "jn17_blocked_tasks": f"WITH {_TASK_NEEDS} SELECT group_id, CAST(number AS INTEGER) AS number, array_to_string(unresolved, ',') AS unresolved FROM u WHERE len(unresolved) > 0",
    "tk04_next_tasks": f"WITH {_TASK_NEEDS} SELECT group_id, CAST(number AS INTEGER) AS number, priority FROM (SELECT t.*, row_number() OVER (PARTITION BY t.group_id ORDER BY priority DESC, t.number) AS r FROM t JOIN u ON t.group_id = u.group_id AND t.number = u.number WHERE coalesce(len(unresolved), 0) = 0) WHERE r = 1",
    "ag21_group_dashboard": f"WITH {_DASH} SELECT d.group_id, done, total, CAST(next_open AS INTEGER) AS next_open, coalesce(e.n, 0) AS notes, coalesce(l.n, 0) AS plans FROM d LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) e ON user_id = group_id LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON l_orderkey = group_id",
    "ag22_campaign_summary": f"WITH {_DASH} SELECT campaign, count(*) AS groups, CAST(sum(total - done) AS BIGINT) AS open_tasks, CAST(sum(total) AS BIGINT) AS total_tasks, count(*) FILTER (total = 0 OR done = total) AS hidden_groups FROM d GROUP BY campaign",
    "fl07_filtered_groups": f"WITH {_DASH} SELECT group_id, campaign FROM d WHERE total > done AND group_id IN (SELECT group_id FROM t WHERE priority > 40 AND status <> 'completed')",
    "fl07_campaign_groups": f"WITH {_DASH} SELECT group_id, done, total FROM d WHERE (total = 0 OR total > done) AND campaign = 7",
    "jn02_existing": "SELECT c_mktsegment, count(*) AS n, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'exists' ELSE 'not_exists' END AS side FROM customer GROUP BY ALL",
    "lt01_reclaimed": f"SELECT item_id, CASE WHEN x THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'queued' END ELSE work_state END AS work_state, CASE WHEN x THEN '-' ELSE coalesce(lease_id, '-') END AS lease_id FROM (SELECT *, coalesce(work_state = 'leased' AND lease_expires_at <= {_NOW_SQL}, false) AS x FROM ({ITEMS_SQL}))",
    "lt03_retried": f"SELECT a.i AS item_id, CASE WHEN work_state IS NULL THEN 'item_not_here' WHEN work_state IN ('done', 'failed') THEN 'requeued' ELSE 'is_' || work_state END AS outcome FROM (SELECT DISTINCT attempt_id + 5 AS i FROM ({ATTEMPTS_SQL}) WHERE k % 5 = 0) a LEFT JOIN ({ITEMS_SQL}) b ON a.i = b.item_id",
    "lt04_applied_results": f"""WITH r AS (SELECT attempt_id % 5000 AS i, arg_max(result, started_at) AS result FROM ({ATTEMPTS_SQL}) GROUP BY 1)
        SELECT item_id, CASE WHEN work_state = 'leased' AND result = 'failed' THEN 'failed' ELSE work_state END AS work_state, CASE WHEN work_state = 'leased' AND result = 'failed' THEN '-' ELSE coalesce(lease_id, '-') END AS lease_id FROM ({ITEMS_SQL}) LEFT JOIN r ON item_id = i""",
    "lt05_finished_attempts": f"""WITH a AS ({ATTEMPTS_SQL}), r AS (SELECT attempt_id - attempt_id % 2 AS i, result, error_stage, error_code, row_number() OVER (PARTITION BY attempt_id - attempt_id % 2 ORDER BY started_at, result) AS n FROM a)
        SELECT why, count(*) AS n FROM (SELECT CASE WHEN a.k % 9 = 0 OR r.n > 1 THEN 'already_finished' WHEN r.result = 'failed' AND (r.error_stage IS NULL OR r.error_code IS NULL) THEN 'failure_needs_stage_and_code' END AS why FROM r JOIN a ON r.i = a.attempt_id) WHERE why IS NOT NULL GROUP BY why""",
    "val02_judgment_reasons": """WITH m AS (SELECT max(doc_id) AS m FROM documents), j AS (SELECT doc_id, doc_id * 2 AS i, CASE WHEN doc_id % 5 = 0 THEN ' ' WHEN toxic = 1 THEN 'bad' WHEN quality = 1 THEN 'good' END AS label, CASE WHEN doc_id % 7 = 0 THEN 1.5 WHEN doc_id % 3 = 0 THEN 0.5 END AS c, doc_id % 4 = 0 AS noted FROM labels)
        SELECT doc_id, CASE WHEN doc_id % 37 = 6 THEN 'json_parse' WHEN doc_id % 31 = 5 THEN 'missing_field:note' WHEN doc_id % 29 = 4 THEN 'item_id_type' WHEN i > m THEN 'item_not_here' WHEN doc_id % 13 = 1 THEN 'label_type' WHEN label = ' ' THEN 'label_blank' WHEN doc_id % 19 = 2 THEN 'confidence_type'
          WHEN c > 1 THEN 'confidence_range' WHEN c IS NOT NULL AND label IS NULL THEN 'confidence_without_label' WHEN doc_id % 23 = 3 THEN 'note_type' WHEN label IS NULL AND NOT noted THEN 'abstain_needs_note'
          WHEN doc_id % 11 = 0 THEN 'evidence_type' WHEN i % 17 = 0 THEN 'evidence_size_mismatch' WHEN doc_id + 1 > m THEN 'evidence_not_found' WHEN (doc_id + 1) % 17 = 0 THEN 'evidence_size_mismatch' WHEN doc_id + 1 <> i THEN 'evidence_other_item' ELSE '-' END AS reason FROM j, m""",
    "val01_audited": f"""WITH i AS (SELECT item_id, 'u' || (item_id % 9000) AS u, CASE WHEN item_id % 100 = 3 THEN 'lost' ELSE work_state END AS s, CASE WHEN item_id % 50 <> 1 THEN lease_id END AS l FROM ({ITEMS_SQL})),
        q AS (SELECT page_id * 50 AS item_id, CASE WHEN page_id % 20 = 0 THEN 'rumour' ELSE 'seed' END AS k, 'x' AS v FROM pages UNION ALL SELECT page_id - page_id % 25, 'seed', 'y' FROM pages),
        j AS (SELECT item_id, label, CASE WHEN worker_id = 'toxic' THEN 0.5 END AS c, item_id % 2 = 0 AS noted FROM ({JUDGMENTS_SQL})),
        v AS (SELECT 'items' AS table_name, 'unique_canonical_url' AS rule, count(*) AS n FROM (SELECT u FROM i GROUP BY u HAVING count(*) > 1) UNION ALL SELECT 'items', 'work_state', count(*) FROM i WHERE s = 'lost'
          UNION ALL SELECT 'items', 'lease_matches_state', count(*) FROM i WHERE (s = 'leased') <> (l IS NOT NULL) UNION ALL SELECT 'sources', 'unique_source', count(*) FROM (SELECT 1 FROM q GROUP BY item_id, k, v HAVING count(*) > 1)
          UNION ALL SELECT 'sources', 'source_kind', count(*) FROM q WHERE k = 'rumour' UNION ALL SELECT 'sources', 'item_exists', count(DISTINCT item_id) FROM q WHERE item_id NOT IN (SELECT item_id FROM i)
          UNION ALL SELECT 'attempts', 'item_exists', count(DISTINCT user_id) FROM events WHERE user_id NOT IN (SELECT item_id FROM i) UNION ALL SELECT 'judgments', 'item_exists', count(DISTINCT item_id) FROM j WHERE item_id NOT IN (SELECT item_id FROM i)
          UNION ALL SELECT 'judgments', 'confidence_without_label', count(*) FROM j WHERE c IS NOT NULL AND label IS NULL UNION ALL SELECT 'judgments', 'abstain_needs_note', count(*) FROM j WHERE label IS NULL AND NOT noted)
        SELECT table_name, rule, n FROM v WHERE n > 0""",
    "jn09_order_snapshot": """WITH b AS (SELECT o_custkey AS key, max(o_totalprice) AS m FROM orders WHERE o_orderdate < DATE '1998-01-01' GROUP BY 1), a AS (SELECT o_custkey AS key, max(o_totalprice) AS m FROM orders WHERE o_orderdate >= DATE '1995-01-01' GROUP BY 1)
        SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'new' WHEN a.key IS NULL THEN 'disappeared' WHEN a.m IS DISTINCT FROM b.m THEN 'changed' ELSE 'unchanged' END AS change FROM a FULL JOIN b ON a.key = b.key""",
}

