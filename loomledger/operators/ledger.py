"""Ledger operators: adding URLs, filters, audits, judgments, leases, reports, retries, admission and export rows.

Plain Parquet has no row-level merge, so transitions return the new table (or its changed rows) and leave writing to the
caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomledger.sources.tables import checkpointed

# The ledger's enumerations.
WORK_STATES = ("queued", "leased", "done", "failed")
SOURCE_KINDS = ("seed", "search", "sitemap", "robots", "internal_link", "import")
EXPORT_FIELDS = ("canonical_url", "domain", "work_state", "source_kinds", "sources", "labels", "judgments", "warnings", "errors", "attempts", "paths")


def add_urls(items: DataFrame, sources: DataFrame, records: DataFrame, kind: str, value: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, sources, counts) after adding canonicalised records (canonical_url, domain, reject).

    A new address is inserted once, known ones count as duplicates, and each address gets a provenance row unless the same
    triple is there."""
    if kind not in SOURCE_KINDS:
        raise ValueError(f"unknown source kind: {kind}")
    good = records.where("reject is null")
    fresh = good.groupBy("canonical_url").agg(F.min("domain").alias("domain")).join(items.select("canonical_url"), "canonical_url", "left_anti")
    triples = good.select("canonical_url", F.lit(kind).alias("source_kind"), F.lit(value).alias("source_value")).distinct()
    new_sources = triples.join(sources, ["canonical_url", "source_kind", "source_value"], "left_anti")
    # The counts take one pass over the records and one shuffle: rejects have no canonical address.
    had = sources.where((F.col("source_kind") == kind) & (F.col("source_value") == value)).select("canonical_url", F.lit(True).alias("_had")).distinct()
    met = records.groupBy(F.when(F.col("reject").isNull(), F.col("canonical_url")).alias("canonical_url")).agg(F.count(F.lit(1)).alias("_n"))
    met = met.join(items.select("canonical_url", F.lit(True).alias("_known")).distinct(), "canonical_url", "left").join(had, "canonical_url", "left")
    good_url = F.col("canonical_url").isNotNull()
    counts = met.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("received"),
        F.count_if(good_url & F.col("_known").isNull()).alias("added"),
        F.coalesce(F.sum(F.when(~good_url, F.col("_n"))), F.lit(0)).alias("rejected"),
        F.count_if(good_url & F.col("_had").isNull()).alias("sources_added"),
    ).select("received", "added", (F.col("received") - F.col("rejected") - F.col("added")).alias("duplicates"), "rejected", "sources_added")
    return items.unionByName(fresh, allowMissingColumns=True), sources.unionByName(new_sources), counts


def validate_filters(state: str | None = None, source: str | None = None, fields: list[str] | None = None) -> None:
    """Unknown states, source kinds or fields are an error, not an empty result."""
    for value in (state or "").split(",") if state else ():
        if value.strip() not in WORK_STATES:
            raise ValueError(f"unknown state: {value.strip()}")
    if source and source.partition(":")[0] not in SOURCE_KINDS:
        raise ValueError(f"unknown source kind: {source.partition(':')[0]}")
    for field in fields or ():
        if field not in EXPORT_FIELDS:
            raise ValueError(f"unknown field: {field}")


def filter_ledger(
    items: DataFrame,
    sources: DataFrame | None = None,
    judgments: DataFrame | None = None,
    attempts: DataFrame | None = None,
    state: str | None = None,
    domain: str | None = None,
    label: str | None = None,
    source: str | None = None,
    warning: str | None = None,
) -> DataFrame:
    """Items that meet all conditions; state, domain and warning are comma lists, source is kind or kind:value."""
    validate_filters(state, source)
    listed = lambda text: [x.strip() for x in text.split(",") if x.strip()]
    out = items
    if state:
        out = out.where(F.col("work_state").isin(listed(state)))
    if domain:
        out = out.where(F.col("domain").isin(listed(domain)))
    if label:
        out = out.join(judgments.where(F.col("label") == label).select("item_id"), "item_id", "left_semi")
    if source:
        kind, _, value = source.partition(":")
        hits = sources.where(F.col("source_kind") == kind)
        out = out.join((hits.where(F.col("source_value") == value) if value else hits).select("item_id"), "item_id", "left_semi")
    if warning:
        hits = attempts.where(F.arrays_overlap("warning_codes", F.array(*map(F.lit, listed(warning)))))
        out = out.join(hits.select("item_id"), "item_id", "left_semi")
    return out


def filter_dates(df: DataFrame, column: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Rows between two bounds; a bound that is a date counts to its last millisecond. Rows without a date go once a bound is set."""
    out = df
    if first:
        out = out.where(F.col(column) >= F.lit(first).cast("timestamp"))
    if last:
        end = f"{last} 23:59:59.999" if len(last) == 10 else last
        out = out.where(F.col(column) <= F.lit(end).cast("timestamp"))
    return out


def filter_scope(df: DataFrame, path: str, scope: str) -> DataFrame:
    """Rows whose path is the scope or lies under it."""
    return df.where((F.col(path) == scope) | F.col(path).startswith(scope + "/"))


def audit_constraints(items: DataFrame, sources: DataFrame, judgments: DataFrame, attempts: DataFrame) -> DataFrame:
    """Violations (table, rule, key): uniqueness, references, enumerations and the checks of judgments."""

    def broken(df: DataFrame, table: str, rule: str, key: str, condition: Column) -> DataFrame:
        return df.where(F.coalesce(condition, F.lit(False))).select(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))

    def repeated(df: DataFrame, table: str, rule: str, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), F.concat_ws("|", *keys).alias("key"))

    def missing(df: DataFrame, table: str, rule: str, key: str, other: DataFrame) -> DataFrame:
        return df.where(F.col(key).isNotNull()).join(other.select(F.col("item_id").alias(key)), key, "left_anti").select(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key")).distinct()

    label, note = F.col("label"), F.coalesce(F.col("note"), F.lit(""))
    parts = [
        repeated(items, "items", "unique_canonical_url", "canonical_url"),
        broken(items, "items", "work_state", "item_id", ~F.col("work_state").isin(*WORK_STATES)),
        broken(items, "items", "lease_matches_state", "item_id", (F.col("work_state") == "leased") != F.col("lease_id").isNotNull()),
        repeated(sources, "sources", "unique_source", "item_id", "source_kind", "source_value"),
        broken(sources, "sources", "source_kind", "item_id", ~F.col("source_kind").isin(*SOURCE_KINDS)),
        missing(sources, "sources", "item_exists", "item_id", items),
        missing(attempts, "attempts", "item_exists", "item_id", items),
        missing(judgments, "judgments", "item_exists", "item_id", items),
        broken(judgments, "judgments", "label_not_blank", "item_id", label.isNotNull() & (F.trim(label) == "")),
        broken(judgments, "judgments", "confidence_without_label", "item_id", F.col("confidence").isNotNull() & label.isNull()),
        broken(judgments, "judgments", "confidence_range", "item_id", (F.col("confidence") < 0) | (F.col("confidence") > 1)),
        broken(judgments, "judgments", "abstain_needs_note", "item_id", label.isNull() & (F.trim(note) == "")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: Fields that every judgment has, in the order in which they are asked for.
JUDGMENT_FIELDS = ("item_id", "label", "confidence", "note", "evidence_artifact_ids")


def typed_judgments(raw: DataFrame, json: str = "json") -> DataFrame:
    """Add the fields of judgments written as JSON objects, and fault: the first field that is missing (missing_field:name) or of another type (item_id_type, label_type, confidence_type,
    note_type, evidence_type), by the order of the rules; null where all are there. An item_id may be a number in quotes."""
    v = F.try_parse_json(json)
    field = lambda name: F.try_variant_get(v, f"$.{name}", "variant")
    kind = {name: F.schema_of_variant(field(name)) for name in JUDGMENT_FIELDS}
    number = lambda name: F.coalesce(kind[name].rlike(r"^(BIGINT|DOUBLE|DECIMAL|INT|FLOAT)"), F.lit(False))
    null = lambda name: F.coalesce(kind[name] == "VOID", F.lit(True))
    text = lambda name: F.coalesce(kind[name] == "STRING", F.lit(False))
    fault = F.when(v.isNull(), "json_parse")
    for name in JUDGMENT_FIELDS:
        fault = fault.when(field(name).isNull(), f"missing_field:{name}")
    item = F.try_variant_get(v, "$.item_id", "string").try_cast("double")
    whole = item.isNotNull() & (item == F.floor(item))
    faults = fault.when(~whole | ~(number("item_id") | text("item_id")), "item_id_type").when(~null("label") & ~text("label"), "label_type").when(~null("confidence") & ~number("confidence"), "confidence_type").when(~null("note") & ~text("note"), "note_type").when(~F.coalesce(kind["evidence_artifact_ids"].startswith("ARRAY"), F.lit(False)), "evidence_type")
    return raw.withColumns({
        "fault": faults,
        "item_id": item.try_cast("long"),
        "label": F.when(text("label"), F.try_variant_get(v, "$.label", "string")),
        "confidence": F.when(number("confidence"), F.try_variant_get(v, "$.confidence", "double")),
        "note": F.when(text("note"), F.try_variant_get(v, "$.note", "string")),
        "evidence_artifact_ids": F.try_variant_get(v, "$.evidence_artifact_ids", "array<bigint>"),
    })


def check_judgments(judgments: DataFrame, items: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Add reason: the first rule a judgment breaks, in order, or null. judgments: item_id, label, confidence, note, evidence_artifact_ids, and fault where typed_judgments has found one.

    artifacts: artifact_id, item_id, state (ok, missing, size_mismatch, sha_mismatch) of the file behind it. A judgment is known by its own columns, so equal ones
    share a reason and no others do."""
    named = ["item_id", "evidence_artifact_ids"]
    asked = judgments.select(*named).where("evidence_artifact_ids is not null").distinct()
    evidence = asked.select(*named, F.posexplode("evidence_artifact_ids").alias("_at", "artifact_id"))
    files = artifacts.select("artifact_id", F.col("item_id").alias("_owner"), F.col("state").alias("_state"))
    wrong = (
        F.when(F.col("_state").isNull(), "evidence_not_found")
        .when(F.col("_state") != "ok", F.concat(F.lit("evidence_"), F.col("_state")))
        .when(F.col("_owner") != F.col("item_id"), "evidence_other_item")
    )
    faults = evidence.join(files, "artifact_id", "left").withColumn("_fault", wrong).where("_fault is not null").groupBy(*named).agg(F.min_by("_fault", "_at").alias("_fault"))
    faults = faults.select(F.col("item_id").alias("_i"), F.col("evidence_artifact_ids").alias("_e"), "_fault")
    known = items.select("item_id", F.lit(True).alias("_known")).distinct()
    label, confidence = F.col("label"), F.col("confidence")
    typed = F.col("fault") if "fault" in judgments.columns else F.lit(None).cast("string")
    early, late = typed.rlike("^(json_parse|missing_field|item_id_type)"), lambda name: typed == name
    reason = (
        F.when(early, typed)
        .when(F.col("item_id").isNull(), "item_id_type")
        .when(F.col("_known").isNull(), "item_not_here")
        .when(late("label_type"), "label_type")
        .when(label.isNotNull() & (F.trim(label) == ""), "label_blank")
        .when(late("confidence_type") | (confidence.isNotNull() & (F.isnan(confidence) | (F.abs(confidence) == float("inf")))), "confidence_type")
        .when((confidence < 0) | (confidence > 1), "confidence_range")
        .when(confidence.isNotNull() & label.isNull(), "confidence_without_label")
        .when(late("note_type"), "note_type")
        .when(label.isNull() & (F.trim(F.coalesce("note", F.lit(""))) == ""), "abstain_needs_note")
        .when(F.col("evidence_artifact_ids").isNull(), "evidence_type")
        .otherwise(F.col("_fault"))
    )
    out = judgments.join(known, "item_id", "left").join(faults, F.col("item_id").eqNullSafe(F.col("_i")) & (F.col("evidence_artifact_ids") == F.col("_e")), "left")
    return out.withColumn("reason", reason).select(*judgments.columns, "reason")


def reclaim(items: DataFrame, now: Column, most: int | None = None) -> DataFrame:
    """Leases that have run out go back to the queue; with most, an item leased so often fails for good."""
    over = (F.col("work_state") == "leased") & (F.col("lease_expires_at") <= now)
    state = F.when(F.col("attempts") >= most, "failed").otherwise("queued") if most is not None else F.lit("queued")
    over = F.coalesce(over, F.lit(False))
    return items.withColumns({"work_state": F.when(over, state).otherwise(F.col("work_state")), "lease_id": F.when(~over, F.col("lease_id")), "lease_expires_at": F.when(~over, F.col("lease_expires_at"))})


def apply_reports(items: DataFrame, attempts: DataFrame, reports: DataFrame, batch: DataFrame, lease_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, accepted, rejected) of a batch of judgments checked by check_judgments (column reason).

    The batch's key is a hash of its rows in any order: a key that reports (report_key) has already changes nothing."""
    body = batch.select(F.sha2(F.to_json(F.struct(*sorted(batch.columns))), 256).alias("h"))
    # Sums of the hashes' parts, which combine before the shuffle: no task sees all rows.
    parts = [F.sum(F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(38,0)")).cast("string") for at in (1, 16, 31, 46)]
    key = body.agg(F.sha2(F.concat_ws(",", F.count(F.lit(1)).cast("string"), *parts), 256).alias("report_key"))
    fresh = batch.crossJoin(key).join(reports.select("report_key"), "report_key", "left_anti")
    held = items.select("item_id", F.col("lease_id").alias("_lease"))
    collected = attempts.where("result <> 'failed'").select("item_id", F.lit(True).alias("_collected")).distinct()
    why = F.when(~F.coalesce(F.col("_lease") == lease_id, F.lit(False)), "not_in_this_lease").when(F.col("_collected").isNull(), "not_collected").otherwise(F.col("reason"))
    judged = fresh.join(held, "item_id", "left").join(collected, "item_id", "left").withColumn("why", why).drop("_lease", "_collected", "reason")
    accepted = judged.where("why is null").drop("why")
    done = accepted.select("item_id", F.lit(True).alias("_done")).distinct()
    after = items.join(done, "item_id", "left")
    ended = F.coalesce("_done", F.lit(False))
    after = after.withColumns({"work_state": F.when(ended, "done").otherwise(F.col("work_state")), "lease_id": F.when(~ended, F.col("lease_id"))}).drop("_done")
    return after, accepted, judged.where("why is not null")


def apply_retries(items: DataFrame, asked: DataFrame, reason: str) -> tuple[DataFrame, DataFrame]:
    """(items, outcome): done and failed items that are asked for go back to the queue; others are typed."""
    outcome = asked.select("item_id").distinct().join(items.select("item_id", F.col("work_state").alias("from_state")), "item_id", "left")
    kind = F.when(F.col("from_state").isNull(), "item_not_here").when(F.col("from_state").isin("done", "failed"), "requeued").otherwise(F.concat(F.lit("is_"), F.col("from_state")))
    outcome = outcome.withColumns({"outcome": kind, "reason": F.lit(reason)})
    again = outcome.where("outcome = 'requeued'").select("item_id", F.lit(True).alias("_again"))
    after = items.join(again, "item_id", "left")
    return after.withColumn("work_state", F.when(F.col("_again"), "queued").otherwise(F.col("work_state"))).drop("_again"), outcome


def apply_results(items: DataFrame, results: DataFrame) -> DataFrame:
    """The latest result of each leased item: a failure fails it and ends the lease; otherwise it stays leased and is collected. results: item_id, result, ended_at."""
    last = results.groupBy("item_id").agg(F.max_by("result", "ended_at").alias("_result"), F.max("ended_at").alias("_at"))
    out = items.join(last, "item_id", "left")
    leased = (F.col("work_state") == "leased") & F.col("_result").isNotNull()
    failed = leased & (F.col("_result") == "failed")
    return out.withColumns({"work_state": F.when(failed, "failed").otherwise(F.col("work_state")), "collected_at": F.when(leased & ~failed, F.col("_at")).otherwise(F.col("collected_at")), "lease_id": F.when(~failed, F.col("lease_id"))}).drop("_result", "_at")


def finish_attempts(attempts: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(attempts, rejects): an attempt is finished once, by its first result; a failure needs a stage and a code. results: attempt_id, result, error_stage, error_code, finished_at."""
    order = Window.partitionBy("attempt_id").orderBy("finished_at", "result")
    open_ = attempts.select("attempt_id", F.col("result").isNotNull().alias("_over"))
    judged = results.withColumn("_n", F.row_number().over(order)).join(open_, "attempt_id", "left")
    why = F.when(F.col("_over").isNull(), "unknown_attempt").when(F.col("_over") | (F.col("_n") > 1), "already_finished").when((F.col("result") == "failed") & (F.col("error_stage").isNull() | F.col("error_code").isNull()), "failure_needs_stage_and_code")
    judged = judged.withColumn("why", why).drop("_n", "_over")
    new = judged.where("why is null").select("attempt_id", *(F.col(c).alias(f"_{c}") for c in ("result", "error_stage", "error_code", "finished_at")))
    out = attempts.join(new, "attempt_id", "left")
    for c in ("result", "error_stage", "error_code", "finished_at"):
        out = out.withColumn(c, F.coalesce(c, f"_{c}")).drop(f"_{c}")
    return out, judged.where("why is not null")


def admit_capped(records: DataFrame, key: str, order: str, cap: int) -> DataFrame:
    """Add admitted: the first cap rows of each key, in order. Refused rows don't count, so the first rows are the accepted ones."""
    return records.withColumn("admitted", F.row_number().over(Window.partitionBy(key).orderBy(order)) <= cap)


def _admission(policy: dict, names: list[str]):
    """Decide rows that come sorted by domain, accepted rows first, then by line. The counters of one domain are all that is held."""
    import pyarrow as pa
    import pyarrow.compute as pc

    url_cap, shape_cap, combo_cap, facet_cap = (policy[c] for c in ("domain_url_cap", "path_shape_cap", "query_combo_cap", "faceted_cap"))

    def decide(batches):
        now, total, shapes, combos, faceted = None, 0, {}, {}, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            domains = batch.column("domain")
            place = domains.dictionary_encode().indices.to_pylist()
            cuts = [0, *(i for i in range(1, len(place)) if place[i] != place[i - 1]), len(place)]
            whys = []
            for low, high in zip(cuts, cuts[1:]):
                if low == 0 and now is not None and domains[0].as_py() == now[0]:
                    pass
                else:
                    now, total, shapes, combos, faceted = (domains[low].as_py(),), 0, {}, {}, 0
                run = batch.slice(low, high - low)
                if total >= url_cap and not pc.any(run.column("_before")).as_py():
                    # The domain is full: its other rows needn't be looked at.
                    whys.extend(["domain_url_cap"] * (high - low))
                    continue
                for before, shape, combo, facet in zip(*(run.column(c).to_pylist() for c in ("_before", "shape", "combo", "facet"))):
                    why = None
                    if not before:
                        if total >= url_cap:
                            why = "domain_url_cap"
                        elif shapes.get(shape, 0) >= shape_cap:
                            why = "path_shape_cap"
                        elif combo and combos.get(combo, 0) >= combo_cap:
                            why = "query_combo_cap"
                        elif facet is not None and faceted >= facet_cap:
                            why = "faceted_cap"
                    whys.append(why)
                    if why is None:
                        total += 1
                        shapes[shape] = shapes.get(shape, 0) + 1
                        if combo:
                            combos[combo] = combos.get(combo, 0) + 1
                        faceted += facet is not None
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(whys, pa.string())], names=[*names, "why"])
            yield out.filter(pc.invert(batch.column("_before")))

    return decide


def admit(records: DataFrame, policy: dict, accepted: DataFrame | None = None) -> DataFrame:
    """Admission in order of line under several caps that only accepted rows fill: adds why (null: admitted).

    records: line, canonical_url, domain, shape, combo, facet, hops, excluded (a reason, or null), with others that come along. policy:
    domain_url_cap, path_shape_cap, query_combo_cap, faceted_cap, external_hop_max, deny_domains. accepted: domain, shape, combo, facet of rows
    admitted before; they fill the caps.

    What needs no counter (denied domains, exclusions, hops) is decided row by row and isn't moved. The rest is sorted by domain and line and
    streams past the counters of its domain, so order is kept and a domain with most of the rows is never held; it is still one
    task's stream, since order decides. A null domain is a domain of its own."""
    domain = F.coalesce("domain", F.lit(""))
    denied = F.lit(False)
    for d in policy.get("deny_domains", ()):
        denied = denied | (domain == d) | domain.endswith("." + d)
    far = F.coalesce(F.col("hops") > policy.get("external_hop_max", 2), F.lit(False))
    settled = records.withColumn("why", F.when(denied, "denied_domain").when(F.col("excluded").isNotNull(), F.col("excluded")).when(far, "external_hop_exceeded"))
    open_ = settled.where("why is null").drop("why").withColumn("_before", F.lit(False))
    if accepted is not None:
        kinds = {f.name: f.dataType for f in records.schema}
        old = accepted.select(*((F.col(c) if c in ("domain", "shape", "combo", "facet") else F.lit(None)).cast(kinds[c]).alias(c) for c in records.columns), F.lit(True).alias("_before"))
        open_ = open_.unionByName(old)
    ordered = open_.repartition("domain").sortWithinPartitions("domain", F.desc("_before"), "line", "canonical_url")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema)
    judged = ordered.mapInArrow(_admission(policy, records.columns), schema + ", why string")
    return settled.where("why is not null").unionByName(judged)


def readmit(parked: DataFrame, accepted: DataFrame, policy: dict, urls: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(admitted, remaining) once caps are wider: oldest first, the accepted rows counted; remaining by domain with its most common reason and its oldest address.

    urls (canonical_url): rows that came in by another way meanwhile are no candidates any more."""
    if urls is not None:
        parked = parked.join(urls.select("canonical_url").distinct(), "canonical_url", "left_anti").select(parked.columns)
    judged = checkpointed(admit(parked, policy, accepted))
    remaining = judged.where("why is not null").groupBy("domain").agg(F.count(F.lit(1)).alias("remaining"), F.mode("why", True).alias("why"), F.min_by("canonical_url", F.struct("line", "canonical_url")).alias("sample"))
    return judged.where("why is null").drop("why"), remaining


def assign_batches(items: DataFrame, order: str, size: int) -> DataFrame:
    """Add batch_id and place: items in order of a column, cut into batches. No single task sees all rows: range partitions are numbered from their offsets."""
    spread = items.repartitionByRange(order).withColumn("_p", F.spark_partition_id())
    spread = checkpointed(spread).withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1)
    sizes = spread.groupBy("_p").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.withColumn("_one", F.lit(1)).withColumn("_before", F.coalesce(F.sum("_size").over(Window.partitionBy("_one").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    out = spread.join(offsets, "_p").withColumn("_at", F.col("_n") + F.col("_before"))
    return out.withColumns({"batch_id": F.floor(F.col("_at") / size), "place": F.col("_at") % size}).drop("_p", "_n", "_before", "_at")


def ledger_rows(items: DataFrame, sources: DataFrame, judgments: DataFrame, attempts: DataFrame, artifacts: DataFrame | None = None) -> DataFrame:
    """One row an item, as exports have it: source_kinds, sources (kind:value), labels (all, those that differ too), warnings, errors, attempt_ids, manifest_paths, artifact_paths, and the numbers of
    judgments and attempts. Arrays are sorted. sources: item_id, source_kind, and source_value where there is one; attempts: item_id, attempt_id, warning_codes, error_code, and
    operation where known (without it every run is a collection); artifacts: attempt_id, path.

    Kinds, codes and labels are made distinct before the exchange. Sources, runs and files are all in the row by its contract, so a row is as
    long as what its item has."""
    distinct = lambda df, column, name: df.where(F.col(column).isNotNull()).groupBy("item_id").agg(F.array_sort(F.collect_set(column)).alias(name))
    every = lambda df, column, name: df.where(F.col(column).isNotNull()).groupBy("item_id").agg(F.array_sort(F.collect_list(column)).alias(name))
    parts = [distinct(sources, "source_kind", "source_kinds"), distinct(judgments, "label", "labels"), judgments.groupBy("item_id").agg(F.count(F.lit(1)).alias("judgments"))]
    if "source_value" in sources.columns:
        parts.append(every(sources.withColumn("_s", F.concat_ws(":", "source_kind", "source_value")).select("item_id", "_s").distinct(), "_s", "sources"))
    warned = attempts.select("item_id", F.explode("warning_codes").alias("_w")).distinct()
    parts += [distinct(warned, "_w", "warnings"), distinct(attempts, "error_code", "errors"), attempts.groupBy("item_id").agg(F.count(F.lit(1)).alias("attempts"), F.array_sort(F.collect_list(F.col("attempt_id").cast("string"))).alias("attempt_ids"))]
    collected = attempts.where("operation = 'collect'") if "operation" in attempts.columns else attempts
    path = F.concat(F.lit("artifacts/pages/"), F.col("item_id").cast("string"), F.lit("/"), F.col("attempt_id").cast("string"), F.lit("/manifest.json"))
    parts.append(every(collected.where("item_id is not null").withColumn("_m", path), "_m", "manifest_paths"))
    if artifacts is not None:
        parts.append(every(artifacts.join(attempts.select("attempt_id", "item_id"), "attempt_id").where("item_id is not null"), "path", "artifact_paths"))
    out, nothing = items, F.array().cast("array<string>")
    for part in parts:
        out = out.join(part, "item_id", "left")
    arrays = [c for c in ("source_kinds", "sources", "labels", "warnings", "errors", "attempt_ids", "manifest_paths", "artifact_paths") if c in out.columns]
    return out.withColumns({**{c: F.coalesce(c, nothing) for c in arrays}, **{c: F.coalesce(c, F.lit(0)) for c in ("judgments", "attempts")}})


def exists_in(df: DataFrame, other: DataFrame, keys: list[str], negate: bool = False) -> DataFrame:
    """Rows of df with a row of the same keys in other, or without one (negate): EXISTS and NOT EXISTS. A null key has no equal, so its row doesn't exist there."""
    return df.join(other.select(*keys).distinct(), keys, "left_anti" if negate else "left_semi").select(df.columns)
