"""Reconciliation: snapshots, files against the ledger, indexes against items, key sets, references, matches, ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomledger.operators.substrings import occurrences
from loomledger.sources.tables import checkpointed


def snapshot_diff(before: DataFrame, after: DataFrame, key: str = "key", value: str = "lastmod", flagged: DataFrame | None = None) -> DataFrame:
    """key and change: new, changed, unchanged, disappeared, or reappeared where a key flagged as gone before is back."""
    b = before.select(F.col(key).alias("_b"), F.col(value).alias("_old"))
    a = after.select(F.col(key).alias("_a"), F.col(value).alias("_new"))
    out = b.join(a, F.col("_b") == F.col("_a"), "full_outer").withColumn(key, F.coalesce("_a", "_b"))
    change = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "disappeared").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed").otherwise("unchanged")
    if flagged is not None:
        gone = flagged.select(F.col(key)).distinct().withColumn("_gone", F.lit(True))
        out = out.join(gone, key, "left")
        change = F.when(F.col("_gone") & F.col("_a").isNotNull(), "reappeared").otherwise(change)
    return out.select(key, F.col("_old").alias("before"), F.col("_new").alias("after"), change.alias("change"))


def disappeared(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    return before.select(key).subtract(after.select(key))


def reappeared(flagged: DataFrame, after: DataFrame, key: str) -> DataFrame:
    return flagged.select(key).intersect(after.select(key))


#: What artifacts' files begin with while they are written, what a run's manifest is called, folders of pointers.
PART, MANIFEST, POINTERS = ".part-", "manifest.json", ("latest", "by-domain")


def audit_artifacts(artifacts: DataFrame, files: DataFrame, root: str = "artifacts") -> DataFrame:
    """path and finding: ok, missing, size_mismatch, sha_mismatch, orphan or incomplete. artifacts, files: path, byte_size, sha256.

    A file that no artifact names is incomplete if its own name begins as one that is being written; manifests, and files in the folders of pointers
    under root, are no orphans and have no finding."""
    a = artifacts.select(F.col("path").alias("_p"), F.col("byte_size").alias("_size"), F.col("sha256").alias("_sha"))
    f = files.select("path", "byte_size", "sha256")
    out = a.join(f, F.col("_p") == F.col("path"), "full_outer")
    name, loose = F.substring_index("path", "/", -1), F.col("_p").isNull()
    own = name == MANIFEST
    for folder in POINTERS:
        own = own | F.col("path").startswith(f"{root}/{folder}/")
    finding = (
        F.when(loose & name.startswith(PART), "incomplete")
        .when(loose & own, F.lit(None))
        .when(loose, "orphan")
        .when(F.col("path").isNull(), "missing")
        .when(F.col("_size") != F.col("byte_size"), "size_mismatch")
        .when(F.col("_sha") != F.col("sha256"), "sha_mismatch")
        .otherwise("ok")
    )
    return out.select(F.coalesce("path", "_p").alias("path"), finding.alias("finding")).where("finding is not null")


def runs_without_manifest(attempts: DataFrame, files: DataFrame) -> DataFrame:
    """attempt_id of finished runs whose folder has no manifest. attempts: attempt_id, finished_at, folder; files: path."""
    have = files.where(F.substring_index("path", "/", -1) == MANIFEST).select(F.regexp_replace("path", f"/{MANIFEST}$", "").alias("folder")).distinct()
    return attempts.where("finished_at is not null").join(have, "folder", "left_anti").select("attempt_id")


def evidence_states(artifacts: DataFrame, attempts: DataFrame, files: DataFrame) -> DataFrame:
    """artifact_id, item_id and state (ok, missing, size_mismatch, sha_mismatch) of every artifact, for check_judgments. artifacts: artifact_id, attempt_id, path, byte_size, sha256; attempts: attempt_id, item_id; files: path, byte_size, sha256."""
    listed = files.select("path", F.col("byte_size").alias("_size"), F.col("sha256").alias("_sha"))
    out = artifacts.join(attempts.select("attempt_id", "item_id"), "attempt_id", "left").join(listed, "path", "left")
    state = F.when(F.col("_size").isNull(), "missing").when(F.col("_size") != F.col("byte_size"), "size_mismatch").when(F.col("_sha") != F.col("sha256"), "sha_mismatch").otherwise("ok")
    return out.select("artifact_id", "item_id", state.alias("state"))


def reconcile_index(items: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matched, missing, stale): items with a link to them or to anything under them, items without, links that fit no item. items, links: path."""
    parts = F.split("link", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    named = links.select(F.regexp_replace("path", "/+$", "").alias("link")).distinct()
    reach = named.select("link", F.explode(above).alias("path"))
    hits = reach.join(items.select("path").distinct(), "path", "left_semi")
    return items.join(hits.select("path").distinct(), "path", "left_semi"), items.join(hits.select("path").distinct(), "path", "left_anti"), named.join(hits.select("link").distinct(), "link", "left_anti")


def symmetric_difference(a: DataFrame, b: DataFrame, key: str, exempt: DataFrame | None = None) -> DataFrame:
    """key and side (only_a, only_b) of keys that one side lacks and that aren't exempt."""
    x, y = a.select(F.col(key).alias("_x")).distinct(), b.select(F.col(key).alias("_y")).distinct()
    out = x.join(y, F.col("_x") == F.col("_y"), "full_outer").where("_x is null or _y is null")
    out = out.select(F.coalesce("_x", "_y").alias(key), F.when(F.col("_y").isNull(), "only_a").otherwise("only_b").alias("side"))
    return out if exempt is None else out.join(exempt.select(key), key, "left_anti")


def reconcile_keys(schema: DataFrame, example: DataFrame, settings: DataFrame, services: DataFrame, exempt: DataFrame, guide: DataFrame | None = None) -> DataFrame:
    """Findings (check, key, detail) over key names: A schema and example differ, B a required key is absent in an env, C a service's key isn't declared, D dev and prod services
    differ, by service and, in services both have, by key and by how a key is declared, E a key no schema knows, F services and guide differ, G dev and prod settings differ,
    H an env's keys aren't in the guide's order.

    schema: key, required; example: key; settings: env, key (KEY or KEY@app), and ord for H; services: env, service, key, and declared (value, sync:false) for D and F;
    exempt: key; guide: key, rank, sensitive (null: not said)."""
    plain = settings.select("env", F.regexp_replace("key", "@.*$", "").alias("key")).distinct()
    finding = lambda df, check, key, detail: df.select(F.lit(check).alias("check"), F.col(key).alias("key"), detail.alias("detail"))
    a = finding(symmetric_difference(schema, example, "key"), "A", "key", F.col("side"))
    envs = settings.select("env").distinct()
    wanted = schema.where("required").select("key").crossJoin(envs)
    b = finding(wanted.join(plain, ["env", "key"], "left_anti"), "B", "key", F.col("env"))
    c = finding(services.join(schema.select("key"), "key", "left_anti"), "C", "key", F.concat_ws("/", "env", "service")).distinct()
    one = lambda df, env: df.where(F.col("env") == env)
    d = finding(symmetric_difference(one(services, "dev"), one(services, "prod"), "service"), "D", "service", F.col("side"))
    how = F.col("declared") if "declared" in services.columns else F.lit(None).cast("string")
    side = lambda env: one(services, env).groupBy("service", "key").agg(F.min(how).alias(env))
    both = one(services, "dev").select("service").intersect(one(services, "prod").select("service"))
    pairs = side("dev").withColumn("_d", F.lit(True)).join(side("prod").withColumn("_p", F.lit(True)), ["service", "key"], "full_outer").join(both, "service", "left_semi")
    told = F.when(F.col("_d").isNull(), F.concat("service", F.lit(": only prod"))).when(F.col("_p").isNull(), F.concat("service", F.lit(": only dev"))).when(~F.col("dev").eqNullSafe(F.col("prod")), F.concat("service", F.lit(": dev "), F.coalesce("dev", F.lit("-")), F.lit(", prod "), F.coalesce("prod", F.lit("-"))))
    d = d.unionByName(finding(pairs.withColumn("_told", told).where("_told is not null"), "D", "key", F.col("_told")))
    e = finding(plain.join(schema.select("key"), "key", "left_anti"), "E", "key", F.col("env"))
    g = finding(symmetric_difference(one(plain, "dev"), one(plain, "prod"), "key"), "G", "key", F.col("side"))
    out = a
    for part in (b, c, d, e, g):
        out = out.unionByName(part)
    if guide is not None:
        said = guide.select(F.col("key").alias("_g"), "sensitive")
        seen = services.select("key", how.alias("_how")).distinct().join(said, F.col("key") == F.col("_g"), "left")
        why = F.when(F.col("_g").isNull(), "not_in_guide").when(F.col("sensitive") & (F.col("_how") == "value"), "secret_as_value").when(~F.col("sensitive") & (F.col("_how") == "sync:false"), "public_as_secret")
        out = out.unionByName(finding(seen.withColumn("_why", why).where("_why is not null"), "F", "key", F.col("_why")).distinct())
        if "ord" in settings.columns:
            drift = first_drift(settings, guide.select("key", "rank"))
            out = out.unionByName(finding(drift, "H", "found", F.concat("env", F.lit(": expected "), "expected")))
    return out.join(exempt.select("key"), "key", "left_anti").select("check", "key", "detail")


def scoped_lookup(keys: DataFrame, settings: DataFrame) -> DataFrame:
    """Add found and scoped: KEY@app first, then KEY. keys: key, app; settings: key."""
    names = settings.select(F.col("key").alias("_name")).distinct()
    out = keys.join(names.select(F.col("_name").alias("_own")), F.col("_own") == F.concat("key", F.lit("@"), "app"), "left").join(names, F.col("_name") == F.col("key"), "left")
    return out.withColumns({"scoped": F.col("_own").isNotNull(), "found": F.coalesce("_own", "_name").isNotNull()}).drop("_own", "_name")


def canonical_sort(keys: DataFrame, reference: DataFrame) -> DataFrame:
    """Keys in the order of a reference list: unknown ones last, the plain key before its scoped ones, else as they stood. keys: key, ord; reference: key, rank."""
    base = F.regexp_replace("key", "@.*$", "")
    ranks = reference.select(F.col("key").alias("_base"), "rank")
    out = keys.withColumn("_k", base).join(ranks, F.col("_k") == F.col("_base"), "left")
    out = out.withColumns({"known": F.col("rank").isNotNull(), "scoped": F.col("key").contains("@")})
    return out.orderBy(F.desc("known"), F.asc_nulls_last("rank"), "scoped", "ord").drop("_k", "_base")


def first_drift(settings: DataFrame, reference: DataFrame) -> DataFrame:
    """env, place, found and expected: the first key of each env that doesn't stand where the canonical order has it; envs in order are absent. settings: env, key, ord; reference: key, rank.

    An env's keys are a settings file, so one window holds one file."""
    ranks = reference.select(F.col("key").alias("_base"), "rank")
    keys = settings.withColumn("_k", F.regexp_replace("key", "@.*$", "")).join(ranks, F.col("_k") == F.col("_base"), "left")
    scoped = F.col("key").contains("@")
    stood = keys.withColumn("place", F.row_number().over(Window.partitionBy("env").orderBy("ord", "key")))
    should = Window.partitionBy("env").orderBy(F.col("rank").isNull(), "rank", scoped, "ord", "key")
    placed = stood.withColumn("due", F.row_number().over(should))
    here = placed.select("env", "place", F.col("key").alias("found"))
    there = placed.select("env", F.col("due").alias("place"), F.col("key").alias("expected"))
    off = here.join(there, ["env", "place"]).where("found <> expected")
    return off.groupBy("env").agg(F.min(F.struct("place", "found", "expected")).alias("f")).select("env", "f.place", "f.found", "f.expected")


def resolve_refs(entries: DataFrame, labels: DataFrame, files: DataFrame) -> DataFrame:
    """Add resolved and problem: @label:x becomes the label's body; a body that is one @file:y becomes the file's text; a label inside a label is refused; what isn't there is said.

    entries: text; labels: label, body; files: file, content."""
    label = F.regexp_extract("text", r"^@label:(\S+)$", 1)
    out = entries.withColumn("_l", label).join(labels.select(F.col("label").alias("_label"), "body"), F.col("_l") == F.col("_label"), "left")
    file = F.regexp_extract(F.coalesce("body", F.lit("")), r"^@file:(\S+)$", 1)
    out = out.withColumn("_f", file).join(files.select(F.col("file").alias("_file"), "content"), F.col("_f") == F.col("_file"), "left")
    named = F.col("_l") != ""
    problem = F.when(named & F.col("_label").isNull(), "missing_label").when(named & F.col("body").startswith("@label:"), "nested_label").when(named & (F.col("_f") != "") & F.col("_file").isNull(), "missing_file")
    resolved = F.when(~named, F.col("text")).when(problem.isNotNull(), F.concat(F.lit("["), problem, F.lit(": "), F.when(problem == "missing_file", F.col("_f")).otherwise(F.col("_l")), F.lit("]"))).when(F.col("_f") != "", F.col("content")).otherwise(F.col("body"))
    return out.withColumns({"resolved": resolved, "problem": problem}).drop("_l", "_label", "body", "_f", "_file", "content")


def expand_groups(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """group, member, place and body of every member; body null where no label has its name. groups: group, members."""
    members = groups.select("group", F.posexplode("members").alias("place", "member"))
    return members.join(labels.select(F.col("label").alias("member"), "body"), "member", "left").select("group", "place", "member", "body", F.col("body").isNull().alias("missing"))


def match_boxes(cards: DataFrame, boxes: DataFrame) -> DataFrame:
    """Add box to every card: the first box with its detail URL, else with its image; a box is used once, by its first card. cards: page, position, href, img; boxes: page, box, href, img."""

    def first(column: str) -> DataFrame:
        rank = Window.partitionBy("page", column).orderBy("box")
        return boxes.where(F.col(column).isNotNull()).withColumn("_r", F.row_number().over(rank)).where("_r = 1").select(F.col("page").alias("_page"), F.col(column).alias(f"_{column}"), F.col("box").alias(f"_box_{column}"))

    out = cards
    for column in ("href", "img"):
        side = first(column)
        out = out.join(side, (F.col("page") == F.col("_page")) & (F.col(column) == F.col(f"_{column}")), "left").drop("_page", f"_{column}")
    out = out.withColumn("_box", F.coalesce("_box_href", "_box_img"))
    use = F.row_number().over(Window.partitionBy("page", "_box").orderBy("position"))
    return out.withColumn("box", F.when(use == 1, F.col("_box"))).drop("_box", "_box_href", "_box_img")


def lookup_sections(sections: DataFrame, ids: DataFrame) -> DataFrame:
    """id, matches, path and address: a section of exactly that title, else one whose title holds it; several: ambiguous, no answer; none: missing. sections: path, address, title; ids: id.

    Titles are read once, where they are; what goes on is one row for each id that a task has met. An empty id is in every title that isn't null."""
    known = sections.where("title is not null").select(F.lower("title").alias("text"), F.struct("path", "address").alias("_s"))
    asked = checkpointed(ids.select("id", F.lower("id").alias("needle")).distinct())
    place = F.col("_s")
    counts = occurrences(known, asked).groupBy("piece").agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_s"), F.count_if("whole").alias("_exact"), F.min(F.when(F.col("whole"), place)).alias("_e"))
    exact = F.col("_exact") > 0
    met = asked.join(counts, F.col("needle").cast("binary") == F.col("piece")).select("id", F.when(exact, F.col("_exact")).otherwise(F.col("_n")).alias("matches"), F.when(exact, F.col("_e")).otherwise(F.col("_s")).alias("_s"))
    # An empty title is exactly the empty id.
    empty = F.col("text") == ""
    totals = known.agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_s"), F.count_if(empty).alias("_exact"), F.min(F.when(empty, place)).alias("_e")).where("_n > 0")
    every = asked.where("needle = ''").select("id").join(F.broadcast(totals)).select("id", F.when(exact, F.col("_exact")).otherwise(F.col("_n")).alias("matches"), F.when(exact, F.col("_e")).otherwise(F.col("_s")).alias("_s"))
    out = ids.join(met.unionByName(every), "id", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    only = F.col("matches") == 1
    return out.select("id", "matches", F.when(only, "found").when(F.col("matches") == 0, "missing").otherwise("ambiguous").alias("verdict"), F.when(only, F.col("_s.path")).alias("path"), F.when(only, F.col("_s.address")).alias("address"))


def check_provenance(records: DataFrame, urls: DataFrame, parentless: tuple[str, ...] = ("seed", "search", "sitemap", "robots", "import")) -> DataFrame:
    """Add outcome: new, known, needs_parent (a kind that must have one) or unknown_parent. records: url_id, parent_id, source_kind; urls: url_id."""
    known = urls.select("url_id").distinct()
    out = records.join(known.select(F.col("url_id").alias("_p")), F.col("parent_id") == F.col("_p"), "left").join(known.select(F.col("url_id").alias("_u")), F.col("url_id") == F.col("_u"), "left")
    free = F.col("source_kind").isin(*parentless)
    outcome = F.when(~free & F.col("parent_id").isNull(), "needs_parent").when(F.col("parent_id").isNotNull() & F.col("_p").isNull(), "unknown_parent").when(F.col("_u").isNotNull(), "known").otherwise("new")
    return out.withColumn("outcome", outcome).drop("_p", "_u")


def note_source(notes: DataFrame, turns: DataFrame, before: int, after: int) -> DataFrame:
    """Lines of the transcript each note points at, its range (a or a-b) widened; outcome says why there are none.

    notes: note, file, range; turns: file, line, role."""
    low = F.regexp_extract("range", "^([0-9]+)(?:-[0-9]+)?$", 1)
    high = F.regexp_extract("range", "^[0-9]+-([0-9]+)$", 1)
    parsed = notes.withColumns({"low": F.when(low != "", low.cast("int") - before), "high": F.when(low != "", F.when(high != "", high).otherwise(low).cast("int") + after)})
    files = turns.select("file").distinct().withColumn("_there", F.lit(True))
    parsed = parsed.join(files, "file", "left")
    outcome = F.when(F.col("_there").isNull(), "file_missing").when(F.coalesce("range", F.lit("")) == "", "range_missing").when(F.col("low").isNull() | (F.col("high") - after < F.col("low") + before), "range_unreadable").otherwise("ok")
    parsed = parsed.withColumn("outcome", outcome).drop("_there")
    lines = parsed.join(turns.select(F.col("file").alias("_file"), F.col("line").alias("_line"), "role"), (F.col("file") == F.col("_file")) & (F.col("outcome") == "ok") & F.col("_line").between(F.col("low"), F.col("high")), "left")
    return lines.select("note", "file", "outcome", F.col("_line").alias("line"), "role")


def expand_queries(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """input, query and alias (false for the query itself): lower-cased queries and the terms their aliases stand for. queries: input; aliases: from_term, to_term."""
    own = queries.select("input", F.lower("input").alias("query"), F.lit(False).alias("alias"))
    other = queries.join(aliases, F.lower("input") == F.lower("from_term")).select("input", F.lower("to_term").alias("query"), F.lit(True).alias("alias"))
    rank = Window.partitionBy("input", "query").orderBy("alias")
    return own.unionByName(other).withColumn("_r", F.row_number().over(rank)).where("_r = 1").drop("_r")


def update_groups(before: DataFrame, after: DataFrame) -> DataFrame:
    """key and event: joined, left, moved or stayed, by content group. before, after: key, content_hash (null: not measurable)."""
    b, a = before.select(F.col("key").alias("_b"), F.col("content_hash").alias("_old")), after.select(F.col("key").alias("_a"), F.col("content_hash").alias("_new"))
    out = b.join(a, F.col("_b") == F.col("_a"), "full_outer")
    event = F.when(F.col("_old").isNull() & F.col("_new").isNotNull(), "joined").when(F.col("_old").isNotNull() & F.col("_new").isNull(), "left").when(F.col("_old").eqNullSafe(F.col("_new")), "stayed").otherwise("moved")
    return out.select(F.coalesce("_a", "_b").alias("key"), event.alias("event"))


def merge_cards(cards: DataFrame, batch: DataFrame, cycle: int) -> DataFrame:
    """Cards after a batch: what was known keeps its first cycle and first sight, what is seen again gets a new last sight. cards: card_id, discovered_cycle, first_seen, last_seen; batch: card_id, seen_at."""
    seen = batch.groupBy("card_id").agg(F.min("seen_at").alias("_first"), F.max("seen_at").alias("_last"))
    out = cards.join(seen, "card_id", "full_outer")
    return out.select("card_id", F.coalesce("discovered_cycle", F.lit(cycle)).alias("discovered_cycle"), F.coalesce("first_seen", "_first").alias("first_seen"), F.coalesce("_last", "last_seen").alias("last_seen"))


def mark_read(messages: DataFrame, marks: DataFrame) -> DataFrame:
    """Messages after marks (no, read, at): the first time of reading stays. messages: no, read, read_at."""
    last = marks.groupBy("no").agg(F.max_by("read", "at").alias("_read"), F.min(F.when(F.col("read"), F.col("at"))).alias("_at"))
    out = messages.join(last, "no", "left")
    return out.withColumns({"read": F.coalesce("_read", "read"), "read_at": F.coalesce("read_at", "_at")}).drop("_read", "_at")


def cycle_report(state: DataFrame, cycles: DataFrame) -> DataFrame:
    """The next cycle's row (cycle, version, woken), or none when the ledger's version is the last cycle's. state: version, woken; cycles: cycle, version."""
    last = cycles.agg(F.coalesce(F.max("cycle"), F.lit(0)).alias("_last"), F.max_by("version", "cycle").alias("_version"))
    return state.crossJoin(last).where(~F.col("version").eqNullSafe(F.col("_version"))).select((F.col("_last") + 1).alias("cycle"), "version", "woken")
