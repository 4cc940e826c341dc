"""URL operators: canonical form, merging, kinds, patterns, pages of series, exclusions, robots, domains."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomledger.functions import urls as U
from loomledger.sources.tables import checkpointed


def canonicalize(df: DataFrame, url: str = "url", base: str | None = None, keep: Iterable[str] = (), drop: Iterable[str] | None = None, per_domain: DataFrame | None = None) -> DataFrame:
    """Add original_url, canonical_url, domain, dropped and reject to every row.

    reject is null, empty, unparsable, scheme or userinfo; the other new columns are null where it isn't. Kept parameters
    win over dropped ones, and per-domain lists (columns domain, param, action keep|drop) only ever add to the general
    ones. base: a column with the URL that relative addresses are resolved against."""
    original = F.trim(F.col(url))
    out = df.withColumn("original_url", original)
    absolute = original
    if base is not None:
        absolute = resolved(original, F.col(base))
    out = out.withColumn("_u", F.coalesce(absolute, F.lit("")))
    u = F.col("_u")
    # The address is taken apart once; what follows reads the parts.
    out = out.withColumns({"_scheme": U.scheme(u), "_authority": U.authority(u), "_path": U.path(u), "_query": U.query(u)})
    scheme, authority, domain = F.col("_scheme"), F.col("_authority"), F.col("domain")
    out = out.withColumns({"domain": U.host_of(authority), "_p": U.params_of(F.col("_query"))})
    out = out.withColumn(
        "reject",
        F.when(F.coalesce(F.col("original_url"), F.lit("")) == "", "empty")
        .when(scheme == "", "unparsable")
        .when(~scheme.isin("http", "https"), "scheme")
        .when(authority.contains("@"), "userinfo")
        .when((domain == "") | domain.rlike(r"[\s<>\"{}|^%`\\]") | ~authority.rlike(r"^(\[[0-9A-Fa-f:.]+\]|[^:\[\]]+)(:[0-9]*)?$"), "unparsable"),
    )
    kept = [k.lower() for k in (*U.KEEP_PARAMS, *keep)]
    gone = [k.lower() for k in (U.DROP_PARAMS if drop is None else drop)]
    own_keep = own_drop = F.array().cast("array<string>")
    if per_domain is not None:
        # A policy table: one row for each domain that has rules of its own.
        rules = per_domain.groupBy(F.lower("domain").alias("domain")).agg(
            F.collect_set(F.when(F.col("action") == "keep", F.lower("param"))).alias("_keep"), F.collect_set(F.when(F.col("action") == "drop", F.lower("param"))).alias("_drop")
        )
        out = out.join(rules, "domain", "left")
        own_keep, own_drop = F.coalesce("_keep", own_keep), F.coalesce("_drop", own_drop)
    name = lambda p: F.lower(p["k"])
    is_kept = lambda p: name(p).isin(kept) | F.array_contains(own_keep, name(p))
    is_dropped = lambda p: ~is_kept(p) & (name(p).isin(gone) | F.array_contains(own_drop, name(p)))
    left = F.sort_array(F.filter("_p", lambda p: ~is_dropped(p)))
    query = F.array_join(F.transform(left, lambda p: F.concat(U.form_encoded(p["k"]), F.lit("="), U.form_encoded(p["v"]))), "&")
    port = F.regexp_extract(authority, r":([0-9]+)$", 1).try_cast("int")
    shown_port = F.when(port.isNull() | ((scheme == "http") & (port == 80)) | ((scheme == "https") & (port == 443)), "").otherwise(F.concat(F.lit(":"), port.cast("string")))
    bare = F.regexp_replace(U.plain_path(F.col("_path")), "/+$", "")
    # Lambdas are interpreted: addresses without parameters skip them.
    none = F.size("_p") == 0
    out = out.withColumns({"_q": F.when(none, "").otherwise(query), "_bare": bare, "_port": shown_port})
    shown = F.when(F.col("_bare") == "", "/").otherwise(F.col("_bare"))
    canonical = F.concat(scheme, F.lit("://"), domain, F.col("_port"), shown, F.when(F.col("_q") == "", "").otherwise(F.concat(F.lit("?"), F.col("_q"))))
    good = F.col("reject").isNull()
    return (
        out.withColumn("canonical_url", F.when(good, canonical))
        .withColumn("dropped", F.when(good, F.when(none, F.array().cast("array<string>")).otherwise(F.transform(F.filter("_p", is_dropped), lambda p: p["k"]))))
        .withColumn("domain", F.when(good, F.regexp_replace("domain", r"^\[(.+)\]$", "$1")))
        .select(*df.columns, "original_url", "canonical_url", "domain", "dropped", "reject")
    )


def resolved(url: Column, base: Column) -> Column:
    """A reference resolved against a base address."""
    root = F.concat(U.scheme(base), F.lit("://"), U.authority(base))
    folder = F.regexp_replace(F.when(U.path(base) == "", "/").otherwise(U.path(base)), "[^/]*$", "")
    whole = F.concat(root, U.path(base))
    return (
        F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), url)
        .when(url.startswith("//"), F.concat(U.scheme(base), F.lit(":"), url))
        .when(url.startswith("/"), F.concat(root, url))
        .when(url.startswith("?"), F.concat(whole, url))
        .when(url.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), url))
        .otherwise(F.concat(root, folder, url))
    )


def first_wins(df: DataFrame, key: str, order: str, fill: str | None = None) -> DataFrame:
    """The first row of each key, with the number of rows (n_rows); fill: a column whose null takes the first later value.

    Rows without a key are rejects, not rows of one key: they are left out. The rows of a key meet in an aggregation, which
    combines them before the exchange, so a key that very many rows share is no hot task."""
    filled = [] if fill is None else [F.min_by(fill, F.when(F.col(fill).isNotNull(), F.col(order))).alias("_fill")]
    out = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*df.columns), order).alias("_row"), F.count(F.lit(1)).alias("n_rows"), *filled)
    return out.select(*((F.col("_fill") if c == fill else F.col(f"_row.{c}")).alias(c) for c in df.columns), "n_rows")


def path_shapes(df: DataFrame, url: str = "url") -> DataFrame:
    """Add shape, combo, facet and facet_keys."""
    u = F.col(url)
    return df.withColumns({"shape": U.path_shape(u), "combo": U.query_combo(u), "facet": U.facet_kind(u), "facet_keys": U.facet_keys(u)})


def classify_kind(df: DataFrame, url: str = "url", cards: str | None = None) -> DataFrame:
    """Add kind, kind_status and evidence."""
    found = U.kind(F.col(url), None if cards is None else F.col(cards))
    return df.withColumn("_k", found).withColumns({"kind": F.col("_k.kind"), "kind_status": F.col("_k.status"), "evidence": F.col("_k.evidence")}).drop("_k")


def compile_globs(patterns: DataFrame, pattern: str = "pattern") -> DataFrame:
    """Add regex and reject to path globs: * is one segment, ** the rest; anything else is literal."""
    p = F.col(pattern)
    segments = F.split(p, "/")
    mixed = F.exists(segments, lambda s: s.contains("*") & ~s.isin("*", "**"))
    reject = (
        F.when(p.isNull() | (F.trim(p) == ""), "empty")
        .when(~p.startswith("/"), "no_leading_slash")
        .when(p.rlike(r"[?#\s]"), "not_a_path")
        .when(~p.rlike(r"^[A-Za-z0-9._~\-/*%]+$"), "bad_character")
        .when(mixed, "mixed_star")
    )
    part = lambda s: F.when(s == "**", ".+").when(s == "*", "[^/]+").otherwise(F.regexp_replace(s, r"([.+?^${}()|\[\]\\])", r"\\$1"))
    regex = F.concat(F.lit("^"), F.array_join(F.transform(segments, part), "/"), F.lit("/?$"))
    return patterns.withColumn("reject", reject).withColumn("regex", F.when(F.col("reject").isNull(), regex))


def classify_by_patterns(df: DataFrame, patterns: DataFrame, url: str = "url", given: str | None = None, default: str = "unknown") -> DataFrame:
    """Add kind_by_pattern, kind_why, kind and kind_source.

    patterns: side (listing | detail), pattern and scope (a domain, or null for all). A given kind wins over the domain's own
    patterns, those over the general ones, those over the default; where both sides of one level match, it doesn't answer."""
    # A policy table of a few hand-written rows, checked by its writer: it is gathered into two literal lists of rules.
    rules = compile_globs(patterns).where("reject is null").select("side", "regex", F.lower("scope").alias("scope")).collect()
    u = F.col(url)
    p = F.when(U.path(u) == "", "/").otherwise(U.path(u))

    def hit(side: str, own: bool) -> Column:
        out = F.lit(False)
        for r in rules:
            if r["side"] == side and (r["scope"] is not None) == own:
                out = out | (p.rlike(r["regex"]) & (F.lit(True) if r["scope"] is None else U.host(u) == r["scope"]))
        return out

    level = lambda own: F.when(hit("listing", own) & ~hit("detail", own), "listing").when(hit("detail", own) & ~hit("listing", own), "detail")
    both = (hit("listing", True) & hit("detail", True)) | (hit("listing", False) & hit("detail", False))
    told = F.lit(None).cast("string") if given is None else F.col(given)
    return df.withColumns(
        {
            "kind_by_pattern": F.coalesce(level(True), level(False)),
            "kind_why": F.when(both, "both_matched"),
            "kind": F.coalesce(told, level(True), level(False), F.lit(default)),
            "kind_source": F.when(told.isNotNull(), "given").when(level(True).isNotNull(), "domain").when(level(False).isNotNull(), "policy").otherwise("default"),
        }
    )


def page_of(df: DataFrame, url: str = "url", kind: str = "kind", kind_source: str = "kind_source", offset_step: int | None = None) -> DataFrame:
    """Add series and page_index for addresses confirmed as listings; null where an address is no page of a series."""
    u = F.regexp_replace(F.col(url), "#.*$", "")
    confirmed = (F.col(kind) == "listing") & F.col(kind_source).isNotNull() & (F.col(kind_source) != "default")
    rest = F.concat(F.regexp_extract(u, r"^([^?]*)", 1))
    pieces = F.filter(F.split(U.query(u), "&"), lambda x: x != "")

    def without(key: str) -> Column:
        left = F.array_join(F.filter(pieces, lambda x: F.lower(F.regexp_extract(x, "^([^=]*)", 1)) != key), "&")
        return F.when(left == "", rest).otherwise(F.concat(rest, F.lit("?"), left))

    def value(key: str) -> Column:
        """The first value of digits of a parameter."""
        found = F.filter(U.params(u), lambda q: (F.lower(q["k"]) == key) & q["v"].rlike("^[0-9]+$"))
        return F.try_element_at(found, F.lit(1))["v"].cast("long")

    series, index = F.lit(None).cast("string"), F.lit(None).cast("long")
    tail = F.regexp_extract(U.path(u), r"^(.*)/([0-9]+)$", 2)
    named = F.regexp_extract(U.path(u), r"(?i)/(page|p|pg|pages)/([0-9]+)$", 2)
    cut = lambda pattern: F.concat(F.regexp_replace(rest, pattern, ""), F.when(F.regexp_replace(U.path(u), pattern, "") == "", "/").otherwise(""), F.when(U.query(u) == "", "").otherwise(F.concat(F.lit("?"), U.query(u))))
    series = F.when(named != "", cut(r"(?i)/(page|p|pg|pages)/[0-9]+$")).when(tail != "", cut(r"/[0-9]+$"))
    index = F.when(named != "", named.cast("long")).when(tail != "", tail.cast("long"))
    if offset_step:
        for key in reversed(OFFSETS):
            fits = value(key) % offset_step == 0
            series, index = F.when(fits, without(key)).otherwise(series), F.when(fits, (value(key) / offset_step + 1).cast("long")).otherwise(index)
    for key in reversed(U.PAGE_KEYS):
        series, index = F.when(value(key).isNotNull(), without(key)).otherwise(series), F.when(value(key).isNotNull(), value(key)).otherwise(index)
    return df.withColumns({"series": F.when(confirmed, series), "page_index": F.when(confirmed, index)})


OFFSETS = U.OFFSET_KEYS


def priority(df: DataFrame, kind: str = "kind", depth: str = "depth", lastmod: str = "lastmod") -> DataFrame:
    """Add priority: listings first, deeper addresses later, a known date of change as a tie-breaker."""
    base = F.when(F.col(kind) == "listing", 100).when(F.col(kind) == "sitemap", 90).when(F.col(kind) == "detail", 10).otherwise(50)
    return df.withColumn("priority", base - 10 * F.coalesce(F.col(depth), F.lit(0)) + F.when(F.col(lastmod).isNotNull(), 1).otherwise(0))


def match_exclusions(df: DataFrame, path_patterns: list[str], query_keys: list[str], url: str = "url") -> DataFrame:
    """Add why and why_evidence: the first path glob that matches, else the first query key of the list; null where none does."""
    spark = df.sparkSession
    u = F.col(url)
    p = F.when(U.path(u) == "", "/").otherwise(U.path(u))
    globs = compile_globs(spark.createDataFrame([(i, g) for i, g in enumerate(path_patterns)], "i int, pattern string")).orderBy("i").collect()
    pattern = F.lit(None).cast("string")
    for rule in reversed(globs):
        if rule["reject"]:
            raise ValueError(f"bad path pattern {rule['pattern']!r}: {rule['reject']}")
        pattern = F.when(p.rlike(rule["regex"]), rule["pattern"]).otherwise(pattern)
    keys = [k.lower() for k in query_keys]
    key = F.try_element_at(F.filter(F.transform(U.params(u), lambda q: F.lower(q["k"])), lambda k: k.isin(keys)), F.lit(1)) if keys else F.lit(None).cast("string")
    return df.withColumns({"why": F.when(pattern.isNotNull(), "excluded_path_pattern").when(key.isNotNull(), "excluded_query_key"), "why_evidence": F.coalesce(pattern, key)})


def domain_in(df: DataFrame, listed: DataFrame, domain: str = "domain") -> DataFrame:
    """Rows whose domain, or a domain above it, is listed (column domain); a leading www. doesn't count. An equality join on every suffix."""
    bare = F.regexp_replace(F.lower(F.col(domain)), r"^www\.", "")
    labels = F.split(bare, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    names = listed.select(F.regexp_replace(F.lower("domain"), r"^www\.", "").alias("_suffix")).distinct()
    hit = df.select(F.col(domain).alias("_d"), suffixes.alias("_s")).distinct().select("_d", F.explode("_s").alias("_suffix")).join(names, "_suffix", "left_semi").select("_d").distinct()
    return df.join(hit, df[domain] == hit["_d"], "left_semi")


#: Shares into which a host's addresses are dealt to meet its rules.
SHARES = 16


def robots_decide(urls: DataFrame, rules: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """Add allowed, rule_type and rule_path. rules: host, group_id, agents (lower-cased), rule_type, path (null: a group without rules).

    The group with the longest agent name that begins ours, else the first with *; its longest matching rule, ties to allow; no
    rule or no group: allowed."""
    me = agent.lower()
    group = rules.select("host", "group_id", F.explode("agents").alias("_a")).distinct()
    group = group.where((F.col("_a") == "*") | F.lit(me).startswith(F.col("_a")))
    best = Window.partitionBy("host").orderBy(F.when(F.col("_a") == "*", -1).otherwise(F.length("_a")).desc(), "group_id")
    group = group.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("host", "group_id")
    literal = F.regexp_replace("path", r"([.+?^${}()|\[\]\\])", r"\\$1")
    regex = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(literal, r"\\\$$", r"\$"), r"\*", ".*"))
    live = rules.join(group, ["host", "group_id"], "left_semi").where("path is not null").select(F.col("host").alias("_h"), F.col("rule_type").alias("_t"), F.col("path").alias("_path"), regex.alias("_regex"))
    u = F.col(url)
    target = F.concat(F.when(U.path(u) == "", "/").otherwise(U.path(u)), F.when(U.query(u) == "", "").otherwise(F.concat(F.lit("?"), U.query(u))))
    keyed = urls.withColumn("_host", U.host(u)).withColumn("_target", target)
    # Each address meets its host's rules once, however many rows have it; the rows keep their number and take the verdict back.
    # A host's few rules are there for every share of its addresses, so a host with most of the addresses is many tasks' work.
    shared = live.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    asked = keyed.select("_host", "_target").distinct().withColumn("_part", F.pmod(F.xxhash64("_target"), F.lit(SHARES)).cast("int"))
    hits = asked.join(shared, (F.col("_host") == F.col("_h")) & (F.col("_part") == F.col("_share")) & F.expr("_target rlike _regex"))
    win = hits.groupBy("_host", "_target").agg(F.max(F.struct(F.length("_path").alias("n"), (F.col("_t") == "allow").alias("a"), F.col("_t").alias("t"), F.col("_path").alias("p"))).alias("_w"))
    return keyed.join(win, ["_host", "_target"], "left").select(*urls.columns, F.coalesce(F.col("_w.t") == "allow", F.lit(True)).alias("allowed"), F.col("_w.t").alias("rule_type"), F.col("_w.p").alias("rule_path"))


def robots_state(urls: DataFrame, files: DataFrame, decided: DataFrame, url: str = "url") -> DataFrame:
    """Add robots_state and allowed. files: host, http_status. 404 and 410: no file, allowed; another failure or no answer: unknown, allowed."""
    status = files.select(F.col("host").alias("_h"), "http_status")
    out = decided.withColumn("_host", U.host(F.col(url))).join(status, F.col("_host") == F.col("_h"), "left")
    state = F.when(F.col("http_status").isin(404, 410), "no_file").when(F.col("http_status").isNull() | (F.col("http_status") >= 400), "unknown").otherwise("read")
    return out.withColumn("robots_state", state).withColumn("allowed", F.when(state == "read", F.col("allowed")).otherwise(True)).drop("_host", "_h", "http_status")


def external_hops(links: DataFrame, seeds: DataFrame, allow: list[str], most: int = 2) -> DataFrame:
    """url, domain and hops of every address reached within most hops. links: from_url, to_url; seeds: url.

    Within a domain, or into an allowed one, hops stay; otherwise they grow by one. One join for each link followed, until
    nothing gets nearer; each round ends in a checkpoint."""
    allowed = [a.lower() for a in allow]
    far = lambda a, b: F.when((U.host(a) == U.host(b)) | U.host(b).isin(allowed), 0).otherwise(1)
    edges = checkpointed(links.select("from_url", "to_url", far(F.col("from_url"), F.col("to_url")).alias("step")).distinct())  # every round reads them
    reached = seeds.select("url", F.lit(0).alias("hops")).distinct()
    frontier = reached
    while True:
        new = frontier.join(edges, F.col("url") == F.col("from_url")).select(F.col("to_url").alias("url"), (F.col("hops") + F.col("step")).alias("hops")).where(F.col("hops") <= most).groupBy("url").agg(F.min("hops").alias("hops"))
        better = new.join(reached.select("url", F.col("hops").alias("_old")), "url", "left").where("_old is null or hops < _old").drop("_old")
        better = checkpointed(better)
        if better.isEmpty():
            break
        reached = checkpointed(reached.unionByName(better).groupBy("url").agg(F.min("hops").alias("hops")))
        frontier = better
    return reached.select("url", U.host(F.col("url")).alias("domain"), "hops")


def host_verdict(hosts: DataFrame, addresses: DataFrame) -> DataFrame:
    """host, verdict and addresses: allowed only if all of a host's addresses are public; hosts: host; addresses: host, address."""
    found = addresses.select("host", U.ip_class(F.col("address")).alias("_c")).groupBy("host").agg(F.bool_and(F.coalesce(F.col("_c") == "public", F.lit(False))).alias("_all"), F.min(F.when(F.col("_c") != "public", F.col("_c"))).alias("_why"), F.count(F.lit(1)).alias("addresses"))
    out = hosts.select("host").distinct().join(found, "host", "left")
    verdict = F.when(F.col("_all").isNull(), "no_public_address").when(F.col("_all"), "allowed").when(F.col("_why").isNull(), "unreadable_address").otherwise(F.concat(F.lit("ip_"), F.col("_why")))
    return out.select("host", verdict.alias("verdict"), F.coalesce("addresses", F.lit(0)).alias("addresses"))
