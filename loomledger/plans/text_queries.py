"""Queries of the text and outcome operators over pages, documents, conversations, benchmark and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomledger.operators import reviews
from loomledger.operators import text as ops
from loomledger.sources.tables import ATTEMPTS_SQL, attempts, table

#: Phrases, rules and words that occur in the driver's tables (the fixed lists are tested by golden rows).
_PHRASES = ("thanedble", "licensed under", "nicht", "queen", "spam")
_RULES = [("(?i)licensed under", "licence line"), (r"\| [^|]*\|", "table residue"), ("###|%%%", "marks"), ("(?i)idiot|scum", "insult")]
_WORDS = ["thereof", "that", "einer", "queau"]


def visible_text(spark, sf_dir):
    return ops.visible_text(table(spark, sf_dir, "pages")).select("page_id", F.sha2("text", 256).alias("text_hash"), "chars")


def outgoing_links(spark, sf_dir):
    return ops.outgoing_links(table(spark, sf_dir, "pages"), "html").select("page_id", "href")


def declared_count(spark, sf_dir):
    return ops.declared_count(table(spark, sf_dir, "documents").withColumn("t", F.concat(F.format_number("n_chars", 0), F.lit(" items "), F.col("text"))), "t").select("doc_id", "declared")


def term_counts(spark, sf_dir):
    return ops.term_counts(table(spark, sf_dir, "documents"), "text", "doc_id")


def top_words(spark, sf_dir):
    return ops.top_words(ops.term_counts(table(spark, sf_dir, "documents"), "text", "doc_id"))


def content_hash(spark, sf_dir):
    return ops.content_hash(table(spark, sf_dir, "documents"), "text", html=False).select("doc_id", "content_hash")


def content_groups(spark, sf_dir):
    return ops.content_groups(ops.content_hash(table(spark, sf_dir, "documents"), "text", html=False), "doc_id")


def error_page(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("title", F.regexp_extract("text", r"^([^\n]*)", 1))
    out = ops.error_page(docs, "text", "title", _PHRASES)
    return out.where("phrase is not null").select("doc_id", "phrase", "found_in", "offset")


def text_flags(spark, sf_dir):
    return ops.text_flags(table(spark, sf_dir, "documents"), "text").groupBy("lang").agg(F.count_if("empty_text").alias("empty"), F.count_if("thin_text").alias("thin"), F.count(F.lit(1)).alias("n"))


def challenge(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("title", F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return ops.challenge(pages, "html", "title", ("licensed", "cheap", "moron")).select("page_id", "challenge")


def clean_turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    noisy = F.concat(F.lit("<system-reminder>x\ny</system-reminder>"), F.col("text"), F.lit("\n\n\n\n<local-command-stdout>z</local-command-stdout>  "))
    blocks = F.array(F.struct(F.lit("thinking").alias("type"), F.lit("secret").alias("text"), F.lit(None).cast("string").alias("name")), F.struct(F.lit("text").alias("type"), noisy.alias("text"), F.lit(None).cast("string").alias("name")), F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.col("role").alias("name")))
    return ops.clean_turns(c.withColumn("blocks", blocks).drop("text")).select("conv_id", "turn", F.sha2("text", 256).alias("text_hash"))


def lint_rules(spark, sf_dir):
    return ops.lint_rules(table(spark, sf_dir, "documents"), _RULES, "text").select("doc_id", F.array_join("reasons", ",").alias("reasons"))


def out_of_corpus(spark, sf_dir):
    """Words of the documents of which the part names, as a small corpus, hold no form."""
    return ops.out_of_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "part"), "text", "doc_id", "p_name", allow=("the",))


def odd_pairs(spark, sf_dir):
    return ops.odd_pairs(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "text", "item_id")


def preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ops.preview(F.col("text"), 60).alias("preview"))


def required_words(spark, sf_dir):
    return ops.required_words(table(spark, sf_dir, "documents"), _WORDS, "text").select("doc_id", F.array_join("matched", ",").alias("matched"), "review_required")


def search_notes(spark, sf_dir):
    """Documents that hold a text, newest (largest id) first, fifty of them, with the total."""
    return reviews.search_notes(table(spark, sf_dir, "documents"), "licensed", 50, "doc_id", ["text", "source"]).select("doc_id", "source", "total")


def search_transcripts(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), (F.col("turn") + 1).alias("line"), F.col("role").alias("speaker"), "text")
    return reviews.search_transcripts(t, "tion th")


def inbox(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("sender"), "text", (F.col("turn") % 2 == 1).alias("read"), F.when(F.col("turn") % 4 == 0, F.concat(F.lit("assist-"), F.col("conv_id").cast("string"))).alias("file"))
    return reviews.filter_inbox(m, unread=True, query="Assist").select("conv_id", "turn", "sender")


def outcomes(spark, sf_dir):
    a = attempts(spark, sf_dir)
    produced = F.when(F.col("k") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("text"), F.lit("links")))
    missing = F.when(F.col("k") % 5 == 0, F.array(F.lit("images"))).otherwise(F.array().cast("array<string>"))
    out = ops.classify_outcome(a.withColumns({"ok": F.col("result") != "failed", "produced": produced, "missing": missing}), "ok", "produced", "missing", "warning_codes")
    return out.select("attempt_id", "outcome")


def described_errors(spark, sf_dir):
    out = ops.describe_errors(attempts(spark, sf_dir).where("result = 'failed'"))
    return out.select("attempt_id", "described", F.coalesce("known_stage", F.lit("-")).alias("known_stage"), "retryable")


def unknown_warnings(spark, sf_dir):
    return ops.unknown_warnings(attempts(spark, sf_dir), "warning_codes", "attempt_id").groupBy("warning").agg(F.count(F.lit(1)).alias("n"))


def public_states(spark, sf_dir):
    a = attempts(spark, sf_dir)
    state = F.when(a["kind"] == "click", "leased").when(a["kind"] == "view", "fetched").when(a["kind"] == "error", "blocked").when(a["kind"] == "signup", "excluded")
    return a.withColumn("state", ops.public_state(state)).groupBy("kind", "state").agg(F.count(F.lit(1)).alias("n"))


def redirects(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    final = F.when(F.col("url").contains("#top"), F.regexp_extract("url", "^(https?://[^/]*/)", 1)).when(F.col("url").contains("ref=x"), F.regexp_replace("url", "://", "://other.")).when(F.col("url").startswith("http:"), F.regexp_replace("url", "://", "://www.")).otherwise(F.col("url"))
    hops = F.when(F.col("url").contains("utm"), F.array("url", F.lit("a"), "url")).otherwise(F.array("url", F.lit("b")))
    out = ops.redirect_flags(p.withColumns({"final": final, "hops": hops}), "url", "final", "hops")
    return out.select("page_id", "redirected", "to_root", "off_site", "n_hops", "redirect_loop")


def scoped_documents(spark, sf_dir):
    from loomledger.operators import ledger

    docs = table(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", F.lit("corpus"), "source", "lang", F.col("doc_id").cast("string")))
    return ledger.filter_scope(docs, "path", "corpus/src1").select("doc_id", "path")


def dated_events(spark, sf_dir):
    from loomledger.operators import ledger

    return ledger.filter_dates(table(spark, sf_dir, "events"), "ts", "2024-01-05", "2024-01-09").select("event_id", "event_type")


_VISIBLE = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?is)<noscript\b.*?</noscript>', ' ', 'g'), '(?is)<template\b.*?</template>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
_TERMS = r"SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS term FROM documents) WHERE length(term) BETWEEN 2 AND 24 AND NOT regexp_matches(term, '^[0-9]+$') AND term NOT IN (" + ", ".join(f"'{w}'" for w in ops.STOP_WORDS) + ") GROUP BY doc_id, term"
_CONTENT = r"sha256(trim(regexp_replace(text, '\s+', ' ', 'g')))"


def _error_sql() -> str:
    title = "lower(regexp_extract(text, '^([^\\n]*)', 1))"
    head = "substr(lower(text), 1, 400)"
    cases = [(p, "title", title) for p in _PHRASES] + [(p, "head", head) for p in _PHRASES]
    pick = lambda value: "CASE " + " ".join(f"WHEN contains({c}, '{p}') THEN {value(p, w, c)}" for p, w, c in cases) + " END"
    return f"""SELECT * FROM (SELECT doc_id, {pick(lambda p, w, c: f"'{p}'")} AS phrase, {pick(lambda p, w, c: f"'{w}'")} AS found_in, CAST({pick(lambda p, w, c: f"strpos({c}, '{p}') - 1")} AS INTEGER) AS "offset" FROM documents) WHERE phrase IS NOT NULL"""


_PARTIAL = ", ".join(f"'{w}'" for w, p in ops.WARNINGS.items() if p)
_CODES = ", ".join(f"('{c}', '{s}', {str(c in ops.RETRYABLE).lower()})" for s, cs in ops.ERRORS.items() for c in cs)
_SPLIT = r"string_split_regex(lower(text), '[^\p{L}\p{N}]+')"

QUERIES = {
    "ht02_visible_text": visible_text,
    "ht04_outgoing_links": outgoing_links,
    "ht06_declared_count": declared_count,
    "tx01_term_counts": term_counts,
    "ag11_top_words": top_words,
    "tx02_content_hash": content_hash,
    "ag14_content_groups": content_groups,
    "tx03_error_page": error_page,
    "tx04_text_flags": text_flags,
    "tx05_challenge": challenge,
    "tx06_clean_turns": clean_turns,
    "tx07_lint_rules": lint_rules,
    "tx08_out_of_corpus": out_of_corpus,
    "tx09_odd_pairs": odd_pairs,
    "tx12_preview": preview,
    "tx13_required_words": required_words,
    "fl08_search_notes": search_notes,
    "fl09_search_transcripts": search_transcripts,
    "fl06_inbox": inbox,
    "fl04_scoped_documents": scoped_documents,
    "fl03_dated_events": dated_events,
    "oc01_outcomes": outcomes,
    "oc02_described_errors": described_errors,
    "oc03_unknown_warnings": unknown_warnings,
    "oc04_public_states": public_states,
    "oc05_redirects": redirects,
}

ORACLE = {
    "ht02_visible_text": f"SELECT page_id, sha256({_VISIBLE}) AS text_hash, CAST(length({_VISIBLE}) AS INTEGER) AS chars FROM pages",
    "ht04_outgoing_links": "SELECT DISTINCT page_id, href FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)href=[\"'']([^\"'']+)[\"'']', 1)) AS href FROM pages) WHERE NOT regexp_matches(href, '(?i)^(#|javascript:|mailto:|tel:|data:)')",
    "ht06_declared_count": r"SELECT doc_id, TRY_CAST(replace(d, ',', '') AS BIGINT) AS declared FROM (SELECT doc_id, regexp_extract(substr(format('{:,}', n_chars) || ' items ' || text, 1, 3000), '(?i)([0-9,]+)\s*(?:items|products|results)\b', 1) AS d FROM documents)",
    "tx01_term_counts": _TERMS,
    "ag11_top_words": f"SELECT term, CAST(sum(n) AS BIGINT) AS n FROM ({_TERMS}) GROUP BY term ORDER BY n DESC, term LIMIT 20",
    "tx02_content_hash": f"SELECT doc_id, {_CONTENT} AS content_hash FROM documents",
    "ag14_content_groups": f"SELECT {_CONTENT} AS content_hash, count(*) AS members, min(doc_id) AS first_key, max(doc_id) AS last_key FROM documents GROUP BY 1 HAVING count(*) >= 2",
    "tx03_error_page": _error_sql(),
    "tx04_text_flags": "SELECT lang, count(*) FILTER (length(text) = 0) AS empty, count(*) FILTER (length(text) BETWEEN 1 AND 1499) AS thin, count(*) AS n FROM documents GROUP BY lang",
    "tx05_challenge": "SELECT page_id, regexp_matches(regexp_extract(html, '<title>([^<]*)</title>', 1) || chr(10) || substr(html, 1, 4000), 'licensed|cheap|moron') AS challenge FROM pages",
    "tx06_clean_turns": r"SELECT conv_id, turn, sha256(regexp_replace(regexp_replace(text || chr(10) || chr(10) || chr(10) || chr(10) || '  ' || chr(10) || '[tool: ' || role || ']', '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS text_hash FROM conversations",
    "tx07_lint_rules": r"SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '(?i)licensed under') THEN 'licence line' END, CASE WHEN regexp_matches(text, '\| [^|]*\|') THEN 'table residue' END, CASE WHEN regexp_matches(text, '###|%%%') THEN 'marks' END, CASE WHEN regexp_matches(text, '(?i)idiot|scum') THEN 'insult' END], lambda r: r IS NOT NULL), ',') AS reasons FROM documents",
    "tx08_out_of_corpus": rf"""
WITH t AS (SELECT DISTINCT doc_id, token FROM (SELECT doc_id, unnest({_SPLIT}) AS token FROM documents) WHERE length(token) >= 2 AND token <> 'the' AND NOT regexp_matches(token, '^[0-9]+$')),
c AS (SELECT string_agg(w, ' ') AS corpus FROM (SELECT DISTINCT unnest({_SPLIT.replace('text', 'p_name')}) AS w FROM part)),
u AS (SELECT DISTINCT token, regexp_extract(token, '^[0-9]+(\p{{L}}{{1,3}})', 1) AS unit, CASE WHEN unicode(token[-1]) BETWEEN 44032 AND 55203 AND (unicode(token[-1]) - 44032) % 28 IN (4, 8, 16) THEN token[:-2] || chr((unicode(token[-1]) - (unicode(token[-1]) - 44032) % 28)::INTEGER) END AS bare FROM t),
f AS (SELECT token, unit, bare, list_filter(list_concat([token, bare, CASE WHEN regexp_matches(token, '..s$') THEN left(token, -1) END, CASE WHEN regexp_matches(token, '..(es|ed)$') THEN left(token, -2) END, CASE WHEN regexp_matches(token, '..ing$') THEN left(token, -3) END], list_transform(range(2, length(token)), lambda i: left(token, i))), lambda x: x IS NOT NULL) AS forms FROM u),
h AS (SELECT token FROM f, c WHERE (unit <> '' AND contains(corpus, unit)) OR len(list_filter(forms, lambda x: contains(corpus, x))) > 0)
SELECT doc_id, t.token, CASE WHEN regexp_matches(t.token, '{ops.INFLECTED}') OR bare IS NOT NULL THEN 'soft' ELSE 'missing' END AS verdict FROM t JOIN f ON f.token = t.token WHERE t.token NOT IN (SELECT token FROM h)""",
    "tx09_odd_pairs": rf"""
WITH b AS (SELECT item_id, list_filter({_SPLIT}, lambda w: w <> '') AS w FROM benchmark), d AS MATERIALIZED (SELECT list_filter({_SPLIT}, lambda w: w <> '') AS w FROM documents),
bp AS MATERIALIZED (SELECT DISTINCT item_id, w[i] AS first, w[i + 1] AS second FROM (SELECT item_id, w, unnest(range(1, len(w))) AS i FROM b)),
dp AS MATERIALIZED (SELECT DISTINCT p[1] AS first, p[2] AS second FROM (SELECT unnest(list_zip(w[1:-2], w[2:])) AS p FROM d WHERE len(w) > 1)), k AS MATERIALIZED (SELECT DISTINCT unnest(w) AS w FROM d)
SELECT bp.item_id, bp.first, bp.second FROM bp SEMI JOIN k ON bp.first = k.w SEMI JOIN k AS k2 ON bp.second = k2.w ANTI JOIN dp ON bp.first = dp.first AND bp.second = dp.second""",
    "tx12_preview": "SELECT doc_id, substr(trim(list_extract(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> ''), 1)), 1, 60) AS preview FROM documents",
    "tx13_required_words": "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{w}') THEN '{w}' END" for w in _WORDS) + "], lambda w: w IS NOT NULL), ',') AS matched, NOT (" + " OR ".join(f"contains(lower(text), '{w}')" for w in _WORDS) + ") AS review_required FROM documents",
    "fl08_search_notes": "SELECT doc_id, source, count(*) OVER () AS total FROM documents WHERE contains(lower(text), 'licensed') OR contains(source, 'licensed') ORDER BY doc_id DESC LIMIT 50",
    "fl09_search_transcripts": r"SELECT conv_id AS file, turn + 1 AS line, role AS speaker, substr(t, greatest(1, strpos(lower(t), 'tion th') - 20), 60) AS snippet FROM (SELECT *, regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM conversations) WHERE contains(lower(t), 'tion th')",
    "fl06_inbox": "SELECT conv_id, turn, role AS sender FROM conversations WHERE turn % 2 = 0 AND (contains(lower(text), 'assist') OR contains(role, 'assist') OR turn % 4 = 0)",
    "fl04_scoped_documents": "SELECT doc_id, 'corpus/' || source || '/' || lang || '/' || doc_id AS path FROM documents WHERE source = 'src1'",
    "fl03_dated_events": "SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-10'",
    "oc01_outcomes": f"SELECT attempt_id, CASE WHEN result = 'failed' OR k % 7 = 0 THEN 'failed' WHEN k % 5 = 0 OR len(list_filter(warning_codes, lambda w: w IN ({_PARTIAL}))) > 0 THEN 'partial' ELSE 'success' END AS outcome FROM ({ATTEMPTS_SQL})",
    "oc02_described_errors": f"WITH v(code, stage, retryable) AS (VALUES {_CODES}) SELECT attempt_id, coalesce(error_stage, stage, '?') || '/' || coalesce(error_code, '?') AS described, coalesce(stage, '-') AS known_stage, coalesce(retryable, false) AS retryable FROM ({ATTEMPTS_SQL}) a LEFT JOIN v ON a.error_code = v.code WHERE result = 'failed'",
    "oc03_unknown_warnings": f"SELECT warning, count(*) AS n FROM (SELECT unnest(warning_codes) AS warning FROM ({ATTEMPTS_SQL})) WHERE warning = 'not_a_warning' GROUP BY warning",
    "oc04_public_states": f"SELECT kind, CASE kind WHEN 'click' THEN 'queued' WHEN 'view' THEN 'fetched' WHEN 'error' THEN 'fetched' ELSE 'known_deferred' END AS state, count(*) AS n FROM ({ATTEMPTS_SQL}) GROUP BY 1, 2",
    "oc05_redirects": r"""
WITH p AS (SELECT page_id, url, CASE WHEN contains(url, '#top') THEN regexp_extract(url, '^(https?://[^/]*/)', 1) WHEN contains(url, 'ref=x') THEN replace(url, '://', '://other.') WHEN starts_with(url, 'http:') THEN replace(url, '://', '://www.') ELSE url END AS f FROM pages),
h AS (SELECT *, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS up, regexp_extract(f, '^https?://[^/?#]*([^?#]*)', 1) AS fp, regexp_extract(url, '\?([^#]*)', 1) AS uq, regexp_extract(f, '\?([^#]*)', 1) AS fq FROM p)
SELECT page_id, url <> f AS redirected, NOT (up IN ('', '/') AND uq = '') AND fp IN ('', '/') AND fq = '' AS to_root,
  regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), '^www\.', '') <> regexp_replace(lower(regexp_extract(f, '^https?://([^/?#]*)', 1)), '^www\.', '') AS off_site,
  CAST(CASE WHEN contains(url, 'utm') THEN 3 ELSE 2 END AS INTEGER) AS n_hops, contains(url, 'utm') AS redirect_loop FROM h""",
}
