"""Text operators: visible text, terms, fingerprints, observations, transcripts, phrase rules, vocabulary checks, outcomes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that say nothing about a page.
STOP_WORDS = ("그리고", "그러나", "있습니다", "합니다", "입니다", "수", "및", "등", "더", "이", "그", "저", "the", "and", "for", "with", "you", "your", "this", "that", "from", "are", "our", "all")

# Phrases of error pages, in the order in which they are tried.
ERROR_PAGE_PHRASES = (
    "something went wrong", "whoops", "page not found", "404 not found", "not found",
    "oops", "an error occurred", "temporarily unavailable", "service unavailable",
    "페이지를 찾을 수 없", "오류가 발생", "잘못된 접근", "일시적인 오류", "존재하지 않는 페이지",
)
ERROR_HEAD, THIN_CHARS = 400, 1500

# Warnings and whether they make a result partial.
WARNINGS = {
    "redirected": False, "http_error_status": False, "error_page_text_detected": False, "empty_text": False, "thin_text": False, "charset_unsupported": False,
    "robots_disallowed": False, "blocked_page_suspected": False, "subresource_blocked": False, "images_not_requested_by_browser": False, "image_mime_mismatch": False,
    "browser_no_pinned_connection": False, "response_truncated": True, "image_fetch_partial": True, "image_fetch_none": True, "images_over_limit": True,
    "image_scan_capped": True, "screenshot_truncated": True, "scroll_limit_reached": True,
}

# Error codes by stage, and those for which another try may help.
ERRORS = {
    "input": ("bad_mode", "bad_output", "no_outputs", "output_not_in_mode", "unsupported_output", "stale_lease", "lease_expired", "worker_mismatch"),
    "url": ("url_scheme", "url_userinfo", "url_unparsable", "url_no_host"),
    "policy": ("ip_loopback", "ip_private", "ip_link_local", "ip_unspecified", "ip_multicast", "ip_reserved", "ip_documentation", "ip_shared_cgnat", "ip_benchmark", "ip_nat64", "hostname_localhost", "resolves_to_non_public", "no_public_address"),
    "connect": ("remote_address_mismatch", "connect_timeout", "econnrefused", "econnreset", "ehostunreach", "enetunreach", "etimedout"),
    "dns": ("dns_ENOTFOUND", "dns_EAI_AGAIN", "dns_empty", "dns_failed"),
    "pace": ("queue_too_long", "domain_sleeping"),
    "response": ("headers_timeout", "overall_timeout"),
    "body": ("body_timeout", "decode_failed"),
    "redirect": ("redirect_loop", "too_many_redirects", "redirect_no_location", "bad_location"),
    "deps": ("playwright_not_found", "playwright_shape"),
    "navigate": ("goto_failed", "no_response"),
    "browser": ("browser_failed",),
    "collector": ("collector_threw",),
    "request": ("unknown",),
}
RETRYABLE = (
    "lease_expired", "dns_EAI_AGAIN", "dns_empty", "dns_failed", "queue_too_long", "domain_sleeping", "connect_timeout", "econnrefused", "econnreset", "ehostunreach",
    "enetunreach", "etimedout", "headers_timeout", "body_timeout", "overall_timeout", "goto_failed", "no_response", "browser_failed", "unknown",
)

# How screens of a terminal read, most telling first.
SCREEN_MARKER = r"esc to interrupt|Working \("
SCREEN_RULES = (("blocked", "Do you want to"), ("capacity", "is at capacity"), ("done", "Context compacted"), ("stuck-input", r"(?m)^\s*❯[^\S\n]+\S"), ("stuck-input", "to queue message"))
SCREEN_DONE = ((r"(✻|⏺) [\p{L}]+ for [0-9]+[hms]", r"(?m)^\s*❯[^\S\n]*$"), ("Worked for [0-9]+[hms]", r"Ask Codex to do anything|› Implement \{feature\}"))

# How a reader's header in front of Markdown reads.
READER_MARK = r"^Markdown Content:[^\S\n]*$"
READER_LINES = r"(?:[^\S\n]*\n|(?:Title|URL Source|Published Time|Warning|Images|Links|Description)\s*:[^\n]*\n)+"

# Marks of bot checks.
CHALLENGE_MARKS = (
    "Sorry, you have been blocked", "Checking your browser before accessing", "cf-browser-verification", "Just a moment...", "__cf_chl_",
    "Attention Required! | Cloudflare", "Enable JavaScript and cookies to continue",
)


def visible(html: Column) -> Column:
    """Text without comments, scripts, styles, noscripts, templates and tags, white space collapsed."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in ("script", "style", "noscript", "template"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "<[^>]+>", " "), r"\s+", " "))


def visible_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add text and chars."""
    return pages.withColumn("text", visible(F.col(html))).withColumn("chars", F.length("text"))


def outgoing_links(df: DataFrame, body: str, markdown: bool = False) -> DataFrame:
    """One row (column href) for each distinct link of a body; fragments, javascript, mailto, tel and data are left out."""
    b = F.col(body)
    if markdown:
        named = F.regexp_extract_all(b, F.lit(r"(?<!!)\[[^\]]*\]\(([^)\s]+)"), F.lit(1))
        bare = F.regexp_extract_all(F.regexp_replace(b, r"\]\([^)]*\)", " "), F.lit(r"(https?://[^\s<>\"')\]]+)"), F.lit(1))
        found = F.concat(named, bare)
    else:
        found = F.regexp_extract_all(b, F.lit("(?i)href=[\"']([^\"']+)[\"']"), F.lit(1))
    kept = F.filter(F.array_distinct(found), lambda h: ~h.rlike("(?i)^(#|javascript:|mailto:|tel:|data:)"))
    return df.select("*", F.explode(kept).alias("href"))


def declared_count(df: DataFrame, text: str) -> DataFrame:
    """Add declared: the number of items that a text's first 3000 characters state."""
    head = F.substring(text, 1, 3000)
    korean = F.regexp_extract(head, r"(?:총|전체)\s*([0-9,]+)\s*(?:개|건)", 1)
    english = F.regexp_extract(head, r"(?i)([0-9,]+)\s*(?:items|products|results)\b", 1)
    found = F.when(korean != "", korean).otherwise(english)
    return df.withColumn("declared", F.when(found != "", F.regexp_replace(found, ",", "").try_cast("long")))


def term_counts(df: DataFrame, text: str, key: str) -> DataFrame:
    """key, term, n: lower-cased words of 2 to 24 characters that aren't all digits or stop words; nothing is cut."""
    words = F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+")).alias("term")
    kept = df.select(key, words).where((F.length("term") >= 2) & (F.length("term") <= 24) & ~F.col("term").rlike("^[0-9]+$") & ~F.col("term").isin(*STOP_WORDS))
    return kept.groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))


def top_words(terms: DataFrame, n: int = 20) -> DataFrame:
    return terms.groupBy("term").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "term").limit(n)


def content_hash(df: DataFrame, body: str, markdown: bool = False, html: bool = True) -> DataFrame:
    """Add content_hash: sha256 of a body's normal form, its visible text (or Markdown without a reader's header), white space collapsed."""
    b = F.col(body)
    if markdown:
        marked = F.regexp_replace(b, r"(?sm)\A.*?" + READER_MARK, "")
        heads = F.regexp_replace(b, r"(?i)\A" + READER_LINES, "")
        text = F.when(b.rlike("(?m)" + READER_MARK), marked).otherwise(heads)
    else:
        text = visible(b) if html else b
    return df.withColumn("content_hash", F.sha2(F.trim(F.regexp_replace(text, r"\s+", " ")), 256))


def content_groups(df: DataFrame, key: str, least: int = 2) -> DataFrame:
    """content_hash, members, first_key of fingerprints with several members. Pre-aggregated: no member list is gathered."""
    return df.groupBy("content_hash").agg(F.count(F.lit(1)).alias("members"), F.min(key).alias("first_key"), F.max(key).alias("last_key")).where(F.col("members") >= least)


def error_page(df: DataFrame, text: str, title: str | None = None, phrases: tuple[str, ...] = ERROR_PAGE_PHRASES, head: int = ERROR_HEAD) -> DataFrame:
    """Add phrase, found_in (title | head) and offset of the first phrase, in the list's order, in the title, else in the text's first characters."""
    lower_title = F.lower(F.coalesce(F.col(title), F.lit(""))) if title else F.lit("")
    lower_head = F.substring(F.lower(F.coalesce(F.col(text), F.lit(""))), 1, head)
    phrase, place, at = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("int")
    for where, column in (("head", lower_head), ("title", lower_title)):
        for p in reversed(phrases):
            hit = F.instr(column, p)
            phrase, place, at = F.when(hit > 0, F.lit(p)).otherwise(phrase), F.when(hit > 0, F.lit(where)).otherwise(place), F.when(hit > 0, hit - 1).otherwise(at)
    return df.withColumns({"phrase": phrase, "found_in": place, "offset": at})


def text_flags(df: DataFrame, text: str, thin: int = THIN_CHARS) -> DataFrame:
    """Add empty_text and thin_text."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    return df.withColumns({"empty_text": n == 0, "thin_text": (n > 0) & (n < thin)})


def challenge(df: DataFrame, text: str, title: str, marks: tuple[str, ...] = CHALLENGE_MARKS) -> DataFrame:
    """Add challenge: any mark in the title or in the first 4000 characters."""
    both = F.concat_ws("\n", F.col(title), F.substring(text, 1, 4000))
    hit = F.lit(False)
    for mark in marks:
        hit = hit | both.contains(mark)
    return df.withColumn("challenge", F.coalesce(hit, F.lit(False)))


def cleaned(text: Column) -> Column:
    """A turn without reminder and local-command spans, blank lines collapsed, trimmed."""
    out = F.regexp_replace(text, r"(?s)<system-reminder>.*?</system-reminder>", "")
    out = F.regexp_replace(out, r"(?s)<local-command-[^>]*>.*?</local-command-[^>]*>", "")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def clean_turns(df: DataFrame, blocks: str = "blocks", thinking: bool = False, results: bool = False) -> DataFrame:
    """Add text to turns of typed blocks (array of type, text, name): text blocks, tools as [tool: name]; empty turns are dropped."""
    kept = F.filter(blocks, lambda b: b["type"].isin(*(["text", "tool_use"] + ["thinking"] * thinking + ["tool_result"] * results)))
    shown = F.transform(kept, lambda b: F.when(b["type"] == "tool_use", F.concat(F.lit("[tool: "), F.coalesce(b["name"], F.lit("?")), F.lit("]"))).otherwise(F.coalesce(b["text"], F.lit(""))))
    return df.withColumn("text", cleaned(F.array_join(shown, "\n"))).where("text <> ''")


def lint_rules(df: DataFrame, rules: list[tuple[str, str]], text: str) -> DataFrame:
    """Add reasons: of every rule (regular expression, reason) that matches, its reason, in the rules' order."""
    reasons = F.filter(F.array(*(F.when(F.col(text).rlike(pattern), F.lit(reason)) for pattern, reason in rules)), lambda r: r.isNotNull())
    return df.withColumn("reasons", F.array_distinct(reasons))


# Endings of inflected words, Korean ones as one letter, English ones as several; final consonants that endings leave behind, as places in a syllable's 28 endings.
INFLECTED = "(다|요|죠|까|니|고|며|면|서|지|게|나|자|라|어|아|여|워|해|돼|임|음|기|은|는|을|를|이|가|에|의|와|과|도|만)$|..(s|es|ed|ing)$"
CODAS = (4, 8, 16)


def _without_coda(word: Column) -> Column:
    """A word without its last syllable's final consonant, if that is one of CODAS; else null."""
    last = F.substring(word, -1, 1)
    code = F.conv(F.hex(F.encode(last, "UTF-16BE")), 16, 10).cast("long") - 0xAC00
    open_ = F.decode(F.unhex(F.hex(code - code % 28 + 0xAC00)), "UTF-16BE")
    return F.when(code.between(0, 11171) & (code % 28).isin(*CODAS), F.concat(F.substring(word, F.lit(1), F.length(word) - 1), open_))


def _runs(word: Column, most: int) -> Column:
    """The runs of one to most letters in a word."""
    none = F.array().cast("array<string>")

    def of(n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(word) - (n - 1), F.lit(1)))
        return F.when(F.length(word) >= n, F.transform(places, lambda i: F.substring(word, i, F.lit(n)))).otherwise(none)

    return F.concat(*(of(n) for n in range(1, most + 1)))


def out_of_corpus(df: DataFrame, corpus: DataFrame, text: str, key: str, corpus_text: str = "text", allow: tuple[str, ...] = (), inflected: str = INFLECTED) -> DataFrame:
    """key, token, verdict of a text's words of which the corpus holds no form as part of any word: soft where the word is inflected (it matches the expression, or ends in a final consonant that an ending leaves), else missing.

    A word's forms are itself, itself without an ending or a final consonant, and its beginnings of two letters or more. All of them begin
    with its first two letters, and those are one of the forms, except that a word of two letters has one more: its second letter without the
    final consonant. So a word passes where the corpus has one of these pairs side by side: the corpus is met through its distinct runs of one to three letters, an equality
    join. A number with a unit of up to three letters passes where the corpus has the unit; numbers and allowed words always pass."""
    split = lambda c: F.split(F.lower(c), r"[^\p{L}\p{N}]+")
    tokens = df.select(key, F.explode(F.array_distinct(split(F.col(text)))).alias("_t")).where((F.length("_t") >= 2) & ~F.col("_t").rlike("^[0-9]+$") & ~F.col("_t").isin(*(allow or ("",))))
    words = corpus.select(F.explode(F.array_distinct(split(F.col(corpus_text)))).alias("w")).where("w <> ''").distinct()
    held = words.select(F.explode(_runs(F.col("w"), 3)).alias("run")).distinct()
    unit = F.nullif(F.regexp_extract("_t", r"^[0-9]+(\p{L}{1,3})", 1), F.lit(""))
    asked = F.array_compact(F.array(F.substring("_t", 1, 2), F.when(F.length("_t") == 2, _without_coda(F.col("_t"))), unit))
    known = tokens.select("_t").distinct().select("_t", F.explode(asked).alias("run")).join(held, "run", "left_semi").select("_t").distinct()
    unheld = tokens.join(known, "_t", "left_anti")
    soft = F.col("_t").rlike(inflected) | _without_coda(F.col("_t")).isNotNull()
    return unheld.select(key, F.col("_t").alias("token"), F.when(soft, "soft").otherwise("missing").alias("verdict"))


def odd_pairs(df: DataFrame, corpus: DataFrame, text: str, key: str, corpus_text: str = "text") -> DataFrame:
    """key, first, second: neighbouring words that the corpus has each, but never beside each other."""
    split = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def pairs(frame: DataFrame, *keys: str) -> DataFrame:
        w = frame.select(*keys, F.col("_w"))
        both = F.explode(F.arrays_zip(F.slice("_w", 1, F.greatest(F.size("_w") - 1, F.lit(0))).alias("first"), F.slice("_w", 2, F.greatest(F.size("_w") - 1, F.lit(0))).alias("second"))).alias("p")
        return w.where(F.size("_w") > 1).select(*keys, both).select(*keys, "p.first", "p.second").distinct()

    own = pairs(df.select(key, split(F.col(text)).alias("_w")), key)
    held = corpus.select(split(F.col(corpus_text)).alias("_w"))
    known = held.select(F.explode("_w").alias("first")).distinct()
    met = pairs(held)
    return own.join(known, "first", "left_semi").join(known.withColumnRenamed("first", "second"), "second", "left_semi").join(met, ["first", "second"], "left_anti").select(key, "first", "second")


def screen_state(text: Column) -> Column:
    """working, blocked, capacity, done, stuck-input or unknown."""
    working = text.rlike(SCREEN_MARKER)
    out = F.when(working, "working")
    for state, pattern in SCREEN_RULES:
        out = out.when(text.rlike(pattern), state)
    for worked, idle in SCREEN_DONE:
        out = out.when(text.rlike(worked) & text.rlike(idle), "done")
    return out.otherwise("unknown")


def screen_progress(readings: DataFrame, surface: str = "surface", at: str = "at", text: str = "text") -> DataFrame:
    """Add state: a screen that says working only counts as such when its elapsed time, or the screen, changed since the reading before."""
    order = Window.partitionBy(surface).orderBy(at)
    token = F.regexp_extract(text, r"([0-9]+m? ?[0-9]*s)", 1)
    changed = (F.lag(text).over(order) != F.col(text)) | (F.lag(token).over(order) != token)
    state = screen_state(F.col(text))
    return readings.withColumn("state", F.when((state == "working") & ~F.coalesce(changed, F.lit(True)), "stalled").otherwise(state))


# The first bytes of image formats, in hexadecimal.
IMAGE_MAGIC = (("image/png", "^89504E47"), ("image/jpeg", "^FFD8FF"), ("image/gif", "^47494638"), ("image/webp", "^52494646.{8}57454250"), ("image/bmp", "^424D"), ("image/avif", "^.{8}66747970(61766966|61766973)"), ("image/heic", "^.{8}66747970(68656963|68656978|6D696631)"), ("image/x-icon", "^00000100"))


#: Bytes in which an SVG element has to begin; what may stand before it: a byte order mark, declarations and comments.
SNIFFED = 300
SVG = r"^(\xef\xbb\xbf)?\s*((<\?.*?\?>|<!--(?s:.*?)-->|<!doctype[^>\[]*(\[(?s:.*?)\])?[^>]*>)\s*)*<svg[\s>]"


def sniff_mime(df: DataFrame, content: str, declared: str) -> DataFrame:
    """Add mime, from the first bytes, and mime_mismatch against the declared type."""
    head = F.hex(F.substring(content, 1, 64))
    out = F.lit(None).cast("string")
    for mime, pattern in reversed(IMAGE_MAGIC):
        out = F.when(head.rlike(pattern), mime).otherwise(out)
    # Marks are ASCII: bytes are read one by one, so a letter that is cut in two does no harm.
    svg = F.lower(F.decode(F.substring(content, 1, SNIFFED), "ISO-8859-1")).rlike(SVG)
    out = F.coalesce(out, F.when(svg, "image/svg+xml"))
    plain = F.lower(F.trim(F.regexp_replace(declared, ";.*$", "")))
    return df.withColumn("mime", out).withColumn("mime_mismatch", F.coalesce(F.col("mime") != F.regexp_replace(plain, "^image/jpg$", "image/jpeg"), F.lit(False)))


def preview(body: Column, n: int) -> Column:
    """The first line that isn't blank, cut to n characters."""
    lines = F.filter(F.split(body, "\n"), lambda line: F.trim(line) != "")
    return F.substring(F.trim(F.try_element_at(lines, F.lit(1))), 1, n)


def required_words(df: DataFrame, words: list[str], text: str) -> DataFrame:
    """Add matched (the words a text holds) and review_required (none of them)."""
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    matched = F.filter(F.array(*(F.when(lower.contains(w.lower()), F.lit(w)) for w in words)), lambda w: w.isNotNull())
    return df.withColumn("matched", matched).withColumn("review_required", F.size("matched") == 0)


def classify_outcome(df: DataFrame, ok: str, produced: str, missing: str, warnings: str) -> DataFrame:
    """Add outcome: failed, partial or success."""
    partial = F.array(*(F.lit(w) for w, p in WARNINGS.items() if p))
    out = F.when(~F.col(ok) | (F.size(produced) == 0), "failed").when((F.size(missing) > 0) | F.arrays_overlap(warnings, partial), "partial").otherwise("success")
    return df.withColumn("outcome", out)


def error_vocabulary(spark) -> DataFrame:
    """error_code, stage, retryable: the fixed table."""
    return spark.createDataFrame([(code, stage, code in RETRYABLE) for stage, codes in ERRORS.items() for code in codes], "error_code string, stage string, retryable boolean")


def describe_errors(df: DataFrame, code: str = "error_code", stage: str = "error_stage") -> DataFrame:
    """Add known_stage, retryable and described; unknown codes stay visible."""
    vocabulary = error_vocabulary(df.sparkSession).withColumnsRenamed({"error_code": "_code", "stage": "known_stage"})
    out = df.join(F.broadcast(vocabulary), F.col(code) == F.col("_code"), "left").drop("_code")
    shown = F.concat(F.coalesce(F.col(stage), F.col("known_stage"), F.lit("?")), F.lit("/"), F.coalesce(F.col(code), F.lit("?")))
    return out.withColumn("described", shown).withColumn("retryable", F.coalesce("retryable", F.lit(False)))


def unknown_warnings(df: DataFrame, warnings: str, key: str) -> DataFrame:
    """key and warning of codes that aren't in the vocabulary."""
    return df.select(key, F.explode(warnings).alias("warning")).where(~F.col("warning").isin(*WARNINGS))


def public_state(state: Column) -> Column:
    """known_deferred, queued or fetched."""
    return F.when(state.isin("queued", "leased"), "queued").when(state.isin("fetched", "content_validated", "visual_validated", "needs_visual_review", "invalid", "blocked", "failed_permanent"), "fetched").otherwise("known_deferred")


def redirect_flags(df: DataFrame, requested: str, final: str, hops: str) -> DataFrame:
    """Add redirected, to_root, off_site, n_hops and redirect_loop."""
    from loomledger.functions import urls as U

    a, b = F.col(requested), F.col(final)
    root = lambda u: U.path(u).isin("", "/") & (U.query(u) == "")
    return df.withColumns(
        {
            "redirected": a != b,
            "to_root": ~root(a) & root(b),
            "off_site": ~U.same_host(U.host(a), U.host(b)),
            "n_hops": F.size(hops),
            "redirect_loop": F.size(F.array_distinct(hops)) < F.size(hops),
        }
    )


def parse_names(df: DataFrame, name: str, pattern: str, tags: list[str] | None = None) -> DataFrame:
    """Add name_date, name_month, name_title, name_tag and reject for names by a pattern of {date}, {title} and {tag}."""
    parts = {"{date}": "([0-9]{4}-[0-9]{2}-[0-9]{2})", "{title}": "(.+?)", "{tag}": r"([^\[\]\s]+)"}
    order = re.findall(r"\{(?:date|title|tag)\}", pattern)
    regex = "^" + re.sub(r"\\\{(date|title|tag)\\\}", lambda m: parts["{" + m[1] + "}"], re.escape(pattern)) + "$"
    at = lambda part: F.regexp_extract(name, regex, order.index(part) + 1) if part in order else F.lit(None).cast("string")
    fits = F.col(name).rlike(regex)
    date, tag = at("{date}"), at("{tag}")
    reject = F.when(~F.coalesce(fits, F.lit(False)), "pattern")
    if tags is not None and "{tag}" in order:
        reject = reject.when(~tag.isin(*tags), "unknown_tag")
    if "{date}" in order:
        reject = reject.when(F.try_to_date(date, "yyyy-MM-dd").isNull(), "bad_date")
    out = df.withColumn("reject", reject)
    good = F.col("reject").isNull()
    return out.withColumns({"name_date": F.when(good, date), "name_month": F.when(good, F.substring(date, 1, 7)), "name_title": F.when(good, at("{title}")), "name_tag": F.when(good, tag)})
