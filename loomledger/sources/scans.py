"""Scans: URL lists, judgments, pages as bytes, Markdown, transcripts, sitemaps, robots files, key=value files, task ledgers.

A bad line never disappears: it becomes a reject with its line number and a reason."""

from __future__ import annotations

import re

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomledger.operators.urls import canonicalize
from loomledger.sources.ranges import csv_records, held, numbered_lines
from loomledger.sources.sitemaps import sitemap_rows
from loomledger.sources.tables import checkpointed

# The fields of a URL list's objects, and names of its CSV column, in the order in which they are tried.
URL_FIELDS = ("url", "canonical_url", "link", "href", "address")
SCAN_HEAD = 2048
#: Bytes of a sitemap, inflated, that are read at most.
SITEMAP_BYTES = 50 << 20
_SITEMAP = pa.schema([("file", pa.string()), ("kind", pa.string()), ("at", pa.int32()), ("raw", pa.string()), ("lastmod", pa.string()), ("gzipped", pa.bool_()), ("bytes", pa.int64()), ("entries", pa.int64()), ("error", pa.string()), ("limit_hit", pa.string())])


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1) and content of every line of the files, read in byte ranges."""
    return numbered_lines(spark, path)


def read_url_list(spark: SparkSession, path: str, fmt: str = "jsonl") -> tuple[DataFrame, DataFrame]:
    """(records, rejects): url and line, or line and reason. jsonl: a bare URL, a JSON string or an object a line; csv: a header with a URL column."""
    if fmt == "csv":
        return _read_csv_urls(spark, path)
    lines = text_lines(spark, path)
    c = F.trim("content")
    some = lines.where(c != "")
    fields = F.from_json(c, F.lit(", ".join(f"`{f}` string" for f in URL_FIELDS)))
    as_object = F.coalesce(*(F.when(F.trim(fields[f]) != "", fields[f]) for f in URL_FIELDS))
    parsed = F.try_parse_json(c)
    kind = F.schema_of_variant(parsed)
    url = F.when(c.startswith("{"), as_object).when(c.startswith('"'), F.try_variant_get(parsed, "$", "string")).otherwise(c)
    reason = (
        F.when(c.rlike('^[{"\\[]') & parsed.isNull(), "json_parse")
        .when(c.startswith("{") & as_object.isNull(), "no_url_field")
        .when(c.startswith("[") | (c.startswith('"') & (kind != "STRING")), "not_a_url")
        .when(F.coalesce(F.trim(url), F.lit("")) == "", "empty_url")
    )
    out = some.withColumns({"reason": reason, "url": url})
    return out.where("reason is null").select("file", "line", "url"), out.where("reason is not null").select("file", "line", "reason")


def _read_csv_urls(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """RFC 4180 records, under their first line: quoted cells hold commas, line ends and doubled quotes. A quote that is never closed and another number of cells than the header's are rejects."""
    records, unclosed = csv_records(spark, path)
    cell = r'(?:^|,)("(?:[^"]++|"")*+"|[^",][^,]*+|)'
    cells = F.transform(F.regexp_extract_all("content", F.lit(cell), F.lit(1)), lambda x: F.when(x.startswith('"'), F.regexp_replace(F.regexp_replace(x, '^"|"$', ""), '""', '"')).otherwise(x))
    rows = records.withColumn("cells", cells)
    names = F.transform("cells", lambda x: F.lower(F.trim(x)))
    at = F.coalesce(*(F.when(F.array_position(names, f) > 0, F.array_position(names, f)) for f in URL_FIELDS))
    # A row a file: the first record is the header.
    head = rows.groupBy("file").agg(F.min_by(F.struct("line", F.size("cells").alias("n"), at.cast("int").alias("at")), "line").alias("h"))
    head = held(head.select("file", F.col("h.line").alias("_head"), F.col("h.n").alias("_n"), F.col("h.at").alias("_at")))
    body = rows.join(head, "file").where("line > _head")
    url = F.trim(F.try_element_at("cells", F.col("_at")))
    reason = F.when(F.col("_at").isNull(), "no_url_column").when(F.size("cells") != F.col("_n"), "cell_count").when(F.coalesce(url, F.lit("")) == "", "empty_url")
    out = body.withColumns({"reason": reason, "url": url})
    rejects = out.where("reason is not null").select("file", "line", "reason").unionByName(unclosed.withColumn("reason", F.lit("unclosed_quote")))
    return out.where("reason is null").select("file", "line", "url"), rejects


def read_judgments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of JSON objects, one a line."""
    lines = text_lines(spark, path).where(F.trim("content") != "")
    parsed = F.try_parse_json("content")
    reason = F.when(parsed.isNull(), "json_parse").when(~F.trim("content").startswith("{"), "not_an_object")
    row = F.from_json("content", "item_id bigint, label string, confidence double, evidence_artifact_ids array<bigint>, note string")
    out = lines.withColumns({"reason": reason, "j": row})
    return out.where("reason is null").select("line", "j.*"), out.where("reason is not null").select("line", "reason")


def decode_pages(df: DataFrame, content: str, content_type: str) -> DataFrame:
    """Add text, charset, charset_source (header, meta, default) and charset_fallback to pages of bytes."""
    named = F.lower(F.regexp_extract(F.coalesce(F.col(content_type), F.lit("")), r"(?i)charset\s*=\s*[\"']?([A-Za-z0-9_\-]+)", 1))
    head = F.decode(F.substring(content, 1, SCAN_HEAD), "ISO-8859-1")
    meta = F.lower(F.regexp_extract(head, r"(?i)<meta[^>]+charset\s*=\s*[\"']?\s*([A-Za-z0-9_\-]+)", 1))
    source = F.when(named != "", "header").when(meta != "", "meta").otherwise("default")
    asked = F.when(named != "", named).when(meta != "", meta).otherwise("utf-8")
    out = df.withColumns({"charset_source": source, "_asked": asked})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.drop("_asked").schema)

    def run(batches):
        import codecs

        for batch in batches:
            texts, used, fell = [], [], []
            for raw, name in zip(batch.column(content).to_pylist(), batch.column("_asked").to_pylist(), strict=True):
                try:
                    codecs.lookup(name)
                    fell.append(False)
                except LookupError:
                    name = "utf-8"
                    fell.append(True)
                used.append(name)
                texts.append(None if raw is None else bytes(raw).decode(name, "replace"))
            kept = [c for c in batch.schema.names if c != "_asked"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string()), pa.array(used, pa.string()), pa.array(fell)], names=[*kept, "text", "charset", "charset_fallback"])

    return out.mapInArrow(run, schema + ", text string, charset string, charset_fallback boolean")


#: How a document stands to version control, in the order in which an entry wins.
TRACKING = ("tracked", "untracked", "ignored")


def read_markdown(spark: SparkSession, root: str, listed: DataFrame | None = None, ignored_under: str | None = None) -> DataFrame:
    """path, folder, file_name, text, modified and tracking of every Markdown file under root, node_modules left out, as are folders whose names begin with a dot (Spark's readers skip them; give such a folder as root).

    listed (path, tracking): what version control lists; then only files that it lists are documents, a path that it lists several times has its first status in the order tracked,
    untracked, ignored, another status counts as tracked, and ignored ones count only under the folder ignored_under, if one is given. Without a list all are tracked."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[mM][dD]").text(root, wholetext=True)
    path = F.regexp_replace(F.col("_metadata.file_path"), "^.*?" + re.escape(root.rstrip("/")) + "/", "")
    out = files.select(path.alias("path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("modified")).where(~F.col("path").rlike("(^|/)node_modules/"))
    if listed is None:
        out = out.withColumn("tracking", F.lit("tracked"))
    else:
        status = F.when(F.col("tracking").isin(*TRACKING), F.col("tracking")).otherwise("tracked")
        some = listed.select("path", status.alias("tracking"))
        if ignored_under is not None:
            some = some.where((F.col("tracking") != "ignored") | F.col("path").startswith(ignored_under.rstrip("/") + "/"))
        place = F.array_position(F.array(*map(F.lit, TRACKING)), F.col("tracking"))
        out = out.join(some.groupBy("path").agg(F.min_by("tracking", place).alias("tracking")), "path")
    return out.withColumns({"folder": F.regexp_replace("path", "/?[^/]*$", ""), "file_name": F.regexp_extract("path", "([^/]*)$", 1)})


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """file, line, type, sidechain and blocks of every event of JSONL transcripts; lines that don't parse are skipped, a plain string is one text block."""
    lines = text_lines(spark, path)
    event = F.from_json("content", "type string, isSidechain boolean, message struct<content: string>")
    rows = lines.withColumn("e", event).where("e.type is not null")
    content = F.col("e.message.content")
    blocks = F.from_json(content, "array<struct<type: string, text: string, name: string>>")
    one = F.array(F.struct(F.lit("text").alias("type"), content.alias("text"), F.lit(None).cast("string").alias("name")))
    return rows.select("file", "line", "e.type", F.coalesce("e.isSidechain", F.lit(False)).alias("sidechain"), F.when(content.startswith("["), blocks).otherwise(one).alias("blocks"))


def read_sitemaps(df: DataFrame, body: str, base: str, most_bytes: int = SITEMAP_BYTES) -> tuple[DataFrame, DataFrame]:
    """(files, entries): kind (urlset, sitemapindex, unknown), gzipped, bytes (inflated), entries, error (gunzip_failed, not_a_sitemap, too_large) and limit_hit (max_bytes) of each
    body of bytes, plain or gzip by its first bytes; loc (resolved), raw, lastmod and unresolvable of every entry.

    A body is inflated and taken apart as a stream, so it costs the same memory however much it inflates to; where that is over most_bytes reading stops, and
    the file says so beside the entries that were read. Bodies are read once: the result is kept in a checkpoint."""

    def read(batches):
        for batch in batches:
            for file, raw in zip(batch.column("_base").to_pylist(), batch.column("_body"), strict=True):
                rows = []
                for row in sitemap_rows(raw.as_buffer() if raw.is_valid else b"", most_bytes):
                    rows.append({"file": file} | row)
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=_SITEMAP)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_SITEMAP)

    schema = "file string, kind string, at int, raw string, lastmod string, gzipped boolean, bytes long, entries long, error string, limit_hit string"
    rows = checkpointed(df.select(F.col(base).alias("_base"), F.col(body).alias("_body")).mapInArrow(read, schema))
    files = rows.where("at is null").select("file", "kind", "gzipped", "bytes", "entries", "error", "limit_hit")
    entries = canonicalize(rows.where("at is not null").select("file", "kind", "at", "raw", "lastmod"), "raw", base="file")
    return files, entries.select("file", "kind", "at", "raw", F.col("canonical_url").alias("loc"), "lastmod", F.col("reject").isNotNull().alias("unresolvable"))


def read_robots(df: DataFrame, host: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(rules, sitemaps): host, group_id, agents, rule_type, path in file order; host and sitemap.

    Comments go, consecutive User-agent lines share a group, an empty Disallow allows everything, rules before any agent are for *."""
    lines = df.select(F.col(host).alias("host"), F.posexplode(F.split(text, "\r?\n")).alias("at", "raw"))
    lines = lines.withColumn("raw", F.trim(F.regexp_replace("raw", "#.*$", "")))
    lines = lines.select("host", "at", F.lower(F.trim(F.regexp_extract("raw", "^([^:]+):", 1))).alias("field"), F.trim(F.regexp_extract("raw", "^[^:]+:(.*)$", 1)).alias("value")).where("field <> ''")
    sitemaps = lines.where("field = 'sitemap' and value <> ''").select("host", F.col("value").alias("sitemap"))
    live = lines.where("field in ('user-agent', 'allow', 'disallow')")
    order = Window.partitionBy("host").orderBy("at")
    starts = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(order), F.lit("")) != "user-agent")
    live = live.withColumn("group_id", F.sum(starts.cast("int")).over(order))
    agents = live.where("field = 'user-agent'").groupBy("host", "group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.lower("value").alias("v")))), lambda x: x["v"]).alias("agents"))
    nothing = (F.col("field") == "disallow") & (F.col("value") == "")
    rules = live.where("field <> 'user-agent'").select("host", "group_id", "at", F.when(nothing, "allow").otherwise(F.col("field")).alias("rule_type"), F.when(nothing, "/").otherwise(F.col("value")).alias("path")).where("path <> ''")
    out = agents.join(rules, ["host", "group_id"], "full_outer")
    return out.select("host", "group_id", F.coalesce("agents", F.array(F.lit("*"))).alias("agents"), "rule_type", "path", "at"), sitemaps


def _named_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """text_lines of files given by name."""

    def run(batches):
        for batch in batches:
            for path in batch.column("file").to_pylist():
                system, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
                with system.open_input_stream(at, compression=None) as file:
                    rows = re.split("\r?\n", file.read().decode("utf-8-sig", "replace"))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(range(1, len(rows) + 1), pa.int32()), pa.array(rows)], names=["file", "line", "content"])

    names = spark.createDataFrame([(p,) for p in paths], "file string")
    return names.repartition(max(1, len(paths)), "file").mapInArrow(run, "file string, line int, content string")


def read_kv_keys(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, key and line of the first time each key is set. Values are never read into the result.

    path: a file or folder, or a list of files. Spark's own readers skip files whose names begin with a dot, as such files often do: files of a list
    are opened by name, each in a task."""
    if isinstance(path, str):
        lines = text_lines(spark, path)
    else:
        lines = _named_lines(spark, path)
    keyed = lines.where(~F.col("content").rlike(r"^\s*(#|$)")).select("file", "line", F.regexp_extract("content", r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*(?:@[A-Za-z0-9_\-]+)?)\s*=", 1).alias("key")).where("key <> ''")
    return keyed.groupBy("file", "key").agg(F.min("line").alias("line"))


def read_tasks(spark: SparkSession, root: str) -> DataFrame:
    """Tasks from JSON files named number.status.json: the name's status wins over the body's, missing fields get defaults, corrupt files are skipped."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root, wholetext=True)
    rows = files.select(F.col("_metadata.file_name").alias("file"), F.from_json("value", "number int, content string, tag string, depends_on array<int>, priority int, status string, owner string, group_id bigint").alias("t"), F.try_parse_json("value").isNotNull().alias("_ok"))
    named = F.regexp_extract("file", r"\.(pending|in_progress|completed)\.json$", 1)
    number = F.regexp_extract("file", r"^(\d+)", 1)
    out = rows.where("_ok").select(
        F.coalesce("t.number", F.when(number != "", number.cast("int"))).alias("number"),
        F.coalesce("t.content", F.lit("")).alias("content"),
        "t.tag",
        F.coalesce("t.depends_on", F.array().cast("array<int>")).alias("depends_on"),
        F.coalesce("t.priority", F.lit(0)).alias("priority"),
        F.when(named != "", named).otherwise(F.coalesce("t.status", F.lit("pending"))).alias("status"),
        "t.owner",
        "t.group_id",
    )
    return out.where("number is not null").orderBy("number")


def sitemap_seeds(declared: DataFrame, hosts: DataFrame, guesses: tuple[str, ...] = ("/sitemap.xml", "/sitemap_index.xml")) -> DataFrame:
    """url and origin (declared, guess): a host's declared sitemaps, distinct; conventional places only where a host declares none. declared: host, sitemap; hosts: host, root."""
    named = canonicalize(declared.join(hosts, "host"), "sitemap", base="root").where("reject is null").select("host", F.col("canonical_url").alias("url")).distinct()
    bare = hosts.join(named.select("host").distinct(), "host", "left_anti")
    guessed = bare.select("host", F.explode(F.array(*(F.concat(F.regexp_replace("root", "/+$", ""), F.lit(g)) for g in guesses))).alias("url"))
    return named.withColumn("origin", F.lit("declared")).unionByName(guessed.withColumn("origin", F.lit("guess")))

