"""The driver's tables bound to the ledger's logical tables, and checkpoints in the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of df by a checkpoint in spark.checkpoint.dir; where that is unset, in a folder of its own, which only a local master can have."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; timestamps without zone become timestamps once, here."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*(F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes))


def url_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url and line: every page's address as written, with a fragment, and with a tracking parameter."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    bare = F.regexp_extract("url", "^([^#]*)", 1)
    forms = F.array(F.col("url"), F.concat(bare, F.lit("#x")), F.concat(bare, F.when(bare.contains("?"), "&").otherwise("?"), F.lit("utm_source=x")))
    return pages.select("page_id", F.posexplode(forms).alias("form", "url")).select("url", (F.col("page_id") * 3 + F.col("form")).alias("line"))


#: The same, for DuckDB.
URL_RECORDS_SQL = """
SELECT url, page_id * 3 AS line FROM pages
UNION ALL SELECT regexp_extract(url, '^([^#]*)', 1) || '#x', page_id * 3 + 1 FROM pages
UNION ALL SELECT regexp_extract(url, '^([^#]*)', 1) || CASE WHEN contains(regexp_extract(url, '^([^#]*)', 1), '?') THEN '&' ELSE '?' END || 'utm_source=x', page_id * 3 + 2 FROM pages
"""


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, from_url, n (order) and href of every quoted href of every page, comments and scripts included."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.col("url").alias("from_url"), F.posexplode(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))).alias("n", "href"))


PAGE_LINKS_SQL = """
SELECT page_id, from_url, unnest(range(len(h))) AS n, unnest(h) AS href
FROM (SELECT page_id, url AS from_url, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS h FROM pages)
"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collection attempts from events: result by type, warnings and errors by the property k."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    result = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "partial").otherwise("success")
    codes = F.array(*map(F.lit, ("connect_timeout", "dns_ENOTFOUND", "redirect_loop", "body_timeout", "made_up_code")))
    warnings = F.array(*map(F.lit, ("redirected", "thin_text", "response_truncated", "image_fetch_partial", "not_a_warning")))
    failed = F.col("event_type") == "error"
    return e.select(
        F.col("event_id").alias("attempt_id"),
        F.col("user_id").alias("item_id"),
        F.col("ts").alias("started_at"),
        result.alias("result"),
        F.when(failed, F.when(k % 3 == 0, F.lit(None).cast("string")).when(k % 3 == 1, "connect").otherwise("body")).alias("error_stage"),
        F.when(failed, F.element_at(codes, k % 5 + 1)).alias("error_code"),
        F.filter(F.array(F.when(k % 2 == 0, F.element_at(warnings, k % 5 + 1)), F.when(k % 3 == 0, F.element_at(warnings, k % 4 + 1))), lambda w: w.isNotNull()).alias("warning_codes"),
        F.col("value").alias("byte_size"),
        k.alias("k"),
        F.col("event_type").alias("kind"),
    )


ATTEMPTS_SQL = """
SELECT event_id AS attempt_id, user_id AS item_id, ts AS started_at,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'partial' ELSE 'success' END AS result,
  CASE WHEN event_type = 'error' THEN CASE k % 3 WHEN 1 THEN 'connect' WHEN 2 THEN 'body' END END AS error_stage,
  CASE WHEN event_type = 'error' THEN (['connect_timeout', 'dns_ENOTFOUND', 'redirect_loop', 'body_timeout', 'made_up_code'])[k % 5 + 1] END AS error_code,
  list_filter([CASE WHEN k % 2 = 0 THEN (['redirected', 'thin_text', 'response_truncated', 'image_fetch_partial', 'not_a_warning'])[k % 5 + 1] END,
               CASE WHEN k % 3 = 0 THEN (['redirected', 'thin_text', 'response_truncated', 'image_fetch_partial', 'not_a_warning'])[k % 4 + 1] END], lambda w: w IS NOT NULL) AS warning_codes,
  value AS byte_size, k, event_type AS kind
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
"""


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two workers' judgments of each labelled document: item_id, worker_id, label."""
    labels = table(spark, sf_dir, "labels")
    pairs = F.explode(F.array(F.struct(F.lit("quality").alias("worker_id"), F.col("quality").alias("l")), F.struct(F.lit("toxic").alias("worker_id"), F.col("toxic").alias("l"))))
    return labels.select("doc_id", pairs.alias("j")).select(F.col("doc_id").alias("item_id"), "j.worker_id", F.when(F.col("j.l") == 1, "yes").otherwise(F.lit(None).cast("string")).alias("label"))


JUDGMENTS_SQL = """
SELECT doc_id AS item_id, 'quality' AS worker_id, CASE WHEN quality = 1 THEN 'yes' END AS label FROM labels
UNION ALL SELECT doc_id, 'toxic', CASE WHEN toxic = 1 THEN 'yes' END FROM labels
"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks from lineitem: group_id, number, status, priority, depends_on (the task before)."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    li = table(spark, sf_dir, "lineitem").withColumn("number", F.row_number().over(order))
    return li.select(
        F.col("l_orderkey").alias("group_id"),
        "number",
        F.when(F.col("l_linestatus") == "F", "completed").otherwise("pending").alias("status"),
        F.col("l_quantity").cast("int").alias("priority"),
        F.when(F.col("number") > 1, F.array(F.col("number") - 1)).otherwise(F.array().cast("array<int>")).alias("depends_on"),
    )


TASKS_SQL = """
SELECT group_id, number, status, priority, CASE WHEN number > 1 THEN [number - 1] ELSE [] END AS depends_on FROM (
  SELECT l_orderkey AS group_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS number,
    CASE WHEN l_linestatus = 'F' THEN 'completed' ELSE 'pending' END AS status, CAST(trunc(l_quantity) AS INTEGER) AS priority FROM lineitem)
"""
