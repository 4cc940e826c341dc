"""Queries of the reconciliation operators over nation, region, customer, supplier, orders, documents, pages, conversations and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomledger.operators import recon
from loomledger.operators import urls as url_ops
from loomledger.plans import url_queries
from loomledger.sources.tables import PAGE_LINKS_SQL, page_links, table


def disappeared(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    before, after = o.where("o_orderdate < '1997-01-01'"), o.where("o_orderdate >= '1997-01-01'")
    gone = recon.disappeared(before, after, "o_custkey").withColumn("change", F.lit("disappeared"))
    return gone.unionByName(recon.reappeared(before.where("o_totalprice > 300000"), after, "o_custkey").withColumn("change", F.lit("reappeared")))


def artifacts_audited(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("a/"), F.col("l_partkey").cast("string")).alias("path")).agg(F.sum("l_quantity").cast("long").alias("byte_size"), F.max("l_returnflag").alias("sha256"))
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    path = F.when(size > 45, F.concat(F.lit("a/.part-"), key)).when(size == 40, F.concat(F.lit("a/"), key, F.lit("/manifest.json"))).when(size == 39, F.concat(F.lit("artifacts/latest/"), key)).when(size == 38, F.concat(F.lit("a/x.part-1/"), key)).otherwise(F.concat(F.lit("a/"), key))
    part = table(spark, sf_dir, "part").select(path.alias("path"), (size * 20).cast("long").alias("byte_size"), F.lit("R").alias("sha256"))
    files = li.where("byte_size % 3 = 0").unionByName(part.join(li.where("byte_size % 3 = 0").select("path"), "path", "left_anti"))
    return recon.audit_artifacts(li, files).groupBy("finding").agg(F.count(F.lit(1)).alias("n"))


def runs_without_manifest(spark, sf_dir):
    """Orders as runs, finished unless they are open; two in three have written a manifest."""
    o = table(spark, sf_dir, "orders")
    folder = F.concat(F.lit("runs/"), F.col("o_orderkey").cast("string"))
    runs = o.select(F.col("o_orderkey").alias("attempt_id"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("finished_at"), folder.alias("folder"))
    return recon.runs_without_manifest(runs, o.select(F.concat(folder, F.when(F.col("o_orderkey") % 3 == 0, "/page.html").otherwise("/manifest.json")).alias("path")))


def index_reconciled(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    items = docs.select(F.concat_ws("/", F.lit("corpus"), "source", "lang").alias("path")).distinct()
    links = table(spark, sf_dir, "labels").join(docs, "doc_id").where("toxic = 1").select(F.concat(F.lit("corpus/"), "source", F.when(F.col("quality") == 1, F.lit("/")).otherwise("/x/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    matched, missing, stale = recon.reconcile_index(items, links)
    tag = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit(name))
    return tag(matched, "matched").unionByName(tag(missing, "missing")).unionByName(tag(stale, "stale"))


def _settings(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(F.when(F.col("s_acctbal") > 5000, "dev").otherwise("prod").alias("env"), F.concat("n_name", F.when(F.col("s_suppkey") % 3 == 0, "@app").otherwise("")).alias("key")).distinct()


_SETTINGS_SQL = "SELECT DISTINCT CASE WHEN s_acctbal > 5000 THEN 'dev' ELSE 'prod' END AS env, n_name || CASE WHEN s_suppkey % 3 = 0 THEN '@app' ELSE '' END AS key FROM supplier JOIN nation ON s_nationkey = n_nationkey"


def _guide(spark, sf_dir):
    n = table(spark, sf_dir, "nation").where("n_regionkey > 0")
    return n.select(F.col("n_name").alias("key"), (F.lit(100) - F.col("n_nationkey")).alias("rank"), F.when(F.col("n_nationkey") % 3 == 0, True).when(F.col("n_nationkey") % 3 == 1, False).alias("sensitive"))


def _ordered_settings(spark, sf_dir):
    return _settings(spark, sf_dir).withColumn("ord", F.length("key") * 10 + F.ascii(F.substring("key", -1, 1)))


def keys_reconciled(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    schema = n.where("n_nationkey < 20").select(F.col("n_name").alias("key"), (F.col("n_regionkey") < 3).alias("required"))
    example = n.where("n_nationkey between 3 and 22").select(F.col("n_name").alias("key"))
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    services = c.select(F.when(F.col("c_acctbal") > 0, "dev").otherwise("prod").alias("env"), F.col("c_mktsegment").alias("service"), F.col("n_name").alias("key"), F.when(F.col("c_custkey") % 2 == 0, "value").otherwise("sync:false").alias("declared")).distinct()
    return recon.reconcile_keys(schema, example, _ordered_settings(spark, sf_dir), services, n.where("n_regionkey = 4").select(F.col("n_name").alias("key")), _guide(spark, sf_dir))


def first_drift(spark, sf_dir):
    return recon.first_drift(_ordered_settings(spark, sf_dir), _guide(spark, sf_dir))


def scoped_lookup(spark, sf_dir):
    keys = table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.lit("app").alias("app"))
    return recon.scoped_lookup(keys, _settings(spark, sf_dir).where("env = 'dev'"))


def key_difference(spark, sf_dir):
    s = _settings(spark, sf_dir)
    return recon.symmetric_difference(s.where("env = 'dev'"), s.where("env = 'prod'"), "key", table(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_name").alias("key")))


def canonical_order(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    keys = _settings(spark, sf_dir).groupBy("key").agg(F.min("env").alias("env")).withColumn("ord", F.length("key") * 10 + F.ascii(F.substring("key", -1, 1)))
    out = recon.canonical_sort(keys, n.where("n_regionkey > 0").select(F.col("n_name").alias("key"), (F.lit(100) - F.col("n_nationkey")).alias("rank")))
    return out.select("key", "known", "scoped", "rank")


def sections_found(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sections = docs.select(F.col("source").alias("path"), F.col("doc_id").cast("string").alias("address"), F.regexp_extract("text", r"^([^\n]*)", 1).alias("title"))
    ids = docs.select(F.regexp_extract("text", r"^(\S+ \S+ \S+)", 1).alias("id")).where("id <> ''").distinct()
    return recon.lookup_sections(sections, ids).select("id", "matches", "verdict")


def provenance(spark, sf_dir):
    pages = url_ops.canonicalize(table(spark, sf_dir, "pages").select("page_id", "url")).select(F.col("canonical_url").alias("url_id"), F.col("page_id"))
    links = url_ops.canonicalize(page_links(spark, sf_dir), url="href", base="from_url").where("reject is null")
    parents = url_ops.canonicalize(links.select(F.col("from_url").alias("url"), F.col("canonical_url").alias("url_id"), "n")).select("url_id", F.col("canonical_url").alias("parent_id"), "n")
    records = parents.select("url_id", F.when(F.col("n") % 5 == 0, F.lit(None).cast("string")).otherwise(F.concat("parent_id", F.when(F.col("n") == 3, "?lost=1").otherwise(""))).alias("parent_id"), F.when(F.col("n") % 2 == 0, "seed").otherwise("internal_link").alias("source_kind"))
    return recon.check_provenance(records, pages).groupBy("source_kind", "outcome").agg(F.count(F.lit(1)).alias("n"))


def note_sources(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    turns = c.select(F.col("conv_id").alias("file"), (F.col("turn") + 1).alias("line"), "role")
    spot = F.when(F.col("turn") == 0, "").when(F.col("turn") == 1, "x").when(F.col("turn") == 2, "3-1").when(F.col("turn") == 3, "2-3").otherwise(F.col("turn").cast("string"))
    notes = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("note"), (F.col("conv_id") + F.when(F.col("turn") == 5, 1_000_000).otherwise(0)).alias("file"), spot.alias("range"))
    return recon.note_source(notes, turns, 1, 1)


def expanded_queries(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    queries = docs.select(F.regexp_extract("text", r"^(\S+)", 1).alias("input")).where("input <> ''").distinct()
    aliases = docs.select(F.lower(F.regexp_extract("text", r"^(\S+)", 1)).alias("from_term"), F.col("source").alias("to_term")).where("from_term <> ''").distinct()
    return recon.expand_queries(queries, aliases)


def updated_groups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    part = lambda of, shift: docs.select(F.col("doc_id").alias("key"), F.when((F.col("doc_id") + shift) % 7 != 0, F.sha2(F.col(of), 256)).alias("content_hash"))
    after = part("text", 3).withColumn("content_hash", F.when(F.col("key") % 11 == 0, F.lit("other")).otherwise(F.col("content_hash")))
    return recon.update_groups(part("text", 0), after)


def merged_cards(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    cards = o.where("o_orderdate < '1996-01-01'").groupBy(F.col("o_custkey").alias("card_id")).agg(F.lit(1).alias("discovered_cycle"), F.min("o_orderkey").alias("first_seen"), F.max("o_orderkey").alias("last_seen"))
    batch = o.where("o_orderdate >= '1996-01-01'").select(F.col("o_custkey").alias("card_id"), F.col("o_orderkey").alias("seen_at"))
    return recon.merge_cards(cards, batch, 2)


def read_marks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("no"), (F.col("turn") % 2 == 1).alias("read"), F.when(F.col("turn") % 2 == 1, F.col("turn") * 10).alias("read_at"))
    marks = c.select("no", F.explode(F.array(F.struct((F.col("no") % 3 == 0).alias("r"), (F.col("no") + 5).alias("at")), F.struct((F.col("no") % 2 == 0).alias("r"), (F.col("no") + 1).alias("at")))).alias("m")).select("no", F.col("m.r").alias("read"), F.col("m.at").alias("at"))
    return recon.mark_read(c, marks)


QUERIES = {
    "so02_disappeared": disappeared,
    "jn10_artifacts_audited": artifacts_audited,
    "jn11_index_reconciled": index_reconciled,
    "jn12_keys_reconciled": keys_reconciled,
    "jn13_scoped_lookup": scoped_lookup,
    "so03_key_difference": key_difference,
    "tk06_canonical_order": canonical_order,
    "jn18_sections_found": sections_found,
    "jn10_runs_without_manifest": runs_without_manifest,
    "tk06_first_drift": first_drift,
    "jn19_provenance": provenance,
    "jn20_note_sources": note_sources,
    "jn08_expanded_queries": expanded_queries,
    "lt06_updated_groups": updated_groups,
    "lt07_merged_cards": merged_cards,
    "lt08_read_marks": read_marks,
}

_PLAIN = f"(SELECT DISTINCT env, regexp_replace(key, '@.*$', '') AS key FROM ({_SETTINGS_SQL}))"
_DRIFT = f"""stood AS (SELECT env, key, row_number() OVER (PARTITION BY env ORDER BY o, key) AS place, row_number() OVER (PARTITION BY env ORDER BY r IS NULL, r, contains(key, '@'), o, key) AS due
    FROM (SELECT env, key, length(key) * 10 + ascii(key[-1]) AS o, 100 - n_nationkey AS r FROM ({_SETTINGS_SQL}) LEFT JOIN nation ON n_name = regexp_replace(key, '@.*$', '') AND n_regionkey > 0)),
  drift AS (SELECT a.env, a.place, a.key AS found, b.key AS expected FROM stood a JOIN stood b ON a.env = b.env AND a.place = b.due WHERE a.key <> b.key QUALIFY row_number() OVER (PARTITION BY a.env ORDER BY a.place) = 1)"""
_FIRST3 = r"regexp_extract(text, '^(\S+ \S+ \S+)', 1)"
_TITLE = r"regexp_extract(text, '^([^\n]*)', 1)"

ORACLE = {
    "jn19_provenance": f"""WITH l AS (SELECT from_url, {url_queries._LINK_URL} AS u, n FROM ({PAGE_LINKS_SQL}) WHERE href <> ''), p AS (SELECT DISTINCT {url_queries._canonical('url')} AS u FROM pages),
        r AS (SELECT {url_queries._LINK_CANONICAL} AS url_id, CASE WHEN n % 5 = 0 THEN NULL ELSE {url_queries._canonical('from_url')} || CASE WHEN n = 3 THEN '?lost=1' ELSE '' END END AS parent_id, CASE WHEN n % 2 = 0 THEN 'seed' ELSE 'internal_link' END AS source_kind FROM l)
        SELECT source_kind, CASE WHEN source_kind <> 'seed' AND parent_id IS NULL THEN 'needs_parent' WHEN parent_id IS NOT NULL AND parent_id NOT IN (SELECT u FROM p) THEN 'unknown_parent' WHEN url_id IN (SELECT u FROM p) THEN 'known' ELSE 'new' END AS outcome, count(*) AS n FROM r GROUP BY ALL""",
    "so02_disappeared": """SELECT DISTINCT o_custkey, 'disappeared' AS change FROM orders WHERE o_orderdate < DATE '1997-01-01' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '1997-01-01')
        UNION ALL SELECT DISTINCT o_custkey, 'reappeared' FROM orders WHERE o_orderdate < DATE '1997-01-01' AND o_totalprice > 300000 AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '1997-01-01')""",
    "jn10_artifacts_audited": """WITH a AS (SELECT 'a/' || l_partkey AS p, CAST(trunc(sum(l_quantity)) AS BIGINT) AS s, max(l_returnflag) AS h FROM lineitem GROUP BY 1), k AS (SELECT * FROM a WHERE s % 3 = 0),
        f AS (SELECT * FROM k UNION ALL SELECT * FROM (SELECT CASE WHEN p_size > 45 THEN 'a/.part-' || p_partkey WHEN p_size = 40 THEN 'a/' || p_partkey || '/manifest.json' WHEN p_size = 39 THEN 'artifacts/latest/' || p_partkey WHEN p_size = 38 THEN 'a/x.part-1/' || p_partkey ELSE 'a/' || p_partkey END AS p, CAST(p_size * 20 AS BIGINT) AS s, 'R' AS h FROM part) WHERE p NOT IN (SELECT p FROM k))
        SELECT CASE WHEN a.p IS NULL AND contains(f.p, '/.part-') THEN 'incomplete' WHEN a.p IS NULL THEN 'orphan' WHEN f.p IS NULL THEN 'missing' WHEN a.s <> f.s THEN 'size_mismatch' WHEN a.h <> f.h THEN 'sha_mismatch' ELSE 'ok' END AS finding, count(*) AS n FROM a FULL JOIN f ON a.p = f.p WHERE a.p IS NOT NULL OR NOT (ends_with(f.p, '/manifest.json') OR starts_with(f.p, 'artifacts/latest/')) GROUP BY 1""",
    "jn10_runs_without_manifest": "SELECT o_orderkey AS attempt_id FROM orders WHERE o_orderstatus <> 'O' AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0)",
    "tk06_first_drift": f"WITH {_DRIFT} SELECT env, place::INTEGER AS place, found, expected FROM drift",
    "jn11_index_reconciled": """WITH i AS (SELECT DISTINCT 'corpus/' || source || '/' || lang AS p FROM documents), l AS (SELECT DISTINCT 'corpus/' || source || CASE WHEN quality = 1 THEN '/' ELSE '/x/' END || lang || '/' || d.doc_id AS k FROM labels JOIN documents d ON labels.doc_id = d.doc_id WHERE toxic = 1)
        SELECT count(*) AS n, 'matched' AS what FROM i WHERE EXISTS (SELECT 1 FROM l WHERE k = p OR starts_with(k, p || '/')) UNION ALL SELECT count(*), 'missing' FROM i WHERE NOT EXISTS (SELECT 1 FROM l WHERE k = p OR starts_with(k, p || '/'))
        UNION ALL SELECT count(*), 'stale' FROM l WHERE NOT EXISTS (SELECT 1 FROM i WHERE k = p OR starts_with(k, p || '/'))""",
    "jn12_keys_reconciled": f"""WITH s AS (SELECT n_name AS key, n_regionkey < 3 AS required FROM nation WHERE n_nationkey < 20), x AS (SELECT n_name AS key FROM nation WHERE n_nationkey BETWEEN 3 AND 22), p AS {_PLAIN},
        v AS (SELECT DISTINCT CASE WHEN c_acctbal > 0 THEN 'dev' ELSE 'prod' END AS env, c_mktsegment AS service, n_name AS key, CASE WHEN c_custkey % 2 = 0 THEN 'value' ELSE 'sync:false' END AS how FROM customer JOIN nation ON c_nationkey = n_nationkey),
        k AS (SELECT service, key, min(how) FILTER (env = 'dev') AS dev, min(how) FILTER (env = 'prod') AS prod FROM v WHERE service IN (SELECT service FROM v GROUP BY service HAVING count(DISTINCT env) = 2) GROUP BY ALL), {_DRIFT},
        f AS (SELECT 'A' AS "check", key, 'only_a' AS detail FROM s WHERE key NOT IN (SELECT key FROM x) UNION ALL SELECT 'A', key, 'only_b' FROM x WHERE key NOT IN (SELECT key FROM s)
          UNION ALL SELECT 'B', s.key, e.env FROM s, (SELECT DISTINCT env FROM p) e WHERE required AND NOT EXISTS (SELECT 1 FROM p WHERE p.env = e.env AND p.key = s.key)
          UNION ALL SELECT DISTINCT 'C', key, env || '/' || service FROM v WHERE key NOT IN (SELECT key FROM s)
          UNION ALL SELECT DISTINCT 'D', service, CASE WHEN env = 'dev' THEN 'only_a' ELSE 'only_b' END FROM v WHERE service NOT IN (SELECT service FROM v v2 WHERE v2.env <> v.env)
          UNION ALL SELECT 'D', key, service || CASE WHEN dev IS NULL THEN ': only prod' WHEN prod IS NULL THEN ': only dev' ELSE ': dev ' || dev || ', prod ' || prod END FROM k WHERE dev IS DISTINCT FROM prod
          UNION ALL SELECT DISTINCT 'F', key, CASE WHEN n_name IS NULL THEN 'not_in_guide' WHEN n_nationkey % 3 = 0 THEN 'secret_as_value' ELSE 'public_as_secret' END FROM v LEFT JOIN nation ON n_name = key AND n_regionkey > 0 WHERE n_name IS NULL OR (n_nationkey % 3 = 0 AND how = 'value') OR (n_nationkey % 3 = 1 AND how = 'sync:false')
          UNION ALL SELECT 'H', found, env || ': expected ' || expected FROM drift
          UNION ALL SELECT 'E', key, env FROM p WHERE key NOT IN (SELECT key FROM s)
          UNION ALL SELECT 'G', key, CASE WHEN env = 'dev' THEN 'only_a' ELSE 'only_b' END FROM p WHERE key NOT IN (SELECT key FROM p p2 WHERE p2.env <> p.env))
        SELECT * FROM f WHERE key NOT IN (SELECT n_name FROM nation WHERE n_regionkey = 4)""",
    "jn13_scoped_lookup": f"WITH d AS (SELECT key FROM ({_SETTINGS_SQL}) WHERE env = 'dev') SELECT n_name AS key, 'app' AS app, n_name || '@app' IN (SELECT key FROM d) AS scoped, n_name || '@app' IN (SELECT key FROM d) OR n_name IN (SELECT key FROM d) AS found FROM nation",
    "so03_key_difference": f"WITH s AS ({_SETTINGS_SQL}) SELECT key, CASE WHEN env = 'dev' THEN 'only_a' ELSE 'only_b' END AS side FROM s WHERE key NOT IN (SELECT key FROM s t WHERE t.env <> s.env) AND key NOT IN (SELECT n_name FROM nation WHERE n_regionkey = 0)",
    "tk06_canonical_order": f"SELECT key, r IS NOT NULL AS known, contains(key, '@') AS scoped, r AS rank FROM (SELECT DISTINCT key FROM ({_SETTINGS_SQL})) LEFT JOIN (SELECT n_name, 100 - n_nationkey AS r FROM nation WHERE n_regionkey > 0) ON regexp_replace(key, '@.*$', '') = n_name",
    "jn18_sections_found": f"""WITH s AS (SELECT lower({_TITLE}) AS t FROM documents), i AS (SELECT DISTINCT {_FIRST3} AS id FROM documents WHERE {_FIRST3} <> ''),
        e AS (SELECT id, count(*) AS n FROM i JOIN s ON lower(id) = t GROUP BY id), p AS (SELECT id, count(*) AS n FROM i JOIN s ON contains(t, lower(id)) WHERE id NOT IN (SELECT id FROM e) GROUP BY id)
        SELECT i.id, coalesce(e.n, p.n, 0) AS matches, CASE coalesce(e.n, p.n, 0) WHEN 1 THEN 'found' WHEN 0 THEN 'missing' ELSE 'ambiguous' END AS verdict FROM i LEFT JOIN e ON i.id = e.id LEFT JOIN p ON i.id = p.id""",
    "jn20_note_sources": r"""WITH t AS (SELECT conv_id AS file, turn + 1 AS line, role FROM conversations), n AS (SELECT conv_id * 1000 + turn AS note, conv_id + CASE WHEN turn = 5 THEN 1000000 ELSE 0 END AS file, CASE turn WHEN 0 THEN '' WHEN 1 THEN 'x' WHEN 2 THEN '3-1' WHEN 3 THEN '2-3' ELSE CAST(turn AS VARCHAR) END AS r FROM conversations),
        p AS (SELECT *, TRY_CAST(regexp_extract(r, '^([0-9]+)(-[0-9]+)?$', 1) AS INTEGER) AS lo, coalesce(TRY_CAST(regexp_extract(r, '^[0-9]+-([0-9]+)$', 1) AS INTEGER), TRY_CAST(regexp_extract(r, '^([0-9]+)$', 1) AS INTEGER)) AS hi FROM n),
        o AS (SELECT *, CASE WHEN file NOT IN (SELECT file FROM t) THEN 'file_missing' WHEN r = '' THEN 'range_missing' WHEN lo IS NULL OR hi < lo THEN 'range_unreadable' ELSE 'ok' END AS outcome FROM p)
        SELECT note, o.file, outcome, t.line, t.role FROM o LEFT JOIN t ON o.file = t.file AND outcome = 'ok' AND t.line BETWEEN lo - 1 AND hi + 1""",
    "jn08_expanded_queries": r"""WITH q AS (SELECT DISTINCT regexp_extract(text, '^(\S+)', 1) AS input FROM documents WHERE regexp_extract(text, '^(\S+)', 1) <> ''), a AS (SELECT DISTINCT lower(regexp_extract(text, '^(\S+)', 1)) AS f, source AS t FROM documents WHERE regexp_extract(text, '^(\S+)', 1) <> '')
        SELECT input, query, bool_and(alias) AS alias FROM (SELECT input, lower(input) AS query, false AS alias FROM q UNION ALL SELECT input, lower(t), true FROM q JOIN a ON lower(input) = f) GROUP BY input, query""",
    "lt06_updated_groups": "SELECT doc_id AS key, CASE WHEN a IS NULL AND b IS NOT NULL THEN 'joined' WHEN a IS NOT NULL AND b IS NULL THEN 'left' WHEN a IS NOT DISTINCT FROM b THEN 'stayed' ELSE 'moved' END AS event FROM (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN text END AS a, CASE WHEN doc_id % 11 = 0 THEN 'other' WHEN (doc_id + 3) % 7 <> 0 THEN text END AS b FROM documents)",
    "lt07_merged_cards": """SELECT coalesce(a.c, b.c) AS card_id, CAST(CASE WHEN a.c IS NOT NULL THEN 1 ELSE 2 END AS INTEGER) AS discovered_cycle, coalesce(a.lo, b.lo) AS first_seen, coalesce(b.hi, a.hi) AS last_seen
        FROM (SELECT o_custkey AS c, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders WHERE o_orderdate < DATE '1996-01-01' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS c, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders WHERE o_orderdate >= DATE '1996-01-01' GROUP BY 1) b ON a.c = b.c""",
    "lt08_read_marks": "SELECT no, no % 3 = 0 AS read, coalesce(CASE WHEN turn % 2 = 1 THEN turn * 10 END, CASE WHEN no % 2 = 0 THEN no + 1 WHEN no % 3 = 0 THEN no + 5 END) AS read_at FROM (SELECT conv_id * 100 + turn AS no, turn FROM conversations)",
}
