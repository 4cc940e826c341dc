"""Golden rows of operators that the driver's tables don't exercise."""

import datetime as dt
import gzip
import random

import pytest
from pyspark.sql import functions as F

from loomledger.functions import urls as U
from loomledger.operators import docs as doc_ops
from loomledger.operators import graph, html, ledger, recon, series, stats, text
from loomledger.operators import urls as url_ops
from loomledger.plans import text_queries
from loomledger.sources import scans, sinks


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


CANONICAL = [
    ("HTTP://Example.COM:80/a/?b=2&a=1#x", "http://example.com/a?a=1&b=2"),
    ("https://example.com", "https://example.com/"),
    ("https://example.com./p/", "https://example.com/p"),
    ("https://example.com:8443/p", "https://example.com:8443/p"),
    ("https://example.com/p?utm_source=x&id=3&gclid=1", "https://example.com/p?id=3"),
    ("https://example.com/p?q=a%20b", "https://example.com/p?q=a+b"),
    ("https://example.com/a/../b/./c", "https://example.com/b/c"),
    ("https://example.com/é", "https://example.com/%C3%A9"),
    ("https://example.com/p?", "https://example.com/p"),
    ("  https://example.com/p  ", "https://example.com/p"),
    ("https://[2001:db8::1]/x", "https://[2001:db8::1]/x"),
]
REJECTED = [("", "empty"), ("   ", "empty"), (None, "empty"), ("not a url", "unparsable"), ("ftp://example.com/", "scheme"), ("javascript:alert(1)", "scheme"), ("https://u:p@example.com/", "userinfo"), ("https://", "unparsable"), ("https://exa mple.com/", "unparsable")]


def test_canonical_urls(spark):
    out = url_ops.canonicalize(spark.createDataFrame([(u,) for u, _ in CANONICAL + REJECTED], "url string")).collect()
    for r, (_, expected) in zip(out, CANONICAL + REJECTED, strict=True):
        assert (r.canonical_url if r.reject is None else r.reject) == expected, r
    again = url_ops.canonicalize(spark.createDataFrame([(c,) for _, c in CANONICAL], "url string"))
    assert [r.canonical_url for r in again.collect()] == [c for _, c in CANONICAL]


def test_relative_urls(spark):
    base = "https://a.example/x/y?z=1"
    cases = {"/p": "https://a.example/p", "q": "https://a.example/x/q", "../r": "https://a.example/r", "//b.example/s": "https://b.example/s", "?t=2": "https://a.example/x/y?t=2", "#top": "https://a.example/x/y?z=1"}
    out = url_ops.canonicalize(spark.createDataFrame([(k, base) for k in cases], "url string, base string"), base="base")
    assert dict(rows(out, "url", "canonical_url")) == cases


def test_ip_classes(spark):
    cases = {
        "127.0.0.1": "loopback", "10.1.2.3": "private", "172.16.0.1": "private", "172.32.0.1": "public", "192.168.1.1": "private", "169.254.1.1": "link_local", "100.64.0.1": "shared_cgnat", "198.18.0.1": "benchmark",
        "192.0.2.1": "documentation", "224.0.0.1": "multicast", "255.255.255.255": "reserved", "0.0.0.0": "unspecified", "8.8.8.8": "public", "::1": "loopback", "::": "unspecified", "fd00::1": "private", "fe80::1": "link_local",
        "ff02::1": "multicast", "::ffff:10.0.0.1": "private", "::ffff:8.8.8.8": "public", "64:ff9b::1": "nat64", "2001:db8::1": "documentation", "2606:4700::1": "public", "nonsense": None, "300.1.1.1": None,
    }
    out = spark.createDataFrame([(k,) for k in cases], "a string").select("a", U.ip_class(F.col("a")).alias("c"))
    assert dict(rows(out, "a", "c")) == cases


def test_globs(spark):
    out = url_ops.compile_globs(spark.createDataFrame([(p,) for p in ("/a/*", "/**", "a", "", "/a b", "/a?x", "/x*y/z", "/ä")], "pattern string")).collect()
    assert [r.reject for r in out] == [None, None, "no_leading_slash", "empty", "not_a_path", "not_a_path", "mixed_star", "bad_character"]


def test_page_of_needs_a_confirmed_listing(spark):
    data = [("https://a/x?page=3&s=1", "listing", "policy"), ("https://a/x?page=3", "listing", "default"), ("https://a/list/page/4", "listing", "given"), ("https://a/x?offset=40", "listing", "given"), ("https://a/c/7", "listing", "given"), ("https://a/x?p=9", "detail", "given")]
    out = url_ops.page_of(spark.createDataFrame(data, "url string, kind string, kind_source string"), offset_step=20)
    assert rows(out, "series", "page_index") == [("https://a/x?s=1", 3), (None, None), ("https://a/list", 4), ("https://a/x", 3), ("https://a/c", 7), (None, None)]


PAGE = """<!DOCTYPE html><html><head><title> A &amp; B </title><base href="/shop/"><meta property="og:image" content="/og.png"><script>var t="</p>";</script>
<script type="application/ld+json">{"@type":"ItemList","itemListElement":["a","b","c"]}</script></head>
<body><nav><a href="/home">Home</a></nav><main><h1>Title</h1><p>One  two<br>three</p><div hidden>secret</div><p style="display: none">no</p><pre>  a
   b</pre>
<ul><li><a href="p/1"><img src="1.png" alt="first"></a></li><li><a href="p/2?utm_source=x"><img src="2.png"></a></li><li><a href="p/2"><img src="2b.png" srcset="2c.png 1x, 2d.png 2x"></a></li><li><a href="p/3"><img src="i.png" width="10"></a></li></ul>
<a href="#part">part</a><a href="mailto:x@y">mail</a><a>none</a><a href="https://www.other.example/z">other</a><img src="data:image/png;base64,xx"></main></body></html>"""


def test_page_parsing(spark):
    pages = spark.createDataFrame([(1, "https://shop.example/list", PAGE), (2, "https://shop.example/", None)], "page_id long, url string, html string")
    parsed = html.parse_pages(pages)
    body = html.extract_text(parsed).where("page_id = 1").first()
    assert body.title == "A & B" and body.skipped_hidden == 2 and body.skipped_script_style == 2
    assert body.text.split("\n")[:6] == ["Home", "Title", "One two", "three", "  a", "   b"] and "secret" not in body.text
    links = html.extract_links(parsed).orderBy("index").collect()
    assert [(r.kind, r.href, r.landmark) for r in links] == [
        ("http", "https://shop.example/home", "nav"), ("http", "https://shop.example/shop/p/1", "main"), ("http", "https://shop.example/shop/p/2", "main"), ("http", "https://shop.example/shop/p/2", "main"),
        ("http", "https://shop.example/shop/p/3", "main"), ("http", "https://shop.example/shop", "main"), ("non_http", None, "main"), ("no_href", None, "main"), ("http", "https://www.other.example/z", "main"),
    ]
    assert links[1].text == "first" and links[5].fragment_only and not links[8].internal and links[1].internal
    counts = html.link_counts(html.extract_links(parsed)).first()
    assert (counts.total, counts.internal, counts.external, counts.non_http, counts.no_href, counts.fragment_only) == (9, 6, 1, 1, 1, 1)
    images = {(r.kind, r.image): len(r.references) for r in html.extract_images(parsed).collect()}
    assert images[("http", "https://shop.example/og.png")] == 1 and images[("http", "https://shop.example/shop/2c.png")] == 1 and ("data_uri", None) in images
    assert html.jsonld_items(pages).orderBy("page_id").first().jsonld == 3
    _, cards = html.card_groups(parsed)
    assert rows(cards.orderBy("position"), "href", "img") == [("https://shop.example/shop/p/1", "1.png"), ("https://shop.example/shop/p/2", "2.png")]


def test_first_rows_of_keys(spark):
    data = [("a", 3, "x", None), ("a", 1, "y", None), ("a", 2, "z", "f"), (None, 1, "r", None), (None, 2, "s", None), ("b", 5, "q", "g")]
    df = spark.createDataFrame(data, "k string, line int, v string, extra string")
    assert rows(url_ops.first_wins(df, "k", "line").orderBy("k"), "k", "line", "v", "extra", "n_rows") == [("a", 1, "y", None, 3), ("b", 5, "q", "g", 1)]
    assert rows(url_ops.first_wins(df, "k", "line", "extra").orderBy("k"), "k", "line", "v", "extra", "n_rows") == [("a", 1, "y", "f", 3), ("b", 5, "q", "g", 1)]


def test_robots_keep_equal_rows(spark):
    rules = spark.createDataFrame([("a.com", 1, ["*"], "disallow", "/x")], "host string, group_id int, agents array<string>, rule_type string, path string")
    urls = spark.createDataFrame([("https://a.com/x/1", {"k": "v"}), ("https://a.com/x/1", {"k": "v"}), ("https://a.com/y", None), (None, None)], "url string, extra map<string,string>")
    assert sorted((r.url or "", r.allowed) for r in url_ops.robots_decide(urls, rules, "Bot").collect()) == [("", True), ("https://a.com/x/1", False), ("https://a.com/x/1", False), ("https://a.com/y", True)]


def test_words_out_of_the_corpus(spark):
    corpus = spark.createDataFrame([("walk the talk",)], "text string")
    df = spark.createDataFrame([(1, "walkathon zzz qings alk " + "w" * 30)], "id int, text string")
    assert sorted(map(tuple, text.out_of_corpus(df, corpus, "text", "id").collect())) == [(1, "qings", "soft"), (1, "w" * 30, "missing"), (1, "zzz", "missing")]


def test_search_sorts(spark):
    docs = spark.createDataFrame([("a", "f", "a.md", "t", "word", 1, 9, 5, 2), ("b", "f", "b.md", "t", "word", 2, 8, 7, 1)], "path string, folder string, file_name string, title string, text string, modified int, created int, lines int, sections int")
    asked = spark.createDataFrame([("word", False)], "query string, alias boolean")
    for sort, first in (("created", "a"), ("lines", "b"), ("sections", "a"), ("modified", "b"), ("alphabetical", "a")):
        assert doc_ops.search_docs(docs, asked, sort).first().path == first


def test_page_verdicts(spark):
    long = "word " * 100
    data = [
        (1, 200, "https://a/l", "https://a/l", "listing", "T", long, 5, True, 5, 3, False),
        (2, 404, "https://a/l", "https://a/l", "listing", "T", long, 0, False, None, 0, False),
        (3, 200, "https://a/d/1", "https://a/", "detail", "T", long, 0, False, None, 0, True),
        (4, 200, "https://a/d/1", "https://a/d/1", "detail", "T", long, 0, False, None, 0, True),
        (5, 200, "https://a/x", "https://a/x", "unknown", "Whoops", long, 0, False, None, 0, False),
        (6, 200, "https://a/x", "https://a/x", "unknown", "T", "short", 0, False, None, 0, False),
        (7, 200, "https://a/l", "https://a/l", "listing", "T", long, 5, True, 3, 0, False),
    ]
    df = spark.createDataFrame(data, "id int, status int, requested string, final string, kind string, title string, text string, cards int, similar_path boolean, declared int, jsonld int, has_image boolean")
    out = html.page_verdict(df).orderBy("id").collect()
    assert [r.validity for r in out] == ["content_validated", "invalid", "invalid", "content_validated", "invalid", "invalid", "invalid"]
    assert out[0].extraction == "complete" and out[2].negatives == ["redirected_to_root"] and out[6].negatives == ["declared_overcount:3vs5"]


def test_sections(spark):
    source = "# Doc\nintro\n## A\na\n```\n## not\n```\n### A1\n### A2\n## definition\nd\n## 2 B\nb\n"
    lines = doc_ops.doc_lines(spark.createDataFrame([("d.md", source)], "path string, text string"))
    found = doc_ops.sections(lines)
    got = rows(found.orderBy("start_line"), "address", "title", "start_line", "end_line")
    assert got == [("1", "A", 3, 9), ("1-1", "A1", 8, 8), ("1-2", "A2", 9, 9), ("definition", "definition", 10, 11), ("2", "B", 12, 13)]
    assert [r.fenced for r in doc_ops.headers(lines).orderBy("line").collect()] == [False, False, True, False, False, False, False]
    body = doc_ops.section_text(lines, found, spark.createDataFrame([(1, "d.md", "2")], "ord int, path string, address string")).first()
    assert body.text == "## 2 B\nb"


def test_paging(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(20)], "a int, b int")
    seen, cursor = [], None
    while True:
        page, after = doc_ops.page(df, ["a", "b"], 6, {"q": 1}, cursor)
        got = page.collect()
        if not got:
            break
        seen += [tuple(r) for r in got]
        cursor = after(got[-1])
    assert seen == sorted((i % 3, i) for i in range(20))
    with pytest.raises(ValueError):
        doc_ops.page(df, ["a", "b"], 6, {"q": 2}, cursor)


def test_robots(spark):
    source = "# c\nUser-agent: loom\nUser-agent: Other\nDisallow: /private\nAllow: /private/ok\n\nUser-agent: *\nDisallow:\nSitemap: /map.xml # x\nDisallow: /*.pdf$"
    rules, maps = scans.read_robots(spark.createDataFrame([("a.example", source), ("b.example", "Disallow: /")], "host string, text string"), "host", "text")
    assert rows(maps, "host", "sitemap") == [("a.example", "/map.xml")]
    urls = ["https://a.example/private/x", "https://a.example/private/ok/1", "https://a.example/f.pdf", "https://b.example/x", "https://c.example/x"]
    decide = lambda agent: [r.allowed for r in url_ops.robots_decide(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string"), rules, agent).orderBy("i").collect()]
    assert decide("LoomBot") == [False, True, True, False, True]
    assert decide("Zed") == [True, True, False, False, True]
    state = url_ops.robots_state(spark.createDataFrame([("https://a.example/x", False), ("https://b.example/x", False), ("https://c.example/x", False)], "url string, allowed boolean"), spark.createDataFrame([("a.example", 404), ("b.example", 500), ("c.example", 200)], "host string, http_status int"), spark.createDataFrame([("https://a.example/x", False), ("https://b.example/x", False), ("https://c.example/x", False)], "url string, allowed boolean"))
    assert sorted(rows(state, "robots_state", "allowed")) == [("no_file", True), ("read", False), ("unknown", True)]


def test_sitemaps_and_closure(spark):
    index = "<sitemapindex><sitemap><loc>/a.xml</loc></sitemap><sitemap><loc>/b.xml</loc></sitemap><sitemap><loc>/index.xml</loc></sitemap></sitemapindex>"
    a = gzip.compress(b"<urlset><url><loc>https://s.example/1</loc><lastmod>2024-01-01</lastmod></url><url><loc>/2?utm_source=x</loc></url></urlset>")
    b = b"<urlset><url><loc>https://s.example/2</loc></url><url><loc>ftp://x</loc></url></urlset>"
    data = [("https://s.example/index.xml", index.encode()), ("https://s.example/a.xml", a), ("https://s.example/b.xml", b), ("https://s.example/c.xml", b"<html>")]
    files, entries = scans.read_sitemaps(spark.createDataFrame(data, "url string, body binary"), "body", "url")
    assert dict(rows(files, "file", "kind")) == {data[0][0]: "sitemapindex", data[1][0]: "urlset", data[2][0]: "urlset", data[3][0]: "unknown"}
    known = files.select(F.col("file").alias("url"), F.col("file").alias("final_url"), "kind")
    seeds = spark.createDataFrame([("https://s.example/index.xml", "robots"), ("https://s.example/gone.xml", "sitemap")], "url string, kind string")
    opened, urls = graph.sitemap_closure(seeds, known, entries)
    assert {r.url.rsplit("/", 1)[1]: (r.depth, r.outcome) for r in opened.collect()} == {"index.xml": (0, "opened"), "gone.xml": (0, "unreadable"), "a.xml": (1, "opened"), "b.xml": (1, "opened")}
    assert rows(urls, "url", "source_kind", "lastmod", "times") == [("https://s.example/1", "robots", "2024-01-01", 1), ("https://s.example/2", "robots", None, 2)]


def test_scans(spark, tmp_path):
    (tmp_path / "u.jsonl").write_text('https://a/1\n\n"https://a/2"\n{"link":"https://a/3"}\n{"x":1}\n{bad\n[1]\n')
    good, bad = scans.read_url_list(spark, str(tmp_path / "u.jsonl"))
    assert rows(good.orderBy("line"), "line", "url") == [(1, "https://a/1"), (3, "https://a/2"), (4, "https://a/3")]
    assert rows(bad.orderBy("line"), "line", "reason") == [(5, "no_url_field"), (6, "json_parse"), (7, "not_a_url")]
    (tmp_path / "u.csv").write_text('Name,URL\nx,https://a/1\n"y, z","https://a/""2"""\nbad\n"open,https://a/3\nq,\n')
    good, bad = scans.read_url_list(spark, str(tmp_path / "u.csv"), "csv")
    assert rows(good.orderBy("line"), "line", "url") == [(2, "https://a/1"), (3, 'https://a/"2"')]
    assert rows(bad.orderBy("line"), "line", "reason") == [(4, "cell_count"), (5, "unclosed_quote"), (6, "empty_url")]
    (tmp_path / "j.jsonl").write_text('{"item_id":1,"label":"a","evidence_artifact_ids":[1,2]}\n5\n{x\n')
    good, bad = scans.read_judgments(spark, str(tmp_path / "j.jsonl"))
    assert rows(good, "item_id", "label") == [(1, "a")] and rows(bad.orderBy("line"), "line", "reason") == [(2, "not_an_object"), (3, "json_parse")]
    (tmp_path / "dev.env").write_text("# c\nA=1\nexport B=2\nA=3\nA@app=4\n")
    assert rows(scans.read_kv_keys(spark, str(tmp_path / "dev.env")).orderBy("line"), "key", "line") == [("A", 2), ("B", 3), ("A@app", 5)]
    (tmp_path / ".env").write_text("\ufeffTOKEN=x\r\n\nexport NAME=y\nTOKEN=z\n")
    assert rows(scans.read_kv_keys(spark, [str(tmp_path / ".env")]).orderBy("line"), "key", "line") == [("TOKEN", 1), ("NAME", 3)]
    (tmp_path / "md" / "node_modules").mkdir(parents=True)
    (tmp_path / "md" / "a.MD").write_text("# x")
    (tmp_path / "md" / "node_modules" / "b.md").write_text("# y")
    assert rows(scans.read_markdown(spark, str(tmp_path / "md")), "path", "text") == [("a.MD", "# x")]
    (tmp_path / "t.jsonl").write_text('{"type":"user","message":{"content":"hi"}}\nnope\n{"type":"assistant","isSidechain":true,"message":{"content":[{"type":"thinking","text":"t"},{"type":"text","text":"ok"},{"type":"tool_use","name":"run"}]}}\n')
    turns = text.clean_turns(scans.read_transcripts(spark, str(tmp_path / "t.jsonl")))
    assert rows(turns.orderBy("line"), "line", "sidechain", "text") == [(1, False, "hi"), (3, True, "ok\n[tool: run]")]
    (tmp_path / "tasks").mkdir()
    (tmp_path / "tasks" / "2.completed.json").write_text('{"content":"b","status":"pending","depends_on":[1]}')
    (tmp_path / "tasks" / "1.json").write_text('{"number":1}')
    (tmp_path / "tasks" / "3.json").write_text("{broken")
    assert rows(scans.read_tasks(spark, str(tmp_path / "tasks")), "number", "status", "content") == [(1, "pending", ""), (2, "completed", "b")]


def test_charsets(spark):
    data = [(1, "é".encode("latin-1"), "text/html; charset=ISO-8859-1"), (2, b'<meta charset="windows-1252">\x93', None), (3, "é".encode(), "text/html; charset=klingon"), (4, None, None)]
    out = scans.decode_pages(spark.createDataFrame(data, "id int, content binary, content_type string"), "content", "content_type")
    assert rows(out.orderBy("id"), "text", "charset_source", "charset_fallback") == [("é", "header", False), ('<meta charset="windows-1252">“', "meta", False), ("é", "header", True), (None, "default", False)]


def test_sinks(spark, tmp_path):
    data = spark.createDataFrame([(1, "https://a/1", ["x", "y"])], "item_id long, canonical_url string, labels array<string>")
    assert sinks.export_ledger(data, str(tmp_path / "e"), "csv", ["canonical_url", "labels"])["rows"] == 1
    assert (tmp_path / "e").read_bytes() == b'item_id,canonical_url,labels\r\n1,https://a/1,"[""x"",""y""]"\r\n'
    with pytest.raises(ValueError):
        sinks.export_ledger(data, str(tmp_path / "f"), "csv", ["nonsense"])
    with pytest.raises(ValueError):
        sinks.write_snapshot(data, str(tmp_path / "s"), 1, "me", "why", complete=False)
    first = sinks.write_snapshot(data, str(tmp_path / "s"), 1, "me", "why", complete=True).first()
    second = sinks.write_snapshot(data.repartition(3), str(tmp_path / "s"), 2, "me", "why", complete=False, force=True).first()
    assert first.content_hash == second.content_hash and second.forced and first.rows == 1
    sinks.write_batches(ledger.assign_batches(spark.range(10).select(F.col("id").alias("item_id"), F.lit("u").alias("url")), "item_id", 4), str(tmp_path / "b"))
    assert spark.read.json(str(tmp_path / "b")).groupBy("batch_id").count().count() == 3


def test_strict_filters():
    for bad in ({"state": "lost"}, {"source": "rumour:x"}, {"fields": ["nope"]}):
        with pytest.raises(ValueError):
            ledger.validate_filters(**bad)


def test_multi_cap_admission_is_sequential(spark):
    rng = random.Random(4)
    policy = {"domain_url_cap": 15, "path_shape_cap": 4, "query_combo_cap": 3, "faceted_cap": 5, "external_hop_max": 2, "deny_domains": ["bad.example"]}
    data = [(i, f"u{i}", rng.choice(["a.example", "b.example", "x.bad.example"]), rng.choice("ABCDE"), rng.choice(["", "p", "q&r"]), rng.choice([None, "path"]), rng.randrange(4), rng.choice([None, None, "excluded_query_key"])) for i in range(200)]
    schema = "line long, canonical_url string, domain string, shape string, combo string, facet string, hops int, excluded string"
    state, expected = {}, {}
    for line, _, domain, shape, combo, facet, hops, excluded in data:
        s = state.setdefault(domain, {"n": 0, "f": 0, "shape": {}, "combo": {}})
        if domain.endswith("bad.example"):
            why = "denied_domain"
        elif excluded:
            why = excluded
        elif hops > 2:
            why = "external_hop_exceeded"
        elif s["n"] >= 15:
            why = "domain_url_cap"
        elif s["shape"].get(shape, 0) >= 4:
            why = "path_shape_cap"
        elif combo and s["combo"].get(combo, 0) >= 3:
            why = "query_combo_cap"
        elif facet and s["f"] >= 5:
            why = "faceted_cap"
        else:
            why = None
            s["n"] += 1
            s["f"] += bool(facet)
            s["shape"][shape] = s["shape"].get(shape, 0) + 1
            s["combo"][combo] = s["combo"].get(combo, 0) + 1
        expected[line] = why
    records = spark.createDataFrame(data, schema)
    judged = ledger.admit(records, policy)
    assert dict(rows(judged, "line", "why")) == expected
    parked = judged.where("why is not null").drop("why")
    admitted, remaining = ledger.readmit(parked, judged.where("why is null").select("domain", "shape", "combo", "facet"), policy | {"path_shape_cap": 6, "domain_url_cap": 40})
    assert admitted.count() > 0 and remaining.agg(F.sum("remaining")).first()[0] + admitted.count() == parked.count()


def test_dryness_and_pace_equal_their_sequential_forms(spark):
    rng = random.Random(8)
    pages, expected = [], {}
    for s in range(60):
        seen, streak, best, since, last, gaps = set(), 0, 0, None, None, 0
        for i in sorted(rng.sample(range(12), rng.randrange(1, 9))):
            ids, unknown = [rng.randrange(5) for _ in range(rng.randrange(4))], rng.random() < 0.15
            pages.append((s, i, ids, unknown))
            if last is not None and i != last + 1:
                gaps, streak, since = gaps + 1, 0, None
            last = i
            if unknown:
                streak, since = 0, None
            elif set(ids) - seen:
                streak, since = 0, None
            else:
                streak, since = streak + 1, i if since is None else since
                best = max(best, streak)
            seen |= set() if unknown else set(ids)
        expected[s] = (streak, best, streak >= 3, since if streak >= 3 else None, gaps, len(seen))
    out = series.series_dryness(spark.createDataFrame(pages, "series int, index int, emitted array<int>, unknown boolean"))
    assert {r.series: (r.dry_streak, r.longest_dry_streak, r.dry, r.dry_from, r.gaps, r.unique_details) for r in out.collect()} == expected
    requests = [(d, i, rng.randrange(1000) + 40 * i, rng.randrange(1, 90)) for d in range(5) for i in range(40)]
    allowed, after = {}, {}
    for d, i, now, gap in requests:
        at = max(now, after.get(d, 0))
        allowed[d, i], after[d] = at, at + gap
    out = series.pace_schedule(spark.createDataFrame(requests, "d int, i int, now long, gap long"), "d", "now", "i", "gap")
    assert {(r.d, r.i): r.allowed_at for r in out.collect()} == allowed


def test_reports_are_idempotent(spark):
    items = spark.createDataFrame([(1, "leased", "L"), (2, "leased", "M"), (3, "leased", "L")], "item_id long, work_state string, lease_id string")
    attempts = spark.createDataFrame([(1, "success"), (3, "failed")], "item_id long, result string")
    batch = spark.createDataFrame([(1, "good", None), (2, "good", None), (3, "good", None)], "item_id long, label string, reason string")
    none = spark.createDataFrame([], "report_key string")
    after, accepted, rejected = ledger.apply_reports(items, attempts, none, batch, "L")
    assert rows(accepted, "item_id") == [(1,)] and sorted(rows(rejected, "item_id", "why")) == [(2, "not_in_this_lease"), (3, "not_collected")]
    assert sorted(rows(after, "item_id", "work_state")) == [(1, "done"), (2, "leased"), (3, "leased")]
    again = ledger.apply_reports(after, attempts, accepted.select("report_key"), batch.orderBy(F.desc("item_id")), "L")
    assert again[1].count() == 0 and again[2].count() == 0


def test_small_reconciliations(spark):
    entries = spark.createDataFrame([("plain",), ("@label:a",), ("@label:b",), ("@label:c",), ("@label:zz",), ("@label:d",)], "text string")
    labels = spark.createDataFrame([("a", "body a"), ("b", "@file:f"), ("c", "@label:a"), ("d", "@file:gone")], "label string, body string")
    out = recon.resolve_refs(entries, labels, spark.createDataFrame([("f", "file text")], "file string, content string"))
    assert dict(rows(out, "text", "resolved")) == {"plain": "plain", "@label:a": "body a", "@label:b": "file text", "@label:c": "[nested_label: c]", "@label:zz": "[missing_label: zz]", "@label:d": "[missing_file: gone]"}
    groups = recon.expand_groups(spark.createDataFrame([("g", ["a", "q"])], "group string, members array<string>"), labels)
    assert rows(groups.orderBy("place"), "member", "missing") == [("a", False), ("q", True)]
    cards = spark.createDataFrame([(1, 0, "h1", "i1"), (1, 1, "h1", "i1"), (1, 2, None, "i2"), (1, 3, "h9", None)], "page int, position int, href string, img string")
    boxes = spark.createDataFrame([(1, 10, "h1", "i1"), (1, 11, "h1", "i3"), (1, 12, "h2", "i2")], "page int, box int, href string, img string")
    assert rows(recon.match_boxes(cards, boxes).orderBy("position"), "box") == [(10,), (None,), (12,), (None,)]
    state = spark.createDataFrame([(7, 3)], "version long, woken long")
    cycles = spark.createDataFrame([(1, 7)], "cycle int, version long")
    assert recon.cycle_report(state, cycles).count() == 0 and recon.cycle_report(state, cycles.where("false")).first().cycle == 1


def test_completion_names_every_open_measure(spark):
    out = stats.completion(spark.createDataFrame([(0, 0, 0), (0, 112, None)], "queued int, unvisited int, incomplete int")).collect()
    assert [(r.complete, r.reasons) for r in out] == [(True, []), (False, ["unvisited:112", "incomplete:unknown"])]


def test_screens(spark):
    cases = {
        "Working (12s • esc to interrupt)": "working", "Do you want to proceed?": "blocked", "The model is at capacity": "capacity", "Context compacted": "done", "❯ half typed": "stuck-input",
        "✻ Cooked for 14m 11s\n❯ ": "done", "Worked for 3m\nAsk Codex to do anything": "done", "press enter to queue message": "stuck-input", "hello": "unknown",
    }
    out = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.screen_state(F.col("t")).alias("s"))
    assert dict(rows(out, "t", "s")) == cases
    reads = spark.createDataFrame([("a", 1, "Working (1s)"), ("a", 2, "Working (2s)"), ("a", 3, "Working (2s)")], "surface string, at int, text string")
    assert rows(text.screen_progress(reads).orderBy("at"), "state") == [("working",), ("working",), ("stalled",)]


def test_observations(spark):
    df = spark.createDataFrame([(1, "Whoops", "x" * 2000), (2, "fine", "a" * 500 + " not found"), (3, None, "Oops, sorry"), (4, "t", "")], "id int, title string, text string")
    out = text.text_flags(text.error_page(df, "text", "title"), "text").orderBy("id").collect()
    assert [(r.phrase, r.found_in, r.thin_text, r.empty_text) for r in out] == [("whoops", "title", False, False), (None, None, True, False), ("oops", "head", True, False), (None, None, False, True)]
    mime = spark.createDataFrame([(bytearray(b"\x89PNG\r\n\x1a\n0000"), "image/jpeg"), (bytearray(b"\xff\xd8\xff\xe0"), "image/jpg"), (bytearray(b"<svg xmlns='x'>"), "image/svg+xml"), (bytearray(b"??"), "image/png")], "b binary, d string")
    assert rows(text.sniff_mime(mime, "b", "d"), "mime", "mime_mismatch") == [("image/png", True), ("image/jpeg", False), ("image/svg+xml", False), (None, False)]


def test_date_bounds(spark):
    at = [dt.datetime(2024, 1, 5, 23, 59, 59), dt.datetime(2024, 1, 6), None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(at)], "i int, t timestamp")
    assert rows(ledger.filter_dates(df, "t", "2024-01-05", "2024-01-05"), "i") == [(0,)]
    assert ledger.filter_dates(df, "t").count() == 3


def test_host_verdicts_and_seeds(spark):
    hosts = spark.createDataFrame([("a",), ("b",), ("c",)], "host string")
    addresses = spark.createDataFrame([("a", "8.8.8.8"), ("a", "2606:4700::1"), ("b", "8.8.8.8"), ("b", "10.0.0.1")], "host string, address string")
    assert sorted(rows(url_ops.host_verdict(hosts, addresses), "host", "verdict", "addresses")) == [("a", "allowed", 2), ("b", "ip_private", 2), ("c", "no_public_address", 0)]
    declared = spark.createDataFrame([("a", "/m.xml"), ("a", "https://a.example/m.xml")], "host string, sitemap string")
    roots = spark.createDataFrame([("a", "https://a.example/"), ("b", "https://b.example/")], "host string, root string")
    assert sorted(rows(scans.sitemap_seeds(declared, roots), "url", "origin")) == [("https://a.example/m.xml", "declared"), ("https://b.example/sitemap.xml", "guess"), ("https://b.example/sitemap_index.xml", "guess")]


def test_evidence_states(spark):
    artifacts = spark.createDataFrame([(1, 10, "p1", 5, "x"), (2, 10, "p2", 5, "x"), (3, 11, "p3", 5, "x"), (4, 11, "p4", 5, "x")], "artifact_id long, attempt_id long, path string, byte_size long, sha256 string")
    files = spark.createDataFrame([("p1", 5, "x"), ("p2", 6, "x"), ("p3", 5, "y")], "path string, byte_size long, sha256 string")
    out = recon.evidence_states(artifacts, spark.createDataFrame([(10, 100), (11, 101)], "attempt_id long, item_id long"), files)
    assert sorted(rows(out, "artifact_id", "item_id", "state")) == [(1, 100, "ok"), (2, 100, "size_mismatch"), (3, 101, "sha_mismatch"), (4, 101, "missing")]


def test_declared_counts_images_and_runs(spark):
    pages = spark.createDataFrame([("p1", "s", 2), ("p2", "s", 3), ("p3", None, 5), ("p4", "s", 9)], "page string, series string, declared int")
    cards = spark.createDataFrame([("p1", "a"), ("p1", "b"), ("p2", "c"), ("p3", "d")], "page string, card string")
    assert sorted(rows(stats.declared_check(pages, cards), "page", "verdict")) == [("p1", "match"), ("p2", "match"), ("p3", "mismatch"), ("p4", "scope_unknown")]
    images = spark.createDataFrame([(1, "u1", "img", "ok", 10, False, 2), (1, "u2", "meta", "failed", None, False, 1), (2, "u3", "img", "failed", None, True, 1)], "page_id int, url string, origin string, status string, byte_size long, mime_mismatch boolean, n_references int")
    out = stats.image_counts(images).orderBy("page_id").collect()
    assert [(r.unique, r.downloaded, r.failed, r.bytes, r.warnings) for r in out] == [(2, 1, 1, 10, ["image_fetch_partial"]), (1, 0, 1, 0, ["image_fetch_none", "image_mime_mismatch"])]
    files = spark.createDataFrame([("urlset", 1), ("sitemapindex", 0), ("unreadable", 1), ("skipped", 2)], "kind string, depth int")
    run = stats.sitemap_run_counts(files, spark.createDataFrame([("a",), ("a",), ("b",)], "canonical_url string")).first()
    assert (run.opened, run.skipped, run.indexes, run.urlsets, run.unreadable, run.urls, run.duplicates, run.max_depth, run.partial) == (3, 1, 1, 1, 1, 2, 1, 2, True)


def test_waking_details(spark):
    cards = spark.createDataFrame([("c1", "u1", "d", "A", "", None), ("c2", "u2", "d", "A", "", None), ("c3", "u3", "d", "A", "", None), ("c4", None, "d", "A", "", None)], "card_id string, detail_url string, domain string, shape string, combo string, facet string")
    urls = spark.createDataFrame([("u1", "known_deferred"), ("u2", "queued"), ("u3", "fetched")], "canonical_url string, state string")
    policy = {"domain_url_cap": 5, "path_shape_cap": 5, "query_combo_cap": 5, "faceted_cap": 5}
    out = graph.wake_details(cards, urls, spark.createDataFrame([("c1",), ("c2",), ("c3",), ("c4",), ("cx",)], "card_id string"), policy)
    assert dict(rows(out, "card_id", "outcome")) == {"c1": "queued", "c2": "already_queued", "c3": "already_fetched", "c4": "no_detail_url", "cx": "unknown_card"}


def test_html_links_table_function(spark):
    html.html_links_udtf(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM html_links('<a href=\"/x\">one</a> <a>two</a>')").collect()] == [(0, "/x", "one"), (1, None, "two")]


def test_a_skipped_sitemap_index_leads_nowhere(spark):
    from loomledger.operators import graph

    seeds = spark.createDataFrame([("a", "robots"), ("b", "robots"), ("c", "robots")], "url string, kind string")
    files = spark.createDataFrame([("a", "a", "urlset"), ("b", "b", "sitemapindex"), ("c", "c", "sitemapindex"), ("d", "d", "urlset")], "url string, final_url string, kind string")
    entries = spark.createDataFrame([("a", "x", None), ("c", "d", None), ("d", "y", None)], "file string, loc string, lastmod string")
    opened, urls = graph.sitemap_closure(seeds, files, entries, most_files=2)
    assert {(r.url, r.outcome) for r in opened.collect()} == {("a", "opened"), ("b", "opened"), ("c", "skipped")}
    assert [r.url for r in urls.collect()] == ["x"]
    opened, urls = graph.sitemap_closure(seeds, files, entries)
    assert {r.url for r in urls.collect()} == {"x", "y"} and opened.count() == 4


def test_signatures_are_of_the_layout(spark):
    card = '<li class="card big x"><a href="/p/{0}"><img src="{0}.png"></a><p>{1}</p></li>'
    page = lambda inner, n=3, text="t": "<main><ul class='grid'>" + "".join(inner.format(i, text * (i + 1)) for i in range(n)) + "</ul></main>"
    pages = [
        (1, page(card)), (2, page(card, text="other words ")), (3, page(card.replace("<p>{1}</p>", "<div><p>{1}</p></div>"))), (4, page(card, 4)), (5, page(card.replace("big", "small"))),
        (6, page(card.replace('<a href="/p/{0}"><img src="{0}.png"></a><p>{1}</p>', '<p>{1}</p><a href="/p/{0}"><img src="{0}.png"></a>'))), (7, page(card.replace("</li>", ""))), (8, "<p>no cards</p>"),
    ]
    df = spark.createDataFrame([(i, "https://a.example/", h) for i, h in pages], "page_id int, url string, html string")
    groups, _ = html.card_groups(html.parse_pages(df))
    got = {r.page_id: r.signature for r in groups.where("best").collect()}
    assert got[1] == got[2] == got[6] and 8 not in got
    assert len({got[i] for i in (1, 3, 4, 5)}) == 4
    tree = html.tree_hash("li", [html.tree_hash("a", [html.tree_hash("img", [])]), html.tree_hash("p", [])])
    assert got[1] == f"li.card.big>ul.grid>main.|{tree}|n=3"


def test_profiles_and_markdown_reach_the_verdict(spark):
    long = "word " * 100
    data = [
        (1, 200, "listing", long, 5, "s1", "s1", False), (2, 200, "listing", long, 5, "s2", "s1", False), (3, 200, "listing", long, 0, None, None, True), (4, 200, "detail", long, 9, "s2", "s1", True),
        (5, 200, "detail", "short", 0, None, None, True), (6, 200, "unknown", long + "Not Found", 0, None, None, True), (7, 403, "unknown", long, 0, None, None, True), (8, 200, "listing", long, 5, "s1", None, None),
    ]
    df = spark.createDataFrame(data, "id int, status int, kind string, text string, cards int, signature string, accepted_signature string, markdown boolean")
    df = df.withColumns({"requested": F.lit("https://a/x"), "final": F.when(F.col("id") == 4, "https://a/").otherwise("https://a/x"), "title": F.lit("T"), "similar_path": F.lit(False), "declared": F.lit(None).cast("int"), "jsonld": F.lit(0), "has_image": F.lit(False)})
    out = {r.id: r for r in html.page_verdict(df).collect()}
    assert [out[i].validity for i in range(1, 9)] == ["content_validated", "invalid", "needs_visual_review", "content_validated", "invalid", "invalid", "invalid", "needs_visual_review"]
    assert "profile_signature_match" in out[1].evidence and out[2].negatives == ["profile_signature_changed"]
    assert out[3].evidence == [f"markdown_text:{len(long.strip())}"] and out[4].evidence == out[3].evidence and out[3].extraction == "uncertain"
    assert out[5].negatives == ["thin_text:5"] and out[6].negatives == ["error_phrase:not found"] and out[7].negatives == ["http_403"]


def test_final_consonants_and_units(spark):
    corpus = spark.createDataFrame([("갖추다 만들 열두 종이",)], "text string")
    words = ["갖춘", "갖출", "갖춰", "든", "12종", "3개", "42", "만든", "없는", "없음", "한"]
    df = spark.createDataFrame([(1, " ".join(words))], "id int, text string")
    got = {r.token: r.verdict for r in text.out_of_corpus(df, corpus, "text", "id").collect()}
    # 갖춘 and 갖출 are 갖추 with a final consonant; 12종 has a unit of the corpus; words of one letter aren't looked at.
    assert got == {"갖춰": "missing", "3개": "missing", "만든": "soft", "없는": "soft", "없음": "soft"}


def test_ledger_rows_for_exports(spark):
    items = spark.createDataFrame([(1,), (2,)], "item_id int")
    sources = spark.createDataFrame([(1, "seed", "b"), (1, "seed", "a"), (1, "seed", "a")], "item_id int, source_kind string, source_value string")
    judgments = spark.createDataFrame([(1, "x"), (1, None), (1, "y")], "item_id int, label string")
    attempts = spark.createDataFrame([(1, "r1", ["w", "v"], None, "collect"), (1, "r2", ["w"], "e", "map"), (None, "r3", None, None, "search")], "item_id int, attempt_id string, warning_codes array<string>, error_code string, operation string")
    artifacts = spark.createDataFrame([("r1", "p2"), ("r1", "p1"), ("r3", "p3")], "attempt_id string, path string")
    one, two = ledger.ledger_rows(items, sources, judgments, attempts, artifacts).orderBy("item_id").collect()
    assert (one.source_kinds, one.sources, one.labels, one.judgments) == (["seed"], ["seed:a", "seed:b"], ["x", "y"], 3)
    assert (one.warnings, one.errors, one.attempt_ids, one.manifest_paths, one.artifact_paths) == (["v", "w"], ["e"], ["r1", "r2"], ["artifacts/pages/1/r1/manifest.json"], ["p1", "p2"])
    assert (two.sources, two.artifact_paths, two.attempts, two.judgments) == ([], [], 0, 0)
    keys = spark.createDataFrame([(1, "a"), (1, None)], "item_id int, source_value string")
    assert [r.source_value for r in ledger.exists_in(keys, sources, ["item_id", "source_value"]).collect()] == ["a"]
    assert [r.source_value for r in ledger.exists_in(keys, sources, ["item_id", "source_value"], negate=True).collect()] == [None]


def test_markdown_by_tracking(spark, tmp_path):
    for name in ("a.md", "d/b.MD", "node_modules/c.md", "x/f.md", "other.txt", "d/g.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    got = scans.read_markdown(spark, str(tmp_path))
    assert {r.path: r.tracking for r in got.collect()} == {p: "tracked" for p in ("a.md", "d/b.MD", "x/f.md", "d/g.md")}
    listed = spark.createDataFrame([("a.md", "untracked"), ("a.md", "tracked"), ("d/b.MD", "odd"), ("x/f.md", "ignored"), ("d/g.md", "ignored"), ("gone.md", "tracked"), ("node_modules/c.md", "tracked")], "path string, tracking string")
    assert {r.path: r.tracking for r in scans.read_markdown(spark, str(tmp_path), listed, "x").collect()} == {"a.md": "tracked", "d/b.MD": "tracked", "x/f.md": "ignored"}


def test_references_end_with_a_semicolon(spark):
    source = """<title>A &amp</title><script>a &amp b</script><p>&copy; &COPY &NBSP;x&lt;&ampx; &notit; &#65; &#65 &unknown; R&D &amp;amp; &</p><a href="/p?a=1&copy=2&amp;b=3"><script>&amp;</script>&amp l</a><!-- <script> &amp -->&amp;<p>&amp"""
    parsed = html.parse_pages(spark.createDataFrame([(1, "https://a.example/", source)], "page_id long, url string, html string"))
    row = html.extract_text(parsed).first()
    assert row.title == "A &amp" and row.text == "© &COPY x<&ampx; &notit; A &#65 &unknown; R&D &amp; &\n&amp l&\n&amp"
    assert parsed.first().links[0].raw_href == "/p?a=1&copy=2&b=3"


def test_every_transcript_is_searched(spark, tmp_path):
    turns = [(c, t, "user", f"{c} station then") for c in range(8, 22) for t in range(2)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert sorted((r.file, r.line) for r in text_queries.search_transcripts(spark, str(tmp_path)).collect()) == [(c, t + 1) for c, t, *_ in turns]


def test_notes_of_every_kind_are_ranked(spark):
    notes = [(i, ("date", "de", "fr", None)[i % 4], i * 7 % 50) for i in range(400)]
    got = {(r.i, r.rank) for r in stats.list_notes(spark.createDataFrame(notes, "i long, k string, d long"), "k", "d", "i", 30).collect()}
    want = {(n[0], at) for k in ("date", "de", "fr", None) for at, n in enumerate(sorted((n for n in notes if n[1] == k), key=lambda n: (-n[2], -n[0])), 1) if k != "date" or at <= 30}
    assert got == want


def test_few_parsed_pages_are_held(monkeypatch):
    import pyarrow as pa

    made = []
    monkeypatch.setattr(html, "_Page", lambda page=html._Page: made.append(1) or page())
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(1000)), "url": ["https://a.example/"] * 1000, "html": ["<p>x</p>"] * 1000})
    parts = html._parsed([batch], [*"kuabcdefgh"])
    assert next(parts).num_rows == len(made) <= 100
    assert sum(p.num_rows for p in parts) == 1000 - html.PAGES


def test_sections_over_several_batches(spark):
    """Headers reach Python as one sorted stream, not a group a document: a document may go on in the next batch, with sections still open."""
    docs = [(f"d{i}", "\n".join(["# t", *(f"{'#' * (2 + (i + j) % 3)} s{j}\ntext" for j in range(i)), "end"])) for i in range(9)]
    lines = doc_ops.doc_lines(spark.createDataFrame(docs, "path string, text string"))
    whole = sorted(map(tuple, doc_ops.sections(lines).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        cut = doc_ops.sections(lines)
        assert sorted(map(tuple, cut.collect())) == whole and len(whole) == sum(range(9))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroups" not in cut._jdf.queryExecution().executedPlan().toString()
    assert [(r.address, r.start_line, r.end_line) for r in doc_ops.sections(lines).where("path = 'd3'").orderBy("start_line").collect()] == [("1", 2, 8), ("1-1", 4, 8), ("1-1-1", 6, 8)]
