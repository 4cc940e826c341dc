"""Sitemaps as streams: limits, broken bodies, comments and entries over the pieces' borders."""

import gzip
import random
import resource
import zlib

import pytest

from loomledger.operators import graph, stats
from loomledger.sources import scans, sitemaps


def read(body, most=50 << 20):
    *entries, end = sitemaps.sitemap_rows(body, most)
    return [(e["raw"], e["lastmod"]) for e in entries], end


@pytest.mark.parametrize("piece", [1, 7, 100, 1 << 16])
def test_pieces_don_t_matter(monkeypatch, piece):
    monkeypatch.setattr(sitemaps, "_PIECE", piece)
    rng = random.Random(1)
    entries = [(f"https://s.example/é/{i}?a=1&b={i}", None if i % 3 else f"2024-01-{i % 28 + 1:02}") for i in range(60)]
    parts = []
    for loc, mod in entries:
        parts.append(rng.choice(["", " ", "<!-- <url><loc>no</loc></url> -->", "<!-- - -- > -->", "\n"]))
        parts.append(f"<url>\n<loc>{loc.replace('&', '&amp;') if rng.random() < 0.7 else '<![CDATA[' + loc + ']]>'}</loc>" + (f"<lastmod> {mod} </lastmod>" if mod else "") + "<image:image><image:loc>x</image:loc></image:image></url>")
    text = f"<?xml version='1.0'?><!-- <sitemapindex> --><urlset xmlns='x'>{''.join(parts)}</urlset>".encode()
    for body in (text, gzip.compress(text), gzip.compress(text[:500]) + gzip.compress(text[500:]) + b"\0\0"):
        got, end = read(body)
        assert got == entries and (end["kind"], end["entries"], end["bytes"], end["error"]) == ("urlset", 60, len(text), None)


def test_broken_bodies():
    text = b"<urlset>" + b"<url><loc>https://s.example/1</loc></url>" * 50_000 + b"</urlset>"
    got, end = read(gzip.compress(text)[:-4000])
    assert end["error"] == "gunzip_failed" and 0 < len(got) < 50_000
    assert read(b"\x1f\x8bnot gzip")[1]["error"] == "gunzip_failed"
    assert read(b"<html>")[1] | {"bytes": 0} == {"kind": "unknown", "gzipped": False, "bytes": 0, "entries": 0, "error": "not_a_sitemap", "limit_hit": None}
    assert read(b"")[1]["error"] == "not_a_sitemap"
    got, end = read(text, most=1 << 16)
    assert (end["error"], end["limit_hit"]) == ("too_large", "max_bytes")
    assert read(b"<sitemapindex><sitemap><loc>/a</loc></sitemap><url><loc>b</loc></url><sitemap></sitemap></sitemapindex>")[0] == [("/a", None), ("", None)]
    assert read(b"<urlset><url><loc>" + b"x" * (3 << 20) + b"<url><loc>y</loc></url></urlset>")[1]["error"] is None


def test_a_bomb_costs_little():
    machine = zlib.compressobj(9, zlib.DEFLATED, 31)
    bomb = b"".join(machine.compress(b"<urlset>" if not i else b" " * (1 << 20)) for i in range(201)) + machine.flush()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    got, end = read(bomb)
    assert end["limit_hit"] == "max_bytes" and end["bytes"] <= 50 << 20 and not got
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 64 << 10


def test_limits_and_errors_of_a_run(spark):
    urlset = lambda *locs: ("<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in locs) + "</urlset>").encode()
    index = lambda *locs: ("<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in locs) + "</sitemapindex>").encode()
    root = "https://s.example"
    bodies = [(f"{root}/i", index("/a", "/b", "/j", "/gone")), (f"{root}/a", urlset("/1", "/2", "ftp://x", "")), (f"{root}/b", urlset(*(f"/big/{i}" for i in range(300)))), (f"{root}/j", index("/c")), (f"{root}/c", urlset("/deep"))]
    files, entries = scans.read_sitemaps(spark.createDataFrame(bodies, "url string, body binary"), "body", "url", most_bytes=5000)
    assert {(r.file.rsplit("/", 1)[1], r.error, r.limit_hit) for r in files.collect()} == {("i", None, None), ("a", None, None), ("b", "too_large", "max_bytes"), ("j", None, None), ("c", None, None)}
    known = files.selectExpr("file as url", "file as final_url", "kind", "limit_hit")
    seeds = spark.createDataFrame([(f"{root}/i", "robots")], "url string, kind string")
    opened, urls = graph.sitemap_closure(seeds, known, entries, depth=1)
    outcomes = {r.url.rsplit("/", 1)[1]: r.outcome for r in opened.collect()}
    assert outcomes == {"i": "opened", "a": "opened", "b": "too_large", "j": "max_depth", "gone": "unreadable"}
    errors = graph.discovery_errors(opened, entries)
    assert sorted((r.url.rsplit("/", 1)[1], r.code) for r in errors.collect()) == [("a", "bad_loc"), ("a", "bad_loc"), ("b", "too_large"), ("gone", "unreadable"), ("j", "max_depth")]
    limits = graph.limits_hit(opened, urls)
    kinds = opened.selectExpr("case when outcome = 'skipped' then 'skipped' when outcome = 'unreadable' then 'unreadable' else file_kind end as kind", "depth")
    run = stats.sitemap_run_counts(kinds, urls.selectExpr("url as canonical_url"), errors, limits).first()
    assert (run.errors, run.limits_hit, run.partial, run.indexes, run.urlsets, run.unreadable) == (5, ["max_bytes", "max_depth"], True, 2, 2, 1)
    assert [r.limit_hit for r in graph.limits_hit(opened, urls, 3).where("limit_hit = 'max_urls'").collect()] == ["max_urls"]
