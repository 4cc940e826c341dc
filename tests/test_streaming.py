import datetime as dt

import pytest

from loomledger.operators.series import pace_schedule
from loomledger.streaming import ledger as streams

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def fed(spark, tmp_path, df, parts=2):
    """The rows of df as a stream of so many micro-batches of files."""
    df.repartition(parts).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def collected(spark, tmp_path, stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return [tuple(r) for r in spark.table(name).collect()]


def test_ingest_equals_the_batch_form(spark, tmp_path):
    urls = [(f"https://a.example/{i % 7}?utm_source=x",) for i in range(20)] + [("nope",), ("https://b.example/",)]
    query = streams.stream_add_urls(fed(spark, tmp_path, spark.createDataFrame(urls, "url string"), 3), str(tmp_path / "ledger"), "seed", "list", str(tmp_path / "cp"))
    query.awaitTermination(180)
    items = spark.read.parquet(str(tmp_path / "ledger" / "items"))
    assert items.count() == items.select("canonical_url").distinct().count() == 8
    assert spark.read.parquet(str(tmp_path / "ledger" / "sources")).count() == 8
    counts = spark.read.parquet(str(tmp_path / "ledger" / "counts")).groupBy().sum("received", "added", "duplicates", "rejected").first()
    assert tuple(counts) == (22, 8, 13, 1)


def test_reports_once(spark, tmp_path):
    df = spark.createDataFrame([("k1", T0), ("k1", T0), ("k2", T0)], "report_key string, at timestamp")
    assert sorted(r[0] for r in collected(spark, tmp_path, streams.stream_reports(fed(spark, tmp_path, df)), "reports")) == ["k1", "k2"]


def test_pace_equals_the_closed_form_and_refuses(spark, tmp_path):
    rows = [("a", i, "request", 10 * i, 50) for i in range(6)] + [("b", 1, "sleep", 0, 1000), ("b", 2, "request", 10, 5), ("b", 3, "request", 2000, 5)]
    df = spark.createDataFrame(rows, "domain string, id long, kind string, now_ms long, gap_ms long")
    got = {(d, i): (a, r) for d, i, a, r in collected(spark, tmp_path, streams.stream_pace(fed(spark, tmp_path, df, 1)), "pace")}
    closed = pace_schedule(df.where("domain = 'a'"), "domain", "now_ms", "id", "gap_ms").collect()
    assert {("a", r.id): (r.allowed_at, None) for r in closed} == {k: v for k, v in got.items() if k[0] == "a"}
    assert got[("b", 2)] == (None, "domain_sleeping") and got[("b", 3)] == (2000, None)


def test_leases(spark, tmp_path):
    ms = lambda s: int((T0 + dt.timedelta(seconds=s)).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [(1, "lease", "L", at(0), ms(0), ms(100)), (1, "report", "L", at(50), ms(50), 0), (2, "lease", "M", at(0), ms(0), ms(100)), (2, "report", "M", at(150), ms(150), 0), (3, "lease", "N", at(0), ms(0), ms(100)), (3, "report", "X", at(20), ms(20), 0)]
    df = spark.createDataFrame(rows, "item_id long, kind string, lease string, at timestamp, at_ms long, until_ms long")
    got = collected(spark, tmp_path, streams.stream_leases(fed(spark, tmp_path, df, 1)), "leases")
    outcomes = {i: [o for j, _, _, o in sorted(got, key=lambda r: r[2]) if j == i] for i in (1, 2, 3)}
    assert outcomes[1] == ["leased", "reported"] and outcomes[2] == ["leased", "expired", "stale"] and outcomes[3][:2] == ["leased", "stale"]


def test_screens(spark, tmp_path):
    rows = [("s", 1, "Working (1s)"), ("s", 2, "Working (1s)"), ("s", 3, ""), ("s", 4, ""), ("s", 5, None), ("s", 6, "Do you want to go on?")]
    df = spark.createDataFrame(rows, "surface string, at_ms long, text string")
    got = sorted(collected(spark, tmp_path, streams.stream_screens(fed(spark, tmp_path, df, 1)), "screens"), key=lambda r: r[1])
    assert [s for _, _, s in got] == ["working", "stalled", "empty", "empty", "no_panel", "blocked"]


def test_running_status(spark, tmp_path):
    df = spark.createDataFrame([("failed", "x"), ("failed", "x"), ("success", None)], "result string, error_code string")
    got = collected(spark, tmp_path, streams.stream_status(fed(spark, tmp_path, df)), "status", "complete")
    assert sorted(got) == [("failed", "x", 2), ("success", "-", 1)]


def test_retention(spark):
    rows = spark.createDataFrame([("a", i) for i in range(6)], "k string, i int")
    assert sorted(r.i for r in streams.retain_last(rows.where("i >= 3"), rows.where("i < 3"), "k", "i", 2).collect()) == [4, 5]


def test_a_batch_brings_what_the_ledger_lacks(spark, tmp_path):
    """Ten micro-batches after an older ledger, with a restart in between, bring what the batch form brings at once."""
    from pyspark.sql import functions as F

    from loomledger.operators.ledger import add_urls
    from loomledger.operators.urls import canonicalize

    old_items = spark.createDataFrame([(f"https://a.example/{i}", "a.example") for i in range(30)], "canonical_url string, domain string")
    old_sources = spark.createDataFrame([(f"https://a.example/{i}", "seed", "list") for i in range(0, 30, 2)] + [("https://a.example/1", "search", "q")], "canonical_url string, source_kind string, source_value string")
    urls = spark.createDataFrame([(f"https://a.example/{i % 50}?utm_source={i}",) for i in range(200)] + [("mailto:x",)] * 3 + [("",)], "url string").repartition(10)
    stream = fed(spark, tmp_path, urls, 10)
    for _ in range(2):
        query = streams.stream_add_urls(stream, str(tmp_path / "ledger"), "seed", "list", str(tmp_path / "cp"), old_items, old_sources)
        query.awaitTermination(240)
        assert query.exception() is None
    items, sources, counts = add_urls(old_items, old_sources, canonicalize(urls), "seed", "list")
    key = lambda df: sorted(tuple(r) for r in df.collect())
    got = {name: spark.read.parquet(str(tmp_path / "ledger" / name)).drop("batch") for name in ("items", "sources", "counts")}
    assert key(got["items"]) == key(items.join(old_items, "canonical_url", "left_anti").select("canonical_url", "domain"))
    assert key(got["sources"]) == key(sources.join(old_sources, old_sources.columns, "left_anti"))
    names = ("received", "added", "duplicates", "rejected", "sources_added")
    assert tuple(got["counts"].agg(*(F.sum(c).alias(c) for c in names)).first()) == tuple(counts.select(*names).first())
    # A second run without new files changes nothing, and no batch reads the ledger: its own rows are its only input.
    assert spark.read.parquet(str(tmp_path / "ledger" / "counts")).count() == 10
    assert all(p.numInputRows <= 40 for p in query.recentProgress)


def test_silence_is_told_once_and_again_after_a_reading(spark, tmp_path):
    import time

    folder = str(tmp_path / "in")
    reading = lambda at: spark.createDataFrame([("s", at, "Working (1s)")], "surface string, at_ms long, text string").coalesce(1).write.mode("append").parquet(folder)
    reading(1)
    stream = spark.readStream.schema("surface string, at_ms long, text string").parquet(folder)
    query = streams.stream_screens(stream, silent_ms=1500).writeStream.format("memory").queryName("silence").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    seen = lambda: [(r.at_ms, r.state) for r in spark.table("silence").collect()]

    def until(n):
        for _ in range(240):
            if len(seen()) >= n:
                break
            time.sleep(0.25)

    try:
        until(2)
        time.sleep(4)
        assert seen() == [(1, "working"), (1, "timeout")]
        reading(2)
        until(4)
        assert seen() == [(1, "working"), (1, "timeout"), (2, "stalled"), (2, "timeout")]
    finally:
        query.stop()


def test_status_report_equals_the_batch_form_after_every_batch(spark, tmp_path):
    import random

    from loomledger.operators import stats

    rng = random.Random(4)
    rows = [(f"a{i}", T0 + dt.timedelta(minutes=rng.randrange(50)), rng.choice(["success", "failed", "partial"]), rng.choice(["fetch", "parse", None]), rng.choice(["e1", "e2", "e3", "e4", "e5", "e6", None]), rng.choice([None, [], ["w1"], ["w1", f"w{i % 8}"]])) for i in range(120)]
    moves = [(i % 25, rng.choice(["queued", "leased", "done", "failed"]), rng.randrange(1000)) for i in range(120)]
    for k in range(3):
        spark.createDataFrame(rows[k::3], "attempt_id string, started_at timestamp, result string, error_stage string, error_code string, warning_codes array<string>").coalesce(1).write.mode("append").parquet(str(tmp_path / "attempts"))
        spark.createDataFrame(moves[k::3], "item_id int, work_state string, at_ms long").coalesce(1).write.mode("append").parquet(str(tmp_path / "moves"))
    attempts, changes = (spark.read.parquet(str(tmp_path / name)) for name in ("attempts", "moves"))
    streamed = [spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)) for df, name in ((attempts, "attempts"), (changes, "moves"))]
    for query in streams.stream_status_report(*streamed, str(tmp_path / "status"), str(tmp_path / "cp")):
        query.awaitTermination(240)
        assert query.exception() is None
    for k in range(3):
        # Files are read in the order in which they were written.
        so_far, moved = rows[0::3] + (rows[1::3] if k else []) + (rows[2::3] if k > 1 else []), moves[0::3] + (moves[1::3] if k else []) + (moves[2::3] if k > 1 else [])
        sample = spark.createDataFrame(so_far, attempts.schema)
        report = spark.read.parquet(str(tmp_path / "status" / "problems" / f"batch={k}"))
        assert [tuple(r) for r in report.where("kind = 'error'").orderBy("place").select("stage", "name", "n", "sample").collect()] == [tuple(r) for r in stats.top_errors(sample).select("error_stage", "error_code", "n", "sample").collect()]
        assert [tuple(r) for r in report.where("kind = 'warning'").orderBy("place").select("name", "n").collect()] == [tuple(r) for r in stats.top_warnings(sample).collect()]
        last = {}
        for item, state, at in moved:
            last[item] = max(last.get(item, (-1, "")), (at, state))
        counts = stats.state_counts(spark.createDataFrame([(i, s) for i, (_, s) in last.items()], "item_id int, work_state string")).first().asDict()
        got = {r.work_state: r["items"] for r in spark.read.parquet(str(tmp_path / "status" / "states" / f"batch={k}")).collect() if r["items"]}
        assert got == {s: n for s, n in counts.items() if s not in ("total", "other") and n} and sum(got.values()) == counts["total"]
