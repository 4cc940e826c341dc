"""One new file or none, and the digest of a table's content."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from loomledger.sources import digests, onefile, sinks


def test_one_file_in_order(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.choice(["plain", 'say "x"', "a,b", "two\nlines", "", None, "é"]), [rng.choice("ab")] * (i % 3)) for i in range(500)]
    df = spark.createDataFrame(rows, "item_id long, canonical_url string, labels array<string>").repartition(7)
    path = tmp_path / "out.csv"
    assert sinks.export_ledger(df, str(path), "csv", ["canonical_url", "labels"])["rows"] == 500
    text = path.read_bytes().decode()
    assert text.count("item_id") == 1 and text.endswith("\r\n")
    got = list(csv.reader(io.StringIO(text, newline="")))
    assert got[1:] == [[str(i), u or "", json.dumps(ls, separators=(",", ":"))] for i, u, ls in rows]
    assert sinks.export_ledger(df, f"file://{tmp_path}/out.jsonl", "jsonl", ["labels"])["format"] == "jsonl"
    assert [json.loads(x)["item_id"] for x in (tmp_path / "out.jsonl").read_text().splitlines()] == list(range(500))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out.csv", "out.jsonl"]


def test_no_rows_still_make_a_file(spark, tmp_path):
    none = spark.createDataFrame([], "item_id long, canonical_url string")
    sinks.export_ledger(none, str(tmp_path / "e.csv"), "csv", ["canonical_url"])
    assert (tmp_path / "e.csv").read_bytes() == b"item_id,canonical_url\r\n"
    sinks.write_manifest(none, str(tmp_path / "e.jsonl"))
    assert (tmp_path / "e.jsonl").read_bytes() == b""


def test_a_target_that_is_there_stays(spark, tmp_path):
    (tmp_path / "x").write_text("old")
    with pytest.raises(Exception, match="is there already"):
        onefile.write_lines(spark.range(3).select(F.col("id").cast("string")), str(tmp_path / "x"))
    assert (tmp_path / "x").read_text() == "old" and len(list(tmp_path.iterdir())) == 1


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    bad = spark.range(0, 1000, 1, 8).select(F.when(F.col("id") == 777, F.raise_error(F.lit("broken row"))).otherwise(F.col("id").cast("string")).alias("line"))
    with pytest.raises(Exception, match="broken row"):
        onefile.write_lines(bad, str(tmp_path / "x"))
    assert list(tmp_path.iterdir()) == []


def test_digest_is_of_the_content(spark, monkeypatch):
    rows = [(i % 50, f"text {i % 70}", None if i % 9 == 0 else 1.5 * i) for i in range(400)] + [(1, "", None)] * 30
    df = spark.createDataFrame(rows, "a int, b string, c double")
    for leaf in (1 << 16, 16):
        monkeypatch.setattr(digests, "LEAF", leaf)
        same = {digests.table_digest(x) for x in (df, df.repartition(7), df.orderBy(F.desc("c")), df.select("c", "a", "b"))}
        assert len(same) == 1 and same.pop()[0] == 430
        changed = df.withColumn("b", F.when((F.col("a") == 3) & (F.col("c") == 1.5 * 53), F.concat("b", F.lit("!"))).otherwise(F.col("b")))
        fewer = spark.createDataFrame(rows[:-1], df.schema)
        nulls = df.withColumn("b", F.when(F.col("b") != "", F.col("b")))
        assert len({digests.table_digest(x)[1] for x in (df, changed, fewer, nulls, df.limit(0), df.withColumnRenamed("a", "d"))}) == 6
        assert 1 <= digests.changed_leaves(df, changed).count() <= 2 and digests.changed_leaves(df, df.repartition(3)).count() == 0


def test_snapshots_are_numbered_once(spark, tmp_path):
    df, path = spark.range(5).toDF("id"), str(tmp_path / "s")
    sinks.write_snapshot(df, path, 1, "me", "why", complete=True)
    with pytest.raises(ValueError, match="taken"):
        sinks.write_snapshot(df, path, 1, "me", "again", complete=True)
    sinks.write_snapshot(df.limit(0), path, 2, "me", "why", complete=True)
    assert sinks.snapshots(spark, path).count() == 2 and sinks.verify_snapshot(spark, path, 1) and sinks.verify_snapshot(spark, path, 2)
    df.withColumn("id", F.col("id") + 1).write.mode("overwrite").parquet(f"{path}/snapshot=1")
    assert not sinks.verify_snapshot(spark, path, 1)


def test_digest_has_two_levels_at_most(spark, monkeypatch):
    """As many leaves as the query's SQL cuts, whatever the number of rows: a third level would come at 256 times LEAF."""
    import hashlib
    from collections import Counter

    monkeypatch.setattr(digests, "LEAF", 2)
    df = spark.range(2000).selectExpr("id % 1500 AS a")
    counts = Counter(hashlib.sha256(f'{{"a":{i % 1500}}}'.encode()).hexdigest() for i in range(2000))
    leaves = {}
    for h in sorted(counts):
        leaves.setdefault(h[:2], []).append(f"{h}:{counts[h]}")
    root = hashlib.sha256(",".join(f"{p}:{hashlib.sha256(','.join(x).encode()).hexdigest()}" for p, x in sorted(leaves.items())).encode()).hexdigest()
    assert digests.table_digest(df) == (2000, hashlib.sha256(f"2000:a:{root}".encode()).hexdigest())
