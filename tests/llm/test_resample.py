"""Importance resampling against plain counting, and texts in stretches against whole ones."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomledger.llm import queries, resample
from loomledger.llm.common import stretches

COLUMNS = ("doc_id", "n_features", "weight", "score", "rank")


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def features(text, orders=2, buckets=10_000):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, orders + 1) for i in range(len(w) - n + 1)]


def expected(docs, target, orders=2, buckets=10_000, percent=25, least=20):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text, orders, buckets))
    for text in target:
        t.update(features(text, orders, buckets))
    ns, nt = sum(s.values()), sum(t.values())
    rows = []
    for doc_id, text in docs:
        f = features(text, orders, buckets)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in f]
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain) // len(gain) if gain else 0
        rows.append((doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text))))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    ranks = {id(r): i + 1 for i, r in enumerate(able[: len(able) * percent // 100])}
    return sorted(((*r[:4], ranks.get(id(r))) for r in rows), key=str)


def answers(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


DOCS = [(i, " ".join(f"w{(i * j) % 37}" if j % 3 else "The É-x" for j in range(i % 45))) for i in range(120)]
DOCS += [(500, None), (501, ""), (502, "one"), (503, "---"), (504, "Zoë 42_b a\tb\x00c"), (505, "long word " * 60_000), (None, "w1 w2 " * 30), (7, "w3 w4 " * 15), (506, "ÀÉ ß İ")]
TARGET = ["w1 w2 w3 the é x", None, "", "w5 W6"]


def test_rows_equal_plain_counting(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(5)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    assert answers(resample.score(docs, target)) == expected(DOCS, TARGET)
    assert answers(resample.score(docs, target, orders=3, buckets=97, percent=50, min_words=1)) == expected(DOCS, TARGET, 3, 97, 50, 1)


def test_stretches_have_the_features_of_the_whole():
    text = " ".join(f"Wort{i % 19}É" * (1 + i % 4) for i in range(400)) + " X" + "y" * 300 + " end"
    for orders in (1, 2, 3):
        whole = Counter(features(text, orders))
        for limit in (7, 64, 1000, 100_000):
            cut = Counter()
            for piece, known in stretches(text.encode(), limit, resample._CUT, orders - 1):
                for _, bucket in resample.buckets_of(pa.array([piece.decode()], pa.large_string()), orders, 10_000, known):
                    cut.update(np.asarray(bucket).tolist())
            assert cut == whole


def test_a_text_over_the_limit_is_one_row(spark):
    assert resample.STRETCH == 8 << 20
    text = "alpha Beta gamma " * 600_000
    docs = spark.createDataFrame([(1, text), (2, "alpha beta " * 20)], "doc_id long, text string")
    target = spark.createDataFrame([("alpha",)], "text string")
    assert answers(resample.score(docs, target, percent=100)) == expected([(1, text), (2, "alpha beta " * 20)], ["alpha"], percent=100)


def test_ranks_over_many_ranges_and_equal_rows(spark):
    rows = spark.range(3000).select((F.col("id") % 5).alias("v"), F.lit(1).alias("same"), F.col("id").alias("row"))
    ranks = resample.ranked(rows, F.desc("v"), F.asc("row")).orderBy("rank").collect()
    assert [r["rank"] for r in ranks] == list(range(1, 3001))
    assert [r["v"] for r in ranks] == [4 - i // 600 for i in range(3000)]


def test_empty_tables_and_clashing_names(spark):
    target = spark.createDataFrame([("a b",)], "text string")
    assert resample.score(spark.createDataFrame([], "doc_id long, text string"), target).count() == 0
    docs = spark.createDataFrame([(i, "a b " * 10, "q", 1.5) for i in range(8)], "doc_id long, text string, `rank` string, weight double")
    none = spark.createDataFrame([], "text string")
    assert answers(resample.score(docs, none)) == expected([(i, "a b " * 10) for i in range(8)], [])
    drawn = resample.drawn(docs, target)
    assert drawn.columns == docs.columns and drawn.count() == 2


def test_query_equals_sql(spark, sf_dir):
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    sql = duck.sql(f"SELECT {', '.join(COLUMNS)} FROM ({resample.oracle_sql()})").fetchall()
    assert answers(queries.queries()["op11_importance_resampling"](spark, sf_dir)) == sorted(sql, key=str)
