"""Exact dedup against plain grouping: filters of all sizes, ties, nulls, repeated rows, hot groups."""

import hashlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from loomledger.llm import exact_dedup, queries
from loomledger.llm.common import written

COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def expected(rows, best=max):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, stays = best(known) if known else None, True
        for i in ids:
            out.append((i, keep, len(ids), i == keep and stays, hashlib.sha256(text.encode()).hexdigest()))
            stays = stays and i != keep
    return sorted(out, key=str)


def answers(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


ROWS = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "c " * 100_000), (7, "c " * 100_000), (7, "c " * 100_000), (None, "a"), (None, "z"), (None, "z"), (8, "A"), (9, "a ")]


@pytest.mark.parametrize("cells", [2, 64, 1 << 20])
def test_rows_equal_plain_grouping(spark, cells):
    rows = ROWS + [(100 + i, f"text {i % 40}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert answers(exact_dedup.classes(docs, cells=cells)) == expected(rows)


def test_smallest_id_can_stay(spark):
    rows = [r for r in ROWS if r[0] is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert answers(exact_dedup.classes(docs, keep="smallest")) == expected(rows, min)
    with pytest.raises(ValueError):
        exact_dedup.classes(docs, keep="newest")


def test_more_groups_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LARGEST", 3)
    rows = [(i, "hot" if i % 3 == 0 else f"text {i % 50}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert answers(exact_dedup.classes(docs)) == expected(rows)


def test_filter_holds_back_single_texts(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 20, "same").otherwise(F.col("id").cast("string")).alias("text"))
    rows = exact_dedup._numbered(docs, "doc_id", "text", None, False)
    looked = exact_dedup.possibly_repeated(rows, written(exact_dedup.repeated_cells(rows), "filter"))
    assert looked.where("maybe").count() == 20
    # Looking up moves no row: the only exchanges are the broadcasts of the filter.
    plan = looked.where("not maybe")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and "Exchange hashpartitioning" not in plan and "Exchange Single" not in plan


def test_normalised_texts_and_whole_rows(spark):
    rows = [(1, "A b", "x", 5), (2, "a B", "y", 6), (3, "c", "z", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, `row` int")
    lower = exact_dedup.classes(docs, normalise=F.lower)
    assert {(r.doc_id, r.keep_id, r.kept) for r in lower.collect()} == {(1, 2, False), (2, 2, True), (3, 3, True)}
    stays = exact_dedup.distinct(docs, normalise=F.lower)
    assert stays.columns == docs.columns
    assert sorted(tuple(r) for r in stays.collect()) == rows[1:]


def test_empty_table(spark):
    assert exact_dedup.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert exact_dedup.distinct(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_equals_sql(spark, sf_dir):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    sql = duck.sql(f"SELECT {', '.join(COLUMNS)} FROM ({exact_dedup.oracle_sql()})").fetchall()
    df = queries.queries()["op12_exact_dedup"](spark, sf_dir)
    assert answers(df) == sorted(sql, key=str)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan
