"""Helpers that the operators share: written intermediate tables, Arrow batches, label folds."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a fresh local one, which only a local master can have."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: the lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc32_of(column: str) -> Column:
    """crc32 of an integer id written as decimal text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def split_batches(batches: Iterator[pa.RecordBatch], text: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text column of each holds at most limit bytes, or one row. Null texts become empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(text)
        column = pc.fill_null(batch.column(at).cast(pa.large_string()), "")
        batch = batch.set_column(at, text, column)
        ends = np.cumsum(np.asarray(pc.binary_length(column), dtype=np.int64))
        low = 0
        while low < batch.num_rows:
            before = int(ends[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(low, high - low)
            low = high
        del batch, column
        pa.default_memory_pool().release_unused()


def stretches(text: bytes, limit: int, cut: re.Pattern, carry: int = 0) -> Iterator[tuple[bytes, int]]:
    """A long text in stretches that end before a separator (cut), and how many words at a stretch's start are the last of the one before."""
    start, held = 0, []
    while start < len(text):
        end = start + limit
        at = cut.search(text, end) if end < len(text) else None
        end = at.start() if at else len(text)
        yield b" ".join([*held, text[start:end]]), len(held)
        if carry:
            held = [*held, *(w for w in cut.split(text[start:end].lower()) if w)][-carry:]
        start = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a large_string array without nulls, and the offsets of its rows (one more than rows)."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """White-space separated words of each text: row of each word, index of each word, the distinct words."""
    lists = pc.ascii_split_whitespace(column)
    counts = np.asarray(pc.list_value_length(lists), dtype=np.int64)
    coded = pc.list_flatten(lists).dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    rows = np.repeat(np.arange(len(column), dtype=np.int64), counts)
    index = np.asarray(coded.indices, dtype=np.int64)
    names = coded.dictionary
    # A text of white space alone, or with white space at its ends, yields empty words: they aren't words.
    if len(names) and pc.any(pc.equal(pc.binary_length(names), 0)).as_py():
        empty = int(np.flatnonzero(np.asarray(pc.binary_length(names)) == 0)[0])
        keep = index != empty
        rows, index = rows[keep], index[keep]
    return rows, index, names


def labelled(labels: DataFrame, label: str, fold: int, held_out: int) -> DataFrame:
    """doc_id and label of the rows a model may learn from: the remainder of crc32(doc_id) by fold isn't held_out.

    A null label or id teaches nothing; a document labelled twice counts with its smaller label."""
    return (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (F.pmod(crc32_of("doc_id"), F.lit(fold)) != held_out))
        .groupBy("doc_id")
        .agg(F.min(F.col(label).cast("int")).alias("label"))
    )


def bounded_sample(learnable: DataFrame, limit: int) -> DataFrame:
    """At most limit rows, those whose hashed id is smallest: the same rows in every run."""
    return learnable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
