"""Sinks: ledger exports, work batches, numbered snapshots with manifests, row manifests."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomledger.operators.ledger import validate_filters
from loomledger.sources.digests import table_digest
from loomledger.sources.onefile import csv_lines, write_lines

MANIFEST = "snapshot int, rows long, content_hash string, who string, reason string, forced boolean"


def export_ledger(rows: DataFrame, path: str, fmt: str, fields: list[str], anchor: str = "item_id") -> dict:
    """Write rows as jsonl or csv into one new file and tell what was written. The anchor column comes first and orders the rows, arrays are JSON in csv, lines of csv
    end in CRLF; no rows still make a file, an existing target is an error, and a failed export leaves none."""
    validate_filters(fields=[f for f in fields if f != anchor])
    if fmt not in ("csv", "jsonl"):
        raise ValueError(f"unknown format: {fmt}")
    out = rows.select(anchor, *(f for f in fields if f != anchor))
    ordered = out.repartitionByRange(anchor).sortWithinPartitions(anchor)
    if fmt == "csv":
        header, line = csv_lines(out)
        write_lines(ordered.select(line.alias("line")), path, header, "\r\n")
    else:
        write_lines(ordered.select(F.to_json(F.struct(*out.columns), {"ignoreNullFields": "false"}).alias("line")), path)
    return {"path": path, "format": fmt, "fields": out.columns, "rows": out.count()}


def write_batches(batched: DataFrame, path: str) -> None:
    """One folder of JSON lines (item_id, url) for each batch_id."""
    batched.select("batch_id", "item_id", "url").repartition("batch_id").sortWithinPartitions("batch_id", "item_id").write.partitionBy("batch_id").mode("errorifexists").json(path)


def write_snapshot(df: DataFrame, path: str, number: int, who: str, reason: str, complete: bool, force: bool = False) -> DataFrame:
    """Write an immutable numbered snapshot and its manifest row; an incomplete one only when forced, a number that is taken never.

    The content hash is the root of a hash tree over the rows: it doesn't depend on their order or partitions, and no task sees all rows."""
    if not complete and not force:
        raise ValueError("the ledger isn't complete; force the snapshot to take it as it is")
    spark = df.sparkSession
    if not snapshots(spark, path).where(F.col("snapshot") == number).isEmpty():
        raise ValueError(f"snapshot {number} is taken")
    df.write.mode("errorifexists").parquet(f"{path}/snapshot={number}")
    rows, digest = table_digest(spark.read.schema(df.schema).parquet(f"{path}/snapshot={number}"))
    manifest = spark.createDataFrame([(number, rows, digest, who, reason, not complete)], MANIFEST)
    manifest.write.mode("append").json(f"{path}/manifest")
    return manifest


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """The manifest rows of all snapshots."""
    try:
        return spark.read.schema(MANIFEST).json(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def verify_snapshot(spark: SparkSession, path: str, number: int) -> bool:
    """Whether a snapshot is what its manifest says."""
    said = snapshots(spark, path).where(F.col("snapshot") == number).first()
    rows, digest = table_digest(spark.read.parquet(f"{path}/snapshot={number}"))
    return said is not None and (said.rows, said.content_hash) == (rows, digest)


def write_manifest(rows: DataFrame, path: str, order: str | None = None) -> None:
    """One JSON line a row, in one new file; order: a column that orders the lines."""
    out = rows if order is None else rows.repartitionByRange(order).sortWithinPartitions(order)
    write_lines(out.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("line")), path)
