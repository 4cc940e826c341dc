"""Lines and CSV records of files of any size, read in byte ranges.

Spark's text reader splits a file into blocks at line ends and tells where each began. Line numbers need the lines of the blocks before: a
first pass counts them, a block's number of lines is all that is exchanged, and a second pass numbers the lines. Both passes read
the same splits. Nothing ever holds a file, or more of it than a block; a compressed file is one block, read as a stream.

A CSV record with line ends in quoted cells can cross blocks, and whether a block starts inside quotes is only known once those
before it are read. So a block is read for both answers at once, and its summary tells where each leads. A file's summaries, one short row
a block, are then followed in order, which picks the answer that holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomledger.sources.tables import checkpointed

#: Rows up to which a table of blocks or files is broadcast.
FEW = 100_000


def held(df: DataFrame) -> DataFrame:
    """df, to be joined on one of its keys: broadcast where it has been counted and is small."""
    kept = checkpointed(df)
    return F.broadcast(kept) if kept.count() <= FEW else kept


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """file, block (its first byte), at (ascends within a block) and content of every line. Lines end in a line feed; a carriage return before it is kept."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("content")
    )


def _plain(line, content):
    """A line without its carriage return; the first without a byte order mark."""
    return F.regexp_replace(F.when(line == 1, F.regexp_replace(content, "^﻿", "")).otherwise(content), "\r$", "")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1) and content of every line of the files."""
    lines = _blocks(spark, path)
    sizes = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = held(sizes.select("file", "block", (F.col("first") - F.coalesce(F.sum("n").over(earlier), F.lit(0)) - 1).alias("zero")))
    line = F.col("at") - F.col("zero")
    return lines.join(starts, ["file", "block"]).select("file", line.alias("line"), _plain(line, F.col("content")).alias("content"))


_QUOTED, _CELLS = r'(?:[^"]|"")*', r'(?:,(?:"(?:[^"]|"")*"|[^",][^,]*|))*'
_WHOLE = re.compile(rf'(?:"{_QUOTED}"|[^",][^,]*|){_CELLS}', re.S)
_OPENS = re.compile(rf'(?:(?:"{_QUOTED}"|[^",][^,]*|){_CELLS},)?"{_QUOTED}', re.S)
_CLOSES = re.compile(rf'{_QUOTED}"{_CELLS}', re.S)
_REOPENS = re.compile(rf'{_QUOTED}"{_CELLS},"{_QUOTED}', re.S)
_STAYS = re.compile(_QUOTED, re.S)


def outside(line: str) -> str:
    """What a line is that starts outside quotes: whole, open (a cell goes on in the next line) or wrong."""
    return "whole" if _WHOLE.fullmatch(line) else "open" if _OPENS.fullmatch(line) else "wrong"


def inside(line: str) -> str:
    """What a line is that starts inside quotes: closed, open, or wrong (it can't go on with an open cell)."""
    return "closed" if _CLOSES.fullmatch(line) else "open" if _STAYS.fullmatch(line) or _REOPENS.fullmatch(line) else "wrong"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Batches cut where the block changes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = batch.column(0).dictionary_encode().indices.to_numpy(), batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if high > low:
                yield batch.column(0)[low].as_py(), int(block[low]), batch.slice(low, high - low)


def _quoted(column: pa.Array) -> list[tuple[int, str]]:
    """Place and text of the lines with a quote: all others leave the state as it is."""
    at = np.flatnonzero(np.asarray(pc.match_substring(column, '"')))
    return list(zip(at.tolist(), (x.removesuffix("\r") for x in column.take(pa.array(at)).to_pylist()), strict=True))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block: lines; for a start outside (0) and inside (1) quotes the line (from 0) of the record that is open at the end, -1 if none is,
    or -2 if it is the one from before; and for a start inside, whether the record from before ends well."""
    now, out = None, []
    for file, block, run in _runs(batches):
        if now != (file, block):
            now = (file, block)
            out.append([file, block, 0, -1, -2, None])
        row = out[-1]
        for at, line in _quoted(run.column(2)):
            for start in (0, 1):
                open_ = row[3 + start]
                if open_ == -1:
                    row[3 + start] = row[2] + at if outside(line) == "open" else -1
                elif (kind := inside(line)) != "open":
                    if open_ == -2:
                        row[5] = kind == "closed"
                    row[3 + start] = row[2] + at if kind == "wrong" and outside(line) == "open" else -1
        row[2] += run.num_rows
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "block", "n", "open0", "open1", "ends"), r, strict=True)) for r in out], schema=_SUMMARY)


_SUMMARY = pa.schema([("file", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("open0", pa.int64()), ("open1", pa.int64()), ("ends", pa.bool_())])


def _followed(blocks: pd.DataFrame) -> pd.DataFrame:
    """What holds for each block of a file: lines before it, the line of the record that is open at its start (-1: none), and whether the one that is open at its end ends well."""
    rows = blocks.sort_values("block").to_dict("records")
    before, carried = 0, -1
    for r in rows:
        r["before"], r["carried"] = before, carried
        last = r["open1"] if carried >= 0 else r["open0"]
        carried = carried if last == -2 else before + last + 1 if last >= 0 else -1
        before += r["n"]
    well = False
    for r in reversed(rows):
        r["leaves"] = well
        well = bool(r["ends"]) if r["ends"] is not None and r["ends"] == r["ends"] else well
    return pd.DataFrame(rows)[["file", "block", "before", "carried", "leaves"]]


_PIECE = pa.schema([("file", pa.string()), ("line", pa.int64()), ("at", pa.int64()), ("content", pa.string()), ("kind", pa.string())])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, line, at, content, kind: whole records, alone (lines of a record that never ends, each read by itself), and pieces of records that cross blocks, under the record's first line."""
    now, open_, lines, line, leaves = None, -1, [], 0, False
    out: list[tuple] = []

    def over(good: bool) -> None:
        """The open record ends in this block."""
        if not good:
            out.extend((now[0], n, n, text, "alone") for n, text in lines)
        elif lines and lines[0][0] == open_:
            out.append((now[0], open_, open_, "\n".join(text for _, text in lines), "whole"))
        elif lines:
            out.append((now[0], open_, lines[0][0], "\n".join(text for _, text in lines), "piece"))
        lines.clear()

    def left() -> None:
        """The block ends while a record is open: it goes on in the next one, or never ends."""
        if now and lines:
            if leaves:
                out.append((now[0], open_, lines[0][0], "\n".join(text for _, text in lines), "piece"))
            else:
                out.extend((now[0], n, n, text, "alone") for n, text in lines)
            lines.clear()

    def sent() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _PIECE, strict=True)], schema=_PIECE)
        out.clear()
        return batch

    for file, block, run in _runs(batches):
        if now != (file, block):
            left()
            now, line = (file, block), run.column(3)[0].as_py()
            open_, leaves = (run.column(i)[0].as_py() for i in (4, 5))
        texts = run.column(2).to_pylist()
        quoted, low = _quoted(run.column(2)), 0
        for at, text in [*quoted, (len(texts), None)]:
            # Lines without quotes in between.
            if open_ == -1:
                out.extend((file, line + i + 1, line + i + 1, texts[i], "whole") for i in range(low, at))
            else:
                lines.extend((line + i + 1, texts[i]) for i in range(low, at))
            if text is None:
                break
            low, n = at + 1, line + at + 1
            if open_ != -1:
                kind = inside(text)
                if kind != "wrong":
                    lines.append((n, texts[at]))
                if kind == "open":
                    continue
                over(kind == "closed")
                open_ = -1
                if kind == "closed":
                    continue
            kind = outside(text)
            if kind == "open":
                open_ = n
                lines.append((n, texts[at]))
            else:
                out.append((file, n, n, texts[at], "whole" if kind == "whole" else "alone"))
        line += len(texts)
        if out:
            yield sent()
    left()
    if out:
        yield sent()


def csv_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejects): file, line and content of every CSV record that is complete, under its first line; file and line of those whose quotes are never closed.

    A cell starts with a quote or has none that counts. A quoted cell ends at a quote before a comma or a line end and may hold line ends. A record
    whose open cell meets a line that can't go on with it, or the file's end, never ends: its first line is rejected, and the lines
    after it are read each by itself. Blank lines are no records."""
    lines = _blocks(spark, path)
    summary = lines.select("file", "block", "content").mapInArrow(_summaries, "file string, block long, n long, open0 long, open1 long, ends boolean")
    known = held(summary.groupBy("file").applyInPandas(_followed, "file string, block long, before long, carried long, leaves boolean"))
    rows = lines.join(known, ["file", "block"]).select("file", "block", "content", "before", "carried", "leaves")
    pieces = rows.mapInArrow(_pieces, "file string, line long, at long, content string, kind string")
    crossing = pieces.where("kind = 'piece'").groupBy("file", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "content"))), lambda x: x["content"]), "\n").alias("content"))
    alone = pieces.where("kind = 'alone'").withColumn("content", _plain(F.col("line"), F.col("content")))
    complete = F.col("content").rlike(r'^(?:"(?:[^"]++|"")*+"|[^",][^,]*+|)(?:,(?:"(?:[^"]++|"")*+"|[^",][^,]*+|))*+$')
    whole = pieces.where("kind = 'whole'").select("file", "line", "content").unionByName(crossing)
    records = whole.withColumn("content", _plain(F.col("line"), F.col("content"))).unionByName(alone.where(complete).select("file", "line", "content"))
    return records.where(F.trim("content") != ""), alone.where(~complete).select("file", "line")
