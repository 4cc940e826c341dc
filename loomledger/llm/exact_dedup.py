"""Exact dedup with two Bloom passes, in DataFrame functions only.

1. Texts are read once: a row's digest (sha256 of the normalised text), its id and a row number are written. Nothing later
   reads texts.
2. First pass: a digest sets one cell in each of two halves of a counting Bloom filter. A task adds up its cells before the
   exchange, so it sends no row of its own, at most one small counter a cell, and a cell that a third of all rows hit is one
   counter a task. Cells that were hit twice become bits of the second filter, packed into bitmaps of 4 KB.
3. Second pass: the second filter is broadcast (at most ``cells`` / 8 bytes, 16 MB by default) and every row is looked up in it.
   A digest with a cell that nothing else hit can't be repeated: its row passes straight through, as a group of one. There
   are no false negatives, so no copy is missed.
4. Only the possibly repeated rows are exchanged, digest and id alone. Groups are aggregated before the exchange. The
   thousand largest groups are broadcast to their rows; any other group has less than a thousandth of the rows, so a
   join on the digest has no hot key.

A filter too small for the data sends more rows the long way and changes no answer: ``cells`` is about speed alone.

Null texts are empty texts, and equal to them. Empty and very long texts are hashed like others. Of rows with equal texts and the
same largest doc_id exactly one stays. A null doc_id is smaller than any other; in a group of such rows alone one stays and keep_id is
null. An empty table gives an empty result. Other columns, whatever their names, are ignored by ``classes`` and travel along in ``distinct``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomledger.llm.common import written

#: Cells of the filter, both halves together; the broadcast bitmaps have as many bits.
CELLS = 1 << 27
#: Groups that are broadcast to their rows.
LARGEST = 1000


def _text(text_col: str, normalise: Callable[[Column], Column] | None) -> Column:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return text if normalise is None else normalise(text)


def _cell(half: int, cells: int) -> Column:
    """A row's cell in one half: eight bytes of the digest, modulo the half's cells."""
    return F.pmod(F.xxhash64(F.lit(half), F.col("digest")), F.lit(cells // 2)) + F.lit(half * (cells // 2))


def repeated_cells(rows: DataFrame, cells: int = CELLS) -> DataFrame:
    """First pass: the cells hit by more than one row, as bitmaps (page, bits); pages without one are absent."""
    hit = rows.select(F.explode(F.array(_cell(0, cells), _cell(1, cells))).alias("cell"))
    twice = hit.groupBy("cell").agg(F.count(F.lit(1)).alias("hits")).where("hits > 1")
    return twice.groupBy(F.bitmap_bucket_number("cell").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))


def _is_set(bits: Column, cell: Column) -> Column:
    """Whether a bitmap, null without its page, has the cell's bit."""
    at = F.bitmap_bit_position(cell)
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False))


def possibly_repeated(rows: DataFrame, filter_: DataFrame, cells: int = CELLS) -> DataFrame:
    """Second pass: rows with the boolean ``maybe``; where it is false no other row has the digest."""
    for half in (0, 1):
        pages = F.broadcast(filter_.select(F.col("page").alias(f"page{half}"), F.col("bits").alias(f"bits{half}")))
        rows = rows.withColumn(f"cell{half}", _cell(half, cells))
        rows = rows.join(pages, F.bitmap_bucket_number(f"cell{half}") == F.col(f"page{half}"), "left")
    maybe = _is_set(F.col("bits0"), F.col("cell0")) & _is_set(F.col("bits1"), F.col("cell1"))
    return rows.select("doc_id", "row", "digest", maybe.alias("maybe"))


def _numbered(docs: DataFrame, id_col: str, text_col: str, normalise, keep_columns: bool) -> DataFrame:
    """One row a document with a row number, written: row numbers stay what they are when tasks are repeated."""
    digest = F.unhex(F.sha2(_text(text_col, normalise).cast("binary"), 256))
    made = [F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), digest.alias("digest")]
    if keep_columns:
        made.append(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("held"))
    return written(docs.select(*made), "digests")


def _classes(rows: DataFrame, keep: str, cells: int) -> DataFrame:
    best = F.max if keep == "largest" else F.min
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "row")
    if keep == "smallest":
        order = F.struct(F.col("doc_id").isNull().alias("known"), "doc_id", "row")
    looked = written(possibly_repeated(rows, repeated_cells(rows, cells), cells), "looked-up")
    alone = looked.where("not maybe").select("doc_id", "row", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    maybe = looked.where("maybe").drop("maybe")
    groups = maybe.groupBy("digest").agg(best(order).alias("best"), F.count(F.lit(1)).alias("group_size"))
    groups = written(groups.select(F.col("digest").alias("of"), F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size"), "groups")
    large = groups.orderBy(F.desc("group_size"), "of").limit(LARGEST)
    near = maybe.join(F.broadcast(large), F.col("digest") == F.col("of"), "left")
    answers = ("doc_id", "row", "digest", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"))
    far = near.where("of is null").select("doc_id", "row", "digest").join(groups, F.col("digest") == F.col("of"))
    return alone.unionByName(near.where("of is not null").select(*answers)).unionByName(far.select(*answers))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None, keep: str = "largest", cells: int = CELLS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; ``normalise`` maps a text column to what is compared."""
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep: largest or smallest, not {keep}")
    found = _classes(_numbered(docs, id_col, text_col, normalise, False), keep, cells)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None, keep: str = "largest", cells: int = CELLS) -> DataFrame:
    """The rows of docs that stay, with all their columns. Rows that no filter cell holds back meet no join."""
    rows = _numbered(docs, id_col, text_col, normalise, True)
    dropped = _classes(rows.drop("held"), keep, cells).where("not kept").select("row")
    return rows.join(dropped, "row", "left_anti").select("held.*")


def oracle_sql() -> str:
    """op12_exact_dedup for DuckDB, over the view documents."""
    return """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))"""
