"""Substring lookup: many needles in many texts without comparing each with each, and without an index of the texts.

Needles leave the hashes of themselves and of their beginnings in a bit filter of bounded size, which every task has. Texts are read once, where they are: a rolling
hash over their bytes tells at which places a needle may begin, and only the bytes that stand there go on, to meet the needles in an equality join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomledger.sources.tables import checkpointed

#: Bits of the filter for each needle, and the powers of two between which its size lies (32 MB at most; beyond that more places are sent, and answers don't change).
BITS, LEAST, MOST = 64, 16, 28
#: Places hashed at once.
CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def _sums(data: np.ndarray) -> np.ndarray:
    """Sums of the bytes before every place, times powers of the base: two of them give the hash of what is between."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)))])


def _bits(hashes: np.ndarray, length, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of hashes of strings of a length."""
    mixed = (hashes ^ (np.uint64(1) + np.asarray(length).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed >> np.uint64(64 - width), ((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - width)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _filter(needles: DataFrame, width: int) -> np.ndarray:
    """The bytes of the filter: hashes of all needles, and of their first bytes, as many as a power of two."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                data, offsets = _buffers(batch.column(0).slice(at, 4096))
                sums, back = _sums(data), _powers(_INVERSE, len(data) + 1)
                starts, whole = offsets[:-1], np.diff(offsets)
                for length in (whole, 1 << np.frexp(whole)[1].astype(np.int64) - 1):
                    for bit in _bits((sums[starts + length] - sums[starts]) * back[starts], length, width):
                        yield pa.RecordBatch.from_arrays([pa.array(bit.astype(np.int64))], names=["bit"])

    bits = needles.select(F.col("needle").cast("binary")).mapInArrow(run, "bit long")
    words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("mask")).toArrow()
    out = np.zeros(1 << width - 6, np.int64)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy()
    return out.view(np.uint8)


def _places(data: np.ndarray, offsets: np.ndarray, lengths: dict[int, list[int]], marks: np.ndarray, width: int):
    """length, rows and places where a needle of that length may begin. lengths: by the power of two that isn't over them."""
    longest = max(max(n) for n in lengths.values())

    def marked(hashes, length):
        first, second = _bits(hashes, length, width)
        held = np.flatnonzero((marks[first >> np.uint64(3)] >> (first & np.uint64(7)).astype(np.uint8)) & 1)
        second = second[held]
        return held[((marks[second >> np.uint64(3)] >> (second & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)]

    for a in range(0, len(data), CHUNK):
        part = data[a : a + CHUNK + longest]
        n = min(CHUNK, len(data) - a)
        sums, back = _sums(part), _powers(_INVERSE, n)
        row = np.searchsorted(offsets, np.arange(a, a + n), "right") - 1
        left = offsets[row + 1] - np.arange(a, a + n)
        for power, several in lengths.items():
            at = np.flatnonzero(left >= power)
            at = at[marked((sums[at + power] - sums[at]) * back[at], power)]
            for length in several:
                here = at[left[at] >= length]
                here = here[marked((sums[here + length] - sums[here]) * back[here], length)]
                if len(here):
                    yield length, row[here], here + a


def occurrences(texts: DataFrame, needles: DataFrame, text: str = "text") -> DataFrame:
    """The other columns of texts with piece (binary), whole: what stands where a needle (column needle) may stand, once for each row, and whether it is all of the text.

    Every needle that a text holds is among its pieces, and few others: those that aren't needles have to be dropped by a join. Letters are as they are: fold
    case before. Null and empty texts hold nothing, null and empty needles are in none."""
    needles = checkpointed(needles.where("needle <> ''").select("needle").distinct())
    width = min(MOST, max(LEAST, (needles.count() * BITS).bit_length()))
    lengths: dict[int, list[int]] = {}
    for r in needles.select(F.octet_length("needle").alias("n")).distinct().collect():
        lengths.setdefault(1 << r.n.bit_length() - 1, []).append(r.n)
    rest = [c for c in texts.columns if c != text]
    marks = texts.sparkSession.sparkContext.broadcast(_filter(needles, width))

    def run(batches):
        for batch in batches:
            data, offsets = _buffers(batch.column(0))
            found: dict[int, list] = {}
            for length, row, place in _places(data, offsets, lengths, marks.value, width) if lengths else ():
                found.setdefault(length, []).append((row, place))
            for length, several in found.items():
                row, place = (np.concatenate(x) for x in zip(*several, strict=True))
                for a in range(0, len(row), step := max(1, CHUNK // length)):
                    # Rows go up, so a row's places are together, and a piece may be there twice only where a step ends.
                    b = min(a + step, len(row))
                    pieces = data[place[a:b, None] + np.arange(length)].tobytes()
                    pieces = [pieces[i : i + length] for i in range(0, len(pieces), length)]
                    once = set() if a == 0 or row[a] != row[a - 1] else {p for p in once if p[0] == row[a]}  # noqa: F821
                    kept = []
                    for i, key in enumerate(zip(row[a:b].tolist(), pieces, strict=True)):
                        if key not in once:
                            once.add(key)
                            kept.append(i)
                    if kept:
                        at = row[a:b][kept]
                        own = batch.take(pa.array(at)).columns[1:]
                        yield pa.RecordBatch.from_arrays([*own, pa.array([pieces[i] for i in kept], pa.binary()), pa.array(np.diff(offsets)[at] == length)], names=[*rest, "piece", "whole"])

    kinds = dict(texts.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "piece binary", "whole boolean"])
    return texts.where(F.col(text) != "").select(F.col(text).cast("binary"), *rest).mapInArrow(run, schema)


def contained(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """needle and text of every needle (column needle) that a text (column text) holds, each pair once."""
    texts = texts.where("text <> ''").select("text", F.col("text").alias("_text")).distinct()
    met = occurrences(texts, needles).select(F.col("piece").alias("_p"), F.col("_text").alias("text"))
    return met.join(needles.where("needle <> ''").select("needle").distinct(), F.col("_p") == F.col("needle").cast("binary")).select("needle", "text")
