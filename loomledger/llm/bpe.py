"""Byte-level BPE encoding in overlapping chunks, and decoding.

A text is cut into chunks that overlap. Each is pre-tokenised on its own. The matches
from a position on depend only on the text from there on, so two neighbouring chunks that have one boundary in
common inside their overlap agree on all later ones: the first such boundary after a character that isn't white
space is the seam (after white space the look-ahead could still see the other side). The pieces between the seams
are encoded independently and their ids concatenated in order. Where two chunks never agree, as within one word
longer than the overlap, the seam is left out and the neighbours are encoded as one piece. Decoding concatenates the tokens'
bytes.

The chunks of a text of up to ``deal`` characters stay in its task; those of a longer text are dealt over all tasks, and so are
its pieces, whose ids then stream by in order. The result depends neither on ``deal`` nor on the chunks.

Null text counts as empty: no ids. Repeated doc_ids are kept apart by row. Empty table: no rows. Other columns of
the input are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomledger.llm.common import split_batches

#: A boundary this near a chunk's end may come from the cut, not from the text.
_MARGIN = 2


@lru_cache(maxsize=2)
def load(ranks_path: str, pattern: str):
    """The encoding of a rank file, without special tokens."""
    import tiktoken

    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


_COLUMNS = {"ids": {"ids": ("array<int>", pa.list_(pa.int32()))}, "digests": {"n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}}


def _ids(encoding, piece: str) -> bytes:
    """The ids of a piece, as bytes: one call, whatever number of pre-tokens it has."""
    return np.array(encoding.encode_ordinary(piece), dtype="<u4").tobytes()


class _Bytes:
    """Decoding: the bytes of all tokens one after the other, and where each begins."""

    def __init__(self, encoding):
        tokens = [b""] * encoding.n_vocab
        for token in encoding.token_byte_values():
            tokens[encoding.encode_single_token(token)] = token
        self.size = np.array([*map(len, tokens)], dtype=np.int64)
        self.begin, self.flat = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(tokens), np.uint8)

    def of(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        stop = np.cumsum(size)
        return self.flat[np.repeat(self.begin[ids] - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)].tobytes()


@lru_cache(maxsize=1)
def _bytes(ranks_path: str, pattern: str) -> _Bytes:
    """One for each Python worker, kept from task to task."""
    return _Bytes(load(ranks_path, pattern))


class _Joined:
    """The ids of one text's pieces in order, or their count and the digests of the ids and of the decoded bytes."""

    def __init__(self, decoder: _Bytes, output: str):
        self.decoder, self.output = decoder, output
        self.n, self.parts, self.ids, self.decoded = 0, [], hashlib.sha256(), hashlib.sha256()

    def add(self, raw: bytes) -> None:
        self.n += len(raw) // 4
        if self.output == "ids":
            self.parts.append(raw)
        else:
            self.ids.update(raw)
            self.decoded.update(self.decoder.of(np.frombuffer(raw, "<u4")))

    def columns(self) -> tuple:
        if self.output == "ids":
            return (np.frombuffer(b"".join(self.parts), "<u4").astype(np.int32),)
        return self.n, self.ids.hexdigest(), self.decoded.hexdigest()


@lru_cache(maxsize=2)
def _compiled(pattern: str):
    found = regex.compile(pattern)
    if found.groups:
        raise ValueError("the pattern must not have capturing groups")
    return found


def boundaries(pattern: str, text: str) -> list[int]:
    """Where the pre-tokens of a text end."""
    ends = [*accumulate(map(len, _compiled(pattern).findall(text)))]
    if (ends[-1] if ends else 0) != len(text):
        raise ValueError("the pattern must match every character")
    return ends


def edges(text: str, ends: list[int], start: int, step: int, overlap: int) -> tuple[list[int], list[int]]:
    """Ends of a chunk's pre-tokens that may be seams (the character before is no white space) in its two overlaps; the chunk begins at start."""
    n = bisect.bisect_left(ends, len(text) - _MARGIN)
    head, tail = ends[: bisect.bisect_left(ends, overlap, 0, n)], ends[bisect.bisect_left(ends, step, 0, n) : n]
    return tuple([start + p for p in side if not text[p - 1].isspace()] for side in (head, tail))


def chunk_starts(size: int, chunk: int, overlap: int) -> range:
    return range(0, max(1, size - overlap), chunk - overlap)


def pieces(pattern: str, text: str, chunk: int, overlap: int) -> list[str]:
    """A text between its seams. A text of one chunk has none, so its pre-tokens needn't be found."""
    starts = chunk_starts(len(text), chunk, overlap)
    if len(starts) == 1:
        return [text]
    seams, before = [0], set()
    for start in starts:
        part = text[start : start + chunk]
        head, tail = edges(part, boundaries(pattern, part), start, chunk - overlap, overlap)
        if start:
            seams.append(min(before.intersection(head), default=None))
        before = set(tail)
    # Neighbours without a seam are one piece.
    cuts = [*(s for s in seams if s is not None), len(text)]
    return [text[low:high] for low, high in zip(cuts, cuts[1:], strict=False)]


def encode(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = 2048, overlap: int = 128, output: str = "ids", deal: int = 65536, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and either its ids (output="ids") or their count and digests, with the digest of the decoded bytes (output="digests").

    chunk, overlap and deal are in characters."""
    columns = _COLUMNS[output]
    schema = "doc_id long, " + ", ".join(f"{name} {kind[0]}" for name, kind in columns.items())
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def answer(ids: list, found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array([row[i] for row in found], type=kind[1]) for i, kind in enumerate(columns.values()))], names=["doc_id", *columns])

    def whole(batches):
        encoding, decoder = load(ranks_path, pattern), _bytes(ranks_path, pattern)
        for batch in split_batches(batches, "text", 4 << 20):
            found = []
            for text in batch.column("text").to_numpy(zero_copy_only=False):
                joined = _Joined(decoder, output)
                for piece in pieces(pattern, text, chunk, overlap):
                    joined.add(_ids(encoding, piece))
                found.append(joined.columns())
            yield answer(batch.column("doc_id").to_pylist(), found)

    near = texts.where(F.length("text") <= deal).mapInArrow(whole, schema)

    def cut(batches):
        for batch in split_batches(batches, "text", 4 << 20):
            for doc, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text")), strict=True):
                starts = chunk_starts(len(text), chunk, overlap)
                for low in range(0, len(starts), 64):
                    part = starts[low : low + 64]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc] * len(part), pa.int64()), "row": pa.array([row] * len(part), pa.int64()), "start": pa.array(part, pa.int64()), "text": [text[s : s + chunk] for s in part]})

    def pre_tokenise(batches):
        for batch in batches:
            found = [edges(text, boundaries(pattern, text), start, chunk - overlap, overlap) for start, text in zip(batch.column("start").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([f[i] for f in found], pa.list_(pa.int64())) for i in (0, 1))], names=[*batch.schema.names, "head", "tail"])

    long = texts.where(F.length("text") > deal).withColumn("row", F.monotonically_increasing_id())
    chunks = long.mapInArrow(cut, "doc_id long, row long, start long, text string")
    # Chunks of one text meet again only for their seams; the matching itself is dealt over all tasks.
    chunks = chunks.repartition("row", "start").mapInArrow(pre_tokenise, "doc_id long, row long, start long, text string, head array<long>, tail array<long>")
    order = Window.partitionBy("doc_id", "row").orderBy("start")
    seam = F.array_min(F.array_intersect("tail", F.lead("head").over(order)))
    sewn = chunks.select("doc_id", "row", "start", "text", seam.alias("stop"))
    sewn = sewn.select(
        "doc_id",
        "row",
        "start",
        F.coalesce(F.lag("stop").over(order), "start").alias("from"),
        F.coalesce("stop", F.lead("start").over(order), F.col("start") + F.length("text")).alias("to"),
        "text",
        F.coalesce(F.sum(F.col("stop").isNotNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("piece"),
    ).select("doc_id", "row", "start", "piece", F.expr("substring(text, cast(`from` - start as int) + 1, cast(`to` - `from` as int))").alias("text"))
    sewn = sewn.groupBy("doc_id", "row", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "").alias("text"))

    def encode_pieces(batches):
        encoding = load(ranks_path, pattern)
        for batch in split_batches(batches, "text", 4 << 20):
            ids = [_ids(encoding, t) for t in batch.column("text").to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "row", "piece")), pa.array(ids, pa.binary())], names=["doc_id", "row", "piece", "ids"])

    def join_ids(batches):
        decoder, now, joined = _bytes(ranks_path, pattern), None, None
        for batch in batches:
            for doc, row, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "ids")), strict=True):
                if (doc, row) != now:
                    if joined:
                        yield answer([now[0]], [joined.columns()])
                    now, joined = (doc, row), _Joined(decoder, output)
                joined.add(ids)
        if joined:
            yield answer([now[0]], [joined.columns()])

    encoded = sewn.repartition("doc_id", "row", "piece").mapInArrow(encode_pieces, "doc_id long, row long, piece long, ids binary")
    return near.unionByName(encoded.repartition("row").sortWithinPartitions("row", "piece").mapInArrow(join_ids, schema))


def decode(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the bytes of its ids; null ids count as none."""

    def run(batches):
        encoding = load(ranks_path, pattern)
        for batch in batches:
            decoded = [encoding.decode_bytes(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(decoded, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, bytes binary")
