"""Best-fit packing of documents into fixed-length training sequences by the linear grouping scheme.

1. Every document becomes token ids plus an end id; longer ones are cut into pieces of the capacity, the first
   piece taking the remainder.
2. The driver sees only the histogram of piece lengths, which has at most ``capacity`` rows whatever the corpus.
3. Lengths over a third of the capacity are grouped by equal cardinality and rounded up to the largest of their group; the few
   sizes left are packed by a configuration linear programme (column generation with a knapsack price). Each configuration
   is used as often as the programme says, rounded to the nearest; the upward ones come last, largest fraction first.
4. Actual pieces are substituted for the rounded ones: in each sequence the longest that their sizes allow, the last one the
   longest that still fits. All space left takes the remaining pieces by best fit, longest first.
5. The plan maps (length, rank among the pieces of that length) to (sequence, offset). Ranks come from counts by
   (length, bucket), so a length that a third of all pieces share is dealt over all buckets.

Null or empty text: the document is the end id alone. Repeated doc_ids: each row is packed; pieces carry the same
doc_id. Empty table: no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import json
import zlib
from array import array
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomledger.llm.common import split_batches, written

#: White space, in RE2's syntax, as the pre-tokenisation pattern's \s has it.
_SPACES = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]{2}|\x{00}"


@lru_cache(maxsize=2)
def _encoding(tokenizer_json: str):
    """The vocabulary of a byte-level BPE file of the tokenizers library, run by tiktoken: the same ids, several times faster.

    Added tokens are found in a text before all else, as the library does by itself."""
    import public_tokenizers
    import tiktoken

    with open(tokenizer_json, encoding="utf-8") as file:
        model = json.load(file)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    added = model.get("added_tokens", [])
    if any(token["single_word"] or token["lstrip"] or token["rstrip"] or token["normalized"] for token in added):
        raise ValueError(f"{tokenizer_json}: added tokens that depend on their neighbours aren't supported")
    special = {token["content"]: token["id"] for token in added}
    ranks = {bytes(spelled[c] for c in token): rank for token, rank in model["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("pack", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def _with_added(encoding) -> tuple:
    """A function that encodes a whole text, and the added tokens' spellings."""
    names = sorted(encoding.special_tokens_set)
    return lambda text: encoding.encode(text, allowed_special="all"), names


class _WordIds:
    """Ids of words met before. A word starts at a space between two other characters, where a pre-token always starts."""

    def __init__(self, encode, limit: int = 120_000):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.flat = array("q", [0]), array("I")

    def look_up(self, words) -> np.ndarray:
        if len(self.known) > self.limit:
            self.clear()
        known, out = self.known, []
        for word in words:
            at = known.get(word)
            if at is None:
                at = known[word] = len(known)
                self.flat.extend(self.encode(word))
                self.starts.append(len(self.flat))
            out.append(at)
        return np.array(out, dtype=np.int64)


@lru_cache(maxsize=1)
def _word_ids(tokenizer_json: str) -> _WordIds:
    """One for each Python worker, kept from task to task."""
    return _WordIds(_encoding(tokenizer_json).encode_ordinary)


def _ids(column: pa.Array, encode, added: list[str], cache: _WordIds, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows, each row followed by end_id, and the offsets of the rows."""
    odd = np.array(pc.match_substring_regex(column, _SPACES).fill_null(False))
    for name in added:
        odd |= np.asarray(pc.match_substring(column, name).fill_null(False))
    marked = pc.replace_substring(pc.if_else(pa.array(odd), "", column), " ", "\0 ")
    lists = pc.split_pattern(marked, "\0")
    counts = np.asarray(pc.list_value_length(lists), dtype=np.int64)
    coded = pc.list_flatten(lists).dictionary_encode()
    names = cache.look_up(coded.dictionary.to_numpy(zero_copy_only=False))
    starts = np.array(cache.starts, dtype=np.int64)
    flat = np.array(cache.flat, dtype=np.uint32)
    words = names[np.asarray(coded.indices, dtype=np.int64)]
    # one more word for each row's end
    ends = np.cumsum(counts)
    begin = np.insert(starts[words], ends, len(flat))
    length = np.insert(starts[words + 1] - starts[words], ends, 1)
    flat = np.append(flat, np.uint32(end_id))
    stop = np.cumsum(length)
    ids = flat[np.repeat(begin - (stop - length), length) + np.arange(stop[-1] if len(stop) else 0)]
    offsets = np.r_[0, stop[ends + np.arange(len(ends))]]
    if odd.any():  # texts with neighbouring white space or added tokens are encoded whole
        parts, row_offsets = [], [0]
        for i in range(len(column)):
            part = np.array([*encode(column[i].as_py()), end_id], dtype=np.uint32) if odd[i] else ids[offsets[i] : offsets[i + 1]]
            parts.append(part)
            row_offsets.append(row_offsets[-1] + len(part))
        ids, offsets = np.concatenate(parts), np.array(row_offsets)
    return ids, offsets


def token_pieces(docs: DataFrame, tokenizer_json: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of at most capacity ids: doc_id, piece, start, length, ids_crc32 and, with keep_ids, the ids."""

    def run(batches):
        encode, added = _with_added(_encoding(tokenizer_json))
        cache = _word_ids(tokenizer_json)
        for batch in split_batches(batches, "text"):
            ids, offsets = _ids(batch.column("text"), encode, added, cache, end_id)
            raw = ids.astype("<u4").tobytes()
            out: dict[str, list] = defaultdict(list)
            for doc, low, high in zip(batch.column("id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                at, piece = low, 0
                while at < high:
                    stop = at + ((high - at) % capacity or capacity)
                    out["doc_id"].append(doc)
                    out["piece"].append(piece)
                    out["start"].append(at - low)
                    out["length"].append(stop - at)
                    out["ids_crc32"].append(zlib.crc32(raw[4 * at : 4 * stop]))
                    if keep_ids:
                        out["ids"].append(ids[at:stop].astype(np.int32))
                    at, piece = stop, piece + 1
            types = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.list_(pa.int32())} if keep_ids else {})
            yield pa.RecordBatch.from_arrays([pa.array(out[k], type=t) for k, t in types.items()], names=list(types))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


# --- the plan, on counts alone ---------------------------------------------------------------------------------


def _knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes (smallest first) that fits the capacity: one item more at a time."""
    room = np.arange(capacity + 1)[:, None] - sizes
    fits, every = room >= 0, np.arange(capacity + 1)
    best, took = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes[0])):
        gain = np.where(fits, best[np.maximum(room, 0)] + prices, -np.inf)
        top = gain.argmax(axis=1)
        more = gain[every, top] > best + 1e-12
        took.append(np.where(more, top, -1))
        best = np.where(more, gain[every, top], best)
    counts, c = np.zeros(len(sizes), dtype=np.int64), capacity
    for level in reversed(took):
        if level[c] >= 0:
            counts[level[c]] += 1
            c -= int(sizes[level[c]])
    return float(best[capacity]), counts


def _configurations(sizes: np.ndarray, needs: np.ndarray, capacity: int, rounds: int = 3000) -> list[tuple[np.ndarray, float]]:
    """Column generation: configurations and how often each is used, covering the needs with about the fewest sequences.

    After so many rounds the configurations found so far are used: a bound on the driver's time, not on the pieces packed."""
    k = len(sizes)
    columns = [np.eye(k)[i] * (capacity // sizes[i]) for i in range(k)]
    cost = np.ones(k)
    inverse = np.diag([1.0 / (capacity // s) for s in sizes])
    x = inverse @ needs
    for step in range(rounds):
        prices = cost @ inverse
        low = int(np.argmin(prices))
        if prices[low] < -1e-9:
            column, price = -np.eye(k)[low], 0.0
        else:
            value, counts = _knapsack(sizes, prices, capacity)
            if value <= 1 + 1e-7:
                break
            column, price = counts.astype(float), 1.0
        change = inverse @ column
        up = change > 1e-10
        if not up.any():
            break
        ratio = np.full(k, np.inf)
        ratio[up] = x[up] / change[up]
        out = int(np.argmin(ratio))
        pivot = inverse[out] / change[out]
        inverse -= np.outer(change, pivot)
        inverse[out] = pivot
        columns[out], cost[out] = column, price
        if step % 100 == 99:
            inverse = np.linalg.inv(np.array(columns).T)
        x = inverse @ needs
    return [(c.astype(np.int64), float(v)) for c, v, p in zip(columns, x, cost, strict=True) if p and v > 1e-9]


def _grouped(counts: dict[int, int], groups: int) -> dict[int, int]:
    """Linear grouping: pieces in groups of equal cardinality, longest first, each counted at its largest length."""
    quota, size, room = -(-sum(counts.values()) // groups), 0, 0
    needs: dict[int, int] = defaultdict(int)
    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            if not room:
                size, room = n, quota
            take = min(left, room)
            needs[size] += take
            left, room = left - take, room - take
    return needs


def plan_sequences(histogram: dict[int, int], capacity: int = 1024, groups: int = 48, large: float = 1 / 3) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, count, first sequence, offset) that place every piece, and the number of sequences.

    The i-th piece of a run goes to sequence first + i at the run's offset."""
    runs: list[tuple[int, int, int, int, int]] = []
    used: dict[int, int] = defaultdict(int)  # ranks given out, by length
    space: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by free ids: (first sequence, count)
    free: list[int] = []
    sequences = 0

    def put(length: int, count: int, first: int, offset: int) -> None:
        if count:
            runs.append((length, used[length], count, first, offset))
            used[length] += count

    def give(room: int, first: int, count: int) -> None:
        if room > 0 and count:
            if room not in space:
                bisect.insort(free, room)
            space[room].append((first, count))

    left = {n: c for n, c in histogram.items() if c > 0}
    for length in [n for n in left if n >= capacity]:
        put(length, left[length], sequences, 0)
        sequences += left.pop(length)

    big = {n: c for n, c in left.items() if n > large * capacity}
    needs = _grouped(big, groups)
    sizes = np.array(sorted(needs), dtype=np.int64)
    uses = []
    if len(sizes):
        for counts, times in _configurations(sizes, np.array([needs[s] for s in sizes.tolist()], dtype=float), capacity):
            slots = np.repeat(sizes, counts)[::-1].tolist()
            whole = int(times + 1e-6)
            uses += [(slots, whole, 0.0), (slots, 1, times - whole)] if times > whole + 0.5 else [(slots, whole, 0.0)]
    # Whole uses first, fullest first, then those for the fractions, largest first.
    uses = sorted((u for u in uses if u[1]), key=lambda u: (u[2] > 0, -u[2], [-s for s in u[0]]))
    there = sorted(big)

    def substituted(slots: list[int]) -> list[int]:
        """Actual lengths for a configuration's sizes, or fewer where the pieces run out."""
        got: list[int] = []
        for i, size in enumerate(slots):
            room = capacity - sum(got)
            at = bisect.bisect_right(there, room if i == len(slots) - 1 else min(size, room)) - 1
            while at >= 0 and left[there[at]] <= got.count(there[at]):
                at -= 1
            if at >= 0:
                got.append(there[at])
        return got

    for slots, repeat, _ in uses:
        while repeat:
            got = substituted(slots)
            if len(got) < len(slots):
                break
            # As long as each length lasts, one run a slot.
            same = min(repeat, *(left[n] // got.count(n) for n in set(got)))
            offset = 0
            for n in got:
                put(n, same, sequences, offset)
                left[n] -= same
                offset += n
            there = [n for n in there if left[n]]
            give(capacity - offset, sequences, same)
            sequences, repeat = sequences + same, repeat - same

    # Best fit, longest first, into the tightest space.
    for length in sorted((n for n in left if left[n] > 0), reverse=True):
        n = left[length]
        while n:
            at = bisect.bisect_left(free, length)
            if at == len(free):
                each = capacity // length
                count = max(1, n // each)
                give(capacity, sequences, count)
                sequences += count
                continue
            room = free[at]
            first, count = space[room].pop()
            if not space[room]:
                del space[room]
                free.pop(at)
            each = min(n, room // length)
            bins = min(count, n // each)
            for i in range(each):
                put(length, bins, first, capacity - room + i * length)
            n -= each * bins
            give(room - each * length, first, bins)
            give(room, first + bins, count - bins)
    return runs, sequences


def pack(pieces: DataFrame, capacity: int = 1024, groups: int = 48) -> DataFrame:
    """Add sequence_id and offset to a table of pieces (columns doc_id, piece, length): see the module's text.

    The pieces are read three times, so hand over a written table."""
    spark = pieces.sparkSession
    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    # At most capacity rows reach the driver.
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = plan_sequences(histogram, capacity, groups)
    before = counts.withColumn(
        "before",
        F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)),
    ).select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", *[c for c in ("start", "ids_crc32") if c in pieces.columns])
    ranked = dealt.withColumn("at", F.row_number().over(within) - 1).join(before, ["length", "bucket"]).withColumn("rank", F.col("at") + F.col("before")).drop("at", "before", "bucket")

    # The plan has a few runs for each length: its size has a bound that doesn't depend on the corpus.
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
    plan = spark.sparkContext.broadcast((table[:, 0] << 40 | table[:, 1], table[:, 1], table[:, 3], table[:, 4]))

    def place(batches):
        keys, first_rank, first, offset = plan.value
        for batch in batches:
            if not batch.num_rows:
                continue
            rank = np.asarray(batch.column("rank"), dtype=np.int64)
            at = np.searchsorted(keys, np.asarray(batch.column("length"), dtype=np.int64) << 40 | rank, side="right") - 1
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(first[at] + rank - first_rank[at]), pa.array(offset[at])],
                names=[*kept, "sequence_id", "offset"],
            )

    names = [c for c in ranked.columns if c != "rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.select(*names).schema) + ", sequence_id long, offset long"
    return ranked.select(*names, F.col("rank").cast("long").alias("rank")).mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_json: str, capacity: int = 1024, end_id: int = 2, groups: int = 48, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Token pieces of the documents with their places: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset."""
    pieces = written(token_pieces(docs, tokenizer_json, capacity, end_id, id_col, text_col, keep_ids), "pieces")
    columns = pieces.columns
    return pack(pieces, capacity, groups).select(*columns, "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The training sequences themselves, from a packing with ids: sequence_id, ids, doc_ids (in order of place)."""
    placed = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return placed.select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.col("p.doc_id").alias("doc_ids"))
