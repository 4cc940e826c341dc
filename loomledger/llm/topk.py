"""Exact top-k inner-product search by no-random-access aggregation.

Vectors become integers, floor(scale * x). Rows are dealt into blocks, and a block into runs of ``run`` rows; a run keeps one
list for each dimension, of (row, value) sorted by value, and knows the lists' ends. A query needs every list from the end that suits the sign of its
component, deeper where the component is larger, a step further each round, and never looks a row up: what was read is kept
for its row, and nothing else of a row is known. Lists are read once for ``TOGETHER`` queries, from both ends; the bounds of all of these are
one product of their components with what is known of the rows, so what a query costs by itself is arithmetic, not reading. An entry not read yet is at most the list's last value read, which
bounds a row's score from above, and at least the list's far end, which bounds it from below. The bar is the k-th best of the
scores resolved so far and of the lower bounds. Rows whose upper bound is under the bar, and so all rows not met yet when the
sum of the last values read is under it, can't qualify. When at most ``2 k`` rows can, the lists are read on until all of those have
been met everywhere: their sums are then their scores, and the bar goes on to the next run. ``entries_read`` tells, with each
query, how many entries of its lists had been read when it was answered, and ``entries`` how many there were.

The work is queries times rows: vectors that point everywhere leave no bound that would spare a query most of the rows.

A block of rows stays in one task while queries stream past it, so each row travels once for every ``queries_per_part`` queries, and each
query once for every block. A block has ``rows_per_block`` rows and 2 Mi components at most, fewer rows if there would be fewer blocks than tasks at once.

Scores are exact: integers below 2^24 in single precision, below 2^53 as doubles, larger ones as Python integers. A score that a long can't hold is an
error (OverflowError), never a wrong number.

Vectors that are null or hold null, NaN or infinite components take no part. Vectors of different dimensions
don't meet. Rows that repeat a vec_id count once (the smallest vector). Ties go to the smaller vec_id. Empty table: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ROWS = "d int, block long, part int, asks int, id long, v array<double>"
#: Groups of lists of about one weight, for each of which a round has one depth.
GROUPS = 4
#: Queries for which lists are read together: a bound for each of them and each row of a run is held at once.
TOGETHER = 1024
#: Components that a block holds at most, and rows that it holds at least before it is made smaller for the sake of more tasks.
COMPONENTS, LEAST = 1 << 21, 4096
_FOUND = "query_id long, vec_id long, score long, read long, held long"


def usable(vector: str) -> Column:
    """Whether a vector takes part: not null, not empty, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls, all of one length, as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


class SortedLists:
    """A run of rows: their ids, and a sorted list of (row, value) for each dimension. Lists are read from either end; of what isn't read only the two ends of each list are known."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray):
        self.ids, self.m = ids, len(ids)
        order = np.argsort(rows, axis=0, kind="stable").T
        value = np.take_along_axis(rows.T, order, axis=1)
        # From the small end and from the large end: both as dimension x place.
        self._rows = np.ascontiguousarray(np.stack([order, order[:, ::-1]]), dtype=np.intp)
        self._values = np.ascontiguousarray(np.stack([value, value[:, ::-1]]))
        self.least, self.most = value[:, 0].copy(), value[:, -1].copy()
        self.largest = float(np.abs(rows).max(initial=0.0))
        self._by_id = np.argsort(ids, kind="stable")

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Where rows of these ids stand; -1: not here."""
        at = self._by_id[np.minimum(np.searchsorted(self.ids, ids, sorter=self._by_id), self.m - 1)]
        return np.where(self.ids[at] == ids, at, -1)

    def read(self, dims: np.ndarray, large: bool, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and values of the entries from begin to end of the lists of dims, counted from their large or small ends."""
        return self._rows[int(large), dims, begin:end], self._values[int(large), dims, begin:end]


class Reading:
    """How far a run's lists are read for a batch of queries. A list is read once for all queries that want it from that end."""

    def __init__(self, lists: SortedLists, queries: np.ndarray, kind: type = np.float64):
        self.lists, d = lists, queries.shape[1]
        # A negative component reads its list from the small end (the first d columns), a positive one from the large end.
        self.signed = np.concatenate([np.minimum(queries, 0.0), np.maximum(queries, 0.0)], axis=1)
        used = np.flatnonzero(self.signed.any(axis=0))  # a component of zero needs no list
        self.signed = self.signed[:, used].astype(kind)
        self.wants, self.dims, large = self.signed != 0, used % d, used >= d
        size = np.abs(self.signed).mean(axis=0, dtype=np.float64)
        heavy = np.argsort(-size, kind="stable")
        # Lists are read in groups of one end and of about one weight, each group to one depth.
        self.groups = [g for part in np.array_split(heavy, min(GROUPS, max(1, len(used)))) for g in (part[large[part]], part[~large[part]]) if len(g)]
        self.large = [bool(large[g[0]]) for g in self.groups]
        weight = np.sqrt(size)
        self.weight = [weight[g].mean() / max(weight.mean(), 1e-300) for g in self.groups]
        self.last = np.where(large, lists.most[self.dims], lists.least[self.dims]).astype(kind)
        self.far = np.where(large, lists.least[self.dims], lists.most[self.dims]).astype(kind)
        # What is known of an entry, as list x row: its value, or if it is unread the last value read of its list.
        self.near = np.repeat(self.last[:, None], lists.m, axis=1)
        self.unread = np.ones((len(used), lists.m), dtype=bool)
        self.depth = np.zeros(len(used), np.int64)

    def read_to(self, ends: list[int]) -> None:
        """Reads each group of lists on to an end."""
        for group, large, end in zip(self.groups, self.large, ends, strict=True):
            begin = int(self.depth[group[0]])
            if end > begin:
                rows, values = self.lists.read(self.dims[group], large, begin, end)
                for at, row, value in zip(group.tolist(), rows, values.astype(self.near.dtype), strict=True):
                    self.near[at][row], self.unread[at][row] = value, False
                self.last[group], self.depth[group] = values[:, -1], end
        np.copyto(self.near, self.last[:, None], where=self.unread)


def aggregate_all(lists: SortedLists, queries: np.ndarray, own_ids: np.ndarray, k: int, bars: np.ndarray, slack: np.ndarray, step: float = 0.15, kind: type = np.float64) -> list[tuple[np.ndarray, np.ndarray, np.ndarray | None, int]]:
    """For each query the rows of a run that can still be among its k best, with their scores, or (where its slack isn't 0) with all of their values, and the number of entries read of its lists.

    bars: scores that k other rows reach; slack: what rounding can add to a bound; kind: holds all bounds."""
    m, reading = lists.m, Reading(lists, queries, kind)
    own = lists.places(own_ids)
    found: list = [None] * len(queries)

    def finish(i: int, alive: np.ndarray, score: np.ndarray) -> None:
        values = None
        if slack[i]:
            values = np.zeros((queries.shape[1], len(alive)))
            mine = np.flatnonzero(reading.wants[i])
            values[reading.dims[mine]] = reading.near[np.ix_(mine, alive)]
        found[i] = alive, score, values, int(reading.depth[reading.wants[i]].sum())

    some = reading.wants.any(axis=1)
    for i in np.flatnonzero(~some):
        alive = np.delete(np.arange(m), own[i] if own[i] >= 0 else [])
        finish(i, alive, np.zeros(len(alive)))
    many, share = np.flatnonzero(some), 3 * step
    # Queries with few rows left, and these rows: pairs in order of queries.
    asks, rows = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def met() -> np.ndarray:
        """Ends the queries whose few rows have been met in all of their lists: their sums are their scores. Tells in which lists the others' rows are missing."""
        nonlocal asks, rows
        lacks = reading.unread.T[rows] & reading.wants[asks]
        waits = np.zeros(len(queries), dtype=bool)
        waits[asks[lacks.any(axis=1)]] = True
        done = ~waits[asks]
        score = (reading.near.T[rows[done]] * reading.signed[asks[done]]).sum(axis=1)
        ends, begins = np.unique(asks[done], return_index=True)
        for i, alive, sums in zip(ends.tolist(), np.split(rows[done], begins[1:]), np.split(score, begins[1:]), strict=False):
            finish(i, alive, sums)
        asks, rows = asks[~done], rows[~done]
        return lacks[~done].any(axis=0)

    while len(many):
        reading.read_to([int(min(m, max(1, np.ceil(share * m * w)))) for w in reading.weight])
        bar, at, mine = bars[many] - slack[many], np.flatnonzero(own[many] >= 0), own[many]
        if m > k and len(fresh := np.flatnonzero(bars[many] == -np.inf)):
            lower = reading.signed[many[fresh]] @ np.where(reading.unread, reading.far[:, None], reading.near)
            itself = np.flatnonzero(mine[fresh] >= 0)
            lower[itself, mine[fresh][itself]] = -np.inf
            bar[fresh] = np.partition(lower, m - k, axis=1)[:, m - k] - slack[many[fresh]]
        upper = reading.signed[many] @ reading.near
        # A bound that is no number keeps its row.
        kept = ~(upper < bar.astype(kind)[:, None])
        kept[at, mine[at]] = False
        left = np.count_nonzero(kept, axis=1)
        if (reading.depth == m).all():
            for j, i in enumerate(many.tolist()):
                alive = np.flatnonzero(kept[j])
                finish(i, alive, upper[j, alive])
            few = np.ones(len(many), dtype=bool)
        else:
            few = left <= 2 * k
            for i in many[few & (left == 0)].tolist():
                finish(i, np.zeros(0, np.int64), np.zeros(0))
            ask, row = np.nonzero(kept[few])
            asks, rows = np.r_[asks, many[few][ask]], np.r_[rows, row]
            by_query = np.argsort(asks, kind="stable")
            asks, rows = asks[by_query], rows[by_query]
        many = many[~few]
        missing = met()
        share += step
    # Read on until the rows left have been met in all lists.
    while len(asks):
        reading.read_to([min(m, int(reading.depth[g[0]]) + max(1, m // 16) * bool(missing[g].any())) for g in reading.groups])
        missing = met()
    return found


def aggregate(lists: SortedLists, query: np.ndarray, own_id: int, k: int, bar: float, slack: float, step: float = 0.15) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, int]:
    """``aggregate_all`` for one query."""
    return aggregate_all(lists, query[None], np.array([own_id]), k, np.array([bar]), np.array([slack]), step)[0]


def best_of_block(runs: list[SortedLists], queries: np.ndarray, own_ids: np.ndarray, k: int) -> list[tuple[list[tuple[int, int]], int]]:
    """For each query (-score, id) of the k best rows of a block's runs, ties to the smaller id, and the number of entries read."""
    best: list[list[tuple[int, int]]] = [[] for _ in queries]
    read, bars = [0] * len(queries), np.full(len(queries), -np.inf)
    with np.errstate(over="ignore", invalid="ignore"):
        reach = np.abs(queries).sum(axis=1)
        # Sums of integers that stay under 2^24 are exact in single precision, under 2^53 in double.
        kind = np.float32 if reach.max(initial=0.0) * max(lists.largest for lists in runs) < 2.0**24 else np.float64
        for lists in runs:
            bound = reach * lists.largest
            slack = np.where(bound < 2.0**53, 0.0, np.maximum(1e-12 * bound, 5e-324))
            for i, (alive, score, values, entries) in enumerate(aggregate_all(lists, queries, own_ids, k, bars, slack, kind=kind)):
                read[i] += entries
                if values is None:
                    score = score.astype(np.int64)
                    if len(alive) > 4 * k:
                        few = score >= np.partition(score, len(score) - k)[len(score) - k]
                        alive, score = alive[few], score[few]
                    score = score.tolist()
                else:
                    whole = [int(x) for x in queries[i]]
                    score = [sum(int(x) * q for x, q in zip(row, whole, strict=True)) for row in values.T.tolist()]
                best[i] = sorted([*best[i], *zip((-s for s in score), lists.ids[alive].tolist(), strict=True)])[:k]
                if len(best[i]) == k:
                    bars[i] = -float(best[i][-1][0])
    return list(zip(best, read, strict=True))


def search(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, rows_per_block: int = 32768, queries_per_part: int = 65536, run: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score, entries_read, entries: the k best rows of each query; queries are the rows whose id is divisible by ``every``."""
    ready = (
        vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"))
        .where(F.col("id").isNotNull() & usable("v"))
        .groupBy("id")
        .agg(F.min("v").alias("v"), F.max(F.size("v")).alias("longest"))
        .withColumn("d", F.size("v"))
    )
    asks = F.col("id") % every == 0
    n = ready.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(asks, 1)).alias("queries"), F.coalesce(F.sum("longest"), F.lit(0)).alias("components")).first()
    # Large blocks, since queries travel to each; smaller ones where there would be fewer than there are cores.
    spread = min(-(-n["rows"] // LEAST), 2 * vectors.sparkSession.sparkContext.defaultParallelism)
    blocks = max(1, -(-n["rows"] // rows_per_block), -(-n["components"] // COMPONENTS), spread)
    parts = max(1, -(-n["queries"] // queries_per_part))
    each = lambda n, kind: F.explode(F.sequence(F.lit(0).cast(kind), F.lit(n - 1).cast(kind)))
    # Every block of rows meets every part of the queries: a stated query set against all rows.
    rows = ready.select("d", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), each(parts, "int").alias("part"), F.lit(0).alias("asks"), "id", "v")
    queries = ready.where(asks).select("d", each(blocks, "long").alias("block"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("asks"), "id", "v")

    def integers(batch: pa.RecordBatch) -> np.ndarray:
        with np.errstate(over="ignore"):
            found = np.floor(scale * matrix(batch.column("v")))
        if not np.isfinite(found).all():
            raise OverflowError("a component times the scale is no finite number")
        return found

    def answered(runs: list[SortedLists], asking: pa.RecordBatch) -> pa.RecordBatch:
        out: tuple[list, ...] = ([], [], [], [], [])
        ids, asked = np.asarray(asking.column("id"), dtype=np.int64), integers(asking)
        held = sum(lists.m for lists in runs) * asked.shape[1]
        found = (x for at in range(0, len(ids), TOGETHER) for x in best_of_block(runs, asked[at : at + TOGETHER], ids[at : at + TOGETHER], k))
        for own, (best, read) in zip(ids.tolist(), found, strict=True):
            # The counts travel on the first row of each block's answer.
            for i, (score, row) in enumerate(best):
                if not -(2**63) <= -score < 2**63:
                    raise OverflowError(f"the score of {own} and {row} doesn't fit a long")
                for column, value in zip(out, (own, row, -score, read if i == 0 else 0, held if i == 0 else 0), strict=True):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score", "read", "held"])

    def scan(batches):
        now, held, runs = None, [], None
        for batch in batches:
            columns = [np.asarray(batch.column(c), dtype=np.int64) for c in ("d", "block", "part", "asks")]
            edges = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0), True]) if batch.num_rows else []
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                key = tuple(int(c[low]) for c in columns[:3])
                if key != now:
                    now, held, runs = key, [], None
                piece = batch.slice(low, high - low)
                if not columns[3][low]:
                    held.append(piece)
                elif held or runs:
                    if runs is None:
                        x, ids = np.concatenate([integers(h) for h in held]), np.concatenate([np.asarray(h.column("id"), dtype=np.int64) for h in held])
                        runs, held = [SortedLists(x[at : at + run], ids[at : at + run]) for at in range(0, len(x), run)], []
                    yield answered(runs, piece)

    dealt = rows.union(queries).repartitionById(blocks * parts, (F.col("block") * parts + F.col("part")).cast("int"))
    met = dealt.sortWithinPartitions("d", "block", "part", "asks", "id").mapInArrow(scan, _FOUND)
    of_query = Window.partitionBy("query_id")
    ranked = met.select(
        "query_id",
        F.row_number().over(of_query.orderBy(F.desc("score"), "vec_id")).alias("rank"),
        "vec_id",
        "score",
        F.sum("read").over(of_query).alias("entries_read"),
        F.sum("held").over(of_query).alias("entries"),
    )
    return ranked.where(F.col("rank") <= k)
