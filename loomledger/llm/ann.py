"""Approximate nearest neighbours (largest inner product) with balanced posting lists.

Index: centroids come from a k-means on a sample (bounded as the number of lists is) that charges full clusters extra, so that posting lists are
balanced. Inner product becomes distance by one more component, sqrt(M^2 - |x|^2) (zero for the queries). Every
vector joins the list of its nearest centroid and, near a boundary, those of other centroids at most ``spread`` times as
far. Lists longer than ``list_rows`` are split into parts, so a list that a third of all vectors share is dealt over many
tasks. Parts are put together into shards of at most ``shard_bytes`` of vectors and a part, so there are more shards the
more rows are posted. All vectors are indexed; only the centroids see a sample.

Assignment: the centroids form a graph in memory (hubs linked to many centroids around them, every centroid to its nearest ones). A vector
goes in at its nearest hubs, on to their links and to the links of the best it has met. Vectors of a batch that stand at one hub go on together, as one product.

Search: a query visits the lists at most ``ratio`` times as far as the nearest (``probes`` of all lists at most), and however far they are as
many of the nearest as hold ``floor`` times the rows it asks for, replicas counted once. With ``recall`` the ratio is measured instead: ``asked`` queries,
drawn by hashed id, are compared with every row of the table, and the ratio (to the mean distance of the nearest hundredth of the lists) is the smallest that finds this share of their true neighbours,
with as many replicas, up to ``replicas``, as leave the fewest rows to compare. Lists are kept in shards, and a
query travels once to each shard that holds a list it visits, with the distance up to which it visits. A task holds one shard at a time, and the queries pass by it
in batches. Products in the column's own precision, with bounds of their rounding, tell which rows may be among the best; these have their exact inner products
of the original vectors in double precision. Of more than k + 1 equal vectors of a list, only those of the smallest ids can be found, so the others aren't held.

Vectors that are null, zero, or hold null, NaN or infinite components take no part. Vectors of different dimensions have no inner product: each dimension
is searched for itself, with an index of its own, or, if it isn't the most common one and has at most ``FEW`` rows, by comparing all its rows. Rows that repeat a vec_id count once (the smallest vector). Ties go to the smaller vec_id. Fewer rows than asked for: all of them
are candidates. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from loomledger.llm.topk import matrix, usable

#: Rows that meet in a shard: vectors of a list (asks 0) and queries with the squared distance up to which they visit lists (asks 1). list is 0 for queries, far for vectors.
KIND = "shard long, asks int, list int, id long, far double, v binary"
NAMES = ["shard", "asks", "list", "id", "far", "v"]
#: The best rows of a query in one shard.
FOUND = "query_id long, vec_ids array<long>, scores array<double>"
#: So many products of a query and a row, or of a vector and a centroid, are held at once.
PRODUCTS = 1 << 20
#: In a shard's innermost loop, so many as stay in a core's cache.
NEAR = 1 << 18
#: Squared distances differ by less than this when they are computed again; vectors are scaled to a length of 1 at most.
SLACK = 4e-6
#: Rows of a dimension, and their components together, up to which it needs no index.
FEW, COMPONENTS = 1024, 1 << 22


def balanced_centroids(sample: np.ndarray, lists: int, rounds: int = 12, charge: float = 0.1) -> np.ndarray:
    """k-means on a sphere (lifted vectors have one norm) whose assignment adds a charge that grows with the cluster's size in the round before."""
    rng = np.random.default_rng(5)
    lists = min(lists, len(sample))
    centroids = sample[np.sort(rng.permutation(len(sample))[:lists])].copy()
    price = np.zeros(lists, dtype=sample.dtype)
    radius = float(np.sqrt((sample**2).sum(axis=1).max()))
    for _ in range(rounds):
        near = np.empty(len(sample), dtype=np.int64)
        step = max(16, PRODUCTS // lists)
        cost, twice = (centroids**2).sum(axis=1) + price, -2 * centroids.T
        for low in range(0, len(sample), step):
            far = sample[low : low + step] @ twice
            far += cost
            near[low : low + step] = np.argmin(far, axis=1)
        size = np.bincount(near, minlength=lists)
        price = (charge * radius**2 * np.minimum(3.0, size * lists / len(sample) - 1)).astype(sample.dtype)
        total = np.stack([np.bincount(near, weights=sample[:, j], minlength=lists) for j in range(sample.shape[1])], axis=1)
        filled = size > 0
        length = np.sqrt((total[filled] ** 2).sum(axis=1))
        centroids[filled] = total[filled] * (radius / np.maximum(length, 1e-12))[:, None]
        for empty in np.flatnonzero(~filled):
            centroids[empty] = sample[rng.integers(len(sample))]
    return centroids


class CentroidGraph:
    """Centroids; every one is linked to its nearest ones, and hubs are linked to many around them."""

    def __init__(self, centroids: np.ndarray, near: int = 8, doors: int = 3, small: int = 4096):
        self.centroids = centroids.astype(np.float32)
        self.norm = (self.centroids**2).sum(axis=1)
        n, self.doors = len(centroids), doors
        #: Small graphs have one hub that is linked to all.
        self.hubs = np.zeros(1, np.int64) if n <= small else np.unique(np.linspace(0, n - 1, int(2 * np.sqrt(n))).astype(np.int64))
        self.around = [np.arange(n)] if n <= small else list(self._links(self.hubs, max(small // 8, n // 16)))
        self.links = None if n <= small else self._links(np.arange(n), near + 1)

    def _links(self, nodes: np.ndarray, most: int) -> np.ndarray:
        step = max(16, PRODUCTS // len(self.norm))
        return np.concatenate([np.argpartition(self.distances(self.centroids[nodes[low : low + step]]), most - 1, axis=1)[:, :most] for low in range(0, len(nodes), step)])

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        """Squared distances of vectors and all centroids."""
        far = vectors.astype(np.float32) @ (-2 * self.centroids.T)
        far += self.norm
        far += np.einsum("ij,ij->i", vectors, vectors).astype(np.float32)[:, None]
        return np.maximum(far, 0, out=far)

    def near(self, vectors: np.ndarray, within: float, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(vector, centroid): of the centroids that the search meets, those at most ``within`` times as far as the nearest, ``most`` of them at most."""
        vectors = vectors.astype(np.float32)
        own = np.einsum("ij,ij->i", vectors, vectors)
        met: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def meet(rows: np.ndarray, nodes: np.ndarray) -> None:
            """These rows meet all of these centroids: kept are those that may be near enough."""
            side, norm = -2 * self.centroids[nodes].T, self.norm[nodes]
            for low in range(0, len(rows), step := max(16, PRODUCTS // len(nodes))):
                some = rows[low : low + step]
                far = vectors[some] @ side
                far += norm
                least = np.maximum(far.min(axis=1) + own[some], 0)
                row, at = np.divmod(np.flatnonzero(far <= ((within * np.sqrt(least) + 1e-6) ** 2 - own[some] + SLACK)[:, None]), len(nodes))
                met.append((some[row], nodes[at], np.maximum(far[row, at] + own[some[row]], 0)))

        def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """What was met, each centroid once, by vector and distance, and how far the nearest is."""
            row, node, far = (np.concatenate([x[i] for x in met]) for i in range(3))
            _, once = np.unique(row * len(self.norm) + node, return_index=True)
            by = once[np.lexsort((node[once], far[once], row[once]))]
            return row[by], node[by], np.sqrt(far[by])

        if len(self.hubs) == 1:
            meet(np.arange(len(vectors)), self.around[0])
        else:
            far = self.norm[self.hubs] - 2 * vectors @ self.centroids[self.hubs].T
            hub = np.argpartition(far, self.doors - 1, axis=1)[:, : self.doors].ravel()
            by = np.argsort(hub, kind="stable")
            edges = np.searchsorted(hub[by], np.arange(len(self.hubs) + 1))
            for h in range(len(self.hubs)):
                if edges[h] < edges[h + 1]:
                    meet(by[edges[h] : edges[h + 1]] // self.doors, self.around[h])
            row, node, _ = best()
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            for low in range(0, len(first), step := max(16, PRODUCTS // self.links.shape[1] // vectors.shape[1])):
                row_, linked = row[first[low : low + step]], self.links[node[first[low : low + step]]]
                far = np.einsum("ij,ikj->ik", vectors[row_], self.centroids[linked])
                met.append((np.repeat(row_, linked.shape[1]), linked.ravel(), np.maximum(own[row_][:, None] + self.norm[linked] - 2 * far, 0).ravel()))
        row, node, far = best()
        first = np.searchsorted(row, row)
        keep = (far <= within * far[first] + 1e-6) & (np.arange(len(row)) - first < most)
        return row[keep], node[keep]


def _rows(column: pa.Array, dtype: str) -> np.ndarray:
    """A list column, or a binary one of whole rows, without nulls, all of one length, as a matrix."""
    if not pa.types.is_binary(column.type):
        return np.asarray(column.flatten()).astype(dtype, copy=False).reshape(len(column), -1)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(dtype).reshape(len(column), -1)


def _bytes(x: np.ndarray) -> pa.Array:
    """A matrix as a binary column."""
    width = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def _lifted(vectors: np.ndarray, largest: float, query: bool = False) -> np.ndarray:
    """Vectors, scaled to a length of 1 at most, with the component that turns inner products into distances; queries get zero."""
    unit = vectors / np.float64(largest)
    extra = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", unit, unit), 0))
    return np.hstack([unit, extra[:, None]]).astype(np.float32)


def _unit(far: np.ndarray, first: int, nearer: float = 0.0) -> np.ndarray:
    """The mean distance of each query's ``first`` nearest lists, from squared distances; ``nearer`` at least."""
    return np.maximum(np.sqrt(np.partition(far, first - 1, axis=1)[:, :first].astype(np.float64)).mean(axis=1), nearer)


def _reach(far: np.ndarray, width: int, ratio: float, sizes: np.ndarray, least: int, first: int = 1, nearer: float = 0.0) -> np.ndarray:
    """The squared distance up to which each query visits lists: ``ratio`` times that of its ``first`` nearest lists, ``width`` lists at most, but as many as hold ``least`` rows by ``sizes``."""
    bar = (ratio * _unit(far, first, nearer) + 1e-9) ** 2
    if width < far.shape[1]:
        wide = np.flatnonzero((far <= bar[:, None]).sum(axis=1) > width)
        bar[wide] = np.partition(far[wide], width - 1, axis=1)[:, width - 1]
    short = np.flatnonzero((far <= bar[:, None]) @ sizes.astype(np.float64) < least)
    if len(short):
        order = np.argsort(far[short], axis=1, kind="stable")
        enough = np.minimum((np.cumsum(sizes[order], axis=1) < least).sum(axis=1), far.shape[1] - 1)
        bar[short] = np.maximum(bar[short], far[short, order[np.arange(len(short)), enough]])
    return bar + SLACK


def _chosen(graph: CentroidGraph, vectors: np.ndarray, width: int, ratio: float, sizes: np.ndarray | None = None, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(vector, list) of the lists within ratio of the nearest, and of the nearest that hold ``least`` rows by ``sizes``, or of all lists."""
    if sizes is None:
        return graph.near(vectors, ratio, width)
    far = graph.distances(vectors)
    return np.nonzero(far <= _reach(far, width, ratio, sizes, least)[:, None])


def shard_starts(sizes: np.ndarray, list_rows: int, shard_rows: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts of each list, its first part's place, and the shard of every part: neighbours in order, as many as hold shard_rows rows.

    Small tables get smaller shards, about ``least`` of them."""
    parts = -(-sizes // list_rows)
    first = np.cumsum(parts) - parts
    rows = np.repeat(sizes / np.maximum(parts, 1), parts)
    filled = min(shard_rows, max(1, -(-int(sizes.sum()) // least)))
    return parts, first, ((np.cumsum(rows) - rows) // filled).astype(np.int64)


def _best(query: np.ndarray, row: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k rows of each query; a row met in several lists counts once."""
    by = np.lexsort((row, -score, query))
    query, row, score = query[by], row[by], score[by]
    # Equal rows have equal scores, so they are neighbours.
    once = np.r_[True, (query[1:] != query[:-1]) | (row[1:] != row[:-1])] if len(query) else np.zeros(0, bool)
    query, row, score = query[once], row[once], score[once]
    best = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[best], row[best], score[best]


def _exact(q: np.ndarray, x: np.ndarray, query: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in one order for every pair, so that equal vectors tie."""
    step = max(1, PRODUCTS // max(1, x.shape[1]))
    return np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", q[query[low : low + step]].astype(np.float64), x[row[low : low + step]].astype(np.float64)) for low in range(0, len(query), step))])


def _packed(query: np.ndarray, row: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    """Rows sorted by query as FOUND."""
    first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, np.int64)
    ends = pa.array(np.r_[first, len(query)].astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(query[first], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(row, pa.int64())), pa.ListArray.from_arrays(ends, pa.array(score, pa.float64()))], names=["query_id", "vec_ids", "scores"])


class Shard:
    """Lists that are held together, and their best rows for the queries that pass by."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, list_: np.ndarray, k: int):
        by = np.lexsort((ids, list_))
        by = by[self._reachable(x, list_, by, k)]
        self.x, self.ids, list_, self.k = x[by], ids[by], list_[by], k
        self.edges = np.flatnonzero(np.r_[True, list_[1:] != list_[:-1], True])
        self.lists = list_[self.edges[:-1]]
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.x, self.x, dtype=np.float64))
        self.longest = np.maximum.reduceat(self.norms, self.edges[:-1])
        _, self.same, times = np.unique(self.ids, return_inverse=True, return_counts=True)
        #: Rows that are in more than one of the lists.
        self.again = times[self.same] > 1
        #: A product of two vectors of length 1 has at most this rounding error.
        self.error = (x.shape[1] + 8) * float(np.finfo(x.dtype).eps)

    @staticmethod
    def _reachable(x: np.ndarray, list_: np.ndarray, by: np.ndarray, k: int) -> np.ndarray:
        """Which rows, in the order ``by`` of lists and ids, aren't preceded by k + 1 equal ones in their list; these would always win the ties."""
        words = x.view(np.uint32).reshape(len(x), -1)
        # Overflow wraps around: a hash, which brings equal rows together.
        key = np.zeros(len(x), np.uint64)
        for j, odd in enumerate(np.random.default_rng(8).integers(0, 1 << 62, words.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)):
            key += words[:, j] * odd
        order = np.lexsort((key[by], list_[by]))
        key, list_ = key[by][order], list_[by][order]
        alike = np.flatnonzero((key[1:] == key[:-1]) & (list_[1:] == list_[:-1])) + 1
        new = np.ones(len(by), bool)
        for low in range(0, len(alike), step := max(1, PRODUCTS // x.shape[1])):
            part = alike[low : low + step]
            new[part] = (x[by[order[part]]] != x[by[order[part - 1]]]).any(axis=1)
        first = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
        keep = np.ones(len(by), bool)
        keep[order[np.arange(len(by)) - first > k]] = False
        return keep

    def best(self, q: np.ndarray, query_ids: np.ndarray, visits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best k rows of each query in the lists that it visits (a row of ``visits`` for each list)."""
        norms = np.sqrt(np.einsum("ij,ij->i", q, q, dtype=np.float64))
        bar = np.full(len(q), -np.inf)
        kept, new, pending = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), [], 0
        room = max(NEAR, 16 * int(np.diff(self.edges).max())) + 15 & ~7
        products, good = np.empty(room, q.dtype), np.zeros(room, bool)
        for at, (begin, end) in enumerate(zip(self.edges[:-1], self.edges[1:], strict=True)):
            some_all, x = np.flatnonzero(visits[at]), self.x[begin:end]
            for low in range(0, len(some_all), step := max(16, NEAR // len(x))):
                some = some_all[low : low + step]
                size = len(some) * len(x)
                score = np.matmul(q[some], x.T, out=products[:size].reshape(len(some), -1))
                doubt = self.error * norms[some] * self.longest[at]
                fresh = np.flatnonzero(np.isneginf(bar[some])) if len(x) > self.k else []
                if len(fresh):
                    # The query's own row may be among these.
                    nth = len(x) - self.k - 1
                    bar[some[fresh]] = np.partition(score[fresh], nth, axis=1)[:, nth] - doubt[fresh]
                # Rounded down, so that no row is lost by the bar's own rounding.
                edge = np.nextafter((bar[some] - doubt).astype(score.dtype), score.dtype.type(-np.inf))
                np.greater_equal(score, edge[:, None], out=good[:size].reshape(len(some), -1))
                good[size : size + 7] = False
                # Few are good: eight are looked at together first.
                eight = np.flatnonzero(good[: size + 7 & ~7].view(np.uint64))
                at_eight, in_eight = np.nonzero(good.reshape(-1, 8)[eight])
                flat = eight[at_eight] * 8 + in_eight
                new.append((some[flat // len(x)], begin + flat % len(x), products[flat].astype(np.float64)))
                pending += len(flat)
            if pending > 2 * self.k * len(q):
                kept, new, pending = self._left(q, query_ids, norms, bar, [kept, *new]), [], 0
        query, row, _ = self._left(q, query_ids, norms, bar, [kept, *new])
        by = np.argsort(query_ids, kind="stable")
        place = np.empty(len(q), np.int64)
        place[by] = np.arange(len(q))
        found = _best(place[query], self.ids[row], _exact(q, self.x, query, row), self.k)
        return query_ids[by][found[0]], found[1], found[2]

    def _left(self, q: np.ndarray, query_ids: np.ndarray, norms: np.ndarray, bar: np.ndarray, met: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) that may still be among the best k of what was met; raises the queries' bars to what the k-th best has for sure."""
        query, row, score = (np.concatenate([m[i] for m in met]) for i in range(3))
        keep = self.ids[row] != query_ids[query]
        twice = np.flatnonzero(keep & self.again[row])
        if len(twice):
            _, once = np.unique(query[twice] * len(self.ids) + self.same[row[twice]], return_index=True)
            keep[twice] = False
            keep[twice[once]] = True
        query, row, score = query[keep], row[keep], score[keep]
        doubt = self.error * norms[query] * self.norms[row]
        # One key: the query, then the score, as a share of the most it can be, falling (as ordered bits of a single).
        bits = ((score - doubt) / np.maximum(norms[query] * self.longest.max(), np.finfo(np.float64).tiny)).astype(np.float32).view(np.int32).astype(np.int64)
        by = np.argsort((query << 32) + ((1 << 31) - (bits ^ ((bits >> 31) & 0x7FFFFFFF))))
        query, row, score, doubt = query[by], row[by], score[by], doubt[by]
        first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, len(query)])
        rank = np.arange(len(query)) - np.repeat(first, size)
        top = np.flatnonzero((rank < self.k) & (np.repeat(size, size) >= self.k))
        if len(top):
            who = query[top[:: self.k]]
            bar[who] = np.maximum(bar[who], (score[top] - doubt[top]).reshape(-1, self.k).min(axis=1))
        keep = score + doubt >= bar[query]
        query, row, score = query[keep], row[keep], score[keep]
        # Near ties are told apart by exact scores, so that no query keeps many.
        size = np.bincount(query, minlength=len(q))
        crowd = np.flatnonzero((size > 2 * self.k)[query])
        if len(crowd):
            exact = _exact(q, self.x, query[crowd], row[crowd])
            by = np.lexsort((self.ids[row[crowd]], -exact, query[crowd]))
            who = query[crowd][by]
            keep = np.ones(len(query), bool)
            keep[crowd[by[np.arange(len(by)) - np.searchsorted(who, who) >= self.k]]] = False
            query, row, score = query[keep], row[keep], score[keep]
        return query, row, score


def search(
    vectors: DataFrame,
    every: int = 20,
    k: int = 20,
    vectors_per_list: int = 256,
    most_lists: int = 16384,
    sample: int = 20000,
    list_rows: int = 4096,
    replicas: int = 4,
    spread: float = 1.03,
    probes: float = 0.75,
    ratio: float = 1.35,
    shards: int = 24,
    shard_bytes: int = 256 << 20,
    floor: int = 4,
    sample_per_list: int = 4,
    recall: float | None = None,
    asked: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: about the k best rows of each query; queries are the rows whose id is divisible by ``every``.

    ``recall``: the share of the true neighbours to be found, for which as many lists are visited as that takes; None: ``ratio`` and ``probes`` tell."""
    spark = vectors.sparkSession
    single = isinstance(vectors.schema[vector_col].dataType.elementType, FloatType)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), (F.col(vector_col) if single else F.transform(vector_col, lambda x: x.cast("double"))).alias("v")).where(F.col("id").isNotNull())
    # Only rows whose id another row has are exchanged.
    many = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    repeats = not many.isEmpty()

    def taken(of_id: Column | None = None) -> DataFrame:
        """The rows that take part, of those whose ids are wanted: that is asked before their components are looked at."""
        left = rows if of_id is None else rows.where(of_id)
        left = left.where(usable("v") & F.exists("v", lambda x: x != 0))
        if not repeats:
            return left
        own = left.join(many, "id", "left_semi").groupBy("id").agg(F.min("v").alias("v"))
        return left.join(many, "id", "left_anti").unionByName(own)

    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    facts = taken().select(F.size("v").alias("d"), norm.alias("norm")).groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("largest"), F.min("norm").alias("least")).orderBy(F.desc("n"), "d").collect()  # a row a dimension
    if not facts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    few = [f["d"] for f in facts[1:] if f["n"] <= FEW and f["n"] * f["d"] <= COMPONENTS]
    met = None
    for f in facts:
        if f["d"] not in few:
            # Products of singles have to stay finite and normal.
            dtype = "<f4" if single and 1e-15 <= f["least"] and f["largest"] <= 1e15 else "<f8"
            own = _indexed(
                lambda of_id=None, d=f["d"]: taken(of_id).where(F.size("v") == d), dtype, f["n"], f["d"], f["largest"], every, k, vectors_per_list, most_lists, sample, list_rows, replicas, spread, probes, ratio, shards, shard_bytes, floor, sample_per_list, recall, asked
            )
            met = own if met is None else met.unionByName(own)
    if few:
        met = met.unionByName(_compared(taken().where(F.size("v").isin(few)), every, k))

    def merge(batches):
        """The best k rows of what the shards have for a query; its rows come one after the other."""
        held = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64))

        def ranked(query, row, score):
            query, row, score = _best(query, row, score, k)
            return pa.RecordBatch.from_arrays([pa.array(query), pa.array((np.arange(len(query)) - np.searchsorted(query, query) + 1).astype(np.int32)), pa.array(row), pa.array(score)], names=["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            if batch.num_rows:
                each = np.asarray(batch.column("vec_ids").value_lengths(), dtype=np.int64)
                new = np.repeat(np.asarray(batch.column("query_id"), dtype=np.int64), each), np.asarray(batch.column("vec_ids").flatten(), dtype=np.int64), np.asarray(batch.column("scores").flatten(), dtype=np.float64)
                new = tuple(np.concatenate(x) for x in zip(held, new, strict=True))
                last = np.searchsorted(new[0], new[0][-1]) if len(new[0]) else 0
                yield ranked(*(x[:last] for x in new))
                held = tuple(x[last:] for x in new)
        yield ranked(*held)

    return met.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")


def _compared(rows: DataFrame, every: int, k: int) -> DataFrame:
    """The best k rows of each query among all rows of its dimension: a dimension is a group of at most FEW rows."""

    def compare(table: pa.Table) -> pa.Table:
        ids, x = np.asarray(table.column("id"), dtype=np.int64), matrix(table.column("v").combine_chunks())
        asks = np.flatnonzero(ids % every == 0)
        query, row = np.nonzero(ids[asks][:, None] != ids[None, :])
        return pa.Table.from_batches([_packed(*_best(ids[asks][query], ids[row], _exact(x, x, asks[query], row), k))])

    return rows.groupBy(F.size("v")).applyInArrow(compare, FOUND)


def _indexed(
    taken: Callable[..., DataFrame], dtype: str, n: int, d: int, largest: float, every: int, k: int, vectors_per_list: int, most_lists: int, sample: int, list_rows: int, replicas: int, spread: float, probes: float, ratio: float, shards: int, shard_bytes: int, floor: int, sample_per_list: int, recall: float | None, asked: int
) -> DataFrame:
    """FOUND of what the lists of one dimension's index hold for each query."""
    rows = taken()
    spark = rows.sparkSession
    lists = int(min(most_lists, max(1, n // vectors_per_list)))
    # A bounded sample: at most sample_per_list * most_lists rows, however large the table. Hashes that are too large anyway aren't sorted.
    most = max(sample, sample_per_list * lists)
    hashed, queries = F.xxhash64("id"), F.col("id") % every == 0
    place = F.pmod(hashed, F.lit(1 << 20))
    drawn = taken(place <= int(min(1.0, 1.2 * most / n + 1e-3) * (1 << 20))).orderBy(place, hashed, "id").limit(most).select("v").toArrow().column("v")
    drawn = _lifted(_rows(drawn.combine_chunks(), dtype), largest)
    lists = min(lists, len(drawn))
    fitted = spark.sparkContext.broadcast(CentroidGraph(balanced_centroids(drawn, lists)))
    # The nearest list of all is nearer to some queries than to others by chance, so a measured ratio is one to the mean of the nearest hundredth.
    width, nearest = (max(1, int(np.ceil(probes * lists))), 1) if recall is None else (lists, max(1, lists // 100))
    # At most ``asked`` queries.
    trial = taken(queries).orderBy(hashed, "id").limit(asked).toArrow() if recall is not None else None
    trial_ids = np.asarray(trial.column("id"), dtype=np.int64) if trial else np.zeros(0, np.int64)
    trial = _rows(trial.column("v").combine_chunks(), dtype) if len(trial_ids) else np.zeros((0, d), dtype)
    trial_far = fitted.value.distances(_lifted(trial, largest, query=True))
    # Queries that lie on their centroid have a ratio too: they count as half as far away as most.
    nearer = max(1e-9, float(np.median(_unit(trial_far, nearest))) / 2) if len(trial) else 0.0

    def learn(batches):
        """How many rows have a list as their first, second... (key >= 0); the best k rows of each trial query (key < 0), with how much farther than its nearest lists the nearest of a row's first, first two... lists is."""
        graph, size = fitted.value, np.zeros(replicas * lists, np.int64)
        far = graph.distances(_lifted(trial, largest, query=True))
        far = np.sqrt(far) / _unit(far, nearest, nearer)[:, None].astype(np.float32)
        query, score, need, bar = np.zeros(0, np.int64), np.zeros(0), np.zeros((0, replicas)), np.full(len(trial), -np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = _rows(batch.column("v"), dtype), np.asarray(batch.column("id"), dtype=np.int64)
            at, list_ = graph.near(_lifted(x, largest), spread, replicas)
            size += np.bincount((np.arange(len(at)) - np.searchsorted(at, at)) * lists + list_, minlength=len(size))
            if len(trial):
                products = trial @ x.T
                _, own, mine = np.intersect1d(trial_ids, ids, return_indices=True)
                products[own, mine] = -np.inf
                fresh = np.flatnonzero(np.isneginf(bar)) if len(x) > k else []
                if len(fresh):
                    bar[fresh] = np.partition(products[fresh], len(x) - k, axis=1)[:, len(x) - k]
                who, row = np.divmod(np.flatnonzero(products >= bar[:, None].astype(products.dtype)), len(x))
                found = products[who, row].astype(np.float64)
                edges = np.searchsorted(at, np.arange(len(x) + 1))
                place = np.minimum(edges[row][:, None] + np.arange(replicas), edges[row + 1][:, None] - 1)
                least = np.minimum.accumulate(far[who[:, None], list_[place]], axis=1)
                real = found > -np.inf
                query, score, need = np.r_[query, who[real]], np.r_[score, found[real]], np.r_[need, least[real].astype(np.float64)]
                by = np.lexsort((-score, query))
                query, score, need = query[by], score[by], need[by]
                best = np.arange(len(query)) - np.searchsorted(query, query) < k
                query, score, need = query[best], score[best], need[best]
                full = np.flatnonzero(np.bincount(query, minlength=len(trial)) == k)
                bar[full] = score[np.searchsorted(query, full) + k - 1]
        filled = np.flatnonzero(size)
        ends = np.r_[np.zeros(len(filled), np.int64), np.arange(len(query) + 1) * replicas].astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[filled, -1 - query]), pa.array(np.r_[size[filled], np.zeros(len(query), np.int64)]), pa.array(np.r_[np.zeros(len(filled)), -score]), pa.ListArray.from_arrays(pa.array(ends), pa.array(need.ravel()))], names=["key", "size", "score", "need"])

    best = F.when(F.col("key") < 0, F.struct("score", "need"))
    learnt = rows.mapInArrow(learn, "key long, size long, score double, need array<double>").groupBy("key").agg(F.sum("size").alias("size"), F.slice(F.sort_array(F.collect_list(best)), 1, k).getField("need").alias("need"))
    # At most replicas * most_lists rows, and asked ones.
    sizes, needs = np.zeros(replicas * lists, dtype=np.int64), []
    for r in learnt.collect():
        if r["key"] >= 0:
            sizes[r["key"]] = r["size"]
        else:
            needs += r["need"]
    sizes = np.cumsum(sizes.reshape(replicas, lists), axis=0)
    if needs:
        # Of all numbers of replicas that find enough, the one whose lists have the fewest rows to compare.
        ratios = np.sort(np.array(needs), axis=0)[int(np.ceil(recall * len(needs))) - 1] * (1 + 1e-6)
        some = trial_far[:256]
        work = [((some <= _reach(some, width, r, size, 0, nearest, nearer)[:, None]) @ size.astype(np.float64)).sum() for r, size in zip(ratios, sizes, strict=True)]
        # A replica has to save a tenth of the comparing, since it is dealt too.
        replicas = int(np.argmin(np.array(work) * (1 + 0.1 * np.arange(replicas)))) + 1
        ratio = float(ratios[replicas - 1])
    sizes = sizes[replicas - 1]
    # A row is posted up to ``replicas`` times, and the query may be one of them.
    sizes_of, least = spark.sparkContext.broadcast(sizes), max(1, floor) * replicas * (k + 1)
    placed = spark.sparkContext.broadcast(shard_starts(sizes, list_rows, max(1, shard_bytes // (np.dtype(dtype).itemsize * d)), shards))

    def deal(batches):
        """A shard's vectors. Long lists in parts: the part comes from the id, the number of parts from the list's length."""
        parts, first, shard = placed.value
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch.column("v"), dtype)
                at, list_ = fitted.value.near(_lifted(x, largest), spread, replicas)
                id_ = np.asarray(batch.column("id"), dtype=np.int64)[at]
                part = (id_.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts[list_]
                yield pa.RecordBatch.from_arrays([pa.array(shard[first[list_] + part]), pa.array(np.zeros(len(at), np.int32)), pa.array(list_.astype(np.int32)), pa.array(id_), pa.array(np.zeros(len(at))), _bytes(x[at])], names=NAMES)

    def visit(batches):
        """The queries, once for each shard that holds a list they visit."""
        graph, (parts, _, shard) = fitted.value, placed.value
        list_ = np.repeat(np.arange(lists), parts)
        numbers, low = np.unique(shard, return_index=True)
        # Shards hold consecutive lists: from the first up to the last.
        edges = np.stack([list_[low], list_[np.r_[low[1:], len(shard)] - 1] + 1], axis=1).ravel()
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = _rows(batch.column("v"), dtype), np.asarray(batch.column("id"), dtype=np.int64)
            for begin in range(0, len(x), step := max(16, 4 * PRODUCTS // lists)):
                q = x[begin : begin + step]
                far = graph.distances(_lifted(q, largest, query=True))
                bar = _reach(far, width, ratio, sizes_of.value, least, nearest, nearer)
                visited = np.zeros((len(q), lists + 1), bool)
                visited[:, :-1] = (far <= bar[:, None]) & (parts > 0)
                at, which = np.nonzero(np.logical_or.reduceat(visited, edges, axis=1)[:, ::2])
                yield pa.RecordBatch.from_arrays([pa.array(numbers[which]), pa.array(np.ones(len(at), np.int32)), pa.array(np.zeros(len(at), np.int32)), pa.array(ids[begin + at]), pa.array(bar[at]), _bytes(q[at])], names=NAMES)

    def scan(batches):
        now, held, shard, centroids = None, [], None, None
        for batch in batches:
            at, asks = (np.asarray(batch.column(c), dtype=np.int64) for c in ("shard", "asks"))
            edges = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (asks[1:] != asks[:-1]), True]) if len(at) else []
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                if at[low] != now:
                    now, held, shard = at[low], [], None
                piece = batch.slice(low, high - low)
                x, ids = _rows(piece.column("v"), dtype), np.asarray(piece.column("id"), dtype=np.int64)
                if not asks[low]:
                    held.append((x.copy(), ids.copy(), np.asarray(piece.column("list"), dtype=np.int64)))
                elif held or shard:
                    if shard is None:
                        x_, ids_, list_ = (np.concatenate([h[i] for h in held]) for i in range(3))
                        held = []
                        shard = Shard(x_, ids_, list_, k)
                        centroids = CentroidGraph(fitted.value.centroids[shard.lists], small=lists)
                        del x_, ids_, list_
                    far = centroids.distances(_lifted(x, largest, query=True))
                    yield _packed(*shard.best(x, ids, (far <= np.asarray(piece.column("far"))[:, None]).T.copy()))

    dealt, asking = rows.mapInArrow(deal, KIND), taken(queries).mapInArrow(visit, KIND)
    return dealt.union(asking).repartition("shard").sortWithinPartitions("shard", "asks").mapInArrow(scan, FOUND)
