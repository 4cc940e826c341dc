import math
import random
from collections import defaultdict

import numpy as np
import pytest

from loomledger.llm import ann, queries, topk

NAN, INF = float("nan"), float("inf")


def odd_rows(seed=0, n=300, d=8):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) for _ in range(d)]) for i in range(n)]
    rows += [(n + i, list(rows[3][1])) for i in range(40)]
    rows += [(900, None), (950, [1.0] * (d - 1) + [None]), (1000, [NAN] * d), (1050, [INF] + [0.0] * (d - 1)), (1100, [])]
    return rows + [rows[5], rows[5]]


def brute_top(rows, every=50, k=5):
    """Query, rank, row and score by plain integer products; of the vectors of one id the smallest counts."""
    good = {}
    for i, v in rows:
        if v and all(x is not None and math.isfinite(x) for x in v):
            good[i] = min(good.get(i, v), v)
    good = {i: [math.floor(256 * x) for x in v] for i, v in good.items()}
    expected = set()
    for i, v in good.items():
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good.items() if j != i and len(w) == len(v))
            expected |= {(i, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)}
    return expected


def test_exact_search_is_exact(spark):
    rows = odd_rows() + [(2000, [1.0, 2.0]), (2050, [0.5, -2.0]), (2000, [3.0, 2.0]), (50, [9.0] * 8), (2100, [0.0] * 8)]
    vectors = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<double>, score int")
    expected = brute_top(rows)
    for size, part, run in ((8192, 16384, 1024), (37, 3, 16)):
        found = topk.search(vectors, rows_per_block=size, queries_per_part=part, run=run).collect()
        assert {tuple(r)[:4] for r in found} == expected and len(found) == len(expected)


def test_registered_search_is_exact(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    found = queries.op4_exact_topk(spark, sf_dir).collect()
    assert {tuple(r)[:4] for r in found} == brute_top(rows) and all(0 < r.entries_read <= r.entries for r in found)


def test_large_components_are_exact_or_an_error(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(0, [1e6, 3.0, -1e6]), (1, [1e6 + 1 / 256, 2.0, -1e6]), (2, [1e6, 2.0, -1e6 - 1 / 256]), (3, [1e6, 5.0, -1e6])]
    found = topk.search(spark.createDataFrame(rows, schema)).collect()
    assert {tuple(r)[:4] for r in found} == brute_top(rows)
    for big in (1e20, 1.7e308):
        with pytest.raises(Exception, match="OverflowError"):
            topk.search(spark.createDataFrame([(0, [big]), (1, [big])], schema)).collect()


def test_bounds_stop_early_and_lose_nothing():
    rng = np.random.default_rng(1)
    shares, left = [], []
    for rows in (np.floor(rng.normal(0, 20, (700, 6))), np.floor(rng.pareto(1.5, (700, 6)) * 20)):
        lists = topk.SortedLists(rows, np.arange(len(rows)))
        for query in np.floor(rng.normal(0, 20, (30, 6))):
            scores = rows @ query
            for bar in (-np.inf, np.sort(scores)[-5]):
                alive, found, _, read = topk.aggregate(lists, query, -1, 5, bar, 0.0)
                assert set(np.flatnonzero(scores >= np.sort(scores)[-5])) <= set(alive) and read <= rows.size
                assert (found == scores[alive]).all()
            left.append(len(alive))
            # A run none of whose rows can qualify is left before its lists end.
            shares.append(topk.aggregate(lists, query, -1, 5, scores.max() + 1, 0.0)[3] / rows.size)
    assert np.mean(shares) < 0.75 and np.mean(left) < 12


def test_unread_entries_are_never_touched():
    """All entries that a query hasn't read are made nonsense; the query reads the same ones again and finds the same."""
    rng = np.random.default_rng(7)
    rows = np.floor(rng.pareto(1.5, (400, 7)) * 20) * rng.choice([-1, 1], (400, 7))

    class Watched(topk.SortedLists):
        def __init__(self, *args):
            super().__init__(*args)
            self.touched = np.zeros(self._values.shape, bool)

        def read(self, dims, large, begin, end):
            self.touched[int(large), dims, begin:end] = True
            return super().read(dims, large, begin, end)

    for query in np.floor(rng.normal(0, 9, (20, 7))):
        bar = np.sort(rows @ query)[-3]
        lists = Watched(rows, np.arange(len(rows)))
        first = topk.aggregate(lists, query, 5, 3, bar, 0.0)
        assert lists.touched.sum() == first[3] < rows.size
        lists._values[~lists.touched], lists._rows[~lists.touched] = np.nan, 10**6
        again = topk.aggregate(lists, query, 5, 3, bar, 0.0)
        assert (first[0] == again[0]).all() and (first[1] == again[1]).all() and first[3] == again[3]


def test_lists_are_read_once_for_many_queries():
    """What is read of the lists doesn't grow with the number of queries; every query finds what brute force finds."""
    rng = np.random.default_rng(11)

    class Counted(topk.SortedLists):
        entries = 0

        def read(self, dims, large, begin, end):
            self.entries += len(dims) * (end - begin)
            return super().read(dims, large, begin, end)

    for scale in (20, 1e5, 1e12):
        rows = np.floor(rng.normal(0, scale, (500, 6)))
        rows[40:60] = rows[3]
        ids = rng.permutation(1000)[:500]
        queries = np.vstack([np.floor(rng.normal(0, scale, (120, 6))), rows[:80], np.zeros((1, 6))])
        queries[5, 1:] = 0
        own = np.r_[np.full(120, -1), ids[:80], ids[7]]
        for few in (10, len(queries)):
            runs = [Counted(rows[at : at + 200], ids[at : at + 200]) for at in range(0, 500, 200)]
            found = topk.best_of_block(runs, queries[-few:], own[-few:], 5)
            assert sum(lists.entries for lists in runs) <= 2 * rows.size
            for query, itself, (best, read) in zip(queries[-few:], own[-few:], found, strict=True):
                scores = sorted((-sum(int(a) * int(b) for a, b in zip(query, row)), int(i)) for row, i in zip(rows, ids) if i != itself)
                assert best == scores[:5] and (0 < read <= rows.size) == query.any()


def test_posting_lists(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (12, 16))
    data = np.vstack([centres[i % 12] + rng.normal(0, 0.5, 16) for i in range(3000)] + [np.ones(16)] * 1500)
    data[7] = data[20]
    rows = [(i, [float(x) for x in v], "z") for i, v in enumerate(data)] + [(9000, None, "z"), (9020, [0.0] * 16, "z"), (9040, [NAN] * 16, "z"), (9060, [1.0], "z"), (40, [float(x) for x in data[40]], "z")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    found = defaultdict(list)
    for r in ann.search(vectors, vectors_per_list=100, list_rows=300).orderBy("query_id", "rank").collect():
        assert math.isclose(r.score, float(data[r.query_id] @ data[r.vec_id]), rel_tol=1e-12, abs_tol=1e-12)
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(found) == set(range(0, len(data), 20))
    hits = 0
    for q, got in found.items():
        assert [g[0] for g in got] == list(range(1, 21))
        assert [(-g[2], g[1]) for g in got] == sorted((-g[2], g[1]) for g in got) and q not in {g[1] for g in got}
        scores = data @ data[q]
        scores[q] = -np.inf
        bar = np.sort(scores)[-20]
        hits += sum(g[2] >= bar - 1e-9 for g in got)
    assert hits / (20 * len(found)) >= 0.9


def test_small_and_empty_tables(spark):
    schema = "vec_id long, embedding array<double>"
    for search in (ann.search, topk.search):
        assert search(spark.createDataFrame([], schema)).count() == 0
        assert search(spark.createDataFrame([(0, [1.0])], schema)).count() == 0
        rows = search(spark.createDataFrame([(0, [1.0, 0.0]), (3, [2.0, 0.0]), (2, [2.0, 0.0])], schema)).orderBy("rank").collect()
        assert [(r.query_id, r.rank, r.vec_id) for r in rows] == [(0, 1, 2), (0, 2, 3)]


def test_shards_grow_with_the_posted_rows():
    rng = np.random.default_rng(3)
    for n in (0, 5, 400, 4000):
        sizes = rng.integers(0, 3000, n)
        sizes[: n // 50] *= 40
        parts, first, shard = ann.shard_starts(sizes, 4096, 20_000, 24)
        rows = np.bincount(shard, weights=np.repeat(sizes / np.maximum(parts, 1), parts)) if n else np.zeros(0)
        assert len(shard) == parts.sum() and all(shard[first[i]] <= shard[first[i] + parts[i] - 1] for i in range(n) if parts[i])
        assert (rows <= 20_000 + 4096).all() and len(rows) >= sizes.sum() / 24_096


def test_small_shards_find_the_same(spark):
    vectors = spark.createDataFrame([(i, v) for i, v in odd_rows() if v and len(v) == 8 and i < 900], "vec_id long, embedding array<double>")
    whole, cut = ({tuple(r) for r in ann.search(vectors, vectors_per_list=20, list_rows=16, probes=1.0, ratio=99.0, shard_bytes=size).collect()} for size in (64 << 20, 640))
    assert whole == cut and len(whole) == 17 * 20


def test_lonely_lists_still_give_k_rows(spark):
    # Every query lies on a centroid that holds it alone; all vectors have one norm.
    rng = np.random.default_rng(4)
    data = rng.normal(0, 1, (400, 12))
    data /= np.sqrt((data**2).sum(axis=1))[:, None]
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for r in ann.search(vectors, vectors_per_list=1, spread=1.0).collect():
        found[r.query_id].append(r.vec_id)
    assert set(found) == set(range(0, 400, 20)) and all(len(set(v)) == len(v) == 20 for v in found.values())


def test_floor_takes_lists_beyond_the_graph():
    graph = ann.CentroidGraph(np.array([[0.0, 0.0], [1.0, 0.0], [2.0, 0.0], [30.0, 0.0]]))
    at, list_ = ann._chosen(graph, np.zeros((1, 2)), 2, 1.3, np.array([1, 1, 1, 1000]), 80)
    assert sorted(list_) == [0, 1, 2, 3] and set(at) == {0}
    at, list_ = ann._chosen(graph, np.zeros((1, 2)), 2, 1.3, np.array([100, 1, 1, 1000]), 80)
    assert list(list_) == [0]


def test_every_dimension_is_searched(spark):
    rng = np.random.default_rng(6)
    sizes = {4: 1500, 8: 1300, 2: 60, 3: 1}
    rows = [(d, [float(x) for x in np.round(rng.normal(0, 1, d), 1)]) for d, n in sizes.items() for _ in range(n)]
    rng.shuffle(order := np.arange(len(rows)))
    rows = [(i, rows[j][1]) for i, j in enumerate(order)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for r in ann.search(vectors, k=5, probes=1.0, ratio=99.0).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    for q, v in rows:
        if q % 20 == 0 and any(len(w) == len(v) for i, w in rows if i != q):
            scores = sorted((-float(np.einsum("i,i->", np.array(v), np.array(w))), i) for i, w in rows if len(w) == len(v) and i != q)
            assert [i for i, _ in found.pop(q)] == [i for _, i in scores[:5]], (q, len(v))
    assert not found


def test_recall_of_the_registered_query(spark):
    import pyarrow.parquet as pq

    from loomledger.llm import queries

    folder = "/root/testdata/sf0.1"
    table = pq.read_table(f"{folder}/embeddings.parquet")
    ids, x = np.array(table.column("vec_id")), np.array(table.column("embedding").to_pylist(), dtype=np.float64)
    found = defaultdict(list)
    for r in queries.queries()["op7_posting_lists"](spark, folder).collect():
        found[r.query_id].append(r.score)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        scores = np.sort(np.delete(x @ x[q], q))[-20:]
        total += len(scores)
        hits += sum(s >= scores[0] - 1e-9 for s in found[ids[q]])
    assert hits / total >= 0.95


def brute_near(data, ids, k, every=20):
    """Query -> ids of its k best rows by exact inner products, ties to the smaller id."""
    x = np.asarray(data, dtype=np.float64)
    return {int(i): [int(r) for _, r in sorted((-float(np.einsum("i,i->", q, v)), j) for v, j in zip(x, ids) if j != i)[:k]] for q, i in zip(x, ids) if i % every == 0}


def test_a_measured_ratio_finds_the_share_it_is_asked_for(spark):
    rng = np.random.default_rng(12)
    data = rng.normal(0, 1, (3000, 24)).astype(np.float32)
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id long, embedding array<float>")
    expected = brute_near(data, range(3000), 10)
    sizes = []
    for share in (0.9, 1.0):
        found = defaultdict(list)
        for r in ann.search(vectors, k=10, vectors_per_list=30, recall=share, floor=1).orderBy("query_id", "rank").collect():
            found[r.query_id].append(r.vec_id)
            assert r.score == float(np.einsum("i,i->", data[r.query_id].astype(float), data[r.vec_id].astype(float)))
        sizes.append(np.mean([len(set(found[q]) & set(best)) / 10 for q, best in expected.items()]))
        assert set(found) == set(expected) and all(len(v) == 10 for v in found.values())
    # All 150 queries were asked, so the share is no estimate.
    assert 0.9 <= sizes[0] < 0.97 and sizes[1] == 1.0


def test_near_ties_copies_and_odd_lengths_are_told_apart(spark):
    rng = np.random.default_rng(13)
    base = rng.normal(0, 1, 16).astype(np.float32)
    near = np.repeat(base[None, :], 300, axis=0)
    # One last bit of one component: single products can't tell these rows apart.
    for i in range(300):
        near[i, i % 16] = np.nextafter(near[i, i % 16], np.float32(9), dtype=np.float32)
    data = np.vstack([near, np.repeat(base[None, :], 700, axis=0), rng.normal(0, 1, (1000, 16)).astype(np.float32)])
    ids = rng.permutation(len(data))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 97)
    try:
        for scale in (1.0, 1e-30, 1e30):
            x = (data * np.float32(scale)).astype(np.float32)
            vectors = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)] + [(0, [9e37] * 16)] * 2, "vec_id long, embedding array<float>")
            rows = dict(zip(ids.tolist(), x.astype(np.float64)))
            rows[0] = min(rows[0].tolist(), [float(np.float32(9e37))] * 16)
            expected = brute_near(list(rows.values()), list(rows), 20)
            found = defaultdict(list)
            for r in ann.search(vectors, vectors_per_list=100, probes=1.0, floor=1000).orderBy("query_id", "rank").collect():
                found[r.query_id].append(r.vec_id)
            assert found == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_copies_that_always_lose_ties_are_not_held():
    rng = np.random.default_rng(14)
    x = np.vstack([np.ones((500, 8)), rng.normal(0, 1, (50, 8))]).astype(np.float32)
    ids, list_ = rng.permutation(len(x)), np.zeros(len(x), np.int64)
    shard = ann.Shard(x, ids, list_, 5)
    assert len(shard.ids) == 56 and set(np.sort(ids[:500])[:6]) <= set(shard.ids)


def test_a_vector_meets_few_of_many_centroids():
    rng = np.random.default_rng(15)
    centroids, x = rng.normal(0, 1, (6000, 16)), rng.normal(0, 1, (500, 16))
    graph = ann.CentroidGraph(centroids)
    assert len(graph.hubs) + graph.doors * max(len(a) for a in graph.around) < len(centroids) / 3
    at, node = graph.near(x, 1.03, 4)
    far = ((x[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    first = node[np.searchsorted(at, np.arange(500))]
    assert (first == far.argmin(axis=1)).mean() > 0.8 and (np.bincount(at, minlength=500) > 0).all()
    assert (np.sqrt(far[at, node]) <= 1.031 * np.sqrt(far[at, first[at]])).all()
