import random

import pytest
import xxhash

from loomledger.llm import components, simhash


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def brute_fingerprint(text):
    words = [w for w in text.encode().lower().split()]
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert found == brute_components(nodes, [e for e in edges if e[0] != e[1]])
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("dense", [2, 48])
def test_links_connect_all_within_two_bits(spark, dense):
    rng = random.Random(dense)
    prints = set()
    for _ in range(25):
        base = rng.getrandbits(64)
        prints.add(base)
        for _ in range(rng.randrange(12)):
            near = base
            for _ in range(rng.randrange(5)):
                near ^= 1 << rng.randrange(64)
            prints.add(near)
    prints = sorted(prints)
    signed = [(i, simhash._signed(p)) for i, p in enumerate(prints)]
    links = [(r.u, r.v) for r in simhash.fingerprint_links(spark.createDataFrame(signed, "rep long, fp long"), dense).collect()]
    assert all((prints[u] ^ prints[v]).bit_count() <= 2 for u, v in links)
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    assert brute_components(range(len(prints)), links) == brute_components(range(len(prints)), pairs)


def test_near_duplicates_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in rows] + [(9001, None), (9000, ""), (9002, " \t\n"), (9003, "One"), (9004, "one"), (9005, "A b"), (9006, "É b C d e"), (9007, "é b c d E")]
    docs = spark.createDataFrame([(i, t, 1, "y") for i, t in rows], "doc_id long, text string, fp int, component_id string")
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    prints = {i: brute_fingerprint(t or "") for i, t in rows}
    ids = sorted(prints)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (prints[a] ^ prints[b]).bit_count() <= 2]
    comps = brute_components(ids, linked)
    assert found == {i: (f"{prints[i]:016x}", comps[i]) for i in ids}


def test_repeated_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(7, "a b c d"), (7, "something else here now"), (9, "a b c d"), (8, "something else here now")], "doc_id long, text string")
    assert {r.component_id for r in simhash.near_duplicates(docs).collect()} == {7}
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
