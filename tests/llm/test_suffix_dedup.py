import hashlib
import random
from collections import Counter, defaultdict

import pytest

from loomledger.llm import suffix_dedup


def brute(rows, length):
    least = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            least[w] = min(least.get(w, i), i)
    out = Counter()
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if least[t[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out[i, len(t), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()] += 1
    return out


def result(docs, length=50, **options):
    found = suffix_dedup.remove_repeats(docs, length, **options)
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect())


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force_on_random_texts(spark, seed):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("ab" if k % 3 else "abcdefgé ") for _ in range(rng.randrange(45, 140))) for k in range(12)]
    rows = []
    for i in range(140):
        parts = [rng.choice([rng.choice(passages), "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(60))), "x" * rng.randrange(90)]) for _ in range(rng.randrange(5))]
        rows.append((rng.randrange(10_000), "".join(parts)))
    rows += [(1, None), (2, ""), (3, "short"), (20_000, rows[0][1]), (20_001, rows[0][1]), (-5, rows[7][1])]
    rows = list({i: (i, t) for i, t in rows}.values())
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, key int, positions string").repartition(3)
    assert result(docs) == brute(rows, 50)


def test_against_brute_force_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert result(docs, keep_bytes=False) == brute([tuple(r) for r in docs.collect()], 50)


def test_near_edits_and_repeated_rows(spark):
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefghij klm") for _ in range(900))
    rows = [(100, base), (100, base)]
    for i in range(30):
        p = rng.randrange(900)
        rows.append((101 + i, base[:p] + "#" + base[p + rng.randrange(3) :]))
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows, 50)


def test_no_ids_and_empty(spark):
    rows = [(None, "a" * 80), (None, "a" * 80), (4, "a" * 80)]
    assert {r.n_removed for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    # A nameless row beside id 0 with the same text, of which id 0 loses a part.
    rng = random.Random(4)
    part, own = ("".join(rng.choice("abcdefgh") for _ in range(90)) for _ in range(2))
    rows = [(None, part + own), (0, part + own), (-3, own + part[:70])]
    found = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {None: 0, 0: 160, -3: 0}


def test_longer_strings_and_a_long_text(spark):
    rng = random.Random(6)
    shared = "".join(rng.choice("abcdef ") for _ in range(700))
    rows = [(i, "".join(rng.choice("uvwxyz ") for _ in range(300)) + shared[rng.randrange(300) :]) for i in range(20)]
    rows.append((50, "".join(rng.choice("ghijkl ") for _ in range(200_000)) + shared))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for length in (50, 200):
        assert result(docs, length) == brute(rows, length)


def test_a_hot_passage_is_sent_once_a_batch(spark):
    passage = "the same passage of more than fifty bytes in very many documents of one batch"
    rows = [(i, f"{i:06d} {passage}") for i in range(400)]
    texts = spark.createDataFrame([(i, 7, t, list(range(len(t)))) for i, t in rows], "doc long, key long, text string, positions array<int>").coalesce(1)
    sent = [suffix_dedup._stretches_of(r.blob) for r in suffix_dedup.stretches(texts, 50, 8).collect()]
    assert sum((s[0][0] == 0).sum() for s in sent) > 0 and sum(len(s[1][0]) for s in sent) >= 399
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows, 50)


def test_cover():
    differences = defaultdict(int)
    for a in suffix_dedup.COVER:
        for b in suffix_dedup.COVER:
            differences[(a - b) % suffix_dedup.COVER_MODULUS] += 1
    assert set(differences) == set(range(suffix_dedup.COVER_MODULUS))


def test_parts_of_a_bucket_find_what_the_whole_finds():
    import numpy as np

    from loomledger.llm import suffix_dedup as sd

    random = np.random.default_rng(3)
    shared = random.integers(97, 123, 400, dtype=np.uint8)
    rows = [np.concatenate([random.integers(97, 123, 300, dtype=np.uint8), shared[n * 20 : n * 20 + 200]]) for n in range(8)]
    raw, offsets = np.concatenate(rows), np.cumsum([0, *map(len, rows)])
    found = sd.anchors(raw, offsets, 50)
    doc, first = found["row"], found["first"]
    size, lead, start = found["last"] - first + 50, found["at"] - first, first - offsets[doc]

    def covered(doc, key, *rest):
        at, low, high = sd.repeated_starts(doc, *rest, 50)
        return {(d, p) for d, a, b in zip(doc[at].tolist(), low.tolist(), high.tolist(), strict=True) for p in range(a, b + 50)}

    stretches = (doc, np.zeros_like(doc), start, lead, size, sd._gather(raw, first, size))
    whole = covered(*stretches)
    parts = [p for p in sd._dealt(*stretches, 7) if len(p[0])]
    assert len(whole) > 500 and len(parts) > 3
    assert set().union(*(covered(*p) for p in parts)) == whole
