import bisect
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomledger.llm import bpe, packing, queries

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["", None, " ", "  a  b", "x\n\n\ny <|endoftext|> z", "hello <|endoftext|> world", "<|endoftext|><|endoftext|>a<|endoftext|", "a  b", "it's 's", "\x00 \x00a b", "naïve Ünï 12 345", "\t \n", "a b " * 700, "word" * 3000, "日本語 テスト"]


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(i, t, "x", 7) for i, t in enumerate(ODD)] + [(0, "again", "x", 7), (3, "  a  b", "x", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, piece string, ids int")


def reference_ids(text):
    return Tokenizer.from_file(JSON).encode(text or "", add_special_tokens=False).ids


def test_pieces_have_the_tokenizers_ids_and_fill_sequences(odd_docs):
    rows = packing.pack_documents(odd_docs, JSON, capacity=64, keep_ids=True).collect()
    texts = defaultdict(list)
    for r in odd_docs.collect():
        texts[r.doc_id].append(reference_ids(r.text) + [2])
    places = defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert any(ids[r.start : r.start + r.length] == r.ids for ids in texts[r.doc_id])
        assert r.piece == 0 or r.length == 64
        places[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(len(x) for v in texts.values() for x in v)
    for place in places.values():
        at = 0
        for offset, length in sorted(place):
            assert offset == at
            at += length
        assert at <= 64
    joined = packing.sequences(packing.pack_documents(odd_docs, JSON, capacity=64, keep_ids=True)).collect()
    assert sum(len(r.ids) for r in joined) == sum(r.length for r in rows)


def best_fit_decreasing(lengths):
    """Sequences that plain best fit uses, longest piece first."""
    free = []
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(free, n)
        room = free.pop(at) if at < len(free) else 1024
        bisect.insort(free, room - n)
    return len(free)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once_and_near_the_bound(seed):
    rng = random.Random(seed)
    lengths = [min(1024, max(1, int(rng.choice([rng.gauss(500, 200), rng.uniform(1, 1024), rng.expovariate(1 / 80)])))) for _ in range(4000)]
    histogram = Counter(lengths)
    for large in (1 / 3, 0.2, 0.5):
        runs, n = packing.plan_sequences(dict(histogram), 1024, 48, large)
        ranks, fill = defaultdict(list), defaultdict(list)
        for length, first_rank, count, first, offset in runs:
            ranks[length] += range(first_rank, first_rank + count)
            for i in range(count):
                fill[first + i].append((offset, length))
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in histogram.items()}
        assert len(fill) <= n
        for place in fill.values():
            at = 0
            for offset, length in sorted(place):
                assert offset == at
                at += length
            assert at <= 1024
    # The registered plan: as few sequences as plain best fit, and most large pieces share one by a configuration.
    runs, n = packing.plan_sequences(dict(histogram))
    assert n <= best_fit_decreasing(lengths) + 1
    large = {(first + i, offset) for length, _, count, first, offset in runs if 342 <= length < 1024 for i in range(count)}
    assert sum(offset > 0 for _, offset in large) > 0.3 * len(large)


def test_registered_packing(spark, sf_dir):
    found = queries.op1_best_fit_packing(spark, sf_dir).collect()
    pieces = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in found}
    tokenizer, expected = Tokenizer.from_file(JSON), {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for piece, (low, high) in enumerate(zip(cuts[:-1], cuts[1:])):
            expected[r.doc_id, piece] = (low, high - low, zlib.crc32(np.array(ids[low:high], "<u4").tobytes()))
    assert pieces == expected and len(found) == len(pieces)
    places = defaultdict(list)
    for r in found:
        places[r.sequence_id].append((r.offset, r.length))
    for place in places.values():
        assert sorted(place) == [(sum(n for _, n in sorted(place)[:i]), n) for i, (_, n) in enumerate(sorted(place))] and sum(n for _, n in place) <= 1024
    assert len(places) <= best_fit_decreasing([n for _, n, _ in pieces.values()])


def test_registered_encoding(spark, sf_dir):
    encoding, expected = bpe.load(RANKS, public_tokenizers.PATTERN), set()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = encoding.encode_ordinary(r.text or "")
        expected.add((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert {tuple(r) for r in queries.op3_byte_bpe(spark, sf_dir).collect()} == expected


def test_most_text_is_encoded_between_seams(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if r.text]
    cut = [bpe.pieces(public_tokenizers.PATTERN, t, 2048, 128) for t in texts]
    assert ["".join(c) for c in cut] == texts
    assert sum(len(t) for t, c in zip(texts, cut) if len(c) > 1) > 0.5 * sum(map(len, texts))


def test_packing_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(empty, JSON).count() == 0
    assert bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_chunked_encoding_equals_the_whole(spark, odd_docs):
    rng = random.Random(5)
    long = ["".join(rng.choice(["the", " and", "  ", "\n", "\n\n\n", " x1", "é", "'s", "!?", " \t"]) for _ in range(600)) for _ in range(25)]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(long)], "doc_id long, text string"))
    encoding = bpe.load(RANKS, public_tokenizers.PATTERN)
    expected = Counter()
    for r in docs.collect():
        ids = encoding.encode_ordinary(r.text or "")
        expected[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    for chunk, overlap, deal in ((120, 40, 65536), (120, 40, 120), (64, 8, 300), (64, 8, 65536), (100_000, 100, 1000)):
        found = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, chunk, overlap, "digests", deal).collect()
        assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == expected


def test_round_trip(odd_docs):
    ids = bpe.encode(odd_docs, RANKS, public_tokenizers.PATTERN, 50, 10, deal=1000)
    back = Counter((r.doc_id, bytes(r.bytes)) for r in bpe.decode(ids, RANKS, public_tokenizers.PATTERN).collect())
    assert back == Counter((r.doc_id, (r.text or "").encode()) for r in odd_docs.collect())
