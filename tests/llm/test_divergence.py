"""Source divergence against plain counting; transducers against sorted lists."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from loomledger.llm import divergence, queries, transducer

COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def expected(docs, least=3, top=200):
    terms = []
    for text, lang, source in docs:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms.append((lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)))
    in_docs, counts, of_lang, sources = Counter(), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, words in terms:
        sources[lang].add(source)
        in_docs.update((lang, w) for w in set(words))
    for lang, source, words in terms:
        kept = [w for w in words if in_docs[lang, w] >= least]
        counts[lang, source].update(kept)
        of_lang[lang].update(kept)
    out = []
    for lang, named in sources.items():
        kept = sorted(of_lang[lang])

        def share(counter, kept=kept):
            total = sum(counter.values()) + len(kept)
            return {w: 1 + 10**9 * (counter[w] + 1) // total for w in kept}

        p, q = {s: share(counts[lang, s]) for s in named}, share(of_lang[lang])
        for s in named:
            pairs = sorted((-sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o.encode()) for o in named if o != s)
            out += [(lang, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(pairs)]
            best = sorted((-((p[s][w] - q[w]) ** 2 // q[w]), w.encode()) for w in kept if counts[lang, s][w] and p[s][w] > q[w])
            out += [(lang, s, "term", w.decode(), -v, i + 1) for i, (v, w) in enumerate(best[:top])]
    return sorted(out)


def answers(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def documents():
    rows = [(" ".join(f"w{chr(97 + (i * j) % 23)}" + "éa"[j % 2] * (j % 4) for j in range(1 + i % 30)), ("en", "de", None)[i % 3], f"s{i % 4}") for i in range(150)]
    rows += [("", "xx", "a"), (None, "xx", "b"), ("only twice", "xx", "c"), ("only twice", "xx", None), ("word", "alone", "one"), ("word WORD", "alone", "one"), ("Word 1word", "alone", "one")]
    rows += [("x" * 50_000 + " big", "en", "s9")] * 3 + [("big " * 50_000, "en", "s9")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), "text string, lang string, source string").repartition(5)


def test_rows_equal_plain_counting(docs):
    assert answers(divergence.audit(docs)) == expected(documents())


def test_several_shards_and_rounds(docs):
    assert answers(divergence.audit(docs, resident=400, shard=7)) == expected(documents())
    assert answers(divergence.audit(docs, least=1, top=3, shard=10)) == expected(documents(), 1, 3)


def test_empty_and_clashing(spark):
    schema = "text string, lang string, source string, term long, ordinal string, `rank` int"
    assert divergence.audit(spark.createDataFrame([], schema)).count() == 0
    rows = [("a b", "l", "s", 1, "x", 2)] * 3 + [("a c", "l", "t", 1, "x", 2)] * 3
    assert answers(divergence.audit(spark.createDataFrame(rows, schema))) == expected([r[:3] for r in rows])


@pytest.mark.parametrize("words", [[], [b""], [b"", b"a"], [b"a"], sorted({f"{a}{b}ing".encode() for a in "abc" for b in ("", "s", "st")}), sorted({str(i * i).encode() for i in range(3000)}), [b"x" * n for n in range(1, 200)]])
def test_transducer_numbers_sorted_strings(words):
    built = transducer.build(words)
    assert built.size == len(words)
    asked = words + [w + b"!" for w in words] + [w[:-1] for w in words if w] + [b"zz", b""]
    data = np.frombuffer(b"".join(asked), np.uint8)
    ends = np.cumsum([len(w) for w in asked])
    starts = ends - [len(w) for w in asked]
    place = {w: i for i, w in enumerate(words)}
    for machine in (built, transducer.Transducer.unpacked(built.packed())):
        assert machine.ordinals(data, starts, ends).tolist() == [place.get(w, -1) for w in asked]


def test_transducer_is_minimal():
    words = sorted(f"{a}{b}{c}".encode() for a in "abcd" for b in "efgh" for c in "ijkl")
    assert len(transducer.build(words).finals) == 4
    with pytest.raises(ValueError):
        transducer.build([b"b", b"a"])


def test_shares_divide_exactly():
    n = np.array([0, 1, 10**12, 2**52, 999])
    total = np.array([1, 3, 10**12 + 7, 2**52 + 12345, 10**9])
    assert divergence._shares(n, total).tolist() == [1 + 10**9 * (a + 1) // b for a, b in zip(n.tolist(), total.tolist(), strict=True)]


def test_query_equals_sql(spark, sf_dir):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    sql = duck.sql(f"SELECT {', '.join(COLUMNS)} FROM ({divergence.oracle_sql()})").fetchall()
    assert answers(queries.queries()["op13_source_divergence"](spark, sf_dir)) == sorted(sql)
