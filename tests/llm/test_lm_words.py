"""Language-model scores."""

import math
from collections import Counter, defaultdict

import duckdb
import pytest

from loomledger.llm import lmscore, queries

SCHEMA = "doc_id long, text string, part int, score double, asks int"


def brute_scores(docs, target, mass):
    """Scores by plain counting; docs: (doc_id, text) rows."""
    ends = lambda text: ["", *(text or "").lower().split(), ""]
    texts = [(i, ends(t)) for i, t in docs]
    total = sum(len(w) - 1 for _, w in texts)
    pairs, heads, tails = {0: Counter(), 1: Counter()}, {0: Counter(), 1: Counter()}, Counter()
    for i, words in texts:
        for side in (0, 1) if i in target else (0,):
            pairs[side].update(zip(words, words[1:]))
            heads[side].update(words[:-1])
        tails.update(words[1:])
    out = Counter()
    for i, words in texts:
        loss = [-sum(math.log((pairs[s][a, b] + mass * tails[b] / total) / (heads[s][a] + mass)) for a, b in zip(words, words[1:])) / (len(words) - 1) for s in (1, 0)]
        out[i, len(words) - 1, *(round(x, 6) for x in (*loss, loss[0] - loss[1]))] += 1
    return out


def rounded(rows):
    return Counter((r.doc_id, r.n_tokens, *(round(x, 6) for x in (r.target_loss, r.background_loss, r.score))) for r in rows)


def test_every_word_against_sql(spark, sf_dir):
    rows = queries.op2_lm_score(spark, sf_dir).collect()
    duck = duckdb.connect()
    for t in ("documents", "labels"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    expected = {r[0]: r[1:] for r in duck.sql(queries.oracle_sql()["op2_lm_score"]).fetchall()}
    assert len(rows) == len(expected)
    for r in rows:
        assert r.n_tokens == expected[r.doc_id][0]
        assert all(abs(x - y) <= 2e-6 for x, y in zip(r[2:], expected[r.doc_id][1:], strict=True))


@pytest.mark.parametrize("part, bucket", [(8 << 20, 16 << 20), (200, 90), (40, 5000)])
def test_odd_rows_against_counting(spark, part, bucket):
    rows = [(i, f"a b{i % 3} c a") for i in range(40)] + [(5, "a b2 c a"), (5, "a b2 c a"), (7, "other words"), (41, None), (42, ""), (43, " \t "), (44, "x " * 3000), (None, "a b1"), (None, None), (45, "Été ÉTÉ a b")]
    docs = spark.createDataFrame([(i, t, 3, 0.5, 1) for i, t in rows], SCHEMA)
    goal = {5, 7, 41, 44, 45, 9000}
    target = spark.createDataFrame([(i,) for i in [*goal, 5, None]], "doc_id long")
    found = lmscore.score(docs, target, 4.0, part, bucket).collect()
    lower = [(i, t and "".join(c.lower() if c.isascii() else c for c in t)) for i, t in rows]
    # Words are split at ASCII white space alone.
    expected = brute_scores([(i, t and t.replace(" ", "~")) for i, t in lower], goal, 4.0)
    swap = {"É": "@"}
    expected = brute_scores([(i, t and "".join(swap.get(c, c) for c in t.replace(" ", "~"))) for i, t in lower], goal, 4.0)
    assert rounded(found) == expected


def test_rare_words_tell_texts_apart(spark):
    common = [(i, " ".join(f"w{j}" for j in range(60)), 0, 0.0, 0) for i in range(30)]
    docs = spark.createDataFrame([*common, (100, "w1 heron w2", 0, 0.0, 0), (101, "w1 viper w2", 0, 0.0, 0)], SCHEMA)
    scores = defaultdict(float, {r.doc_id: r.score for r in lmscore.score(docs, spark.createDataFrame([(100,)], "doc_id long")).collect()})
    assert scores[100] < scores[101]


def test_empty_sides(spark):
    docs = spark.createDataFrame([(1, "a b", 0, 0.0, 0), (2, None, 0, 0.0, 0)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long")
    assert lmscore.score(docs.where("false"), none).count() == 0
    assert rounded(lmscore.score(docs, none).collect()) == brute_scores([(1, "a b"), (2, None)], set(), 4.0)
