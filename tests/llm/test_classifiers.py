import zlib

import numpy as np
import pyarrow as pa
import pytest

from loomledger.llm import quality, toxicity

BIG = "/root/testdata/sf0.01"
ODD = [(None, "no id"), (70_001, None), (70_002, ""), (70_003, " \t\n"), (70_004, "x" * 200_000), (70_005, "a b c " * 30_000), (5, "again")]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.read.parquet(f"{BIG}/documents.parquet")
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], frame.schema)
    return frame.unionByName(odd)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{BIG}/labels.parquet")


def accuracy(rows, labels, column):
    truth = {r["doc_id"]: r[column] for r in labels.collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth and r.doc_id < 70_000]
    return np.mean([p == t for p, t in held]), held


@pytest.mark.parametrize("run,column,fold,out", [(quality.classify, "quality", 4, 2), (toxicity.score, "toxic", 5, 0)])
def test_held_out_accuracy_and_fold(docs, labels, run, column, fold, out):
    rows = run(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % fold == out)
    share, held = accuracy(rows, labels, column)
    assert len(held) > 40 and share >= 0.9


def test_toxic_documents_are_found(spark):
    """Some labelled documents hold no insult at all: of sf0.1's 97 held-out ones seven. A constant answer finds none."""
    found = {}
    for size in ("sf0.01", "sf0.1"):
        folder = f"/root/testdata/{size}"
        truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
        rows = toxicity.score(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).where("held_out").collect()
        held = [(r.predicted, truth[r.doc_id]) for r in rows if truth.get(r.doc_id) is not None]
        found[size] = tuple(held.count(x) for x in ((1, 1), (0, 1), (1, 0)))
    hit, missed, wrong = found["sf0.1"]
    assert hit / (hit + missed) >= 0.92 and hit / (hit + wrong) >= 0.95
    hit, missed, wrong = found["sf0.01"]
    assert hit >= 4 and wrong <= 1


def test_copies_of_a_text_are_one_family():
    words = [f"w{i}" for i in range(60)]
    documents = [(1, words), (1, words[:-2]), (0, words), (1, words[:30] + [f"v{i}" for i in range(30)]), (1, []), (1, []), (1, ["a"]), (1, ["a"]), (1, ["b"])]
    assert toxicity._families(documents) == [0, 2, 3, 4, 5, 6, 8]


@pytest.mark.parametrize("run,column", [(quality.classify, "quality"), (toxicity.score, "toxic")])
def test_a_labelled_id_that_repeats_is_one_row(spark, docs, labels, run, column):
    some = docs.where("doc_id < 150")
    many = some.unionByName(some.where("doc_id % 3 = 1"))
    few = labels.where("doc_id < 150")
    assert {(r.doc_id, r.score) for r in run(some, few).collect()} == {(r.doc_id, r.score) for r in run(many, few).collect()}


@pytest.mark.parametrize("run,column", [(quality.classify, "quality"), (toxicity.score, "toxic")])
def test_labels_and_metadata_are_no_inputs(spark, docs, labels, run, column):
    some = docs.where("doc_id < 200 or doc_id >= 70000")
    few = labels.where("doc_id < 400")
    plain = {(r.doc_id, r.score) for r in run(docs, few).where("doc_id < 200").collect()}
    blank = docs.selectExpr("doc_id", "text", "'zz' lang", "cast(doc_id as string) source", "1L n_chars")
    assert plain == {(r.doc_id, r.score) for r in run(blank, few).where("doc_id < 200").collect()}
    none = run(some, labels.where("false")).collect()
    assert len(none) == some.count()
    same = run(some, labels.where(f"{column} = 1")).collect()
    assert len(same) == len(none)
    assert run(docs.where("false"), labels).count() == 0


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    machine = quality.FactorisationMachine(0.1, rng.normal(0, 1, 20), rng.normal(0, 1, (20, 3)))
    feature, value = np.array([1, 4, 7, 9]), np.array([0.5, 1.0, -1.0, 2.0])
    pairs = sum(machine.factors[feature[i]] @ machine.factors[feature[j]] * value[i] * value[j] for i in range(4) for j in range(i))
    z = 0.1 + machine.weights[feature] @ value + pairs
    assert np.isclose(machine.scores(1, np.zeros(4, int), feature, value)[0], 1 / (1 + np.exp(-z)))


def test_subsequence_kernel_against_enumeration():
    def explicit(word):
        s = [toxicity._START, *(ord(c) - 96 for c in word), toxicity._END]
        total = {}
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, min(len(s), i + toxicity.SPAN + 1)):
                    key = (s[i], s[j], s[k])
                    total[key] = total.get(key, 0) + toxicity.DECAY ** (k - i)
        norm = sum(toxicity.DECAY ** (2 * (k - i)) for i in range(len(s)) for j in range(i + 1, len(s)) for k in range(j + 1, min(len(s), i + toxicity.SPAN + 1))) ** 0.5
        return {k: v / norm for k, v in total.items()}

    words = ["idiot", "idxiot", "trash", "a", "thingamajigs"]
    codes, owner = toxicity.windows(pa.array(words))
    assert owner.tolist() == list(range(len(words)))
    for i, w in enumerate(words):
        scores = toxicity.kernel_scores(codes, toxicity.subsequence_table(codes[i]).astype(np.float32))
        for j, v in enumerate(words):
            a, b = explicit(w), explicit(v)
            assert np.isclose(scores[j], sum(a[k] * b.get(k, 0) for k in a), rtol=1e-4, atol=1e-6)


def test_spelled_apart_and_inserted_insults(spark, docs, labels):
    tests = ["i d i o t", "you st.upid thing", "the traash of it", "LOSER!!", "and the of", "a i o u the", "m-o-r-o-n"]
    model = toxicity.fit(docs, toxicity.labelled(labels, "toxic", 5, 0))
    column = pa.array(tests, pa.large_string())
    scores = model.evidence(column)[:, 0]
    assert min(scores[[0, 3, 6]]) > max(scores[[4, 5]])


def test_windows_of_sentences_are_the_same_in_blocks():
    column = pa.array(["One two. Three four! \n five", "", "  ", "no end " * 40, ". . ."], pa.large_string())
    rows, index, names = toxicity.document_sentences(column)
    assert [names[int(i)].as_py().replace(toxicity._SPACE, " ") for i in index[rows == 0]] == ["One two", "Three four", "five"]
    whole = toxicity.windows(names)
    parts = list(toxicity.window_blocks(names, step=3))
    assert np.array_equal(whole[0], np.concatenate([c for c, _ in parts])) and np.array_equal(whole[1], np.concatenate([o for _, o in parts]))
    # Every place of a long sentence lies in a window, and the spaces between its words too.
    long_one = int(index[rows == 3][0])
    joined = whole[0][whole[1] == long_one]
    assert len(joined) > 20 and (joined == toxicity._END).any(axis=1).all()


def test_an_insult_of_common_words_is_learned_from_sentences(spark):
    rng = np.random.default_rng(5)
    plain = [f"{a}{b}" for a in ("ba", "re", "mo", "tu", "li", "ko", "sa", "ne") for b in ("dan", "rel", "sik", "mor")] + ["cold", "fish", "cold", "fish"]

    def text(toxic):
        sentences = []
        for _ in range(4):
            words = [str(w) for w in rng.choice(plain, 8)]
            words = [w for i, w in enumerate(words) if not (w in ("cold", "fish") and i and words[i - 1] in ("cold", "fish"))]
            sentences.append(" ".join(words))
        if toxic:
            sentences[int(rng.integers(4))] += " cold fish"
        return ". ".join(sentences) + "."

    rows = [(i, text(i % 3 == 0), int(i % 3 == 0)) for i in range(900)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    found = toxicity.score(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")).where("held_out").collect()
    truth = {i: y for i, _, y in rows}
    right = np.mean([r.predicted == truth[r.doc_id] for r in found])
    print("right", right)
    assert len(found) > 100 and right >= 0.85
