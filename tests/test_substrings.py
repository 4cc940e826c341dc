"""Substring lookup by grams against comparing everything with everything."""

import random

from loomledger.operators import recon, substrings


def test_pairs_equal_all_comparisons(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcd é😀", k=rng.randint(0, 40))) for _ in range(150)] + ["", None, "aaaaaa", "x" * 3000 + "needle at the end"]
    needles = ["".join(rng.choices("abcd é😀", k=rng.randint(1, 6))) for _ in range(80)] + ["", None, "aa", "aaa", "needle", "zzz", "a%b", ".*", "xxx"]
    got = substrings.contained(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(n,) for n in needles], "needle string"))
    assert {(r.needle, r.text) for r in got.collect()} == {(n, t) for t in texts for n in needles if t and n and n in t}
    assert got.count() == got.distinct().count()


def test_plan_has_no_nested_loop(spark):
    got = substrings.contained(spark.createDataFrame([("some title",)], "text string"), spark.createDataFrame([("title",)], "needle string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "text string"), spark.createDataFrame([("a",), ("abc",)], "text string")
    for texts, needles in ((none, some), (some, none), (none, none)):
        assert substrings.contained(texts, needles.withColumnRenamed("text", "needle")).count() == 0


def test_sections(spark):
    sections = spark.createDataFrame([("p1", "1", "Set up"), ("p2", "2", "How to set up Things"), ("p3", "3", "Things"), ("p4", "4", None), ("p5", "5", "Other THINGS")], "path string, address string, title string")
    ids = spark.createDataFrame([("set up",), ("thing",), ("How to",), ("nothing",), ("",), (None,), ("How to",), ("ow",)], "id string")
    got = sorted((r.id or "-", r.matches, r.verdict, r.address) for r in recon.lookup_sections(sections, ids).collect())
    assert got == sorted([("set up", 1, "found", "1"), ("thing", 3, "ambiguous", None), ("How to", 1, "found", "2"), ("How to", 1, "found", "2"), ("nothing", 0, "missing", None), ("-", 4, "ambiguous", None), ("-", 0, "missing", None), ("ow", 1, "found", "2")])


def test_only_places_of_needles_go_on(spark):
    """Common grams don't multiply: of texts full of a needle's beginning only what may be a needle is sent, once for each text."""
    texts = spark.createDataFrame([(i, "abcabd" * 300 + ("abcabcabx" if i % 10 == 0 else "")) for i in range(100)], "i long, text string")
    needles = spark.createDataFrame([("abcabcabx",), ("abcabd",), ("abcabdabcabc",)], "needle string")
    got = substrings.occurrences(texts, needles)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    pieces = [(r.i, bytes(r.piece)) for r in got.collect()]
    true = {(i, n) for i in range(100) for n in (b"abcabd", *([b"abcabcabx", b"abcabdabcabc"] if i % 10 == 0 else []))}
    assert true <= set(pieces) and len(pieces) == len(set(pieces)) <= 2 * len(true)


def test_places_across_chunks(spark):
    long = "x" * (substrings.CHUNK - 3) + "needle" + "ü" * substrings.CHUNK + "needle" + "y" * 9 + "e" * 70
    texts = spark.createDataFrame([(long,), ("needle",), ("xüber",)], "text string")
    needles = spark.createDataFrame([("xneedleü",), ("needle",), ("eedl" + "e" * 70,), ("y" * 9 + "e" * 70,), ("üb",), ("üx",)], "needle string")
    got = [(r.needle, len(r.text)) for r in substrings.contained(texts, needles).collect()]
    assert sorted(got) == sorted((n.needle, len(t.text)) for t in texts.collect() for n in needles.collect() if n.needle in t.text)
