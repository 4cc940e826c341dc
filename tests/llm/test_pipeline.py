from collections import defaultdict

import pytest

import corpus_pipeline
from loomledger.llm import licenses, lmscore, simhash
from loomledger.llm.common import written

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def test_stages_keep_columns_and_shrink(stages):
    for before, after in zip(stages[:-2], stages[1:-1], strict=True):
        assert after.columns == COLUMNS and after.dtypes == before.dtypes
        assert 0 < after.count() <= before.count()
    assert {n for n, _ in corpus_pipeline.STAGES} == {"quality", "toxicity", "near_duplicates", "repeated_passages", "packing"}


def test_one_document_of_each_group_stays(stages):
    before = {r.doc_id: r.component_id for r in simhash.near_duplicates(stages[2]).collect()}
    after = {r.doc_id for r in stages[3].collect()}
    assert after == set(before.values())


def test_repeats_go_and_nothing_else(stages):
    before, after = ({r.doc_id: r.text for r in s.collect()} for s in stages[3:5])
    assert set(before) == set(after)
    seen = defaultdict(lambda: 1 << 60)
    for i, t in before.items():
        b = t.encode()
        for p in range(len(b) - 49):
            seen[b[p : p + 50]] = min(seen[b[p : p + 50]], i)
    for i, t in before.items():
        b, gone = t.encode(), set()
        for p in range(len(b) - 49):
            if seen[b[p : p + 50]] < i:
                gone.update(range(p, p + 50))
        assert after[i] == bytes(c for k, c in enumerate(b) if k not in gone).decode("utf-8", "ignore")
    assert all(r.n_chars == len(r.text) for r in stages[4].collect())


def test_packing_holds_every_document(stages):
    assert {r.doc_id for r in stages[5].select("doc_id").distinct().collect()} == {r.doc_id for r in stages[4].collect()}


def test_stages_on_odd_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(900_000, None, None, None, None), (None, "x y z", "en", None, 1), (900_001, "", "en", "s", 0), (900_002, "word " * 40_000, "en", "s", 5), (900_002, "word " * 40_000, "en", "s", 5)], docs.schema)
    for table in (odd, odd.where("false")):
        now = table
        for name, stage in corpus_pipeline.STAGES:
            now = written(stage(spark, now, SF), name)
            now.count()


def test_licences(spark):
    mit = 'MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated\ndocumentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n'
    rows = [
        (1, "Some text.\nLicensed under the Apache License, Version 2.0.", "Apache-2.0", 0),
        (2, "# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n", "Apache-2.0", 0),
        (3, mit, "MIT", 0),
        (4, "RELEASED UNDER THE MIT LICENSE!! This work is licensed under the GNU General Public License, version 3.", "MIT,GPL-3.0-only", 0),
        (5, "Licensed under CC BY-NC 4.0. All rights reserved.", "CC-BY-NC-4.0", 1),
        (6, "no licence here, permission denied", "", 0),
        (7, None, "", 0),
        (8, "", "", 0),
    ]
    found = licenses.scan(spark.createDataFrame([(i, t, "names") for i, t, _, _ in rows], "doc_id long, text string, names string")).collect()
    assert {r.doc_id: (r.licenses, r.n_unmatched) for r in found} == {i: (x, n) for i, _, x, n in rows}
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lm_scores_prefer_the_target(spark):
    target = [(i, "the cat sat on the mat and the dog sat too") for i in range(40)]
    other = [(100 + i, "buy cheap pills now click here to buy now") for i in range(60)]
    docs = spark.createDataFrame([*target, *other, (500, None), (501, ""), (502, "unseen zebra")], "doc_id long, text string")
    scores = {r.doc_id: r for r in lmscore.score(docs, spark.createDataFrame(target, "doc_id long, text string")).collect()}
    assert len(scores) == 103 and scores[0].score < 0 < scores[100].score
    assert scores[500].n_tokens == scores[501].n_tokens == 1
    assert lmscore.score(docs, docs.where("false")).count() == 103
    assert lmscore.score(docs.where("false"), docs).count() == 0
