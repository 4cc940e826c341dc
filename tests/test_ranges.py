"""Files read in byte ranges against the whole file: line numbers, rejects, CSV records over the borders."""

import csv
import io
import random

import pytest

from loomledger.sources import ranges, scans


@pytest.fixture()
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_are_those_of_the_whole_file(spark, tmp_path, small_blocks):
    rng = random.Random(1)
    texts = {}
    for name in ("a", "b", "c"):
        lines = ["x" * rng.choice((0, 1, 30, 200, 9000)) + f"é{i}" for i in range(400)]
        end = "\r\n" if name == "b" else "\n"
        texts[name] = ("﻿" if name == "a" else "") + end.join(lines) + (end if name != "c" else "")
        (tmp_path / name).write_bytes(texts[name].encode())
    (tmp_path / "empty").write_text("")
    got = scans.text_lines(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() > 16
    rows = {(r.file.rsplit("/", 1)[1], r.line): r.content for r in got.collect()}
    want = {(name, i + 1): line for name, text in texts.items() for i, line in enumerate(text.removeprefix("﻿").replace("\r\n", "\n").removesuffix("\n").split("\n"))}
    assert rows == want


def test_no_task_reads_over_its_range(spark, tmp_path, small_blocks):
    (tmp_path / "f").write_text("".join(f"line {i}\n" for i in range(20_000)))
    per_task = ranges._blocks(spark, str(tmp_path)).groupBy("block").count().collect()
    assert len(per_task) > 16 and max(r["count"] for r in per_task) < 20_000 / 16


def test_url_list_and_rejects(spark, tmp_path, small_blocks):
    lines = []
    for i in range(3000):
        lines.append({0: f"https://a/{i}", 1: f'"https://b/{i}"', 2: f'{{"link": "https://c/{i}"}}', 3: "", 4: '{"x": 1}', 5: '{"url": broken'}[i % 6])
    (tmp_path / "u.jsonl").write_text("\n".join(lines))
    good, bad = scans.read_url_list(spark, str(tmp_path / "u.jsonl"))
    assert {(r.line, r.url) for r in good.collect()} == {(i + 1, f"https://{'abc'[i % 6]}/{i}") for i in range(3000) if i % 6 < 3}
    assert {(r.line, r.reason) for r in bad.collect()} == {(i + 1, {4: "no_url_field", 5: "json_parse"}[i % 6]) for i in range(3000) if i % 6 > 3}


def quoted(cell):
    return '"' + cell.replace('"', '""') + '"'


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_over_borders_equal_the_csv_module(spark, tmp_path, small_blocks, end):
    rng = random.Random(2)
    parts = ["a", "", "long " * 60, 'say "x"', "two\nlines", "\n\n", ',"', "é", "many\nlines\n" * 300]
    rows = [["note", "url", "more"]] + [[quoted(rng.choice(parts)), f"https://a/{i}", rng.choice(("", "plain", 'in"side', quoted(rng.choice(parts))))] for i in range(900)]
    text = end.join(",".join(r) for r in rows)
    (tmp_path / "u.csv").write_bytes(text.encode())
    records, rejects = ranges.csv_records(spark, str(tmp_path / "u.csv"))
    got = [r.content for r in sorted(records.collect(), key=lambda r: r.line)]
    want = list(csv.reader(io.StringIO(text, newline="")))
    assert [next(csv.reader(io.StringIO(x, newline=""))) for x in got] == want
    assert rejects.count() == 0
    good, bad = scans.read_url_list(spark, str(tmp_path / "u.csv"), "csv")
    assert sorted(r.url for r in good.collect()) == sorted(r[1] for r in want[1:]) and bad.count() == 0
    firsts, line = {}, 1
    for row in rows:
        firsts[row[1]] = line
        line += ",".join(row).count("\n") + 1
    assert {r.url: r.line for r in good.collect()} == {u: n for u, n in firsts.items() if u != "url"}


def one_after_the_other(lines):
    """Records and rejected lines by the rule itself, line by line."""
    records, rejects, open_ = [], [], []

    def alone(rows):
        for n, text in rows:
            (records if ranges.outside(text) == "whole" else rejects).append((n, text))

    for n, text in enumerate(lines, 1):
        if open_:
            kind = ranges.inside(text)
            if kind != "wrong":
                open_.append((n, text))
                if kind == "closed":
                    records.append((open_[0][0], "\n".join(t for _, t in open_)))
                    open_ = []
                continue
            alone(open_)
            open_ = []
        kind = ranges.outside(text)
        if kind == "open":
            open_ = [(n, text)]
        else:
            alone([(n, text)])
    alone(open_)
    return sorted(r for r in records if r[1].strip()), sorted(n for n, _ in rejects)


@pytest.mark.parametrize("seed", range(4))
def test_unclosed_quotes_reject_only_their_record(spark, tmp_path, small_blocks, seed):
    rng = random.Random(seed)
    kinds = ["plain,https://a/{}", '"ok, {}",x', '"two {}\nlines",y', '"never {},z', 'z,"', '"a"b,{}', '""', "", 'w,"""{}', "long {} " * 40]
    weights = [30, 10, 6, 0.2, 0.2, 0.4, 1, 2, 0.2, 10]
    lines = "\n".join(rng.choices(kinds, weights)[0].replace('{}', str(i)) for i in range(2500)).split("\n")
    (tmp_path / "u.csv").write_text("\n".join(lines))
    records, rejects = ranges.csv_records(spark, str(tmp_path / "u.csv"))
    want, lost = one_after_the_other(lines)
    assert sorted((r.line, r.content) for r in records.collect()) == want
    assert sorted(r.line for r in rejects.collect()) == lost
