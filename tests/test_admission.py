"""Admission as a sorted stream against the rule, one row after the other."""

import random

import pytest
from pyspark.sql import functions as F

from loomledger.operators import graph, ledger

POLICY = {"domain_url_cap": 40, "path_shape_cap": 9, "query_combo_cap": 6, "faceted_cap": 7, "external_hop_max": 2, "deny_domains": ["bad.example"]}
SCHEMA = "line long, canonical_url string, domain string, shape string, combo string, facet string, hops int, excluded string"


def one_by_one(rows, accepted=()):
    of = {}

    def taken(domain, shape, combo, facet):
        s = of.setdefault(domain, {"n": 0, "shape": {}, "combo": {}, "f": 0})
        s["n"] += 1
        s["shape"][shape] = s["shape"].get(shape, 0) + 1
        if combo:
            s["combo"][combo] = s["combo"].get(combo, 0) + 1
        s["f"] += facet is not None
        return s

    for a in accepted:
        taken(*a)
    out = {}
    for line, _, domain, shape, combo, facet, hops, excluded in sorted(rows):
        s = of.get(domain, {"n": 0, "shape": {}, "combo": {}, "f": 0})
        if domain and (domain == "bad.example" or domain.endswith(".bad.example")):
            why = "denied_domain"
        elif excluded:
            why = excluded
        elif (hops or 0) > 2:
            why = "external_hop_exceeded"
        elif s["n"] >= 40:
            why = "domain_url_cap"
        elif s["shape"].get(shape, 0) >= 9:
            why = "path_shape_cap"
        elif combo and s["combo"].get(combo, 0) >= 6:
            why = "query_combo_cap"
        elif facet is not None and s["f"] >= 7:
            why = "faceted_cap"
        else:
            why = None
            taken(domain, shape, combo, facet)
        out[line] = why
    return out


def data(n, seed=1):
    rng = random.Random(seed)
    hot = lambda i: "hot.example" if i % 3 == 0 else rng.choice(["a.example", "b.example", "x.bad.example", "", None, f"d{i % 50}.example"])
    return [(i, f"u{i}", hot(i), rng.choice(["/*", "/a", "/b/*", None]), rng.choice(["", "q", "p&q", None]), rng.choice([None, None, "path"]), rng.choice([0, 1, 3, None]), rng.choice([None] * 9 + ["excluded_param"])) for i in range(n)]


@pytest.mark.parametrize("batch", [7, 10_000])
def test_stream_equals_the_rule(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    rows = data(3000)
    rng = random.Random(2)
    accepted = [(rng.choice(["hot.example", "a.example", "new.example", None]), rng.choice(["/*", "/a"]), rng.choice(["", "q"]), rng.choice([None, "path"])) for _ in range(25)]
    records = spark.createDataFrame(rows, SCHEMA).repartition(6)
    try:
        assert {r.line: r.why for r in ledger.admit(records, POLICY).collect()} == one_by_one(rows)
        old = spark.createDataFrame(accepted, "domain string, shape string, combo string, facet string")
        assert {r.line: r.why for r in ledger.admit(records, POLICY, old).collect()} == one_by_one(rows, accepted)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_full_hot_domain_streams_by(spark):
    lines = spark.range(900_000).select(F.col("id").alias("line"))
    rows = lines.select("line", F.concat(F.lit("u"), "line").alias("canonical_url"), F.when(F.col("line") % 3 == 0, "hot.example").otherwise(F.concat(F.col("line") % 997, F.lit(".example"))).alias("domain"), F.concat(F.lit("/"), F.col("line") % 7).alias("shape"), F.lit("").alias("combo"), F.lit(None).cast("string").alias("facet"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("excluded"))
    judged = ledger.admit(rows, POLICY).groupBy("domain").agg(F.count_if(F.col("why").isNull()).alias("n"), F.max(F.when(F.col("why").isNull(), F.col("line"))).alias("last")).where("domain = 'hot.example'").first()
    assert (judged.n, judged.last) == (40, 117)


def test_readmission_skips_what_came_in_otherwise(spark):
    rows = data(600)
    judged = ledger.admit(spark.createDataFrame(rows, SCHEMA), POLICY)
    accepted, parked = judged.where("why is null").select("domain", "shape", "combo", "facet"), judged.where("why is not null").drop("why")
    gone = parked.where("domain = 'hot.example'").select("canonical_url")
    admitted, remaining = ledger.readmit(parked, accepted, POLICY | {"domain_url_cap": 400, "path_shape_cap": 90}, gone)
    left = {r.domain: (r.remaining, r["sample"]) for r in remaining.collect()}
    assert "hot.example" not in left and admitted.where("domain = 'hot.example'").count() == 0
    assert sum(n for n, _ in left.values()) + admitted.count() + gone.count() == parked.count()


def test_waking_counts_what_was_accepted(spark):
    cards = spark.createDataFrame([(f"c{i}", f"u{i % 4}", "d", "/*", "", None) for i in range(8)], "card_id string, detail_url string, domain string, shape string, combo string, facet string")
    chosen = spark.createDataFrame([(f"c{i}", 8 - i) for i in range(8)], "card_id string, ord int")
    none = spark.createDataFrame([], "canonical_url string, state string")
    accepted = spark.createDataFrame([("d", "/*", "", None)] * 3, "domain string, shape string, combo string, facet string")
    policy = POLICY | {"path_shape_cap": 5}
    out = {r.card_id: r.outcome for r in graph.wake_details(cards, none, chosen, policy, accepted).collect()}
    # In the order asked for c7, c6, ... : u3 and u2 fill the shape's two free places; cards with one detail share its answer.
    assert out == {f"c{i}": "queued" if i % 4 >= 2 else "path_shape_cap" for i in range(8)}
