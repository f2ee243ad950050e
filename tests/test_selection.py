"""Exact percentiles and running totals against plain versions."""

import math
import random
from collections import defaultdict

import pytest


@pytest.mark.parametrize("most", [3, 100_000])
def test_percentiles_are_exact(spark, most):
    from millrace.operators.selection import exact_percentiles

    rng = random.Random(4)
    groups = {
        "even": [rng.random() for _ in range(3000)], "powers": [2.0 ** -rng.randint(0, 900) for _ in range(800)], "equal": [7.0] * 500, "two": [1.0] * 300 + [2.0] * 300,
        "few": [3.0, -1.0], "one": [5.0], None: [float(i % 10) for i in range(95)], "ties": [float(rng.randint(0, 4)) for _ in range(1000)] + [1e300, -1e300],
    }
    rows = [(g, v) for g, own in groups.items() for v in own] + [("nulls", None), ("even", None)]
    rng.shuffle(rows)
    shares = [0.0, 0.01, 0.5, 0.95, 0.99, 1.0]
    got = exact_percentiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", shares, accuracy=50, most=most).collect()
    want = {(g, s): sorted(own)[max(1, math.ceil(s * len(own) - 1e-9)) - 1] for g, own in groups.items() for s in shares}
    assert len(got) == len(want) and {(r.g, r.share): r.v for r in got} == want


def test_percentiles_of_an_empty_table(spark):
    from millrace.operators.selection import exact_percentiles

    assert exact_percentiles(spark.createDataFrame([], "g string, v double"), "g", "v", [0.5]).count() == 0


def test_running_totals_cross_partitions(spark):
    from millrace.operators.selection import running_totals

    rng = random.Random(9)
    rows = [(rng.choice(["hot", "hot", "a", None]), i, rng.choice([None, *range(5)]), "x") for i in range(2000)]
    table = spark.createDataFrame(rows, "g string, i int, n int, _other string").repartition(5)
    out = running_totals(table, "g", ["i"], "n")
    want, sums = {}, defaultdict(int)
    for g, i, n, _ in sorted(rows, key=lambda r: r[1]):
        sums[g] += n or 0
        want[i] = sums[g]
    got = out.collect()
    assert out.columns == [*table.columns, "upto"] and len(got) == 2000 and {r.i: r.upto for r in got} == want
    assert running_totals(table.where("false"), "g", ["i"], "n").count() == 0


@pytest.mark.parametrize("coalesced", ["true", "false"])
def test_greedy_fit_passes_over_what_does_not_fit(spark, monkeypatch, coalesced):
    from millrace.operators import selection
    from millrace.operators.selection import greedy_fit

    made, plain = {}, selection.stored
    monkeypatch.setattr(selection, "stored", lambda df, label: made.setdefault(label, plain(df, label)))

    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "a", None]), i, rng.choice([None, -2, 0, *range(1, 90)]), "x") for i in range(3000)]
    table = spark.createDataFrame(rows, "g string, i int, n int, _other string").repartition(5)
    room, want = defaultdict(lambda: 400), set()
    for g, i, n, _ in rows:
        if max(n or 0, 0) <= room[g]:
            room[g] -= max(n or 0, 0)
            want.add(i)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
    try:
        out = greedy_fit(table, "g", ["i"], "n", 400)
        got = out.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert coalesced == "true" or made["lefts"].where("_g = 'hot'").count() > 1  # the group lies in several parts
    made.clear()
    assert out.columns == table.columns and len(got) == len(want) and {r.i for r in got} == want
    assert greedy_fit(table.where("false"), "g", ["i"], "n", 400).count() == 0
