"""Rules from tables, guarded moves, purges, and the registered chunks, against plain versions."""

import random
from collections import defaultdict


def test_first_fitting_rule_decides(spark):
    from millrace.operators.rules import decide

    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice([None, *range(20)])) for i in range(300)]
    rules = [(p, rng.choice(["a", "b", None]), rng.choice([None, 3, 8]), rng.choice([None, 12, 18]), f"r{p}") for p in range(8)]
    table = spark.createDataFrame(rules, "priority int, k string, n_from int, n_upto int, say string")
    got = {r.i: r.say for r in decide(spark.createDataFrame(rows, "i int, k string, n int"), table, ["i"], "say", "none").collect()}
    fits = lambda r, k, n: (r[1] is None or r[1] == k) and (r[2] is None or (n is not None and n >= r[2])) and (r[3] is None or (n is not None and n < r[3]))
    assert got == {i: next((r[4] for r in rules if fits(r, k, n)), "none") for i, k, n in rows}
    assert {r.say for r in decide(spark.createDataFrame(rows, "i int, k string, n int"), table.where("false"), ["i"], "say", "none").collect()} == {"none"}


def test_ends_never_move_and_purges_count(spark):
    from millrace.operators.rules import guarded, purge

    rows = spark.createDataFrame([(1, "done"), (2, "open"), (3, None)], "id int, status string")
    moves = spark.createDataFrame([(1, "open"), (2, "done"), (3, "open")], "id int, to string")
    ends = spark.createDataFrame([("done",), ("done",)], "status string")
    assert {r.id: r.status for r in guarded(rows, moves, ["id"], ends).collect()} == {1: "done", 2: "done", 3: "open"}
    kept, counts = purge(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "t string, x int"), "t", spark.createDataFrame([("a",), ("z",), ("a",)], "t string"))
    assert [tuple(r) for r in kept.collect()] == [("b", 3)] and {r.t: r.n for r in counts.collect()} == {"a": 2, "z": 0}


def test_registered_chunks_equal_the_chunker(spark):
    from millrace.functions.text import pieces
    from millrace.queries import QUERIES

    small = "/root/testdata/sf0.001"
    want = defaultdict(list)
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        for x in pieces(r.text or "", 800, 100):
            want[r.doc_id].append(len(x))
    got = {r.doc_id: (r.chunks, r.longest) for r in QUERIES["c7_chunks"](spark, small).collect()}
    assert got == {k: (len(v), max(v)) for k, v in want.items()}
