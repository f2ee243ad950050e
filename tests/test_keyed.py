"""Merges by key buckets."""

import glob
import hashlib

import pytest

from pyspark.sql import functions as F

SCHEMA = "id bigint, v string, n int"


@pytest.fixture
def table(spark, tmp_path):
    from millrace.streaming import keyed

    root = str(tmp_path / "t")
    rows = [(i, f"v{i}", 1) for i in range(500)] + [(None, "null", 1)]
    keyed.create(spark.createDataFrame(rows, SCHEMA), root, ["id"], 16)
    return root, {i: (v, n) for i, v, n in rows}


def files(root):
    return {f: hashlib.md5(open(f, "rb").read()).hexdigest() for f in glob.glob(f"{root}/data/*/_bucket=*/*.parquet")}


@pytest.mark.parametrize("small", [True, False])
def test_merge_touches_its_buckets_only(spark, table, small, monkeypatch):
    from millrace.streaming import keyed, versions

    root, want = table
    monkeypatch.setattr(keyed, "MOST_BYTES", 1 << 20 if small else -1)
    before, start = files(root), versions.manifest(spark, root)
    source = spark.createDataFrame([(7, "x", 5, False), (8, "gone", 0, True), (1000, "new", 3, False), (2000, "never", 0, True), (None, "y", 2, False)], f"{SCHEMA}, _gone boolean")
    rule = lambda: {"v": F.col("s_v"), "n": F.col("n") + F.col("s_n")}
    new = keyed.merge(spark, root, source, ["id"], SCHEMA, rule)
    want |= {7: ("x", 6), 1000: ("new", 3), None: ("y", 3)}
    del want[8]
    read = lambda at=None: {r.id: (r.v, r.n) for r in keyed.read(spark, root, SCHEMA, at).collect()}
    assert read() == want and keyed.read(spark, root, SCHEMA).count() == len(want)
    kept = [b for b in start.buckets if new.buckets[b] == start.buckets[b]]
    assert 16 - len(kept) <= 5 and new.version == 1
    assert {k: v for k, v in files(root).items() if k in before} == before  # old files as they were
    written = {f.split("_bucket=")[1].split("/")[0] for f in files(root).keys() - before.keys()}
    assert written.isdisjoint(kept)
    assert len(read(start)) == 501 and read(start)[7] == ("v7", 1)  # the version before is still there
    assert keyed.merge(spark, root, source.where("false"), ["id"], SCHEMA).version == 1


def test_target_is_not_exchanged(spark, table):
    from millrace.streaming import keyed, versions

    root, _ = table
    at = versions.manifest(spark, root)
    target = keyed._rows(spark, root, at, SCHEMA, [3, 5]).drop("_bucket")
    source = spark.createDataFrame([(7, "x", 5, False)], f"{SCHEMA}, _gone boolean").selectExpr("id AS s_id", "v AS s_v", "n AS s_n", "_gone AS s__gone")
    out = keyed.merged(target, source, ["id"], {"v": F.col("s_v")}, True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    union = plan[plan.index("Union") :]
    first = union[: union.index("LeftAnti")]
    assert "Exchange hashpartitioning" not in first and "BroadcastHashJoin" in first and "_bucket" in plan.split("PartitionFilters: [")[1][:60]


def test_merges_that_meet(spark, table, monkeypatch):
    from millrace.streaming import keyed, versions

    root, want = table
    real, seen = keyed.merged, []

    def slow(*args):
        seen.append(1)
        if len(seen) == 1:
            keyed.merge(spark, root, spark.createDataFrame([(7, "first", 1)], SCHEMA), ["id"], SCHEMA)
        return real(*args)

    monkeypatch.setattr(keyed, "merged", slow)
    keyed.merge(spark, root, spark.createDataFrame([(7, "second", 1)], SCHEMA), ["id"], SCHEMA, lambda: {"v": F.concat("v", F.lit(","), "s_v")})
    assert keyed.read(spark, root, SCHEMA).where("id = 7").first().v == "first,second" and len(seen) == 3
    assert versions.expire(spark, root, keep=1, least_age_s=0) > 0
    assert keyed.read(spark, root, SCHEMA).count() == len(want)
