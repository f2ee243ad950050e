import json
import os
import shutil

import pandas as pd
import pytest

from pyspark.sql import functions as F

from millrace.streaming import versions
from millrace.streaming.ingest import applied, changes, compact, current, ingest, ordered_log, replay, resync, stuck
from millrace.streaming.limits import breaker, breaker_stream, bucket, bucket_stream, late_policy


def test_bucket_and_breaker_folds():
    state, out = bucket(None, [(0, 3), (0, 3), (1, 1), (10, 5)], rate=1, capacity=5)
    assert [g for g, _ in out] == [True, False, True, True] and out[1][1] == 1
    _, again = bucket(state, [(10, 1)], 1, 5)
    assert again == [(False, 1.0)]
    rows = [(i, False) for i in range(5)] + [(10, True), (310, False), (400, True), (1000, True), (1001, True)]
    assert breaker(None, rows)[1] == ["closed"] * 5 + ["open", "half_open", "open", "half_open", "closed"]


def test_deletes_win_and_replays_change_nothing(spark):
    page = spark.createDataFrame([(1, "a", 1, False), (1, "b", 2, False), (2, "c", 3, False), (2, "c", 4, True)], "id int, v string, seq int, deleted boolean")
    target = spark.createDataFrame([(2, "old", 0), (3, "keep", 0)], "id int, v string, seq int")
    once = applied(target, *changes(page, ["id"], "seq"), ["id"])
    twice = applied(once, *changes(page, ["id"], "seq"), ["id"])
    want = [(1, "b", 2), (3, "keep", 0)]
    assert sorted(map(tuple, once.collect())) == want and sorted(map(tuple, twice.collect())) == want


def test_ingest_pages_of_a_feed(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    for i, rows in enumerate([[(1, "a", False), (2, "b", False)], [(1, "c", False), (2, "b", True)], [(4, "d", False)]]):
        (feed / f"{i}.json").write_text("\n".join(json.dumps({"id": r[0], "v": r[1], "seq": i, "deleted": r[2]}) for r in rows))
        os.utime(feed / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # pages are read in the order of their times
    root = str(tmp_path / "table")
    args = (spark, str(feed), "id int, v string, seq int, deleted boolean", root, str(tmp_path / "cp"), ["id"], "seq", "id int, v string, seq int")
    last = ingest(*args)
    table = lambda: sorted((r.id, r.v) for r in current(spark, root, ["id"], "id int, v string, seq int").collect())
    assert last == 3 and table() == [(1, "c"), (4, "d")]
    before = versions.manifest(spark, root)
    assert before.version == 2 and len(before.deltas) == 3
    assert compact(spark, root, ["id"], "id int, v string, seq int") == 3 and table() == [(1, "c"), (4, "d")]
    assert versions.manifest(spark, root).deltas == ()
    (feed / "3.json").write_text(json.dumps({"id": 4, "v": "d", "seq": 3, "deleted": True}))
    os.utime(feed / "3.json", (1_700_000_009, 1_700_000_009))
    assert ingest(*args) == 4 and table() == [(1, "c")]
    fresh = spark.createDataFrame([(9, "n", 5), (8, "old", 0)], "id int, v string, seq int")
    resync(spark, fresh, root, ["id"], "id int, v string, seq int", "seq", 2)
    assert table() == [(1, "c"), (9, "n")]
    # a new checkpoint numbers its batches from 0, and what it brings stands behind the snapshot
    (tmp_path / "feed2").mkdir()
    (tmp_path / "feed2" / "0.json").write_text(json.dumps({"id": 5, "v": "e", "seq": 6, "deleted": False}))
    again = (args[0], str(tmp_path / "feed2"), *args[2:4], str(tmp_path / "cp2"), *args[5:])
    assert ingest(*again) == 1 and table() == [(1, "c"), (5, "e"), (9, "n")]
    # so does a checkpoint that begins anew in an old place
    shutil.rmtree(tmp_path / "cp2")
    (tmp_path / "feed2" / "0.json").write_text(json.dumps({"id": 6, "v": "f", "seq": 7, "deleted": False}))
    assert ingest(*again) == 1 and table() == [(1, "c"), (5, "e"), (6, "f"), (9, "n")]


def test_replay_and_stuck_runs(spark):
    log = spark.createDataFrame([("r", 1, "a", "x", 1), ("r", 3, "b", "y", 2), ("r", 2, "c", "z", 3), ("r", 3, "b", "y", 4), ("s", 9, "d", "", 5)], "run_id string, seq int, type string, data string, ts int")
    assert [r.seq for r in replay(log, "r", 1).collect()] == [2, 3]
    runs = spark.sql("SELECT * FROM VALUES (1, 'running', TIMESTAMP '2024-01-01 10:00:00'), (2, 'done', TIMESTAMP '2024-01-01 09:00:00'), (3, 'waiting', TIMESTAMP '2024-01-01 10:58:30') AS t(id, status, started_at)")
    assert [r.id for r in stuck(runs, F.to_timestamp(F.lit("2024-01-01 11:00:00")), 60).collect()] == [1]


def _run(spark, frame, tmp_path, build, name):
    src = str(tmp_path / f"{name}-in")
    frame.write.parquet(src)
    out = build(spark.readStream.schema(frame.schema).parquet(src))
    q = out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"{name}-cp")).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_stateful_streams_fold_in_time_order(spark, tmp_path):
    t = pd.to_datetime("2024-01-01") + pd.to_timedelta([3, 0, 1, 2], unit="s")
    frame = spark.createDataFrame(pd.DataFrame({"key": ["k"] * 4, "ts": t, "units": [1.0, 2.0, 2.0, 1.0]}))
    got = {r.ts.second: r.granted for r in _run(spark, frame, tmp_path, lambda s: bucket_stream(s, 0.5, 3), "bucket")}
    assert got == {0: True, 1: False, 2: True, 3: True}
    frame = spark.createDataFrame(pd.DataFrame({"key": ["k"] * 6, "ts": pd.to_datetime("2024-01-01") + pd.to_timedelta(range(6), unit="s"), "ok": [False] * 5 + [True]}))
    assert sorted(r.state for r in _run(spark, frame, tmp_path, breaker_stream, "breaker")) == ["closed"] * 5 + ["open"]


def test_duplicates_go_and_windows_count(spark, tmp_path):
    t = pd.to_datetime("2024-01-01") + pd.to_timedelta([0, 1, 1, 2], unit="min")
    frame = spark.createDataFrame(pd.DataFrame({"run_id": [1] * 4, "seq": [1, 2, 2, 3], "ts": t}))
    assert len(_run(spark, frame, tmp_path, ordered_log, "log")) == 3
    assert late_policy(frame).collect()[0].n == 4


DELTA = "id int, v string, _gone boolean"


def test_versions_are_atomic_and_pinned(spark, tmp_path):
    root = str(tmp_path / "t")
    put = lambda rows, *who: versions.add_delta(spark, root, spark.createDataFrame(rows, DELTA), *who)
    table = lambda at=None: sorted(map(tuple, versions.read(spark, root, ["id"], "id int, v string", at).collect()))
    assert table() == [] and versions.manifest(spark, root).version == -1
    put([(1, "a", False), (2, "b", False)], "s", 0)
    put([(1, "c", False), (2, None, True)], "s", 1)
    assert put([(7, "again", False)], "s", 1).version == 1 and table() == [(1, "c")]  # run again: nothing new
    # a crash between the write and the commit leaves data that nobody reads
    versions.write_data(spark.createDataFrame([(8, "lost", False)], DELTA), root)
    assert table() == [(1, "c")]
    # a reader that has begun sees its version through a compaction and further deltas
    pinned = versions.manifest(spark, root)
    reader = versions.read(spark, root, ["id"], "id int, v string", pinned)
    versions.replace_base(spark, root, lambda at: versions.read(spark, root, ["id"], "id int, v string", at))
    put([(3, "d", False)], "s", 2)
    assert sorted(map(tuple, reader.collect())) == [(1, "c")] == table(pinned) and table() == [(1, "c"), (3, "d")]
    assert versions.expire(spark, root, keep=1, least_age_s=1e6) == 0
    assert versions.expire(spark, root, keep=1, least_age_s=0) == 3 and table() == [(1, "c"), (3, "d")]
    assert versions.versions(spark, root) == [3]


def test_writers_that_meet_build_on_each_other(spark, tmp_path):
    root = str(tmp_path / "t")
    put = lambda i: versions.add_delta(spark, root, spark.createDataFrame([(i, "x", False)], DELTA))
    put(1)
    seen = []

    def slow(now):
        seen.append(now.version)
        if len(seen) == 1:
            put(2)  # another writer is faster
        return versions.replace(now, applied={"mark": 1})

    assert versions.commit(spark, root, slow).version == 2 and seen == [0, 1]
    ids = lambda: sorted(r.id for r in versions.read(spark, root, ["id"], "id int, v string").collect())
    assert ids() == [1, 2]

    def build(at):
        if len(at.deltas) == 2:
            put(3)  # a delta that comes while a base is built stays behind it
        return versions.read(spark, root, ["id"], "id int, v string", at)

    new = versions.replace_base(spark, root, build)
    assert len(new.deltas) == 1 and ids() == [1, 2, 3]
    with pytest.raises(versions.Conflict):
        versions.commit(spark, root, lambda now: (put(4), now)[1], tries=2)


def test_a_failed_base_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "t")
    versions.add_delta(spark, root, spark.createDataFrame([(1, "x", False)], DELTA))
    broken = F.raise_error(F.lit("lost"))
    with pytest.raises(Exception, match="lost"):
        versions.replace_base(spark, root, lambda at: versions.read(spark, root, ["id"], "id int, v string", at).withColumn("v", F.when(F.col("id") == 1, broken).otherwise("y")))
    assert versions.manifest(spark, root).version == 0
    assert [tuple(r) for r in versions.read(spark, root, ["id"], "id int, v string").collect()] == [(1, "x")]


def _pages(spark, tmp_path, name, pages, schema):
    """A stream of files, one a batch, in order."""
    src = tmp_path / name
    src.mkdir()
    for k, rows in enumerate(pages):
        (src / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(src / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))


def _at(minute):
    return f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z"


def test_rolling_log_counts_in_order_drops_late_rows_and_forgets_idle_keys(spark, tmp_path):
    from millrace.streaming.rolling import rolling_stream

    pages = [[("a", 0), ("a", 20), ("b", 5)], [("a", 10), ("a", 59), ("a", 61)], [("b", 90)], [("c", 400), ("a", 12)], [("c", 401)], [("c", 900)]]
    rows = [[{"key": k, "id": f"{k}{m}", "ts": _at(m)} for k, m in page] for page in pages]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = rolling_stream(_pages(spark, tmp_path, "log", rows, "key string, id string, ts timestamp"), 3)
        q = out.writeStream.format("memory").queryName("rolling").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.awaitTermination()
        got = {r.id: (r.used, r.allowed) for r in spark.table("rolling").collect()}
        # a12 comes when rows up to minute 51 have been counted, and is dropped; c900 still waits
        assert got == {"a0": (1, True), "a10": (2, True), "a20": (3, True), "b5": (1, True), "a59": (4, False), "a61": (4, False), "b90": (1, True), "c400": (1, True), "c401": (2, True)}
        state = spark.read.format("statestore").option("stateVarName", "counted").load(str(tmp_path / "cp"))
        assert {r.key.key for r in state.select("key").collect()} <= {"c"}  # a and b have been idle for longer than the window
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_rows_behind_the_watermark_are_left_out_of_windows(spark, tmp_path):
    pages = [[0, 1, 50], [100], [2, 99], [300]]
    rows = [[{"ts": _at(m)} for m in page] for page in pages]
    out = late_policy(_pages(spark, tmp_path, "late", rows, "ts timestamp"), "30 minutes", "15 minutes")
    q = out.writeStream.format("memory").queryName("late").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    base = 1_704_067_200_000_000
    # minute 2 comes when the watermark is at 70: it is dropped; minute 99 is not late
    assert {(r.slot - base) // 60_000_000: r.n for r in spark.table("late").collect()} == {0: 2, 45: 1, 90: 2}
