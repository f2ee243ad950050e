"""Expansion by hops against a plain breadth-first search, and the second wave on odd hits."""

import random

from pyspark.sql import functions as F


def test_expand_equals_breadth_first_search(spark):
    from millrace.operators.follow import Edge, expand

    rng = random.Random(3)
    pairs = {("a", "b"): 60, ("b", "c"): 60, ("c", "a"): 40, ("b", "b"): 30}
    rows = {k: [(str(rng.randint(0, 25)) if rng.random() > 0.05 else None, str(rng.randint(0, 25)) if rng.random() > 0.05 else None) for _ in range(n)] for k, n in pairs.items()}
    edges = [Edge(s, t, spark.createDataFrame(own, "src string, dst string")) for (s, t), own in rows.items()]
    start = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "2"), ("a", None)], "kind string, id string")
    want = {("a", "1"): (0, "a:1"), ("b", "2"): (0, "b:2")}
    last = dict(want)
    for hop in range(1, 4):
        found = {}
        for (kind, i), (_, path) in last.items():
            for (s, t), own in rows.items():
                for src, dst in own:
                    if s == kind and src == i and dst is not None and (t, dst) not in want:
                        p = f"{path} {t}:{dst}"
                        found[t, dst] = min(found.get((t, dst), (hop, p)), (hop, p))
        want |= found
        last = found
    got = expand(start, edges, 3).collect()
    assert len(got) == len(want) and {(r.kind, r.id): (r.hop, r.path) for r in got} == want
    assert expand(start.where("false"), edges, 3).count() == 0


def test_second_wave_without_hits_and_with_odd_ones(spark):
    from millrace.operators.follow import second_wave

    messages = spark.createDataFrame([("m1", 1, 0), ("m2", 1, 1), ("m3", 1, 2), ("m4", 2, 0), ("m5", 3, 0)], "message_id string, thread_id int, position int")
    events = spark.createDataFrame([(7, "Plan Review", "Boss@x.org", ["a@x.org", "BOSS@x.org", None, "A@x.org"]), (8, None, None, None)], "event_id int, title string, organizer_email string, attendee_emails array<string>")
    files = spark.createDataFrame([(1, "plan_review.pdf", "/x"), (2, "planReview2.txt", "/x"), (3, "review of the plan.doc", None), (4, None, None)], "file_id int, name string, folder_path string")
    mails = spark.createDataFrame([("m2", True, 1), ("m1", True, 2), ("m4", True, 3), ("m5", False, 0)], "message_id string, ok boolean, rank int")
    hits = spark.createDataFrame([(7, True, 2), (8, False, 1)], "event_id int, ok boolean, rank int")
    wave = lambda a, b: sorted((r.part, r.of, r.ref, r.place) for r in second_wave(spark, a, b, messages, events, files).collect())
    assert wave(mails, hits) == sorted(
        [("participant", "7", "boss@x.org", 0), ("participant", "7", "a@x.org", 1), ("thread", "1", "m1", 0), ("thread", "1", "m2", 1), ("thread", "1", "m3", 2), ("reply", "1", "m3", 2), ("file", "7", "1", 0), ("file", "7", "3", 1)]
    )
    assert wave(mails.where("false"), hits.where("event_id = 8")) == []
    assert wave(mails.where("false"), hits.withColumn("ok", F.col("event_id") == 8)) == []
