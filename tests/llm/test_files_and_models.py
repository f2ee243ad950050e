import base64
import hashlib
import json
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import toxicity
from millrace.llm.media import cuts, image, samples, store_and_read
from millrace.llm.mixing import capped_shares, cheapest_flow, mix, words
from millrace.llm.toxicity import label_model, learn, score
from millrace.llm.warc import read_warc, write_warc


def test_archive_round_trip(spark):
    rows = [(i, f"http://h/{i}\r\nx" if i % 7 else None, [None, "", "<p>é</p>", f"page {i % 5}", "y" * (i * 50)][i % 5]) for i in range(60)]
    rows += [rows[3], (None, None, None), (None, "u", "alone"), (61, "u", "page 3")]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("page", F.lit("x"))
    uri, manifest = write_warc(frame, shard_bytes=4000, roll_bytes=700)
    got = read_warc(uri, manifest).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", 1 << 60), i)
    want = []
    for i, _, h in rows:
        p, f = (h or "").encode(), first.get(h or "")
        again = f is not None and i != f
        want.append((i is None, i or 0, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", f if again else None))
    key = lambda r: (*r[:5], r[5] or -1)
    assert sorted(map(key, ((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got))) == sorted(map(key, want))
    assert manifest.count() > 5
    _, again = write_warc(frame.repartition(7), shard_bytes=4000, roll_bytes=700)
    names = lambda m: sorted((r.shard, r.seq, r.sha256) for r in m.collect())
    assert names(manifest) == names(again)
    assert read_warc(*write_warc(frame.limit(0))).count() == 0


def test_chunks_rebuild_every_payload():
    rng = random.Random(1)
    texts = ["", "a", "é" * 5000, "".join(rng.choice("abcd \n") for _ in range(60_000))]
    many = [image(t) for t in texts]
    for media, ends in zip(many, cuts(many, 256, 8, 4096), strict=True):
        assert ends[-1] == len(media) and ends == sorted(set(ends))
        assert all(b - a <= 4096 for a, b in zip([0, *ends], ends, strict=False))
    moved = image("xyz" * 100 + texts[3])
    header = lambda media: len(media) - len(samples(media))
    near = {e - header(moved) - 300 for e in cuts([moved], 256, 8, 4096)[0]} & {e - header(many[3]) for e in cuts(many, 256, 8, 4096)[3]}
    assert len(near) > 20  # cuts follow the content
    assert samples(image("abc"))[:4] == b"abc\xff"


def test_media_of_odd_rows(odd, odd_rows, none):
    want = []
    for i, t, *_ in odd_rows:
        b = (t or "").encode()
        p = b + b"\xff" * (576 if not b else -len(b) % 576)
        want.append((i is None, i or 0, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(image(t or "")), hashlib.sha256(image(t or "")).hexdigest(), ",".join(map(str, [*(sum(x >> 5 == k for x in p) for k in range(8)), sum(p), sum(y > x for x, y in zip(p, p[1:], strict=False))]))))
    for hot in (1, 1000):  # with and without chunks that are broadcast
        got = sorted((r.doc is None, r.doc or 0, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) for r in store_and_read(odd, hot_entries=hot).collect())
        assert got == sorted(want)
    assert store_and_read(none).count() == 0
    assert not [t for t in odd.sparkSession.catalog.listTables() if t.name.startswith("millrace_")]


def test_shares_stop_at_the_cap_and_pass_the_rest_on():
    shares = capped_shares([10, 1000, 100], [3, 1, 2], 3)
    assert shares[0] == 30 and shares[2] == 300 and sum(shares) == 1110
    assert capped_shares([], [], 3) == [] and capped_shares([0, 0], [1, 2], 3) == [0, 0]


def test_flow_prefers_first_passes_and_reroutes():
    # pattern 0 serves both sources, pattern 1 only the first
    flow = cheapest_flow([10, 10], [[0, 1], [0]], [10, 10], 3)
    assert flow.get((1, 0), 0) == 10 and flow.get((0, 1), 0) == 10 and flow.get((0, 0), 0) == 0
    flow = cheapest_flow([10, 5], [[0, 1], [0]], [12, 10], 3)
    assert sum(flow.values()) == 22


def test_mix_of_odd_rows(odd, odd_rows, none):
    out = mix(odd, F.array("source"), words(F.col("text"))).collect()
    assert len(out) == len(odd_rows)
    taken, target, size = {}, {}, {}
    for r in out:
        s = r.members[0].name
        taken[s], size[s] = taken.get(s, 0) + r.taken, size.get(s, 0) + r.size
        target[s] = r.target
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.repeats * r.size
    assert all(r.source_size == size[r.members[0].name] for r in out)
    assert all(abs(taken[s] - target[s]) <= max(r.size for r in out if r.members[0].name == s) / 2 + 1 for s in target)
    assert sorted(map(str, out)) == sorted(map(str, mix(odd.repartition(5), F.array("source"), words(F.col("text"))).collect()))
    assert mix(none, F.array("source"), words(F.col("text"))).count() == 0


def test_mix_of_overlapping_sources(spark):
    rows = [(i, ["a"] if i % 3 == 0 else ["b"] if i % 3 == 1 else ["a", "b", "a"], 10 + i % 7) for i in range(300)]
    out = mix(spark.createDataFrame(rows, "doc_id bigint, s array<string>, size bigint"), F.col("s"), F.col("size")).collect()
    assert len({json.dumps([m.name for m in r.members]) for r in out}) == 3
    assert all(r.taken <= 3 * r.size for r in out)


def test_label_model_discounts_voters_that_repeat_each_other():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    vote = lambda right: np.where(rng.random(4000) < right, truth, ~truth) * 2 - 1
    one = vote(0.7)
    votes = np.stack([one, one, one, vote(0.9), vote(0.85), vote(0.95)], axis=1)
    post, found = label_model(votes, np.ones(4000))
    assert ((post > 0.5) == truth).mean() > 0.93
    assert found["correlation"][0, 1] > 0.99 and abs(found["accuracy"][3] - 0.9) < 0.05
    copies = sorted(found["evidence"][:3])
    assert copies[1] < 0.02 < copies[2] < found["evidence"][3]  # two of three that say the same add nothing
    again, _ = label_model(votes[:, [0, 3, 4, 5]], np.ones(4000))
    assert np.abs(again - post).max() < 0.05


def test_label_model_estimates_the_given_label_too():
    rng = np.random.default_rng(1)
    truth = rng.random(6000) < 0.3
    vote = lambda right: np.where(rng.random(6000) < right, truth, ~truth) * 2 - 1
    votes = np.stack([*(vote(0.9) for _ in range(6)), vote(0.7)], axis=1)  # the last, the given label, is often wrong
    post, found = label_model(votes, np.ones(6000))
    assert ((post > 0.5) == truth).mean() > 0.97 and abs(found["accuracy"][-1] - 0.7) < 0.04


def test_toxicity_learns_words_and_beginnings(spark, odd, none):
    rng = random.Random(2)
    plain = ["lorem", "ipsum", "dolor", "amet", "consec", "tetur"]
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 8 == 0
        w = [rng.choice(plain) + rng.choice(["", "ne", "ra", "to"]) for _ in range(rng.randint(3, 60))]
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["moron", "vequ" + rng.choice(["ta", "re", "mi", "so", "lu"])]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs, given = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = learn(docs, given)
    got = {r.row.doc_id: r.score for r in score(docs, model).collect()}
    held = [(got[i], t) for i, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((s >= 0.5) == bool(t) for s, t in held) and len(held) > 200
    assert model.score("a vequnew word") > model.score("a plain word")
    out = score(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert score(none, learn(none, given.where("false"))).count() == 0
    lone = learn(docs, given.where("toxic = 0"))
    assert 0 <= lone.score("") < 0.5


def test_learning_takes_one_python_worker_a_task(spark, monkeypatch):
    """Two Python operators in one stage would take two workers a task, which live on and count for every later stage."""
    rows = [(i, ("you idiot " if i % 3 == 0 else "a calm ") + f"text number {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 3 = 0) AS toxic")
    plans, stored = {}, toxicity.stored
    monkeypatch.setattr(toxicity, "stored", lambda df, label: (plans.update({label: df._jdf.queryExecution().executedPlan().toString()}), stored(df, label))[1])
    learn(docs, labels)
    assert plans["training"].count("MapInArrow") == 1 and "EvalPython" not in plans["training"]
