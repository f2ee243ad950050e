import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm import hnsw
from millrace.llm.hnsw import near_vectors
from millrace.llm.linededup import dedup_lines
from millrace.llm import minhash
from millrace.llm.minhash import near_duplicates
from millrace.llm.suffixdedup import remove_repeats


def roots(nodes, edges):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in nodes}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == roots({x for e in edges for x in e}, edges)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_line_dedup_of_odd_rows(odd, odd_rows, none):
    blank = " \t\n\x0b\x0c\r"
    key = lambda x: re.sub("[A-Z]+", lambda m: m[0].lower(), x.strip(blank))
    holders = defaultdict(set)
    last = 1 << 70
    for i, t, *_ in odd_rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add(last if i is None else i)
    want = []
    for i, t, *_ in odd_rows:
        lines = (t or "").split("\n")
        own = last if i is None else i
        kept = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == own]
        want.append((i is None, i or 0, "\n".join(kept), len(lines), len(lines) - len(kept)))
    for bits in (1 << 21, 1 << 27):  # a small filter suspects more and changes nothing
        out = dedup_lines(odd, bits=bits)
        assert sorted((r.row.doc_id is None, r.row.doc_id or 0, r.kept, r.n_lines, r.n_dropped) for r in out.collect()) == sorted(want)
    assert set(out.select("row.*").columns) == set(odd.columns) - {"text"}
    assert dedup_lines(none).count() == 0


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_of_odd_rows(odd, odd_rows, none, k):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t, *_ in odd_rows if i is not None}
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = roots(sets, edges)
    got = near_duplicates(odd, words_each=k).collect()
    assert len(got) == len(odd_rows)
    assert {r.doc: r.component for r in got if r.doc is not None} == want
    assert {r.doc: r.n_shingles for r in got if r.doc is not None} == {i: len(s) for i, s in sets.items()}
    assert all(r.component is None for r in got if r.doc is None)
    assert near_duplicates(none).count() == 0


def test_links_between_members_of_a_chain_are_found(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[10 * k : 10 * k + 200]) for k in range(12)]  # each like its neighbour, not like the first
    got = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), words_each=2).collect()
    assert {r.component for r in got} == {0}


def test_links_within_one_crowded_bucket_are_found(spark):
    run, texts = " ".join(f"t{i}" for i in range(101)), []
    for i in range(300):  # two words that each pair shares make the difference between 0.794 and 0.823
        texts.append(f"{run} p{i // 2} q{i // 2} " + " ".join(f"o{i}x{k}" for k in range(11)))
    got = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), words_each=2).collect()
    assert {r.doc: r.component for r in got} == {i: i - i % 2 for i in range(300)}


def test_links_along_a_ring_are_found(spark):
    words = [f"w{i}" for i in range(600)]
    texts = [" ".join((words + words)[10 * k : 10 * k + 200]) for k in range(60)]
    got = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), words_each=2).collect()
    assert {r.component for r in got} == {0}


def test_links_within_large_mixed_buckets_are_found(spark):
    rng = random.Random(5)
    template, pool = [f"t{i}" for i in range(140)], [f"p{i}" for i in range(140)]
    sets = [{*template, *rng.sample(pool, 60)} for _ in range(320)]  # at 0.6 to 0.78 with each other
    for own in sets[:30]:
        mine = sorted(own - {*template})
        sets.append({*template, *mine[:42], *rng.sample(sorted({*pool} - own), 18)})  # at 0.83 with its origin
    edges = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    rows = [(i, " ".join(sorted(s))) for i, s in enumerate(sets)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), words_each=1).collect()
    assert len(edges) >= 30
    assert {r.doc: r.component for r in got} == roots(range(len(sets)), edges)


def test_pairs_of_one_template_that_cannot_be_links_are_never_rows(spark, monkeypatch):
    rng, made = random.Random(9), []
    template, pool = [f"t{i}" for i in range(140)], [f"p{i}" for i in range(140)]
    rows = [(i, " ".join([*template, *rng.sample(pool, 60)])) for i in range(240)]
    plain = minhash.stored

    def counted(df, label):
        out = plain(df, label)
        made.extend([out.count()] if label == "candidates" else [])
        return out

    monkeypatch.setattr(minhash, "stored", counted)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), words_each=1).collect()
    sets = [set(t.split()) for _, t in rows]
    edges = [(a, b) for a in range(240) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert {r.doc: r.component for r in got} == roots(range(240), edges)
    assert len(made) == 4 and sum(made) < 240  # of 28,680 pairs


def rows_of_joins(plan):
    """Numbers of output rows of all joins of a plan that has run."""
    own = [plan.metrics().apply("numOutputRows").value()] if "Join" in plan.nodeName() else []
    return own + [n for i in range(plan.children().size()) for n in rows_of_joins(plan.children().apply(i))]


def test_members_of_a_large_component_meet_only_what_they_may_resemble(spark, monkeypatch):
    rng = random.Random(8)
    first, second = ([f"{k}{i}" for i in range(200)] for k in "ab")
    texts = [" ".join(rng.sample(base, 190) + [f"{base[0]}own{k}x{i}" for i in range(10)]) for base, n in ((first, 160), (second, 220)) for k in range(n)]
    texts += [" ".join(rng.sample(first, 160) + rng.sample(second, 40)) for _ in range(40)]  # alone, with shingles that are rare for them and for the first group
    made, stored = [], minhash.stored

    def counted(df, label):
        if label == "candidates":
            with minhash.settings(spark, {"spark.sql.adaptive.enabled": "false"}):  # a join whose rows all go would leave the plan
                df.collect()
            made.append(max(rows_of_joins(df._jdf.queryExecution().executedPlan())))
        return stored(df, label)

    monkeypatch.setattr(minhash, "stored", counted)
    got = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), words_each=1).collect()
    sets = [set(x.split()) for x in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert {r.doc: r.component for r in got} == roots(range(len(sets)), pairs)
    assert len(made) == 4 and made[-1] < 2_000, made


def test_sketches_never_differ_in_more_slots_than_sets_in_shingles():
    rng = np.random.default_rng(2)
    for n in (1, 5, 60, 900, 5000):
        x = rng.integers(-(1 << 63), 1 << 63, n)
        y = np.concatenate([x[: n - n // 5], rng.integers(-(1 << 63), 1 << 63, n // 6)])
        one, other = minhash.sketches(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)])).view(np.uint8)
        assert np.unpackbits(one ^ other).sum() <= len({*x.tolist()} ^ {*y.tolist()})


def removed(texts, width=400):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[p : p + width] for d in data for p in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for p in range(len(d) - width + 1):
            if seen[d[p : p + width]] > 1:
                gone[p : p + width] = True
        gone = gone[: len(d)]
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, bytes(np.frombuffer(d, np.uint8)[~gone])))
    return out


def test_repeats_of_odd_rows(odd, odd_rows, none):
    want = [(r[0] is None, r[0] or 0, *x) for r, x in zip(odd_rows, removed([r[1] for r in odd_rows]), strict=True)]
    got = [(r.doc is None, r.doc or 0, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(odd).collect()]
    assert sorted(got) == sorted(want)
    assert remove_repeats(none).count() == 0


def test_repeats_with_edits_periods_and_edges(spark):
    rng = np.random.default_rng(1)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    base = word(3000)
    texts = [base, base[:399], base[100:500], base[2000:2399] + word(30), word(50) + base[700:1300] + word(60), "ab" * 900, "z" * 450, "z" * 400]
    for _ in range(6):
        x = list(base)
        for p in rng.integers(0, 3000, 5):
            x[p] = "#"
        texts.append("".join(x))
    got = {r.doc: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == removed(texts)


def test_passages_that_other_texts_repeat(spark):
    rng = random.Random(9)
    make = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(n)]
    base = make(900)
    texts = [base, make(50) + base[100:151] + make(40), make(60) + base[300:350] + make(9), base[500:551], base[500:550], make(70), base[700:800] + ["#"] + base[801:900], [*make(3), *base[850:]]]
    texts += [[*t[:25], "#", *t[26:]] for t in texts[:2]] + [texts[5] + texts[5], make(30)]
    texts = [" ".join(t) for t in texts] + ["same " * 60, "same " * 51, "same " * 50, "", None]
    grams = [{tuple(w[i : i + 51]) for i in range(len(w) - 50)} for w in ((t or "").split() for t in texts)]
    want = [int(any(g & h for j, h in enumerate(grams) if j != i)) for i, g in enumerate(grams)]
    got = {r.doc: r.repeats_passage for r in remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == want and 0 < sum(want) < len(want)


def test_repeats_around_the_pieces_of_long_texts(spark):
    rng = np.random.default_rng(2)
    a, b = ("".join(np.array(list("abcdefgh"))[rng.integers(0, 8, (1 << 22) + 3000)]) for _ in range(2))
    at = (1 << 22) - 250
    passage = b[at : at + 500]
    texts = [a, b, "#" + passage + "#"]  # nothing else occurs twice
    want = [(len(a), 0, 0, a.encode()), (len(b), 500, 1, (b[:at] + b[at + 500 :]).encode()), (502, 500, 1, b"##")]
    got = {r.doc: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert [got[i][:3] for i in range(3)] == [w[:3] for w in want]
    assert [got[i][3] == w[3] for i, w in enumerate(want)] == [True] * 3


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    rows = [base[i % 60] * (1 + i) + rng.normal(size=16) * (i % 4) * 0.12 * (1 + i) for i in range(400)]
    vectors = [(i, r.tolist()) for i, r in enumerate(rows)]
    vectors += [(500, rows[3].tolist()), (501, None), (502, []), (503, [0.0] * 16), (504, [float("nan")] * 16), (505, [None] + [1.0] * 15), (506, [1e-200] * 16), (507, [1e200] * 16), (None, rows[5].tolist()), (508, [1.0, 2.0])]
    sound = {i: np.array(v) / max(map(abs, v)) for i, v in vectors if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    cosine = lambda a, b: len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95
    edges = [(a, b) for a in sound for b in sound if a < b and cosine(sound[a], sound[b])]
    want = roots({i for i, _ in vectors if i is not None}, edges)
    links = Counter(x for e in edges for x in e)
    frame = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>").withColumn("doc", F.lit(1))
    got = near_vectors(frame, shard_rows=100, block_rows=150).collect()
    assert len(got) == len(vectors)
    assert {r.doc: r.component for r in got if r.doc is not None} == want
    assert {r.doc: r.n_links for r in got if r.doc is not None} == {i: links[i] for i in want}
    assert near_vectors(frame.where("vec_id < 0")).count() == 0


def test_small_groups_are_found_beside_a_large_one(spark):
    """Graphs far larger than a beam; the large group, which is compared whole, must not speak for the pairs."""
    rng = np.random.default_rng(8)
    lone, pairs, core = rng.normal(size=(1200, 24)), rng.normal(size=(700, 24)), rng.normal(size=24)
    rows = np.concatenate([lone, pairs, pairs + rng.normal(size=pairs.shape) * 0.2, core + rng.normal(size=(400, 24)) * 0.1])
    rows /= np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    close = np.triu(rows @ rows.T >= 0.95, 1)
    want = Counter(np.concatenate(np.nonzero(close)).tolist())
    frame = spark.createDataFrame(list(enumerate(rows.tolist())), "vec_id bigint, embedding array<double>")
    got = {r.doc: r for r in near_vectors(frame, shard_rows=1500, least_shards=2, block_rows=1500).collect()}
    assert len(got) == len(rows) and all(got[i].n_links <= want[i] for i in got)
    small = [i for i in range(1200, 2600) if want[i]]
    assert len(small) > 1000
    assert sum(got[i].n_links == want[i] for i in small) >= 0.99 * len(small)
    assert all(got[i].n_links == want[i] for i in range(2600, 3000)) and len({got[i].component for i in range(2600, 3000)}) == 1


def test_links_of_a_large_group_are_not_held_as_pairs():
    """A graph in parts, then queries that are all linked with all of it: memory is that of the graph and a few pairs."""
    rng = np.random.default_rng(9)
    n, size = 1500, 64
    raw = (rng.normal(size=size) + rng.normal(size=(n, size)) * 0.05).astype(np.float32)
    rows = pa.table({"node": pa.array(range(n), pa.int64()), "vector": pa.array(raw.tolist(), pa.list_(pa.float32()))})
    graph = hnsw._build_shard((pa.scalar(size), pa.scalar(0)), rows)
    parts = graph.num_rows
    kinds = pa.schema([("size", pa.int32()), ("shard", pa.int32()), ("block", pa.int32()), ("seq", pa.int32()), ("part", pa.binary()), ("node", pa.int64()), ("vector", pa.list_(pa.float32()))])
    head = pa.record_batch([[size] * parts, [0] * parts, [0] * parts, graph.column("seq").to_pylist(), graph.column("part").to_pylist(), [None] * parts, [None] * parts], schema=kinds)
    asked = pa.record_batch([[size] * n, [0] * n, [0] * n, [hnsw._LAST] * n, [None] * n, range(n), raw.tolist()], schema=kinds)
    tracemalloc.start()
    found = sum(x.num_rows for x in hnsw._search(0.95, 48, 0.995)(iter([head, asked])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == n * (n - 1)
    assert most < 150e6  # two matrices of all pairs' vectors in double precision would be 2.3 GB
