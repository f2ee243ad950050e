"""Runs of repeating words against a plain search over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

SMALL = "/root/testdata/sf0.001"


def by_search(words):
    """All runs (start, length, period), each period tried at each place."""
    n, out = len(words), []
    numbers = {w: k for k, w in enumerate(dict.fromkeys(words))}
    own = np.array([numbers[w] for w in words], np.int64)
    for q in range(1, n // 3 + 1):
        same = np.concatenate([[0], (own[q:] == own[:-q]).astype(np.int8), [0]])
        for a, b in zip(np.flatnonzero(np.diff(same) == 1).tolist(), np.flatnonzero(np.diff(same) == -1).tolist(), strict=True):
            length = b - a + q
            part = own[a : a + length]
            if length >= max(24, 3 * q) and not any((part[d:] == part[:-d]).all() for d in range(1, q)):
                out.append((a, length, q))
    return sorted(out)


def expected(doc, text, circles=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc).encode())
    if circles and n and h % 10 == 0 and doc is not None:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = by_search(words)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    listed = digest("".join(f"{s},{m},{q}\n" for s, m, q in runs))
    kept = digest(" ".join(w for i, w in enumerate(words) if i not in dropped))
    return (len(runs), *(best or (None,) * 3), None if best is None else 1000 * best[1] // best[2], listed, kept)


COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query_equals_search(spark):
    import __spark_entry__

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = __spark_entry__.queries()["op11_periodic_runs"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in rows} == {i: expected(i, x) for i, x in texts.items()}
    assert any(r.n_runs for r in rows)


@pytest.mark.parametrize("seed", range(150))
def test_runs_of_words_put_side_by_side(seed):
    from millrace.llm.periodic import find_runs, runs_of_documents

    rng, docs = random.Random(seed), []
    for _ in range(rng.randint(1, 5)):
        words, most = [], rng.randint(0, 300)
        while len(words) < most:
            circle = [rng.randint(0, rng.choice([1, 2, 5])) for _ in range(rng.randint(1, 14))]
            words += circle * rng.randint(1, 8) + [rng.randint(0, 9) for _ in range(rng.randint(0, 6))]
        docs.append(np.array(words, np.int64))
    for own, got in zip(docs, runs_of_documents(docs), strict=True):
        want = by_search(own.tolist())
        assert list(zip(*(x.tolist() for x in got), strict=True)) == want
        whole = find_runs(own)  # without leaving anything out before
        assert sorted(zip(*(x.tolist() for x in whole), strict=True)) == want


def test_every_square_is_in_the_vocabulary():
    from millrace.llm.periodic import Names, blocks, covering, primitive, vocabulary

    rng = random.Random(2)
    for _ in range(200):
        words = [rng.randint(0, rng.choice([1, 2])) for _ in range(rng.randint(2, 40))]
        names = Names(np.array(words, np.int64))
        start, half = covering(names, blocks(names))
        ok = primitive(names, start, half)
        first, behind, half = vocabulary(names, start[ok], half[ok])
        got = {tuple(words[i : i + 2 * h]): b - a for a, b, h in zip(first.tolist(), behind.tolist(), half.tolist(), strict=True) for i in [int(names.order[a])]}
        want = {}
        for h in range(1, len(words) // 2 + 1):
            for i in range(len(words) - 2 * h + 1):
                x = words[i : i + h]
                if x == words[i + h : i + 2 * h] and not any(h % d == 0 and x == x[:d] * (h // d) for d in range(1, h)):
                    square = tuple(x + x)
                    want[square] = want.get(square, 0) + 1
        assert got == want and len(got) == len(half)


def test_long_texts_of_few_words():
    from millrace.llm.periodic import runs_of_documents

    one = np.zeros(60_000, np.int64)
    broken = np.array([0] * 30_000 + [1] + [0] * 30_000)
    long = np.tile(np.arange(4_000), 6)
    got = [list(zip(*(x.tolist() for x in r), strict=True)) for r in runs_of_documents([one, broken, long])]
    assert got == [[(0, 60_000, 1)], [(0, 30_000, 1), (30_001, 30_000, 1)], [(0, 24_000, 4_000)]]


def test_odd_rows(odd, odd_rows, none):
    from millrace.llm.periodic import looped, periodic_runs

    circle = "a b c d e f g h " * 9
    rows = [*odd_rows, (None, circle, *odd_rows[0][2:]), (700, circle + "\x0b\x1cx ", *odd_rows[0][2:])]
    table = odd.sparkSession.createDataFrame(rows, odd.schema).repartition(3)
    for prepare in (None, looped):
        got = periodic_runs(table, prepare=prepare).collect()
        want = [(r[0], *expected(r[0], r[1], prepare is not None)) for r in rows]
        assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    assert periodic_runs(none).count() == 0
    full = periodic_runs(table, with_runs=True).where("doc = 700").first()
    assert full.runs[0].period == 8 and full.collapsed == "a b c d e f g h \x1cx "
