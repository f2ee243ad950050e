import hashlib
import re
from collections import defaultdict
from fractions import Fraction

import public_tokenizers
import sentencepiece
import pytest

SMALL = "/root/testdata/sf0.001"


def test_all_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} >= {f"op{k}" for k in range(1, 14)}


def test_pipeline_stages_keep_the_columns_and_every_decision(spark):
    import corpus_pipeline
    from millrace.llm.common import stored

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SMALL), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] >= counts[1] == counts[2] >= counts[3] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert last.count() == counts[-1]


def test_pipeline_takes_odd_rows_and_empty_tables(odd, none, spark):
    import corpus_pipeline
    from millrace.llm.common import stored

    for start in (odd, none):
        docs = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stored(stage(spark, docs, SMALL), name)
            assert docs.columns == start.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()
    assert docs.count() == 0


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def _without_shared_lines(docs):
    key, holders = (lambda x: _lower(x.strip(" \t\n\x0b\x0c\r"))), defaultdict(set)
    for i, _, t in docs:
        for x in t.split("\n"):
            holders[key(x)].add(i)
    stays = lambda i, x: len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i
    return [(i, s, "\n".join(x for x in t.split("\n") if stays(i, x))) for i, s, t in docs]


def _without_near_copies(docs):
    sets, root = {}, {i: i for i, _, _ in docs}
    for i, _, t in docs:
        w = _words(_lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [d for d in docs if find(d[0]) == d[0]]


def _mixed(docs):
    size = defaultdict(int)
    for _, s, t in docs:
        size[s] += len(_words(t))
    names = sorted(size)
    weight, target, left = {s: k % 3 + 1 for k, s in enumerate(names)}, {}, Fraction(sum(size.values()))
    while over := [s for s in names if s not in target and left * weight[s] > 3 * size[s] * sum(weight[x] for x in names if x not in target)]:
        target |= {s: Fraction(3 * size[s]) for s in over}
        left -= sum(target[s] for s in over)
    open_ = sum(weight[x] for x in names if x not in target)
    target |= {s: left * weight[s] / open_ for s in names if s not in target}
    out = []
    for s in names:
        passes, rest = divmod(int(target[s] + Fraction(1, 2)), size[s]) if size[s] else (0, 0)
        upto = 0
        for i, t in sorted(((i, t) for i, own, t in docs if own == s), key=lambda d: (hashlib.md5(f"mix:{d[0]}".encode()).hexdigest(), d[0])):
            n = len(_words(t))
            upto += n
            out += [(i, s, t)] * (passes + (2 * upto - n <= 2 * rest))
    return out


def test_pipeline_equals_brute_force_behind_its_classifier(spark):
    import corpus_pipeline

    clean = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL).collect()
    docs = _mixed(_without_near_copies(_without_shared_lines([(r.doc_id, r.source, r.text or "") for r in clean])))
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = [(i, len(ids := library.encode(t, add_eos=True)), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()) for i, _, t in docs]
    got = [(r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SMALL).collect()]
    assert sorted(got) == sorted(want) and len(got) > 50


@pytest.mark.parametrize("name", ["op4_warc", "op6_mix_sources", "op7_minhash_near_dedup", "op9_line_dedup", "op10_hnsw_near_dedup", "op13_conversation_repair"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    theirs = con.execute(__spark_entry__.oracle_sql()[name])
    columns = sorted(c[0] for c in theirs.description)
    place = [[c[0] for c in theirs.description].index(c) for c in columns]
    want = sorted(repr(tuple(r[i] for i in place)) for r in theirs.fetchall())
    got = __spark_entry__.queries()[name](spark, SMALL)
    assert sorted(got.columns) == columns
    assert sorted(repr(tuple(r)) for r in got.select(columns).collect()) == want
