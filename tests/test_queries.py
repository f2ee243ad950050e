import hashlib
import math

import pytest

from millrace.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return plain(x.asDict()) if hasattr(x, "asDict") else x


@pytest.fixture(scope="module")
def duck():
    con = pytest.importorskip("duckdb").connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SMALL)
    columns = sorted(got.columns)
    rows = [tuple(map(plain, r)) for r in got.select(columns).collect()]
    if name not in ORACLES:
        assert rows
        return
    theirs = duck.execute(ORACLES[name])
    names = [c[0] for c in theirs.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in theirs.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_token_bags_of_odd_texts_equal_their_sql(spark, tmp_path):
    """Texts without words, a dotted capital I, an id twice or missing, and a share that rounds at a tie (41 of 640)."""
    import duckdb

    place = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % 64
    names = {}
    for i in range(100_000):
        names.setdefault(place(f"w{i}"), f"w{i}")
        if len(names) == 64:
            break
    tie = [(7, 41), (1, 637), (2, 46), (3, 5), (4, 3)]  # squares add up to 640 * 640
    assert sum(n * n for _, n in tie) == 640 * 640
    dotted = next(w for w in (f"i{i}x" for i in range(1000)) if place(w) == 7)
    texts = [(1, ""), (2, "!!! ?"), (3, dotted.upper().replace("I", "İ") + " a"), (4, None), (5, f"{names[7]} b"), (5, f"{names[7]} {names[63]}"), (None, names[7]), (6, "日本"), (7, " ".join(w for p, n in tie for w in [names[p]] * n))]
    spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = QUERIES["c43_token_bag"](spark, str(tmp_path)).select("doc_id", "x7", "x63").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, con.execute(ORACLES["c43_token_bag"]).fetchall()))
    assert {r.doc_id: r.x7 for r in got}[7] == 0.064062


@pytest.mark.parametrize("name", ["r24_alias_longest", "x12_aliases_in_messages"])
def test_aliases_from_odd_beginnings_equal_their_sql(spark, tmp_path, name):
    """Beginnings without words for long, words that are cut where only the head is read, and shared ones."""
    import duckdb

    texts = [None, "", "..", "-" * 300 + "the of in", "x" * 197 + " of the", "the " + "y" * 400 + " end", "Thé\u0301 öf " + "é" * 250, "of" + " " * 196 + "the of", "z" * 200, "z" * 201 + " the", "the of", "in the"] * 5
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    said = [(i, 0, "user", t) for i, t in enumerate([*texts[3:12], "of the, in THE", "yes", "of the " + "x" * 197, None])]
    spark.createDataFrame(said, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(con.execute(ORACLES[name]).fetchall()) and len(got) > 5
