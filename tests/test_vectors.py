"""The vector index against exact search."""

import numpy as np
import pytest

from pyspark.sql import functions as F


def exact(keys, rows, query, n):
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    order = np.lexsort((keys, -np.round(unit @ (query / np.linalg.norm(query)), 9)))
    return keys[order[:n]].tolist()


@pytest.fixture(scope="module")
def groups(spark, tmp_path_factory):
    """Vectors in 60 groups, some rows that have no cosine, and an index of them."""
    from millrace.operators import vectors as V

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 32))
    rows = centres[rng.integers(60, size=6000)] + 0.25 * rng.normal(size=(6000, 32))
    odd = [(9001, None), (9002, [0.0] * 32), (9003, [float("nan")] * 32), (9004, [1.0]), (9005, []), (9006, [None] + [1.0] * 31), (9007, [float("inf")] * 32)]
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)] + odd, "id bigint, e array<double>")
    path = str(tmp_path_factory.mktemp("vectors"))
    return V.build(table, path, "id", "e"), path, np.float32(rows).astype(float), table


def test_recall_and_rows_read_where_vectors_form_groups(spark, groups):
    from millrace.operators import vectors as V

    model, path, rows, table = groups
    keys = np.arange(len(rows))
    queries = table.where("id % 100 = 0 AND id < 6000").selectExpr("id AS query", "e AS vector")
    got = {}
    for r in V.nearest_of_all(spark, path, queries, least=0).collect():
        got.setdefault(r["query"], set()).add(r.key)
    hits = [len(got[q] & set(exact(keys, rows, rows[q], 40))) for q in range(0, 6000, 100)]
    assert sum(hits) / (40 * len(hits)) >= 0.95
    probed = V.guesses(spark, path, model, rows[0].tolist())
    assert probed.count() <= len(rows) / 10 and model.share <= 0.1
    plan = probed._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "list" in plan.split("PartitionFilters")[1][:80] and "vector" not in plan.split("ReadSchema")[1][:80]


def test_one_query_equals_many_and_scores_are_exact(spark, groups):
    from millrace.operators import vectors as V

    model, path, rows, table = groups
    one = V.nearest(spark, path, rows[300].tolist(), 10, least=0).collect()
    many = V.nearest_of_all(spark, path, table.where("id = 300").selectExpr("id AS query", "e AS vector"), 10, least=0).collect()
    assert {r.key for r in one} == {r.key for r in many}
    for r in one:
        want = rows[r.key] @ rows[300] / np.linalg.norm(rows[r.key]) / np.linalg.norm(rows[300])
        assert r.cosine == pytest.approx(want)
    every = V.nearest(spark, path, rows[300].tolist(), 10, probes=len(model.centres), candidates=len(rows)).collect()
    assert [r.key for r in every] == exact(np.arange(len(rows)), rows, rows[300], 10)
    with pytest.raises(ValueError, match="finite length"):
        V.nearest(spark, path, [0.0] * 32)


def test_small_and_empty_tables(spark, tmp_path):
    from millrace.operators import vectors as V

    few = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [1.0, 0.1, 0.0])], "id int, e array<double>")
    V.build(few, str(tmp_path / "few"), "id", "e")
    assert [r.key for r in V.nearest(spark, str(tmp_path / "few"), [1.0, 0.0, 0.0], 2).collect()] == [1, 3]
    V.build(few.where("false"), str(tmp_path / "none"), "id", "e")
    assert V.nearest(spark, str(tmp_path / "none"), [1.0], 2).count() == 0


def test_recall_on_the_evenly_spread_vectors_of_the_tables(spark, tmp_path):
    from millrace.operators import vectors as V

    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    model = V.build(e, str(tmp_path), "vec_id", "embedding")
    rows = e.orderBy("vec_id").toPandas()
    keys, x = rows.vec_id.to_numpy(), np.array(rows.embedding.tolist(), float)
    got = V.nearest_of_all(spark, str(tmp_path), e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector")), least=0).groupBy("query").agg(F.collect_set("key").alias("keys")).collect()
    hits = [len(set(r["keys"]) & set(exact(keys, x, x[keys == r["query"]][0], 40))) for r in got]
    assert len(hits) == len(keys) // 100 and sum(hits) / (40 * len(hits)) >= 0.95
    assert model.share <= 0.1  # rows that are read in full; of the others one byte in sixteen is read


def test_exact_search_of_all_queries(spark, groups, monkeypatch):
    """Groups with copies that tie across lists and parts, few vectors a part, fewer rows than are asked for."""
    from millrace.operators import vectors as V

    _, path, rows, table = groups
    keys, asked = np.arange(len(rows)), range(0, 6000, 500)
    queries = table.where("id % 500 = 0 AND id < 6000 OR id > 9000").selectExpr("id AS query", "e AS vector")
    for floats in (V.PART_FLOATS, 32 * 700):
        monkeypatch.setattr(V, "PART_FLOATS", floats)
        got = {}
        for r in V.exact_of_all(spark, path, queries).collect():
            got.setdefault(r["query"], set()).add(r.key)
            assert r.cosine == pytest.approx(rows[r.key] @ rows[r["query"]] / np.linalg.norm(rows[r.key]) / np.linalg.norm(rows[r["query"]]))
        assert got == {q: set(exact(keys, rows, rows[q], 40)) for q in asked}


def test_exact_search_of_copies_and_of_few_rows(spark, tmp_path, monkeypatch):
    from millrace.operators import vectors as V

    monkeypatch.setattr(V, "PART_FLOATS", 4 * 50)
    monkeypatch.setattr(V, "ASKED", 2)
    copies = spark.range(300).selectExpr("id", "IF(id % 3 = 0, array(1D, 0D, 0D, 0D), array(1D, CAST(id AS DOUBLE), 2D, 3D)) AS e")
    V.build(copies, str(tmp_path / "copies"), "id", "e")
    got = V.exact_of_all(spark, str(tmp_path / "copies"), copies.where("id % 60 = 0").selectExpr("id AS query", "e AS vector"), 10).collect()
    assert sorted((r["query"], r.key) for r in got) == [(q, k) for q in range(0, 300, 60) for k in range(0, 30, 3)]
    V.build(copies.limit(3), str(tmp_path / "few"), "id", "e")
    assert V.exact_of_all(spark, str(tmp_path / "few"), copies.where("id = 0").selectExpr("id AS query", "e AS vector")).count() == 3
    V.build(copies.where("false"), str(tmp_path / "none"), "id", "e")
    assert V.exact_of_all(spark, str(tmp_path / "none"), copies.selectExpr("id AS query", "array(1.0) AS vector")).count() == 0


def test_query_equals_its_sql_where_vectors_are_evenly_spread(spark):
    import duckdb

    from millrace.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.1/embeddings.parquet'")
    got = sorted(map(tuple, QUERIES["t1_nearest_by_index"](spark, "/root/testdata/sf0.1").collect()))
    assert got == sorted(con.execute(ORACLES["t1_nearest_by_index"]).fetchall()) and len(got) == 800
