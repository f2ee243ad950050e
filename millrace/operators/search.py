"""Retrieval: vector and lexical arms, rank fusion, normalised confidence, evidence, decay, and verdicts."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shapes import table

# Fixed values of the scoring rules.
RRF_K, CANDIDATES = 60, 40
SPREAD, FLOOR_READ, MARGIN = 4.0, 0.55, 0.15
MAIL_DAYS, FILE_DAYS, BOOST, BOOST_DAYS = 30.0, 90.0, 0.6, 45.0
PLACES = 9  # scores are compared to this many decimals, so that ties break by key on every engine


class SearchError(ValueError):
    """A search that cannot be answered as asked."""


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays in double precision; null for a zero vector."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(x, x) * dot(y, y))
    return F.when(norm > 0, dot(x, y) / norm)


def top(df: DataFrame, score: str, key: str, n: int) -> DataFrame:
    return df.orderBy(F.round(score, PLACES).desc_nulls_last(), key).limit(n)


def cosine_to(vector: str, query: list[float]) -> Column:
    """``cosine`` of the named column with a fixed vector, term by term, so that it stays in generated code.

    One expression is parsed for all terms: putting hundreds of columns together takes longer than a small scan.
    Null for a query with a component that is not finite.
    """
    if not all(math.isfinite(q) for q in query):
        return F.lit(None).cast("double")
    x = [f"CAST(get(`{vector}`, {i}) AS DOUBLE)" for i in range(len(query))]
    dot = F.expr(" + ".join(["0D", *(f"{c} * ({q!r}D)" for c, q in zip(x, query, strict=True))]))
    square = F.expr(" + ".join(["0D", *(f"{c} * {c}" for c in x)]))
    norm = F.sqrt(square * F.lit(reduce(lambda s, q: s + q * q, query, 0.0)))
    return F.when((norm > 0) & (F.size(vector) == len(query)), dot / norm)


def vector_arm(df: DataFrame, query: list[float], n: int = CANDIDATES, key: str = "id", vector: str = "embedding") -> DataFrame:
    """Rows (key, cosine): the exact best ``n``; nothing but the key and the score is kept until then."""
    q = [float(x) for x in query]
    return top(df.where(F.col(vector).isNotNull()).select(key, cosine_to(vector, q).alias("cosine")), "cosine", key, n)


def lexical_arm(df: DataFrame, terms: list[str], n: int = CANDIDATES, key: str = "id", text: str = "text") -> DataFrame:
    """Rows (key, score): the best ``n`` that hold every term, words of the letters a to z of the lower-case text.

    The score is the sum of the terms' frequencies over 1 + ln(length). Words are told apart once: two spaces stand
    between any two and one at either end, so that words and terms are counted by the bytes that taking them out saves.
    """
    low = F.lower(F.col(text))
    every = lambda c, form: reduce(lambda a, b: a & b, [F.contains(c, F.lit(form.format(t))) for t in terms])
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(low, "[^a-z]+", "  ")), F.lit(" "))
    # a generated row is worked out once, a projected column wherever it is named
    split = df.where(every(low, "{}")).select(key, F.explode(F.array(words)).alias("_words"))
    saved = lambda part: F.octet_length("_words") - F.octet_length(F.replace(F.col("_words"), F.lit(part), F.lit("")))
    counted = reduce(lambda a, b: a + b, [saved(f" {t} ") / (len(t) + 2) for t in terms])
    scored = split.where(every(F.col("_words"), " {} ")).select(key, (counted / (1 + F.log(saved(" ") / 2))).alias("score"))
    return top(scored, "score", key, n)


def ranked(arm: DataFrame, score: str, key: str = "id") -> DataFrame:
    """The arm's positions from 1; an arm holds few rows, so that one window orders it."""
    return arm.withColumn("rank", F.row_number().over(Window.orderBy(F.round(score, PLACES).desc(), key)))


def rrf(*arms: DataFrame, key: str = "id", k: int = RRF_K, weights: tuple[float, ...] | None = None) -> DataFrame:
    """Sum over the arms of weight / (k + rank), by default of equal weights of 1; an arm that misses a key adds nothing."""
    if weights is not None and len(weights) != len(arms):
        raise SearchError(f"{len(weights)} weights for {len(arms)} arms")
    parts = [a.select(key, (w / (k + F.col("rank"))).alias("part")) for a, w in zip(arms, weights or (1.0,) * len(arms), strict=True)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionAll(p)
    return both.groupBy(key).agg(F.sum("part").alias("rrf"))


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def confidence(score: str, *pool: str) -> Column:
    """0.5 + z / 4 within the pool, clamped; the clamped score itself for pools of fewer than 3 or without spread."""
    w = Window.partitionBy(*pool)
    n, mean, sd = F.count(score).over(w), F.avg(score).over(w), F.stddev_pop(score).over(w)
    return F.when((n < 3) | (sd < 1e-9), clamp01(F.col(score))).otherwise(clamp01(0.5 + (F.col(score) - mean) / sd / SPREAD))


def linear_confidence(cosine_: Column) -> Column:
    """Where there is no pool: 0 at a cosine of 0.2, 1 at 0.85, a straight line between."""
    return clamp01((cosine_ - 0.2) / 0.65)


def with_floor(pool: DataFrame, score: str, by: str, name: str) -> DataFrame:
    """The score, or for rows that have none the least of their pool; pools are aggregated and joined back."""
    least = pool.groupBy(F.col(by).alias("_pool")).agg(F.min(score).alias("_floor"))
    return pool.join(least, F.col(by).eqNullSafe(F.col("_pool"))).withColumn(name, F.coalesce(score, "_floor")).drop("_pool", "_floor")


def with_confidence(df: DataFrame, score: str, pool: str, name: str) -> DataFrame:
    """``confidence`` as a column, for pools of any size: their moments are aggregated and joined back."""
    m = df.groupBy(F.col(pool).alias("_pool")).agg(F.count(score).alias("_n"), F.avg(score).alias("_mean"), F.stddev_pop(score).alias("_sd"))
    cn = F.when((F.col("_n") < 3) | (F.col("_sd") < 1e-9), clamp01(F.col(score))).otherwise(clamp01(0.5 + (F.col(score) - F.col("_mean")) / F.col("_sd") / SPREAD))
    return df.join(m, F.col(pool).eqNullSafe(F.col("_pool"))).withColumn(name, cn).drop("_pool", "_n", "_mean", "_sd")


def best_two(df: DataFrame, by: str, key: str, *columns: str) -> DataFrame:
    """For each group its best row's ``columns`` as structs x and y (null without a second), from partial limits."""
    w = Window.partitionBy(by).orderBy(F.round("cn", PLACES).desc(), F.round("cn_raw", PLACES).desc(), key)
    two = df.withColumn("r", F.row_number().over(w)).where("r <= 2")
    row = F.struct(key, *columns)
    return two.groupBy(by).agg(F.max(F.when(F.col("r") == 1, row)).alias("x"), F.max(F.when(F.col("r") == 2, row)).alias("y"))


def decay(age_days: Column, tau_days: float = MAIL_DAYS) -> Column:
    return F.exp(-F.greatest(age_days, F.lit(0.0)) / tau_days)


def boost(days_ahead: Column) -> Column:
    """Coming events gain up to 60 percent, past ones decay like mail."""
    return F.when(days_ahead >= 0, 1 + BOOST * F.exp(-days_ahead / BOOST_DAYS)).otherwise(decay(-days_ahead))


def fuse(vec: DataFrame, lex: DataFrame, known: DataFrame, key: str = "id", mode: str = "hybrid") -> DataFrame:
    """Both arms, or with ``mode`` vector or lexical one of them, in one ranking.

    ``known`` brings ``age_days`` and the array ``evidence`` for each key, whichever arms are used.

    A document that the vector arm missed has the arm's least cosine, one that the lexical arm missed 0. Exact
    evidence makes the confidence 1. Ordered by evidence, decayed confidence, decayed fusion, key.
    """
    if mode not in ("hybrid", "vector", "lexical"):
        raise SearchError(f"no mode {mode!r}")
    vec, lex = (vec if mode != "lexical" else vec.where("false")), (lex if mode != "vector" else lex.where("false"))
    v, x = ranked(vec, "cosine", key).withColumnRenamed("rank", "rv"), ranked(lex, "score", key).withColumnRenamed("rank", "rx")
    part = lambda r: F.coalesce(1.0 / (RRF_K + F.col(r)), F.lit(0.0))
    scores = v.join(x, key, "full").withColumn("rrf", part("rv") + part("rx")).drop("rv", "rx")
    whole = Window.partitionBy()  # two arms' candidates
    scores = scores.withColumn("cosine", F.coalesce("cosine", F.min("cosine").over(whole))).withColumn("score", F.coalesce("score", F.lit(0.0)))
    scores = scores.withColumn("cn_raw", F.greatest(F.when(F.col("cosine").isNotNull(), confidence("cosine")), confidence("score")))
    hits = known.join(F.broadcast(scores), key)  # at most two arms' candidates
    exact = F.size("evidence") > 0
    hits = hits.withColumn("exact", exact).withColumn("cn", F.when(exact, 1.0).otherwise(F.col("cn_raw")))
    hits = hits.withColumn("sort", F.col("cn_raw") * decay(F.col("age_days"))).withColumn("final", F.col("rrf") * decay(F.col("age_days")))
    order = Window.orderBy(F.col("exact").desc(), F.round("sort", PLACES).desc(), F.round("final", PLACES).desc(), key)
    return hits.withColumn("position", F.row_number().over(order))


def verdicts(df: DataFrame, by: str, key: str = "id") -> DataFrame:
    """For each group absent, ambiguous or confident, from its two best confidences; a tie at 1 goes by the raw ones."""
    two = best_two(df, by, key, "cn", "cn_raw")
    gap = F.when((F.col("x.cn") >= 1) & (F.col("y.cn") >= 1), F.col("x.cn_raw") - F.col("y.cn_raw")).otherwise(F.col("x.cn") - F.col("y.cn"))
    verdict = F.when(F.col("x.cn") < FLOOR_READ, "absent").when(F.round(gap, PLACES) < MARGIN, "ambiguous").otherwise("confident")
    return two.select(by, F.col(f"x.{key}").alias("leader"), F.round("x.cn", 6).alias("cn"), F.round(gap, 6).alias("gap"), verdict.alias("verdict"))


def query_vector(spark: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    """The stored vector of one row: a query's embedding."""
    row = table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row["embedding"]]


def arms(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The two arms of the sample question: near vector 0; English documents with "the" and "of"."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    t = table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"), "text")
    return vector_arm(e, query_vector(spark, d)), lexical_arm(t, ["the", "of"])


def vouched(hits: DataFrame, selected: bool) -> DataFrame:
    """A filter on people that chose the rows is evidence of its own."""
    return hits.withColumn("evidence", F.array_union("evidence", F.array(F.lit("FILTER_MATCH")))) if selected else hits


def rescued(df: DataFrame, strict: Column, loose: Column) -> DataFrame:
    """Rows that pass both conditions; where there are none at all, those that pass ``strict``, marked as rescued."""
    both = df.where(strict & loose).withColumn("rescued", F.lit(False))
    none = both.limit(1).agg((F.count("*") == 0).alias("none")).where("none")
    return both.unionByName(df.where(strict).join(none, F.lit(True), "left_semi").withColumn("rescued", F.lit(True)))


def decisions(df: DataFrame, by: str, key: str = "id") -> DataFrame:
    """Verdicts that weigh exact evidence: what leader and runner-up share is ambiguous, what only the leader has decides."""
    two = best_two(df, by, key, "cn", "evidence")
    other = F.coalesce("y.evidence", F.array().cast("array<string>"))
    own = F.col("x.evidence")
    close = F.coalesce(F.round(F.col("x.cn") - F.col("y.cn"), PLACES) < MARGIN, F.lit(False))
    verdict = F.when((F.col("x.cn") < FLOOR_READ) & (F.size(own) == 0), "absent").when(F.size(F.array_intersect(own, other)) > 0, "ambiguous")
    verdict = verdict.when((F.size(own) > 0) & (F.size(other) == 0), "confident").when(close, "ambiguous").otherwise("confident")
    return two.select(by, F.col(f"x.{key}").alias("leader"), verdict.alias("verdict"))
