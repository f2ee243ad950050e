"""Quality and operation metrics: ranked retrieval, confusion, discrete percentiles, freshness."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import exact_percentiles


def percentiles(df: DataFrame, by: str, value: str, *shares: float) -> DataFrame:
    """Discrete percentiles, values that occur, with count and mean; exact for groups of any size."""
    name = lambda s: f"p{round(s * 100)}"
    found = exact_percentiles(df, by, value, list(shares)).withColumnRenamed(by, "_by")
    wide = found.groupBy("_by").agg(*[F.max(F.when(F.col("share") == s, F.col(value))).alias(name(s)) for s in shares])
    own = df.groupBy(by).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"))
    return own.join(wide, own[by].eqNullSafe(wide["_by"]), "left").select(own[by], "n", "mean", *[name(s) for s in shares])


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row: the four counts, precision, recall and F1 of class 1."""
    t, g = F.col(truth) == 1, F.col(guess) == 1
    n = lambda c: F.count(F.when(c, 1))
    c = df.agg(n(t & g).alias("tp"), n(~t & g).alias("fp"), n(t & ~g).alias("fn"), n(~t & ~g).alias("tn"))
    p, r = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("tp", "fp", "fn", "tn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(share(2 * p * r, p + r), 6).alias("f1"))


def retrieval_quality(pairs: DataFrame, k: int = 5, deep: int = 10) -> DataFrame:
    """From (query, doc, grade 0/1, score): P@k strict and capped, R@deep, MRR, nDCG@k by query and over all.

    A query's rows are never ordered as a whole: the best ``deep`` come from limits in each partition, its first
    relevant row is a minimum, and that row's rank is the number of rows before it and 1.
    """
    place = F.struct((-F.round("score", 9)).alias("s"), "doc")
    w = Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "doc")
    best = pairs.select("query", "doc", "score", "grade").withColumn("r", F.row_number().over(w)).where(F.col("r") <= max(k, deep))
    own = pairs.groupBy("query").agg(F.sum("grade").alias("relevant"), F.min(F.when(F.col("grade") == 1, place)).alias("first"))
    firsts = own.select(F.col("query").alias("q"), "first").where(F.col("first").isNotNull())
    before = pairs.select("query", place.alias("place")).join(firsts, F.col("query") == F.col("q")).where(F.col("place") < F.col("first")).groupBy("q").agg(F.count("*").alias("before"))
    ideal = sum(1 / math.log2(i + 1) for i in range(1, k + 1))
    hits = lambda n: F.coalesce(F.sum(F.when(F.col("r") <= n, F.col("grade"))), F.lit(0))
    gain = F.coalesce(F.sum(F.when(F.col("r") <= k, F.col("grade") / F.log2(F.col("r") + 1))), F.lit(0.0))
    top = best.groupBy(F.col("query").alias("b")).agg(hits(k).alias("k"), hits(deep).alias("deep"), gain.alias("gain"))
    m = own.join(top, F.col("query") == F.col("b")).join(before, F.col("query") == F.col("q"), "left")
    m = m.select(
        "query", (F.col("k") / F.least(F.lit(k), F.col("relevant"))).alias("p"), (F.col("k") / k).alias("p_strict"), (F.col("deep") / F.col("relevant")).alias("r"),
        F.when(F.col("first").isNull(), 0.0).otherwise(1.0 / (F.coalesce("before", F.lit(0)) + 1)).alias("mrr"), (F.col("gain") / ideal).alias("ndcg"),
    )
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    out = m.rollup("query").agg(mean("p", f"p{k}"), mean("p_strict", f"p{k}_strict"), mean("r", f"r{deep}"), mean("mrr", "mrr"), mean("ndcg", f"ndcg{k}"))
    return out.withColumn("query", F.coalesce(F.col("query").cast("string"), F.lit("all")))


def class_scores(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Rows (label, tp, fp, fn, precision, recall, f1) for each class and for ``macro`` (mean of classes) and ``micro`` (all together).

    A class is any label that is true or guessed somewhere; null is none. One count by pair of labels is all that moves.
    """
    pairs = df.groupBy(F.col(truth).cast("string").alias("t"), F.col(guess).cast("string").alias("g")).agg(F.count("*").alias("n"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.lit(True).alias("is_true")), F.struct(F.col("g").alias("label"), F.lit(False).alias("is_true")))).alias("x"), "t", "g", "n").select("x.*", "t", "g", "n")
    same = F.coalesce(F.col("t") == F.col("g"), F.lit(False))
    number = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    by = sides.where(F.col("label").isNotNull()).groupBy("label").agg(number(F.col("is_true") & same).alias("tp"), number(~F.col("is_true") & ~same).alias("fp"), number(F.col("is_true") & ~same).alias("fn"))
    p, r = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    scored = by.select("label", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), share(2 * p * r, p + r).alias("f1"))
    total = lambda c: F.sum(c).alias(c)
    macro = scored.agg(total("tp"), total("fp"), total("fn"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")]).select(F.lit("macro").alias("label"), "*")
    micro = by.agg(total("tp"), total("fp"), total("fn")).select(F.lit("micro").alias("label"), "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), share(2 * p * r, p + r).alias("f1"))
    every = scored.unionAll(macro).unionAll(micro).where(F.col("tp").isNotNull())
    return every.select("label", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])
