"""Upserts and guarded state transitions over tables as values: each returns the table after the change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_wins(batch: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key; pre-aggregates, so that a key with many versions stays small."""
    rest = [c for c in batch.columns if c not in (*key, order)]
    best = batch.groupBy(*key).agg(F.max(F.struct(order, *rest)).alias("_x"))
    return best.select(*key, "_x.*").select(batch.columns)


def upsert(target: DataFrame, source: DataFrame, key: list[str], hash_col: str, vector_col: str) -> DataFrame:
    """Rows of ``source`` replace those of ``target``; with an unchanged hash a missing vector is kept, else it falls."""
    t = target.select(*key, *[F.col(c).alias(f"_t_{c}") for c in target.columns if c not in key], F.lit(True).alias("_in_t"))
    s = source.withColumn("_in_s", F.lit(True))
    both = t.join(s, key, "full")
    out = []
    for c in target.columns:
        if c in key:
            out.append(F.col(c))
        elif c == vector_col:
            kept = F.when(F.col(hash_col).eqNullSafe(F.col(f"_t_{hash_col}")), F.coalesce(c, f"_t_{c}")).otherwise(F.col(c))
            out.append(F.when(F.col("_in_s"), kept).otherwise(F.col(f"_t_{c}")).alias(c))
        else:
            out.append(F.when(F.col("_in_s"), F.col(c)).otherwise(F.col(f"_t_{c}")).alias(c))
    return both.select(*out)


def merge_latest(target: DataFrame, source: DataFrame, key: list[str], seen: str) -> DataFrame:
    """New values fill and replace, missing ones keep the old; the time of last sight never goes back."""
    cols = [c for c in target.columns if c not in (*key, seen)]
    t = target.select(*key, *[F.col(c).alias(f"_t_{c}") for c in (*cols, seen)])
    both = t.join(source, key, "full")
    return both.select(*key, *[F.coalesce(c, f"_t_{c}").alias(c) for c in cols], F.greatest(seen, f"_t_{seen}").alias(seen)).select(target.columns)


def transition(rows: DataFrame, moves: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows (id, status) after ``moves`` (id, expected, to): only from the expected status and along allowed edges.

    ``allowed`` (status, to) is a small table of the state machine. The column ``result`` says what became of a move.
    """
    edges = allowed.withColumn("_ok", F.lit(True))
    m = rows.join(moves, "id", "left").join(edges, ["status", "to"], "left")
    fits = F.col("_ok") & (F.col("expected") == F.col("status"))
    result = F.when(F.col("to").isNull(), "kept").when(F.coalesce(fits, F.lit(False)), "moved").when(F.col("expected") != F.col("status"), "stale").otherwise("refused")
    return m.withColumn("result", result).select("id", F.when(F.col("result") == "moved", F.col("to")).otherwise(F.col("status")).alias("status"), "result")


def supersede(rows: DataFrame, key: list[str], newest: list[str], live: str = "pending") -> DataFrame:
    """Of the live rows of a key all but the newest become superseded."""
    w = Window.partitionBy(*key, F.col("status") == live).orderBy(*[F.desc(c) for c in newest])
    return rows.withColumn("status", F.when((F.col("status") == live) & (F.row_number().over(w) > 1), "superseded").otherwise(F.col("status")))
