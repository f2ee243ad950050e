"""Search over several corpora: failure isolation, enumeration, probes, ambiguity cards, and embeddings by hash."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import search as S

#: What every corpus gives: its name, a reference, confidences, and exact evidence.
HIT = "corpus string, ref string, cn double, cn_raw double, evidence array<string>"
PROBED, EXTRACTED, CARD = 5, 3, 4


@dataclass
class Found:
    """Hits of all corpora that answered, and the reason for each that did not."""

    hits: DataFrame
    missed: dict[str, str] = field(default_factory=dict)

    def counts(self, corpora: list[str]) -> DataFrame:
        """Rows (corpus, n, missed) for every corpus asked, zero filled."""
        spark = self.hits.sparkSession
        asked = spark.createDataFrame([(c, c in self.missed) for c in corpora], "corpus string, missed boolean")
        n = self.hits.groupBy("corpus").agg(F.count("*").alias("n"))
        return asked.join(n, "corpus", "left").select("corpus", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "missed")


def hit(corpus: str, ref: Column, cn: Column, evidence: Column | None = None, raw: Column | None = None) -> list[Column]:
    """The columns of ``HIT``."""
    none = F.array().cast("array<string>")
    return [F.lit(corpus).alias("corpus"), ref.cast("string").alias("ref"), cn.alias("cn"), (cn if raw is None else raw).alias("cn_raw"), (none if evidence is None else evidence).alias("evidence")]


def best(hits: DataFrame, n: int) -> DataFrame:
    return hits.orderBy(F.round("cn", S.PLACES).desc(), F.round("cn_raw", S.PLACES).desc(), "corpus", "ref").limit(n)


def search_all(corpora: Mapping[str, Callable[[], DataFrame]], n: int = 10) -> Found:
    """The best ``n`` hits of each corpus; one that fails, in planning or in running, leaves the others alone.

    Only the ``n`` hits of a corpus come to the driver, so that its failure shows here and not in a later job.
    """
    tables, missed, spark = [], {}, None
    for name, build in corpora.items():
        try:
            top = best(build(), n)
            spark = top.sparkSession
            tables.append(top.toArrow())
        except (PySparkException, S.SearchError) as e:
            missed[name] = type(e).__name__
    if spark is None:
        raise S.SearchError(f"no corpus answered: {missed}")
    rows = [r for t in tables for r in t.to_pylist()]
    return Found(spark.createDataFrame([(r["corpus"], r["ref"], r["cn"], r["cn_raw"], r["evidence"]) for r in rows], HIT), missed)


def enumerated(df: DataFrame, corpus: str, ref: str) -> DataFrame:
    """Rows that filters alone have chosen, as hits: certain, with the filter as evidence."""
    return df.select(*hit(corpus, F.col(ref), F.lit(1.0), F.array(F.lit("FILTER_MATCH"))))


def probe(hits: DataFrame, freshness: DataFrame, texts: DataFrame, now_us: int, stale_us: int = 2 * 900_000_000) -> DataFrame:
    """One row a corpus: its decision over its best five hits, the addresses in the best three, and how fresh it is.

    ``freshness`` has (corpus, last_us), ``texts`` (corpus, ref, text).
    """
    from pyspark.sql import Window

    from ..functions.text import emails

    w = Window.partitionBy("corpus").orderBy(F.round("cn", S.PLACES).desc(), F.round("cn_raw", S.PLACES).desc(), "ref")
    top = hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= PROBED)
    n = top.groupBy("corpus").agg(F.count("*").alias("n"))
    read = texts.join(F.broadcast(top.where(F.col("place") <= EXTRACTED).select("corpus", "ref")), ["corpus", "ref"])  # three rows a corpus
    people = read.groupBy("corpus").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(emails(F.col("text")))))).alias("people"))
    age = F.when(F.col("last_us").isNull(), "never_synced").when(F.lit(now_us) - F.col("last_us") > stale_us, "stale").otherwise("fresh")
    out = S.decisions(top, "corpus", "ref").join(n, "corpus").join(people, "corpus", "left").join(freshness, "corpus", "left")
    return out.select("corpus", "leader", "verdict", "n", F.coalesce("people", F.array().cast("array<string>")).alias("people"), age.alias("freshness"))


def ambiguity_card(hits: DataFrame, order: list[str]) -> DataFrame:
    """Up to four candidates of the first corpus, in ``order``, whose leader qualifies and whose two best are too close."""
    place = F.create_map(*[x for i, c in enumerate(order) for x in (F.lit(c), F.lit(i))])
    open_ = S.verdicts(hits, "corpus", "ref").where("verdict = 'ambiguous'").select("corpus", F.element_at(place, F.col("corpus")).alias("place"))
    first = open_.where("place IS NOT NULL").orderBy("place").limit(1).select("corpus")
    fit = (F.col("cn") >= S.FLOOR_READ) | (F.size("evidence") > 0)
    return best(hits.join(F.broadcast(first), "corpus", "left_semi").where(fit), CARD)  # one row


def token_bags(df: DataFrame, key: str, text: str, size: int = 64) -> DataFrame:
    """Rows (key, vector, texts): deterministic embeddings for tests, words hashed into ``size`` places, of length 1; zeros for no words.

    Texts with the same key make one bag; ``texts`` counts them. The dotted capital I lower-cases to one letter, as in SQL.
    """
    plain = F.lower(F.translate(F.coalesce(text, F.lit("")), "\u0130", "i"))
    # a null behind the words of each text counts the texts
    words = df.select(key, F.explode(F.array_append(F.split(plain, "[^a-z0-9]+"), F.lit(None).cast("string"))).alias("w")).where("w IS NULL OR w <> ''")
    place = F.pmod(F.conv(F.substring(F.md5(F.col("w").cast("binary")), 1, 4), 16, 10).cast("int"), F.lit(size))
    n = words.groupBy(key, place.alias("place")).agg(F.count("*").cast("double").alias("n"))
    known = F.col("place").isNotNull()
    bags = n.groupBy(key).agg(F.map_from_entries(F.collect_list(F.when(known, F.struct("place", "n")))).alias("m"), F.sqrt(F.sum(F.when(known, F.col("n") * F.col("n")))).alias("length"), F.max(F.when(~known, F.col("n"))).alias("texts"))
    return bags.select(key, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i) / F.col("length"), F.lit(0.0))).alias("vector"), F.col("texts").cast("bigint").alias("texts"))


def missing_embeddings(rows: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Each hash and text once that the cache of (model, hash, vector) lacks for this model."""
    known = cache.where(F.col("model") == model).select("hash")
    return rows.groupBy("hash").agg(F.min("text").alias("text")).join(known, "hash", "left_anti")


def embedded(rows: DataFrame, cache: DataFrame, model: str, embed: Callable[[list[str]], list[list[float]]]) -> tuple[DataFrame, DataFrame]:
    """The rows (hash, text, ...) with vectors, and the cache with what was new; ``embed`` takes a batch of texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"model": model, "hash": b["hash"], "vector": embed(b["text"].fillna("").tolist())})

    new = missing_embeddings(rows, cache, model).mapInPandas(run, "model string, hash string, vector array<double>")
    full = cache.unionByName(new)
    return rows.join(full.where(F.col("model") == model).select("hash", "vector"), "hash", "left"), full


def one_model(df: DataFrame, column: str = "embed_model") -> DataFrame:
    """The rows, if their vectors come from one model; scores of different models do not compare."""
    models = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(2).collect()]
    if len(models) > 1:
        raise S.SearchError(f"vectors of different models: {sorted(models)}")
    return df


def reusable(step: str, turn: str) -> bool:
    """Whether a step's query may use the embedding of the turn: it says nothing that the turn does not."""
    words = lambda t: {w.strip(".,;:!?\"'()") for w in t.lower().split()} - {""}
    return bool(words(step)) and words(step) <= words(turn)
