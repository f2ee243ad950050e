"""Who and what is meant: people from mail and calendar, references from what was lately seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalise


def name_match(name: Column, asked: str) -> Column:
    """Share of the asked words that the name has; a word of which only four letters fit counts half."""
    words = F.lit(asked.lower().split())
    have = F.split(normalise(name), " ")
    one = lambda w: F.when(F.array_contains(have, w), 1.0).when((F.length(w) >= 4) & F.exists(have, lambda h: h.startswith(F.substring(w, 1, 4))), 0.5).otherwise(0.0)
    return F.aggregate(F.transform(words, one), F.lit(0.0), lambda a, x: a + x) / F.size(words)


def machine(address: Column) -> Column:
    """Whether an address is a sender that nobody reads."""
    local = F.split_part(F.lower(address), F.lit("@"), F.lit(1))
    return local.isin("noreply", "no-reply", "donotreply", "mailer-daemon", "notifications") | local.startswith("no-reply") | local.startswith("bounce")


def people(seen: DataFrame, asked: str) -> DataFrame:
    """From (address, name, weight, source) the candidates by confidence: the match, and how much was seen of them."""
    p = seen.groupBy("address").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.max_by("name", F.struct(F.length("name"), "name")).alias("name"), F.array_sort(F.collect_set("source")).alias("sources"))
    cn = F.least(F.lit(1.0), 0.75 * name_match(F.col("name"), asked) + 0.25 * F.least("weight", F.lit(10.0)) / 10)
    return p.withColumn("cn", F.round(cn * F.when(machine(F.col("address")), 0.3).otherwise(1.0), 6)).where("cn > 0")


def references(entities: DataFrame, now_us: int, kind: str | None = None) -> DataFrame:
    """Entities of each conversation by recency, later places a little lower."""
    e = entities if kind is None else entities.where(F.col("kind") == kind)
    place = F.row_number().over(Window.partitionBy("conversation").orderBy(F.desc("seen_us"), "ref")) - 1
    age = (F.lit(now_us) - F.col("seen_us")) / 60_000_000.0
    return e.withColumn("score", F.round(1 / (1 + age / 30) - 0.02 * place, 6))
