"""A training corpus from raw documents: toxic ones go, repeated lines go, near copies go, sources are mixed, text is encoded.

``STAGES`` are applied in order; each takes (spark, docs, sf_dir), works on all rows that the one before kept, and
returns the columns of ``documents``, the last one the encoding. What a stage has written is what the next reads.

Defined cases are those of the operators. Documents with a null id are never dropped as copies; after the mix a
document stands as many times as the mix takes it.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import ship, stored, table
from millrace.llm.linededup import dedup_lines
from millrace.llm.minhash import near_duplicates
from millrace.llm.mixing import mix, words
from millrace.llm.sentencepiece_codec import encode_decode
from millrace.llm.toxicity import learn, score


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.5; the classifier learns from labelled rows that are not held out."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, learn(docs, labels)).where("score < 0.5").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share stay in the first; the number of characters follows the text."""
    ship(spark)
    out = dedup_lines(docs)
    columns = {"text": F.col("kept"), "n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": F.col("kept")}
    return out.select(*[columns[c].alias(c) if c in columns else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id."""
    ship(spark)
    copies = near_duplicates(docs).where("doc <> component").select(F.col("doc").alias("doc_id")).distinct()
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    ship(spark)
    taken = mix(docs, F.array("source"), words(F.col("text"))).groupBy("doc").agg(F.max("repeats").alias("repeats")).where("repeats > 0")
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    rows = rows.join(taken, F.col("row.doc_id").eqNullSafe(F.col("doc")))
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))).alias("copy")).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with an end id, as digests with their number."""
    ship(spark)
    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("doc", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: A trained classifier decides the first stage; SQL cannot express it.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
