"""Physical layouts: tables dealt by tenant and sorted by time, derived columns, inverted postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bucket_of(tenant: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(tenant), F.lit(buckets)).cast("int")


def write_table(df: DataFrame, path: str, tenant: str, by: str, buckets: int = 64) -> None:
    """Files by tenant bucket, each sorted by ``by``: a tenant's scan lists one folder, and minima and maxima skip row groups."""
    dealt = df.withColumn("_bucket", bucket_of(tenant, buckets))
    dealt.repartitionByRange("_bucket", tenant, by).sortWithinPartitions("_bucket", tenant, by).write.partitionBy("_bucket").mode("overwrite").parquet(path)


def read_tenant(spark: SparkSession, path: str, tenant: str, value: object, buckets: int = 64) -> DataFrame:
    """One tenant's rows: the bucket is known before the scan, so that other folders are never listed for it."""
    table = spark.read.parquet(path)
    number = spark.createDataFrame([(value,)], f"t {dict(table.dtypes)[tenant]}").select(bucket_of("t", buckets)).first()[0]
    return table.where((F.col("_bucket") == number) & (F.col(tenant) == value)).drop("_bucket")


def append(df: DataFrame, path: str) -> None:
    """A log that only grows: audit rows and traces."""
    df.write.mode("append").parquet(path)


def with_service(df: DataFrame, op: str = "op") -> DataFrame:
    """The service of an operator's name, made by the writer so that every reader finds the same."""
    return df.withColumn("service", F.substring_index(op, ".", 1))


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """Inverted lists (term, key, n, size): each word of each text with its count and the text's length."""
    words = df.select(key, F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: w != "").alias("w")).select(key, "w", F.size("w").alias("size"))
    return words.select(key, "size", F.explode("w").alias("term")).groupBy("term", key, "size").agg(F.count("*").alias("n"))


def lookup(lists: DataFrame, terms: list[str], key: str) -> DataFrame:
    """Keys that hold all terms with their scores, from the terms' lists alone."""
    own = lists.where(F.col("term").isin(terms))
    return own.groupBy(key).agg(F.count("*").alias("terms"), (F.sum("n") / (1 + F.log(F.first("size").cast("double")))).alias("score")).where(F.col("terms") == len(set(terms))).select(key, "score")
