"""The three shapes (message, event, file) as DataFrames, each read from the table that carries it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: The sample tables carry no accounts; rows are dealt to so many.
TENANTS = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; timestamps without a zone are taken as UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def micros(c: Column | str) -> Column:
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)


def at(text: str) -> Column:
    """A UTC timestamp literal."""
    return F.to_timestamp(F.lit(text))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as messages: the thread is the conversation, the sender the role."""
    t = table(spark, sf_dir, "conversations")
    sent = F.timestamp_micros(F.lit(1_704_067_200_000_000) + (F.col("conv_id") * 3600 + F.col("turn") * 60) * 1_000_000)
    return t.select(
        F.lit("mail").alias("connector"), F.concat_ws("-", "conv_id", "turn").alias("message_id"), F.col("conv_id").alias("thread_id"), F.col("turn").alias("position"), F.lit(0).alias("chunk_index"),
        F.concat("role", F.lit("@example.com")).alias("from_email"), F.when(F.col("role") == "user", F.array(F.lit("assistant@example.com"))).otherwise(F.array(F.lit("user@example.com"))).alias("to_emails"),
        F.substring("text", 1, 40).alias("subject"), F.col("text").alias("body"), sent.alias("sent_at"), F.pmod("conv_id", F.lit(TENANTS)).alias("tenant"),
        F.array_compact(F.array(F.lit("INBOX"), F.when(F.col("turn") % 2 == 0, "UNREAD"), F.when(F.col("conv_id") % 5 == 0, "Starred"))).alias("labels"), (F.length("text") % 4 == 0).alias("has_attachments"),
        F.when(F.col("conv_id") % 3 == 0, F.array(F.lit("system@example.com"))).otherwise(F.array().cast("array<string>")).alias("cc_emails"),
    )


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calendar entries of one calendar a user, ``value`` minutes long."""
    t = table(spark, sf_dir, "events")
    start = micros("ts")
    return t.select(
        F.lit("calendar").alias("connector"), F.col("event_id"), F.col("user_id").alias("calendar_id"), F.col("event_type").alias("title"), start.alias("starts_us"), (start + F.floor(F.col("value") * 60).cast("bigint") * 1_000_000).alias("ends_us"),
        F.when(F.col("event_type") == "error", "cancelled").when(F.col("event_type") != "view", "confirmed").alias("status"), F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("value"),
        F.pmod("user_id", F.lit(TENANTS)).alias("tenant"), F.concat(F.lit("u"), "user_id", F.lit("@example.com")).alias("organizer_email"), F.array(F.concat(F.lit("U"), F.pmod(F.col("user_id") + 1, F.lit(50)), F.lit("@Example.com")), F.concat(F.lit("u"), F.pmod("event_id", F.lit(50)), F.lit("@example.com"))).alias("attendee_emails"),
        (F.col("value") < 2).alias("all_day"), F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("r"), F.pmod("event_id", F.lit(70)))).alias("recurring_event_id"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: the folder is the source."""
    t = table(spark, sf_dir, "documents")
    return t.select(
        F.lit("drive").alias("connector"), F.col("doc_id").alias("file_id"), F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")).alias("name"), F.col("text").alias("content"), F.concat(F.lit("text/"), "lang").alias("mime_type"), F.col("source").alias("folder_id"), F.concat(F.lit("/"), "lang", F.lit("/"), "source").alias("folder_path"), F.col("n_chars").alias("size_bytes"),
        F.pmod("doc_id", F.lit(TENANTS)).alias("tenant"), (F.lit(1_704_067_200_000_000) + F.pmod(F.col("doc_id") * 7919, F.lit(2_592_000)) * 1_000_000).alias("modified_us"), F.concat("source", F.lit("@example.com")).alias("owner_email"), (F.col("doc_id") % 3 == 0).alias("is_shared"),
        F.when(F.col("doc_id") % 3 == 0, F.array(F.concat("lang", F.lit("@example.com")), F.lit("user@example.com"))).otherwise(F.array().cast("array<string>")).alias("shared_with_emails"),
    )
