"""Raw payloads of mail, calendar and file services as shape rows, from JSON text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PART = "struct<mimeType:string,filename:string,body:struct<data:string,attachmentId:string,size:bigint>>"
_DEEP = f"struct<mimeType:string,filename:string,body:struct<data:string,attachmentId:string,size:bigint>,parts:array<{_PART}>>"
MAIL = f"id string, threadId string, labelIds array<string>, internalDate string, historyId string, payload struct<mimeType:string,headers:array<struct<name:string,value:string>>,body:struct<data:string,attachmentId:string,size:bigint>,parts:array<{_DEEP}>>"
EVENT = "id string, status string, summary string, description string, location string, organizer struct<email:string>, start struct<dateTime:string,date:string,timeZone:string>, `end` struct<dateTime:string,date:string,timeZone:string>, attendees array<struct<email:string,displayName:string,responseStatus:string,optional:boolean>>, recurringEventId string, etag string"
FILE = "id string, name string, mimeType string, modifiedTime string, owners array<struct<emailAddress:string>>, shared boolean, trashed boolean, parents array<string>, webViewLink string, size string"


def _decoded(data: Column) -> Column:
    """Text of base64url data; padding is optional there."""
    plain = F.translate(data, "-_", "+/")
    return F.decode(F.unbase64(F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), "=")), "UTF-8")


def _header(headers: Column, name: str) -> Column:
    return F.get(F.transform(F.filter(headers, lambda h: F.lower(h["name"]) == name), lambda h: h["value"]), F.lit(0))


def addresses(c: Column) -> Column:
    """Lower-cased addresses of a header."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[\w.+-]+@[\w.-]+\.\w+"), F.lit(0)), F.lower))


def mail(df: DataFrame, column: str = "json") -> DataFrame:
    """Messages of two levels of parts: the first plain text, else the first HTML, is the body; files have names."""
    m = df.select(F.from_json(column, MAIL).alias("m")).select("m.*")
    none = F.lit(None)
    slim = lambda p: F.struct(p["mimeType"].alias("mimeType"), p["filename"].alias("filename"), p["body"].alias("body"))
    outer = F.coalesce(F.col("payload.parts"), F.array())
    inner = F.flatten(F.transform(outer, lambda p: F.coalesce(p["parts"], F.array())))
    whole = F.struct(F.col("payload.mimeType").alias("mimeType"), none.cast("string").alias("filename"), F.col("payload.body").alias("body"))
    leaves = F.concat(F.array(whole), F.transform(outer, slim), inner)
    m = m.withColumn("leaves", leaves)
    text = lambda kind: F.get(F.transform(F.filter("leaves", lambda p: (p["mimeType"] == kind) & p["body"]["data"].isNotNull()), lambda p: _decoded(p["body"]["data"])), F.lit(0))
    head = lambda name: _header(F.col("payload.headers"), name)
    return m.select(
        F.lit("mail").alias("connector"), F.col("id").alias("message_id"), F.col("threadId").alias("thread_id"), F.coalesce("labelIds", F.array()).alias("labels"), head("subject").alias("subject"),
        F.coalesce(text("text/plain"), F.regexp_replace(text("text/html"), "<[^>]*>", " "), F.lit("")).alias("body"), F.get(addresses(head("from")), F.lit(0)).alias("from_email"), addresses(head("to")).alias("to_emails"), addresses(head("cc")).alias("cc_emails"),
        F.exists("leaves", lambda p: F.coalesce(F.length(p["filename"]), F.lit(0)) > 0).alias("has_attachments"), F.array_contains(F.coalesce("labelIds", F.array()), "UNREAD").alias("is_unread"), F.timestamp_millis(F.col("internalDate").try_cast("bigint")).alias("sent_at"),
    )


def _instant(c: str) -> Column:
    """A moment; a bare date is midnight in its zone, UTC without one."""
    zone = F.coalesce(F.col(f"{c}.timeZone"), F.lit("UTC"))
    return F.coalesce(F.try_to_timestamp(F.col(f"{c}.dateTime")), F.to_utc_timestamp(F.try_to_timestamp(F.col(f"{c}.date")), zone))


def events(df: DataFrame, column: str = "json") -> DataFrame:
    """Events; a stub without a start is a cancellation."""
    e = df.select(F.from_json(column, EVENT).alias("e")).select("e.*")
    people = F.coalesce("attendees", F.array())
    return e.select(
        F.lit("calendar").alias("connector"), F.col("id").alias("event_id"), F.when(F.col("start").isNull(), "cancelled").otherwise(F.col("status")).alias("status"), F.col("summary").alias("title"), "description", "location", F.lower("organizer.email").alias("organizer_email"),
        F.transform(people, lambda p: F.lower(p["email"])).alias("attendee_emails"), _instant("start").alias("starts_at"), _instant("end").alias("ends_at"), (F.col("start.date").isNotNull() & F.col("start.dateTime").isNull()).alias("all_day"), F.col("recurringEventId").alias("recurring_event_id"),
    )


def drive(df: DataFrame, column: str = "json") -> DataFrame:
    f = df.select(F.from_json(column, FILE).alias("f")).select("f.*")
    return f.select(F.lit("drive").alias("connector"), F.col("id").alias("file_id"), "name", F.col("mimeType").alias("mime_type"), F.lower(F.get(F.col("owners.emailAddress"), F.lit(0))).alias("owner_email"), F.coalesce("shared", F.lit(False)).alias("is_shared"), F.get("parents", F.lit(0)).alias("folder_id"), F.col("size").try_cast("bigint").alias("size_bytes"), F.try_to_timestamp("modifiedTime").alias("modified_at"), F.coalesce("trashed", F.lit(False)).alias("deleted"), F.col("webViewLink").alias("url"))


def history(df: DataFrame, column: str = "json") -> DataFrame:
    """Rows (message_id, seq, deleted) of a mail history page; a delete wins over every change of the page."""
    one = "array<struct<message:struct<id:string>>>"
    h = df.select(F.explode(F.from_json(column, f"history array<struct<id:string,messagesAdded:{one},labelsAdded:{one},labelsRemoved:{one},messagesDeleted:{one}>>")["history"]).alias("h"))
    ids = lambda c: F.coalesce(F.transform(F.col(f"h.{c}"), lambda x: x["message"]["id"]), F.array())
    rows = h.select(F.col("h.id").cast("bigint").alias("seq"), F.array_union(F.array_union(ids("messagesAdded"), ids("labelsAdded")), ids("labelsRemoved")).alias("changed"), ids("messagesDeleted").alias("gone"))
    both = rows.select("seq", F.explode("changed").alias("message_id"), F.lit(False).alias("deleted")).unionAll(rows.select("seq", F.explode("gone").alias("message_id"), F.lit(True).alias("deleted")))
    return both.groupBy("message_id").agg(F.max("seq").alias("seq"), F.bool_or("deleted").alias("deleted"))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON Lines data set; lines that describe its schema are left out."""
    return spark.read.schema(f"{schema}, _schema string").json(path).where("_schema IS NULL").drop("_schema")


def alias_table(groups: dict[str, dict[str, list[str]]], spark: SparkSession) -> DataFrame:
    """Rows (grp, kind, value) of alias groups: tokens, domains and addresses, each in its folded form."""
    rows = [(g, kind, v.lower()) for g, kinds in groups.items() for kind, values in kinds.items() for v in values]
    return spark.createDataFrame(rows, "grp string, kind string, value string")


def alias_files(spark: SparkSession, path: str) -> DataFrame:
    """The alias table of a folder of JSON Lines, a group a line: (group, tokens, domains, codes).

    Lines of one group are united, missing lists are empty, values stand once; lines without a name are left out.
    """
    rows = spark.read.schema("`group` string, tokens array<string>, domains array<string>, codes array<string>").json(path).where("`group` IS NOT NULL")
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>")))))).alias(c)
    return rows.groupBy("group").agg(*[united(c) for c in ("tokens", "domains", "codes")])
