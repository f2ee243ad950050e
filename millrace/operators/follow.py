"""Follow-ups on what a search has found: typed nodes that are expanded hop by hop, and the second wave of a probe."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import file_words, normalise
from ..sources.scratch import stored


@dataclass(frozen=True)
class Edge:
    """From nodes of one kind to nodes of another: rows (src, dst), both text."""

    source: str
    target: str
    rows: DataFrame


def expand(start: DataFrame, edges: list[Edge], hops: int) -> DataFrame:
    """Rows (kind, id, hop, path) of all nodes within ``hops`` of ``start`` (kind, id), each with the first of its shortest paths.

    A hop joins the nodes that the one before reached with the edges that begin at their kinds, keeps one path of each new
    node and drops nodes that were reached before. Each frontier is written: lineage ends there, and both sides of a join have plain
    exchanges, so that a node with very many edges is split. Paths are nodes ``kind:id`` with a blank between them.
    """
    spark = start.sparkSession
    name = lambda kind, id_: F.concat(F.lit(kind) if isinstance(kind, str) else kind, F.lit(":"), id_)
    first = start.select("kind", "id").where(F.col("id").isNotNull()).distinct().select("kind", "id", F.lit(0).alias("hop"), name(F.col("kind"), F.col("id")).alias("path"))
    reached = [stored(first, "frontier")]
    for hop in range(1, hops + 1):
        last, parts = reached[-1], []
        for e in edges:
            own = last.where(F.col("kind") == e.source).select(F.col("id").alias("src"), "path")
            met = own.join(e.rows.where(F.col("dst").isNotNull()), "src")
            parts.append(met.select(F.lit(e.target).alias("kind"), F.col("dst").alias("id"), F.concat("path", F.lit(" "), name(e.target, F.col("dst"))).alias("path")))
        found = reduce(DataFrame.unionAll, parts).groupBy("kind", "id").agg(F.min("path").alias("path"))
        seen = reduce(DataFrame.unionAll, [r.select("kind", "id") for r in reached])
        new = found.join(seen, ["kind", "id"], "left_anti").select("kind", "id", F.lit(hop).alias("hop"), "path")
        reached.append(stored(new, "frontier"))
        if reached[-1].isEmpty():
            break
    return reduce(DataFrame.unionAll, reached)


def second_wave(spark: SparkSession, mail_hits: DataFrame, event_hits: DataFrame, messages: DataFrame, events: DataFrame, files: DataFrame, *, threads: int = 2, names: int = 3) -> DataFrame:
    """Rows (part, of, ref, place) of what always follows the first wave's hits, best first by ``rank`` among those with ``ok``.

    * participants: the best event's organizer and attendees, each address once;
    * thread, reply: the messages in the threads of the best mails, and those behind the mail that was hit;
    * file: at most ``names`` files whose name has all words of the event's title.

    Hits are few (a top-k of each corpus); messages and files are met by semi joins with them.
    """
    best_event = event_hits.where("ok").orderBy("rank").limit(1).select("event_id")
    event = events.join(F.broadcast(best_event), "event_id", "left_semi")  # one row
    of = F.col("event_id").cast("string")
    people = F.concat(F.array(F.lower("organizer_email")), F.transform(F.coalesce("attendee_emails", F.array().cast("array<string>")), F.lower))
    people = F.array_distinct(F.filter(people, lambda x: x.isNotNull()))
    participants = event.select(F.lit("participant").alias("part"), of.alias("of"), F.posexplode(people).alias("place", "ref")).select("part", "of", "ref", "place")

    two = mail_hits.where("ok").orderBy("rank").limit(threads).join(messages.select("message_id", "thread_id", F.col("position").alias("at")), "message_id")
    anchor = two.groupBy("thread_id").agg(F.min_by("at", "rank").alias("at"))
    told = messages.join(F.broadcast(anchor), "thread_id")  # at most ``threads`` rows
    whole = told.select(F.lit("thread").alias("part"), F.col("thread_id").cast("string").alias("of"), F.col("message_id").alias("ref"), F.col("position").cast("int").alias("place"))
    replies = told.where(F.col("position") > F.col("at")).select(F.lit("reply").alias("part"), F.col("thread_id").cast("string").alias("of"), F.col("message_id").alias("ref"), F.col("position").cast("int").alias("place"))

    title = event.select(of.alias("of"), F.filter(F.split(normalise(F.col("title")), " "), lambda x: x != "").alias("words")).where(F.size("words") > 0)
    named = files.select("file_id", F.split(normalise(F.concat_ws(" ", "name", file_words(F.col("name")), "folder_path")), " ").alias("own"))
    met = named.join(F.broadcast(title), F.size(F.array_except("words", "own")) == 0)  # one title
    order = Window.partitionBy("of").orderBy("file_id")
    related = met.orderBy("file_id").limit(names).select(F.lit("file").alias("part"), "of", F.col("file_id").cast("string").alias("ref"), (F.row_number().over(order) - 1).alias("place"))
    return participants.unionAll(whole).unionAll(replies).unionAll(related)
