"""Operators that plans may name, over the three shapes of a data folder."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import text as T
from ..operators import corpora as C
from ..operators import filters as P
from ..operators import intervals as I
from ..operators import resolve as R
from ..sources.shapes import calendar, files, messages
from .ir import Op, Pause, PlanError, Refs


def registry(spark: SparkSession, d: str) -> dict[str, Op]:
    """All operators, bound to a folder; ``extended`` adds one at run time."""
    shapes = {"mail": (messages, P.MESSAGE, "message_id"), "calendar": (calendar, P.EVENT, "event_id"), "drive": (files, P.FILE, "file_id")}
    out: dict[str, Op] = {}

    def search(name: str) -> Any:
        def lower(limit: int = 50, ids: Any = None, **given: Any) -> DataFrame:
            read, spec, key = shapes[name]
            df = read(spark, d)
            if isinstance(ids, Refs):
                df = ids.filter(df, key)
            elif ids is not None:
                df = df.where(F.col(key).isin(ids))
            return spec.enumerate(df, limit, **given).withColumn("refs", F.col(key))

        return lower

    for name, (read, spec, key) in shapes.items():
        fields = ("refs", key, *read(spark, d).columns)
        args = {"limit": int, "ids": (list, Refs), **{f: object for f in (*spec.filters, *spec.flags)}}
        out[f"{name}.search"] = Op(f"{name}.search", args, fields, search(name))
    out["drive.largest"] = Op("drive.largest", {"limit": int}, ("file_id", "name", "size_bytes"), lambda limit=20: files(spark, d).orderBy(F.desc("size_bytes"), "file_id").limit(limit))
    out["calendar.find_conflicts"] = Op("calendar.find_conflicts", {"title": str, "against": str}, ("one", "other", "minutes"), lambda title, against: _conflicts(spark, d, title, against), ("title", "against"))
    out |= _reads(spark, d) | _meta(spark, d) | _effects(spark)
    out["mail.draft"] = Op("mail.draft", {"to": str, "body": str}, ("to", "body", "status"), lambda to, body: spark.createDataFrame([(to, body, "draft")], "to string, body string, status string"), ("to",), is_write=True)
    return out


def _by_ids(df: DataFrame, key: str, ids: Any) -> DataFrame:
    return ids.filter(df, key) if isinstance(ids, Refs) else df.where(F.col(key).isin(P.listed(ids)))


def _reads(spark: SparkSession, d: str) -> dict[str, Op]:
    """Whole rows by id, free slots, and the entry that a time means."""
    mail = ("message_id", "thread_id", "subject", "text", "emails", "urls")
    file = ("file_id", "name", "text", "urls")

    def get_mail(ids: Any) -> DataFrame:
        m = _by_ids(messages(spark, d), "message_id", ids).groupBy("message_id", "thread_id", "subject").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "body"))).alias("parts"))  # chunks of one message
        body = F.array_join(F.transform("parts", lambda x: x["body"]), "\n")
        return m.select("message_id", "thread_id", "subject", T.clean_mail(body).alias("text"), T.emails(body).alias("emails"), T.urls(body).alias("urls"))

    def get_files(ids: Any) -> DataFrame:
        return _by_ids(files(spark, d), "file_id", ids).select("file_id", "name", F.col("content").alias("text"), T.urls(F.col("content")).alias("urls"))

    def free(day_us: int, days: int = 5, zone: str = "UTC", minutes: int = 30) -> DataFrame:
        busy = calendar(spark, d).where("NOT all_day AND status IS DISTINCT FROM 'cancelled'").select(F.col("calendar_id").alias("who"), F.col("starts_us").alias("start"), F.col("ends_us").alias("end"))
        return I.free_slots(busy, ["who"], day_us, days, minutes * I.MINUTE, zone=zone)

    def match(at_us: int, participants: Any = None, title: str | None = None) -> DataFrame:
        return I.matched(P.EVENT.scan(calendar(spark, d), participants=participants, title_contains=title, not_cancelled=True), "event_id", "starts_us", at_us)

    ids = (list, int, str, Refs)
    return {
        "mail.get": Op("mail.get", {"ids": ids}, mail, get_mail, ("ids",)),
        "calendar.get": Op("calendar.get", {"ids": ids}, ("event_id", "title", "duration", "attendees"), lambda ids: I.shaped(_by_ids(calendar(spark, d), "event_id", ids)), ("ids",)),
        "drive.get": Op("drive.get", {"ids": ids}, file, get_files, ("ids",)),
        "calendar.find_free_slots": Op("calendar.find_free_slots", {"day_us": int, "days": int, "zone": str, "minutes": int}, ("who", "free_from", "free_until"), free, ("day_us",)),
        "calendar.match_event": Op("calendar.match_event", {"at_us": int, "participants": object, "title": str}, ("event_id", "verdict"), match, ("at_us",)),
    }


def _meta(spark: SparkSession, d: str) -> dict[str, Op]:
    """Operators over other operators' rows, and over all corpora."""
    contact = lambda df, address, name, weight, source: df.select(F.lower(address).alias("address"), F.lit(name).alias("name") if name is None else F.col(name).alias("name"), F.lit(weight).alias("weight"), F.lit(source).alias("source"))

    def person(name: str) -> DataFrame:
        m, e = messages(spark, d).withColumn("who", F.substring_index("from_email", "@", 1)), calendar(spark, d).withColumn("who", F.substring_index("organizer_email", "@", 1))
        return R.people(contact(m, "from_email", "who", 1.0, "mail").unionByName(contact(e, "organizer_email", "who", 2.0, "calendar")), name)

    def reference(now_us: int, kind: str | None = None) -> DataFrame:
        e = calendar(spark, d).select(F.col("calendar_id").alias("conversation"), F.col("event_id").alias("ref"), F.col("title").alias("kind"), F.col("starts_us").alias("seen_us"))
        return R.references(e, now_us, kind)

    def search_all(text: str, limit: int = 10) -> DataFrame:
        share = lambda c: F.least(F.lit(1.0), F.regexp_count(F.lower(c), F.lit(re.escape(text.lower()))) / 3.0)
        corpora = {
            "mail": lambda: messages(spark, d).where(F.lower("body").contains(text.lower())).select(*C.hit("mail", F.col("message_id"), share("body"))),
            "calendar": lambda: calendar(spark, d).where(F.lower("title").contains(text.lower())).select(*C.hit("calendar", F.col("event_id"), share("title"))),
            "drive": lambda: files(spark, d).where(F.lower("content").contains(text.lower())).select(*C.hit("drive", F.col("file_id"), share("content"))),
        }
        return C.best(C.search_all(corpora, limit).hits, limit)

    def ask(question: str, choices: Any = ()) -> DataFrame:
        raise Pause(question, tuple(choices))

    def rows_of(rows: Any) -> DataFrame:
        if not isinstance(rows, Refs):
            raise PlanError(["rows must be a [*] reference"])
        return rows.frame

    def mapped(rows: Any, f: Any, schema: str) -> DataFrame:
        return rows_of(rows).mapInArrow(f, schema)

    return {
        "search.all": Op("search.all", {"text": str, "limit": int}, ("corpus", "ref", "cn"), search_all, ("text",)),
        "resolve.person": Op("resolve.person", {"name": str}, ("address", "name", "cn"), person, ("name",)),
        "resolve.reference": Op("resolve.reference", {"now_us": int, "kind": str}, ("conversation", "ref", "score"), reference, ("now_us",)),
        "ask.user": Op("ask.user", {"question": str, "choices": list}, ("answer",), ask, ("question",)),
        "data.filter": Op("data.filter", {"rows": Refs, "tests": list, "mode": str}, (), lambda rows, tests, mode="all": P.where(rows_of(rows), [tuple(t) for t in tests], mode), ("rows", "tests")),
        "text.extract": Op("text.extract", {"rows": Refs, "column": str}, ("order", "ticket", "support", "origin", "date", "missing"), lambda rows, column: rows_of(rows).select("*", X.extracted(F.col(column)).alias("_x")).select("*", "_x.*").drop("_x"), ("rows", "column")),
        "text.map": Op("text.map", {"rows": Refs, "f": object, "schema": str}, (), mapped, ("rows", "f", "schema")),
        "page.more": Op("page.more", {"shape": str, "limit": int, "offset": int, "filters": dict}, (), lambda shape, limit, offset, filters=None: _page(spark, d, shape, limit, offset, filters or {}), ("shape", "limit", "offset")),
    }


def _page(spark: SparkSession, d: str, shape: str, limit: int, offset: int, filters: dict) -> DataFrame:
    shapes = {"mail": (messages, P.MESSAGE), "calendar": (calendar, P.EVENT), "drive": (files, P.FILE)}
    if shape not in shapes:
        raise PlanError([f"no shape {shape!r}"])
    read, spec = shapes[shape]
    return spec.page(read(spark, d), limit, offset, **filters)


#: What may be staged, with the arguments that each needs. A staged action is a row; who carries it out reads the rows.
ACTIONS = {
    "mail.send": ("to", "body"), "mail.update_labels": ("ids", "add", "remove"), "calendar.create_event": ("title", "starts_us", "ends_us"), "calendar.update_event": ("event_id", "etag"), "calendar.delete_event": ("event_id",),
    "drive.create_folder": ("name",), "drive.move_file": ("file_id", "folder_id"), "drive.share_file": ("file_id", "with"), "chat.set_title": ("conversation", "title"),
}
STAGED = "action string, payload map<string, string>, status string, history array<string>"


def _effects(spark: SparkSession) -> dict[str, Op]:
    def stage(name: str, needed: tuple[str, ...]) -> Any:
        def lower(**given: Any) -> DataFrame:
            if lacking := [x for x in needed if given.get(x) is None]:
                raise PlanError([f"{name} needs {', '.join(lacking)}"])
            return spark.createDataFrame([(name, {k: str(v) for k, v in given.items() if v is not None}, "staged", [])], STAGED)

        return lower

    more = {"calendar.create_event": ("attendees", "location"), "calendar.update_event": ("title", "starts_us", "ends_us"), "mail.send": ("subject", "cc")}
    return {name: Op(name, dict.fromkeys((*needed, *more.get(name, ())), object), ("action", "payload", "status"), stage(name, needed), needed, is_write=True) for name, needed in ACTIONS.items()}


def revise(staged: DataFrame, action: str, changes: dict[str, str]) -> DataFrame:
    """Staged actions of a name with changed arguments; what they were before goes to their history."""
    own = (F.col("action") == action) & (F.col("status") == "staged")
    new = F.map_concat(F.map_filter("payload", lambda k, v: ~k.isin(list(changes))), F.create_map(*[F.lit(x) for kv in changes.items() for x in kv]))
    return staged.withColumn("history", F.when(own, F.array_append("history", F.to_json("payload"))).otherwise(F.col("history"))).withColumn("payload", F.when(own, new).otherwise(F.col("payload")))


def relabelled(labels: Column, add: list[str], remove: list[str]) -> Column:
    """A message's labels after a change; a label that is both added and removed stays."""
    return F.array_union(F.array_except(labels, F.lit(remove)), F.lit(add))


def titled(chats: DataFrame, conversation: Any, title: str) -> DataFrame:
    """A conversation gets a title once; one that it has is kept."""
    own = (F.col("conversation") == conversation) & F.col("title").isNull()
    return chats.withColumn("title", F.when(own, F.lit(title)).otherwise(F.col("title")))


def _conflicts(spark: SparkSession, d: str, title: str, against: str) -> DataFrame:
    side = lambda t: calendar(spark, d).where(F.col("title") == t)
    a = side(title).select(F.col("calendar_id").alias("who"), F.col("event_id").alias("one"), F.col("starts_us").alias("start"), F.col("ends_us").alias("end"))
    b = side(against).select(F.col("calendar_id").alias("who"), F.col("event_id").alias("other"), F.col("starts_us").alias("b_start"), F.col("ends_us").alias("b_end"))
    return I.overlap_join(a, b, ["who"]).select("one", "other", I.overlap_minutes().alias("minutes"))


def extended(ops: dict[str, Op], op: Op) -> dict[str, Op]:
    return {**ops, op.name: op}
