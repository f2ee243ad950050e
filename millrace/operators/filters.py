"""Whitelisted filters of a shape, and the row predicate language."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import urls

Build = Callable[[Any], Column]


class UnknownFilter(ValueError):
    """A filter that the shape does not offer; it is refused, never dropped."""


@dataclass(frozen=True)
class Spec:
    """A view of a shape: time column, natural key, and the filters that it offers."""

    time_col: str
    key: tuple[str, ...]
    filters: Mapping[str, Build] = field(default_factory=dict)
    flags: Mapping[str, Callable[[], Column]] = field(default_factory=dict)
    descending: bool = True

    def predicate(self, given: Mapping[str, Any]) -> Column:
        """The conjunction of all given filters; None values are skipped, flags take no value."""
        parts = []
        for name, value in given.items():
            if name in self.flags:
                if value:
                    parts.append(self.flags[name]())
            elif name not in self.filters:
                raise UnknownFilter(f"{name!r} is not one of {sorted([*self.filters, *self.flags])}")
            elif value is not None:
                parts.append(self.filters[name](value))
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    def scan(self, df: DataFrame, **given: Any) -> DataFrame:
        return df.where(self.predicate(given))

    def page(self, df: DataFrame, limit: int, offset: int, **given: Any) -> DataFrame:
        """The rows behind ``offset`` in the shape's order: the next page of the same question."""
        return self.enumerate(df, offset + limit, **given).offset(offset)

    def of(self, df: DataFrame, tenant: Any, connector: str | None = None, **given: Any) -> DataFrame:
        """The rows of one tenant, and of one connector if named; a tenant must be given."""
        if tenant is None:
            raise UnknownFilter("a scan needs its tenant")
        own = df.where(F.col("tenant") == tenant)
        return self.scan(own if connector is None else own.where(F.col("connector") == connector), **given)

    def of_plan(self, df: DataFrame, given: Mapping[str, Any]) -> DataFrame:
        """Filters as a plan writes them: ``window`` is since and until, ``x[]`` takes a list, ``bool:x`` a truth value."""
        plain: dict[str, Any] = {}
        for name, value in given.items():
            if name == "window":
                plain |= dict(zip(("since", "until"), bounds(value), strict=True))
            elif name.endswith("[]"):
                plain[name[:-2]] = None if value is None else listed(value)
            elif name.startswith("bool:"):
                plain[name[5:]] = truth(value)
            else:
                plain[name] = value
        return self.scan(df, **plain)

    def enumerate(self, df: DataFrame, limit: int, **given: Any) -> DataFrame:
        """Unscored rows in the shape's order, nulls last, ties by key."""
        t = F.col(self.time_col)
        return self.scan(df, **given).orderBy(t.desc_nulls_last() if self.descending else t.asc_nulls_last(), *self.key).limit(limit)


def listed(value: Any) -> list:
    return list(value) if isinstance(value, (list, tuple, set)) else [value]


def equal(c: str) -> Build:
    return lambda v: F.col(c) == v


def any_of(c: str) -> Build:
    return lambda v: F.col(c).isin(listed(v))


def holds(c: str) -> Build:
    return lambda v: F.array_contains(c, v)


def overlaps(*cs: str) -> Build:
    return lambda v: F.arrays_overlap(F.concat(*[F.transform(c, F.lower) for c in cs]), F.array(*[F.lit(str(x).lower()) for x in listed(v)]))


def contains(c: str) -> Build:
    return lambda v: F.lower(c).contains(str(v).lower())


def truth(value: Any) -> bool | None:
    """True and false as plans write them; None for anything else."""
    if isinstance(value, (bool, int, float)):
        return bool(value)
    return {"true": True, "yes": True, "1": True, "false": False, "no": False, "0": False}.get(str(value).strip().lower())


def moment(value: Any) -> int | None:
    """Microseconds since 1970 of a number, a time, or ISO text (UTC where it names no zone)."""
    if value is None or isinstance(value, int):
        return value
    t = value if isinstance(value, datetime) else datetime.fromisoformat(str(value))
    return round((t if t.tzinfo else t.replace(tzinfo=UTC)).timestamp() * 1e6)


def bounds(window: Any) -> tuple[int | None, int | None]:
    """Since and until of a window: a pair, or a mapping with start/end or since/until."""
    if window is None:
        return None, None
    if isinstance(window, Mapping):
        window = window.get("start", window.get("since")), window.get("end", window.get("until"))
    since, until = map(moment, window)
    if since is not None and until is not None and until <= since:
        raise UnknownFilter(f"the window {window} is empty")
    return since, until


def labelled(name: str) -> Callable[[Any], Column]:
    """Whether a message has a label, whatever its case, as wanted."""
    return lambda v: F.exists("labels", lambda x: F.upper(x) == name) == bool(truth(v))


def people(*cs: str) -> Build:
    """Whether one of the given addresses, whatever their case, is among the columns' (addresses or arrays of them)."""
    return lambda v: F.arrays_overlap(F.transform(F.flatten(F.array(*[F.col(c) if c.endswith("s") else F.array(c) for c in cs])), F.lower), F.array(*[F.lit(str(x).strip().lower()) for x in listed(v)]))


def least(c: str) -> Build:
    return lambda v: F.col(c) >= v


def prefix(c: str) -> Build:
    return lambda v: F.col(c).startswith(v)


def since(c: str) -> Build:
    return lambda v: F.col(c) >= v


def until(c: str) -> Build:
    return lambda v: F.col(c) < v


MESSAGE = Spec(
    "sent_at", ("connector", "message_id"),
    {
        "since": since("sent_at"), "until": until("sent_at"), "connectors": any_of("connector"), "from_email": lambda v: F.col("from_email") == str(v).lower(), "from_emails": lambda v: F.col("from_email").isin([str(x).lower() for x in listed(v)]),
        "to_email": holds("to_emails"), "cc_email": holds("cc_emails"), "participant_emails": people("from_email", "to_emails", "cc_emails"),
        "thread_id": equal("thread_id"), "message_ids": any_of("message_id"), "subject_contains": contains("subject"), "chunk_index": equal("chunk_index"),
        "labels": overlaps("labels"), "has_attachments": lambda v: F.col("has_attachments") == bool(truth(v)), "is_unread": labelled("UNREAD"), "participants": people("from_email", "to_emails"), "min_cn": least("cn"),
        "has_link": lambda v: (F.size(urls(F.col("body"))) > 0) == bool(truth(v)), "text_contains": contains("body"),
    },
)
EVENT = Spec(
    "starts_us", ("connector", "event_id"),
    {
        "since": since("starts_us"), "until": until("starts_us"), "connectors": any_of("connector"), "calendar_id": equal("calendar_id"), "event_ids": any_of("event_id"), "status": equal("status"),
        "status_in": lambda v: F.coalesce("status", F.lit("confirmed")).isin(listed(v)), "ends_after": lambda v: F.coalesce("ends_us", "starts_us") > v, "container_id": equal("calendar_id"), "external_ids": any_of("event_id"),
        "organizer_email": lambda v: F.lower("organizer_email") == str(v).lower(), "recurring_event_id": equal("recurring_event_id"), "all_day": lambda v: F.col("all_day") == bool(truth(v)),
        "attendee_emails": people("attendee_emails"), "participants": people("organizer_email", "attendee_emails"), "min_cn": least("cn"), "title_contains": contains("title"),
    },
    {"not_cancelled": lambda: ~F.col("status").eqNullSafe("cancelled")}, descending=False,
)
FILE = Spec(
    "modified_us", ("connector", "file_id"),
    {
        "since": since("modified_us"), "until": until("modified_us"), "connectors": any_of("connector"), "owner_email": lambda v: F.lower("owner_email") == str(v).lower(), "is_shared": lambda v: F.col("is_shared") == bool(truth(v)),
        "participant_emails": people("shared_with_emails"), "participants": people("owner_email"), "min_cn": least("cn"), "text_contains": contains("content"),
        "mime_type": equal("mime_type"), "mime_types": any_of("mime_type"), "file_ids": any_of("file_id"), "folder_prefix": prefix("folder_path"), "name_contains": contains("name"), "container_id": equal("folder_id"),
    },
)
#: What people call kinds of files.
FILE_KINDS = {"pdf": "application/pdf", "doc": "application/msword", "document": "application/msword", "sheet": "text/csv", "spreadsheet": "text/csv", "slides": "application/vnd.ms-powerpoint", "deck": "application/vnd.ms-powerpoint", "image": "image/png", "text": "text/plain"}


def kind_words(query: str, kinds: Mapping[str, str] = FILE_KINDS) -> tuple[str, list[str]]:
    """A question without the words that name kinds of files, and those kinds; the question stays if nothing else is left."""
    words = query.split()
    named = list(dict.fromkeys(kinds[k] for w in words if (k := w.lower().strip(".,?!").removesuffix("s")) in kinds or (k := w.lower().strip(".,?!")) in kinds))
    rest = [w for w in words if w.lower().strip(".,?!") not in kinds and w.lower().strip(".,?!").removesuffix("s") not in kinds]
    return (" ".join(rest) if rest else query), named


def window_for(shape: str, window: tuple[int, int] | None, now_us: int, lookback_us: int = 90 * 86_400_000_000) -> tuple[int | None, int | None]:
    """The window that a search of a shape uses: entries of a calendar lie where they are said to lie, whereas
    messages and files of a window that begins in the future are those of the default look-back."""
    if shape == "calendar":
        return window or (None, None)
    return window if window and window[0] < now_us else (now_us - lookback_us, now_us)


# -- the row predicate language -------------------------------------------------------------------------------


def _folded(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string")))


def _number(c: Column) -> Column:
    """A number as it stands, text as a number or else as the seconds of a timestamp."""
    text = c.cast("string")
    return F.coalesce(text.try_cast("double"), F.unix_micros(F.try_to_timestamp(text)) / 1e6)


def _same(c: Column, v: Any) -> Column:
    if isinstance(v, bool):
        return F.coalesce(c.cast("boolean") == v, F.lit(False))
    return F.coalesce(_folded(c) == str(v).strip().lower() if isinstance(v, str) else c == v, F.lit(False))


def _empty(c: Column, kind: str) -> Column:
    out = c.isNull()
    if kind.startswith(("array", "map")):
        return out | (F.size(c) == 0)
    return out | (c == "") if kind == "string" else out


def test(c: Column, kind: str, op: str, v: Any) -> Column:
    """One test as a column that is never null; ``kind`` is the column's type."""
    is_list = kind.startswith("array")
    no = F.lit(False)
    if op in ("eq", "ne"):
        return _same(c, v) if op == "eq" else ~_same(c, v)
    if op in ("in", "not_in"):
        hit = reduce(lambda a, b: a | b, [_same(c, x) for x in listed(v)], no)
        return hit if op == "in" else ~hit
    if op == "contains":
        return F.coalesce(F.exists(c, lambda x: _same(x, v)), no) if is_list else F.coalesce(c, F.lit("")).contains(str(v))
    if op == "icontains":
        return F.coalesce(F.exists(c, lambda x: _folded(x) == str(v).strip().lower()), no) if is_list else F.lower(F.coalesce(c, F.lit(""))).contains(str(v).lower())
    if op == "starts_with":
        return F.lower(F.coalesce(c, F.lit(""))).startswith(str(v).lower())
    if op == "matches":
        return F.coalesce(c, F.lit("")).rlike(f"(?iu){v}")
    if op in ("exists", "empty"):
        want = _empty(c, kind) if op == "empty" else ~_empty(c, kind)
        return want if v in (None, True) else ~want
    if op == "within":
        return F.coalesce((_number(c) >= v[0]) & (_number(c) < v[1]), no)
    if op in ("before", "gt", "after", "lt", "gte", "lte"):
        n = _number(c)
        return F.coalesce({"before": n < v, "lt": n < v, "after": n > v, "gt": n > v, "gte": n >= v, "lte": n <= v}[op], no)
    raise UnknownFilter(f"no test {op!r}")


def where(df: DataFrame, tests: list[tuple[str, str, Any]], mode: str = "all") -> DataFrame:
    """Rows that pass all, or any, of (path, test, value)."""
    kinds = dict(df.dtypes)
    parts = [test(F.col(p), kinds.get(p, "string"), op, v) for p, op, v in tests]
    if not parts:
        return df
    return df.where(reduce((lambda a, b: a & b) if mode == "all" else (lambda a, b: a | b), parts))


def kept_ratio(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: count, dropped and the share that was kept, to three places."""
    n = before.agg(F.count("*").alias("n"))
    k = after.agg(F.count("*").alias("count"))
    return n.join(k, F.lit(True), "cross").select("count", (F.col("n") - F.col("count")).alias("dropped"), F.round(F.when(F.col("n") > 0, F.col("count") / F.col("n")).otherwise(0.0), 3).alias("kept_ratio"))


def ordered(df: DataFrame, by: str, descending: bool, tie: list[str]) -> DataFrame:
    """Nulls last when ascending, first when descending; ties by key."""
    c = F.col(by)
    return df.orderBy(c.desc_nulls_first() if descending else c.asc_nulls_last(), *tie)
