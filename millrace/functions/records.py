"""Records as columns: dotted paths, canonical JSON, redaction, storage mapping, schedule slots, summaries as text."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEP = re.compile(r"(\w+)|\[(\d+|\*)\]")


def at_path(path: str, root: Column | None = None) -> Column:
    """A dotted path such as ``a.b[0].c`` or ``a[*].b``; a star takes every element, a missing one gives null."""
    steps = [m[1] or (m[2] if m[2] == "*" else int(m[2])) for m in _STEP.finditer(path)]
    column = F.col(steps[0]) if root is None else root
    rest = steps[1:] if root is None else steps
    for i, step in enumerate(rest):
        if step == "*":
            tail = rest[i + 1 :]
            return F.transform(column, lambda x: _walk(x, tail)) if tail else column
        column = F.get(column, F.lit(step)) if isinstance(step, int) else column[step]
    return column


def _walk(column: Column, steps: list) -> Column:
    for i, step in enumerate(steps):
        if step == "*":
            return F.transform(column, lambda x: _walk(x, steps[i + 1 :]))  # noqa: B023
        column = F.get(column, F.lit(step)) if isinstance(step, int) else column[step]
    return column


def canonical_json(*columns: str) -> Column:
    """JSON with its keys in order and nulls written out: equal records are equal texts."""
    return F.to_json(F.struct(*[F.col(c).alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def smear_slot(salt: str, key: Column, slots: int = 900) -> Column:
    """The second of a quarter of an hour in which a key has its turn: even, and the same every time."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}:"), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint") % slots


def redacted(df: DataFrame, visible: list[str], lists: Mapping[str, int]) -> DataFrame:
    """Only ``visible`` columns, others as a count of what is hidden; of the arrays in ``lists`` the first few and how many more."""
    out = [F.col(c) for c in df.columns if c in visible and c not in lists]
    for c, n in lists.items():
        more = F.greatest(F.size(c) - n, F.lit(0))
        out.append(F.concat(F.slice(c, 1, n), F.when(more > 0, F.array(F.concat(F.lit("+"), more))).otherwise(F.array().cast("array<string>"))).alias(c))
    return df.select(*out, F.lit(len([c for c in df.columns if c not in visible and c not in lists])).alias("hidden"))


def stored_message(df: DataFrame, known: list[str], now: Column) -> DataFrame:
    """A message as it is stored: no null body or time, addresses lower-cased and each once, other columns as attributes."""
    fold = lambda c: F.array_distinct(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))))
    rules = {"body": F.coalesce("body", F.lit("")), "sent_at": F.coalesce("sent_at", now), "to_emails": fold("to_emails"), "from_email": F.lower(F.trim("from_email"))}
    others = [c for c in df.columns if c not in known]
    attributes = F.to_json(F.struct(*[F.col(c) for c in sorted(others)])) if others else F.lit("{}")
    return df.select(*[rules[c].alias(c) if c in rules else F.col(c) for c in known if c in df.columns], attributes.alias("attributes"))


def markdown_rows(df: DataFrame, by: str, line: Column, order: list[str], title: str) -> DataFrame:
    """One text a group: a title with the count, and a line each, in order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))), lambda x: F.concat(F.lit("- "), x["_line"]))
    return df.groupBy(by).agg(F.concat(F.lit(f"**{title}** ("), F.count("*"), F.lit(")\n"), F.array_join(lines, "\n")).alias("markdown"))
