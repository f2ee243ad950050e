"""Half-open intervals in epoch microseconds: merging, gaps, overlap joins, free slots, nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE, DAY = 60_000_000, 86_400_000_000


def merge(df: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Rows (by, start, end) of the unions of touching or overlapping intervals; empty ones are dropped.

    Intervals are united within a key and day of their start first, so that one key with very many is shared out;
    what is left of each day then goes through one sorted pass a key.
    """
    rows = df.select(*by, F.col(start).alias("start"), F.col(end).alias("end")).where("end > start")
    daily = _united(rows.withColumn("_day", F.floor(F.col("start") / DAY)), [*by, "_day"]).drop("_day")
    return _united(daily, by)


def _united(rows: DataFrame, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", (before.isNull() | (F.col("start") > before)).cast("int"))
    rows = rows.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def gaps(merged: DataFrame, by: list[str], least: int = 15 * MINUTE) -> DataFrame:
    """Free time between merged intervals of a key, of ``least`` length at least."""
    before = F.lag("end").over(Window.partitionBy(*by).orderBy("start"))
    return merged.select(*by, before.alias("free_from"), F.col("start").alias("free_until")).where(F.col("free_until") - F.col("free_from") >= least)


def _days(start: Column, end: Column, width: int) -> Column:
    """Numbers of the buckets that an interval touches."""
    return F.explode(F.sequence(F.floor(start / width), F.floor((F.greatest(start, end - 1)) / width)))


def overlap_join(a: DataFrame, b: DataFrame, on: list[str], width: int = DAY) -> DataFrame:
    """Pairs of rows of ``a`` (start, end, ...) and ``b`` (b_start, b_end, ...) that overlap and agree on ``on``.

    Both sides are dealt to time buckets, joined by key and bucket, and a pair is kept only in the later of the
    first buckets, so that it comes once. A long interval costs a row for each bucket that it touches.
    """
    x = a.withColumn("_bucket", _days(F.col("start"), F.col("end"), width))
    y = b.withColumn("_bucket", _days(F.col("b_start"), F.col("b_end"), width))
    pairs = x.join(y, [*on, "_bucket"]).where((F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end")))
    return pairs.where(F.col("_bucket") == F.floor(F.greatest("start", "b_start") / width)).drop("_bucket")


def overlap_minutes() -> Column:
    return F.floor((F.least("end", "b_end") - F.greatest("start", "b_start")) / MINUTE)


def working_spans(df: DataFrame, by: list[str], first_day: int, days: int, start_hour: int = 9, end_hour: int = 17, weekdays: bool = True, zone: str = "UTC", window: tuple[int, int] | None = None) -> DataFrame:
    """A span of working hours for each key and day of a zone from the day of ``first_day`` (microseconds) on.

    Hours are wall times, so that spans stay where the clocks change; ``window`` clips them, and empty ones go.
    """
    first = F.to_date(F.from_utc_timestamp(F.timestamp_micros(F.lit(first_day)), zone))
    spans = df.select(*by).distinct().withColumn("day", F.explode(F.sequence(first, F.date_add(first, days - 1))))
    if weekdays:
        spans = spans.where(F.weekday("day") < 5)
    wall = lambda hour: F.unix_micros(F.to_utc_timestamp(F.col("day").cast("timestamp") + F.expr(f"INTERVAL {hour} HOURS"), zone))
    a, b = wall(start_hour), wall(end_hour)
    if window:
        a, b = F.greatest(a, F.lit(window[0])), F.least(b, F.lit(window[1]))
    return spans.select(*by, a.alias("span_from"), b.alias("span_until")).where("span_from < span_until")


def free_slots(busy: DataFrame, by: list[str], first_day: int, days: int, need: int = 30 * MINUTE, buffer: int = 0, **hours: object) -> DataFrame:
    """Free parts of the working spans, ``need`` long at least: what merged busy time leaves of each span."""
    spans = working_spans(busy, by, first_day, days, **hours)
    taken = merge(busy.select(*by, (F.col("start") - buffer).alias("start"), (F.col("end") + buffer).alias("end")), by)
    inside = overlap_join(spans.select(*by, F.col("span_from").alias("start"), F.col("span_until").alias("end")), taken.select(*by, F.col("start").alias("b_start"), F.col("end").alias("b_end")), by)
    parts = inside.select(*by, F.col("start").alias("span_from"), F.col("end").alias("span_until"), F.greatest("start", "b_start").alias("from"), F.least("end", "b_end").alias("until"))
    edges = spans.select(*by, "span_from", "span_until", F.col("span_from").alias("from"), F.col("span_from").alias("until")).unionByName(spans.select(*by, "span_from", "span_until", F.col("span_until").alias("from"), F.col("span_until").alias("until")))
    w = Window.partitionBy(*by, "span_from").orderBy("from", "until")
    free = parts.unionByName(edges).withColumn("next", F.lead("from").over(w))
    return free.where(F.col("next") - F.col("until") >= need).select(*by, F.col("until").alias("free_from"), F.col("next").alias("free_until"))


def nearest(pins: DataFrame, others: DataFrame, on: list[str], within: int) -> DataFrame:
    """For each pin (pin, pin_at) the nearest of ``others`` (other, other_at) within a distance; ties by number.

    Candidates meet in time buckets as wide as the distance, so that each pin sees three buckets at most.
    """
    x = pins.withColumn("_bucket", F.explode(F.array(*[F.floor(F.col("pin_at") / within) + k for k in (-1, 0, 1)])))
    y = others.withColumn("_bucket", F.floor(F.col("other_at") / within))
    apart = F.abs(F.col("pin_at") - F.col("other_at"))
    pairs = x.join(y, [*on, "_bucket"]).withColumn("apart", apart).where(F.col("apart") <= within)
    return pairs.groupBy("pin").agg(F.min(F.struct("apart", "other")).alias("n")).select("pin", "n.other", "n.apart")


def matched(events: DataFrame, key: str, start: str, pinned: int, within: int = 2 * DAY, close: int = 15 * MINUTE) -> DataFrame:
    """One row: the entry nearest to a pinned time, and whether it is the only one, or another is nearly as near."""
    near = events.select(F.col(key).alias("key"), F.abs(F.col(start) - pinned).alias("apart")).where(F.col("apart") <= within).orderBy("apart", "key").limit(2)
    two = near.agg(F.array_sort(F.collect_list(F.struct("apart", "key"))).alias("two"))  # two rows at most
    gap = F.try_element_at("two", F.lit(2))["apart"] - F.try_element_at("two", F.lit(1))["apart"]
    verdict = F.when(F.size("two") == 0, "absent").when(gap < close, "ambiguous").otherwise("confident")
    return two.select(F.try_element_at("two", F.lit(1))["key"].alias(key), verdict.alias("verdict"))


def template_slots(events: DataFrame, calendar: str, first_day: int, days: int, zone: str = "UTC") -> DataFrame:
    """Free half hours or more from 9 to 18, Monday to Friday: entries without an end last 30 minutes, all-day ones do not count."""
    busy = events.where("NOT all_day").select(F.col(calendar).alias("who"), F.col("starts_us").alias("start"), F.coalesce("ends_us", F.col("starts_us") + 30 * MINUTE).alias("end"))
    return free_slots(busy, ["who"], first_day, days, 30 * MINUTE, start_hour=9, end_hour=18, zone=zone)


def shaped(events: DataFrame) -> DataFrame:
    """Entries with their duration in words and the number of attendees."""
    m = F.floor((F.col("ends_us") - F.col("starts_us")) / MINUTE)
    text = F.when(F.col("all_day"), "all day").when(m >= 60, F.concat(F.floor(m / 60), F.lit(" h"), F.when(m % 60 > 0, F.concat(F.lit(" "), m % 60, F.lit(" min"))).otherwise(""))).otherwise(F.concat(m, F.lit(" min")))
    return events.withColumn("duration", text).withColumn("attendees", F.size("attendee_emails"))
