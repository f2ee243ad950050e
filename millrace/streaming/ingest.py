"""Change feeds: pages become upserts and deletes, applied once a batch to a table that only ever moves forward."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ledger import last_wins
from .versions import Manifest, add_delta, manifest, read, replace_base, stream_id


def changes(pages: DataFrame, key: list[str], order: str, deleted: str = "deleted") -> tuple[DataFrame, DataFrame]:
    """The last state of each changed key, and the keys that go; in a page a delete wins over any change."""
    gone = pages.where(F.col(deleted)).select(*key).distinct()
    kept = last_wins(pages.where(~F.col(deleted)).drop(deleted), key, order).join(gone, key, "left_anti")
    return kept, gone


def applied(target: DataFrame, kept: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """The table after a page: replaying a page changes nothing."""
    rest = target.join(kept.select(*key).unionByName(gone), key, "left_anti")
    return rest.unionByName(kept.select(target.columns))


def delta_sink(root: str, key: list[str], order: str, schema: str, checkpoint: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that commits what a batch changes, and nothing else, as one version.

    A batch that is run again changes nothing: its stream and number are in the manifest.
    """
    columns = StructType.fromDDL(schema).names

    def apply(batch: DataFrame, number: int) -> None:
        kept, gone = changes(batch, key, order)
        both = kept.select(*columns).withColumn("_gone", F.lit(False)).unionByName(gone.withColumn("_gone", F.lit(True)), allowMissingColumns=True)
        add_delta(batch.sparkSession, root, both, stream_id(batch.sparkSession, checkpoint), number)

    return apply


def current(spark: SparkSession, root: str, key: list[str], schema: str) -> DataFrame:
    """The table as it stands in the newest version; the frame stays with that version."""
    return read(spark, root, key, schema)


def compact(spark: SparkSession, root: str, key: list[str], schema: str) -> int:
    """A new base from base and deltas as one version, which is returned; -1 if there is nothing yet."""
    if manifest(spark, root).version < 0:
        return -1
    return replace_base(spark, root, lambda at: read(spark, root, key, schema, at)).version


def ingest(spark: SparkSession, feed: str, feed_schema: str, root: str, checkpoint: str, key: list[str], order: str, schema: str, files_a_batch: int = 1) -> int:
    """Work through what a feed folder holds, ``files_a_batch`` pages at a time, and stop; returns how many batches there were.

    Bounded pages make a backfill that goes on where it stopped.
    """
    stream = spark.readStream.schema(feed_schema).option("maxFilesPerTrigger", files_a_batch).json(feed)
    q = stream.writeStream.foreachBatch(delta_sink(root, key, order, schema, checkpoint)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    done = q.lastProgress
    return 0 if done is None else int(done["batchId"]) + 1


def resync(spark: SparkSession, snapshot: DataFrame, root: str, key: list[str], schema: str, time_col: str, since: Any) -> int:
    """When a feed's cursor is gone: a bounded snapshot replaces all rows from ``since`` on; older ones stay.

    The result is a new base in one version, which is returned. What any stream commits afterwards, with a new checkpoint
    or an old one, stands behind it.
    """

    def build(at: Manifest) -> DataFrame:
        older = read(spark, root, key, schema, at).where(F.col(time_col) < F.lit(since))
        fresh = snapshot.where(F.col(time_col) >= F.lit(since)).select(*older.columns)
        return older.join(fresh, key, "left_anti").unionByName(fresh)

    return replace_base(spark, root, build).version


def ordered_log(events: DataFrame, lateness: str = "15 minutes") -> DataFrame:
    """An event log without its duplicates: (run_id, seq) once, within the watermark."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["run_id", "seq"])


def replay(log: DataFrame, run_id: Any, after: int, most: int = 500) -> DataFrame:
    """A run's events behind ``after``, in order, each once, at most as many as a client may ask for at a time."""
    own = log.where((F.col("run_id") == run_id) & (F.col("seq") > after)).groupBy("run_id", "seq").agg(F.min_by(F.struct("type", "data"), "ts").alias("e"))
    return own.select("run_id", "seq", "e.*").orderBy("seq").limit(most)


def stuck(runs: DataFrame, now: Column, deadline_s: float, live: tuple[str, ...] = ("running", "waiting")) -> DataFrame:
    """Runs that are live though they began longer ago than three deadlines, and two minutes at least."""
    age = F.unix_micros(now) - F.unix_micros("started_at")
    return runs.where(F.col("status").isin(*live) & (age > int(max(3 * deadline_s, 120) * 1_000_000)))
