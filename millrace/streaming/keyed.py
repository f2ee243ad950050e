"""A table by key buckets: a merge reads and writes only the buckets that its rows fall into.

Rows lie in folders by the hash of their key. A merge finds the buckets of its source, reads those of the target, and
writes them anew; the manifest of the next version names the new folders for them and the old ones for the rest, whose
files are not touched. The target is never exchanged: while the source is small enough (its measured size decides)
it is broadcast to the target's rows, which stay where they are, and the rows that are new are what a second look at
the matched keys leaves over. A larger source is joined in full with the touched buckets, both sides exchanged by key, so
that skew is split as usual.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import Conflict, Manifest, commit, manifest, write_data

GONE = "_gone"
#: A source of more bytes, by the size of its written files times a factor for rows in memory, is not broadcast.
MOST_BYTES, UNPACKED = 64 << 20, 8


def bucket_of(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _write(df: DataFrame, root: str) -> str:
    """Rows with their column ``_bucket`` in a new data folder, a folder below it for each bucket."""
    name = uuid.uuid4().hex
    df.write.partitionBy("_bucket").parquet(f"{root}/data/{name}")
    return name


def create(df: DataFrame, root: str, key: list[str], buckets: int = 64) -> Manifest:
    """The first version of a table; each bucket's rows are sorted by key."""
    spark = df.sparkSession
    dealt = df.withColumn("_bucket", bucket_of(key, buckets)).repartitionByRange("_bucket", *key).sortWithinPartitions("_bucket", *key)
    name = _write(dealt, root)
    start = Manifest(buckets={str(b): name for b in range(buckets)})

    def first(now: Manifest) -> Manifest:
        if now.version >= 0:
            raise ValueError(f"{root} has versions already")
        return start

    return commit(spark, root, first)


def _rows(spark: SparkSession, root: str, at: Manifest, schema: str, touched: list[int] | None = None) -> DataFrame:
    """Rows of a version with their ``_bucket``, of all buckets or of some: other folders are not listed."""
    wanted = at.buckets if touched is None else {str(b): at.buckets[str(b)] for b in touched}
    parts = []
    for name in sorted(set(wanted.values())):
        own = [int(b) for b, x in wanted.items() if x == name]
        part = spark.read.schema(f"{schema}, _bucket int").parquet(f"{root}/data/{name}")
        parts.append(part.where(F.col("_bucket").isin(*sorted(own))))
    if not parts:
        return spark.createDataFrame([], f"{schema}, _bucket int")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def read(spark: SparkSession, root: str, schema: str, at: Manifest | None = None) -> DataFrame:
    return _rows(spark, root, at or manifest(spark, root), schema).drop("_bucket")


def _size(spark: SparkSession, root: str, name: str) -> int:
    """Bytes of a data folder's files, times ``UNPACKED``."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/data/{name}")
    fs = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return fs.getContentSummary(where).getLength() * UNPACKED


def merged(target: DataFrame, source: DataFrame, key: list[str], matched: dict[str, Column], small: bool) -> DataFrame:
    """Target rows after the merge. The source's columns are ``s_*``; a row with ``s__gone`` deletes.

    ``matched`` says what a column becomes where a key is in both, over the target's columns and the source's; other
    columns keep the target's value. With ``small`` the source is broadcast and the target stays where it is.
    """
    columns = [c for c in target.columns if c not in key]
    on = [F.col(k).eqNullSafe(F.col(f"s_{k}")) for k in key]
    s, gone = source.withColumn("s__here", F.lit(True)), F.coalesce("s__gone", F.lit(False))
    after = [F.when(F.col("s__here"), matched[c]).otherwise(F.col(c)) if c in matched else F.col(c) for c in columns]
    if small:
        old = target.join(F.broadcast(s), on, "left").where(~gone).select(*key, *[x.alias(c) for x, c in zip(after, columns, strict=True)])
        found = target.select(*key).join(F.broadcast(source.select(*[f"s_{k}" for k in key])), on, "left_semi")
        new = source.where(~gone).join(found, on, "left_anti")
        return old.unionByName(new.select(*[F.col(f"s_{c}").alias(c) for c in (*key, *columns)]))
    both = target.withColumn("_here", F.lit(True)).join(s, on, "full").where(~gone)
    values = [F.when(F.col("_here"), x).otherwise(F.col(f"s_{c}")).alias(c) for x, c in zip(after, columns, strict=True)]
    return both.select(*[F.when(F.col("_here"), F.col(k)).otherwise(F.col(f"s_{k}")).alias(k) for k in key], *values)


def merge(spark: SparkSession, root: str, source: DataFrame, key: list[str], schema: str, matched: Callable[[], dict[str, Column]] | None = None, tries: int = 5) -> Manifest:
    """Merge rows with different keys (and perhaps ``_gone``) as one version.

    ``matched()`` gives columns for keys in both, see ``merged``; by default the source's values. If another version comes
    first that changes one of the same buckets, the merge is made anew on top of it.
    """
    for _ in range(tries):
        start = manifest(spark, root)
        written = source if GONE in source.columns else source.withColumn(GONE, F.lit(False))
        names, kinds = written.columns, dict(written.dtypes)
        staged = write_data(written.select(*[F.col(c).alias(f"s_{c}") for c in names]), root)
        own = spark.read.schema(", ".join(f"`s_{c}` {kinds[c]}" for c in names)).parquet(f"{root}/data/{staged}")
        touched = sorted(r.b for r in own.select(bucket_of([f"s_{k}" for k in key], len(start.buckets)).alias("b")).distinct().collect())  # numbers of buckets
        if not touched:
            return start
        target = _rows(spark, root, start, schema, touched).drop("_bucket")
        rule = matched() if matched else {c: F.col(f"s_{c}") for c in target.columns if c not in key}
        out = merged(target, own, key, rule, _size(spark, root, staged) <= MOST_BYTES)
        name = _write(out.withColumn("_bucket", bucket_of(key, len(start.buckets))), root)
        same = lambda now: all(now.buckets[str(b)] == start.buckets[str(b)] for b in touched)
        new = commit(spark, root, lambda now: replace(now, buckets=now.buckets | {str(b): name for b in touched}) if same(now) else None)
        if new.buckets[str(touched[0])] == name:
            return new
    raise Conflict(f"buckets of {root} were changed {tries} times meanwhile")
