"""A table of versions: data in folders that never change, and a log of manifests that says which of them count.

``root/_log`` has one file for each version, which names the base, the deltas behind it in order, and the last batch that each
stream has put in. A version is published by renaming a finished file to a name that nobody has taken; a writer that finds it
taken reads the new version and tries again on top of it. Data folders have names of their own, so that a failed or
repeated write is never seen. A reader takes one manifest and stays with it, whatever is committed meanwhile.

A stream is known by the id in its checkpoint, not by the checkpoint's place: where a checkpoint begins anew, its
batches are new ones too, even though their numbers begin at 0 again.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ledger import last_wins


class Conflict(RuntimeError):
    """A version that another writer has published first, so often that this one gives up."""


@dataclass(frozen=True)
class Manifest:
    version: int = -1
    base: str | None = None
    deltas: tuple[str, ...] = ()
    applied: dict[str, int] = field(default_factory=dict)
    buckets: dict[str, str] = field(default_factory=dict)  # of a table by key buckets: bucket to data folder

    def folders(self) -> set[str]:
        return {*self.deltas, *self.buckets.values(), *([self.base] if self.base else [])}


def _path(spark: SparkSession, where: str) -> Any:
    return spark._jvm.org.apache.hadoop.fs.Path(where)


def _fs(spark: SparkSession, where: str) -> Any:
    return _path(spark, where).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _name(version: int) -> str:
    return f"{version:020d}.json"


def versions(spark: SparkSession, root: str) -> list[int]:
    """The versions whose manifests are there."""
    fs, log = _fs(spark, root), _path(spark, f"{root}/_log")
    names = [s.getPath().getName() for s in fs.listStatus(log)] if fs.exists(log) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, root: str, version: int | None = None) -> Manifest:
    """One version, the newest by default; an empty one where there is none."""
    if version is None:
        known = versions(spark, root)
        if not known:
            return Manifest()
        version = known[-1]
    fs = _fs(spark, root)
    stream = fs.open(_path(spark, f"{root}/_log/{_name(version)}"))
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Manifest(**json.loads(text) | {"deltas": tuple(json.loads(text)["deltas"])})


def _publish(spark: SparkSession, root: str, new: Manifest) -> bool:
    """Whether the version was free and is now this one."""
    fs, jvm = _fs(spark, root), spark._jvm
    tmp, to = _path(spark, f"{root}/_log/.{uuid.uuid4().hex}.tmp"), _path(spark, f"{root}/_log/{_name(new.version)}")
    out = fs.create(tmp, False)
    try:
        out.write(json.dumps(asdict(new)).encode())
    finally:
        out.close()
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsparkSession.sessionState().newHadoopConf())
    try:
        context.rename(fs.makeQualified(tmp), fs.makeQualified(to), none)  # fails where the name is taken
    except Exception as error:  # noqa: BLE001 - whatever the file system says, the name decides
        fs.delete(tmp, False)
        if "FileAlreadyExists" in str(error):
            return False
        raise
    return True


def commit(spark: SparkSession, root: str, change: Callable[[Manifest], Manifest | None], tries: int = 20) -> Manifest:
    """Publish what ``change`` makes of the newest version; None leaves that as it is. ``change`` may be asked again."""
    for _ in range(tries):
        now = manifest(spark, root)
        new = change(now)
        if new is None:
            return now
        new = replace(new, version=now.version + 1)
        if _publish(spark, root, new):
            return new
    raise Conflict(f"version {now.version + 1} of {root} was taken {tries} times")


def write_data(df: DataFrame, root: str) -> str:
    """A new data folder with the rows; nobody sees it until a manifest names it."""
    name = uuid.uuid4().hex
    df.write.parquet(f"{root}/data/{name}")
    return name


def read(spark: SparkSession, root: str, key: list[str], schema: str, at: Manifest | None = None) -> DataFrame:
    """The table of a version: the last of each key among base and deltas, without what was deleted."""
    at = at or manifest(spark, root)
    columns = StructType.fromDDL(schema).names
    folders = [*([at.base] if at.base else []), *at.deltas]
    if not folders:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, _gone boolean").parquet(*[f"{root}/data/{x}" for x in folders])
    place = F.create_map(*[F.lit(x) for k, name in enumerate(folders) for x in (name, k)])
    rows = rows.withColumn("_place", place[F.element_at(F.split("_metadata.file_path", "/"), -2)])
    return last_wins(rows, key, "_place").where(~F.coalesce("_gone", F.lit(False))).select(*columns)


def add_delta(spark: SparkSession, root: str, delta: DataFrame, stream: str | None = None, batch: int | None = None) -> Manifest:
    """Append a delta (rows with ``_gone``) as one version; a batch that a stream has put in before changes nothing."""
    done = lambda m: stream is not None and m.applied.get(stream, -1) >= batch
    if done(now := manifest(spark, root)):
        return now
    name = write_data(delta, root)
    applied = lambda m: m.applied | ({stream: batch} if stream is not None else {})
    return commit(spark, root, lambda m: None if done(m) else replace(m, deltas=(*m.deltas, name), applied=applied(m)))


def replace_base(spark: SparkSession, root: str, build: Callable[[Manifest], DataFrame], tries: int = 5) -> Manifest:
    """A new base made from one version; deltas that came meanwhile stay behind it, another base begins it anew."""
    for _ in range(tries):
        start = manifest(spark, root)
        name = write_data(build(start).withColumn("_gone", F.lit(False)), root)
        new = commit(spark, root, lambda m: replace(m, base=name, deltas=tuple(x for x in m.deltas if x not in start.deltas)) if m.base == start.base else None)
        if new.base == name:
            return new
    raise Conflict(f"the base of {root} was replaced {tries} times meanwhile")


def expire(spark: SparkSession, root: str, keep: int = 10, least_age_s: float = 3600) -> int:
    """Forget all versions but the newest ``keep``, and data that none of them names; returns the number of folders deleted.

    A folder younger than ``least_age_s`` stays: it may be about to be named. Readers of forgotten versions must have ended.
    """
    fs, known = _fs(spark, root), versions(spark, root)
    named: set[str] = set()
    for v in known[-keep:]:
        named |= manifest(spark, root, v).folders()
    for v in known[:-keep]:
        fs.delete(_path(spark, f"{root}/_log/{_name(v)}"), False)
    before, gone = (time.time() - least_age_s) * 1000, 0
    data = _path(spark, f"{root}/data")
    for s in fs.listStatus(data) if fs.exists(data) else []:
        if s.getPath().getName() not in named and s.getModificationTime() <= before:
            fs.delete(s.getPath(), True)
            gone += 1
    return gone


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream's checkpoint has had since it began."""
    fs = _fs(spark, checkpoint)
    stream = fs.open(_path(spark, f"{checkpoint}/metadata"))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["id"]
    finally:
        stream.close()
