"""Helpers shared by the corpus operators: scratch tables, shipping the package, table reading."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_CLEANUP = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.shuffleDependency.fileCleanup.enabled")
_OWN_ROOT: dict[str, str] = {}
_SHIPPED: set[str] = set()


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below ``spark.checkpoint.dir``; where that is unset, below an own folder if all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        root = _OWN_ROOT.setdefault(app, "file://" + tempfile.mkdtemp(prefix="millrace-"))
    return f"{root.rstrip('/')}/millrace-{label}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside the block and are as before behind it."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _shuffles_go_when_written(spark: SparkSession):
    """While a scratch table is written, its shuffle files are dropped as soon as the write ends."""
    return settings(spark, dict.fromkeys(_CLEANUP, "true"))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a scratch Parquet table and read it again: lineage ends in files every executor can reach."""
    spark = df.sparkSession
    path = scratch(spark, label)
    with _shuffles_go_when_written(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more: what was made from them has been written."""
    for t in tables:
        if path := getattr(t, "scratch_path", None):
            jvm = t.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package as a zip, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        name = os.path.basename(top)
        path = os.path.join(tempfile.mkdtemp(prefix="millrace-zip-"), f"{name}.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, files in os.walk(top):
                for f in sorted(files):
                    if f.endswith(".py"):
                        full = os.path.join(folder, f)
                        z.write(full, os.path.join(name, os.path.relpath(full, top)))
        spark.sparkContext.addPyFile(path)
        _SHIPPED.add(app)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str | pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts together hold about ``most_bytes``: bounds what numpy needs at a time."""
    import pyarrow.compute as pc

    texts = batch.column(column) if isinstance(column, str) else column
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most_bytes:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield begin, len(sizes)


def pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each hold about a megabyte."""
    for batch in batches:
        for a, b in slices(batch, column):
            yield batch.slice(a, b - a)


#: What this Python worker keeps from one task to the next of the same operator, by kind and key.
_KEPT: dict[str, dict[str, Any]] = {}


def kept(kind: str, key: str, make: Callable[[], Any]) -> Any:
    """An object that later tasks of the same kind in this worker find again; tasks of another kind drop it."""
    own = _KEPT.setdefault(kind, {})
    if key not in own:
        own[key] = make()
    return own[key]


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _drop_others(kind: str) -> None:
    if others := _KEPT.keys() - {kind}:
        for other in others:
            del _KEPT[other]
        gc.collect()
        _give_back()


def tidy(run: Callable[[Iterator], Iterator], kind: str = "") -> Callable[[Iterator], Iterator]:
    """A batch function for workers that live on: it begins by dropping what tasks of other kinds have kept, and
    gives freed memory back to the system when its task ends."""

    def wrapped(batches: Iterator) -> Iterator:
        _drop_others(kind)
        try:
            yield from run(batches)
        finally:
            _give_back()

    return wrapped


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]
