"""Media columns: content-defined chunks, deduplicated by digest, and ordered lists that rebuild the media.

A payload is stored as a binary PGM image, 24 samples of 8 bits a row. The stored bytes are cut where a rolling
gear hash (the last 32 bytes decide) has its low bits all zero, between a least and a greatest chunk size. Chunks
travel compressed to one row for each digest and rest in files bucketed by digest; each document keeps the
ordered list of its digests. Reading joins the lists with the chunks, of which only the lists move, brings each
document's chunks together in order, joins them and checks the whole against its digest. Chunks that hold a
thousandth of all list entries or more, of which there are a thousand at most, are broadcast to the lists instead,
so that a chunk that very many documents share falls to no single task.

Defined cases: a null or empty text is a payload of padding alone; equal texts give equal values; rows that repeat
an id and text are rebuilt once and returned as often as they occur, those with a null id too; an empty table gives
an empty result. Other columns are not read.
"""

from __future__ import annotations

import bz2
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _shuffles_go_when_written, scratch, stored, texts, tidy

_WIDTH, _UNIT = 24, 576
_GEAR = np.random.default_rng(31).integers(0, 1 << 32, 256, dtype=np.uint32)


def image(text: str) -> bytes:
    """The stored form: text in UTF-8, padded with 255 to a positive multiple of 576 samples."""
    data = text.encode()
    data += b"\xff" * (_UNIT - len(data) if not data else -len(data) % _UNIT)
    return b"P5\n%d %d\n255\n" % (_WIDTH, len(data) // _WIDTH) + data


def samples(media: bytes) -> bytes:
    """The payload of a stored image."""
    kind, size, most, data = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P5" or most != b"255" or len(data) != width * height:
        raise ValueError("not an 8-bit PGM image")
    return data


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Rolling hash at every byte: the sum of the last 32 bytes' gears, each shifted by its distance."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        later = h[k:] + (h[:-k] << np.uint32(k))
        h = np.concatenate([h[:k], later])
    return h


def cuts(many: list[bytes], least: int, bits: int, most: int) -> list[list[int]]:
    """Chunk ends of each of the byte strings."""
    data = np.frombuffer(b"".join(many), np.uint8)
    marks = np.flatnonzero((gear_hashes(data) & np.uint32(((1 << bits) - 1) << (32 - bits))) == 0) + 1 if len(data) else np.zeros(0, np.int64)
    out, base = [], 0
    for x in many:
        ends, at, stop = [], 0, len(x)
        own = marks[np.searchsorted(marks, base) : np.searchsorted(marks, base + stop)] - base
        while stop - at > least:
            k = np.searchsorted(own, at + least)
            end = min(int(own[k]) if k < len(own) else stop, at + most, stop)
            ends.append(end)
            at = end
        if at < stop or not ends:
            ends.append(stop)
        out.append(ends)
        base += stop
    return out


def _chunked(batch: pa.RecordBatch, text_col: str, shape: tuple[int, int, int]) -> Iterator[tuple[int, bytes, list[int]]]:
    held, group, first = 0, [], 0
    own = texts(batch, text_col)
    for i, text in enumerate(own):
        group.append(image(text))
        held += len(group[-1])
        if held > 2 << 20 or i == len(own) - 1:
            for k, (x, ends) in enumerate(zip(group, cuts(group, *shape), strict=True)):
                yield first + k, x, ends
            group, held, first = [], 0, i + 1


def _chunks(text_col: str, shape: tuple[int, int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, bytes] = {}
            held = 0
            for _, media, ends in _chunked(batch, text_col, shape):
                for a, b in zip([0, *ends[:-1]], ends, strict=True):
                    digest = xxhash.xxh3_128_digest(media[a:b])
                    if digest not in found:
                        found[digest] = bz2.compress(media[a:b])
                        held += len(found[digest])
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pydict({"digest": pa.array(found, pa.binary()), "data": pa.array(found.values(), pa.binary())})
                    found, held = {}, 0
            yield pa.RecordBatch.from_pydict({"digest": pa.array(found, pa.binary()), "data": pa.array(found.values(), pa.binary())})

    return run


def _lists(id_col: str, text_col: str, shape: tuple[int, int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, whole, place, digest = [], [], [], []
            for i, media, ends in _chunked(batch, text_col, shape):
                own = xxhash.xxh3_128_digest(media)
                for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                    rows.append(i)
                    whole.append(own)
                    place.append(k)
                    digest.append(xxhash.xxh3_128_digest(media[a:b]))
            yield pa.RecordBatch.from_pydict({"doc": batch.column(id_col).take(pa.array(rows, pa.int64())), "whole": pa.array(whole, pa.binary()), "place": pa.array(place, pa.int32()), "digest": pa.array(digest, pa.binary())})

    return run


def feature(payload: np.ndarray) -> str:
    """Eight counts by the samples' high bits, their sum, and the number of rises."""
    counts = np.bincount(payload >> 5, minlength=8)
    return ",".join(map(str, [*counts.tolist(), int(payload.sum(dtype=np.int64)), int((payload[1:] > payload[:-1]).sum())]))


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by document, digest of the whole and place: one result for each row that the chunks came from."""

    def finish() -> None:
        if key is None:
            return
        media = b"".join(parts)
        if xxhash.xxh3_128_digest(media) != key[1]:
            raise ValueError(f"the chunks of {key[0]} do not rebuild its media")
        payload = samples(media)
        row = {
            "doc": key[0], "n_bytes": len(payload.rstrip(b"\xff")), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]),
            "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature(np.frombuffer(payload, np.uint8)),
        }
        out.extend([row] * copies)

    schema = None
    key, parts, copies, out = None, [], 0, []
    for batch in batches:
        schema = pa.schema([("doc", batch.schema.field("doc").type), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
        for doc, whole, times, data in zip(*(batch.column(c).to_pylist() for c in ("doc", "whole", "times", "data")), strict=True):
            if (doc, whole) != key:
                finish()
                key, parts, copies = (doc, whole), [], times
            parts.append(bz2.decompress(data))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    finish()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def store_and_read(docs: DataFrame, *, least: int = 1024, bits: int = 12, most: int = 32768, hot_entries: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as chunked media and read it back: rows (doc, n_bytes, payload_..., media_..., feature).

    Chunks have ``least`` to ``most`` bytes and about 2 ** ``bits`` more than the least on average. Chunks with at
    least ``hot_entries`` list entries and a thousandth of all are broadcast: 1,000 times ``most`` bytes at the most.
    """
    spark, shape = docs.sparkSession, (least, bits, most)
    narrow = docs.select(id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    stored_chunks = _bucketed(narrow.mapInArrow(tidy(_chunks(text_col, shape)), "digest binary, data binary"))
    lists = narrow.mapInArrow(tidy(_lists(id_col, text_col, shape)), f"doc {kind}, whole binary, place int, digest binary")
    lists = stored(lists.groupBy("doc", "whole", "place", "digest").agg(F.count("*").alias("times")), "lists")
    share = lists.groupBy("digest").agg(F.count("*").alias("n"))
    hot = [r["digest"] for r in share.where(F.col("n") >= F.lit(max(hot_entries, lists.count() // 1000))).select("digest").collect()]  # 1,000 at most
    in_order = ["doc", "whole", "place", "times", "data"]
    parts = lists.where(~F.col("digest").isin(hot)).join(stored_chunks.hint("merge"), "digest").select(in_order)
    if hot:
        few = stored_chunks.where(F.col("digest").isin(hot))
        parts = parts.unionByName(lists.where(F.col("digest").isin(hot)).join(F.broadcast(few), "digest").select(in_order))
    ordered = parts.repartition("doc", "whole").sortWithinPartitions("doc", "whole", "place")
    return ordered.select("doc", "whole", "times", "data").mapInArrow(tidy(_rebuild), f"doc {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def _bucketed(chunks: DataFrame) -> DataFrame:
    """One row for each digest, in files bucketed and sorted by digest; the catalogue keeps no entry of them."""
    spark = chunks.sparkSession
    name, path = f"millrace_chunks_{uuid.uuid4().hex}", scratch(spark, "chunks")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _shuffles_go_when_written(spark):
        distinct = chunks.groupBy("digest").agg(F.first("data").alias("data"))
        distinct.write.option("compression", "none").option("path", path).bucketBy(buckets, "digest").sortBy("digest").saveAsTable(name)
    out = spark.table(name)
    out.schema  # noqa: B018  resolved now, as the entry goes; the files stay
    spark.sql(f"DROP TABLE {name}")
    return out
