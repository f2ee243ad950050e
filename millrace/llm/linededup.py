"""Line dedup across documents with two Bloom filters.

A line's key is the line stripped of ASCII white space at both ends with A-Z lower-cased. A first pass sets,
in a *once* filter, the bits of every key of every document, and in a *twice* filter the bits that a second
document sets too. Each task sends its filters as compressed slices; slices merge by an associative rule
(twice = twice | twice | once & once), so that no task and no merge holds more than its slice. A key whose bits
are not all in *twice* occurs in one document only: it never leaves its task again. Only the suspected repeats
shuffle, as 128-bit digests, for the exact count and the first document.

A filter has at least six bits for each line of the table, up to ``most_bits`` (256 MB), which is all that the driver
and each executor hold. With three hashes it is a third full then. Beyond some 350 million lines it fills up, and
from three times as many on most lines are suspected and shuffle as digests; the result stays exact.

Defined cases: ids are integers; a null or empty text is one empty line; keys shorter than ``min_chars`` code points
always stay; documents with the same id are one document; a null id, as which the largest long counts too, sorts
after all others; repeated rows give repeated results; an empty table gives an empty one. Other columns pass through
unread, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import stored, texts, tidy

_STRIP = b"\x20\x09\x0a\x0b\x0c\x0d"
_LAST = (1 << 63) - 1
_SLICE_BITS, _BITS_A_LINE = 1 << 21, 6
_KEYS = "array<struct<k1:bigint,k2:bigint>>"


def _digest(line: bytes, min_chars: int) -> bytes | None:
    key = line.strip(_STRIP)
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key.lower())


def _positions(digests: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    """``hashes`` filter positions of each digest (rows of two 64-bit values)."""
    a, b = digests[:, 0], digests[:, 1] | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) % np.uint64(bits) for i in range(hashes)])


def _bloom_slices(min_chars: int, bits: int, hashes: int, id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        gathered: list[np.ndarray] = []
        for batch in batches:
            found = bytearray()
            ids = batch.column(id_col).to_pylist()
            for doc, text in zip(ids, texts(batch, text_col), strict=True):
                for d in {d for line in text.encode().split(b"\n") if (d := _digest(line, min_chars))}:
                    found += d
                    found += (_LAST if doc is None else doc).to_bytes(8, "little", signed=True)
            gathered.append(np.frombuffer(bytes(found), np.uint64).reshape(-1, 3))
        rows = np.unique(np.concatenate(gathered), axis=0) if gathered else np.zeros((0, 3), np.uint64)
        if not len(rows):
            return
        at = np.sort(_positions(rows, bits, hashes).ravel())
        again = np.unique(at[1:][at[1:] == at[:-1]])
        at = np.unique(at)
        for k in range(-(-bits // _SLICE_BITS)):
            packed = []
            for x in (at, again):
                lo, hi = np.searchsorted(x, [k * _SLICE_BITS, (k + 1) * _SLICE_BITS])
                held = np.zeros(_SLICE_BITS, bool)
                held[(x[lo:hi] - np.uint64(k * _SLICE_BITS)).astype(np.int64)] = True
                packed.append(zlib.compress(np.packbits(held).tobytes(), 1))
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "salt": pa.array([part % 32], pa.int32()), "once": pa.array([packed[0]], pa.binary()), "twice": pa.array([packed[1]], pa.binary())})

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold the slices that reach this task, one at a time."""
    held: dict[tuple[int, int], list[np.ndarray]] = {}
    for batch in batches:
        for r in batch.to_pylist():
            once, twice = (np.frombuffer(zlib.decompress(r[k]), np.uint8) for k in ("once", "twice"))
            if (have := held.get(key := (r["slice"], r["salt"]))) is None:
                held[key] = [once.copy(), twice.copy()]
            else:
                have[1] |= twice | (have[0] & once)
                have[0] |= once
    for (k, salt), (once, twice) in held.items():
        yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "salt": pa.array([salt], pa.int32()), "once": pa.array([zlib.compress(once.tobytes(), 1)], pa.binary()), "twice": pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())})


def _suspects(min_chars: int, bits: int, hashes: int, twice, id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(twice.value, np.uint8)
        for batch in batches:
            found, docs, rks = bytearray(), [], []
            for doc, rk, text in zip(batch.column(id_col).to_pylist(), batch.column("rk").to_pylist(), texts(batch, text_col), strict=True):
                own = {d for line in text.encode().split(b"\n") if (d := _digest(line, min_chars))}
                found += b"".join(own)
                docs += [_LAST if doc is None else doc] * len(own)
                rks += [rk] * len(own)
            rows = np.frombuffer(bytes(found), np.uint64).reshape(-1, 2)
            at = _positions(rows, bits, hashes)
            hit = (bitmap[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1).all(axis=0)
            signed = rows.view(np.int64)[hit]
            yield pa.RecordBatch.from_pydict({"doc": pa.array(np.array(docs, np.int64)[hit]), "rk": pa.array(np.array(rks, np.int64)[hit]), "k1": pa.array(np.ascontiguousarray(signed[:, 0])), "k2": pa.array(np.ascontiguousarray(signed[:, 1]))})

    return run


def _apply(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, n_lines, n_dropped = [], [], []
            for text, drops in zip(texts(batch, "text"), batch.column("drops").to_pylist(), strict=True):
                lines = text.split("\n")
                n_lines.append(len(lines))
                if drops:
                    gone = {np.array([d["k1"], d["k2"]], np.int64).tobytes() for d in drops}
                    lines = [x for x in lines if _digest(x.encode(), min_chars) not in gone]
                    text = "\n".join(lines)
                n_dropped.append(n_lines[-1] - len(lines))
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=["row", "kept", "n_lines", "n_dropped"])

    return run


def dedup_lines(docs: DataFrame, *, min_chars: int = 10, bits: int | None = None, most_bits: int = 1 << 31, hashes: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (row, kept, n_lines, n_dropped): ``row`` holds all other columns of ``docs``, ``kept`` the text that stays.

    Lines whose key has ``min_chars`` code points and stands in at least two documents stay only in the one with
    the smallest id. ``bits``, by default from the number of lines up to ``most_bits``, and ``hashes`` shape the
    filters and change no result.
    """
    spark = docs.sparkSession
    narrow = docs.select(id_col, text_col)
    if bits is None:
        lines = narrow.agg(F.sum(F.coalesce(F.regexp_count(text_col, F.lit("\n")), F.lit(0)) + 1)).first()[0] or 0
        bits = min(most_bits, max(_SLICE_BITS, 1 << (_BITS_A_LINE * lines - 1).bit_length()))
    layout = "slice int, salt int, once binary, twice binary"
    parts = narrow.mapInArrow(tidy(_bloom_slices(min_chars, bits, hashes, id_col, text_col)), layout)
    merged = parts.repartition("slice", "salt").mapInArrow(tidy(_merge), layout).withColumn("salt", F.lit(0)).repartition("slice").mapInArrow(tidy(_merge), layout)
    bitmap = bytearray(-(-bits // 8))
    for r in merged.select("slice", "twice").collect():  # slices of 256 KB, ``bits`` in all
        begin = r["slice"] * _SLICE_BITS // 8
        bitmap[begin : begin + _SLICE_BITS // 8] = zlib.decompress(bytes(r["twice"]))[: len(bitmap) - begin]
    twice = spark.sparkContext.broadcast(bytes(bitmap))
    # rows are told apart by id and text, so that documents without an id have lists of their own
    rk = F.xxhash64(id_col, text_col).alias("rk")
    suspects = stored(narrow.select(id_col, text_col, rk).mapInArrow(tidy(_suspects(min_chars, bits, hashes, twice, id_col, text_col)), "doc bigint, rk bigint, k1 bigint, k2 bigint"), "suspects")
    first = stored(suspects.groupBy("k1", "k2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last"), "repeats")
    drops = suspects.join(first, ["k1", "k2"]).where("doc > first").groupBy("doc", "rk").agg(F.collect_set(F.struct("k1", "k2")).alias("drops"))
    others = [docs[f"`{c}`"] for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*others).alias("row"), F.col(text_col).alias("text"), F.coalesce(F.col(id_col), F.lit(_LAST)).alias("doc"), rk)
    marked = rows.join(stored(drops, "drops"), ["doc", "rk"], "left")
    schema = StructType([rows.schema["row"], *StructType.fromDDL("kept string, n_lines bigint, n_dropped bigint").fields])
    return marked.select("row", "text", "drops").mapInArrow(tidy(_apply(min_chars)), schema)
