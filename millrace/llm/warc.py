"""A deterministic sharded WARC writer and its reader.

Records are range-partitioned by id into shards, whose bounds come from a sample chosen by a hash of the id, so
that the same table gives the same shards on any cluster. A task sorts its shards and writes gzip members, one a
record, rolling to the next file when the compressed size reaches a limit. Headers, block and payload digests are
made anew from the payload. Files are written under temporary names; the manifest holds only what successful tasks
report, and a second job renames exactly those files, which may be repeated without harm. The reader goes by the
manifest and checks every digest.

Of records with equal payloads of at least ``least_bytes`` bytes, the one with the smallest id is a response and
the others are revisits that refer to it. Which records are revisits is found from (id, digest) pairs alone; these
travel as marks in front of their records, so that payloads are shuffled once.

Defined cases: a null payload is empty; a null id sorts first and is a revisit if any record with an id has its
payload; rows that repeat an id and payload are alike; an empty table gives an empty archive. Other columns are
not read. Line breaks in a URL are percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, stored

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "shard int, seq int, temporary string, name string, records bigint, bytes bigint, sha256 string"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1 of a binary column, from five hexadecimal digits at a time."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(page, url: str | None, payload: bytes, refers_to) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    uri = (url or "urn:none").replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {uri}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{_digest(payload)}", f"WARC-Block-Digest: sha1:{_digest(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Files:
    """The files of one shard in turn."""

    def __init__(self, fs, root: str, shard: int, roll_bytes: int) -> None:
        self.fs, self.root, self.shard, self.roll = fs, root, shard, roll_bytes
        self.seq, self.out, self.done = 0, None, []

    def add(self, member: bytes) -> None:
        if self.out is None:
            self.temporary = f"{self.root}/_temporary/{self.shard:05d}-{self.seq:05d}-{uuid.uuid4().hex}"
            self.out, self.hash, self.records, self.size = self.fs.open_output_stream(self.temporary, compression=None), hashlib.sha256(), 0, 0
        self.out.write(member)
        self.hash.update(member)
        self.records += 1
        self.size += len(member)
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append({"shard": self.shard, "seq": self.seq, "temporary": self.temporary, "name": f"{self.root}/part-{self.shard:05d}-{self.seq:05d}.warc.gz", "records": self.records, "bytes": self.size, "sha256": self.hash.hexdigest()})
            self.out, self.seq = None, self.seq + 1


def _write(uri: str, roll_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as arrow_fs

        fs, root = arrow_fs.FileSystem.from_uri(uri)
        files, page, marks, done = None, object(), {}, []
        for batch in batches:
            shards, pages, kinds, urls, payloads, refers, digests = (batch.column(c) for c in ("shard", "page", "kind", "url", "payload", "refers_to", "digest"))
            for i in range(batch.num_rows):
                shard, this = shards[i].as_py(), pages[i].as_py()
                if files is None or files.shard != shard:
                    if files is not None:
                        files.close()
                        done += files.done
                    files, page = _Files(fs, root, shard, roll_bytes), object()
                if this != page:
                    page, marks = this, {}
                if kinds[i].as_py() == 0:
                    marks[digests[i].as_py()] = refers[i].as_py()
                    continue
                payload = payloads[i].as_py() or b""
                record = _record(this, urls[i].as_py(), payload, marks.get(_digest(payload)) if marks else None)
                gz = zlib.compressobj(level, zlib.DEFLATED, 31)
                files.add(gz.compress(record) + gz.flush())
        if files is not None:
            files.close()
            done += files.done
        yield pa.RecordBatch.from_pylist(done, pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("temporary", pa.string()), ("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    return run


def _commit(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as arrow_fs

        fs, _ = arrow_fs.FileSystem.from_uri(uri)
        for batch in batches:
            for r in batch.to_pylist():
                if fs.get_file_info(r["temporary"]).type != arrow_fs.FileType.NotFound:
                    fs.move(r["temporary"], r["name"])
                elif fs.get_file_info(r["name"]).size != r["bytes"]:
                    raise OSError(f"{r['name']} is neither temporary nor complete")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return run


def write_warc(records: DataFrame, *, uri: str | None = None, shard_bytes: int = 8 << 20, roll_bytes: int = 4 << 20, level: int = 6, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> tuple[str, DataFrame]:
    """Write an archive below ``uri`` (a scratch folder if none is given); returns the folder and the manifest.

    ``shard_bytes`` of uncompressed payload go to a shard, ``roll_bytes`` compressed to a file.
    """
    from pyarrow import fs as arrow_fs

    spark = records.sparkSession
    uri = uri or scratch(spark, "warc")
    fs, root = arrow_fs.FileSystem.from_uri(uri)
    fs.create_dir(f"{root}/_temporary", recursive=True)
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = records.select(F.col(id_col).cast("bigint").alias("page"), F.col(url_col).alias("url"), payload.alias("payload"))
    known = stored(rows.select("page", base32_sha1(F.col("payload")).alias("digest"), F.octet_length("payload").cast("bigint").alias("n")), "digests")
    firsts = known.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("copies")).where("copies > 1 AND first IS NOT NULL")
    marks = known.join(stored(firsts.select("digest", "first"), "firsts"), "digest").where("page IS NULL OR page > first")
    marks = stored(marks.groupBy("page", "digest").agg(F.first("first").alias("refers_to")), "marks")

    total = known.agg(F.count("*").alias("rows"), F.sum("n").alias("bytes")).first()
    shards = max(1, min(65_536, -(-(total["bytes"] or 0) // shard_bytes)))
    every = max(1, total["rows"] // (64 * shards + 1024))
    sample = sorted(r["page"] for r in known.where(F.pmod(F.xxhash64("page"), F.lit(every)) == 0).select("page").distinct().collect() if r["page"] is not None)
    bounds = sorted({sample[len(sample) * k // shards] for k in range(1, shards)}) if sample else []
    coarse = max(1, int(len(bounds) ** 0.5))
    block = F.array_size(F.filter(F.lit(bounds[coarse - 1 :: coarse]), lambda b: b <= F.col("page"))) if bounds else F.lit(0)
    rest = F.array_size(F.filter(F.slice(F.lit(bounds), block * coarse + 1, F.lit(coarse)), lambda b: b <= F.col("page"))) if bounds else F.lit(0)
    shard = F.coalesce(block * coarse + rest, F.lit(0)).cast("int")

    both = rows.select("page", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("bigint").alias("refers_to"), F.lit(None).cast("string").alias("digest")).unionByName(
        marks.select("page", F.lit(0).alias("kind"), "refers_to", "digest"), allowMissingColumns=True
    )
    dealt = both.withColumn("shard", shard).repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "page", "kind", "url", "payload")
    manifest = stored(dealt.mapInArrow(_write(uri, roll_bytes, level), _MANIFEST), "manifest")
    manifest.mapInArrow(_commit(uri), "n bigint").agg(F.sum("n")).collect()
    fs.delete_dir(f"{root}/_temporary")
    return uri, manifest


def _members(stream, piece: int = 1 << 20) -> Iterator[bytes]:
    """Each gzip member's content."""
    inflate, out, waiting = zlib.decompressobj(31), [], b""
    while data := waiting or stream.read(piece):
        out.append(inflate.decompress(data))
        waiting = b""
        if inflate.eof:
            yield b"".join(out)
            waiting, inflate, out = inflate.unused_data, zlib.decompressobj(31), []
    if out and any(out):
        raise OSError("a record is cut off")


def _read(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as arrow_fs

        fs, _ = arrow_fs.FileSystem.from_uri(uri)
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows = []
                with fs.open_input_stream(name, compression=None) as stream:
                    for record in _members(stream):
                        head, block = record.split(b"\r\n\r\n", 1)
                        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                        block = block[: int(fields["Content-Length"])]
                        http, payload = block.split(b"\r\n\r\n", 1)
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if fields["WARC-Block-Digest"] != f"sha1:{_digest(block)}" or (fields["WARC-Type"] == "response" and digest != _digest(payload)):
                            raise OSError(f"{fields['WARC-Record-ID']} in {name} does not fit its digest")
                        page, refers = (None if (x := fields.get(k, "none>").rpartition(":")[2].rstrip(">")) in ("None", "none") else int(x) for k in ("WARC-Record-ID", "WARC-Refers-To"))
                        length = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
                        rows.append({"page_id": page, "payload_bytes": length, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": refers, "url": fields["WARC-Target-URI"]})
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_warc(uri: str, manifest: DataFrame) -> DataFrame:
    """The records of the manifest's files, digests checked."""
    files = manifest.select("name")
    return files.repartition(max(1, files.count()), "name").mapInArrow(_read(uri), "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string")
