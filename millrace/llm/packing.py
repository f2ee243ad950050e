"""Best-fit packing of tokenised documents into sequences of a fixed length, planned over a histogram of lengths.

Documents become pieces: the ids of the whole text with an end id, cut from the end into pieces of the full length,
so that only the first piece may be shorter. What is planned is not pieces but their lengths: a histogram has at most
``capacity`` entries, whatever the corpus. Best fit in decreasing order runs over its counts: sequences that hold the
same lengths form one group with a number, and a length with its count is given to whole groups at once, the group
with the least sufficient room first. A sequence that a length enters is left with less than half of its room, so a
group is entered at most log2(capacity) times, and a length makes at most two new groups: the plan has a few thousand
lines at most, and it alone is broadcast.

A line of the plan says where the pieces of one length with ranks from .. upto go. Ranks within a length come in two
levels: the pieces are written to a scratch table, a block is 65,536 neighbouring rows of one of its files, counts by
block and length are summed up over the blocks, and within a block rows are numbered by their place in the file. So a
length that a third of all pieces have is ranked in as many tasks as it has blocks, and the ranks are the same when a
task runs again.

Ids come from the library: a pre-token is encoded by its model when it is first met and remembered in two generations; documents
whose id ``audit_every`` divides are encoded as a whole by the library too, and a difference fails the job.

Defined cases: a null or empty text is its end id alone; repeated rows and repeated or null ids are packed row by row;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, slices, stored, texts, tidy

#: Pre-tokens of each of the two generations that a worker remembers; rows of a block, within which ranks are counted.
GENERATION, BLOCK = 400_000, 1 << 16


def _class_of(pattern: str, upto: int) -> str:
    """The members of a Unicode property below ``upto`` as ranges for a character class of ``re``."""
    import regex

    every = "".join(chr(i) if not 0xD800 <= i < 0xE000 else "\x01" for i in range(upto))
    spans = [m.span() for m in regex.finditer(f"{pattern}+", every)]
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in spans)


def pre_token_pattern(upto: int = sys.maxunicode + 1) -> re.Pattern[str]:
    """Pre-tokens of byte-level vocabularies in texts of characters below ``upto``, by Unicode properties."""
    letter, number, space = (_class_of(p, upto) for p in (r"\p{L}", r"\p{N}", r"\s"))
    rest = f"[^{space}{letter}{number}]"
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?{rest}+|[{space}]+(?![^{space}])|[{space}]+")


class Ids:
    """Token ids as little-endian 32-bit numbers, pre-token by pre-token."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        special = {t.content: np.uint32(i).tobytes() for i, t in self.library.get_added_tokens_decoder().items()}
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies show as they are
        self.shown = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.find_any, self.find_latin = pre_token_pattern().findall, pre_token_pattern(256).findall
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def recall(self, wanted: set[str]) -> None:
        """Make the ids of the wanted pre-tokens known."""
        if len(self.young) > GENERATION:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        new = []
        for x in wanted:
            if x not in young:
                if (known := old.get(x)) is None:
                    new.append(x)
                else:
                    young[x] = known
        tokens, shown, special = self.library.model.tokenize, self.shown, self.special
        for x in new:
            if x in special:
                young[x] = special[x]
            else:
                young[x] = array("I", [t.id for t in tokens(x.encode().decode("latin-1").translate(shown))]).tobytes()

    def cut_apart(self, text: str) -> list[str]:
        """Pre-tokens and special strings, in order."""
        try:
            text.encode("latin-1")
            find = self.find_latin
        except UnicodeEncodeError:
            find = self.find_any
        if self.cut is None or not any(x in text for x in self.special):
            return find(text)
        return [x for k, part in enumerate(self.cut.split(text)) for x in ([part] if k % 2 else find(part))]

    def of_texts(self, many: list[str]) -> list[bytes]:
        """Ids of texts that are worked on together."""
        parts = [self.cut_apart(x) for x in many]
        self.recall(set(chain.from_iterable(parts)))
        known = self.young.__getitem__
        return [b"".join(map(known, x)) for x in parts]

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: full ones, but for the first where the length leaves a rest."""
    rest = n % capacity
    return ([rest] if rest else []) + [capacity] * (n // capacity)


def _pieces(path: str, end_id: int, capacity: int, audit_every: int, with_ids: bool, id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = kept("packing", path, lambda: Ids(path))
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            docs = batch.column(id_col)
            owner, piece, start, length, crc, content = [], [], [], [], [], []
            own = texts(batch, text_col)
            encoded = chain.from_iterable(ids.of_texts(own[a:b]) for a, b in slices(batch, text_col))
            for row, (doc, text, data) in enumerate(zip(docs.to_pylist(), own, encoded, strict=True)):
                if isinstance(doc, int) and doc % audit_every == 0 and data != ids.whole(text):
                    raise ValueError(f"the library encodes document {doc} otherwise")
                data += end
                at = 0
                for k, n in enumerate(cut_lengths(len(data) // 4, capacity)):
                    part = data[4 * at : 4 * (at + n)]
                    owner.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        content.append(np.frombuffer(part, "<i4"))
                    at += n
            out = {"doc": docs.take(pa.array(owner, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            if with_ids:
                out["ids"] = pa.array(content, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    return run


def token_pieces(docs: DataFrame, tokenizer: str, *, end_id: int = 2, capacity: int = 1024, audit_every: int = 64, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc, piece, start, length, ids_crc32), with ``with_ids`` also the ids, of every document's pieces.

    ``tokenizer`` is a file on every executor.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    run = _pieces(tokenizer, end_id, capacity, audit_every, with_ids, id_col, text_col)
    return docs.select(id_col, text_col).mapInArrow(tidy(run, "packing"), schema)


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best fit, longest first, over counts of lengths.

    Lines (length, from_rank, upto_rank, each, sequence, place): the piece of that length and rank goes into sequence
    ``sequence + (rank - from_rank) div each``, at ``place + ((rank - from_rank) mod each) * length``. The second value
    is the number of sequences.
    """
    by_room: dict[int, list[tuple[int, int]]] = {}  # room: groups (first sequence, number of sequences)
    rooms = np.zeros(capacity + 1, bool)
    lines, sequences = [], 0
    for n in sorted(histogram, reverse=True):
        if not 0 < n <= capacity:
            raise ValueError(f"a piece of length {n} does not fit into {capacity}")
        left, rank = histogram[n], 0
        while left:
            fits = np.flatnonzero(rooms[n:])
            room = int(fits[0]) + n if len(fits) else capacity
            each = room // n
            if len(fits):
                first, number = by_room[room].pop()
                if not by_room[room]:
                    rooms[room] = False
            else:
                first, number = sequences, -(-left // each)
                sequences += number
            full, rest = min(number, left // each), 0
            if full < number:
                rest = left - full * each
            parts = [(first, full, each), (first + full, 1 if rest else 0, rest), (first + full + bool(rest), number - full - bool(rest), 0)]
            for at, many, taken in parts:
                if not many:
                    continue
                if taken:
                    lines.append((n, rank, rank + many * taken, taken, at, capacity - room))
                    rank += many * taken
                    left -= many * taken
                if after := room - taken * n:
                    by_room.setdefault(after, []).append((at, many))
                    rooms[after] = True
    return lines, sequences


def pack(pieces: DataFrame, *, capacity: int = 1024) -> DataFrame:
    """The rows of ``pieces``, which has a column ``length`` of 1 to ``capacity``, with ``sequence_id`` and ``offset``.

    Sequences are as few as best fit, longest first, makes them. The columns ``sequence_id`` and ``offset`` are
    replaced where they exist.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    written = stored(pieces, "pieces")
    # at most ``capacity`` rows reach the driver
    histogram = {r.length: r.n for r in written.groupBy("length").agg(F.count("*").alias("n")).collect()}
    lines, _ = plan(histogram, capacity)
    lines = spark.createDataFrame(lines or [(0, 0, 0, 1, 0, 0)], "length bigint, from_rank bigint, upto_rank bigint, each bigint, sequence bigint, place bigint")
    file, index = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    rows = written.select(F.struct(*[F.col(f"`{c}`") for c in pieces.columns]).alias("row"), F.col("length").alias("n"), file.alias("file"), F.floor(index / BLOCK).alias("block"), index.alias("at"))
    counts = rows.groupBy("n", "file", "block").agg(F.count("*").alias("many"))
    before = F.sum("many").over(Window.partitionBy("n").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("n", "file", "block", F.coalesce(before, F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("n", "file", "block").orderBy("at")) - 1
    ranked = rows.withColumn("local", local).join(counts, ["n", "file", "block"]).withColumn("rank", F.col("local") + F.col("before"))
    # proven bound: lines of the plan are a few thousand whatever the input
    found = ranked.join(F.broadcast(lines), (F.col("n") == F.col("length")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("upto_rank")))
    step = F.col("rank") - F.col("from_rank")
    sequence = F.col("sequence") + F.floor(step / F.col("each"))
    return found.select("row.*", sequence.cast("long").alias("sequence_id"), (F.col("place") + step % F.col("each") * F.col("n")).alias("offset"))
