"""Long repeated byte strings by a logarithmic family of sparse suffix arrays.

Suffixes are sampled by content: of every ``width``-byte string, the position whose ``_CORE``-byte hash is smallest
is its sample, so that equal strings are sampled at equal places. A suffix is ordered by the hash of its core and
then by the digest of its context, which is all strings that are sampled at it; a suffix array is the table of a
batch's suffixes in that order, one row for equal suffixes with their number. A new batch's array is scanned
against all existing levels: suffixes with equal contexts are long matches as they stand, and cores with
different contexts are kept for refinement. Levels of equal rank then merge into the next, so that n batches
leave log n levels and each suffix is merged log n times.

Refinement compares one suffix of each different context: first the parts of 32 neighbouring strings (a part can
only hold a match if what its strings share occurs elsewhere), then single strings of parts that may match. Every
step groups by digests of 128 bits; no group is gathered, and texts travel twice, to the samples to refine and to
the results.

Defined cases: matches never cross documents; a null or empty text has no bytes; repeated rows are separate places,
so that their bytes from ``width`` on all go; documents with a null id take part like others; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .common import drop, slices, stored, tidy

_CORE, _PART, _PIECE = 32, 32, 1 << 22
_WORD_CORE = 12
_SUFFIX = "rk bigint, pos int, lo int, hi int, core bigint, c1 bigint, c2 bigint"
_CONTEXT = ["core", "c1", "c2"]


def _two(data: bytes, seed: int = 0) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(data, seed), np.int64).tolist())


def samples(data: np.ndarray, offsets: np.ndarray, width: int, core: int = _CORE, sums: Callable[[np.ndarray], np.ndarray] = B.prefix_sums) -> tuple[np.ndarray, ...]:
    """For each sample: text, position, first and last start of the strings sampled at it (all in ``data``), core.

    ``data`` are bytes, or with ``sums`` to match other values, such as the hashes of words.
    """
    found = []
    for begin in range(0, max(len(data) - width + 1, 0), _PIECE):
        part = data[begin : begin + _PIECE + width - 1]
        with np.errstate(over="ignore"):
            h = B.window_hash(sums(part), core)
        mask = np.uint64((1 << 23) - 1)
        least = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
        span, reach = width - core + 1, 1
        while reach * 2 <= span:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < span:
            least = np.minimum(least[: reach - span], least[span - reach :])
        at = (least & mask).astype(np.int64)
        start = np.arange(len(at)) + begin
        text = np.searchsorted(offsets, start, side="right") - 1
        whole = start + width <= offsets[text + 1]
        start, text, at = start[whole], text[whole], at[whole]
        if not len(start):
            continue
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)]))
        last = np.concatenate([new[1:], [len(start)]]) - 1
        found.append((text[new], at[new] + begin, start[new], start[last], h[at[new]].view(np.int64)))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _suffixes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch, "text"):
                data, offsets = B.joined(batch.column("text").slice(a, b - a))
                text, at, lo, hi, core = samples(data, offsets, width)
                view = memoryview(data.tobytes())
                digests = b"".join([xxhash.xxh3_128_digest(view[x : y + width]) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)])
                context = np.frombuffer(digests, np.int64).reshape(-1, 2)
                base = offsets[text]
                yield pa.RecordBatch.from_pydict({
                    "rk": batch.column("rk").slice(a, b - a).take(pa.array(text)), "pos": pa.array((at - base).astype(np.int32)), "lo": pa.array((lo - base).astype(np.int32)), "hi": pa.array((hi - base).astype(np.int32)),
                    "core": pa.array(core), "c1": pa.array(np.ascontiguousarray(context[:, 0])), "c2": pa.array(np.ascontiguousarray(context[:, 1])),
                })

    return run


class Levels:
    """The family of suffix arrays: at most one table of each rank."""

    def __init__(self) -> None:
        self.tables: dict[int, DataFrame] = {}
        self.matches: list[DataFrame] = []  # contexts (c1, c2) that occur more than once
        self.forks: list[DataFrame] = []  # cores with different contexts

    def insert(self, suffixes: DataFrame) -> None:
        """Sort a batch of suffixes, scan it against all levels, and merge levels of equal rank."""
        array = suffixes.groupBy(_CONTEXT).agg(F.count("*").alias("n"), F.min(F.struct("rk", "pos", "lo", "hi")).alias("r"))
        array = stored(array.select(*_CONTEXT, "n", "r.*").sortWithinPartitions(_CONTEXT), "suffixes")
        every = reduce(DataFrame.unionAll, [t.select(*_CONTEXT, "n", F.lit(False).alias("new")) for t in self.tables.values()], array.select(*_CONTEXT, "n", F.lit(True).alias("new")))
        scanned = every.groupBy(_CONTEXT).agg(F.sum("n").alias("n"), F.max("new").alias("new"))
        self.matches.append(stored(scanned.where("new AND n > 1").select("c1", "c2"), "matches"))
        context = F.struct("c1", "c2")
        forks = every.groupBy("core").agg(F.min(context).alias("x"), F.max(context).alias("y"), F.max("new").alias("new"))
        self.forks.append(stored(forks.where("new AND x < y").select("core"), "forks"))
        rank = 0
        while rank in self.tables:
            parts = array, self.tables.pop(rank)
            array, rank = self._merged(*parts), rank + 1
            drop(*parts)
        self.tables[rank] = array

    @staticmethod
    def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.unionAll(b).groupBy(_CONTEXT).agg(F.sum("n").alias("n"), F.min(F.struct("rk", "pos", "lo", "hi")).alias("r"))
        return stored(both.select(*_CONTEXT, "n", "r.*").sortWithinPartitions(_CONTEXT), "suffixes")

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionAll, self.tables.values())


def _contexts(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rk, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("rk", "text", "wanted")), strict=True):
                data = (text or "").encode()
                yield pa.RecordBatch.from_pydict({
                    "rk": pa.array([rk] * len(wanted), pa.int64()), "pos": pa.array([w["pos"] for w in wanted], pa.int32()), "lo": pa.array([w["lo"] for w in wanted], pa.int32()), "hi": pa.array([w["hi"] for w in wanted], pa.int32()),
                    "c1": pa.array([w["c1"] for w in wanted], pa.int64()), "n": pa.array([w["n"] for w in wanted], pa.int64()), "core": pa.array([w["core"] for w in wanted], pa.int64()), "data": pa.array([data[w["lo"] : w["hi"] + width] for w in wanted], pa.binary()),
                })

    return run


def _parts(width: int):
    """Parts of a context: by distance from the sample in steps of ``_PART`` starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("rk", "pos", "lo", "c1", "n", "first", "last", "inner", "o1", "o2")}
            for rk, pos, lo, hi, c1, n, core, data in zip(*(batch.column(c).to_pylist() for c in ("rk", "pos", "lo", "hi", "c1", "n", "core", "data")), strict=True):
                for j in range((pos - hi) // _PART, (pos - lo) // _PART + 1):
                    first, last = max(lo, pos - j * _PART - _PART + 1), min(hi, pos - j * _PART)
                    # what all strings of a full part share; any string of the part holds it, so it lies in the context
                    begin, end = pos - j * _PART, pos - j * _PART - _PART + 1 + width
                    out["inner"].append(_two(data[begin - lo : end - lo] + core.to_bytes(8, "little", signed=True), 7 + j)[0])
                    o1, o2 = _two(data[first - lo : last + width - lo], 1)
                    for k, v in (("rk", rk), ("pos", pos), ("lo", lo), ("c1", c1), ("n", n), ("first", first), ("last", last), ("o1", o1), ("o2", o2)):
                        out[k].append(v)
            kinds = {"pos": pa.int32(), "lo": pa.int32(), "first": pa.int32(), "last": pa.int32()}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    return run


def _strings(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rks, at, c1s, ns, digests = [], [], [], [], []
            for rk, lo, c1, n, data, ranges in zip(*(batch.column(c).to_pylist() for c in ("rk", "lo", "c1", "n", "data", "ranges")), strict=True):
                view = memoryview(data)
                for r in ranges:
                    for p in range(r["first"], r["last"] + 1):
                        digests.append(xxhash.xxh3_128_digest(view[p - lo : p - lo + width]))
                        at.append(p)
                    k = r["last"] + 1 - r["first"]
                    rks += [rk] * k
                    c1s += [c1] * k
                    ns += [n] * k
            two = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_pydict({"rk": pa.array(rks, pa.int64()), "at": pa.array(at, pa.int32()), "c1": pa.array(c1s, pa.int64()), "n": pa.array(ns, pa.int64()), "w1": pa.array(np.ascontiguousarray(two[:, 0])), "w2": pa.array(np.ascontiguousarray(two[:, 1]))})

    return run


def _word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts one after another, and where each text's begin."""
    data, offsets = B.joined(column)
    begin, end, first = B.words(data, offsets)
    return B.span_hash(B.prefix_sums(data), begin, end), first


def _word_samples(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch, "text"):
                with np.errstate(over="ignore"):
                    own, first = _word_hashes(batch.column("text").slice(a, b - a))
                    text, _, lo, hi, core = samples(own, first, words, _WORD_CORE, B.value_sums)
                    context = B.span_hash(B.value_sums(own), lo, hi + words) if len(lo) else np.zeros(0, np.uint64)
                base = first[text]
                yield pa.RecordBatch.from_pydict({
                    "rk": batch.column("rk").slice(a, b - a).take(pa.array(text)), "core": pa.array(core), "c": pa.array(context.view(np.int64)), "lo": pa.array((lo - base).astype(np.int32)), "hi": pa.array((hi - base).astype(np.int32)),
                })

    return run


def _word_strings(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (rk, wanted) in enumerate(zip(batch.column("rk").to_pylist(), batch.column("wanted").to_pylist(), strict=True)):
                with np.errstate(over="ignore"):
                    own, _ = _word_hashes(batch.column("text").slice(i, 1))
                    h = B.window_hash(B.value_sums(own), words).view(np.int64)
                found = np.unique(np.concatenate([h[w["lo"] : w["hi"] + 1] for w in wanted]))
                yield pa.RecordBatch.from_pydict({"rk": pa.array([rk] * len(found), pa.int64()), "w": pa.array(found)})

    return run


def repeated_passages(keyed: DataFrame, words: int = 51) -> DataFrame:
    """Keys (rk) of the texts with a run of ``words`` words that another text has too; rows are (rk, text).

    Works as the byte arrays do, over words: equal contexts are shared runs, and only texts that share a core
    and no context are looked at again, string by string, with the other contexts of that core.
    """
    across = lambda df, *by: df.groupBy(*by).agg(F.min("rk").alias("x"), F.max("rk").alias("y")).where("x < y").select(*by)
    every = stored(keyed.mapInArrow(tidy(_word_samples(words)), "rk bigint, core bigint, c bigint, lo int, hi int"), "passages")
    shared = stored(every.join(stored(across(every, "core"), "cores"), "core"), "passages")
    drop(every)
    # sides of joins are written first, so that a core that very many texts share can be split
    sure = stored(shared.join(stored(across(shared, "core", "c"), "sure"), ["core", "c"]).select("rk").distinct(), "sure")
    unsure = stored(shared.join(sure, "rk", "left_anti").select("core").distinct(), "unsure")
    leads = stored(shared.groupBy("core", "c").agg(F.min(F.struct("rk", "lo", "hi")).alias("r")), "leads").join(unsure, "core")
    wanted = leads.groupBy("r.rk").agg(F.collect_list(F.struct("r.lo", "r.hi")).alias("wanted"))
    strings = stored(keyed.dropDuplicates(["rk"]).join(wanted, "rk").mapInArrow(tidy(_word_strings(words)), "rk bigint, w bigint"), "passages")
    out = stored(sure.unionAll(strings.join(across(strings, "w"), "w").select("rk")).distinct(), "repeated")
    drop(shared, sure, strings)
    return out


def _remove(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, removed, spans = [], [], [], []
            passage = batch.column("passage")
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                data = (text or "").encode()
                parts, at, n = [], 0, 0
                for r in sorted((r["lo"], r["hi"] + width) for r in ranges or ()):
                    if n and r[0] <= at:
                        at = max(at, r[1])
                        continue
                    parts.append(data[at : r[0]])
                    at, n = r[1], n + 1
                parts.append(data[at:])
                kept.append(b"".join(parts))
                sizes.append(len(data))
                removed.append(len(data) - len(kept[-1]))
                spans.append(n)
            yield pa.RecordBatch.from_pydict({"doc": batch.column("doc"), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary()), "repeats_passage": passage})

    return run


def remove_repeats(docs: DataFrame, *, width: int = 400, words: int = 51, batches: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc, n_bytes, n_removed, n_spans, kept, repeats_passage), one for each row of ``docs``.

    Every byte of a ``width``-byte string that occurs twice goes. ``repeats_passage`` is 1 where the text has a run
    of ``words`` words that another text has too, which may be shorter than ``width`` bytes. ``batches`` is how many
    parts of the table are indexed one after another.
    """
    if width < 2 * _CORE:
        raise ValueError(f"width must be {2 * _CORE} at least")
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = keyed.withColumn("rk", F.xxhash64("doc", "text"))
    suffixes = stored(keyed.select("rk", "text").mapInArrow(tidy(_suffixes(width)), _SUFFIX), "samples")
    passages = repeated_passages(keyed.select("rk", "text"), words)
    family = Levels()
    for k in range(batches):
        family.insert(suffixes.where(F.pmod("rk", F.lit(batches)) == k))
    matches = stored(reduce(DataFrame.unionAll, family.matches).distinct(), "matches")
    forks = stored(reduce(DataFrame.unionAll, family.forks).distinct(), "forks")

    leads = family.all().join(forks, "core").groupBy(_CONTEXT).agg(F.sum("n").alias("n"), F.min(F.struct("rk", "pos", "lo", "hi")).alias("r"))
    by_doc = leads.groupBy("r.rk").agg(F.collect_list(F.struct("r.pos", "r.lo", "r.hi", "c1", "n", "core")).alias("wanted"))
    contexts = keyed.select("rk", "text").join(by_doc, "rk").mapInArrow(tidy(_contexts(width)), "rk bigint, pos int, lo int, hi int, c1 bigint, n bigint, core bigint, data binary")
    contexts = stored(contexts, "contexts")
    parts = stored(contexts.mapInArrow(tidy(_parts(width)), "rk bigint, pos int, lo int, c1 bigint, n bigint, first int, last int, inner bigint, o1 bigint, o2 bigint"), "parts")
    whole = stored(parts.groupBy("o1", "o2").agg(F.min("c1").alias("x"), F.max("c1").alias("y")).where("x < y").select("o1", "o2"), "wholes")
    whole_marks = parts.where("n = 1").join(whole, ["o1", "o2"]).select("rk", F.col("first").alias("lo"), F.col("last").alias("hi"))
    outer = F.struct("o1", "o2")
    unsure = stored(parts.groupBy("inner").agg(F.min(outer).alias("x"), F.max(outer).alias("y")).where("x < y").select("inner"), "unsure")
    # a sample at the edge of a piece has two contexts, told apart by their first starts
    ranges = parts.join(unsure, "inner").groupBy("rk", "pos", "lo").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    strings = contexts.join(ranges, ["rk", "pos", "lo"]).mapInArrow(tidy(_strings(width)), "rk bigint, at int, c1 bigint, n bigint, w1 bigint, w2 bigint")
    strings = stored(strings, "strings")
    again = stored(strings.groupBy("w1", "w2").agg(F.min("c1").alias("x"), F.max("c1").alias("y")).where("x < y").select("w1", "w2"), "again")
    string_marks = strings.where("n = 1").join(again, ["w1", "w2"]).select("rk", F.col("at").alias("lo"), F.col("at").alias("hi"))

    marks = suffixes.join(matches, ["c1", "c2"]).select("rk", "lo", "hi").unionAll(whole_marks).unionAll(string_marks)
    marks = marks.groupBy("rk").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    marks = stored(marks.join(passages.withColumn("passage", F.lit(1)), "rk", "full"), "marks")
    drop(suffixes, matches, forks, contexts, parts, whole, unsure, strings, again, passages, *family.tables.values(), *family.matches, *family.forks)
    out = keyed.join(marks, "rk", "left")
    return out.select("doc", "text", "ranges", F.coalesce("passage", F.lit(0)).alias("passage")).mapInArrow(tidy(_remove(width)), f"doc {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, repeats_passage int")
