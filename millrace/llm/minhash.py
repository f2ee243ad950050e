"""Near-duplicate documents by one-permutation hashing, banded buckets and star-shaped candidate edges.

One hash of each shingle picks both a bin and a value; a bin keeps its smallest value, and empty bins borrow from
bins chosen by a fixed sequence of probes (optimal densification). ``bands`` runs of ``rows`` bins give bucket
keys. Within a bucket only edges from one centre to the others are candidates, so a bucket of n documents costs
n - 1 pairs. Documents with the same shingle set are one node from the start. Candidates are confirmed on the
full shingle sets. Further rounds look only at buckets whose members are not yet in one component, with another
centre drawn for each bucket; they settle large groups cheaply. Members of buckets that are open after that are
compared by prefixes within each bucket: with shingles in one order for all, rare ones first, two sets at the
threshold share one of their first n - ceil(percent * n / 100) + 1 shingles, and so many must follow it in both, so
that every remaining link is among the candidates. Each set has a sketch beside it, the parity of its shingles in
1,024 slots: a shingle that one of two sets lacks changes one slot at most, so that sketches which differ in more
slots than the threshold lets shingles differ rule the pair out. The join itself compares places, sizes and sketches, and
a pair that cannot be a link is never a row. Pairs within one component are never made. With 40 bands of 6
rows a pair at the threshold 0.8 shares no bucket with a chance of 5e-6. Components settle in 40 rounds or the job fails.

Defined cases: null or blank texts have an empty set and are linked with nothing; a text with fewer words than a
shingle is one shingle; a null id keeps its row, is linked with nothing and has a null component; each row
has the component of its own text, and repeated rows are alike; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .common import settings, slices, stored, tidy
from .components import components

_ATTEMPTS, _SLOTS, _WORDS, _SKETCH = 256, 1 << 18, 8, 16
_COMPILED = {"spark.sql.codegen.hugeMethodLimit": "8000"}  # the JVM leaves longer methods uncompiled; Spark then splits them


def _probes(bins: int) -> np.ndarray:
    """For each attempt and bin the bin to borrow from."""
    return np.random.default_rng(7).integers(0, bins, (_ATTEMPTS, bins))


def densified(least: np.ndarray, empty: np.uint64) -> np.ndarray:
    """Fill the bins that hold ``empty`` from the row's other bins; rows without any value stay as they are."""
    out, probes = least.copy(), _probes(least.shape[1])
    open_rows = np.flatnonzero((least == empty).any(axis=1) & (least != empty).any(axis=1))
    for k in range(_ATTEMPTS):
        if not len(open_rows):
            return out
        part = out[open_rows]
        out[open_rows] = np.where(part == empty, least[open_rows][:, probes[k]], part)
        open_rows = open_rows[(out[open_rows] == empty).any(axis=1)]
    for i in open_rows:
        out[i, out[i] == empty] = least[i].min()
    return out


def shingle_hashes(column: pa.Array, words_each: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts one after another, and the offsets of each text's."""
    data, offsets = B.joined(column)
    begin, end, first = B.words(data, offsets)
    with np.errstate(over="ignore"):
        own = B.span_hash(B.prefix_sums(B.lowered(data)), begin, end)
        n = np.diff(first)
        counts = np.where(n == 0, 0, np.maximum(n - words_each + 1, 1))
        out_offsets = np.concatenate([[0], np.cumsum(counts)])
        text = np.repeat(np.arange(len(n)), counts)
        at = np.arange(out_offsets[-1]) - out_offsets[text] + first[text]
        h = np.zeros(len(at), np.uint64)
        for k in range(words_each):
            there = at + k < first[text + 1]
            step = own[np.minimum(at + k, max(len(own) - 1, 0))] if len(own) else h
            h = B.mix(h * np.uint64(0x2545F4914F6CDD1D) + np.where(there, step, np.uint64(k + 1)))
    return h, out_offsets


def _features(words_each: int, bands: int, rows: int, id_col: str, text_col: str):
    bins = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.uint64(0xFFFFFFFFFFFFFFFF)
        for batch in batches:
            for lo, hi in slices(batch, text_col):
                h, offsets = shingle_hashes(batch.column(text_col).slice(lo, hi - lo), words_each)
                digests, sizes = np.zeros((hi - lo, 2), np.int64), np.zeros(hi - lo, np.int64)
                for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                    own = np.unique(h[a:b])
                    sizes[i] = len(own)
                    digests[i] = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64)
                with np.errstate(over="ignore"):
                    least = np.full((hi - lo, bins), empty)
                    text = np.repeat(np.arange(hi - lo), np.diff(offsets))
                    np.minimum.at(least.reshape(-1), text * bins + ((h >> np.uint64(40)) * np.uint64(bins) >> np.uint64(24)).astype(np.int64), B.mix(h + np.uint64(99)) >> np.uint64(1))
                    filled = densified(least, empty).reshape(hi - lo, bands, rows)
                    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (hi - lo, bands)) * np.uint64(0x9E3779B97F4A7C15)
                    for k in range(rows):
                        keys = B.mix(keys * np.uint64(31) + filled[:, :, k])
                yield pa.RecordBatch.from_pydict({
                    "doc": batch.column(id_col).slice(lo, hi - lo), "n": pa.array(sizes), "s1": pa.array(np.ascontiguousarray(digests[:, 0])), "s2": pa.array(np.ascontiguousarray(digests[:, 1])),
                    "keys": pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo) * bands + 1, bands), pa.int32()), pa.array(keys.view(np.int64).reshape(-1))),
                })

    return run


def sketches(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each of the sets one after another ``_SKETCH`` words of 64 bits: whether the shingles in a slot are odd in number."""
    slots, sets = 64 * _SKETCH, len(offsets) - 1
    with np.errstate(over="ignore"):
        slot = (B.mix(shingles.view(np.uint64) + np.uint64(5)) >> np.uint64(32)).astype(np.int64) % slots
    odd = np.bincount(np.repeat(np.arange(sets), np.diff(offsets)) * slots + slot, minlength=sets * slots).reshape(sets, slots) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)


def _sets(words_each: int, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch, text_col):
                h, offsets = shingle_hashes(batch.column(text_col).slice(lo, hi - lo), words_each)
                own = [np.unique(h[a:b]).view(np.int64) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                ends, v = np.cumsum([0, *map(len, own)]), np.concatenate(own)
                words = {f"w{j}": pa.array(np.ascontiguousarray(w)) for j, w in enumerate(sketches(v, ends).T)}
                yield pa.RecordBatch.from_pydict({"node": batch.column("node").slice(lo, hi - lo), "shingles": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v)), **words})

    return run


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size of the intersection of two sorted sets in each row."""
    for batch in batches:
        x, y = batch.column("xs"), batch.column("ys")
        xo, yo = (np.asarray(c.offsets) for c in (x, y))
        xv, yv = (np.asarray(c.values) for c in (x, y))
        common = [len(np.intersect1d(xv[xo[i] : xo[i + 1]], yv[yo[i] : yo[i + 1]], assume_unique=True)) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b"), "na": pa.array(np.diff(xo), pa.int64()), "nb": pa.array(np.diff(yo), pa.int64()), "common": pa.array(common, pa.int64())})


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles.view(np.uint64) >> np.uint64(46)).astype(np.int64)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles fall in each slot: tells common shingles from rare ones in bounded space."""
    held = np.zeros(_SLOTS, np.int64)
    for batch in batches:
        held += np.bincount(_slot(np.asarray(batch.column("shingles").flatten())), minlength=_SLOTS)
    at = np.flatnonzero(held)
    yield pa.RecordBatch.from_pydict({"slot": pa.array(at.astype(np.int32)), "k": pa.array(held[at])})


def _prefixes(tally: np.ndarray, percent: int):
    """The first shingles of each set, rare slots first, with their places: a set that resembles it has one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("shingles")
            o, v = np.asarray(x.offsets), np.asarray(x.values)
            size = np.diff(o)
            first = size - -(-size.astype(np.int64) * percent // 100) + 1
            parts = [np.zeros(0, np.int64)]
            for a, b, k in zip(o[:-1], o[1:], first, strict=True):
                own = v[a:b]
                parts.append(own[np.lexsort((own, tally[_slot(own)]))[:k]])
            k = np.fromiter(map(len, parts[1:]), np.int64, len(size))
            row = np.repeat(np.arange(len(size)), k)
            place = np.arange(len(row)) - (np.cumsum(k) - k)[row]
            taken = batch.select(["node", "component"]).take(pa.array(row))
            yield pa.RecordBatch.from_pydict({"shingle": pa.array(np.concatenate(parts)), "node": taken.column("node"), "component": taken.column("component"), "n": pa.array(size[row].astype(np.int64)), "place": pa.array(place)})

    return run


def _bits(key: str) -> list[Column]:
    """The buckets of a group as ``_WORDS`` words of 64 bits, one bit a bucket: groups with no bit in common share none."""
    place = F.pmod(F.col(key), F.lit(64 * _WORDS))
    bit = F.expr(f"shiftleft(1L, CAST(pmod({key}, 64) AS INT))")
    return [F.bit_or(F.when(F.floor(place / 64) == j, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"b{j}") for j in range(_WORDS)]


def _close(x: str, y: str, percent: int) -> str:
    """Whether the sketches of two sets differ in no more slots than shingles may at the threshold."""
    apart = " + ".join(f"bit_count(w{j}{x} ^ w{j}{y})" for j in range(_SKETCH))
    return f"({apart}) * {100 + percent} <= {100 - percent} * (n{x} + n{y})"


def _by_prefixes(open_rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes of different components that hold all links between them within the buckets.

    ``open_rows`` has (key, node, component). Components meet at a shingle first, with what is known of all their
    members there, so that members of the same component are never paired.
    """
    tally = np.zeros(_SLOTS, np.int32)
    for r in sets.mapInArrow(tidy(_tally), "slot int, k bigint").groupBy("slot").agg(F.sum("k").alias("k")).toArrow().to_batches():
        tally[np.asarray(r.column("slot"))] = np.minimum(np.asarray(r.column("k")), np.iinfo(np.int32).max)
    own, sketch = [f"b{j}" for j in range(_WORDS)], [f"w{j}" for j in range(_SKETCH)]
    nodes = stored(open_rows.groupBy("node", "component").agg(*_bits("key")), "open")
    grams = nodes.join(sets, "node").select("node", "component", "shingles").mapInArrow(tidy(_prefixes(tally, percent)), "shingle bigint, node bigint, component bigint, n bigint, place bigint")
    grams = stored(grams, "prefixes")
    met = stored(grams.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("shingle"), "met")
    known = nodes.join(sets, "node").select("node", *own, *sketch)
    grams = stored(grams.join(met, "shingle").join(known, "node").withColumn("left", F.col("n") - F.col("place")).drop("place"), "prefixes")
    # of a component's members at a shingle: slots that are odd in all of them, and in any
    slots = [f(w).alias(f"{k}{w}") for w in sketch for k, f in (("all_", F.bit_and), ("any_", F.bit_or))]
    sides = stored(grams.groupBy("shingle", "component").agg(F.min("n").alias("n"), F.max("n").alias("most"), F.max("left").alias("left"), *[F.bit_or(b).alias(b) for b in own], *slots), "sides")
    side = lambda df, c, *more: df.select("shingle", F.col("component").alias(c), *more, *[F.col(x).alias(f"{x}_{c}") for x in df.columns if x not in ("shingle", "component", "node")])
    fit = f"least(left_x, left_y) * {100 + percent} >= {percent} * (n_x + n_y) AND (" + " | ".join(f"(b{j}_x & b{j}_y)" for j in range(_WORDS)) + ") <> 0"
    surely = " + ".join(f"bit_count((all_{w}_x & ~any_{w}_y) | (all_{w}_y & ~any_{w}_x))" for w in sketch)
    meeting = side(sides, "x").join(side(sides, "y"), "shingle").where(f"x < y AND {fit} AND ({surely}) * {100 + percent} <= {100 - percent} * (most_x + most_y)")
    meeting = meeting.select("shingle", "x", "y", *[f"{c}_y" for c in sides.columns if c not in ("shingle", "component")])
    pairs = _members_met(meeting, side(grams, "x", F.col("node").alias("a")), fit, percent).join(side(grams, "y", F.col("node").alias("b")), ["shingle", "y"]).where(f"{fit} AND {_close('_x', '_y', percent)}")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _members_met(meeting: DataFrame, members: DataFrame, fit: str, percent: int) -> DataFrame:
    """Members of x at a shingle, for each y met there that holds a set the member may resemble by what is known of all of y.

    A large component meets many others at a shingle; the join itself leaves out its members that none of y's can be linked with.
    """
    surely = " + ".join(f"bit_count((w{j}_x & ~any_w{j}_y) | (all_w{j}_y & ~w{j}_x))" for j in range(_SKETCH))
    known = [c for c in meeting.columns if c.endswith("_y")]
    return meeting.join(members, ["shingle", "x"]).where(f"{fit} AND ({surely}) * {100 + percent} <= {100 - percent} * (n_x + most_y)").drop(*known)


def near_duplicates(docs: DataFrame, *, words_each: int = 5, percent: int = 80, bands: int = 40, rows: int = 6, rounds: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc, n_shingles, component): one for each row of ``docs``, component the smallest id reachable by links.

    Two documents are linked if 100 * |intersection| >= ``percent`` * |union| of their sets of shingles of
    ``words_each`` lower-cased words. ``rounds`` is the number of star centres tried in
    unsettled buckets before what is left is compared by prefixes.
    """
    narrow = docs.select(id_col, text_col)
    marks = stored(narrow.mapInArrow(tidy(_features(words_each, bands, rows, id_col, text_col)), "doc bigint, n bigint, s1 bigint, s2 bigint, keys array<bigint>"), "minhash")
    named = marks.where("doc IS NOT NULL AND n > 0")
    nodes = stored(named.groupBy("s1", "s2").agg(F.min("doc").alias("node")), "sets")
    # one row of each set goes on; rows with the same id and set are alike
    lead = named.join(nodes, ["s1", "s2"]).where("doc = node").select("node", "n", "keys")
    buckets = lead.select("node", "n", F.explode("keys").alias("key"))
    shared = stored(buckets.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key"), "shared")
    members = stored(buckets.join(shared, "key").select("key", "node", "n"), "buckets")

    chosen = members.select("node").distinct()
    texts = narrow.withColumnRenamed(id_col, "node").join(chosen, "node").select("node", text_col)
    sets = stored(texts.mapInArrow(tidy(_sets(words_each, text_col)), "node bigint, shingles array<bigint>, " + ", ".join(f"w{j} bigint" for j in range(_SKETCH))), "shingles")

    def confirmed(pairs: DataFrame) -> DataFrame:
        compared = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("xs")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("ys")), "b")
        found = compared.mapInArrow(tidy(_overlap), "a bigint, b bigint, na bigint, nb bigint, common bigint").where(f"100 * common >= {int(percent)} * (na + nb - common)").select("a", "b")
        return stored(found, "links")

    def unsettled(least: int) -> DataFrame:
        """Rows of buckets of ``least`` members or more that lie in different components."""
        lively = members.join(reached, "node", "left").withColumn("component", F.coalesce("component", "node"))
        open_keys = lively.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("of")).where(f"x < y AND of >= {least}").select("key")
        return stored(lively.join(open_keys, "key"), "open")

    links = tried = reached = None
    for k in range(rounds):
        if reached is None:
            lively = members.withColumn("component", F.col("node"))
            first = F.min(F.struct("node", "n", "component"))
        else:
            lively = unsettled(2)
            first = F.min_by(F.struct("node", "n", "component"), F.xxhash64(F.lit(k), "key", "node"))
        centres = stored(lively.groupBy("key").agg(first.alias("c")), "centres")
        near = F.least("n", "c.n") * 100 >= F.greatest("n", "c.n") * percent
        pairs = lively.join(centres, "key").where(near & (F.col("component") != F.col("c.component")))
        ends = F.struct("node", "n"), F.struct("c.node", "c.n")
        pairs = pairs.select(F.least(*ends).alias("lo"), F.greatest(*ends).alias("hi")).select(F.col("lo.node").alias("a"), F.col("lo.n").alias("na"), F.col("hi.node").alias("b"), F.col("hi.n").alias("nb")).where("a < b").distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        of = lambda x: sets.select(F.col("node").alias(x), *[F.col(f"w{j}").alias(f"w{j}{x}") for j in range(_SKETCH)])
        with settings(docs.sparkSession, _COMPILED):
            pairs = stored(pairs.join(of("a"), "a").join(of("b"), "b").where(_close("a", "b", int(percent))).select("a", "b"), "candidates")
        tried = pairs if tried is None else tried.unionAll(pairs)
        found = confirmed(pairs)
        links = found if links is None else links.unionAll(found)
        if not k or not found.isEmpty():
            reached = components(links).select("node", "component")
    # the first round has tried the only pair of a bucket of two
    left = unsettled(3).select("key", "node", "component")
    if not left.isEmpty():
        with settings(docs.sparkSession, _COMPILED):
            pairs = stored(_by_prefixes(left, sets, int(percent)).join(tried, ["a", "b"], "left_anti"), "candidates")
        found = confirmed(pairs)
        if not found.isEmpty():
            reached = components(links.unionAll(found)).select("node", "component")
    of_set = nodes.join(reached, "node", "left").select("s1", "s2", F.coalesce("component", "node").alias("component"))
    out = marks.join(stored(of_set, "classes"), ["s1", "s2"], "left")
    return out.select("doc", F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc")).alias("component"))
