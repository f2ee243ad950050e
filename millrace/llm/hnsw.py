"""Near-duplicate vectors by hierarchical navigable small-world graphs, one a shard.

Equal vectors are one node from the start. Nodes are dealt to shards of bounded size; each shard's graph is built
in one task: nodes enter by falling level, so that every layer is a prefix, in batches that search the graph as it
stands and each other directly, and keep diverse neighbours. Every node is then a query to every shard, in blocks: a
graph travels in parts of a megabyte, which come first, and the block's queries follow as a stream. A beam walks
queries in step. A query whose beam holds nothing but links is searched again with twice the beam, or, where that
would grow too wide, compared with the whole shard. What a stretch of the stream begins with is widened likewise until
an audit finds the recall that it asks for: brute force over the whole shard for a hashed sample of its queries. Links
leave as they are found, so that a large group of near-alike vectors is never held as pairs. The
recall is the mean share of its links that a query finds, over the sampled queries that have links to others and
found them by beam, so that neither a query's own node nor a large group that was compared whole hides the loss of
small ones. Found pairs are verified as double-precision cosines, links are united from both sides, and components
follow.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components are linked with nothing;
vectors of different lengths are not compared; rows with a null id are linked with nothing and have a null
component; an id with several vectors has the links of all of them; repeated rows count as vectors of their own;
an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import io

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import stored, tidy
from .components import components

_NONE = np.float32(-2)
#: Bytes of a part of a graph; the place of queries, behind all parts.
_PART, _LAST = 1 << 20, 2**31 - 1


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first so that squares neither vanish nor overflow."""
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def narrow(raw: np.ndarray) -> np.ndarray:
    """Rows of length 1 as float32, a few at a time."""
    out = np.empty(raw.shape, np.float32)
    for lo in range(0, len(raw), 4096):
        out[lo : lo + 4096] = unit(raw[lo : lo + 4096].astype(np.float64))
    return out


def beam(vectors: np.ndarray, near: np.ndarray, queries: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best ``width`` nodes (-1: none) and their similarities for each query, walking all queries in step.

    ``near`` holds each node's neighbours, -1 where there are fewer; ``entries`` the nodes to begin from.
    """
    n, rows = len(near), len(queries)
    ids, sims = np.full((rows, width), -1, np.int32), np.full((rows, width), _NONE, np.float32)
    done, seen = np.zeros((rows, width), bool), np.zeros((rows, n + 1), bool)  # the last column takes the -1
    fresh = np.sort(entries, axis=1)
    fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1
    live = np.arange(rows)
    while len(live):
        known = seen[live[:, None], fresh]
        seen[live[:, None], fresh] = True
        s = np.einsum("rd,rkd->rk", queries[live], vectors[fresh])
        s[known | (fresh < 0)] = _NONE
        all_ids = np.concatenate([ids[live], fresh], axis=1)
        all_sims = np.concatenate([sims[live], s], axis=1)
        all_done = np.concatenate([done[live], np.zeros(fresh.shape, bool)], axis=1)
        best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        ids[live], sims[live], done[live] = (np.take_along_axis(x, best, axis=1) for x in (all_ids, all_sims, all_done))
        open_ = np.where(done[live], _NONE, sims[live])
        live_now = (open_ > _NONE).any(axis=1)
        live, open_ = live[live_now], open_[live_now]
        if not len(live):
            break
        k = min(max(4, width // 16), width)
        pick = np.argpartition(-open_, k - 1, axis=1)[:, :k]
        usable = np.take_along_axis(open_, pick, axis=1) > _NONE
        done[live[:, None], pick] = True
        nodes = np.where(usable, ids[live[:, None], pick], n)
        fresh = np.where((nodes < n)[:, :, None], near[np.minimum(nodes, n - 1)], -1).reshape(len(live), -1)
        fresh = np.sort(fresh, axis=1)
        fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1
    ids[sims <= _NONE] = -1
    return ids, sims


def diverse(vectors: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` neighbours of each row: near ones that are nearer to the row than to each other, then the nearest."""
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
    rows, width = ids.shape
    own = vectors[ids]
    between = np.matmul(own, own.transpose(0, 2, 1))
    closest, count = np.full((rows, width), _NONE, np.float32), np.zeros(rows, int)
    rank = np.full((rows, width), 2 * width)  # chosen ones first, then the others by similarity
    for c in range(width):
        there = ids[:, c] >= 0
        take = there & (sims[:, c] > closest[:, c]) & (count < most)
        rank[take, c] = c
        rank[there & ~take, c] = width + c
        count += take
        closest = np.where(take[:, None], np.maximum(closest, between[:, c]), closest)
    first = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(ids, first, axis=1)
    if out.shape[1] < most:
        out = np.concatenate([out, np.full((rows, most - out.shape[1]), -1, ids.dtype)], axis=1)
    return out


class Graph:
    """Layers over one shard's vectors; layer k covers the first ``sizes[k]`` nodes."""

    def __init__(self, vectors: np.ndarray, degree: int = 12, width: int = 48, seed: int = 5) -> None:
        self.vectors, self.degree = vectors.astype(np.float32, copy=False), degree
        n = len(vectors)
        levels = np.sort((-np.log(np.random.default_rng(seed).random(n)) / np.log(degree)).astype(int))[::-1]
        self.sizes = [int((levels >= k).sum()) for k in range(int(levels[0]) + 1)] if n else []
        self.layers: list[np.ndarray] = [np.zeros((0, degree), np.int32)] * len(self.sizes)
        for k in reversed(range(len(self.sizes))):
            self._build(k, self.sizes[k], degree * (2 if k == 0 else 1), width)

    def entries(self, queries: np.ndarray, above: int) -> np.ndarray:
        """Where to begin below layer ``above``: the best node of a narrow walk down."""
        at = np.zeros((len(queries), 1), np.int32)
        for k in reversed(range(above, len(self.layers))):
            at = beam(self.vectors, self.layers[k], queries, at, 4)[0]
        return at

    def _build(self, k: int, n: int, most: int, width: int) -> None:
        v, near = self.vectors, np.full((n, most), -1, np.int32)
        begin = 0
        while begin < n:
            end = min(n, begin + min(512, max(128, begin)))
            q = v[begin:end]
            among = q @ q.T
            np.fill_diagonal(among, _NONE)
            take = min(width, end - begin)
            own = np.argpartition(-among, take - 1, axis=1)[:, :take]
            ids, sims = (own + begin).astype(np.int32), np.take_along_axis(among, own, axis=1)
            ids[sims <= _NONE] = -1
            if begin:
                entry = self.entries(q, k + 1)
                far_ids, far_sims = beam(v, near[:begin], q, np.where(entry < begin, entry, 0), width)
                ids, sims = np.concatenate([ids, far_ids], axis=1), np.concatenate([sims, far_sims], axis=1)
            near[begin:end] = chosen = diverse(v, ids, sims, most)
            self._back(near, np.repeat(np.arange(begin, end, dtype=np.int32), most), chosen.reshape(-1), most)
            begin = end
        self.layers[k] = self._bridged(near, width)

    def _bridged(self, near: np.ndarray, width: int, rounds: int = 12) -> np.ndarray:
        """A column more, with edges to nodes that cannot be reached from the first node, from the nearest that can."""
        near = np.concatenate([near, np.full((len(near), 1), -1, near.dtype)], axis=1)
        for _ in range(rounds):
            reached, front = np.zeros(len(near) + 1, bool), np.zeros(1, np.int64)
            reached[[0, -1]] = True  # the last place takes the -1
            while len(front):
                front = np.unique(near[front])
                front = front[~reached[front]]
                reached[front] = True
            lost = np.flatnonzero(~reached[:-1])
            if not len(lost):
                break
            for lo in range(0, len(lost), 256):
                part = lost[lo : lo + 256]
                ids, sims = beam(self.vectors, near, self.vectors[part], np.zeros((len(part), 1), np.int32), width)
                sims[(ids < 0) | (near[ids, -1] >= 0) | ~reached[ids]] = _NONE
                at = sims.argmax(axis=1)
                good = sims[np.arange(len(part)), at] > _NONE
                near[ids[np.arange(len(part)), at][good], -1] = part[good]  # of several, the last stays
        return near

    def _back(self, near: np.ndarray, source: np.ndarray, target: np.ndarray, most: int) -> None:
        """Edges from the targets back to the sources; a node with too many keeps diverse ones."""
        real = target >= 0
        source, target = source[real], target[real]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        for lo in range(0, len(nodes), 256):
            part, own = nodes[lo : lo + 256], count[lo : lo + 256]
            more = np.full((len(part), int(own.max())), -1, np.int32)
            inside = np.arange(more.shape[1]) < own[:, None]
            more[inside] = source[first[lo] : first[lo] + own.sum()]
            ids = np.concatenate([near[part], more], axis=1)
            in_order = np.sort(ids, axis=1)
            in_order[:, 1:][in_order[:, 1:] == in_order[:, :-1]] = -1
            sims = np.einsum("rd,rkd->rk", self.vectors[part], self.vectors[in_order])
            sims[in_order < 0] = _NONE
            near[part] = diverse(self.vectors, in_order, sims, most)

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        return beam(self.vectors, self.layers[0], queries, self.entries(queries, 1), min(width, len(self.vectors)))


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    return np.asarray((column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()).reshape(-1, size)


def _build_shard(key: tuple, rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("node")
    nodes, raw = np.asarray(rows.column("node"), np.int64), _matrix(rows.column("vector"), key[0].as_py())
    graph = Graph(narrow(raw))
    blob = _packed(nodes=nodes, raw=raw, sizes=np.array(graph.sizes), **{f"layer{k}": x for k, x in enumerate(graph.layers)})
    parts = [blob[lo : lo + _PART] for lo in range(0, len(blob), _PART)]
    n = len(parts)
    return pa.table({"size": pa.array([key[0].as_py()] * n, pa.int32()), "shard": pa.array([key[1].as_py()] * n, pa.int32()), "seq": pa.array(range(n), pa.int32()), "part": pa.array(parts, pa.binary())})


def _opened(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, Graph]:
    held = np.load(io.BytesIO(b"".join(parts)))
    nodes, raw = held["nodes"], held["raw"]
    graph = Graph.__new__(Graph)
    graph.vectors = narrow(raw)
    graph.sizes = held["sizes"].tolist()
    graph.layers = [held[f"layer{k}"] for k in range(len(graph.sizes))]
    return nodes, raw, graph


def _near(graph: Graph, queries: np.ndarray, floor: np.float32, width: int, most_width: int, together: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Rows (query, node) of similarities of at least ``floor``, some queries at a time, and whether these were compared with the whole shard."""
    n = len(graph.vectors)
    for lo in range(0, len(queries), together):
        todo, wide = np.arange(lo, min(lo + together, len(queries))), width
        while len(todo):
            if wide >= min(n, most_width):
                for part in np.split(todo, range(64, len(todo), 64)):
                    rows, nodes = np.nonzero(queries[part] @ graph.vectors.T >= floor)
                    yield part[rows], nodes, True
                break
            ids, sims = graph.search(queries[todo], wide)
            full = (sims >= floor).all(axis=1)  # nothing but links: there may be more
            rows, at = np.nonzero((sims >= floor) & ~full[:, None])
            yield todo[rows], ids[rows, at], False
            todo, wide = todo[full], wide * 2


def linked(graph: Graph, queries: np.ndarray, own: np.ndarray, least: float, width: int, audit: np.ndarray, recall: float, most_width: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (query, node) of float32 cosines that may reach ``least``, with the beams widened as described above.

    ``own`` is each query's node in this graph, -1 if it is of another shard; ``audit`` the queries to audit.
    What would need a beam wider than ``most_width`` is compared with the whole shard instead.
    """
    n, floor = len(graph.vectors), np.float32(least - 1e-5)
    if width < min(n, most_width) and len(audit):
        asked = queries[audit]
        truth = np.concatenate([part @ graph.vectors.T >= floor + np.float32(1e-5) for part in np.split(asked, range(32, len(asked), 32))])  # surely links, whatever the rounding
        truth[np.flatnonzero(own[audit] >= 0), own[audit][own[audit] >= 0]] = False
        total = truth.sum(axis=1)
    while width < min(n, most_width) and len(audit):
        hits, whole = np.zeros(len(audit), np.int64), np.zeros(len(audit), bool)
        for q, node, compared in _near(graph, asked, floor, width, most_width):
            hits += np.bincount(q[truth[q, node]], minlength=len(audit))
            if compared:
                whole[q] = True
        judged = (total > 0) & ~whole
        if not judged.any() or (hits[judged] / total[judged]).mean() >= recall:
            break
        width *= 2
    for q, node, _ in _near(graph, queries, floor, width, most_width):
        yield q, node


def _answers(opened: tuple[np.ndarray, np.ndarray, Graph], own: np.ndarray, mine: np.ndarray, least: float, width: int, recall: float) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of the nodes ``own`` to those of a shard, as double-precision cosines of a bounded number of pairs at a time."""
    nodes, raw, graph = opened
    audit = np.flatnonzero((own * 2654435761 >> 7) % max(1, len(own) // 128) == 0)[:256]
    at = np.minimum(np.searchsorted(nodes, own), len(nodes) - 1)
    here = np.where(nodes[at] == own, at, -1)
    most = max(1, (1 << 20) // mine.shape[1])
    for q, n in linked(graph, narrow(mine), here, least, width, audit, recall):
        keep = own[q] != nodes[n]
        q, n = q[keep], n[keep]
        for lo in range(0, len(q), most):
            x, y = q[lo : lo + most], n[lo : lo + most]
            good = (unit(mine[x].astype(np.float64)) * unit(raw[y].astype(np.float64))).sum(axis=1) >= least
            if good.any():
                yield pa.RecordBatch.from_pydict({"a": pa.array(own[x[good]]), "b": pa.array(nodes[y[good]])})


def _search(least: float, width: int, recall: float, together: int = 8_192):
    """Rows sorted by (size, shard, block, seq): the parts of a graph, then the queries to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts, opened = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            seq = np.asarray(batch.column("seq"))
            keys = np.stack([*(np.asarray(batch.column(k)) for k in ("size", "shard", "block")), seq == _LAST], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for lo, hi in pairwise([0, *cuts.tolist(), batch.num_rows]):
                if group != (group := tuple(keys[lo, :3].tolist())):
                    parts, opened = [], None
                if not keys[lo, 3]:
                    parts += batch.column("part").slice(lo, hi - lo).to_pylist()
                    continue
                if parts:
                    opened, parts = _opened(parts), []
                if opened is None:  # no vector of this length in the shard
                    continue
                step = -(-(hi - lo) // -(-(hi - lo) // together))
                for a in range(lo, hi, step):
                    rows = batch.slice(a, min(step, hi - a))
                    yield from _answers(opened, np.asarray(rows.column("node"), np.int64), _matrix(rows.column("vector"), group[0]), least, width, recall)

    return run


def near_vectors(vectors: DataFrame, *, least: float = 0.95, width: int = 48, recall: float = 0.995, shard_rows: int = 50_000, least_shards: int = 4, block_rows: int = 8_192, most_parts: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (doc, n_links, component), one for each row of ``vectors``; links are cosines of at least ``least``.

    ``width`` is the beam to begin with, ``recall`` what each audit must find. A shard has about ``shard_rows`` nodes,
    fewer if vectors are longer than 64, a block of queries about ``block_rows``, from eight blocks on up to four times
    as many; beyond ``most_parts`` partitions one takes several blocks in turn.
    """
    kind = "float" if isinstance(vectors.schema[vector_col].dataType.elementType, FloatType) else "double"
    numbers = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    sound = F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("doc"), numbers.alias("vector"))
    rows = rows.withColumn("vector", F.when(sound & F.col("doc").isNotNull(), F.col("vector")))
    keyed = rows.withColumn("h1", F.when(F.col("vector").isNotNull(), F.xxhash64("vector"))).withColumn("h2", F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit(1), F.reverse("vector"))))
    nodes = stored(keyed.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc").alias("node"), F.count("*").alias("copies"), F.first("vector").cast(f"array<{kind}>").alias("vector")), "nodes")
    n, numbers = nodes.agg(F.count("*"), F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()
    shards, blocks = max(least_shards, -(-n // shard_rows), -(-numbers // (64 * shard_rows))), max(1, min(-(-n // block_rows), 8), -(-n // (4 * block_rows)))
    own = nodes.select("node", "vector", F.size("vector").alias("size"))
    dealt = own.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "node"), F.lit(shards)).cast("int"))
    # as many partitions as groups, which are few rows but much work: small ones must not be put together
    index = stored(dealt.repartition(2 * shards, "size", "shard").groupBy("size", "shard").applyInArrow(_build_shard, "size int, shard int, seq int, part binary"), "graphs")
    asked = own.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "node"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    spread = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["size", "shard", "block"]
    parts = min(2 * shards * blocks, most_parts)
    spread = spread.select(*keys, "seq", "part", F.lit(None).cast("bigint").alias("node"), F.lit(None).cast(own.schema["vector"].dataType).alias("vector"))
    asked = asked.select(*keys, F.lit(_LAST).alias("seq"), F.lit(None).cast("binary").alias("part"), "node", "vector")
    rows = spread.unionAll(asked).repartition(parts, *keys).sortWithinPartitions(*keys, "seq")
    found = stored(rows.mapInArrow(tidy(_search(least, width, recall)), "a bigint, b bigint"), "found")
    links = stored(found.unionAll(found.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    copies = nodes.groupBy("node").agg(F.sum("copies").alias("copies"))
    others = links.join(copies.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
    reached = components(links.where("a < b"))
    known = nodes.select("h1", "h2", "node", "copies").join(others.withColumnRenamed("a", "node"), "node", "left").join(reached, "node", "left")
    known = stored(known.select("h1", "h2", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component")), "classes")
    out = keyed.select("doc", "h1", "h2").join(known, ["h1", "h2"], "left")
    return out.select("doc", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "doc").alias("component"))
