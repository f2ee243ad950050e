"""Nearest vectors by an inverted file with product-quantised residuals, and exact scores for what it finds.

An index has three parts below its path. ``codes`` has a row for each vector with one byte for each part of its residual,
in a folder for each list of the inverted file; ``vectors`` has the vectors in full in the same folders, sorted by key in
short pages, so that a few keys are read without the rest; the model (centres of lists, code books, how many lists to
probe) is fitted on a bounded sample and has a size fixed by its parameters.

A search picks lists before it scans: the ``probes`` nearest ones. It reads those lists' codes, a sixteenth of the vectors'
bytes, and scores them from tables of 256 dot products a part. The best ``candidates`` are then read in full and scored exactly.

How many lists and candidates a search needs depends on the vectors: where they form groups, a few lists hold all
neighbours; where they are spread evenly, no choice of lists does. Building measures it on sampled rows against all rows of
the sample and stores the least numbers that reach ``recall``; a caller can give others.

``exact_of_all`` finds the true best of a query set: vectors of a list lie within its radius around its centre, so that a list
is passed over only where none of its vectors can come among a query's best.

Null, zero, non-finite and odd-sized vectors are left out, as their cosine is undefined.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .search import PLACES, cosine, cosine_to, top

BOOK = 256
PART_FLOATS, ASKED = 1 << 20, 20_000  # numbers in a part of the vectors, and queries, that one task holds at once


@dataclass
class Model:
    """Centres of the lists, code books of the residuals (parts x 256 x width), lists to probe, share of rows to rank
    exactly; rows of each list, type of the keys, and the largest distance of a list's vectors from its centre."""

    centres: np.ndarray
    books: np.ndarray
    probes: int
    share: float
    sizes: np.ndarray
    key: str = ""
    radii: np.ndarray | None = None

    def residuals(self, unit: np.ndarray, lists: np.ndarray) -> np.ndarray:
        return (unit - self.centres[lists]).reshape(len(unit), len(self.books), -1)

    def lists_of(self, unit: np.ndarray) -> np.ndarray:
        return np.argmax(unit @ self.centres.T - 0.5 * (self.centres**2).sum(1), axis=1)

    def encode(self, unit: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = self.residuals(unit, lists)
        out = np.empty(rest.shape[:2], np.uint8)
        for k, book in enumerate(self.books):
            out[:, k] = np.argmax(rest[:, k] @ book.T - 0.5 * (book**2).sum(1), axis=1)
        return out

    def tables(self, unit: np.ndarray) -> np.ndarray:
        """Dot products of a query's parts with all code words (parts x 256)."""
        return np.einsum("pd,pcd->pc", unit.reshape(len(self.books), -1), self.books)

    def probed(self, unit: np.ndarray, probes: int | None, least: int) -> np.ndarray:
        """The nearest lists, so many that they hold ``least`` rows too."""
        order = np.argsort(-(self.centres @ unit), kind="stable")
        enough = int(np.searchsorted(np.cumsum(self.sizes[order]), min(least, int(self.sizes.sum())))) + 1
        return order[: max(probes or self.probes, enough)]

    def candidates(self, n: int, least: int) -> int:
        return max(least, 2 * n, math.ceil(self.share * int(self.sizes.sum())))

    def table(self, spark: SparkSession, path: str) -> DataFrame:
        return spark.read.schema(f"key {self.key}, vector array<float>, code binary, rest double, list int").parquet(f"{path}/vectors")

    def to_json(self) -> str:
        return json.dumps({k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in asdict(self).items()})

    @classmethod
    def from_json(cls, text: str) -> Model:
        return cls(**{k: np.array(v) if isinstance(v, list) else v for k, v in json.loads(text).items()})


def _means(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """``k`` centres of the rows; a centre that loses all rows begins anew at one."""
    centres = rows[rng.choice(len(rows), k, replace=len(rows) < k)].copy()
    for _ in range(rounds):
        near = np.argmax(rows @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
        sums, sizes = np.zeros_like(centres), np.bincount(near, minlength=k)
        np.add.at(sums, near, rows)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], rows[rng.integers(len(rows), size=k)])
    return centres


def fit(sample: np.ndarray, *, lists: int, parts: int, recall: float, n: int, seed: int = 7) -> Model:
    """A model from unit rows; probes and share are the least that find ``recall`` of the best ``n`` of sampled queries."""
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, len(sample)))
    centres = _means(sample, lists, rng)
    model = Model(centres, np.zeros((parts, BOOK, sample.shape[1] // parts)), lists, 1.0, np.zeros(lists, np.int64))
    own = model.lists_of(sample)
    rest = model.residuals(sample, own)
    model.books = np.stack([_means(rest[:, k], BOOK, rng) for k in range(parts)])
    codes = model.encode(sample, own)
    queries = rng.choice(len(sample), min(64, len(sample)), replace=False)
    need_lists, need_rank = [], []
    for q in queries.tolist():
        unit = sample[q]
        best = np.argsort(-(sample @ unit))[: n + 1]
        order = np.argsort(-(centres @ unit))
        place = np.empty(lists, np.int64)
        place[order] = np.arange(lists)
        need_lists += place[own[best]].tolist()
        guess = (centres @ unit)[own] + model.tables(unit)[np.arange(parts), codes].sum(1)
        rank = np.empty(len(sample), np.int64)
        rank[np.argsort(-guess)] = np.arange(len(sample))
        need_rank += rank[best].tolist()
    # both choices lose neighbours: each may lose a half of what recall allows
    level = 1 - (1 - recall) / 2
    model.probes = int(np.quantile(need_lists, level, method="higher")) + 1
    model.share = (int(np.quantile(need_rank, level, method="higher")) + 1) / len(sample)
    return model


def _usable(vector: str, width: int) -> Column:
    """Rows whose vector has the width and a finite length above zero."""
    square = F.aggregate(F.transform(vector, lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x * x)
    return (F.size(vector) == width) & (square > 0) & (square < math.inf)


def _units(column: pa.Array, width: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def build(df: DataFrame, path: str, key: str, vector: str, *, lists: int | None = None, parts: int = 16, fit_rows: int = 20_000, recall: float = 0.97, n: int = 40) -> Model:
    """Write an index of all rows below ``path``; the model is fitted on at most ``fit_rows`` rows, chosen by a hash of the key.

    By default there are as many lists as the root of the number of rows, 4,096 at most.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("vector"))
    width = rows.where(F.size("vector") > 0).groupBy(F.size("vector").alias("w")).count().orderBy(F.desc("count"), "w").first()
    width = 1 if width is None else width.w
    rows = rows.where(_usable("vector", width))
    lists = lists or max(1, min(4096, math.isqrt(rows.count())))
    parts = max(p for p in range(1, min(parts, width) + 1) if width % p == 0)
    sample = rows.orderBy(F.xxhash64("key"), "key").limit(fit_rows).select("vector").toArrow()["vector"].combine_chunks()
    unit = _units(sample, width) if len(sample) else np.eye(1, width)
    model = fit(unit, lists=lists, parts=parts, recall=recall, n=n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                u = _units(part.column("vector"), width)
                own = model.lists_of(u)
                yield pa.RecordBatch.from_pydict({"key": part.column("key"), "vector": part.column("vector"), "list": pa.array(own, pa.int32()), "code": pa.array([x.tobytes() for x in model.encode(u, own)], pa.binary()), "rest": pa.array(np.sqrt(((u - model.centres[own]) ** 2).sum(1)))})

    kind = dict(rows.dtypes)["key"]
    coded = rows.mapInArrow(run, f"key {kind}, vector array<float>, list int, code binary, rest double")
    # ranges of keys split a list that very many vectors have
    dealt = coded.repartitionByRange("list", "key").sortWithinPartitions("list", "key")
    dealt.select("key", "vector", "code", "rest", "list").write.partitionBy("list").mode("overwrite").option("parquet.page.row.count.limit", "256").parquet(f"{path}/vectors")
    model.key = kind
    model.radii = np.zeros(len(model.centres))
    for r in model.table(spark, path).groupBy("list").agg(F.count("*").alias("n"), F.max("rest").alias("rest")).collect():  # a row a list
        model.sizes[r.list], model.radii[r.list] = r.n, r.rest
    spark.createDataFrame([(model.to_json(),)], "model string").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    return model


def load(spark: SparkSession, path: str) -> Model:
    return Model.from_json(spark.read.parquet(f"{path}/model").first().model)


def _unit(query: list[float]) -> np.ndarray:
    q = np.array([float(x) for x in query])
    length = math.sqrt(float(q @ q))
    if not 0 < length < math.inf:
        raise ValueError("a query needs a finite length above zero")
    return q / length


def guesses(spark: SparkSession, path: str, model: Model, query: list[float], probes: int | None = None, least: int = 0) -> DataFrame:
    """Rows (key, list, guess) of the probed lists: the dot product with the code's vector, from the codes alone."""
    unit = _unit(query)
    near = model.probed(unit, probes, least).tolist()
    dots = model.centres @ unit
    base = F.create_map(*[F.lit(x) for k in near for x in (k, float(dots[k]))])[F.col("list")]
    terms = [f"get(array({', '.join(f'{x!r}D' for x in row.tolist())}), CAST(conv(hex(substr(code, {k + 1}, 1)), 16, 10) AS INT))" for k, row in enumerate(model.tables(unit))]
    scored = model.table(spark, path).where(F.col("list").isin(*near))
    return scored.select("key", "list", (base + F.expr(" + ".join(terms))).alias("guess"))


def nearest(spark: SparkSession, path: str, query: list[float], n: int = 40, *, probes: int | None = None, candidates: int | None = None, least: int = 1000) -> DataFrame:
    """Rows (key, cosine): the best ``n`` among the candidates by exact cosine.

    ``candidates`` is by default the model's share of all rows. At least ``least`` rows are looked at and ranked exactly,
    so that small tables are searched as a whole.
    """
    model = load(spark, path)
    found = guesses(spark, path, model, query, probes, least).orderBy(F.desc("guess"), "key").limit(candidates or model.candidates(n, least)).select("key", "list").collect()  # as many as are ranked exactly
    full = model.table(spark, path).where(F.col("list").isin(*sorted({r.list for r in found})) & F.col("key").isin(*[r.key for r in found]))
    return top(full.select("key", cosine_to("vector", [float(x) for x in query]).alias("cosine")), "cosine", "key", n)


def nearest_of_all(spark: SparkSession, path: str, queries: DataFrame, n: int = 40, *, probes: int | None = None, candidates: int | None = None, least: int = 1000) -> DataFrame:
    """Rows (query, key, cosine): the best ``n`` for each row (query, vector) of a query set.

    Queries go to the lists that they probe, a list's codes are scored in blocks of both, and each block of codes passes
    on the best of each query only. The candidates' vectors are joined by key.
    """
    model = load(spark, path)
    table, rows = model.table(spark, path), int(model.sizes.sum())
    candidates = candidates or model.candidates(n, least)
    width, take = model.centres.shape[1], probes or model.probes
    queries = queries.select("query", F.col("vector").cast("array<float>").alias("vector")).where(_usable("vector", width))
    q_kind, k_kind = dict(queries.dtypes)["query"], model.key

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [model.probed(u, probes, least) for u in _units(batch.column("vector"), width)]
            order, row = np.concatenate(near), np.repeat(np.arange(batch.num_rows), [len(x) for x in near])
            yield pa.RecordBatch.from_arrays([batch.column("query").take(pa.array(row)), batch.column("vector").take(pa.array(row)), pa.array(order, pa.int32())], ["query", "vector", "list"])

    # blocks of some 500 queries and 20,000 codes meet, however long a list is or however often it is probed
    lists = len(model.centres)
    blocks = queries.mapInArrow(route, f"query {q_kind}, vector array<float>, list int").withColumn("block", F.pmod(F.xxhash64("query"), F.lit(1 + queries.count() * take // lists // 500)))
    blocks = blocks.groupBy("list", "block").agg(F.collect_list("query").alias("query"), F.collect_list("vector").alias("vectors"))
    codes = table.select("key", "list", "code").withColumn("part", F.pmod(F.xxhash64("key"), F.lit(1 + rows // lists // 20_000)))
    codes = codes.groupBy("list", "part").agg(F.collect_list("key").alias("key"), F.collect_list("code").alias("codes"))
    met = codes.join(blocks, "list")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                code = np.frombuffer(b"".join(batch.column("codes")[r].as_py()), np.uint8).reshape(-1, len(model.books))
                unit = _units(batch.column("vectors")[r].values, width)
                own = batch.column("list")[r].as_py()
                flat = np.stack([model.tables(u) for u in unit])
                guess = (unit @ model.centres[own])[:, None] + sum(flat[:, k, code[:, k]] for k in range(len(model.books)))
                keep = min(candidates, guess.shape[1])
                at = np.argpartition(-guess, keep - 1, axis=1)[:, :keep]
                names, keys = batch.column("query")[r].values, batch.column("key")[r].values
                yield pa.RecordBatch.from_arrays([names.take(pa.array(np.repeat(np.arange(len(unit)), keep))), keys.take(pa.array(at.reshape(-1))), pa.array(np.take_along_axis(guess, at, 1).reshape(-1))], ["query", "key", "guess"])

    guess = met.mapInArrow(score, f"query {q_kind}, key {k_kind}, guess double")
    best = guess.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("guess"), "key"))).where(F.col("r") <= candidates).select("query", "key")
    full = best.join(table.select("key", "vector"), "key").join(queries.withColumnRenamed("vector", "q"), "query")
    ranked = full.select("query", "key", cosine(F.col("vector"), F.col("q")).alias("cosine"))
    order = Window.partitionBy("query").orderBy(F.round("cosine", PLACES).desc(), "key")
    return ranked.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).drop("r")


def _parts(sizes: np.ndarray, most: int) -> list[tuple[int, int, int]]:
    """Rows (list, first, n): the parts that a list's rows are dealt to, ``n`` from ``first`` on. Small lists share a part."""
    out, part, held = [], 0, 0
    for own, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            part, held = part + 1, 0
        n = max(1, -(-size // most))
        out.append((own, part, n))
        held += size
        if n > 1:
            part, held = part + n, 0
    return out


def exact_of_all(spark: SparkSession, path: str, queries: DataFrame, n: int = 40) -> DataFrame:
    """Rows (query, key, cosine): the true best ``n`` for each row (query, vector) of a query set.

    Every part of the vectors meets every query and keeps its best ``n``, of equal ones the first keys. Within a part a query's
    nearest list comes first; others are scored only if their centre and radius allow more than the query has by then.
    """
    model = load(spark, path)
    width, centres, radii = model.centres.shape[1], model.centres, model.radii
    queries = queries.select("query", F.col("vector").cast("array<float>").alias("vector")).where(_usable("vector", width))
    parts = _parts(model.sizes, max(1, PART_FLOATS // width))
    count, blocks = max(first + k for _, first, k in parts), 1 + queries.count() // ASKED
    dealt = spark.createDataFrame(parts, "list int, first int, parts int")
    rows = model.table(spark, path).select("key", "list", "vector").join(F.broadcast(dealt), "list")  # a row a list
    rows = rows.select("key", "list", "vector", (F.col("first") + F.pmod(F.xxhash64("key"), "parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = queries.select("query", "vector", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("part"), F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block"))

    def best(own: pa.Table, asked: pa.Table) -> pa.Table:
        names, keys = asked["query"].combine_chunks(), own["key"].combine_chunks()
        if not len(names) or not len(keys):
            return pa.table({"query": names[:0], "key": keys[:0], "cosine": pa.array([], pa.float64())})
        sorted_at = pc.sort_indices(keys)
        rank = np.empty(len(keys), np.int64)
        rank[sorted_at.to_numpy()] = np.arange(len(keys))
        order = np.argsort(own["list"].to_numpy(), kind="stable")
        rank, x = rank[order], _units(own["vector"].combine_chunks(), width)[order]
        lists, starts = np.unique(own["list"].to_numpy()[order], return_index=True)
        spans = [(a, min(a + 2048, z)) for s, z in zip(starts, [*starts[1:], len(x)], strict=True) for a in range(s, z, 2048)]
        of = np.searchsorted(starts, [a for a, _ in spans], side="right") - 1
        every = _units(asked["vector"].combine_chunks(), width)
        found, value, place = [], [], []
        for q in range(0, len(every), 1024):
            unit = every[q : q + 1024]
            bound = unit @ centres[lists].T + radii[lists] + 1e-6
            nearest_list = bound.argmax(1)
            score, at, floor = np.full((len(unit), n), -np.inf), np.full((len(unit), n), len(keys)), np.full(len(unit), -np.inf)
            for first in (True, False):
                for (a, z), k in zip(spans, of, strict=True):
                    who = np.flatnonzero(nearest_list == k if first else (nearest_list != k) & (bound[:, k] >= floor))
                    dots = unit[who] @ x[a:z].T
                    enough = dots >= floor[who, None]
                    for i in np.flatnonzero(enough.any(1)).tolist():
                        w, hit = who[i], np.flatnonzero(enough[i])
                        s, r = np.concatenate([score[w], dots[i, hit]]), np.concatenate([at[w], rank[a + hit]])
                        keep = np.lexsort((r, -np.round(s, PLACES)))[:n]
                        score[w], at[w] = s[keep], r[keep]
                        floor[w] = s[keep].min() - 2 * 10.0**-PLACES  # what rounds alike may still come first by its key
            real = score > -np.inf
            found.append(q + np.nonzero(real)[0])
            value.append(score[real])
            place.append(at[real])
        return pa.table({"query": names.take(pa.array(np.concatenate(found))), "key": keys.take(sorted_at.take(pa.array(np.concatenate(place)))), "cosine": np.concatenate(value)})

    kinds = f"query {dict(queries.dtypes)['query']}, key {model.key}, cosine double"
    near = rows.groupBy("part", "block").cogroup(asked.groupBy("part", "block")).applyInArrow(best, kinds)
    order = Window.partitionBy("query").orderBy(F.round("cosine", PLACES).desc(), "key")
    return near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).drop("r")
