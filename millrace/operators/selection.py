"""Order statistics and running totals of groups of any size: no task ever holds a whole group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ..sources.scratch import stored


def exact_percentiles(df: DataFrame, by: str, value: str, shares: list[float], *, accuracy: int = 1000, most: int = 100_000, passes: int = 12) -> DataFrame:
    """Rows (by, share, value): discrete percentiles, the least value that at least that share of the group's values do not exceed.

    A sketch of bounded size brackets each percentile between two values that occur, a count says how many values lie below and
    between, and the bracket is narrowed by a sketch of what lies between until at most ``most`` values are left or both ends
    are equal. Each pass aggregates before it shuffles; only the values left at the end are ranked. The answer is exact: a bracket
    that does not hold the wanted rank is widened to all values on that side.
    """
    rows = df.select(F.col(by).alias("g"), F.col(value).alias("v")).where(F.col("v").isNotNull())
    wanted = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    n = F.count("*")
    state = rows.groupBy("g").agg(n.alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).select("g", "n", "lo", "hi", wanted)
    rank = F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("n") - 1e-9)).cast("long")
    # rank counts from the values at lo on; ``left`` values lie from lo to hi
    state = stored(state.select("g", "share", rank.alias("rank"), "lo", "hi", F.col("n").alias("left")), "percentiles")
    for _ in range(passes):
        live = state.where((F.col("left") > most) & (F.col("lo") < F.col("hi")))
        if live.isEmpty():
            break
        # a row a group and share: small beside the values
        inside = rows.join(live.withColumnsRenamed({"g": "k"}), F.col("g").eqNullSafe(F.col("k")) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        part = F.first("rank") / F.first("left")
        gap = 2.0 / accuracy
        sketch = F.percentile_approx("v", F.array(*[F.lit(i / 200) for i in range(201)]), accuracy)
        cuts = inside.groupBy("g", "share").agg(sketch.alias("q"), part.alias("p"))
        low = F.get("q", F.greatest(F.lit(0), F.floor((F.col("p") - gap) * 200) - 1).cast("int"))
        high = F.get("q", F.least(F.lit(200), F.ceil((F.col("p") + gap) * 200) + 1).cast("int"))
        cuts = cuts.select(F.col("g").alias("cg"), F.col("share").alias("cs"), low.alias("a"), high.alias("b"))
        met = inside.join(cuts, F.col("g").eqNullSafe(F.col("cg")) & (F.col("share") == F.col("cs")))
        count = lambda c: F.count(F.when(c, 1))
        v, a, b = F.col("v"), F.col("a"), F.col("b")
        found = met.groupBy("g", "share", "rank", "lo", "hi", "left", "a", "b").agg(count(v < a).alias("under"), count(v <= a).alias("upto_a"), count(v <= b).alias("upto_b"), F.min(F.when(v > b, v)).alias("next"), F.max(F.when(v < a, v)).alias("prior"))
        r = F.col("rank")
        new = found.select(
            "g", "share",
            F.when(r > F.col("upto_b"), r - F.col("upto_b")).when(r <= F.col("under"), r).otherwise(r - F.col("under")).alias("rank"),
            F.when(r > F.col("upto_b"), F.col("next")).when(r <= F.col("under"), F.col("lo")).otherwise(a).alias("lo"),
            F.when(r > F.col("upto_b"), F.col("hi")).when(r <= F.col("under"), F.col("prior")).when(r <= F.col("upto_a"), a).otherwise(b).alias("hi"),
            F.when(r > F.col("upto_b"), F.col("left") - F.col("upto_b")).when(r <= F.col("under"), F.col("under")).when(r <= F.col("upto_a"), F.col("upto_a") - F.col("under")).otherwise(F.col("upto_b") - F.col("under")).alias("left"),
        )
        done = state.where((F.col("left") <= most) | (F.col("lo") == F.col("hi")))
        state = stored(done.unionAll(new), "percentiles")
    settled = state.where(F.col("lo") == F.col("hi")).select("g", "share", F.col("lo").alias("v"))
    open_ = state.where(F.col("lo") < F.col("hi")).withColumnsRenamed({"g": "k"})
    inside = rows.join(open_, F.col("g").eqNullSafe(F.col("k")) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
    # equal values are one row with their number
    sums = F.sum("m").over(Window.partitionBy("g", "share").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    counted = inside.groupBy("g", "share", "rank", "v").agg(F.count("*").alias("m")).withColumn("upto", sums)
    ranked = counted.where(F.col("upto") >= F.col("rank")).groupBy("g", "share").agg(F.min("v").alias("v"))
    return settled.unionAll(ranked).select(F.col("g").alias(by), "share", F.col("v").alias(value))


def running_totals(df: DataFrame, by: str, order: list[str], size: str, out: str = "upto") -> DataFrame:
    """``df`` with the sum of ``size`` over the group's rows up to and with each row, in the order of ``order``.

    Rows are dealt by ranges of group and order, so that a group of many rows lies in several partitions. Each partition sums up
    its own part of a group while its sorted rows pass by; the totals of parts, a row each, are summed up and added. Null sizes
    count as 0. Rows that tie in ``order`` stand in any order.
    """
    rows = df.withColumn("_size", F.coalesce(F.col(size), F.lit(0)).cast("long")).repartitionByRange(by, *order).sortWithinPartitions(by, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, begun, group, total = context.partitionId() if context else 0, False, None, 0
        for batch in batches:
            sums = []
            for g, n in zip(batch.column(by).to_pylist(), batch.column("_size").to_pylist(), strict=True):
                total = total + n if begun and g == group else n
                begun, group = True, g
                sums.append(total)
            at = pa.array([part] * batch.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, at, pa.array(sums, pa.int64())], [*batch.schema.names, "_part", "_local"])

    schema = StructType([*rows.schema.fields, StructField("_part", IntegerType()), StructField("_local", LongType())])
    local = stored(rows.mapInArrow(run, schema), "totals")
    parts = local.groupBy(F.col(by).alias("_g"), F.col("_part").alias("_p")).agg(F.sum("_size").alias("_all"))
    before = F.sum("_all").over(Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("_g", "_p", F.coalesce(before, F.lit(0)).alias("_before"))
    met = local.join(parts, F.col(by).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return met.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_local") + F.col("_before")).alias(out))


def greedy_fit(df: DataFrame, by: str, order: list[str], size: str, budget: int) -> DataFrame:
    """The rows of ``df`` that fit when each group is filled in ``order``: what does not fit is passed over, later rows may fit.

    Rows are dealt by ranges of group and order. What is left behind a part of a group is a function of what is left before it,
    held as stretches of budgets from which the same is taken; these functions, not rows, are applied one after another for each group,
    and then each part is filled on its own. Null sizes and sizes below 0 count as 0. Rows that tie in ``order`` stand in any order.
    """
    width = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long")
    dealt = df.withColumn("_size", width).repartitionByRange(by, *order).withColumn("_part", F.spark_partition_id())
    local = stored(dealt, "dealt")
    kind, columns = df.schema[by].dataType, df.columns

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, left, top = None, None, 0

        def row() -> pa.RecordBatch:
            taken = np.arange(budget + 1) - left
            begin = np.flatnonzero(np.diff(taken, prepend=-1))
            return pa.RecordBatch.from_arrays([pa.array([key[0]], own), pa.array([key[1]], pa.int32()), pa.array([begin.tolist()]), pa.array([taken[begin].tolist()])], ["_g", "_p", "begin", "taken"])

        for batch in batches:
            own = batch.column(by).type
            for g, p, n in zip(*(batch.column(c).to_pylist() for c in (by, "_part", "_size")), strict=True):
                if (g, p) != key:
                    if key:
                        yield row()
                    key, left, top = (g, p), np.arange(budget + 1), budget
                if 0 < n <= top:
                    left[left >= n] -= n
                    top = int(left.max())
        if key:
            yield row()

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, group, left = False, None, budget
        for batch in batches:
            before = []
            for g, begin, taken in zip(*(batch.column(c).to_pylist() for c in ("_g", "begin", "taken")), strict=True):
                if not begun or g != group:
                    begun, group, left = True, g, budget
                before.append(left)
                left -= taken[int(np.searchsorted(begin, left, "right")) - 1]
            yield pa.RecordBatch.from_arrays([batch.column("_g"), batch.column("_p"), pa.array(before, pa.int64())], ["_g", "_p", "_left"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, left = None, 0
        for batch in batches:
            fits = []
            for g, p, n, before in zip(*(batch.column(c).to_pylist() for c in (by, "_part", "_size", "_left")), strict=True):
                if (g, p) != key:
                    key, left = (g, p), before
                fits.append(n <= left)
                left -= n if n <= left else 0
            yield batch.select(columns).filter(pa.array(fits, pa.bool_()))

    deal = lambda x: x.repartition(by, "_part").sortWithinPartitions(by, "_part", *order)
    ints = ArrayType(LongType())
    maps = StructType([StructField("_g", kind), StructField("_p", IntegerType()), StructField("begin", ints), StructField("taken", ints)])
    parts = stored(deal(local).select(by, "_part", "_size").mapInArrow(stretches, maps), "stretches")
    lefts = StructType([StructField("_g", kind), StructField("_p", IntegerType()), StructField("_left", LongType())])
    parts = stored(parts.repartition("_g").sortWithinPartitions("_g", "_p").mapInArrow(chain, lefts), "lefts")
    met = local.join(parts, F.col(by).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p"))).drop("_g", "_p")
    return deal(met).mapInArrow(fill, df.schema)
