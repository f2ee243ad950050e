"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern: the sorted set of sources that hold them. A flow network then
routes token capacity to the sources' quotas: each pattern offers its tokens once for nothing and again at a cost
that grows with every repetition, each source takes its quota, and successive cheapest paths give a flow of least
cost. Only patterns and sources reach the driver, never documents. What a pattern owes is whole passes over its
documents plus a rest, and the rest is filled with documents in the order of a seeded hash: histograms over two hex
digits of the hash after the other narrow down where the rest ends, and only the documents whose first eight digits
agree with that place are ordered.

Defined cases: null or blank texts have size 0 and take no words; a null source is a source of its own and sorts
last; a document without any source is not taken; repeated rows are separate documents of equal rank; an empty
table gives an empty result. Columns other than the named ones are not read.
"""

from __future__ import annotations

from collections import deque
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

_STEPS, _DIGITS = 4, 2  # histograms of the seeded hash, of 256 buckets each


def words(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def capped_shares(sizes: list[int], weights: list[int], most_repeats: int) -> list[Fraction]:
    """Shares of the total size by weight; none above ``most_repeats`` times its size, the excess shared anew."""
    total, out = sum(sizes), [Fraction(0)] * len(sizes)
    open_, left = set(range(len(sizes))), Fraction(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] > most_repeats * sizes[i] * weight}
        for i in over or open_:
            out[i] = Fraction(most_repeats * sizes[i]) if over else left * weights[i] / weight
        if not over:
            break
        left -= sum(out[i] for i in over)
        open_ -= over
    return out


def cheapest_flow(capacity: list[int], members: list[list[int]], quotas: list[int], most_repeats: int) -> dict[tuple[int, int], int]:
    """Flow (pattern, source) -> tokens that fills the quotas as far as possible at the least cost.

    The k-th pass over a pattern costs k - 1 a token. Each step augments along a cheapest path of the residual
    network, found by label correction over patterns and sources only.
    """
    flow: dict[tuple[int, int], int] = {}
    used, need = [0] * len(capacity), list(quotas)
    holders: list[list[int]] = [[] for _ in quotas]
    for p, own in enumerate(members):
        for s in own:
            holders[s].append(p)
    while True:
        price, came = {}, {}
        queue: deque[tuple[str, int]] = deque()
        for p, c in enumerate(capacity):
            if c and used[p] < most_repeats * c:
                price["p", p] = used[p] // c
                queue.append(("p", p))
        while queue:
            kind, x = node = queue.popleft()
            for y in members[x] if kind == "p" else holders[x]:
                to = ("s", y) if kind == "p" else ("p", y)
                if (kind == "p" or flow.get((y, x), 0) > 0) and price[node] < price.get(to, 1 << 60):
                    price[to], came[to] = price[node], node
                    queue.append(to)
        ends = [s for s, n in enumerate(need) if n > 0 and ("s", s) in price]
        if not ends:
            return flow
        end = min(ends, key=lambda s: (price["s", s], s))
        path = [("s", end)]
        while path[-1] in came:
            path.append(came[path[-1]])
        path.reverse()
        first = path[0][1]
        amount = min([need[end], capacity[first] - used[first] % capacity[first], *(flow[b[1], a[1]] for a, b in zip(path, path[1:], strict=False) if a[0] == "s")])
        used[first] += amount
        need[end] -= amount
        for a, b in zip(path, path[1:], strict=False):
            key, sign = ((a[1], b[1]), 1) if a[0] == "p" else ((b[1], a[1]), -1)
            flow[key] = flow.get(key, 0) + sign * amount


def mix(docs: DataFrame, sources: Column, size: Column, *, most_repeats: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix", most_patterns: int = 100_000, id_col: str = "doc_id") -> DataFrame:
    """Rows (doc, members, size, taken, repeats), one for each row of ``docs``, and for each first source its size and target.

    ``sources`` is an array column of a row's sources. Sources ordered by code point, null last, weigh ``weights``
    in turn and share the total size; no share exceeds ``most_repeats`` times the source's size. More than
    ``most_patterns`` different memberships are refused, since they are solved on the driver and broadcast.
    """
    spark = docs.sparkSession
    members = F.array_sort(F.array_distinct(F.transform(sources, lambda x: F.struct(x.isNull().alias("none"), x.alias("name")))))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))
    rows = docs.select(F.col(id_col).alias("doc"), members.alias("members"), size.alias("size"), order.alias("place"))
    rows = rows.withColumn("pattern", F.to_json("members", {"ignoreNullFields": "false"}))
    rows = stored(rows, "sized")
    sums = rows.groupBy("pattern").agg(F.first("members").alias("members"), F.sum("size").alias("size")).limit(most_patterns + 1).collect()
    if len(sums) > most_patterns:
        raise ValueError(f"more than {most_patterns} membership patterns")
    names = sorted({(m["none"], m["name"] or "") for r in sums for m in r["members"] or ()})
    place = {x: i for i, x in enumerate(names)}
    own = [[place[m["none"], m["name"] or ""] for m in r["members"] or ()] for r in sums]
    source_size = [0] * len(names)
    for r, held in zip(sums, own, strict=True):
        for s in held:
            source_size[s] += r["size"]
    weight = [weights[i % len(weights)] for i in range(len(names))]
    targets = capped_shares(source_size, weight, most_repeats)
    flow = cheapest_flow([r["size"] for r in sums], own, [int(t + Fraction(1, 2)) for t in targets], most_repeats)
    owed = [0] * len(sums)
    for (p, _), n in flow.items():
        owed[p] += n
    plan = [(r["pattern"], owed[p] // r["size"] if r["size"] else 0, owed[p] % r["size"] if r["size"] else 0, source_size[held[0]] if held else None, float(targets[held[0]]) if held else None) for p, (r, held) in enumerate(zip(sums, own, strict=True))]
    plan = spark.createDataFrame(plan, "pattern string, passes bigint, rest bigint, source_size bigint, target double")

    cut = plan.select("pattern", "rest", F.lit(0).cast("bigint").alias("before"), F.lit("").alias("last"))
    for k in range(1, _STEPS + 1):  # a pattern has 256 buckets in each step
        inside = rows.join(F.broadcast(cut), "pattern").where(F.col("place").startswith(F.col("last")))
        held = inside.groupBy("pattern", "rest", "before", F.substring("place", 1, k * _DIGITS).alias("bucket")).agg(F.sum("size").alias("held"))
        running = Window.partitionBy("pattern").orderBy("bucket")
        ends = held.withColumn("upto", F.col("before") + F.sum("held").over(running)).where("upto > rest AND upto - held <= rest")
        cut = stored(ends.select("pattern", "rest", (F.col("upto") - F.col("held")).alias("before"), F.col("bucket").alias("last")), "cut")
    planned = rows.withColumn("bucket", F.substring("place", 1, _STEPS * _DIGITS)).join(F.broadcast(plan.join(cut.drop("rest"), "pattern", "left")), "pattern")
    inside = planned.where("bucket = last")
    upto = F.sum("size").over(Window.partitionBy("pattern").orderBy("place", "doc", "size").rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
    inside = inside.withColumn("picked", (2 * upto - F.col("size") <= 2 * F.col("rest")).cast("bigint"))
    outside = planned.where("NOT coalesce(bucket = last, false)").withColumn("picked", F.coalesce(F.col("bucket") < F.col("last"), F.lit(False)).cast("bigint"))
    repeats = F.col("passes") + F.col("picked")
    return inside.unionByName(outside).select("doc", "members", "size", "source_size", "target", (repeats * F.col("size")).alias("taken"), repeats.alias("repeats"))
