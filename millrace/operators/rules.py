"""Decisions by a table of rules instead of written conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decide(rows: DataFrame, rules: DataFrame, key: list[str], out: str, default: str) -> DataFrame:
    """``rows`` with the column ``out``: what the first rule by ``priority`` says that fits, else ``default``.

    ``rules`` has ``priority``, ``out`` and conditions: a column of the same name as one of ``rows`` must be equal, ``x_from`` is
    the least value of ``x`` that fits and ``x_upto`` the first that does not; null fits everything. Rules without any
    equality are few by nature and are compared with each row; the others meet rows by equality of the column that all of
    them name, so that the table may be long. Rows keep their number: the first rule is picked by a minimum over ``key``.
    """
    columns = [c for c in rules.columns if c not in ("priority", out)]
    equal = [c for c in columns if c in rows.columns]
    ranges = [c for c in columns if c not in equal]
    unknown = [c for c in ranges if c.rsplit("_", 1)[0] not in rows.columns or not c.endswith(("_from", "_upto"))]
    if unknown:
        raise ValueError(f"no column for the conditions {unknown}")
    r = rules.select("priority", F.col(out).alias("_out"), *[F.col(c).alias(f"_r_{c}") for c in columns])
    fits: Column = F.lit(True)
    for c in ranges:
        name, own = c.rsplit("_", 1)[0], F.col(f"_r_{c}")
        fits &= own.isNull() | (F.col(name) >= own if c.endswith("_from") else F.col(name) < own)

    def met(part: DataFrame, by: str | None) -> DataFrame:
        on = fits
        for c in equal:
            same = F.col(c) == F.col(f"_r_{c}")
            on &= same if c == by else F.col(f"_r_{c}").isNull() | same
        return rows.join(part, on).groupBy(*key).agg(F.min(F.struct("priority", "_out")).alias("_first"))

    by = equal[0] if equal else None
    named = met(r.where(F.col(f"_r_{by}").isNotNull()), by) if by else None
    rest = met(r.where(F.col(f"_r_{by}").isNull()) if by else r, None)
    first = (named.unionAll(rest) if named is not None else rest).groupBy(*key).agg(F.min("_first").alias("_first"))
    for k in key:
        first = first.withColumnRenamed(k, f"_k_{k}")
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key]
    return rows.join(first, on, "left").select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce("_first._out", F.lit(default)).alias(out))


def guarded(rows: DataFrame, moves: DataFrame, key: list[str], terminal: DataFrame, status: str = "status", to: str = "to") -> DataFrame:
    """Statuses after ``moves`` (key, to): one that the table ``terminal`` (status) lists never changes."""
    ends = terminal.select(F.col(status).alias("_end")).distinct()
    both = rows.join(moves.select(*key, F.col(to).alias("_to")), key, "left").join(ends, F.col(status) == F.col("_end"), "left")
    new = F.when(F.col("_end").isNotNull() | F.col("_to").isNull(), F.col(status)).otherwise(F.col("_to"))
    return both.select(*key, new.alias(status))


def purge(rows: DataFrame, tenant: str, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of tenants that ``gone`` (tenant) does not list, and the number of rows that each listed one had."""
    listed = gone.select(F.col(tenant)).distinct()
    counts = rows.groupBy(tenant).agg(F.count("*").alias("n"))
    return rows.join(listed, tenant, "left_anti"), listed.join(counts, tenant, "left").select(tenant, F.coalesce("n", F.lit(0)).alias("n"))
