"""Ranks and running counts over groups of any size.

Rows are dealt to range partitions of (group, order), so that a large group lies in many; each partition is sorted and counted in its own task, and a group's
partitions are moved on by what its earlier ones hold: one row for each group and partition it lies in.  No window spans a whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.sources.shared import written


def running_before(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """rows with, for each entry (name, column) of `sums`, the sum of that column over the rows of the same group that come earlier in `order`; 0 for the first.

    `by` may be empty: one group. Rows that tie in `order` come in any order, so order must tell them apart, or they must be summed up before. NULLs come first in `order`, and NULL groups are a group.
    """
    keys = [*by, *order]
    dealt = written(rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in keys]).withColumn("_part", F.spark_partition_id()), "ranks")
    held = dealt.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_part").alias("_at"), *[F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_{name}") for name in sums])
    inside = Window.partitionBy("_part", *by).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    here = dealt.withColumns({f"_in_{name}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for name, c in sums.items()})
    same = F.col("_part") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return here.join(offsets, same).select(*rows.columns, *[(F.col(f"_in_{name}") + F.col(f"_{name}")).alias(name) for name in sums])


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "rank", size: str | None = None) -> DataFrame:
    """rows with `name`, their place in their group from 1 (ties in any order), and, if asked for, the group's size."""
    out = running_before(rows.withColumn("_one", F.lit(1).cast("bigint")), by, order, {name: "_one"}).withColumn(name, F.col(name) + 1).drop("_one")
    if size:
        out = out.join(_sizes(rows, by, size), _same(by)).drop(*[f"_g_{c}" for c in by])
    return out


def _sizes(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    return rows.groupBy(*[F.col(c).alias(f"_g_{c}") for c in by]).agg(F.count(F.lit(1)).alias(name))


def _same(by: list[str]):
    out = F.lit(True)
    for c in by:
        out = out & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return out


def average_ranks(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """rows with the rank of `value` in its group, equal values sharing the mean of their places. Values are counted before they are ranked, so a value that many rows share is one row of the ranking."""
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    ranks = running_before(counts, by, [value], {"_below": "_n"})
    ranks = ranks.select(*[F.col(c).alias(f"_g_{c}") for c in by], F.col(value).alias("_v"), (F.col("_below") + (F.col("_n") + 1) / 2.0).alias(name))
    return rows.join(ranks, _same(by) & F.col(value).eqNullSafe(F.col("_v"))).select(*rows.columns, name)
