"""Ranks and ranges within groups that hold where one group has a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lawloom.plans.stage import join_unique, staged


def best(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group with their ranks; every task keeps k of a group before rows are shuffled."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """All rows with their rank in their group, from 1; ties of the whole order rank in any order.

    Rows are sorted by group and order together into ranges, so a hot group spans as many tasks as its rows fill. A row's
    rank is its place in its range after the rows of its group in earlier ranges, whose counts are joined: one row for
    each range at most.
    """
    keys = [F.col(b).asc_nulls_first() for b in by]
    placed = staged(df.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = placed.groupBy("__range", *by).count()
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("__before", F.sum("count").over(earlier)).where(F.col("__before") > 0).drop("count")
    own = placed.withColumn("__place", F.row_number().over(Window.partitionBy("__range", *by).orderBy(*order)))
    match = own["__range"] == before["__range"]
    for b in by:
        match = match & own[b].eqNullSafe(before[b])
    found = own.join(F.broadcast(before), match, "left").select(*[own[c] for c in df.columns], own["__place"], before["__before"])
    return found.withColumn(name, (F.col("__place") + F.coalesce("__before", F.lit(0))).cast("int")).drop("__place", "__before")


def with_range(df: DataFrame, by: Sequence[str], **scores: str) -> DataFrame:
    """df with name_low and name_high for name=score: the smallest and the largest finite score of the group, which infinite
    ones count as (0 where a group has none), and with the score cut to them."""
    finite = lambda s: F.when(F.abs(s) < float("inf"), F.col(s))
    ranges = df.groupBy(*by).agg(*[c for n, s in scores.items() for c in (F.coalesce(F.min(finite(s)), F.lit(0.0)).alias(f"{n}_low"), F.coalesce(F.max(finite(s)), F.lit(0.0)).alias(f"{n}_high"))])
    joined = join_unique(df, ranges, by, "left")
    for n, s in scores.items():
        joined = joined.withColumn(s, F.when(F.col(s).isNotNull(), F.least(F.greatest(F.col(s), F.col(f"{n}_low")), F.col(f"{n}_high"))))
    return joined
