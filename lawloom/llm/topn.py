"""The N best items of every group, however many items a group has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lawloom.plans import join_unique, staged

#: Distinct items that one task sorts for one group, score range and salt: a fixed figure, whatever the size of the table.
HEAVY_ROWS = 20_000


def item_order(item: Column) -> list[Column]:
    """Ascending by the item's number, items without one last, spellings of one number by text."""
    return [item.try_cast("decimal(38,0)").asc_nulls_last(), item.cast("string").asc()]


def top_n_per_group(rows: DataFrame, group: str, item: str, score: str, n: int = 10, heavy_rows: int = HEAVY_ROWS, ranges: int = 16) -> DataFrame:
    """(group, item, score, rank) of the n best distinct items of each group, ranks from 1 without gaps.

    An item counts once, with its highest usable score; null and NaN scores are unusable, infinities usable, -0.0 is 0.0.
    Equal scores: the smaller item first, as a number. Rows with a null group or item, and items without a usable score,
    are not ranked. Repeats and the order of rows change nothing; an empty table gives an empty one; other columns are
    ignored.

    Exact counts of the distinct items split the groups. Groups of up to heavy_rows items go through one window each.
    Those of more are cut into score ranges; by the exact count of each range, the ranges that can't reach the n best are
    left out. The others are salted by item, with as many salts as the count of the range asks for, so that a range of one
    repeated score is dealt out too, and ranked within (group, range, salt). Their n best each are counted again, and go
    the same way until no group has more than heavy_rows left; then one window ranks them. So no task sorts more than
    about heavy_rows items of a group, even of one with a third of all rows.
    """
    usable = rows.select(F.col(f"`{group}`").alias("g"), F.col(f"`{item}`").alias("i"), (F.col(f"`{score}`") + F.lit(0.0)).alias("s"))
    usable = usable.where(F.col("g").isNotNull() & F.col("i").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s"))
    best = staged(usable.groupBy("g", "i").agg(F.max("s").alias("s")), "topn")

    order = [F.col("s").desc(), *item_order(F.col("i"))]
    first = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)
    heavy = staged(best.groupBy("g").count().where(F.col("count") > heavy_rows).select("g"), "topn-heavy")
    if heavy.isEmpty():
        return first(best, "g").select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "rank")
    light = join_unique(best, heavy, ["g"], "left_anti")
    hot = join_unique(best, heavy, ["g"], "left_semi")
    cuts = hot.groupBy("g").agg(F.percentile_approx("s", [k / ranges for k in range(1, ranges)], 2000).alias("cuts"))
    placed = join_unique(hot, staged(cuts, "topn-cuts"), ["g"]).select("g", "i", "s", F.size(F.filter("cuts", lambda c: c <= F.col("s"))).alias("r"))
    while True:
        counts = staged(placed.groupBy("g", "r").count(), "topn-ranges")
        most = counts.groupBy("g").agg(F.sum("count").alias("n")).agg(F.max("n")).first()[0]
        if most <= max(heavy_rows, 2 * n):
            break
        above = Window.partitionBy("g").orderBy(F.col("r").desc()).rowsBetween(Window.unboundedPreceding, -1)
        reach = counts.withColumn("above", F.coalesce(F.sum("count").over(above), F.lit(0))).where(F.col("above") < n)
        reach = staged(reach.select("g", "r", F.ceil(F.col("count") / max(heavy_rows, 2 * n)).alias("salts")), "topn-reach")
        salted = join_unique(placed, reach, ["g", "r"]).withColumn("salt", F.pmod(F.xxhash64("i"), F.col("salts")))
        placed = staged(first(salted, "g", "r", "salt").select("g", "i", "s", "r"), "topn-survivors")
    ranked = first(light, "g").select("g", "i", "s", "rank").unionByName(first(placed, "g").select("g", "i", "s", "rank"))
    return ranked.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "rank")
