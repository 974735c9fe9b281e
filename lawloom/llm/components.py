"""Groups of linked records by random-mate contraction, and splits that keep such groups together."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lawloom.plans import is_small, join_unique, staged

MAX_ROUNDS = 200
_FINE = 4096


def component_labels(edges: DataFrame, seed: int = 17) -> DataFrame:
    """(v, root): for every vertex of edges (a, b), the vertex that its component contracts to.

    Each round every vertex tosses a coin, drawn from its hash and the round. A vertex with tails that has a neighbour
    with heads collapses into one of them (the one of the smallest hash); edges are renamed, loops and repeats dropped.
    A quarter of the vertices with edges goes in a round at least, in expectation, so rounds grow with the logarithm of
    the vertices, and the tables shrink geometrically. Then the labels are unwound from the last round to the first.
    Every step is a join or an aggregation by vertex that combines on the map side; a hub with a third of all edges is
    aggregated like any other key, and joined by broadcast where a count proves the tables small, or with salts by
    exact counts. Rows with a null end and loops link nothing.
    """
    linked = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    live = staged(linked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    vertices = live.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    small = is_small(live)  # then so are all tables of vertices: two for each edge at most
    meet = lambda left, right, on: left.join(F.broadcast(right), on, "left") if small else join_unique(left, staged(right, "right"), [on], "left")
    rounds: list[DataFrame] = []
    while not live.isEmpty():
        if len(rounds) == MAX_ROUNDS:
            raise RuntimeError("contraction didn't end")
        heads = lambda c, k=len(rounds): F.xxhash64(F.lit(seed), F.lit(k), c) % 2 == 0
        ends = live.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e")).select("e.*")
        mates = ends.where(~heads(F.col("v")) & heads(F.col("w")))
        chosen = staged(mates.groupBy("v").agg(F.min_by("w", F.xxhash64(F.lit(seed + 1), F.lit(len(rounds)), "w")).alias("mate")), "mates")
        rounds.append(chosen)
        renamed = meet(meet(live, chosen.select(F.col("v").alias("a"), F.col("mate").alias("ma")), "a"), chosen.select(F.col("v").alias("b"), F.col("mate").alias("mb")), "b")
        renamed = renamed.select(F.coalesce("ma", "a").alias("x"), F.coalesce("mb", "b").alias("y")).where(F.col("x") != F.col("y"))
        live = staged(renamed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    labels: DataFrame | None = None
    for k, chosen in reversed(list(enumerate(rounds))):
        if labels is None:
            labels = chosen.select("v", F.col("mate").alias("root"))
        else:
            later = labels.select(F.col("v").alias("mate"), "root")
            here = meet(chosen, later, "mate").select("v", F.coalesce("root", "mate").alias("root"))
            labels = here.unionByName(labels)
        if k % 4 == 0:
            labels = staged(labels, "labels")
    if labels is None:
        return vertices.select("v", F.col("v").alias("root"))
    return meet(vertices, labels, "v").select("v", F.coalesce("root", "v").alias("root"))


def linked_groups(members: DataFrame) -> DataFrame:
    """(record, group_id) for members (record, key): records that share a key, directly or through others, are one group.

    group_id is the smallest record of the group. A record with no usable key (null) is a group of its own; null records
    are dropped; repeated rows change nothing. The graph has one vertex per key: a record with several keys links its
    smallest key to each of the others, so the edges number at most the citations, however many records share a key.
    """
    cited = staged(members.where(F.col("record").isNotNull()).distinct(), "cited")
    first = staged(cited.groupBy("record").agg(F.min("key").alias("first")), "first")
    edges = join_unique(cited, first, ["record"]).select(F.col("first").alias("a"), F.col("key").alias("b"))
    roots = staged(component_labels(edges), "roots")
    placed = join_unique(first, roots.withColumnRenamed("v", "first"), ["first"], "left").select("record", F.coalesce("root", "first").alias("root"))
    placed = staged(placed, "placed")
    smallest = placed.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("record").alias("group_id"))
    return join_unique(placed, smallest, ["root"], "left").select("record", F.coalesce("group_id", "record").alias("group_id"))


def assign_splits(groups: DataFrame, shares: Mapping[str, float], seed: int = 17) -> DataFrame:
    """(record, group_id, split): whole groups to splits, so that the records of each split come near its share.

    Groups of more than 1 % of all records (fewer than 100, so they fit the driver) are placed first, largest first, each
    where most room is left. The rest are laid out in hash order and cut by cumulative weight at the room that is left;
    the running sum is taken within 4,096 ranges of hashes and over their 4,096 totals, so no task sorts all groups.
    Ties go to the earlier split of shares. The shares are scaled to sum to 1. A group is never divided.
    """
    total = groups.count()
    names, whole = list(shares), sum(shares.values())
    room = {k: total * shares[k] / whole for k in names}
    sizes = staged(groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")), "sizes")
    big = [(r["group_id"], r["n"]) for r in sizes.where(F.col("n") * 100 > total).collect()]
    split: dict = {}
    for group, n in sorted(big, key=lambda x: (-x[1], x[0])):
        split[group] = max(names, key=lambda k: room[k])
        room[split[group]] -= n
    small = sizes.where(F.col("n") * 100 <= total).withColumn("h", F.xxhash64(F.lit(seed), "group_id")).withColumn("fine", F.pmod(F.shiftrightunsigned("h", 40), F.lit(_FINE)))
    totals = small.groupBy("fine").agg(F.sum("n").alias("all"))
    before = totals.withColumn("before", F.sum("all").over(Window.orderBy("fine")) - F.col("all")).select("fine", "before")
    inside = Window.partitionBy("fine").orderBy("h", "group_id")
    placed = small.join(F.broadcast(before), "fine").withColumn("middle", F.col("before") + F.sum("n").over(inside) - F.col("n") / 2)
    free = {k: max(0.0, room[k]) for k in names}
    scale = (total - sum(n for _, n in big)) / (sum(free.values()) or 1.0)
    case, end = None, 0.0
    for k in names[:-1]:
        end += free[k] * scale
        case = F.when(F.col("middle") < end, k) if case is None else case.when(F.col("middle") < end, k)
    chosen = placed.select("group_id", (F.lit(names[-1]) if case is None else case.otherwise(names[-1])).alias("split"))
    if split:
        kind = sizes.schema["group_id"].dataType.simpleString()
        chosen = chosen.unionByName(groups.sparkSession.createDataFrame(list(split.items()), f"group_id {kind}, split string"))
    return join_unique(groups, chosen, ["group_id"]).select("record", "group_id", "split")
