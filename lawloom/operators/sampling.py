"""Negative sampling, balancing and splitting in a fixed pseudo-random order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lawloom.functions.text import collapse_lower
from lawloom.operators.ranking import best, ranked
from lawloom.plans.stage import join_unique, staged


def hash_order(seed: int, *keys: Column) -> Column:
    """A key whose order is random but fixed by the seed; it's the same in any engine with md5."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[k.cast("string") for k in keys]))


Order = Sequence[Column | str]


def _quota(labels: DataFrame, n: int) -> tuple[DataFrame, int]:
    """(question_id, quota) of n for each label, and the largest quota."""
    quota = staged(labels.groupBy("question_id").agg((F.count(F.lit(1)) * n).cast("int").alias("quota")), "quota")
    return quota, int(quota.agg(F.max("quota")).first()[0] or 0)


def hard_negatives(predicted: DataFrame, labels: DataFrame, keys: Sequence[str], n: int, order: Order = ("rank",)) -> DataFrame:
    """The first n predictions for each label of a question that are no labels, in order: (question_id, keys, place).

    Every task keeps no more of a question than the largest quota before rows are shuffled, so a hot question is no bottleneck.
    """
    quota, most = _quota(labels, n)
    free = join_unique(predicted, labels.select("question_id", *keys).distinct(), ["question_id", *keys], "left_anti")
    free = join_unique(free, quota, ["question_id"])
    return best(free, ["question_id"], order, most, "place").where(F.col("place") <= F.col("quota")).drop("quota")


def soft_negatives(predicted: DataFrame, labels: DataFrame, keys: Sequence[str], n: int, seed: int) -> DataFrame:
    """n predictions for each label, without replacement, in hash order."""
    return hard_negatives(predicted, labels, keys, n, [hash_order(seed, F.col("question_id"), *[F.col(k) for k in keys]), *keys])


def mixed_negatives(predicted: DataFrame, labels: DataFrame, keys: Sequence[str], n: int, seed: int, order: Order = ("rank",)) -> DataFrame:
    """Half of the n soft, half hard; what both draw comes once."""
    hard, soft = hard_negatives(predicted, labels, keys, n - n // 2, order), soft_negatives(predicted, labels, keys, n // 2, seed)
    return hard.select("question_id", *keys).unionByName(soft.select("question_id", *keys)).distinct()


def replacement_negatives(predicted: DataFrame, labels: DataFrame, keys: Sequence[str], n: int, seed: int, order: Order = ("rank",)) -> DataFrame:
    """(question_id, draw, keys): n draws with replacement for each label; a question whose predictions are all labels has none."""
    free = join_unique(predicted, labels.select("question_id", *keys).distinct(), ["question_id", *keys], "left_anti")
    numbered = staged(ranked(free, ["question_id"], [F.col(o) if isinstance(o, str) else o for o in order], "place"), "numbered")
    draws = labels.groupBy("question_id").agg((F.count(F.lit(1)) * n).alias("quota")).join(numbered.groupBy("question_id").agg(F.count(F.lit(1)).alias("size")), "question_id")
    draws = draws.select("question_id", "size", F.explode(F.sequence(F.lit(1), F.col("quota").cast("int"))).alias("draw"))
    pick = F.conv(F.substring(hash_order(seed, F.col("question_id"), F.col("draw")), 1, 8), 16, 10).cast("bigint") % F.col("size") + 1
    return draws.withColumn("place", pick).join(numbered.select("question_id", "place", *keys), ["question_id", "place"]).select("question_id", "draw", *keys)


def balanced(pairs: DataFrame, rate: float = 1.0, cap_when_no_positive: bool = False, order: Order = ("rank",), stage: bool = True) -> DataFrame:
    """All positives of a question and its first rate * positives negatives in order; with none, or a fractional number, all negatives stay unless capped.

    pairs are read more than once; stage=False leaves out their copy on disk, where reading them is cheap.
    """
    pairs = staged(pairs, "pairs") if stage else pairs
    quota = pairs.groupBy("question_id").agg((F.sum("label") * F.lit(float(rate))).alias("__q"))
    quota = staged(quota.withColumn("__all", F.lit(False) if cap_when_no_positive else (F.col("__q") == 0) | (F.col("__q") != F.floor("__q"))), "quota")
    most = int(quota.where(~F.col("__all")).agg(F.max("__q")).first()[0] or 0)
    rows = join_unique(pairs, quota, ["question_id"])
    whole = rows.where((F.col("label") == 1) | F.col("__all"))
    cut = best(rows.where((F.col("label") != 1) & ~F.col("__all")), ["question_id"], order, most, "__p").where(F.col("__p") <= F.col("__q"))
    return whole.unionByName(cut.drop("__p")).drop("__q", "__all")


def same_parent_negatives(labels: DataFrame, items: DataFrame, parent: str, keys: Sequence[str], n: int, seed: int) -> DataFrame:
    """Up to n other items of a label's parent for each question, without replacement, none of the question's own keys whatever their parent."""
    near = labels.select("question_id", parent).distinct().join(items.select(parent, *keys).distinct(), parent)
    free = near.join(labels.select("question_id", *keys).distinct(), ["question_id", *keys], "left_anti")
    order = hash_order(seed, F.col("question_id"), F.col(parent), *[F.col(k) for k in keys])
    return free.withColumn("place", F.row_number().over(Window.partitionBy("question_id", parent).orderBy(order, *keys))).where(F.col("place") <= n)


def nested_sample(items: DataFrame, levels: Sequence[str], each: int, seed: int) -> DataFrame:
    """Up to `each` members at every level of a hierarchy, in hash order: first of the top level, then within each kept one."""
    kept = items.select(*levels).distinct()
    for depth in range(len(levels)):
        path = list(levels[: depth + 1])
        order = hash_order(seed, *[F.col(c) for c in path])
        layer = kept.select(*path).distinct()
        w = Window.partitionBy(*path[:-1]) if depth else Window.partitionBy(F.lit(0))
        chosen = layer.orderBy(order, *path).limit(each) if not depth else layer.withColumn("__p", F.row_number().over(w.orderBy(order, *path))).where(F.col("__p") <= each).drop("__p")
        kept = kept.join(chosen, path, "left_semi")
    return kept


def drawn_places(count: int, taken: Column, n: int, seed: int, *keys: Column) -> Column:
    """n distinct places below count, none of the sorted array taken, at random by the keys; all that are left if they're fewer."""
    draws = F.slice(F.array(*[F.lit(k) for k in range(1, n + 1)]), F.lit(1), F.greatest(F.lit(0), F.least(F.lit(n), F.lit(count) - F.size(taken))))
    number = lambda k: F.conv(F.substring(hash_order(seed, *keys, k), 1, 8), 16, 10).cast("bigint")
    free = lambda used, k: F.aggregate(used, number(k) % (F.lit(count) - F.size(used)), lambda r, u: r + (u <= r).cast("bigint"))
    return F.array_except(F.aggregate(draws, taken, lambda used, k: F.array_sort(F.array_append(used, free(used, k)))), taken)


def numbered(ids: DataFrame, key: str) -> DataFrame:
    """(key, place) of the distinct ids that aren't null, from 0 in order."""
    distinct = ids.where(F.col(key).isNotNull()).select(key).distinct()
    return staged(ranked(distinct, [], [F.col(key)], "place").select(key, (F.col("place") - 1).cast("bigint").alias("place")), "numbered")


def foreign_negatives(labels: DataFrame, items: DataFrame, levels: Sequence[str], each: int, n: int, seed: int) -> DataFrame:
    """(question_id, cited, levels, place): n items of other parents for each question and parent it cites.

    The parent is the first level. A round draws `each` parents other than the cited one, and up to `each` members at every
    level below. Rounds are independent and go on until they hold n items, of which n are drawn; an item of two rounds may
    come twice. Every parent has an item, so no more than n / `each` rounds are needed. A null id is an id like others.
    """
    parent, below = levels[0], levels[1:]
    items = items.where(F.col(parent).isNotNull()).select(*levels).distinct()
    parents = numbered(items, parent)
    count = parents.count()
    rounds = -(-n // max(1, min(each, count - 1)))
    cited = labels.where(F.col(parent).isNotNull()).select("question_id", F.col(parent).alias("cited")).distinct().join(parents.withColumnRenamed(parent, "cited"), "cited", "left")
    cited = cited.withColumn("taken", F.array_compact(F.array("place"))).withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    draws = cited.select("question_id", "cited", "round", F.explode(drawn_places(count, F.col("taken"), each, seed, F.col("question_id"), F.col("cited"), F.col("round"))).alias("place"))
    found = draws.join(parents, "place").drop("place").join(items, parent)
    path = ["question_id", "cited", "round", parent]
    for level in below:
        order = hash_order(seed, *[F.col(c) for c in [*path, level]])
        found = found.withColumn("__p", F.dense_rank().over(Window.partitionBy(*path).orderBy(order, F.col(level).asc_nulls_first()))).where(F.col("__p") <= each).drop("__p")
        path.append(level)
    w = Window.partitionBy("question_id", "cited")
    found = found.withColumn("__before", F.count(F.lit(1)).over(w.orderBy("round").rangeBetween(Window.unboundedPreceding, -1))).where(F.col("__before") < n)
    order = [hash_order(seed, *[F.col(c) for c in path]), "round", *[F.col(c).asc_nulls_first() for c in levels]]
    return found.withColumn("place", F.row_number().over(w.orderBy(*order))).where(F.col("place") <= n).select("question_id", "cited", *levels, "place")


def parent_negatives(questions: DataFrame, labels: DataFrame, parents: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """(question_id, key): n whole parents for each question that none of its labels has; all others if they're fewer."""
    known = numbered(parents, key)
    count = known.count()
    taken = labels.join(known, key).groupBy("question_id").agg(F.array_sort(F.collect_set("place")).alias("taken"))
    drawn = questions.select("question_id").where("question_id is not null").distinct().join(taken, "question_id", "left").withColumn("taken", F.coalesce("taken", F.array().cast("array<bigint>")))
    return drawn.select("question_id", F.explode(drawn_places(count, F.col("taken"), n, seed, F.col("question_id"))).alias("place")).join(known, "place").select("question_id", key)


def pair_frame(queries: DataFrame, positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """(question_id, query, article, label) of (question_id, text) and (question_id, entry): entries of label 1 and 0, both sides cleaned, each row once."""
    entries = positives.select("question_id", "entry", F.lit(1).alias("label")).unionByName(negatives.select("question_id", "entry", F.lit(0).alias("label")))
    return queries.join(entries, "question_id").select("question_id", collapse_lower(F.col("text")).alias("query"), collapse_lower(F.col("entry")).alias("article"), "label").where("article is not null").distinct()


def split_by_size(questions: DataFrame, share: float, seed: int, most: int = 2) -> DataFrame:
    """(question_id, n_labels, split): questions of more than `most` labels train; of the others the first floor(total * (1 - share)) in hash order test."""
    total = questions.count()
    test = int(total * (1 - share))
    order = hash_order(seed, F.col("question_id"))
    placed = ranked(questions.where(F.col("n_labels") <= most), [], [order, F.col("question_id")], "__place")
    tested = placed.where(F.col("__place") <= test).select("question_id", F.lit("test").alias("split"))
    return questions.join(tested, "question_id", "left").withColumn("split", F.coalesce("split", F.lit("train")))


def split_by_lists(questions: DataFrame, first: DataFrame, second: DataFrame, limit: int) -> DataFrame:
    """(question_id, split): the first list, then the second, then by the id's limit."""
    marked = questions.join(first.select("question_id", F.lit(1).alias("__a")).distinct(), "question_id", "left").join(second.select("question_id", F.lit(1).alias("__b")).distinct(), "question_id", "left")
    split = F.when(F.col("__a") == 1, "test-1").when(F.col("__b") == 1, "test-2").when(F.col("question_id") <= limit, "train-1").otherwise("train-2")
    return marked.select("question_id", split.alias("split"))
