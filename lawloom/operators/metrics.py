"""Retrieval and classification metrics, each in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawloom.functions.numeric import argmax, blend, f2, min_max_eps
from lawloom.operators.ranking import best, with_range


def recall_at(ranked: DataFrame, labels: DataFrame, keys: Sequence[str], cutoffs: Sequence[int]) -> DataFrame:
    """(k, micro, macro, labels): recall over all labels, and the mean of the questions' recalls, at every cut-off.

    ranked (question_id, keys, rank), labels (question_id, keys); a repeated label counts as often. Questions without
    labels have no recall.
    """
    found = labels.join(ranked.select("question_id", *keys, "rank"), ["question_id", *keys], "left")
    by_question = found.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias(f"h{k}") for k in cutoffs])
    totals = by_question.agg(F.sum("n").alias("n"), *[F.sum(f"h{k}").alias(f"s{k}") for k in cutoffs], *[F.avg(F.col(f"h{k}") / F.col("n")).alias(f"m{k}") for k in cutoffs])
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.try_divide(F.col(f"s{k}"), F.col("n")).alias("micro"), F.col(f"m{k}").alias("macro"), F.col("n").alias("labels")) for k in cutoffs])
    return totals.select(F.inline(rows))


def hit_over_labels(ranked: DataFrame, labels: DataFrame, keys: Sequence[str], limit: int = 5) -> DataFrame:
    """(topk, number_label, number_true, hit_over_labels): at most one hit a question over all labels, and true recall beside it."""
    found = labels.join(ranked.where(F.col("rank") <= limit).select("question_id", *keys, F.lit(1).alias("hit")), ["question_id", *keys], "left")
    by_question = found.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce("hit", F.lit(0))).alias("any"), F.sum(F.coalesce("hit", F.lit(0))).alias("all"))
    total = by_question.agg(F.sum("n").alias("number_label"), F.sum("any").alias("number_true"), F.sum("all").alias("hits"))
    return total.select(F.lit(limit).alias("topk"), "number_label", "number_true", F.try_divide("number_true", "number_label").alias("hit_over_labels"), F.try_divide("hits", "number_label").alias("recall"))


def fusion_grid(pairs: DataFrame, cutoffs: Sequence[int], weights: Sequence[float] = tuple(i / 10 for i in range(11))) -> DataFrame:
    """(w_bm25, w_bert, threshold, recall) for pairs (question_id, item, label, bm25, bert).

    Scores are scaled within the question once; the weights are exploded, and only the rows that a cut-off reaches are
    ranked, so that a hot question is cut down before the shuffle. Equal fused scores by item.
    """
    scaled = with_range(pairs, ["question_id"], bm25="bm25", bert="bert")
    scaled = scaled.select("question_id", "item", "label", *[min_max_eps(F.col(c), F.col(f"{c}_low"), F.col(f"{c}_high")).alias(n) for n, c in (("a", "bm25"), ("b", "bert"))])
    each = scaled.withColumn("w", F.explode(F.array(*[F.lit(w) for w in weights]))).withColumn("s", blend(F.col("a"), F.col("b"), F.col("w")))
    ranked = best(each.select("w", "question_id", "item", "label", "s"), ["w", "question_id"], [F.round("s", 9).desc(), F.col("item")], max(cutoffs))
    positives = pairs.agg(F.sum("label").alias("positives"))
    hits = ranked.groupBy("w").agg(*[F.sum(F.when(F.col("rank") <= k, F.col("label")).otherwise(0)).alias(f"h{k}") for k in cutoffs]).join(F.broadcast(positives))
    rows = F.array(*[F.struct(F.lit(k).alias("threshold"), F.try_divide(F.col(f"h{k}"), F.col("positives")).alias("recall")) for k in cutoffs])
    return hits.select(F.col("w").alias("w_bm25"), (F.lit(1.0) - F.col("w")).alias("w_bert"), F.inline(rows))


def confusion(rows: DataFrame, predicted: Column, label: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, tp, fp, fn, tn, precision, recall, f2)."""
    p, y = F.coalesce(predicted.cast("int"), F.lit(0)), F.coalesce(label.cast("int"), F.lit(0))
    counts = rows.groupBy(*by).agg(F.sum(p * y).alias("tp"), F.sum(p * (1 - y)).alias("fp"), F.sum((1 - p) * y).alias("fn"), F.sum((1 - p) * (1 - y)).alias("tn"))
    counts = counts.withColumn("precision", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0))).withColumn("recall", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0)))
    return counts.withColumn("f2", f2(F.col("precision"), F.col("recall")))


def accuracy(pairs: DataFrame, given: Column, gold: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, rows, correct, accuracy in percent); a missing answer is wrong."""
    right = F.coalesce((given == gold).cast("int"), F.lit(0))
    counts = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sum(right).alias("correct"))
    return counts.withColumn("accuracy", F.try_divide(F.col("correct") * 100.0, F.col("rows")))


def classification(rows: DataFrame, logits: Column, label: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, rows, accuracy, tp, fp, fn, tn, precision, recall, f2) of the class with the largest logit, class 1 being positive."""
    chosen = rows.select(*by, argmax(logits).alias("__p"), label.cast("int").alias("__y"))
    counts = confusion(chosen, (F.col("__p") == 1).cast("int"), (F.col("__y") == 1).cast("int"), by)
    right = chosen.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.avg(F.coalesce((F.col("__p") == F.col("__y")).cast("double"), F.lit(0.0))).alias("accuracy"))
    return right.join(counts, list(by)) if by else right.join(F.broadcast(counts))
