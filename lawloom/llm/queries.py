"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawloom.llm.answers import answer_defects
from lawloom.llm.bpe import encode_corpus
from lawloom.llm.chunks import split_oversized
from lawloom.llm.components import assign_splits, linked_groups
from lawloom.llm.lawid import canonical_law_udf
from lawloom.llm.leaks import leaked_spans
from lawloom.llm.neighbours import IndexOptions, similar_vectors
from lawloom.llm.overlaps import split_overlaps
from lawloom.llm.quality import classified, text_statistics
from lawloom.llm.sql import ORACLE
from lawloom.llm.topn import top_n_per_group
from lawloom.plans import join_unique, staged

TOKENIZER = os.environ.get("LAWLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
SHARES = {"train": 0.8, "valid": 0.1, "test": 0.1}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _best_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_n_per_group(_table(spark, sf_dir, "predict_relevant_article"), "question_id", "article_db_id", "score")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best articles of each question."""
    return _best_articles(spark, sf_dir).select("question_id", "article_db_id")


def p1_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best articles of each question with their scores and ranks."""
    return _best_articles(spark, sf_dir)


def p1_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1_ranked with a limit of 50 items, so that most questions are hot ones at every scale."""
    return top_n_per_group(_table(spark, sf_dir, "predict_relevant_article"), "question_id", "article_db_id", "score", heavy_rows=50, ranges=4)


def _question_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = _table(spark, sf_dir, "question_legacy")
    law = canonical_law_udf(F.col("law"))
    return linked_groups(questions.select(F.col("question_id").alias("record"), F.explode_outer("relevant_laws.id_Law").alias("law")).select("record", law.alias("key")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that share a law, directly or through others, by group; groups of one aren't listed."""
    groups = _question_groups(spark, sf_dir)
    shared = groups.groupBy("group_id").count().where(F.col("count") > 1).select("group_id")
    return join_unique(groups, shared, ["group_id"]).select(F.col("record").alias("question_id"), "group_id")


def p2_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question with its split, whole groups together."""
    return assign_splits(_question_groups(spark, sf_dir), SHARES).select(F.col("record").alias("question_id"), "group_id", "split")


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each split, whether its records come as near to its share as the largest group allows, and how many of its groups are divided."""
    splits = staged(assign_splits(_question_groups(spark, sf_dir), SHARES), "splits")
    groups = splits.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("split").alias("in_splits"))
    all_of = groups.agg(F.sum("n").alias("total"), F.max("n").alias("largest"), F.sum((F.col("in_splits") > 1).cast("long")).alias("divided_groups"))
    share = F.create_map(*[F.lit(x) for kv in SHARES.items() for x in kv])[F.col("split")]
    near = F.abs(F.col("count") - share * F.col("total")) <= F.col("largest") + 1
    return splits.groupBy("split").count().join(F.broadcast(all_of)).select("split", near.alias("near_share"), "divided_groups")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of similarity 0.8 or more of which either is among the other's ten most similar."""
    near = similar_vectors(_table(spark, sf_dir, "embedding_list"), "vec_id", "embedding", least=0.8, options=IndexOptions(probe_share=0.0))
    return near.select(F.least("vec_a", "vec_b").alias("vec_a"), F.greatest("vec_a", "vec_b").alias("vec_b")).distinct()


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar vectors of every vector whose id is divisible by 100, whatever their similarity."""
    return similar_vectors(_table(spark, sf_dir, "embedding_list"), "vec_id", "embedding", wanted=lambda key: key % 100 == 0)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective answers and their defect."""
    return answer_defects(_table(spark, sf_dir, "answer_qwen"), _table(spark, sf_dir, "question_competition")).where(F.col("defect").isNotNull())


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("split_name") == "train", "train").when(F.col("split_name").isin("valid", "test"), "eval")
    columns = [F.col("question_id").alias("record"), side.alias("side"), F.col("split_name").alias("split"), F.col("source")]
    main = _table(spark, sf_dir, "question_main").select(*columns, F.col("text"), F.lit("question_main").alias("origin"))
    legacy = _table(spark, sf_dir, "question_legacy").select(*columns, F.col("question").alias("text"), F.lit("question_legacy").alias("origin"))
    return split_overlaps(main.unionByName(legacy))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a training and an evaluation question that are equal or near."""
    a, b = F.col("train_record"), F.col("eval_record")
    return _overlaps(spark, sf_dir).where(a != b).select(F.least(a, b).alias("question_a"), F.greatest(a, b).alias("question_b")).distinct()


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps by evaluation split and by the tables and sources of both sides, with their edits and matched words; same_id: pairs of one id on both sides."""
    keys = ["eval_split", "eval_origin", "eval_source", "train_origin", "train_source"]
    matched = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end_word"] - s["first_word"])
    found = _overlaps(spark, sf_dir).withColumn("matched", matched)
    pairs = found.groupBy(*keys, "train_record", "eval_record").agg(F.min("edits").alias("edits"), F.max("matched").alias("matched"))
    same = F.sum((F.col("train_record") == F.col("eval_record")).cast("long"))
    sums = [F.sum(F.col(c).cast("long")).alias(n) for c, n in (("edits", "edits"), ("matched", "matched_words"))]
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), same.alias("same_id"), F.countDistinct("eval_record").alias("eval_questions"), F.countDistinct("train_record").alias("train_questions"), *sums)


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_spans(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark_item"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the items of which they hold at least 13 words in a row."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans to remove from each document, by item."""
    return _leaks(spark, sf_dir).distinct()


def _article_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(origin, law_id, chapter_no, section_no, article_no, text) of every article of both law tables."""
    tree = _table(spark, sf_dir, "law_tree").select(F.col("id").alias("law_id"), F.posexplode("content").alias("chapter_no", "x"))
    tree = tree.select("law_id", "chapter_no", F.posexplode("x.content_Chapter").alias("section_no", "x"))
    tree = tree.select("law_id", "chapter_no", "section_no", F.posexplode("x.content_Section").alias("article_no", "x"))
    tree = tree.select(F.lit("law_tree").alias("origin"), "law_id", "chapter_no", "section_no", "article_no", F.col("x.content_Article").alias("text"))
    flat = _table(spark, sf_dir, "law_flat").select(F.col("id").alias("law_id"), F.posexplode("articles").alias("article_no", "x"))
    return tree.unionByName(flat.select(F.lit("law_flat").alias("origin"), "law_id", F.lit(-1).alias("chapter_no"), F.lit(-1).alias("section_no"), "article_no", F.col("x.text").alias("text")))


PLACE = ["origin", "law_id", "chapter_no", "section_no", "article_no"]


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered pieces of every article text of more than 1,200 characters."""
    return split_oversized(_article_texts(spark, sf_dir), PLACE, "text").distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of the article texts that had to be cut."""
    return split_oversized(_article_texts(spark, sf_dir), PLACE, "text").where(F.col("piece_no") == 0).select(*PLACE).distinct()


def p7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each oversized text by its length: whether its pieces keep to the limits and give the text again."""
    articles = staged(_article_texts(spark, sf_dir).where(F.length("text") > 1200).distinct(), "oversized")
    pieces = split_oversized(articles.withColumn("n", F.length("text")).withColumn("h", F.md5("text")), [*PLACE, "n", "h"], "text")
    listed = pieces.groupBy(*PLACE, "n", "h").agg(F.sort_array(F.collect_list(F.struct("piece_no", "piece_start", "piece"))).alias("p"))  # the pieces of one text
    ends = F.transform("p", lambda x: x["piece_start"] + F.length(x["piece"]))
    overlap = F.transform("p", lambda x, i: F.when(i == 0, 125).otherwise(F.get(F.col("ends"), i - 1) - x["piece_start"]))
    whole = F.array_join(F.transform("p", lambda x, i: F.when(i == 0, x["piece"]).otherwise(F.substring(x["piece"], F.get(F.col("overlaps"), i).cast("int") + 1, F.lit(1 << 20)))), "")
    kept = listed.withColumn("ends", ends).withColumn("overlaps", overlap)
    sizes = F.forall("p", lambda x: F.length(x["piece"]) <= 1200)
    return kept.select(*PLACE, "n", sizes.alias("within_size"), F.forall("overlaps", lambda o: o.between(100, 150)).alias("within_overlap"), (F.md5(whole) == F.col("h")).alias("same_text")).distinct()


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return encode_corpus(_table(spark, sf_dir, "documents"), TOKENIZER)


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and shares, its kind, the rule that decided, and all rules that it fails."""
    return classified(text_statistics(_table(spark, sf_dir, "documents"), published=True)).distinct()


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a text that isn't prose."""
    return classified(text_statistics(_table(spark, sf_dir, "documents"))).where(~F.col("kind").isin("prose", "blank")).select("doc_id", "kind").distinct()


def p10_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The characters and lines of every document."""
    return text_statistics(_table(spark, sf_dir, "documents")).select("doc_id", "n_chars", "n_lines").distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_ranked": p1_ranked,
    "p1_hot": p1_hot,
    "p2_found": p2_found,
    "p2_splits": p2_splits,
    "p2_shares": p2_shares,
    "p3_found": p3_found,
    "p3_neighbours": p3_neighbours,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_report": p6_report,
    "p7_found": p7_found,
    "p7_pieces": p7_pieces,
    "p7_rules": p7_rules,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_spans": p9_spans,
    "p10_found": p10_found,
    "p10_statistics": p10_statistics,
    "p10_counts": p10_counts,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
