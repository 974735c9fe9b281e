"""Queries that write and read tables back, resume an append, stream a folder, and score with the offline stand-ins."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawloom.operators import tokenise
from lawloom.operators.ranking import ranked
from lawloom.operators.scorers import answer, encode, score_pairs
from lawloom.plans.stage import new_folder, staged
from lawloom.sources import io, schemas
from lawloom.streaming.resume import process_new

VOCABULARY = os.environ.get("LAWLOOM_PAIR_TOKENIZER", "/opt/tokenizers/word_bpe_49k.json")


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession) -> str:
    return new_folder(spark, "transfer")


def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All flat laws with the ids and whole texts of their articles, written and read back."""
    path = _folder(spark)
    laws = _t(spark, sf_dir, "law_flat")
    io.write_json(laws, path, overwrite=True)
    io.write_json(laws.where("false"), path)  # the folder exists, so it is kept
    back = spark.read.schema(schemas.LAW_FLAT).option("mode", "FAILFAST").json(path)
    shown = lambda f: F.array_join(F.transform("articles", lambda a: F.coalesce(a[f], F.lit("?"))), "|")
    return back.select("id", F.size("articles").alias("n"), shown("id").alias("article_ids"), shown("text").alias("texts"))


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All questions, null and blank texts, edge white space and line breaks too, written and read back."""
    path = _folder(spark)
    rows = _t(spark, sf_dir, "question_main").select("question_id", "text")
    io.write_csv(rows, path, overwrite=True)
    io.write_csv(rows.where("false"), path)  # kept
    return io.read_csv(spark, path, rows.schema)


def json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in files that hold one JSON array each, read as one table."""
    path, answers = _folder(spark), _t(spark, sf_dir, "answer_qwen").where("question_id is not null").select("question_id", "answer")
    io.write_json_arrays(answers, path, rows_per_file=500)
    return io.read_json(spark, path, schemas.MODEL_ANSWERS)


def case_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Competition questions in a folder of one object a file, read with the name of the file and without their choices."""
    path, q = _folder(spark), _t(spark, sf_dir, "question_competition").where("question_id is not null")
    once = q.groupBy("question_id").agg(F.min(F.struct("question_type", "text", "answer")).alias("x")).select("question_id", "x.*")
    io.write_cases(once.withColumn("choices", F.create_map(F.lit("A"), F.col("answer"))), path, "question_id")
    return io.read_json_cases(spark, path, schemas.QUESTION_COMPETITION, drop=["choices", "relevant_articles"])


def row_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions numbered by id, in two ranges that make up all: those from the hundredth on, and those before, by turns marked."""
    q = _t(spark, sf_dir, "question_main").where("question_id is not null").select("question_id").distinct()
    numbered = staged(ranked(q, [], [F.col("question_id")], "place").withColumn("place", F.col("place") - 1), "numbered")
    return io.row_range(numbered, "place", 0, 100).withColumn("part", F.lit("head")).unionByName(io.row_range(numbered, "place", 100).withColumn("part", F.lit("rest")))


def dev_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a smoke run: the limit is the feature."""
    return io.dev_limit(_t(spark, sf_dir, "question_main").where("question_id is not null").select("question_id").distinct(), "question_id", 20)


def answer_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question answered by a stand-in model that takes batches: it says how long the prompt is."""
    q = _t(spark, sf_dir, "question_competition").where("question_id is not null").select("question_id", F.coalesce("text", F.lit("")).alias("prompt")).distinct()
    return answer(q, "question_id", "prompt", lambda prompts: [str(len(p)) for p in prompts])


def training_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs written as shards of a bounded number of rows for a data loader, and how they come back."""
    path = _folder(spark)
    pairs = _t(spark, sf_dir, "question_main").where("question_id is not null and text is not null").select("question_id", "text", F.coalesce(F.size("relevant_articles"), F.lit(-1)).alias("label")).distinct()
    io.write_shards(pairs, path, rows_per_shard=1000)
    shards = spark.read.parquet(path).withColumn("shard", F.col("_metadata.file_name")).groupBy("shard").count()
    most = shards.agg(F.max("count").alias("most"))
    return spark.read.parquet(path).select("question_id", "text", "label").join(F.broadcast(most.select((F.col("most") <= 1000).alias("bounded"))))


def resume_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All answers, appended in two runs: those to essay questions first, then all, of which the second run finds some done."""
    path = _folder(spark)
    answers = _t(spark, sf_dir, "answer_qwen").where("answer_id is not null").select("answer_id", "question_id").distinct()
    io.resume_append(answers.where(F.col("question_id").contains("TL")), path, "answer_id")
    io.resume_append(answers, path, "answer_id")
    return spark.read.parquet(path)


def split_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    io.write_splits(_t(spark, sf_dir, "question_main").select("question_id", F.coalesce("split_name", F.lit("none")).alias("split")), path)
    return spark.read.parquet(path).select("question_id", F.col("split").cast("string").alias("split"))


def streamed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with the largest number of labels of their rows and the smallest text, processed as a stream: of the rows of one question in a batch the last by these counts, and a question is complete within one file."""
    base, source = _folder(spark), _t(spark, sf_dir, "question_main").select("question_id", "text", "relevant_articles")
    source.where("question_id is not null").repartition(8, "question_id").write.parquet(f"{base}/in")
    work = lambda batch: batch.groupBy("question_id").agg(F.max(F.coalesce(F.size("relevant_articles"), F.lit(-1))).alias("n"), F.min("text").alias("text"))
    process_new(spark, f"{base}/in", source.schema, work, f"{base}/out", "question_id", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("question_id", "n", "text")


def offline_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with their label contents and the overlap score; the hashed word vectors are unit vectors or zero."""
    pairs = _t(spark, sf_dir, "question_main").select("question_id", "text", F.explode("relevant_articles").alias("x")).select("question_id", "text", F.col("x.article_content").alias("content"))
    vectors = encode(score_pairs(pairs, "text", "content"), "text")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    checked = F.when((F.abs(norm - 1) < 1e-3) | (norm == 0), F.col("score")).otherwise(F.raise_error(F.lit("no unit vector")).cast("double"))
    return vectors.select("question_id", F.round(checked, 6).alias("score"), "score_predict")


def tokenised_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with each label's content as token ids of a public vocabulary, as a model is trained on them."""
    pairs = _t(spark, sf_dir, "question_main").select("question_id", "text", F.explode("relevant_articles").alias("x")).select("question_id", "text", F.col("x.article_content").alias("content"))
    return tokenise.tokenised_pairs(pairs.distinct(), "text", "content", VOCABULARY).select("question_id", "input_ids", "token_types", "cut")


QUERIES = {f.__name__: f for f in (json_roundtrip, csv_roundtrip, json_arrays, case_folder, row_range, dev_rows, answer_slot, training_shards, resume_append, split_copies, streamed_questions, offline_scores, tokenised_pairs)}

ORACLE = {
    "json_roundtrip": "select id, coalesce(len(articles), -1)::int as n, array_to_string(list_transform(articles, lambda a: coalesce(a.id, '?')), '|') as article_ids, array_to_string(list_transform(articles, lambda a: coalesce(a.text, '?')), '|') as texts from law_flat",
    "csv_roundtrip": "select question_id, text from question_main",
    "json_arrays": "select question_id, answer from answer_qwen where question_id is not null",
    "case_folder": "select question_id, x.question_type as question_type, x.text as text, x.answer as answer, question_id || '.json' as case_file from (select question_id, min(struct_pack(question_type := question_type, text := text, answer := answer)) as x from question_competition where question_id is not null group by question_id)",
    "row_range": "select question_id, place::int as place, case when place < 100 then 'head' else 'rest' end as part from (select question_id, row_number() over (order by question_id) - 1 as place from (select distinct question_id from question_main where question_id is not null))",
    "dev_rows": "select distinct question_id from question_main where question_id is not null order by question_id limit 20",
    "answer_slot": "select question_id, length(coalesce(text, ''))::varchar as answer from (select distinct question_id, coalesce(text, '') as text from question_competition where question_id is not null)",
    "training_shards": "select distinct question_id, text, coalesce(len(relevant_articles), -1)::int as label, true as bounded from question_main where question_id is not null and text is not null",
    "resume_append": "select distinct answer_id, question_id from answer_qwen where answer_id is not null",
    "split_copies": "select question_id, coalesce(split_name, 'none') as split from question_main",
    "streamed_questions": "select question_id, max(coalesce(len(relevant_articles), -1))::int as n, min(text) as text from question_main where question_id is not null group by question_id",
    "offline_scores": """with p as (select question_id, text, x.article_content as content from (select question_id, text, unnest(relevant_articles) as x from question_main)),
        w as (select *, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') as a, list_filter(regexp_split_to_array(coalesce(content, ''), '\\s+'), lambda x: x <> '') as b from p),
        s as (select *, case when len(list_distinct(a)) = 0 then 0 else len(list_intersect(list_distinct(a), list_distinct(b))) / len(list_distinct(a)) end as score from w)
        select question_id, round(score, 6) as score, (score > 0.5)::int as score_predict from s""",
}
