"""Queries over lexical and dense retrieval, score scaling, fusion and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lawloom.config import EngineConfig
from lawloom.functions import numeric
from lawloom.functions.text import SPACE
from lawloom.operators import bm25, dense, metrics
from lawloom.operators.ranking import best, ranked, with_range
from lawloom.plans.stage import join_unique, staged

CONFIG = EngineConfig()
K = 10


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", "text")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "benchmark_item").select(F.col("item_id").alias("query_id"), "text")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, asked = _docs(spark, sf_dir), _asked(spark, sf_dir)
    best, ranges = bm25.bm25_search(docs, asked, K)
    return bm25.top_k(bm25.padded(best, ranges, docs, asked, K), K).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def bm25_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents kept for each query by default, by their ranks."""
    docs, asked = _docs(spark, sf_dir), _asked(spark, sf_dir)
    best, ranges = bm25.bm25_search(docs, asked, CONFIG.top_k)
    return bm25.top_k(bm25.padded(best, ranges, docs, asked, CONFIG.top_k), CONFIG.top_k).select("query_id", "doc_id", "rank")


def bm25_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best with their scores scaled over all documents, unmatched ones counting as 0, in the three forms."""
    docs = _docs(spark, sf_dir)
    best, ranges = bm25.bm25_search(docs, _asked(spark, sf_dir), K)
    total = docs.where("text is not null").count()
    low, high, x = F.when(F.col("n") < total, F.least("low", F.lit(0.0))).otherwise(F.col("low")), F.col("high"), F.col("score")
    forms = {"plain": numeric.min_max(x, low, high), "eps": numeric.min_max_eps(x, low, high, CONFIG.min_max_eps), "ones": numeric.min_max_ones(x, low, high, CONFIG.min_max_eps)}
    return join_unique(best, ranges, ["query_id"]).select("query_id", "doc_id", *[F.round(c, 6).alias(n) for n, c in forms.items()])


def bm25_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    total, mean = bm25.corpus_size(docs)
    terms = bm25.term_statistics(staged(bm25.document_frequencies(docs), "frequencies"), total)
    return terms.agg(F.count(F.lit(1)).alias("terms"), F.sum("df").alias("postings"), F.round(F.avg("idf"), 6).alias("mean_idf"), F.sum(F.when(F.col("df") * 2 > total, 1).otherwise(0)).alias("floored")).select("*", F.lit(total).cast("bigint").alias("docs"), F.round(F.lit(mean), 6).alias("avgdl"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = (F.size("embedding") == 64) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return _t(spark, sf_dir, "embedding_list").where(good).groupBy("vec_id").agg(F.min(F.struct("law_id", "embedding")).alias("x")).select("vec_id", F.col("x.law_id").alias("law_id"), F.col("x.embedding").alias("v"))


def _cosine(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and as queries those whose id is divisible by 100."""
    vectors = staged(_vectors(spark, sf_dir), "vectors")
    return vectors, vectors.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "v")


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, asked = _cosine(spark, sf_dir)
    return dense.cosine_best(vectors, asked, "vec_id", K, digits=6, apart="vec_id").select("query_id", "vec_id", "rank", F.round("similarity", 5).alias("similarity"))


def cosine_maxpool(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, asked = _cosine(spark, sf_dir)
    return dense.cosine_best(vectors, asked, "law_id", CONFIG.dense_top_k).select("query_id", "law_id", F.round("similarity", 5).alias("similarity"))


def cosine_maxpool_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compatible pooling by runs of one law, cut at the number of laws that are kept."""
    vectors, asked = _cosine(spark, sf_dir)
    return dense.pooled_runs(vectors.where("law_id is not null"), asked, "law_id", "vec_id", CONFIG.dense_top_k).select("query_id", "law_id", F.round("similarity", 5).alias("similarity"))


KEYS = ["law_serial_number", "article_number"]


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, keys, score): each article once with its best usable score; no rank, as a rank of all rows is seldom needed."""
    rows = _t(spark, sf_dir, "predict_relevant_article").select("question_id", *KEYS, numeric.usable(F.col("score")).alias("score"))
    return rows.where("question_id is not null and score is not null and law_serial_number is not null and article_number is not null").groupBy("question_id", *KEYS).agg(F.max("score").alias("score"))


def best_first() -> list[Column]:
    """The order of predictions: best first, equal scores by the keys."""
    return [F.col("score").desc(), *map(F.col, KEYS)]


def _ranked(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return best(predictions(spark, sf_dir), ["question_id"], best_first(), k)


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, keys) of every label of the distinct questions."""
    q = _t(spark, sf_dir, "question_main").select("question_id", "relevant_articles").distinct()
    labels = q.select("question_id", F.explode("relevant_articles").alias("x")).select("question_id", *[F.col(f"x.{k}").alias(k) for k in KEYS])
    return labels.where("law_serial_number is not null and article_number is not null")


def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.recall_at(_ranked(spark, sf_dir, max(CONFIG.recall_cutoffs)), gold(spark, sf_dir), KEYS, CONFIG.recall_cutoffs)
    return out.select("k", F.round("micro", 6).alias("micro"), F.round("macro", 6).alias("macro"), "labels")


def hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.hit_over_labels(_ranked(spark, sf_dir, 5), gold(spark, sf_dir), KEYS)
    return out.withColumn("hit_over_labels", F.round("hit_over_labels", 6)).withColumn("recall", F.round("recall", 6))


def second_score(key: Column) -> Column:
    """A fixed pseudo-random number from 0 to 1 for a key: the stand-in for a model's score."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, keys, item, label, score, bm25, bert) of all predictions; bm25 is the score, infinite or not."""
    labels = gold(spark, sf_dir).distinct().withColumn("label", F.lit(1))
    pairs = join_unique(predictions(spark, sf_dir), labels, ["question_id", *KEYS], "left")
    item = F.concat_ws("#", *KEYS)
    return pairs.select("question_id", *KEYS, item.alias("item"), F.coalesce("label", F.lit(0)).alias("label"), "score", F.col("score").alias("bm25"), second_score(F.concat_ws("#", F.col("question_id").cast("string"), item)).alias("bert"))


def fusion_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.fusion_grid(staged(_pairs(spark, sf_dir).select("question_id", "item", "label", "bm25", "bert"), "pairs"), CONFIG.fusion_cutoffs)
    return out.select(F.round("w_bm25", 6).alias("w_bm25"), F.round("w_bert", 6).alias("w_bert"), "threshold", F.round("recall", 6).alias("recall"))


def score_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score in three scales; infinite scores count as the largest or smallest finite one of their question."""
    pairs = with_range(staged(_pairs(spark, sf_dir).select("question_id", "item", "bm25"), "pairs"), ["question_id"], bm25="bm25")
    x, low, high = F.col("bm25"), F.col("bm25_low"), F.col("bm25_high")
    return pairs.select("question_id", "item", F.round(numeric.min_max(x, low, high), 6).alias("plain"), F.round(numeric.min_max_eps(x, low, high), 6).alias("eps"), F.round(numeric.min_max_ones(x, low, high), 6).alias("ones"))


def confusion_f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and F2 of the first five predictions of each question as positives."""
    out = metrics.confusion(ranked(_pairs(spark, sf_dir), ["question_id"], best_first()), F.col("rank") <= 5, F.col("label"))
    return out.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f2")])


def block_f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean F2 over blocks of ten predictions, positives being those whose second score is above a half."""
    placed = ranked(_pairs(spark, sf_dir), ["question_id"], best_first())
    blocks = metrics.confusion(placed.withColumn("block", F.floor((F.col("rank") - 1) / 10)), F.col("bert") > 0.5, F.col("label"), ["question_id", "block"])
    return blocks.agg(F.count(F.lit(1)).alias("blocks"), F.round(F.avg("f2"), 6).alias("mean_f2"))


def logit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of a two-class model whose logits are a half and the second score: the class of the larger logit."""
    pairs = staged(_pairs(spark, sf_dir).select("label", "bert"), "pairs")
    out = metrics.classification(pairs, F.array(F.lit(0.5), F.col("bert")), F.col("label"))
    probability = pairs.agg(F.round(F.avg(numeric.token_probability(F.array(F.lit(0.5), F.col("bert")), 1)), 6).alias("mean_probability"))
    return out.select("rows", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f2")]).join(F.broadcast(probability))


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_deep, bm25_scaled, bm25_corpus_stats, cosine_topk, cosine_maxpool, cosine_maxpool_runs, recall_at_k, hit_rate, fusion_recall, score_scales, confusion_f2, block_f2, logit_metrics)}

_BM25 = f"""with d as (select doc_id, string_split(trim(regexp_replace(text, '{SPACE}', ' ', 'g')), ' ') as w from documents where text is not null),
size as (select count(*) as n, avg(len(w)) as mean from d), post as (select doc_id, term, count(*) as tf, any_value(dl) as dl from (select doc_id, len(w) as dl, unnest(w) as term from d) group by all),
raw as (select term, count(*) as df, ln((select n from size) - count(*) + 0.5) - ln(count(*) + 0.5) as idf from post group by term),
stat as (select term, df, case when idf < 0 then 0.25 * (select avg(idf) from raw) else idf end as idf from raw),
q as (select query_id, term, count(*) as qf from (select item_id as query_id, unnest(string_split(trim(regexp_replace(text, '{SPACE}', ' ', 'g')), ' ')) as term from benchmark_item where trim(regexp_replace(text, '{SPACE}', ' ', 'g')) <> '') group by all),
score as (select query_id, doc_id, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (select mean from size)))) as score from post join q using (term) join stat using (term) group by all),
"""
_RANKED = "ranked as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id desc) as rank from score)\n"
_VECTORS = """with v as (select vec_id, x.law_id as law_id, list_transform(x.embedding, lambda e: e::double) as v from (select vec_id, min(struct_pack(law_id := law_id, embedding := embedding)) as x from embedding_list
where len(embedding) = 64 and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0 and len(list_filter(embedding, lambda e: e <> 0)) > 0 group by vec_id)),
s as (select a.vec_id as query_id, b.vec_id, b.law_id, list_cosine_similarity(a.v, b.v) as similarity from v a, v b where a.vec_id % 100 = 0)
"""
PREDICTED = """pred as (select *, row_number() over (partition by question_id order by score desc, law_serial_number, article_number) as rank from (select question_id, law_serial_number, article_number, max(score) as score from predict_relevant_article
where question_id is not null and score is not null and not isnan(score) and law_serial_number is not null and article_number is not null group by all)),
gold as (select question_id, x.law_serial_number as law_serial_number, x.article_number as article_number from (select question_id, unnest(relevant_articles) as x from (select distinct question_id, relevant_articles from question_main)) where x.law_serial_number is not null and x.article_number is not null)
"""
_PAIRS = f"""with {PREDICTED}, pairs as (select p.question_id, p.law_serial_number || '#' || p.article_number as item, case when g.question_id is null then 0 else 1 end as label, score, least(greatest(score, coalesce(min(score) filter (where isfinite(score)) over (partition by p.question_id), 0)), coalesce(max(score) filter (where isfinite(score)) over (partition by p.question_id), 0)) as bm25, rank,
('0x' || substr(md5(p.question_id || '#' || p.law_serial_number || '#' || p.article_number), 1, 8))::bigint / 4294967296.0::double as bert from pred p left join (select distinct * from gold) g using (question_id, law_serial_number, article_number))
"""
_CONF = "count(*) filter (where {p} and label = 1) as tp, count(*) filter (where {p} and label = 0) as fp, count(*) filter (where not ({p}) and label = 1) as fn, count(*) filter (where not ({p}) and label = 0) as tn"
_F2 = "case when tp = 0 then 0 else 5 * (tp / (tp + fp)) * (tp / (tp + fn)) / (4 * (tp / (tp + fp)) + tp / (tp + fn)) end"
ORACLE = {
    "bm25_topk": f"{_BM25} {_RANKED} select query_id, doc_id, rank::int as rank, round(score, 6) as score from ranked where rank <= 10",
    "bm25_deep": f"""{_BM25} few as (select item_id as query_id, doc_id from (select distinct item_id from benchmark_item where trim(regexp_replace(text, '{SPACE}', ' ', 'g')) <> '') b, (select doc_id from documents where text is not null order by doc_id desc limit 400) d),
        every as (select * from score union all select f.query_id, f.doc_id, 0 from (select distinct * from few) f where not exists (from score s where s.query_id = f.query_id and s.doc_id = f.doc_id) and (select count(*) from score s where s.query_id = f.query_id) < 200)
        select query_id, doc_id, rank::int as rank from (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id desc) as rank from every) where rank <= 200""",
    "bm25_scaled": f"""{_BM25} lim as (select query_id, max(score) as high, case when count(*) < (select n from size) then least(min(score), 0) else min(score) end as low from score group by query_id), {_RANKED}
        select query_id, doc_id, round(case when high = low then -1 else (score - low) / (high - low) end, 6) as plain, round((score - low) / (high - low + 0.0001), 6) as eps, round(case when high = low then 1 else (score - low) / (high - low + 0.0001) end, 6) as ones from ranked join lim using (query_id) where rank <= 10""",
    "bm25_corpus_stats": f"{_BM25.rstrip()[:-1]} select (select n from size) as docs, round((select mean from size), 6) as avgdl, count(*) as terms, sum(df)::bigint as postings, round(avg(idf), 6) as mean_idf, count(*) filter (where df * 2 > (select n from size)) as floored from stat",
    "cosine_topk": f"{_VECTORS} select query_id, vec_id, rank::int as rank, round(similarity, 5) as similarity from (select *, row_number() over (partition by query_id order by round(similarity, 6) desc, vec_id) as rank from s where query_id <> vec_id) where rank <= 10",
    "cosine_maxpool": f"{_VECTORS}, m as (select query_id, law_id, max(similarity) as similarity from s where law_id is not null group by all) select query_id, law_id, round(similarity, 5) as similarity from (select *, row_number() over (partition by query_id order by round(similarity, 9) desc, law_id) as rank from m) where rank <= 500",
    "cosine_maxpool_runs": f"""{_VECTORS}, t as (select *, lead(1) over w is null as last, case when lag(law_id) over w = law_id then 0 else 1 end as new from s where law_id is not null window w as (partition by query_id order by vec_id)),
        r as (select *, sum(new) over (partition by query_id order by vec_id) as run from t), e as (select query_id, run, law_id, max(similarity) as similarity from r where not last group by all union all select distinct query_id, 1 << 40, '-1', 0.0 from s)
        select query_id, law_id, round(similarity, 5) as similarity from (select *, row_number() over (partition by query_id order by round(similarity, 9) desc, run) as rank from e) where rank <= 500""",
    "recall_at_k": f"""with {PREDICTED}, f as (select g.question_id, p.rank from gold g left join pred p using (question_id, law_serial_number, article_number)), k as (select unnest([1, 2, 5, 10, 20, 50, 100, 200, 500]) as k),
        b as (select k, question_id, count(*) as n, count(*) filter (where rank <= k) as h from f, k group by all) select k, round(sum(h) / sum(n), 6) as micro, round(avg(h / n), 6) as macro, sum(n)::bigint as labels from b group by k""",
    "hit_rate": f"""with {PREDICTED}, f as (select question_id, case when rank <= 5 then 1 else 0 end as hit from gold left join pred using (question_id, law_serial_number, article_number)), b as (select question_id, count(*) as n, max(hit) as one, sum(hit) as hits from f group by all)
        select 5 as topk, sum(n)::bigint as number_label, sum(one)::bigint as number_true, round(sum(one) / sum(n), 6) as hit_over_labels, round(sum(hits) / sum(n), 6) as recall from b""",
    "fusion_recall": f"""{_PAIRS}, n as (select *, (bm25 - min(bm25) over w) / (max(bm25) over w - min(bm25) over w + 0.0001) as a, (bert - min(bert) over w) / (max(bert) over w - min(bert) over w + 0.0001) as b from pairs window w as (partition by question_id)),
        g as (select *, i / 10 as wt, (i / 10) * a + (1 - i / 10) * b as s from n, range(0, 11) t(i)), r as (select *, row_number() over (partition by wt, question_id order by round(s, 9) desc, item) as place from g)
        select round(wt, 6) as w_bm25, round(1 - wt, 6) as w_bert, k as threshold, round(count(*) filter (where place <= k and label = 1) / sum(label), 6) as recall from r, (select unnest([1, 2, 5, 10, 20, 50]) as k) group by wt, k""",
    "score_scales": f"""{_PAIRS} select question_id, item, round(case when max(bm25) over w = min(bm25) over w then -1 else (bm25 - min(bm25) over w) / (max(bm25) over w - min(bm25) over w) end, 6) as plain,
        round((bm25 - min(bm25) over w) / (max(bm25) over w - min(bm25) over w + 0.0001), 6) as eps, round(case when max(bm25) over w = min(bm25) over w then 1 else (bm25 - min(bm25) over w) / (max(bm25) over w - min(bm25) over w + 0.0001) end, 6) as ones from pairs window w as (partition by question_id)""",
    "confusion_f2": f"{_PAIRS}, c as (select {_CONF.format(p='rank <= 5')} from pairs) select *, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round({_F2}, 6) as f2 from c",
    "logit_metrics": f"{_PAIRS}, c as (select count(*) as rows, avg(case when (bert > 0.5) = (label = 1) then 1 else 0 end) as acc, avg(exp(bert) / (exp(bert) + exp(0.5))) as prob, {_CONF.format(p='bert > 0.5')} from pairs) select rows, tp, fp, fn, tn, round(acc, 6) as accuracy, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round({_F2}, 6) as f2, round(prob, 6) as mean_probability from c",
    "block_f2": f"{_PAIRS}, c as (select question_id, (rank - 1) // 10 as block, {_CONF.format(p='bert > 0.5')} from pairs group by all) select count(*) as blocks, round(avg({_F2}), 6) as mean_f2 from c",
}
