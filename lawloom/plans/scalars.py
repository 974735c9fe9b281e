"""Queries over the scalar, text and array functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawloom.functions import arrays, numeric, text
from lawloom.functions.text import NOT_WORD, SPACE


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _t(spark, sf_dir, "documents").where(t.isNotNull()).select("doc_id", text.collapse(t).alias("collapsed"), text.collapse_or_blank(t).alias("or_blank"), text.collapse_lower(t).alias("lowered"), text.title_form(t).alias("title"), F.size(text.tokens(text.collapse(t))).alias("n_tokens"), (F.length(t) > 15).alias("long_enough"))


def normalise_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "answer_qwen").where("answer is not null").select("answer_id", text.answer_form(F.col("answer")).alias("form")).distinct()


def encode_decode_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with their ids written into the text, and read back."""
    articles = _t(spark, sf_dir, "law_flat").select(F.col("id").alias("law"), F.posexplode("articles").alias("pos", "x")).select("law", "pos", F.col("x.id").alias("article"), F.col("x.text").alias("body"))
    articles = articles.where("law is not null and article is not null and body is not null").distinct()
    long = text.law_prefix(F.col("article"), F.col("law"), F.concat(F.lit("d"), F.col("pos").cast("string")), F.concat(F.lit("v"), F.col("pos").cast("string")), F.col("body"))
    short = text.article_prefix(F.col("article"), F.col("law"), F.col("body"))
    a, b = text.split_law_prefix(F.col("long")), text.split_article_prefix(F.col("short"))
    return articles.select("law", "pos", long.alias("long"), short.alias("short")).select("law", "pos", *[c.alias(f"long_{n}") for n, c in a.items()], *[c.alias(f"short_{n}") for n, c in b.items()])


def choices_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _t(spark, sf_dir, "question_competition")
    kind = F.when(F.col("question_id").contains("TL"), "essay").when(F.col("question_id").contains("DS"), "verdict").otherwise("choice")
    printed = q.withColumn("full", text.with_choices(F.col("text"), F.col("choices"))).withColumn("kind", kind).withColumn("is_choice", F.col("question_type") == "Trắc nghiệm")
    return printed.select("question_id", "full", "kind", "is_choice").distinct()


def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _t(spark, sf_dir, "question_competition").where("text is not null")
    cited = F.concat_ws("; ", F.transform("relevant_articles", lambda a: F.concat(F.lit("Điều "), a["article_id"], F.lit(" "), a["law_id"])))
    prompt = text.answer_prompt(cited, F.col("text"), F.col("question_type"), F.col("choices"))
    return q.select("question_id", prompt.alias("prompt"), text.relevance_prompt(F.col("text"), cited).alias("relevance"), text.verdict_word(F.size("relevant_articles")).alias("verdict")).distinct()


def parse_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _t(spark, sf_dir, "answer_qwen").where("answer is not null and question_id is not null")
    kind = F.when(F.col("question_id").contains("TL"), "Tự luận").when(F.col("question_id").contains("DS"), "Đúng/Sai").otherwise("Trắc nghiệm")
    return a.select("answer_id", text.extracted_answer(F.col("answer"), kind).alias("extracted"), text.typed_answer(F.col("answer"), kind).alias("typed")).distinct()


def label_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations without repeats of (law, article), in order; the distinct laws; and how often a text "None" stands for an article."""
    q = _t(spark, sf_dir, "question_legacy")
    unique = arrays.distinct_by(F.col("relevant_laws"), ["id_Law", "id_Article"])
    laws = F.array_sort(F.array_distinct(F.filter(F.transform("relevant_laws", lambda x: x["id_Law"]), lambda x: x.isNotNull())))
    listed = F.array_join(F.transform(unique, lambda x: F.concat(F.coalesce(x["id_Law"], F.lit("?")), F.lit("#"), F.coalesce(x["id_Article"], F.lit("?")))), " | ")
    return q.select("question_id", listed.alias("labels"), F.array_join(laws, " | ").alias("laws"), F.size(F.filter("relevant_laws", lambda x: x["id_Article"] == "None")).alias("nones")).distinct()


def lost_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each law's article ids with the first ones at both ends, for five and for ten."""
    ids = F.transform("articles", lambda a: F.coalesce(a["id"], F.lit("?")))
    laws = _t(spark, sf_dir, "law_flat").where("id is not null and articles is not null").select("id", ids.alias("ids"))
    return laws.select("id", F.array_join(arrays.middle_out(F.col("ids"), 5), " ").alias("five"), F.array_join(arrays.middle_out(F.col("ids"), 10), " ").alias("ten"), F.get("ids", F.lit(0)).alias("best")).distinct()


def score_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("l_discount") * 10, F.col("l_tax") * 10
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(numeric.sigmoid(x), 6).alias("sigmoid"), F.round(numeric.softmax_second(x, y), 6).alias("softmax"), F.round(numeric.f2(F.col("l_discount"), F.col("l_tax")), 6).alias("f2"), F.round(numeric.blend(x, y, F.lit(0.3)), 6).alias("blend"))


QUERIES = {f.__name__: f for f in (normalise_text, normalise_answer, encode_decode_prefix, choices_append, prompt_render, parse_answers, label_arrays, lost_in_middle, score_functions)}

_C = f"trim(regexp_replace(text, '{SPACE}', ' ', 'g'))"
_FORM = f"regexp_replace(regexp_replace(lower(regexp_replace(answer, '^{SPACE}|{SPACE}$', '', 'g')), '{NOT_WORD}', '', 'g'), '(^|[^\\p{{L}}\\p{{N}}_])0+([0-9])', '\\1\\2', 'g')"
_KIND = "case when contains(question_id, 'TL') then 'Tự luận' when contains(question_id, 'DS') then 'Đúng/Sai' else 'Trắc nghiệm' end"
ORACLE = {
    "normalise_text": f"""select doc_id, {_C} as collapsed, case when length({_C}) <= 1 then ' ' else {_C} end as or_blank, trim(regexp_replace(lower(text), '{SPACE}', ' ', 'g')) as lowered,
        trim(regexp_replace(translate(lower(text), '-' || chr(10) || chr(9), ''), '{SPACE}', ' ', 'g')) as title, len(string_split({_C}, ' '))::int as n_tokens, length(text) > 15 as long_enough from documents where text is not null""",
    "normalise_answer": f"select distinct answer_id, {_FORM} as form from answer_qwen where answer is not null",
    "encode_decode_prefix": """with a as (select distinct law, pos, x.id as article, x.text as body from (select id as law, i - 1 as pos, articles[i] as x from (select id, articles, unnest(range(1, len(articles) + 1)) as i from law_flat)) where law is not null and x.id is not null and x.text is not null)
        select law, pos::int as pos, split_part(article || '-', '-', 1) as long_section, case when contains(article, '-') then substr(article, strpos(article, '-') + 1) || '-' else '' end || law as long_law, 'd' || pos as long_document,
        'v' || pos as long_owner, string_split(' ' || body, ']')[1] as long_body, law as short_law, article as short_article, replace(' ' || body, ']', '') as short_body from a""",
    "choices_append": """select distinct question_id, coalesce(text || ' ' || choices['A'] || '. ' || choices['B'] || '. ' || choices['C'] || '. ' || choices['D'], text) as "full",
        case when contains(question_id, 'TL') then 'essay' when contains(question_id, 'DS') then 'verdict' else 'choice' end as kind, question_type = 'Trắc nghiệm' as is_choice from question_competition""",
    "prompt_render": """with q as (select distinct question_id, text, question_type, choices, relevant_articles, coalesce(array_to_string(list_transform(relevant_articles, lambda a: 'Điều ' || a.article_id || ' ' || a.law_id), '; '), '') as cited from question_competition where text is not null),
        p as (select *, coalesce('{' || array_to_string(list_transform(list_sort(map_keys(choices)), lambda k: '''' || k || ''': ''' || choices[k] || ''''), ', ') || '}', '') as shown from q)
        select distinct question_id, case when question_type in ('Tự luận', 'Trắc nghiệm', 'Đúng/Sai') then 'Các bài viết liên quan: ' || cited || chr(10) || chr(10) || 'Câu hỏi: ' || text || chr(10) || chr(10) ||
        case question_type when 'Trắc nghiệm' then 'Lựa chọn: ' || shown || chr(10) || chr(10) || 'Chỉ có 1 đáp án đúng và chỉ cần trả lời A, B, C hoặc D, không cần giải thích' when 'Đúng/Sai' then 'Chỉ cần trả lời Đúng hoặc Sai, không cần giải thích' else 'Chỉ cần trả lời đáp án ngắn gọn nhất có thể, không cần giải thích' end end as prompt,
        'Câu hỏi: ' || text || ' Điều luật: ' || cited || ' Có liên quan:' as relevance, case when len(relevant_articles) <> 0 then 'đúng' when len(relevant_articles) = 0 then 'sai' end as verdict from p""",
    "parse_answers": f"""with a as (select distinct answer_id, answer, {_KIND} as kind, {_FORM} as form, lower(trim(answer, ' ')) as low from answer_qwen where answer is not null and question_id is not null),
        b as (select *, case when starts_with(form, 'câu trả lời') then trim(string_split(form, 'câu trả lời')[2], ' ') else form end as lead from a)
        select distinct answer_id, case when starts_with(lead, 'đúng') then 'đúng' when starts_with(lead, 'sai') then 'sai' when kind = 'Trắc nghiệm' and substr(lead, 1, 1) in ('a', 'b', 'c', 'd') then upper(substr(lead, 1, 1)) else lead end as extracted,
        case kind when 'Đúng/Sai' then case when contains(low, 'đúng') then 'Đúng' when contains(low, 'sai') then 'Sai' else answer end when 'Trắc nghiệm' then case when substr(low, 1, 1) in ('a', 'b', 'c', 'd') then upper(substr(low, 1, 1)) end else answer end as typed from b""",
    "label_arrays": """with q as (select row_number() over () as r, * from question_legacy), l as (select r, question_id, relevant_laws[i] as x, i from (select r, question_id, relevant_laws, unnest(range(1, len(relevant_laws) + 1)) as i from q)),
        f as (select r, x.id_Law as law, x.id_Article as article, min(i) as i from l where x is not null group by all),
        g as (select r, string_agg(coalesce(law, '?') || '#' || coalesce(article, '?'), ' | ' order by i) as labels from f group by r), h as (select r, string_agg(distinct law, ' | ' order by law) as laws from f where law is not null group by r),
        n as (select r, count(*) filter (where x.id_Article = 'None') as nones from l group by r)
        select distinct question_id, case when relevant_laws is null then null else coalesce(labels, '') end as labels, case when relevant_laws is null then null else coalesce(laws, '') end as laws, case when relevant_laws is null then null else coalesce(nones, 0) end::int as nones from q left join g using (r) left join h using (r) left join n using (r)""",
    "lost_in_middle": """with l as (select distinct id, list_transform(articles, lambda a: coalesce(a.id, '?')) as ids from law_flat where id is not null and articles is not null)
        select distinct id, array_to_string(list_filter([ids[1], ids[3], ids[5], ids[4], ids[2]], lambda x: x is not null), ' ') as five,
        array_to_string(list_filter([ids[2], ids[4], ids[6], ids[8], ids[10], ids[9], ids[7], ids[5], ids[3], ids[1]], lambda x: x is not null), ' ') as ten, ids[1] as best from l""",
    "score_functions": """select l_orderkey, l_linenumber, round(1 / (1 + exp(-l_discount * 10)), 6) as sigmoid, round(exp(l_tax * 10) / (exp(l_discount * 10) + exp(l_tax * 10)), 6) as softmax,
        round(case when 4 * l_discount + l_tax = 0 then 0 else 5 * l_discount * l_tax / (4 * l_discount + l_tax) end, 6) as f2, round(0.3::double * (l_discount * 10) + (1 - 0.3::double) * (l_tax * 10), 6) as blend from lineitem""",
}
