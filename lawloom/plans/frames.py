"""Queries over leveled and paragraph corpora, training frames made from retrieval, and prompts in their documented forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawloom.functions import text
from lawloom.functions.text import SPACE
from lawloom.operators import bm25, corpus, sampling
from lawloom.operators.ranking import ranked
from lawloom.plans.stage import BROADCAST_ROWS, join_unique, staged

CANDIDATES = 50
#: Characters of the texts that are broadcast at most, about 100 MB of Vietnamese.
BROADCAST_CHARACTERS = 64_000_000


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """law_flat in the form of a leveled corpus, with the titles and scopes of the tree laws of its id; laws of which none has a title or scope have a null there."""
    listed = lambda name: F.when(F.count(name) > 0, F.array_sort(F.collect_set(name))).alias(name)
    tree = _t(spark, sf_dir, "law_tree").where("id is not null").groupBy("id").agg(listed("title"), listed("scope"))
    numbered = F.transform("articles", lambda a, i: F.struct(F.concat(F.lit("d"), i.cast("string")).alias("id"), F.concat(F.lit("v"), i.cast("string")).alias("vbpl_id"), a["id"].alias("section_number"), a["text"].alias("section_content")))
    titles = F.transform("articles", lambda a: F.substring(a["text"], 1, 40))
    laws = join_unique(_t(spark, sf_dir, "law_flat").where("id is not null").distinct(), tree, ["id"], "left")
    return laws.select(F.concat(F.lit("db-"), "id").alias("id"), F.col("id").alias("law_id"), F.struct("title", "scope", titles.alias("article_title_list"), numbered.alias("article_list")).alias("level"))


def lex_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.lex_articles(_levels(spark, sf_dir)).distinct()


def lex_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.lex_titles(_levels(spark, sf_dir))


def paragraph_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs of all flat laws with their owner written into the text, and read back."""
    paragraphs = _t(spark, sf_dir, "law_flat").select(F.col("id").alias("db_id"), F.transform("articles", lambda a: a["text"]).alias("paragraph")).where("db_id is not null")
    strings = corpus.paragraph_strings(paragraphs)
    return strings.select("text", *[c.alias(n) for n, c in text.split_bracketed(F.col("text")).items()]).distinct()


def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.label_rows(_t(spark, sf_dir, "question_legacy"), "id", "question", "relevant_laws", ["id_Law", "id_Article"], 1)


def law_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of a law as one array by paragraph, and taken apart again."""
    rows = _t(spark, sf_dir, "embedding_list").where("law_id is not null and par_no is not null and embedding is not null").groupBy("law_id", "par_no").agg(F.min("embedding").alias("v"))
    nested = rows.groupBy("law_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("par_no", "v"))), lambda x: x["v"]).alias("vectors"))
    return corpus.exploded_vectors(nested, "law_id", "vectors").select("law_id", "par_no", F.size("v").alias("n"))


def _strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(place, doc_id, law_id, article, content): the distinct strings of all articles, numbered in their order, with what is parsed from them."""
    articles = corpus.flat_articles(_t(spark, sf_dir, "law_flat")).where("law_id is not null and article is not null and content is not null")
    strings = articles.select(text.article_prefix(F.col("article"), F.col("law_id"), F.col("content")).alias("doc_id")).distinct()
    parts = text.split_article_prefix(F.col("doc_id"))
    return staged(ranked(strings, [], [F.col("doc_id")], "place").select("place", "doc_id", parts["law"].alias("law_id"), parts["article"].alias("article"), parts["body"].alias("content")), "strings")


def _candidates(strings: DataFrame, asked: DataFrame) -> DataFrame:
    """(question_id, place, score, rank): the strings that match a question with its choices best. Only their numbers travel; texts are joined where they are wanted."""
    found = bm25.bm25_ranked(strings.select(F.col("place").alias("doc_id"), F.col("doc_id").alias("text")), asked.withColumnRenamed("question_id", "query_id"), CANDIDATES)
    return found.select(F.col("query_id").alias("question_id"), F.col("doc_id").alias("place"), "score", "rank")


def _with_text(rows: DataFrame, texts: DataFrame, key: str, column: str) -> DataFrame:
    """rows joined to the texts of their key; broadcast if all texts together are short enough."""
    size = texts.agg(F.sum(F.length(column))).first()[0] or 0
    return join_unique(rows, texts, [key], small_rows=BROADCAST_ROWS if size <= BROADCAST_CHARACTERS else 0)


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, text) of the questions with their choices; of several texts of one question the smallest."""
    q = _t(spark, sf_dir, "question_competition").where("question_id is not null and text is not null")
    return q.groupBy("question_id").agg(F.min(text.with_choices(F.col("text"), F.col("choices"))).alias("text"))


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _t(spark, sf_dir, "question_competition").select("question_id", F.explode("relevant_articles").alias("x"))
    return q.select("question_id", F.col("x.law_id").alias("law_id"), F.col("x.article_id").alias("article")).where("law_id is not null and article is not null").distinct()


def train_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieved candidates as training rows: all labels among them, and as many of the others, best first; all others where there's no label.

    Candidates are stored once, as they are found, and balanced as numbers and scores; an article goes by the smallest place of its strings.
    """
    strings = _strings(spark, sf_dir)
    first = staged(strings.groupBy("law_id", "article").agg(F.min("place").alias("first")), "first")
    names = staged(join_unique(strings.select("place", "law_id", "article"), first, ["law_id", "article"], "left"), "names")
    labels = staged(join_unique(_cited(spark, sf_dir), first, ["law_id", "article"]).select("question_id", "first", F.lit(1).alias("__l")), "labels")
    found = join_unique(_candidates(strings, _asked(spark, sf_dir)), names.select("place", "first"), ["place"])
    pairs = join_unique(found, labels, ["question_id", "first"], "left").withColumn("label", F.coalesce("__l", F.lit(0))).drop("__l", "first")
    rows = join_unique(sampling.balanced(pairs, 1, stage=False), names.drop("first"), ["place"])
    return rows.select("question_id", "law_id", "article", F.round("score", 6).alias("score"), "label")


def first_label_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with the content of their first label (label 1), and with all retrieved candidates (label 0)."""
    first = _t(spark, sf_dir, "question_competition").where("question_id is not null and text is not null").select("question_id", F.get("relevant_articles", F.lit(0)).alias("x")).where("x is not null")
    first = first.groupBy("question_id").agg(F.min(F.struct(F.col("x.law_id").alias("law_id"), F.col("x.article_id").alias("article"))).alias("x")).select("question_id", "x.*")
    contents = corpus.flat_articles(_t(spark, sf_dir, "law_flat")).where("law_id is not null and article is not null")
    positives = join_unique(corpus.lookup_content(first, contents, ["law_id", "article"], None).where("content is not null"), _asked(spark, sf_dir), ["question_id"])
    rows = positives.select("question_id", text.collapse(F.col("text")).alias("query"), text.collapse(F.col("content")).alias("article"), F.lit(1).alias("label"))
    strings, asked = _strings(spark, sf_dir), staged(_asked(spark, sf_dir), "asked")
    articles = strings.select("place", text.article_prefix(F.col("article"), F.col("law_id"), F.col("content")).alias("article"))
    found = _with_text(_candidates(strings, asked).select("question_id", "place"), articles, "place", "article")
    others = _with_text(found, asked, "question_id", "text").select("question_id", F.col("text").alias("query"), "article", F.lit(0).alias("label"))
    return rows.unionByName(others)


def prompt_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with the instruction in the prompt and beside it, the numbered relevance prompt, and verdicts read back from their words."""
    q = _t(spark, sf_dir, "question_competition").where("text is not null")
    cited = F.array_join(F.transform("relevant_articles", lambda a: a["article_id"]), " ")
    kind, choices = F.col("question_type"), F.col("choices")
    label = F.when(F.size("relevant_articles") > 1, 1).when(F.size("relevant_articles") >= 0, 0)
    return q.select(
        "question_id", text.answer_prompt(cited, F.col("text"), kind, choices).alias("prompt"), text.answer_prompt(cited, F.col("text"), kind, choices, inline=False).alias("user"), text.answer_instruction(kind).alias("system"),
        text.numbered_relevance_prompt(F.col("text"), cited, kind).alias("numbered"), text.verdict_label(text.verdict_word(label)).alias("label"),
    ).distinct()


QUERIES = {f.__name__: f for f in (lex_articles, lex_titles, paragraph_decode, label_rows, law_vectors, train_frame, first_label_frame, prompt_forms)}

_COLLAPSE = "trim(regexp_replace({}, '" + SPACE.replace("{", "{{").replace("}", "}}") + "', ' ', 'g'))"
_TITLE = _COLLAPSE.format("replace(replace(replace(lower(entry), '-', ''), chr(10), ''), chr(9), '')")
_FLAT = "flat as (select distinct id as law_id, i - 1 as article_no, articles[i].id as article, articles[i].text as content, articles[i] is null as missing from (select id, articles, unnest(range(1, len(articles) + 1)) as i from (select distinct * from law_flat where id is not null)))"
_ASKED = """asked as (select question_id, min(case when choices['A'] is null or choices['B'] is null or choices['C'] is null or choices['D'] is null then text else text || ' ' || choices['A'] || '. ' || choices['B'] || '. ' || choices['C'] || '. ' || choices['D'] end) as text
  from question_competition where question_id is not null and text is not null group by question_id)"""
_CANDIDATES = f"""with {_FLAT}, {_ASKED}, docs as (select distinct '[Điều ' || article || ' ' || law_id || '] ' || content as doc from flat where article is not null and content is not null),
d as (select doc, string_split({_COLLAPSE.format('doc')}, ' ') as w from docs), size as (select count(*) as n, avg(len(w)) as mean from d), post as (select doc, term, count(*) as tf, any_value(dl) as dl from (select doc, len(w) as dl, unnest(w) as term from d) group by all),
raw as (select term, count(*) as df, ln((select n from size) - count(*) + 0.5) - ln(count(*) + 0.5) as idf from post group by term), stat as (select term, case when idf < 0 then 0.25 * (select avg(idf) from raw) else idf end as idf from raw),
q as (select question_id, term, count(*) as qf from (select question_id, unnest(string_split({_COLLAPSE.format('text')}, ' ')) as term from asked where {_COLLAPSE.format('text')} <> '') group by all),
score as (select question_id, doc, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (select mean from size)))) as score from post join q using (term) join stat using (term) group by all),
top as (select * from (select *, row_number() over (partition by question_id order by round(score, 9) desc, doc desc) as rank from score) where rank <= {CANDIDATES}),
cand as (select question_id, score, rank, array_to_string(string_split(string_split(doc, ']')[1], ' ')[3:], ' ') as law_id, string_split(string_split(doc, ']')[1], ' ')[2] as article, array_to_string(string_split(doc, ']')[2:], '') as content from top)
"""
_PRINTED = "'{' || array_to_string(list_transform(list_sort(map_entries(choices)), lambda e: '''' || e.key || ''': ''' || e.value || ''''), ', ') || '}'"
_KIND = "case question_type when 'Tự luận' then {} when 'Trắc nghiệm' then {} when 'Đúng/Sai' then {} end"
_HEAD = "'Các bài viết liên quan: ' || coalesce(cited, '') || chr(10) || chr(10) || 'Câu hỏi: ' || text || chr(10) || chr(10)"
_CHOICE = f"{_HEAD} || 'Lựa chọn: ' || coalesce({_PRINTED}, '') || chr(10) || chr(10)"
_SAID = [f"'{text.ANSWER_INSTRUCTIONS[k]}'" for k in ("Tự luận", "Trắc nghiệm", "Đúng/Sai")]
_WHOLE = [f"{head} || {said}" for head, said in zip((_HEAD, _CHOICE, _HEAD), _SAID, strict=True)]
ORACLE = {
    "lex_articles": f"with {_FLAT} select distinct law_id, '[' || article || '-' || law_id || '-d' || article_no || '@#$v' || article_no || '] ' || content as text from flat where not missing and article is not null and content is not null",
    "lex_titles": f"""with t as (select id, array_to_string(list_sort(list(distinct title)), '. ') as title, array_to_string(list_sort(list(distinct scope)), '. ') as scope from law_tree where id is not null group by id), {_FLAT},
        e as (select f.id, unnest([t.title, t.scope]) as entry from (select distinct id from law_flat where id is not null) f join t using (id) union all select law_id, substr(content, 1, 40) from flat)
        select distinct id, 'db-' || id as db_id, {_TITLE} as entry from e where entry is not null""",
    "paragraph_decode": f"with {_FLAT}, s as (select distinct '[' || law_id || ']' || {_COLLAPSE.format('content')} as text from flat where content is not null) select text, substr(string_split(text, ']')[1], 2) as owner, string_split(text, ']')[2] as body from s",
    "label_rows": "select id, question, x.id_Law as id_Law, x.id_Article as id_Article, 1 as label from (select id, question, unnest(relevant_laws) as x from question_legacy) where x is not null",
    "law_vectors": "select law_id, (row_number() over (partition by law_id order by par_no) - 1)::int as par_no, len(v)::int as n from (select law_id, par_no, min(embedding) as v from embedding_list where law_id is not null and par_no is not null and embedding is not null group by all)",
    "train_frame": f"""{_CANDIDATES}, lab as (select distinct question_id, x.law_id as law_id, x.article_id as article from (select question_id, unnest(relevant_articles) as x from question_competition) where x.law_id is not null and x.article_id is not null),
        p as (select c.*, case when l.question_id is null then 0 else 1 end as label from cand c left join lab l using (question_id, law_id, article)), s as (select question_id, sum(label) as quota from p group by question_id),
        r as (select *, row_number() over (partition by question_id, label order by rank) as place from p join s using (question_id)) select question_id, law_id, article, round(score, 6) as score, label from r where label = 1 or quota = 0 or place <= quota""",
    "first_label_frame": f"""{_CANDIDATES}, f as (select question_id, min(struct_pack(law_id := relevant_articles[1].law_id, article := relevant_articles[1].article_id)) as x from question_competition where question_id is not null and text is not null and relevant_articles[1] is not null group by question_id),
        f1 as (select law_id, article, content from (select *, row_number() over (partition by law_id, article order by article_no, content nulls last) as n from flat where article is not null) where n = 1)
        select question_id, {_COLLAPSE.format('text')} as query, {_COLLAPSE.format('content')} as article, 1 as label from f join f1 on x.law_id = f1.law_id and x.article = f1.article join asked using (question_id) where content is not null
        union all select question_id, text, '[Điều ' || article || ' ' || law_id || '] ' || content, 0 from cand join asked using (question_id)""",
    "prompt_forms": f"""with q as (select distinct *, array_to_string(list_transform(relevant_articles, lambda a: a.article_id), ' ') as cited from question_competition where text is not null)
        select distinct question_id, {_KIND.format(*_WHOLE)} as prompt, {_KIND.format(_HEAD, _CHOICE, _HEAD)} as "user", {_KIND.format(*_SAID)} as system,
        'Câu hỏi: ' || text || ' Điều luật: Điều ' || cited || '. ' || question_type || ' Có liên quan:' as numbered, case when len(relevant_articles) > 1 then 1 when len(relevant_articles) >= 0 then 0 end as label from q""",
}
