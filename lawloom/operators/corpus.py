"""Nesting, flattening and enriching of law corpora, and the lookups that questions make in them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lawloom.functions.text import bracketed, joined_sentences, law_prefix, title_form


def tree_articles(tree: DataFrame) -> DataFrame:
    """(law_id, chapter, section, article, title, content, chapter_no, section_no, article_no) of all articles that aren't null elements; one scan, no shuffle."""
    rows = tree.select(F.col("id").alias("law_id"), F.posexplode("content").alias("chapter_no", "c"))
    rows = rows.select("law_id", "chapter_no", F.col("c.id_Chapter").alias("chapter"), F.posexplode("c.content_Chapter").alias("section_no", "s"))
    rows = rows.select("law_id", "chapter_no", "chapter", "section_no", F.col("s.id_Section").alias("section"), F.posexplode("s.content_Section").alias("article_no", "a"))
    return rows.where("a is not null").select("law_id", "chapter", "section", F.col("a.id_Article").alias("article"), F.col("a.title_Article").alias("title"), F.col("a.content_Article").alias("content"), "chapter_no", "section_no", "article_no")


def flat_articles(flat: DataFrame) -> DataFrame:
    """(law_id, article, content, article_no) of a flat corpus."""
    return flat.select(F.col("id").alias("law_id"), F.posexplode("articles").alias("article_no", "a")).where("a is not null").select("law_id", F.col("a.id").alias("article"), F.col("a.text").alias("content"), "article_no")


def attach_children(parents: DataFrame, children: DataFrame, key: str, child_key: str, order: Sequence[str], into: str) -> DataFrame:
    """parents with an array column of their children in order, appended to what the column holds already; no child gives an empty array."""
    fields = [c for c in children.columns if c != child_key]
    grouped = children.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).cast("string").alias("__key")).agg(F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias("__new"))
    joined = parents.join(grouped, parents[key].cast("string") == F.col("__key"), "left")
    new = F.coalesce("__new", F.array().cast(grouped.schema["__new"].dataType))
    combined = F.concat(F.coalesce(F.col(into), F.array().cast(grouped.schema["__new"].dataType)), new) if into in parents.columns else new
    return joined.withColumn(into, combined).drop("__key", "__new")


def first_by(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def lookup_content(wanted: DataFrame, articles: DataFrame, keys: Sequence[str], missing: str | None = "-1") -> DataFrame:
    """wanted with the content of the first article of its keys, compared as text; the sentinel where there's none or it is null."""
    first = first_by(articles.select(*[F.col(k).cast("string").alias(k) for k in keys], "content", "article_no"), keys, [F.col("article_no"), F.col("content").asc_nulls_last()]).drop("article_no")
    joined = wanted.join(first, list(keys), "left")
    return joined if missing is None else joined.withColumn("content", F.coalesce("content", F.lit(missing)))


def article_strings(articles: DataFrame) -> DataFrame:
    """(law_id, text) in the form "[article-law] content"; articles without an id or content are dropped."""
    return articles.select("law_id", F.concat(F.lit("["), "article", F.lit("-"), "law_id", F.lit("] "), "content").alias("text")).where("text is not null")


def law_titles(tree: DataFrame) -> DataFrame:
    """(law_id, entry) of a law's distinct titles in their short form: its title and scope, then all article titles."""
    titles = tree_articles(tree).select("law_id", F.col("title").alias("entry"))
    own = tree.select(F.col("id").alias("law_id"), F.explode(F.array("title", "scope")).alias("entry"))
    return own.unionByName(titles).where("entry is not null and law_id is not null").select("law_id", title_form(F.col("entry")).alias("entry")).distinct()


def law_paragraphs(tree: DataFrame, least: int = 15) -> DataFrame:
    """(law_id, entry): the scope, with the name unless they are equal, then all titles of more than `least` characters, in lower case; a law without name or scope has none."""
    whole = tree.where("id is not null and law_name is not null and scope is not null")
    own = whole.select(F.col("id").alias("law_id"), F.explode(F.when(F.col("law_name") == F.col("scope"), F.array("scope")).otherwise(F.array("law_name", "scope"))).alias("entry"))
    chapters = whole.select("id", F.explode("content").alias("c"))
    sections = chapters.select("id", F.explode("c.content_Chapter").alias("s"))
    articles = sections.select("id", F.explode("s.content_Section").alias("a"))
    titles = [t.select(F.col("id").alias("law_id"), F.col(c).alias("entry")) for t, c in ((chapters, "c.title_Chapter"), (sections, "s.title_Section"), (articles, "a.title_Article"))]
    long = titles[0].unionByName(titles[1]).unionByName(titles[2]).where(F.length("entry") > least)
    return own.unionByName(long).select("law_id", F.lower("entry").alias("entry")).distinct()


def gold_context(questions: DataFrame, articles: DataFrame, k: int, compat: bool = False) -> DataFrame:
    """(question_id, context): the contents of a question's first k labels in order, joined by a space; compat takes k - 1."""
    taken = k - 1 if compat else k
    labels = questions.select("question_id", F.posexplode("relevant_articles").alias("pos", "x")).where(F.col("pos") < taken)
    labels = labels.select("question_id", "pos", F.col("x.law_id").alias("law_id"), F.col("x.article_id").alias("article")).distinct()
    found = lookup_content(labels, articles, ["law_id", "article"], None)
    listed = found.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("pos", "content"))).alias("x"))
    context = F.array_join(F.filter(F.transform("x", lambda e: e["content"]), lambda c: c.isNotNull()), " ")
    return questions.select("question_id").distinct().join(listed.select("question_id", context.alias("context")), "question_id", "left").withColumn("context", F.coalesce("context", F.lit("")))


def all_found(labels: DataFrame, known: DataFrame, group: str, key: str) -> DataFrame:
    """The groups all of whose keys are known."""
    missing = labels.join(known.select(key).distinct().withColumn("__known", F.lit(1)), key, "left").groupBy(group).agg(F.min(F.coalesce("__known", F.lit(0))).alias("all"))
    return missing.where("all = 1").select(group)


def lex_articles(levels: DataFrame) -> DataFrame:
    """(law_id, text) of the articles of a leveled corpus, "[section-law-id@#$document] content"; articles without an id, number or content are dropped."""
    rows = levels.select("law_id", F.explode("level.article_list").alias("a")).where("a is not null")
    return rows.select("law_id", law_prefix(F.col("a.section_number"), F.col("law_id"), F.col("a.id"), F.col("a.vbpl_id"), F.col("a.section_content")).alias("text")).where("text is not null")


def lex_titles(levels: DataFrame) -> DataFrame:
    """(id, db_id, entry) of a leveled corpus: its titles and its scopes, each as one text, and the article titles, in their short form, each once."""
    listed = F.concat(F.array(joined_sentences(F.col("level.title")), joined_sentences(F.col("level.scope"))), F.coalesce("level.article_title_list", F.array().cast("array<string>")))
    rows = levels.select(F.col("law_id").alias("id"), F.col("id").alias("db_id"), F.explode(listed).alias("entry")).where("entry is not null")
    return rows.select("id", "db_id", title_form(F.col("entry")).alias("entry")).distinct()


def paragraph_strings(paragraphs: DataFrame) -> DataFrame:
    """(db_id, text) of every paragraph of a paragraph corpus (db_id, paragraph array), "[db_id]text"; null paragraphs are dropped."""
    rows = paragraphs.select("db_id", F.explode("paragraph").alias("p")).where("p is not null")
    return rows.select("db_id", bracketed(F.col("db_id"), F.col("p")).alias("text"))


def label_rows(questions: DataFrame, key: str, text: str, labels: str, fields: Sequence[str], label: int) -> DataFrame:
    """(id, question, fields, label): one row for each label of a question that isn't null, in the pair format of CSV files."""
    rows = questions.select(F.col(key).alias("id"), F.col(text).alias("question"), F.explode(labels).alias("x")).where("x is not null")
    return rows.select("id", "question", *[F.col(f"x.{f}").alias(f) for f in fields], F.lit(label).alias("label"))


def exploded_vectors(rows: DataFrame, key: str, vectors: str) -> DataFrame:
    """(key, par_no, v) of an array of vectors by paragraph, as retrieval by paragraph wants them; null vectors keep their position and are dropped."""
    return rows.select(key, F.posexplode(vectors).alias("par_no", "v")).where("v is not null")
