"""Queries over corpus shaping, lookups, sampling, splits and votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lawloom.config import EngineConfig
from lawloom.functions.text import SPACE, collapse, relevance_prompt, tokens, verdict_word
from lawloom.operators import corpus, metrics, sampling
from lawloom.operators.ranking import ranked
from lawloom.operators.voting import vote
from lawloom.plans.retrieval import KEYS, PREDICTED, best_first, gold, predictions
from lawloom.plans.stage import join_unique

CONFIG = EngineConfig()
N, SEED = CONFIG.negatives_per_label, CONFIG.seed


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.tree_articles(_t(spark, sf_dir, "law_tree"))


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.flat_articles(_t(spark, sf_dir, "law_flat"))


def flatten_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.article_strings(_tree(spark, sf_dir)).distinct()


def titles_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.law_titles(_t(spark, sf_dir, "law_tree"))


def titles_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.law_paragraphs(_t(spark, sf_dir, "law_tree"))


def attach_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laws with the articles of the flat corpus nested in them, counted and listed in order."""
    laws = _t(spark, sf_dir, "law_tree").select("id").where("id is not null").distinct()
    nested = corpus.attach_children(laws, _flat(spark, sf_dir).where("article is not null").select("law_id", "article_no", "article").distinct(), "id", "law_id", ["article_no"], "article_list")
    return nested.select("id", F.size("article_list").alias("n"), F.array_join(F.transform("article_list", lambda a: a["article"]), " ").alias("articles"))


def enrich_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat laws with the name, title and scope of the first tree law of their id; only those that have one."""
    first = corpus.first_by(_t(spark, sf_dir, "law_tree").where("id is not null").select("id", "law_name", "title", "scope"), ["id"], [F.col(c).asc_nulls_last() for c in ("law_name", "title", "scope")])
    return _t(spark, sf_dir, "law_flat").select("id").where("id is not null").distinct().join(first, "id")


def match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, flat = _t(spark, sf_dir, "law_tree").select("id"), _t(spark, sf_dir, "law_flat").select("id")
    have = flat.join(tree.distinct(), "id", "left_semi")
    names = ("tree_rows", "flat_rows", "matched")
    marked = [t.select(*[F.lit(int(i == k)).alias(n) for i, n in enumerate(names)]) for k, t in enumerate((tree, flat, have))]
    return marked[0].unionByName(marked[1]).unionByName(marked[2]).agg(*[F.sum(n).alias(n) for n in names])


def lookup_with_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = gold(spark, sf_dir).select("question_id", F.col(KEYS[0]).alias("law_id"), F.col(KEYS[1]).alias("article")).distinct()
    return corpus.lookup_content(labels, _flat(spark, sf_dir).where("law_id is not null and article is not null"), ["law_id", "article"]).select("question_id", "law_id", "article", "content")


def gold_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.gold_context(_t(spark, sf_dir, "question_competition").select("question_id", "relevant_articles").distinct(), _flat(spark, sf_dir).where("law_id is not null and article is not null"), 3)


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _t(spark, sf_dir, "question_legacy").select("question_id", F.explode("relevant_laws").alias("x")).where("x is not null")
    return q.select("question_id", F.col("x.id_Law").alias("law_id"), F.col("x.id_Chapter").alias("chapter"), F.col("x.id_Section").alias("section"), F.col("x.id_Article").alias("article")).distinct()


def four_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations with the content of the last article of their law, chapter, section and article."""
    keys = ["law_id", "chapter", "section", "article"]
    last = corpus.first_by(_tree(spark, sf_dir), keys, [F.col(c).desc_nulls_last() for c in ("chapter_no", "section_no", "article_no", "content")])
    return _cited(spark, sf_dir).join(last.select(*keys, "content"), keys, "left").select("question_id", *keys, "content")


def in_corpus_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions all of whose laws are in the corpus; those without labels pass."""
    questions = _t(spark, sf_dir, "question_legacy").select("question_id").distinct()
    known = _t(spark, sf_dir, "law_tree").select(F.col("id").alias("law_id")).where("law_id is not null")
    unknown = _cited(spark, sf_dir).join(known.distinct(), "law_id", "left_anti").select("question_id").distinct()
    return questions.join(unknown, "question_id", "left_anti")


def void_on_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The titles of the laws of each question, in lower case and of more than 15 characters; one missing law voids them all."""
    laws = _t(spark, sf_dir, "law_tree").where("id is not null").select(F.col("id").alias("law_id"), F.explode(F.array("law_name", "scope")).alias("entry"))
    cited = _cited(spark, sf_dir).select("question_id", "law_id").distinct()
    whole = corpus.all_found(cited, laws, "question_id", "law_id")
    return cited.join(whole, "question_id").join(laws, "law_id").where(F.length("entry") > 15).select("question_id", F.lower("entry").alias("entry")).distinct()


def none_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions by whether any citation has the text None for an article; missing lists have none."""
    some = F.coalesce(F.exists("relevant_laws", lambda x: x["id_Article"] == "None"), F.lit(False))
    return _t(spark, sf_dir, "question_legacy").select("question_id", some.alias("has_none")).distinct()


def short_content_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions none of whose labels has a content of fewer than two words."""
    short = F.exists("relevant_articles", lambda x: F.coalesce(F.size(tokens(collapse(x["article_content"]))) < 2, F.lit(True)))
    return _t(spark, sf_dir, "question_main").where(~F.coalesce(short, F.lit(False))).select("question_id").distinct()


def membership_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with their label, and their score if they're labels, 0.0001 if not."""
    labels = gold(spark, sf_dir).distinct().withColumn("__l", F.lit(1))
    joined = join_unique(predictions(spark, sf_dir), labels, ["question_id", *KEYS], "left")
    return joined.select("question_id", *KEYS, F.coalesce("__l", F.lit(0)).alias("label"), F.when(F.col("__l") == 1, F.round("score", 6)).otherwise(0.0001).alias("label_score"))


def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.hard_negatives(predictions(spark, sf_dir), gold(spark, sf_dir), KEYS, N, best_first()).select("question_id", *KEYS, "place")


def soft_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.soft_negatives(predictions(spark, sf_dir), gold(spark, sf_dir), KEYS, N, SEED).select("question_id", *KEYS, "place")


def mixed_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.mixed_negatives(predictions(spark, sf_dir), gold(spark, sf_dir), KEYS, N, SEED, best_first())


def replacement_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.replacement_negatives(predictions(spark, sf_dir), gold(spark, sf_dir), KEYS, N, SEED, best_first())


def same_law_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["chapter", "section", "article"]
    items = _tree(spark, sf_dir).where("law_id is not null and chapter is not null and section is not null and article is not null")
    labels = _cited(spark, sf_dir).where("law_id is not null")
    return sampling.same_parent_negatives(labels, items, "law_id", keys, 4, SEED).select("question_id", "law_id", *keys)


def hierarchical_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of two laws, two chapters of each, two sections of each and two articles of each."""
    levels = ["law_id", "chapter", "section", "article"]
    return sampling.nested_sample(_tree(spark, sf_dir).where(" and ".join(f"{c} is not null" for c in levels)), levels, 2, SEED)


def law_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N articles of other laws for every question and law it cites, drawn in rounds of two laws, chapters, sections and articles; articles without a content are none."""
    items = _tree(spark, sf_dir).where("content is not null")
    return sampling.foreign_negatives(_cited(spark, sf_dir), items, ["law_id", "chapter", "section", "article"], 2, N, SEED).withColumnRenamed("cited", "cited_law")


def enriched_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations with their content, N articles of other laws (soft) and up to four others of the same law (hard)."""
    place = lambda *c: F.concat_ws("#", *[F.coalesce(F.col(x).cast("string"), F.lit("?")) for x in c])
    few = lambda df, by, name, *c: df.groupBy(*by).agg(F.array_join(F.sort_array(F.collect_list(place(*c))), " ").alias(name))  # noqa: E731  at most N, or four
    soft = few(law_negatives(spark, sf_dir).withColumnRenamed("law_id", "other").withColumnRenamed("cited_law", "law_id"), ["question_id", "law_id"], "soft", "other", "chapter", "section", "article")
    hard = few(same_law_negatives(spark, sf_dir), ["question_id", "law_id"], "hard", "chapter", "section", "article")
    cited = four_key_lookup(spark, sf_dir)
    return join_unique(join_unique(cited, soft, ["question_id", "law_id"], "left"), hard, ["question_id", "law_id"], "left")


def balance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = gold(spark, sf_dir).distinct().withColumn("__l", F.lit(1))
    pairs = join_unique(predictions(spark, sf_dir), labels, ["question_id", *KEYS], "left").select("question_id", *KEYS, "score", F.coalesce("__l", F.lit(0)).alias("label"))
    return sampling.balanced(pairs, 2, order=best_first()).select("question_id", *KEYS, "label")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.first_by(_t(spark, sf_dir, "question_main").where("text is not null").select("question_id", "text"), ["question_id"], [F.col("text")])


def _prompts(spark: SparkSession, sf_dir: str, negatives: DataFrame) -> DataFrame:
    """Prompts with their verdicts: the labels that have a content as positives, then the negatives of known content."""
    pairs = gold(spark, sf_dir).distinct().withColumn("label", F.lit(1)).unionByName(negatives.withColumn("label", F.lit(0)))
    named = pairs.select("question_id", F.col(KEYS[0]).alias("law_id"), F.col(KEYS[1]).alias("article"), "label")
    found = corpus.lookup_content(named, _flat(spark, sf_dir).where("law_id is not null and article is not null"), ["law_id", "article"], None).where("content is not null")
    return found.join(_questions(spark, sf_dir), "question_id").select("question_id", "law_id", "article", relevance_prompt(F.col("text"), F.col("content")).alias("prompt"), verdict_word(F.col("label")).alias("verdict"))


def _with_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of an article that has a content: others are passed over before negatives are counted."""
    filled = corpus.first_by(_flat(spark, sf_dir).where("law_id is not null and article is not null"), ["law_id", "article"], [F.col("article_no"), F.col("content").asc_nulls_last()])
    known = filled.where("content is not null").select(F.col("law_id").alias(KEYS[0]), F.col("article").alias(KEYS[1]))
    return join_unique(predictions(spark, sf_dir), known, KEYS, "left_semi")


def train_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of the labels and of N hard negatives for each: the first predictions that are no labels and have a content."""
    return _prompts(spark, sf_dir, sampling.hard_negatives(_with_content(spark, sf_dir), gold(spark, sf_dir).distinct(), KEYS, N, best_first()).select("question_id", *KEYS))


def train_pairs_soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of the labels, N hard and N soft negatives for each, of predictions that have a content; what both draw comes once."""
    return _prompts(spark, sf_dir, sampling.mixed_negatives(_with_content(spark, sf_dir), gold(spark, sf_dir).distinct(), KEYS, 2 * N, SEED, best_first()))


def _law_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(law_id, entry): the names and scopes of all laws that have an id."""
    return _t(spark, sf_dir, "law_tree").where("id is not null").select(F.col("id").alias("law_id"), F.explode(F.array("law_name", "scope")).alias("entry"))


def _main_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, law_id, article_name) of the labels of question_main, null laws too."""
    q = _t(spark, sf_dir, "question_main").where("question_id is not null").select("question_id", F.explode("relevant_articles").alias("x"))
    return q.select("question_id", F.col("x.law_serial_number").alias("law_id"), F.col("x.article_name").alias("article_name")).distinct()


def corpus_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names and scopes, in lower case, of N laws for every question that it doesn't cite."""
    laws = _law_entries(spark, sf_dir)
    drawn = sampling.parent_negatives(_t(spark, sf_dir, "question_main"), _main_labels(spark, sf_dir), laws.select("law_id"), "law_id", N, SEED)
    return drawn.join(laws.where("entry is not null"), "law_id").select("question_id", F.lower("entry").alias("entry")).distinct()


def pair_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with the names and scopes of their laws and the names of their articles (label 1), and corpus_negatives (label 0).

    Positives have more than 15 characters; one missing law voids all of a question.
    """
    labels, laws = _main_labels(spark, sf_dir), _law_entries(spark, sf_dir)
    whole = corpus.all_found(labels, laws, "question_id", "law_id")
    entries = labels.select("question_id", "law_id").distinct().join(laws, "law_id").select("question_id", "entry").unionByName(labels.select("question_id", F.col("article_name").alias("entry")))
    return sampling.pair_frame(_questions(spark, sf_dir), entries.where(F.length("entry") > 15).join(whole, "question_id"), corpus_negatives(spark, sf_dir))


def split_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _t(spark, sf_dir, "question_main").groupBy("question_id").agg(F.max(F.greatest(F.size(F.coalesce("relevant_articles", F.array())), F.lit(0))).alias("n_labels"))
    return sampling.split_by_size(q, CONFIG.train_share, SEED)


def split_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _t(spark, sf_dir, "question_main").select("question_id", "split_name").where("question_id is not null")
    return sampling.split_by_lists(q.select("question_id").distinct(), q.where("split_name = 'test'"), q.where("split_name in ('test', 'valid')"), 500)


def keyed_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question with its first answer, by time and number, or none."""
    first = corpus.first_by(_t(spark, sf_dir, "answer_qwen").where("question_id is not null"), ["question_id"], [F.col("answered_at"), F.col("answer_id")])
    return _t(spark, sf_dir, "question_competition").select("question_id").distinct().join(first.select("question_id", "answer_id", F.col("answer").alias("first_answer")), "question_id", "left")


def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles of a tree law and of the flat law of the same id, side by side by position."""
    w = Window.partitionBy("law_id").orderBy("chapter_no", "section_no", "article_no")
    once = corpus.first_by(_tree(spark, sf_dir).where("law_id is not null"), ["law_id", "chapter_no", "section_no", "article_no"], [F.col("article").asc_nulls_last(), F.col("content").asc_nulls_last()])
    left = once.select("law_id", (F.row_number().over(w) - 1).alias("pos"), F.col("article").alias("tree_article"))
    right = corpus.first_by(_flat(spark, sf_dir).where("law_id is not null"), ["law_id", "article_no"], [F.col("article").asc_nulls_last(), F.col("content").asc_nulls_last()]).select("law_id", F.col("article_no").alias("pos"), F.col("article").alias("flat_article"))
    return left.join(right, ["law_id", "pos"])


def _three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold answers and those of three stand-in models, drawn by md5."""
    q = corpus.first_by(_t(spark, sf_dir, "question_competition").where("answer is not null"), ["question_id"], [F.col("answer")]).select("question_id", F.lower("answer").alias("gold"))
    digit = lambda m: F.conv(F.substring(F.md5(F.concat_ws("-", "question_id", F.lit(str(m)))), 1, 8), 16, 10).cast("bigint")
    given = lambda m: F.when(F.col("question_id").contains("DS"), F.when(digit(m) % 2 == 0, "đúng").otherwise("sai")).when(F.col("question_id").contains("TL"), F.when(digit(m) % 2 == 0, F.col("gold"))).otherwise(F.substring(F.lit("abcd"), (digit(m) % 4 + 1).cast("int"), F.lit(1)))
    return q.withColumn("m1", given(1)).withColumn("m2", given(2)).withColumn("m3", given(3))


def vote_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _three(spark, sf_dir).select("question_id", vote(F.col("question_id"), [F.col("m1"), F.col("m2"), F.col("m3")]).alias("voted"))


def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("question_id").contains("TL"), "essay").when(F.col("question_id").contains("DS"), "verdict").otherwise("choice")
    voted = _three(spark, sf_dir).withColumn("voted", F.lower(vote(F.col("question_id"), [F.col("m1"), F.col("m2"), F.col("m3")]))).withColumn("kind", kind)
    return metrics.accuracy(voted, F.col("voted"), F.col("gold"), ["kind"]).withColumn("accuracy", F.round("accuracy", 6))


def shuffled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All questions with their place in a fixed random order."""
    q = _t(spark, sf_dir, "question_main").where("question_id is not null").select("question_id").distinct()
    return ranked(q, [], [sampling.hash_order(SEED, F.col("question_id")), F.col("question_id")], "place")


def union_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both question tables as one frame, columns by name, missing ones null, with a literal label."""
    main = _t(spark, sf_dir, "question_main").select("question_id", "text", "split_name", F.lit(1).alias("label"))
    legacy = _t(spark, sf_dir, "question_legacy").select("question_id", F.col("question").alias("text"), "source")
    return main.unionByName(legacy, allowMissingColumns=True).select("question_id", "text", "split_name", "source", "label")


QUERIES = {
    f.__name__: f
    for f in (
        flatten_tree, titles_short, titles_long, attach_children, enrich_first, match_counts, lookup_with_sentinel, gold_context, four_key_lookup, enriched_citations, in_corpus_only, void_on_missing, none_partition, short_content_guard,
        membership_score, hard_negatives, soft_negatives, mixed_negatives, replacement_negatives, same_law_negatives, hierarchical_negatives, law_negatives, balance_pairs, train_pairs, train_pairs_soft, corpus_negatives, pair_frame, split_rule, split_by_id, keyed_first, positional_zip,
        vote_ensemble, accuracy, shuffled_rows, union_frames,
    )
}

_TREE = """tree as (select id as law_id, chapter_no, chapter, section_no, section, i - 1 as article_no, z.id_Article as article, z.title_Article as title, z.content_Article as content from (
  select id, c as chapter_no, x.id_Chapter as chapter, s as section_no, y.id_Section as section, i, y.content_Section[i] as z from (
    select id, c, x, h - 1 as s, x.content_Chapter[h] as y, unnest(range(1, len(x.content_Chapter[h].content_Section) + 1)) as i from (
      select id, j - 1 as c, content[j] as x, unnest(range(1, len(content[j].content_Chapter) + 1)) as h from (select id, content, unnest(range(1, len(content) + 1)) as j from law_tree)))) where z is not null)"""
_FLAT = "flat as (select id as law_id, i - 1 as article_no, articles[i].id as article, articles[i].text as content from (select id, articles, unnest(range(1, len(articles) + 1)) as i from law_flat) where articles[i] is not null)"
_FIRST = "f1 as (select law_id, article, content from (select *, row_number() over (partition by law_id, article order by article_no, content nulls last) as n from flat where law_id is not null and article is not null) where n = 1)"
_CITED = "cited as (select distinct question_id, x.id_Law as law_id, x.id_Chapter as chapter, x.id_Section as section, x.id_Article as article from (select question_id, unnest(relevant_laws) as x from question_legacy) where x is not null)"
_HARD = "free as (select p.* from pred p anti join gold g using (question_id, law_serial_number, article_number)), quota as (select question_id, count(*) * {n} as quota from gold group by all)"
_SOFT = "row_number() over (partition by question_id order by md5('42-' || question_id || '-' || law_serial_number || '-' || article_number))"
_HEX = "('0x' || substr({}, 1, 8))::bigint"
_ONE = "g as (select question_id, lower(min(answer)) as gold from question_competition where answer is not null group by question_id)"
_MODEL = "case when contains(question_id, 'DS') then case when {h} % 2 = 0 then 'đúng' else 'sai' end when contains(question_id, 'TL') then case when {h} % 2 = 0 then gold end else substr('abcd', ({h} % 4 + 1)::int, 1) end"
_THREE = f"with {_ONE}, m as (select *, " + ", ".join(f"{_MODEL.format(h=_HEX.format(f'md5(question_id || {chr(39)}-{k}{chr(39)})'))} as m{k}" for k in (1, 2, 3)) + " from g)"
_COUNT = lambda a: " + ".join(f"(coalesce(m{k} = '{a}', false))::int" for k in (1, 2, 3))
_VOTE = f"case when contains(question_id, 'TL') then m3 when contains(question_id, 'DS') then case when {_COUNT('đúng')} > {_COUNT('sai')} then 'đúng' else 'sai' end else case greatest({_COUNT('a')}, {_COUNT('b')}, {_COUNT('c')}, {_COUNT('d')}) when {_COUNT('a')} then 'A' when {_COUNT('b')} then 'B' when {_COUNT('c')} then 'C' else 'D' end end"
_LAWS = "laws as (select law_id, row_number() over (order by law_id) - 1 as place from (select distinct law_id from {} where law_id is not null)), size as (select count(*) as total from laws)"
_PLACES = """list_filter(list_reduce(list_transform(range(1, least({n}, total - len(taken)) + 1), lambda k: ('0x' || substr(md5('42-' || {key} || '-' || k), 1, 8))::bigint),
        lambda used, h: list_sort(list_append(used, list_reduce(used, lambda r, u: r + (u <= r)::bigint, h % (total - len(used))))), taken), lambda p: not list_contains(taken, p))"""
_NEGATIVES = f"""e as (select id as law_id, unnest([law_name, scope]) as entry from law_tree where id is not null), {_LAWS.format('e')},
        l as (select distinct question_id, x.law_serial_number as law_id, x.article_name as article_name from (select question_id, unnest(relevant_articles) as x from question_main where question_id is not null)),
        t as (select q.question_id, coalesce(taken, []::bigint[]) as taken from (select distinct question_id from question_main where question_id is not null) q left join (select question_id, list_sort(list(distinct place)) as taken from l join laws using (law_id) group by question_id) x using (question_id)),
        neg as (select distinct question_id, lower(entry) as entry from (select question_id, unnest({_PLACES.format(n=N, key='question_id')}) as place from t, size) join laws using (place) join e using (law_id) where entry is not null)"""
_CLEAN = f"trim(regexp_replace(lower({{}}), '{SPACE.replace('{', '{{').replace('}', '}}')}', ' ', 'g'))"
_TITLE = f"trim(regexp_replace(translate(lower(entry), '-' || chr(10) || chr(9), ''), '{SPACE}', ' ', 'g'))"
ORACLE = {
    "flatten_tree": f"with {_TREE} select distinct law_id, '[' || article || '-' || law_id || '] ' || content as text from tree where article is not null and law_id is not null and content is not null",
    "titles_short": f"with {_TREE}, e as (select id as law_id, unnest([title, scope]) as entry from law_tree union all select law_id, title from tree) select distinct law_id, {_TITLE} as entry from e where entry is not null and law_id is not null",
    "titles_long": f"""with {_TREE}, w as (select * from law_tree where id is not null and law_name is not null and scope is not null), c as (select id, unnest(content) as c from w), s as (select id, unnest(c.content_Chapter) as s from c), a as (select id, unnest(s.content_Section) as a from s),
        e as (select id, unnest(case when law_name = scope then [scope] else [law_name, scope] end) as entry, true as own from w union all select id, c.title_Chapter, false from c union all select id, s.title_Section, false from s union all select id, a.title_Article, false from a)
        select distinct id as law_id, lower(entry) as entry from e where own or length(entry) > 15""",
    "attach_children": f"with {_FLAT}, c as (select law_id, count(*) as n, string_agg(article, ' ' order by article_no, article) as articles from (select distinct law_id, article_no, article from flat where article is not null) group by law_id) select distinct id, coalesce(n, 0)::int as n, coalesce(articles, '') as articles from law_tree left join c on id = law_id where id is not null",
    "enrich_first": "select id, law_name, title, scope from (select *, row_number() over (partition by id order by law_name nulls last, title nulls last, scope nulls last) as n from law_tree where id is not null) semi join law_flat using (id) where n = 1",
    "match_counts": "select (select count(*) from law_tree) as tree_rows, (select count(*) from law_flat) as flat_rows, (select count(*) from law_flat where id in (select id from law_tree where id is not null)) as matched",
    "lookup_with_sentinel": f"with {PREDICTED}, {_FLAT}, {_FIRST} select distinct question_id, law_serial_number as law_id, article_number as article, coalesce(content, '-1') as content from gold left join f1 on law_serial_number = law_id and article_number = article",
    "gold_context": f"with {_FLAT}, {_FIRST}, l as (select distinct question_id, i, relevant_articles[i].law_id as law_id, relevant_articles[i].article_id as article from (select question_id, relevant_articles, unnest(range(1, least(3, len(relevant_articles)) + 1)) as i from question_competition)), c as (select question_id, string_agg(content, ' ' order by i, content) as context from l left join f1 using (law_id, article) group by question_id) select distinct question_id, coalesce(context, '') as context from question_competition left join c using (question_id)",
    "four_key_lookup": f"with {_TREE}, {_CITED}, l as (select * from (select *, row_number() over (partition by law_id, chapter, section, article order by chapter_no desc, section_no desc, article_no desc, content desc nulls last) as n from tree) where n = 1) select question_id, law_id, chapter, section, article, content from cited left join l using (law_id, chapter, section, article)",
    "in_corpus_only": f"with {_CITED} select distinct question_id from question_legacy where question_id not in (select question_id from cited where law_id is null or law_id not in (select id from law_tree where id is not null))",
    "void_on_missing": f"with {_CITED}, e as (select id as law_id, unnest([law_name, scope]) as entry from law_tree where id is not null), bad as (select question_id from cited where law_id is null or law_id not in (select law_id from e)) select distinct question_id, lower(entry) as entry from cited join e using (law_id) where question_id not in (select question_id from bad) and length(entry) > 15",
    "none_partition": "select distinct question_id, coalesce(len(list_filter(relevant_laws, lambda x: x.id_Article = 'None')) > 0, false) as has_none from question_legacy",
    "short_content_guard": f"select distinct question_id from question_main where not coalesce(len(list_filter(relevant_articles, lambda x: coalesce(len(string_split(trim(regexp_replace(x.article_content, '{SPACE}', ' ', 'g')), ' ')) < 2, true))) > 0, false)",
    "membership_score": f"with {PREDICTED}, l as (select distinct *, 1 as l from gold) select question_id, law_serial_number, article_number, coalesce(l, 0) as label, case when l = 1 then round(score, 6) else 0.0001 end as label_score from pred left join l using (question_id, law_serial_number, article_number)",
    "hard_negatives": f"with {PREDICTED}, {_HARD.format(n=N)} select question_id, law_serial_number, article_number, place::int as place from (select *, row_number() over (partition by question_id order by rank) as place from free) join quota using (question_id) where place <= quota",
    "soft_negatives": f"with {PREDICTED}, {_HARD.format(n=N)} select question_id, law_serial_number, article_number, place::int as place from (select *, {_SOFT} as place from free) join quota using (question_id) where place <= quota",
    "mixed_negatives": f"with {PREDICTED}, {_HARD.format(n=1)} select distinct question_id, law_serial_number, article_number from (select *, {_SOFT} as soft, row_number() over (partition by question_id order by rank) as hard from free) join quota using (question_id) where soft <= quota * {N // 2} or hard <= quota * {N - N // 2}",
    "replacement_negatives": f"with {PREDICTED}, {_HARD.format(n=N)}, nb as (select *, row_number() over (partition by question_id order by rank) as place, count(*) over (partition by question_id) as size from free), d as (select question_id, quota, unnest(range(1, quota + 1)) as draw from quota) select d.question_id, draw::int as draw, law_serial_number, article_number from d join nb on d.question_id = nb.question_id and place = {_HEX.format(chr(109) + 'd5(' + chr(39) + '42-' + chr(39) + ' || d.question_id || ' + chr(39) + '-' + chr(39) + ' || draw)')} % size + 1",
    "same_law_negatives": f"""with {_TREE}, {_CITED}, items as (select distinct law_id, chapter, section, article from tree where law_id is not null and chapter is not null and section is not null and article is not null),
        near as (select distinct c.question_id, i.* from (select distinct question_id, law_id from cited where law_id is not null) c join items i using (law_id)), free as (select n.* from near n anti join (select * from cited where law_id is not null) c using (question_id, chapter, section, article))
        select question_id, law_id, chapter, section, article from (select *, row_number() over (partition by question_id, law_id order by md5('42-' || question_id || '-' || law_id || '-' || chapter || '-' || section || '-' || article), chapter, section, article) as n from free) where n <= 4""",
    "hierarchical_negatives": f"""with {_TREE}, i as (select distinct law_id, chapter, section, article from tree where law_id is not null and chapter is not null and section is not null and article is not null),
        l as (select law_id from (select distinct law_id from i) order by md5('42-' || law_id), law_id limit 2),
        c as (select law_id, chapter from (select *, row_number() over (partition by law_id order by md5('42-' || law_id || '-' || chapter), chapter) as n from (select distinct law_id, chapter from i semi join l using (law_id))) where n <= 2),
        s as (select law_id, chapter, section from (select *, row_number() over (partition by law_id, chapter order by md5('42-' || law_id || '-' || chapter || '-' || section), section) as n from (select distinct law_id, chapter, section from i semi join c using (law_id, chapter))) where n <= 2)
        select law_id, chapter, section, article from (select *, row_number() over (partition by law_id, chapter, section order by md5('42-' || law_id || '-' || chapter || '-' || section || '-' || article), article) as n from (select i.* from i semi join s using (law_id, chapter, section))) where n <= 2""",
    "law_negatives": f"""with {_TREE}, {_CITED}, i as (select distinct law_id, chapter, section, article from tree where law_id is not null and content is not null), {_LAWS.format('i')},
        c as (select *, unnest(range(1, (ceil({N} / greatest(1, least(2, total - 1))))::bigint + 1)) as round from (select question_id, c.law_id as cited_law, case when place is null then []::bigint[] else [place] end as taken from (select distinct question_id, law_id from cited where law_id is not null) c left join laws using (law_id)), size),
        d as (select question_id, cited_law, round, law_id from (select question_id, cited_law, round, unnest({_PLACES.format(n=2, key="question_id || '-' || cited_law || '-' || round")}) as place from c) join laws using (place)),
        e0 as (select question_id, cited_law, round, law_id, chapter, section, article from (select *, dense_rank() over (partition by question_id, cited_law, round, law_id order by md5(concat_ws('-', '42', question_id, cited_law, round, law_id, chapter)), chapter nulls first) as n from d join i using (law_id)) where n <= 2),
        e1 as (select question_id, cited_law, round, law_id, chapter, section, article from (select *, dense_rank() over (partition by question_id, cited_law, round, law_id, chapter order by md5(concat_ws('-', '42', question_id, cited_law, round, law_id, chapter, section)), section nulls first) as n from e0) where n <= 2),
        e2 as (select question_id, cited_law, round, law_id, chapter, section, article from (select *, dense_rank() over (partition by question_id, cited_law, round, law_id, chapter, section order by md5(concat_ws('-', '42', question_id, cited_law, round, law_id, chapter, section, article)), article nulls first) as n from e1) where n <= 2),
        b as (select * from (select *, count(*) over (partition by question_id, cited_law order by round range between unbounded preceding and 1 preceding) as n from e2) where n < {N})
        select question_id, cited_law, law_id, chapter, section, article, place::int as place from (select *, row_number() over (partition by question_id, cited_law order by md5(concat_ws('-', '42', question_id, cited_law, round, law_id, chapter, section, article)), round, law_id, chapter nulls first, section nulls first, article nulls first) as place from b) where place <= {N}""",
    "balance_pairs": f"with {PREDICTED}, l as (select distinct *, 1 as l from gold), p as (select question_id, law_serial_number, article_number, rank, coalesce(l, 0) as label from pred left join l using (question_id, law_serial_number, article_number)), r as (select *, row_number() over (partition by question_id, label order by rank) as n, sum(label) over (partition by question_id) * 2 as quota from p) select question_id, law_serial_number, article_number, label from r where label = 1 or quota = 0 or n <= quota",
    "train_pairs": f"""with {PREDICTED}, {_FLAT}, {_FIRST}, lab as (select distinct * from gold), {_HARD.format(n=N).replace('from gold group', 'from lab group').replace('from pred p', 'from (select pred.* from pred join f1 on law_serial_number = law_id and article_number = article where content is not null) p')}, q as (select question_id, min(text) as text from question_main where text is not null group by question_id),
        p as (select *, 'đúng' as verdict from lab union all select question_id, law_serial_number, article_number, 'sai' from (select *, row_number() over (partition by question_id order by rank) as place from free) join quota using (question_id) where place <= quota)
        select question_id, law_id, article, 'Câu hỏi: ' || text || ' Điều luật: ' || content || ' Có liên quan:' as prompt, verdict from p join f1 on law_serial_number = law_id and article_number = article join q using (question_id) where content is not null""",
    "train_pairs_soft": f"""with {PREDICTED}, {_FLAT}, {_FIRST}, lab as (select distinct * from gold), {_HARD.format(n=N).replace('from gold group', 'from lab group').replace('from pred p', 'from (select pred.* from pred join f1 on law_serial_number = law_id and article_number = article where content is not null) p')}, q as (select question_id, min(text) as text from question_main where text is not null group by question_id),
        p as (select *, 'đúng' as verdict from lab union all select distinct question_id, law_serial_number, article_number, 'sai' from (select *, {_SOFT} as soft, row_number() over (partition by question_id order by rank) as hard from free) join quota using (question_id) where soft <= quota or hard <= quota)
        select question_id, law_id, article, 'Câu hỏi: ' || text || ' Điều luật: ' || content || ' Có liên quan:' as prompt, verdict from p join f1 on law_serial_number = law_id and article_number = article join q using (question_id) where content is not null""",
    "corpus_negatives": f"with {_NEGATIVES} select * from neg",
    "pair_frame": f"""with {_NEGATIVES}, q as (select question_id, min(text) as text from question_main where text is not null group by question_id), bad as (select question_id from l where law_id is null or law_id not in (select law_id from laws)),
        pos as (select question_id, entry from (select distinct question_id, law_id from l) join e using (law_id) union all select question_id, article_name from l),
        p as (select question_id, entry, 1 as label from pos where length(entry) > 15 and question_id not in (select question_id from bad) union all select question_id, entry, 0 from neg)
        select distinct question_id, {_CLEAN.format('text')} as query, {_CLEAN.format('entry')} as article, label from q join p using (question_id)""",
    "split_rule": "with q as (select question_id, max(coalesce(len(relevant_articles), 0))::int as n_labels from question_main group by question_id), t as (select question_id, row_number() over (order by md5('42-' || question_id), question_id) as n from q where n_labels <= 2) select question_id, n_labels, case when n <= trunc((select count(*) from q) * (1 - 0.8::double)) then 'test' else 'train' end as split from q left join t using (question_id)",
    "split_by_id": "select question_id, case when bool_or(split_name = 'test') then 'test-1' when bool_or(split_name = 'valid') then 'test-2' when question_id <= 500 then 'train-1' else 'train-2' end as split from question_main where question_id is not null group by question_id",
    "keyed_first": "select question_id, answer_id, answer as first_answer from (select distinct question_id from question_competition) left join (select * from (select *, row_number() over (partition by question_id order by answered_at nulls first, answer_id) as n from answer_qwen where question_id is not null) where n = 1) using (question_id)",
    "positional_zip": f"with {_TREE}, {_FLAT}, a as (select *, row_number() over (partition by law_id, chapter_no, section_no, article_no order by article nulls last, content nulls last) as n from tree where law_id is not null), l as (select law_id, row_number() over (partition by law_id order by chapter_no, section_no, article_no) - 1 as pos, article as tree_article from a where n = 1), r as (select law_id, article_no as pos, article as flat_article from (select *, row_number() over (partition by law_id, article_no order by article nulls last, content nulls last) as n from flat where law_id is not null) where n = 1) select law_id, pos::int as pos, tree_article, flat_article from l join r using (law_id, pos)",
    "vote_ensemble": f"{_THREE} select question_id, {_VOTE} as voted from m",
    "accuracy": f"{_THREE}, v as (select gold, lower({_VOTE}) as voted, case when contains(question_id, 'TL') then 'essay' when contains(question_id, 'DS') then 'verdict' else 'choice' end as kind from m) select kind, count(*) as rows, count(*) filter (where voted = gold) as correct, round(count(*) filter (where voted = gold) * 100.0::double / count(*), 6) as accuracy from v group by kind",
    "shuffled_rows": "select question_id, (row_number() over (order by md5('42-' || question_id), question_id))::int as place from (select distinct question_id from question_main where question_id is not null)",
    "union_frames": "select question_id, text, split_name, null::varchar as source, 1 as label from question_main union all select question_id, question, null, source, null from question_legacy",
}
_PLACES = "coalesce(chapter, '?') || '#' || coalesce(section, '?') || '#' || coalesce(article, '?')"
ORACLE["enriched_citations"] = f"""select f.*, s.soft, h.hard from ({ORACLE['four_key_lookup']}) f
    left join (select question_id, cited_law, string_agg(p, ' ' order by p) as soft from (select question_id, cited_law, coalesce(law_id, '?') || '#' || {_PLACES} as p from ({ORACLE['law_negatives']})) group by all) s on f.question_id = s.question_id and f.law_id = s.cited_law
    left join (select question_id, law_id, string_agg(p, ' ' order by p) as hard from (select question_id, law_id, {_PLACES} as p from ({ORACLE['same_law_negatives']})) group by all) h on f.question_id = h.question_id and f.law_id = h.law_id"""
