"""Queries that turn the tree-shaped laws into flat, linked tables (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawloom.operators.shred import ADJACENCY, entity_table, shred
from lawloom.plans.stage import join_unique, staged

LEVELS = {"content": ("id_Chapter", "title_Chapter"), "content_Chapter": ("id_Section", "title_Section"), "content_Section": ("id_Article", "title_Article", "content_Article")}


def _laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/law_tree.parquet")


PLACES = ("chapter_no", "section_no", "article_no")
IDS = ["id", "id_Chapter", "id_Section", "id_Article"]


def _adjacency(spark: SparkSession, sf_dir: str, scalars: list[str]) -> DataFrame:
    """The object nodes of all laws and their scalar children of these labels, shredded once."""
    laws = _laws(spark, sf_dir).select("id", "content")
    return staged(shred(laws).where((F.col("kind") == "object") | F.col("label").isin(scalars)), "adjacency")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chapter, section and article that's not a null element, by its law and its positions: the keys of the entity tables of all levels."""
    adjacency = _adjacency(spark, sf_dir, IDS)
    laws = entity_table(adjacency, None, ["id"]).select("root_id", F.col("id").alias("law_id"))
    number = [F.coalesce(F.get("ordinals", F.lit(i)), F.lit(-1)).alias(name) for i, name in enumerate(PLACES)]
    levels = [entity_table(adjacency, label, fields[:1]).select("root_id", *number) for label, fields in LEVELS.items()]
    parts = levels[0].unionByName(levels[1]).unionByName(levels[2])
    return join_unique(parts, laws, ["root_id"]).select("law_id", *PLACES).distinct()


def p4_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat article table: positions, own fields and the law's id, from the object nodes and their scalar children."""
    fields = LEVELS["content_Section"]
    adjacency = _adjacency(spark, sf_dir, ["id", *fields])
    laws = entity_table(adjacency, None, ["id"]).select("root_id", F.col("id").alias("law_id"))
    number = [F.col("ordinals")[i].alias(name) for i, name in enumerate(PLACES)]
    return join_unique(entity_table(adjacency, "content_Section", fields), laws, ["root_id"]).select("law_id", *number, *fields).distinct()


def p4_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes of each label and kind there are in all laws."""
    return shred(_laws(spark, sf_dir)).select(*ADJACENCY).groupBy("label", "kind").agg(F.count(F.lit(1)).alias("nodes"))


QUERIES = {"p4_found": p4_found, "p4_articles": p4_articles, "p4_adjacency": p4_adjacency}

_UNNEST = """
with law as (select id, content from law_tree),
chapters as (select id, i - 1 as c, content[i] as x from (select id, content, unnest(range(1, len(content) + 1)) as i from law)),
sections as (select id, c, i - 1 as s, x.content_Chapter[i] as y from (select id, c, x, unnest(range(1, len(x.content_Chapter) + 1)) as i from chapters where x is not null)),
articles as (select id, c, s, i - 1 as a, y.content_Section[i] as z from (select id, c, s, y, unnest(range(1, len(y.content_Section) + 1)) as i from sections where y is not null))
"""
ORACLE = {
    "p4_found": _UNNEST
    + """
select distinct id as law_id, c::int as chapter_no, -1 as section_no, -1 as article_no from chapters where x is not null
union all select distinct id, c::int, s::int, -1 from sections where y is not null
union all select distinct id, c::int, s::int, a::int from articles where z is not null""",
    "p4_articles": _UNNEST
    + """
select distinct id as law_id, c::int as chapter_no, s::int as section_no, a::int as article_no, z.id_Article as id_Article, z.title_Article as title_Article, z.content_Article as content_Article
from articles where z is not null""",
    "p4_adjacency": """
with law as (select row_number() over () as r, * from law_tree),
chapters as (select r, content[i] as x from (select r, content, unnest(range(1, len(content) + 1)) as i from law)),
sections as (select x.content_Chapter[i] as y from (select x, unnest(range(1, len(x.content_Chapter) + 1)) as i from chapters where x is not null)),
articles as (select y.content_Section[i] as z from (select y, unnest(range(1, len(y.content_Section) + 1)) as i from sections where y is not null)),
nodes as (
  select null as label, 'object' as kind from law
  union all select unnest(['id', 'law_name', 'title', 'scope']), unnest([case when v is null then 'null' else 'scalar' end for v in [id, law_name, title, scope]]) from law
  union all select 'content', case when content is null then 'null' else 'empty' end from law where content is null or len(content) = 0
  union all select 'content', case when x is null then 'null' else 'object' end from chapters
  union all select unnest(['id_Chapter', 'title_Chapter']), unnest([case when v is null then 'null' else 'scalar' end for v in [x.id_Chapter, x.title_Chapter]]) from chapters where x is not null
  union all select 'content_Chapter', case when x.content_Chapter is null then 'null' else 'empty' end from chapters where x is not null and (x.content_Chapter is null or len(x.content_Chapter) = 0)
  union all select 'content_Chapter', case when y is null then 'null' else 'object' end from sections
  union all select unnest(['id_Section', 'title_Section']), unnest([case when v is null then 'null' else 'scalar' end for v in [y.id_Section, y.title_Section]]) from sections where y is not null
  union all select 'content_Section', case when y.content_Section is null then 'null' else 'empty' end from sections where y is not null and (y.content_Section is null or len(y.content_Section) = 0)
  union all select 'content_Section', case when z is null then 'null' else 'object' end from articles
  union all select unnest(['id_Article', 'title_Article', 'content_Article']), unnest([case when v is null then 'null' else 'scalar' end for v in [z.id_Article, z.title_Article, z.content_Article]]) from articles where z is not null)
select label, kind, count(*) as nodes from nodes group by all""",
}
