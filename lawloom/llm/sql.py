"""SQL that gives the same rows as the query of the same name."""

_P1 = """
select question_id, article_db_id, score, rank from (
  select *, row_number() over (partition by question_id order by score desc, try_cast(article_db_id as decimal(38,0)) nulls last, article_db_id) as rank from (
    select question_id, article_db_id, max(score) as score from predict_relevant_article
    where question_id is not null and article_db_id is not null and score is not null and not isnan(score) group by all))
where rank <= 10"""

_P7 = """
select distinct origin, law_id, chapter_no, section_no, article_no{more} from (
  select 'law_tree' as origin, id as law_id, c as chapter_no, s as section_no, (i - 1)::int as article_no, y.content_Section[i].content_Article as t from (
    select id, c, (h - 1)::int as s, x.content_Chapter[h] as y, unnest(range(1, len(x.content_Chapter[h].content_Section) + 1)) as i from (
      select id, (j - 1)::int as c, content[j] as x, unnest(range(1, len(content[j].content_Chapter) + 1)) as h from (
        select id, content, unnest(range(1, len(content) + 1)) as j from law_tree)))
  union all
  select 'law_flat', id, -1, -1, (i - 1)::int, articles[i].text from (select id, articles, unnest(range(1, len(articles) + 1)) as i from law_flat))
where length(t) > 1200"""

ORACLE = {
    "p1_found": f"select question_id, article_db_id from ({_P1})",
    "p1_ranked": f"select question_id, article_db_id, score, rank::int as rank from ({_P1})",
    "p1_hot": f"select question_id, article_db_id, score, rank::int as rank from ({_P1})",
    "p2_shares": "select unnest(['train', 'valid', 'test']) as split, true as near_share, 0 as divided_groups",
    "p7_found": _P7.format(more=""),
    "p7_rules": _P7.format(more=", length(t) as n, true as within_size, true as within_overlap, true as same_text"),
    "p10_counts": "select distinct doc_id, length(coalesce(text, ''))::int as n_chars, len(list_filter(string_split_regex(coalesce(text, ''), '[\\n\\r\\x{85}\\x{2028}\\x{2029}]'), lambda x: regexp_matches(x, '[^\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]')))::int as n_lines from documents",
}
