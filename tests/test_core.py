"""Edge cases of the core operators on hand-written rows, and pure-Python restatements on random ones."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lawloom.functions import arrays, numeric, text
from lawloom.operators import bm25, corpus, dense, metrics, sampling
from lawloom.operators.ranking import ranked, with_range
from lawloom.operators.scorers import answer, encode, score_pairs
from lawloom.operators.shred import ADJACENCY, entity_table, ordinals, shred
from lawloom.operators.voting import vote
from lawloom.plans import is_small, join_unique, release, scope, spread_out, staged
from lawloom.sources import io, schemas

TREE = "id string, content array<struct<id_Chapter:string, content_Chapter:array<struct<id_Section:string>>>>, label string, node int"


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def one(spark, column, **row):
    df = spark.range(1).select(*[(F.lit(v) if not isinstance(v, dict) else F.create_map(*[F.lit(x) for kv in v.items() for x in kv])).alias(k) for k, v in row.items()]) if row else spark.range(1)
    return df.select(column.alias("x")).first()[0]


# --- shredding


def test_shred_keeps_every_part_and_makes_up_none(spark):
    rows = [
        ("a", [("c0", [("s0",), None]), None, ("c2", []), ("c3", None)], "clash", 7),
        ("a", [("c0", [("s0",), None]), None, ("c2", []), ("c3", None)], "clash", 7),
        (None, None, None, None),
        ("", [], "x", 0),
    ]
    adjacency = shred(spark.createDataFrame(rows, TREE))
    assert tuple(adjacency.columns) == ADJACENCY
    nodes = adjacency.distinct()
    assert nodes.where("label = 'content' and kind = 'object'").count() == 3
    assert nodes.where("label = 'content' and kind = 'null'").count() == 2  # one element, one list
    assert nodes.where("label = 'content' and kind = 'empty'").count() == 1
    assert nodes.where("label = 'content_Chapter'").groupBy("kind").count().orderBy("kind").collect() == [("empty", 1), ("null", 2), ("object", 1)]
    chapters = entity_table(adjacency, "content", ["id_Chapter"])
    assert values(chapters, "ordinals", "id_Chapter") == [([0], "c0"), ([2], "c2"), ([3], "c3")]
    assert values(entity_table(adjacency, None, ["id", "node", "label"]), "id", "field_node", "label") == [("", "0", "x"), ("a", "7", "clash"), (None, None, None)]
    sections = entity_table(adjacency, "content_Chapter", ["id_Section"]).select("root_id", F.col("parent").alias("node"), "id_Section")
    assert values(sections.join(chapters.select("root_id", "node", "id_Chapter"), ["root_id", "node"]), "id_Chapter", "id_Section") == [("c0", "s0")]


def test_shred_of_maps_lists_in_lists_and_empty_tables(spark):
    df = spark.createDataFrame([({"k": 1, "l": None}, [[1, None], [], None])], "m map<string,int>, n array<array<int>>")
    adjacency = shred(df)
    assert values(adjacency.where("parent = '$.m'"), "label", "kind", "scalar") == [("k", "scalar", "1"), ("l", "null", None)]
    assert values(adjacency.where("label = 'n'"), "node", "kind") == [("$.n[0]", "list"), ("$.n[0][0]", "scalar"), ("$.n[0][1]", "null"), ("$.n[1]", "list"), ("$.n[2]", "null")]
    assert shred(df.where("false")).count() == 0
    assert one(spark, ordinals(F.lit("$.a[3].b[0]"))) == [3, 0]


def test_shred_round_trip(spark):
    rng = random.Random(4)
    maybe = lambda make, p=0.2: None if rng.random() < p else make()
    rows = [(f"l{i}", maybe(lambda: [maybe(lambda: (maybe(lambda: f"c{rng.random()}"), maybe(lambda: [maybe(lambda: (maybe(lambda: "s"),)) for _ in range(rng.randrange(3))]))) for _ in range(rng.randrange(4))]), None, None) for i in range(40)]
    nodes = {(r.root_id, r.node): r for r in shred(spark.createDataFrame(rows, TREE)).collect()}
    children: dict = {}
    for r in nodes.values():
        children.setdefault((r.root_id, r.parent), []).append(r)

    def field(root, parent, label):
        found = [r for r in children.get((root, parent), []) if r.label == label]
        if len(found) == 1 and found[0].ordinal == -1:
            return [] if found[0].kind == "empty" else found[0].scalar if found[0].kind == "scalar" else None
        return sorted(found, key=lambda r: r.ordinal)

    def rebuilt(root):
        chapters = field(root, "$", "content")
        if chapters is not None:
            chapters = [None if c.kind == "null" else (field(root, c.node, "id_Chapter"), (lambda s: s if s is None else [None if x.kind == "null" else (field(root, x.node, "id_Section"),) for x in s])(field(root, c.node, "content_Chapter"))) for c in chapters]
        return (field(root, "$", "id"), chapters, None, None)

    assert sorted(map(repr, {r.root_id: rebuilt(r.root_id) for r in nodes.values()}.values())) == sorted(map(repr, rows))


# --- text


@pytest.mark.parametrize(("given", "wanted"), [("**Trong 01 năm**", "trong 1 năm"), ("Đúng 1.05", "đúng 105"), ("00", "0"), ("½", "½"), ("  a  b ", "a  b")])
def test_answer_form(spark, given, wanted):
    assert one(spark, text.answer_form(F.lit(given))) == wanted


def test_collapse_agrees_with_python(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \n\t\x1c  \u0085đ") for _ in range(rng.randrange(12))) for _ in range(200)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.collapse(F.col("t")).alias("c")).collect()
    assert all(r.c == " ".join(r.t.split()) for r in got)


def test_prefixes(spark):
    long = text.law_prefix(F.lit("5"), F.lit("1/a-b-c"), F.lit("d1"), F.lit("v1"), F.lit("x ] y"))
    parts = text.split_law_prefix(long)
    assert [one(spark, parts[k]) for k in ("section", "law", "document", "owner", "body")] == ["5", "1/a-b-c", "d1", "v1", " x "]
    short = text.split_article_prefix(text.article_prefix(F.lit("5"), F.lit("A B"), F.lit("x ] y")))
    assert [one(spark, short[k]) for k in ("law", "article", "body")] == ["A B", "5", " x  y"]


def test_choices_and_prompts(spark):
    full = {"A": "1", "B": "2", "C": "3", "D": "4"}
    assert one(spark, text.with_choices(F.lit("q"), F.col("c")), c=full) == "q 1. 2. 3. 4"
    assert one(spark, text.with_choices(F.lit("q"), F.col("c")), c={"A": "1"}) == "q"
    assert one(spark, text.printed_choices(F.col("c")), c={"B": "y", "A": "x"}) == "{'A': 'x', 'B': 'y'}"
    assert one(spark, text.verdict_word(F.lit(3))) == "đúng"


def test_answers(spark):
    assert one(spark, text.typed_answer(F.lit("đúng hay sai"), F.lit("Đúng/Sai"))) == "Đúng"
    assert one(spark, text.typed_answer(F.lit("b) x"), F.lit("Trắc nghiệm"))) == "B"
    assert one(spark, text.typed_answer(F.lit("x"), F.lit("Trắc nghiệm"))) is None
    with pytest.raises(Exception, match="no choice"):
        one(spark, text.typed_answer(F.lit("x"), F.lit("Trắc nghiệm"), strict=True))
    assert one(spark, text.extracted_answer(F.lit("Câu trả lời: Đúng. Câu trả lời"), F.lit("x"))) == "đúng"


# --- numbers and arrays


def test_scales(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", 2.0), ("c", None)], "g string, x double")
    x, low, high = F.col("x"), F.col("x_low"), F.col("x_high")
    got = with_range(df, ["g"], x="x").select("g", "x", numeric.min_max(x, low, high).alias("p"), numeric.min_max_eps(x, low, high).alias("e"), numeric.min_max_ones(x, low, high).alias("o"))
    rows = {(r.g, r.x): (r.p, r.e and round(r.e, 3), r.o and round(r.o, 3)) for r in got.collect()}
    assert rows[("a", 3.0)] == (1.0, 1.0, 1.0)
    assert rows[("b", 2.0)] == (-1.0, 0.0, 1.0)
    assert rows[("c", None)] == (None, None, None)
    assert one(spark, numeric.f2(F.lit(0.0), F.lit(0.0))) == 0.0
    assert one(spark, numeric.usable(F.lit(float("nan")))) is None


def test_arrays(spark):
    items = F.from_json(F.lit('[{"a":1,"b":1},{"a":1,"b":2},null,{"a":null,"b":3},{"a":null,"b":4}]'), "array<struct<a:int,b:int>>")
    assert [r["b"] for r in one(spark, arrays.distinct_by(items, ["a"]))] == [1, 3]
    ranks = F.sequence(F.lit(0), F.lit(9))
    assert one(spark, arrays.middle_out(ranks, 5)) == [0, 2, 4, 3, 1]
    assert one(spark, arrays.middle_out(ranks, 10)) == [1, 3, 5, 7, 9, 8, 6, 4, 2, 0]


# --- retrieval


def test_bm25_blank_queries_padding_and_ties(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d"), (3, ""), (4, None), (5, "c e")], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "a"), (2, " "), (3, None), (4, "zz")], "query_id int, text string")
    found, ranges = bm25.bm25_search(docs, asked, 3)
    best = bm25.top_k(bm25.padded(found, ranges, docs, asked, 3), 3)
    assert values(best.select("query_id", "doc_id", "rank"), "query_id", "rank", "doc_id") == [(1, 1, 1), (1, 2, 5), (1, 3, 3), (4, 1, 5), (4, 2, 3), (4, 3, 2)]
    assert values(ranges, "query_id", "n") == [(1, 1)]
    assert bm25.bm25_search(docs.where("false"), asked, 3)[0].count() == 0 and bm25.bm25_search(docs, asked.where("false"), 3)[0].count() == 0


def test_bm25_best_of_many_ties_and_blocks(spark):
    rng = random.Random(6)
    docs = [(k, " ".join(rng.choice("abcdefg") for _ in range(rng.choice([1, 1, 2, 9])))) for k in range(400)]
    asked = [(f"q{k}", " ".join(rng.choice("abcdefghi") for _ in range(3))) for k in range(12)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "query_id string, text string")
    every, ranges = bm25.bm25_search(d, q, 1000)
    wanted = {}
    for r in every.collect():
        wanted.setdefault(r.query_id, []).append((-round(r.score, 9), -r.doc_id))
    few, same = bm25.bm25_search(d.repartition(3), q, 5, block_terms=7)
    got = {}
    for r in few.collect():
        got.setdefault(r.query_id, []).append((-round(r.score, 9), -r.doc_id))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:5] for k, v in wanted.items()}
    assert {(r.query_id, r.n, round(r.low, 9), round(r.high, 9)) for r in same.collect()} == {(k, len(v), -max(v)[0], -min(v)[0]) for k, v in wanted.items()}
    assert values(ranges, "query_id", "n") == values(same, "query_id", "n")


def test_bm25_formula(spark):
    docs = {1: "x y y", 2: "x", 3: "z z", 4: "w"}
    got = {(r.query_id, r.doc_id): r.score for r in bm25.bm25_search(spark.createDataFrame(list(docs.items()), "doc_id int, text string"), spark.createDataFrame([(1, "y y x")], "query_id int, text string"), 9)[0].collect()}
    from math import log

    n, words = len(docs), {k: v.split() for k, v in docs.items()}
    mean = sum(map(len, words.values())) / n
    df = {t: sum(t in w for w in words.values()) for t in "xyzw"}
    idf = {t: log(n - f + 0.5) - log(f + 0.5) for t, f in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: floor if v < 0 else v for t, v in idf.items()}
    for d in (1, 2):
        want = sum(idf[t] * words[d].count(t) * 2.5 / (words[d].count(t) + 1.5 * (0.25 + 0.75 * len(words[d]) / mean)) for t in "yyx")
        assert got[1, d] == pytest.approx(want)


def test_cosine_against_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    items = [(i, rng.choice(["a", "b", "c", None]), rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(90)]
    items = [(i, g, v) for i, g, v in items if any(v)]
    asked = items[::7]
    df = spark.createDataFrame(items, "pos int, g string, v array<double>")
    queries = spark.createDataFrame([(i, v) for i, _, v in asked], "query_id int, v array<double>")
    cosine = lambda a, b: round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 6)
    for block in (4, 1000):
        got = dense.cosine_best(df.repartition(3), queries, "pos", 4, digits=6, apart="pos", block_queries=block)
        assert values(got, "query_id", "rank", "pos") == sorted(((q, k, i) for q, _, v in asked for k, (_, i) in enumerate(sorted((-cosine(v, w), i) for i, _, w in items if i != q)[:4], 1)), key=repr)
        got = dense.cosine_best(df.repartition(3), queries, "g", 2, digits=6, block_queries=block)
        pooled = {q: sorted((-max(cosine(v, w) for _, h, w in items if h == g), g) for g in "abc")[:2] for q, _, v in asked}
        assert values(got, "query_id", "rank", "g") == sorted(((q, k, g) for q, best in pooled.items() for k, (_, g) in enumerate(best, 1)), key=repr)
    got = {}
    for r in dense.pooled_runs(df.where("g is not null").repartition(3), queries, "g", "pos", 1000).collect():
        got.setdefault(r.query_id, []).append((r.g, round(r.similarity, 6)))
    mine = [r for r in items if r[1]][:-1]
    for q, _, v in asked:
        want = [("-1", 0.0)]
        for k, (_, g, w) in enumerate(mine):
            if k and mine[k - 1][1] == g:
                want[-1] = (g, max(want[-1][1], cosine(v, w)))
            else:
                want.append((g, cosine(v, w)))
        assert sorted(got[q]) == sorted(want)
    assert dense.cosine_best(df.where("false"), queries, "pos", 3).count() == 0


def test_ranks_of_hot_groups(spark):
    rng = random.Random(8)
    data = [(rng.choice([1, 1, 1, 1, 2, 3, None]), rng.randrange(50), k) for k in range(900)]
    df = spark.createDataFrame(data, "g int, s int, k int")
    got = ranked(df, ["g"], [F.col("s").desc(), F.col("k")])
    wanted = sorted(((g, n, k) for group in {r[0] for r in data} for n, (g, _, k) in enumerate(sorted((r for r in data if r[0] == group), key=lambda r: (-r[1], r[2])), 1)), key=repr)
    assert values(got, "g", "rank", "k") == wanted
    assert ranked(df.where("false"), ["g"], [F.col("k")]).count() == 0


def test_logits(spark):
    assert one(spark, numeric.argmax(F.array(F.lit(0.1), F.lit(0.9), F.lit(0.9)))) == 1 and one(spark, numeric.argmax(F.lit(None).cast("array<double>"))) is None
    assert one(spark, numeric.token_probability(F.array(F.lit(0.0), F.lit(1000.0)), 1)) == 1.0 and one(spark, numeric.token_probability(F.array(F.lit(0.0), F.lit(0.0)), F.lit(0))) == 0.5
    rows = spark.createDataFrame([([0.0, 1.0], 1), ([1.0, 0.0], 1), ([0.0, 0.0], 0), (None, 1)], "l array<double>, y int")
    got = metrics.classification(rows, F.col("l"), F.col("y")).first()
    assert (got.rows, got.accuracy, got.tp, got.fp, got.fn, got.tn) == (4, 0.5, 1, 0, 2, 1)


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "question_id int, k string, rank int")
    labels = spark.createDataFrame([(1, "b"), (1, "b"), (1, "x"), (2, "c"), (3, "y")], "question_id int, k string")
    got = {r.k: (r.micro, round(r.macro, 6)) for r in metrics.recall_at(ranked, labels, ["k"], [1, 2, 5]).collect()}
    assert got == {1: (0.2, round(1 / 3, 6)), 2: (0.6, round((2 / 3 + 1) / 3, 6)), 5: (0.6, round((2 / 3 + 1) / 3, 6))}
    hit = metrics.hit_over_labels(ranked, labels, ["k"]).first()
    assert (hit.number_label, hit.number_true, hit.recall) == (5, 2, 0.6)
    assert metrics.accuracy(spark.createDataFrame([("a", "a"), (None, "b")], "g string, t string"), F.col("g"), F.col("t")).first().accuracy == 50.0


# --- corpora, sampling, votes


def test_attach_and_lookup(spark):
    parents = spark.createDataFrame([("5",), ("6",)], "id string")
    children = spark.createDataFrame([(5, 1, "b"), (5, 0, "a"), (None, 0, "z")], "owner int, pos int, t string")
    got = corpus.attach_children(parents, children, "id", "owner", ["pos"], "list")
    assert values(got, "id", "list") == [("5", [(0, "a"), (1, "b")]), ("6", [])]
    articles = spark.createDataFrame([("l", "1", "first", 0), ("l", "1", "second", 1), ("l", "2", None, 2)], "law_id string, article string, content string, article_no int")
    wanted = spark.createDataFrame([("l", "1"), ("l", "2"), ("m", "1")], "law_id string, article string")
    assert values(corpus.lookup_content(wanted, articles, ["law_id", "article"]), "law_id", "article", "content") == [("l", "1", "first"), ("l", "2", "-1"), ("m", "1", "-1")]


def test_sampling(spark):
    ranked = spark.createDataFrame([(1, f"i{k}", k) for k in range(1, 9)] + [(2, "j", 1)], "question_id int, item string, rank int")
    labels = spark.createDataFrame([(1, "i2"), (1, "i9"), (2, "j")], "question_id int, item string")
    hard = sampling.hard_negatives(ranked, labels, ["item"], 2)
    assert [r.item for r in hard.orderBy("place").collect()] == ["i1", "i3", "i4", "i5"]
    soft = sampling.soft_negatives(ranked, labels, ["item"], 2, 42)
    assert soft.count() == 4 and not {r.item for r in soft.collect()} & {"i2"}
    draws = sampling.replacement_negatives(ranked, labels, ["item"], 30, 42)
    assert draws.count() == 60 and {r.item for r in draws.collect()} <= {f"i{k}" for k in (1, 3, 4, 5, 6, 7, 8)}
    assert sampling.mixed_negatives(ranked, labels, ["item"], 3, 42).count() <= 6


def test_foreign_negatives_for_every_citation(spark):
    items = spark.createDataFrame([(f"l{k}", str(c) if c else None, a) for k in range(7) for c in range(3) for a in range(3)] + [("m", None, 0)], "law_id string, chapter string, article int")
    labels = spark.createDataFrame([(q, f"l{k}") for q in range(20) for k in (0, 1)] + [(20, "unknown"), (21, None), (0, "l0")], "question_id int, law_id string")
    got = sampling.foreign_negatives(labels, items, ["law_id", "chapter", "article"], 2, 9, 42).collect()
    by = {}
    for r in got:
        by.setdefault((r.question_id, r.cited), []).append(r)
    assert set(by) == {(q, f"l{k}") for q in range(20) for k in (0, 1)} | {(20, "unknown")}
    assert all(sorted(r.place for r in rows) == list(range(1, 10)) and all(r.law_id != cited for r in rows) for (_, cited), rows in by.items())
    assert {r.law_id for r in got} == {f"l{k}" for k in range(7)} | {"m"} and len({tuple(sorted(r.law_id for r in rows)) for rows in by.values()}) > 10
    once = sampling.foreign_negatives(labels, items, ["law_id", "chapter", "article"], 2, 2, 42)  # one round: at most two laws, chapters of each and articles of each
    assert once.groupBy("question_id", "cited").count().where("count != 2").count() == 0
    pair = items.where("law_id in ('l0', 'l1')")
    assert {r.law_id for r in sampling.foreign_negatives(labels.where("law_id = 'l0'"), pair, ["law_id", "chapter", "article"], 2, 9, 42).collect()} == {"l1"}
    assert sampling.foreign_negatives(labels.where("law_id = 'l0'"), pair.where("law_id = 'l0'"), ["law_id", "chapter", "article"], 2, 9, 42).count() == 0


def test_whole_parents_that_a_question_does_not_cite(spark):
    parents = spark.createDataFrame([(f"l{k}",) for k in range(8)] + [("l0",), (None,)], "law_id string")
    labels = spark.createDataFrame([(q, f"l{k}") for q in range(40) for k in (2, q % 2, q % 2)] + [(1, "unknown"), (1, None)] + [(41, f"l{k}") for k in range(6)], "question_id int, law_id string")
    questions = spark.createDataFrame([(q,) for q in [*range(42), 0, None]], "question_id int")
    by = {}
    for r in sampling.parent_negatives(questions, labels, parents, "law_id", 5, 42).collect():
        by.setdefault(r.question_id, []).append(r.law_id)
    assert all(len(by[q]) == len(set(by[q])) == 5 and not set(by[q]) & {"l2", f"l{q % 2}"} for q in range(40))
    assert len(set(by[40])) == 5 and sorted(by[41]) == ["l6", "l7"] and set(by) == set(range(42)) and len({tuple(sorted(x)) for x in by.values()}) > 5


def test_pair_frame(spark):
    queries = spark.createDataFrame([(1, " Hỏi\tGÌ? "), (2, "x")], "question_id int, text string")
    positives, negatives = (spark.createDataFrame(rows, "question_id int, entry string") for rows in ([(1, "Luật  A"), (1, "luật a")], [(1, "luật\nb"), (2, "luật c"), (3, "luật d"), (2, None)]))
    got = sampling.pair_frame(queries, positives, negatives)
    assert values(got, "question_id", "query", "article", "label") == [(1, "hỏi gì?", "luật a", 1), (1, "hỏi gì?", "luật b", 0), (2, "x", "luật c", 0)]


def test_soft_negatives_are_in_the_training_pairs(spark, small):
    from lawloom.plans import corpora

    every = {(r.question_id, r.law_id, r.article) for r in corpora.train_pairs_soft(spark, small).where("verdict = 'sai'").collect()}
    keys = ["law_serial_number", "article_number"]
    drawn = sampling.soft_negatives(corpora._with_content(spark, small), corpora.gold(spark, small).distinct(), keys, corpora.N, corpora.SEED).selectExpr("question_id", "law_serial_number as law_id", "article_number as article")
    found = corpus.lookup_content(drawn, corpora._flat(spark, small), ["law_id", "article"], None).where("content is not null").join(corpora._questions(spark, small), "question_id").collect()
    hard = {(r.question_id, r.law_id, r.article) for r in corpora.train_pairs(spark, small).where("verdict = 'sai'").collect()}
    assert {(r.question_id, r.law_id, r.article) for r in found} <= every and hard <= every  # here few predictions have a content, so that both may draw all of them
    one_each = sampling.mixed_negatives(corpora._with_content(spark, small), corpora.gold(spark, small).distinct(), keys, 2, corpora.SEED, corpora.best_first())
    assert one_each.count() > sampling.hard_negatives(corpora._with_content(spark, small), corpora.gold(spark, small).distinct(), keys, 1, corpora.best_first()).count()


@pytest.mark.parametrize(("rate", "cap", "wanted"), [(1, False, 2), (2, False, 3), (0, False, 6), (0.5, False, 6), (0, True, 1)])
def test_balance(spark, rate, cap, wanted):
    pairs = spark.createDataFrame([(1, 1, 1)] + [(1, k, 0) for k in range(2, 7)], "question_id int, rank int, label int")
    assert sampling.balanced(pairs, rate, cap).count() == wanted


def test_splits(spark):
    q = spark.createDataFrame([(k, 2) for k in range(100)], "question_id int, n_labels int")
    assert sampling.split_by_size(q, 0.8, 42).where("split = 'test'").count() == 19
    q = spark.createDataFrame([(1,), (7000,), (7001,)], "question_id int")
    got = sampling.split_by_lists(q, q.where("question_id = 1"), q.where("question_id = 1"), 7000)
    assert values(got, "question_id", "split") == [(1, "test-1"), (7000, "train-1"), (7001, "train-2")]


@pytest.mark.parametrize(("key", "answers", "wanted"), [("DS1", ("đúng", "sai", None), "sai"), ("DS1", ("đúng", "đúng", "sai"), "đúng"), ("TN1", ("b", "a", None), "A"), ("TN1", ("x", None, None), "A"), ("TN1", ("c", "c", "a"), "C"), ("TL1", ("x", "y", "z"), "z")])
def test_vote(spark, key, answers, wanted):
    assert one(spark, vote(F.lit(key), [F.lit(a) for a in answers])) == wanted


# --- plans, sources, scorers


def test_plans(spark):
    df = staged(spark.range(10).toDF("a"), "test")
    assert df.count() == 10 and "localCheckpoint" not in df._jdf.queryExecution().toString()
    assert is_small(df, 10) and not is_small(df, 9)
    assert spread_out(spark.range(3).coalesce(1)).rdd.getNumPartitions() >= 4


@pytest.mark.parametrize("how", ["inner", "left", "left_anti", "left_semi"])
def test_hot_keys_of_a_join_are_salted(spark, how):
    left = spark.createDataFrame([(1, n) for n in range(500)] + [(k, 0) for k in range(2, 9)] + [(None, 0)], "k int, n int")
    right = spark.createDataFrame([(k, k * 10) for k in (1, 3, 5, 99)], "k int, v int")
    columns = ["k", "n"] if how in ("left_anti", "left_semi") else ["k", "n", "v"]
    wanted = values(left.join(right, "k", how), *columns)
    assert values(join_unique(left, right, ["k"], how), *columns) == wanted
    salted = join_unique(left, right, ["k"], how, hot_rows=100, small_rows=1)
    assert "__salt" in salted._jdf.queryExecution().logical().toString() and values(salted, *columns) == wanted
    assert values(join_unique(left, right, ["k"], how, small_rows=1), *columns) == wanted


def test_written_tables_are_removed(spark, tmp_path):
    import pathlib
    import subprocess
    import sys

    with scope(spark):
        path = staged(spark.range(3), "scoped").inputFiles()[0].removeprefix("file:").replace("///", "/")
        assert pathlib.Path(path).exists()
    assert not pathlib.Path(path).exists()
    path = staged(spark.range(3), "released").inputFiles()[0].removeprefix("file:").replace("///", "/")
    release(spark)
    assert not pathlib.Path(path).exists()
    code = f"""
from pyspark.sql import SparkSession
from lawloom.plans import staged
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
assert staged(spark.range(3), "x").count() == 3
import os
assert [f for f in os.listdir("{tmp_path}") if f.startswith("lawloom")]
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, capture_output=True)
    deadline = time.time() + 20
    while list(tmp_path.glob("lawloom*")) and time.time() < deadline:
        time.sleep(0.2)
    assert not list(tmp_path.glob("lawloom*"))


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from lawloom.plans.stage import shared_dir

    context = SimpleNamespace(applicationId="app-x", master="spark://host:7077", getConf=lambda: {})
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(sparkContext=context, conf={}))


def test_top_k_is_limited_before_the_shuffle(spark, small):
    from lawloom.plans import retrieval

    plan = retrieval.recall_at_k(spark, small)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_package_is_sent_once(spark):
    from lawloom.plans.ship import ship_package

    ship_package(spark)
    before = len(spark.sparkContext._python_includes)
    ship_package(spark)
    assert len(spark.sparkContext._python_includes) == before >= 1


def test_sources(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    rows = spark.createDataFrame([("1", [("x", 'q"\nt')]), (None, None)], schemas.LAW_FLAT)
    io.write_json(rows, path)
    io.write_json(rows.where("false"), path)  # kept
    assert io.read_json(spark, path + "/*.json", schemas.LAW_FLAT).count() >= 1
    (tmp_path / "cases").mkdir()
    (tmp_path / "cases" / "7.json").write_text('{"question_id": "7", "answer": "a"}')
    got = io.read_json_cases(spark, f"file://{tmp_path}/cases", schemas.MODEL_ANSWERS, drop=["answer"]).first()
    assert (got.question_id, got.case_file) == ("7", "7.json")
    table = spark.createDataFrame([(k, "t\n,'\"") for k in range(4)], "k int, t string")
    io.write_csv(table, f"file://{tmp_path}/c")
    assert values(io.read_csv(spark, f"file://{tmp_path}/c", table.schema), "k", "t") == values(table, "k", "t")
    assert io.resume_append(table.where("k < 2"), f"file://{tmp_path}/r", "k") == 2
    assert io.resume_append(table, f"file://{tmp_path}/r", "k") == 2
    assert values(io.row_range(table, "k", 1, 3), "k") == [(1,), (2,)] and io.row_range(table, "k", 1).count() == 3
    assert values(io.dev_limit(table, "k", 2), "k") == [(0,), (1,)]


def test_csv_keeps_every_text(spark, tmp_path):
    texts = [None, "", " ", "  a ", "\ta", "a\r", "a\rb", "a\r\nb", "\r\n", "\n", 'a"b', '"', '""', "a,b", "\\", '\\"', "\u00a0x\u00a0", "null", 'a\\"b, "c" \r\n "']
    table = spark.createDataFrame([*enumerate(texts), (None, None), (None, "x")], "k int, t string")
    io.write_csv(table, f"file://{tmp_path}/w")
    assert values(io.read_csv(spark, f"file://{tmp_path}/w", table.schema), "k", "t") == values(table, "k", "t")


def test_tokenised_pairs(spark):
    tokenizers = pytest.importorskip("tokenizers")
    from lawloom.operators.tokenise import tokenised_pairs
    from lawloom.plans.transfer import VOCABULARY

    try:
        public = tokenizers.Tokenizer.from_file(VOCABULARY)
    except Exception:
        pytest.skip("no vocabulary here")
    ids = lambda t: public.encode(t, add_special_tokens=False).ids
    long, short = "the permit expires " * 30, "the owner"
    df = spark.createDataFrame([(1, short, long), (2, long, long), (3, None, short), (4, "", None)], "k int, a string, b string")
    got = {r.k: r for r in tokenised_pairs(df, "a", "b", VOCABULARY, 20).collect()}
    assert got[1].input_ids == ids(short) + ids(long)[: 20 - len(ids(short))] and got[1].cut
    assert got[2].input_ids == ids(long)[:10] + ids(long)[:10] and got[2].token_types == [0] * 10 + [1] * 10
    assert (got[3].input_ids, got[3].cut) == (ids(short), False) and got[4].input_ids == []


def test_scorers(spark):
    df = spark.createDataFrame([("a b", "b c"), ("", "x"), (None, None)], "q string, t string")
    assert values(score_pairs(df, "q", "t"), "score", "score_predict") == [(0.0, 0), (0.0, 0), (0.5, 0)]
    assert all(len(r.embedding) == 64 for r in encode(df, "q").collect())
    assert values(answer(df.where("q is not null"), "q", "t", lambda prompts: [p.upper() for p in prompts]), "q", "answer") == [("", "X"), ("a b", "B C")]


def test_a_law_without_scopes_has_no_entry_for_them(spark, tmp_path):
    from lawloom.plans import frames

    spark.createDataFrame([("1", "T", None), ("1", "T", None), ("2", None, ""), ("3", None, None)], "id string, title string, scope string").write.parquet(f"{tmp_path}/law_tree.parquet")
    spark.createDataFrame([("1", [("x", "A-b")]), ("2", None), ("3", []), ("4", None)], schemas.LAW_FLAT).write.parquet(f"{tmp_path}/law_flat.parquet")
    assert values(frames.lex_titles(spark, str(tmp_path)), "id", "entry") == [("1", "ab"), ("1", "t"), ("2", "")]


def test_training_shards_label_null_lists(spark, tmp_path):
    from lawloom.plans import transfer

    rows = [(1, "a", None), (2, "b", []), (3, "c", ["x", None]), (None, "d", None), (4, None, None)]
    spark.createDataFrame(rows, "question_id long, text string, relevant_articles array<string>").write.parquet(f"{tmp_path}/question_main.parquet")
    assert values(transfer.training_shards(spark, str(tmp_path)), "question_id", "label", "bounded") == [(1, -1, True), (2, 0, True), (3, 2, True)]


def test_overlap_score_splits_as_its_sql(spark):
    spaces = ["\t", "\n", "\x0b", "\f", "\r", "\x1c", "\x85", "\xa0", "\u2009", "\u2028", "\u3000", " "]
    df = spark.createDataFrame([(f"{s}a{s}b c", "a c") for s in spaces], "q string, t string")
    duckdb = pytest.importorskip("duckdb")
    words = lambda x: f"list_distinct(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> ''))"
    sql = f"select round(len(list_intersect({words('q')}, {words('t')})) / len({words('q')}), 6) from (select unnest($1) as q, 'a c' as t)"
    wanted = duckdb.execute(sql, [[f"{s}a{s}b c" for s in spaces]]).fetchall()
    assert [(round(r.score, 6),) for r in score_pairs(df.coalesce(1), "q", "t").collect()] == wanted


def test_bm25_blocks_and_matrix_products_agree(spark, monkeypatch):
    rng = random.Random(5)
    words = [*"abcdefgh", *[f"w{i}" for i in range(60)]]
    docs = spark.createDataFrame([(n, " ".join(rng.choices(words, [9] * 8 + [1] * 60, k=rng.randint(1, 20)))) for n in range(300)], "doc_id int, text string")
    asked = spark.createDataFrame([(n, " ".join(rng.choices(words, k=6))) for n in range(120)], "query_id int, text string")
    rows = lambda found: {(r.query_id, r.doc_id): round(r.score, 9) for r in found[0].collect()}
    one, many = rows(bm25.bm25_search(docs, asked, 7)), rows(bm25.bm25_search(docs, asked, 7, block_terms=20))
    monkeypatch.setattr(bm25, "DENSE", 2.0)  # nothing is dense
    block = bm25._Block([(1, "a", 0.5), (1, "b", 2.0), (2, "a", 1.0), (3, "z", 1.0)])
    texts = [["a", "a", "b"], ["c"], ["b"]]
    sparse = block.scores(texts, 2.0, 1.5, 0.75)
    monkeypatch.setattr(bm25, "DENSE", 0.0)
    dense = block.scores(texts, 2.0, 1.5, 0.75)
    assert abs(sparse[0] - dense[0]).max() < 1e-12 and (sparse[1] == dense[1]).all() and dense[1].tolist() == [[True, True, False], [False] * 3, [True, False, False]]
    block.positive = False
    assert (block.scores(texts, 2.0, 1.5, 0.75)[1] == dense[1]).all()
    assert one == many and len(one) > 800


def test_candidates_carry_no_texts(spark, small):
    from lawloom.plans import frames

    strings = frames._strings(spark, small)
    found = frames._candidates(strings, frames._asked(spark, small))
    assert found.columns == ["question_id", "place", "score", "rank"] and found.count() > 0
    texts = [r[0] for r in strings.orderBy("place").select("doc_id").collect()]
    assert texts == sorted(set(texts))
    few = frames._with_text(found, strings.select("place", "content"), "place", "content")
    frames.BROADCAST_CHARACTERS, before = 0, frames.BROADCAST_CHARACTERS
    try:
        same = frames._with_text(found, strings.select("place", "content"), "place", "content")
        assert values(same, "question_id", "place", "content") == values(few, "question_id", "place", "content")
    finally:
        frames.BROADCAST_CHARACTERS = before


def test_train_frame_balances_rows_without_texts(spark, small, monkeypatch):
    from lawloom.plans import frames

    seen, balanced = [], sampling.balanced
    monkeypatch.setattr(sampling, "balanced", lambda pairs, *a, **k: seen.append(set(pairs.columns)) or balanced(pairs, *a, **k))
    assert frames.train_frame(spark, small).count() > 0 and seen and not seen[0] & {"text", "content", "doc_id"}


def test_train_frame_balances_numbers_from_blocks(spark, small, monkeypatch):
    from functools import partial

    from lawloom.plans import frames

    rows = lambda: values(frames.train_frame(spark, small), "question_id", "law_id", "article", "score", "label")
    seen, balanced, wanted, ranked = [], sampling.balanced, rows(), bm25.bm25_ranked
    monkeypatch.setattr(sampling, "balanced", lambda pairs, *a, **k: seen.append(set(pairs.columns)) or balanced(pairs, *a, **k))
    monkeypatch.setattr(bm25, "bm25_ranked", partial(ranked, block_terms=100))  # more blocks than cores
    monkeypatch.setattr(bm25, "top_k", None)  # ranks of blocks are final
    monkeypatch.setattr(bm25, "SUMS", 10)
    assert rows() == wanted and seen == [{"question_id", "place", "score", "rank", "label"}]
    monkeypatch.setattr(bm25, "VOCABULARY", 0)  # documents stored as texts
    assert rows() == wanted
