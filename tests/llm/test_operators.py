"""The operators on DataFrames: results against brute force, and nulls, blanks, ties, repeats, empty tables and extra columns."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lawloom.llm import queries
from lawloom.llm.answers import answer_defects
from lawloom.llm.bpe import encode_corpus
from lawloom.llm.chunks import Limits, split_oversized
from lawloom.llm.components import assign_splits, component_labels, linked_groups
from lawloom.llm.leaks import leaked_spans
from lawloom.llm.neighbours import IndexOptions, similar_vectors
from lawloom.llm.overlaps import near_pairs, split_overlaps
from lawloom.llm.quality import classified, text_statistics
from lawloom.llm.topn import top_n_per_group
from tests.conftest import comparable


def rows(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(name, spark, small, oracle):
    columns, wanted = oracle(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, small)
    assert sorted(df.columns) == columns
    assert sorted(comparable(r) for r in df.select(*columns).collect()) == wanted


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_runs(name, spark, small):
    df = queries.queries()[name](spark, small)
    assert df.count() == df.distinct().count()


# --- 1


def test_top_n_of_hot_and_cold_groups(spark):
    rng = random.Random(1)
    data = [(1, str(rng.randrange(900)), float(rng.randrange(40)), "x") for _ in range(4000)] + [(2, str(i), 5.0, "x") for i in range(300)]
    data += [(g, str(rng.randrange(8)), rng.choice([1.0, math.nan, None, -math.inf, math.inf, -0.0, 0.0]), "x") for g in range(3, 40) for _ in range(9)] + [(None, "1", 1.0, "x"), (3, None, 1.0, "x")]
    df = spark.createDataFrame(data + data[:50], "g int, i string, s double, rank string")
    best: dict = defaultdict(dict)
    for g, i, s, _ in data:
        if g is not None and i is not None and s is not None and not math.isnan(s):
            best[g][i] = max(s, best[g].get(i, -math.inf))
    wanted = {(g, i, k) for g, items in best.items() for k, (i, _) in enumerate(sorted(items.items(), key=lambda x: (-x[1], int(x[0])))[:10], 1)}
    for heavy in (25, 100_000):  # 25: salts in several rounds, as a group of equal scores is one range
        assert rows(top_n_per_group(df, "g", "i", "s", heavy_rows=heavy, ranges=4), "g", "i", "rank") == wanted
    assert top_n_per_group(df.where("false"), "g", "i", "s").count() == 0


def test_items_that_are_no_numbers(spark):
    df = spark.createDataFrame([(1, "b", 1.0), (1, "a", 1.0), (1, "10", 1.0), (1, "9", 1.0)], "g int, i string, s double")
    assert [r.i for r in top_n_per_group(df, "g", "i", "s").orderBy("rank").collect()] == ["9", "10", "a", "b"]


# --- 2


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(500, k) for k in range(200, 260)] + [(k, k + 1) for k in range(300, 340)]
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    df = spark.createDataFrame([*edges, (None, 1), (2, None)], "a int, b int")
    got = rows(component_labels(df), "v", "root")
    groups, wanted = defaultdict(set), defaultdict(set)
    for v, root in got:
        groups[root].add(v)
    for v in {x for e in edges for x in e if e[0] != e[1]}:
        wanted[find(v)].add(v)
    assert set(map(frozenset, groups.values())) == set(map(frozenset, wanted.values()))
    assert component_labels(df.where("false")).count() == 0


def test_groups_and_splits(spark):
    members = [(k, f"s{k % 7}" if k < 14 else None) for k in range(200)] + [(0, "s0"), (0, "s1"), (None, "s1")]
    groups = linked_groups(spark.createDataFrame(members, "record long, key string"))
    got = dict(rows(groups, "record", "group_id"))
    assert len(got) == 200 and {got[k] for k in (0, 7, 1, 8)} == {0} and got[2] == 2 and got[9] == 2 and got[50] == 50
    splits = assign_splits(groups, {"train": 0.8, "valid": 0.1, "test": 0.1})
    by_group, count = defaultdict(set), defaultdict(int)
    for _, g, s in rows(splits, "record", "group_id", "split"):
        by_group[g].add(s)
        count[s] += 1
    assert all(len(s) == 1 for s in by_group.values()) and sum(count.values()) == 200
    assert abs(count["train"] - 160) <= 4 and abs(count["valid"] - 20) <= 4
    assert linked_groups(spark.createDataFrame([], "record long, key string")).count() == 0


# --- 3


def vectors(spark, data):
    return spark.createDataFrame([(i, v, "x") for i, v in data], "vec_id long, embedding array<float>, rank string")


def nearest(data, k, least):
    x = np.array([v for _, v in data], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s, ids = np.round(x @ x.T, 6), [i for i, _ in data]
    out = set()
    for r in range(len(ids)):
        order = sorted((c for c in range(len(ids)) if c != r and s[r, c] >= least), key=lambda c: (-s[r, c], ids[c]))[:k]
        out |= {(ids[r], ids[c]) for c in order}
    return out


def test_neighbours_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 64))
    data = [(k, (centres[k % 60] + rng.normal(size=64) * rng.choice([0.1, 0.4, 1.5])).astype(np.float32).tolist()) for k in range(1500)]
    data += [(5000 + k, data[7][1]) for k in range(25)]  # equal vectors
    bad = [(9001, None), (9002, [1.0] * 63), (9003, [0.0] * 64), (9004, [math.nan] * 64), (9005, [1.0] * 63 + [math.inf]), (None, data[0][1]), (9006, [None] * 64)]
    df = vectors(spark, [*data, *bad, data[3]])
    for least, floor in ((0.8, 0.97), (-1.0, 0.95)):
        wanted = nearest(data, 10, least)
        got = rows(similar_vectors(df, "vec_id", "embedding", least, IndexOptions(block_rows=400, queries_per_block=1)), "vec_a", "vec_b")
        assert len(got & wanted) / len(wanted) >= floor
        if least > 0:
            assert got <= wanted or len(got - wanted) < 0.01 * len(wanted)


def test_lists_grow_as_the_square_root():
    from lawloom.llm.neighbours import Lists, _blocks, _nearest, fit_centroids

    rng = np.random.default_rng(8)
    looked = {}
    for n in (2_000, 8_000, 32_000):
        x = rng.normal(size=(200, 64))[rng.integers(0, 200, n)] + 0.5 * rng.normal(size=(n, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        count = round(4 * math.sqrt(n))
        cells = fit_centroids(x[:2000], math.isqrt(count), 1)
        centroids = fit_centroids(x, count, 1)
        lists = Lists(cells, centroids, _nearest(centroids, cells))
        place = lists.file(x)
        sizes, widest = np.bincount(place, minlength=len(centroids)), np.full(len(centroids), math.pi, np.float32)
        assert abs(len(centroids) - count) <= 0.1 * count and sizes.sum() == n
        q, found, _ = lists.probed(x[:500], 48, -1.0, widest)
        assert (np.bincount(q) == min(48, count)).all()
        looked[n] = sizes[found].sum() / 500
        assert sum(parts for _, parts, _ in _blocks(sizes, 10)) == (-(-sizes // 10)).sum()
    assert looked[32_000] < 6 * looked[2_000]  # 16 times the vectors: 4 times the items looked at


def test_equal_vectors_and_empty_tables(spark):
    same = [(k, [1.0] * 64) for k in range(40)]
    got = rows(similar_vectors(vectors(spark, same), "vec_id", "embedding", 0.8), "vec_a", "vec_b")
    assert got == nearest(same, 10, 0.8)
    assert similar_vectors(vectors(spark, same).where("false"), "vec_id", "embedding").count() == 0
    few = similar_vectors(vectors(spark, same), "vec_id", "embedding", wanted=lambda key: key % 20 == 0)
    assert {a for a, _ in rows(few, "vec_a", "vec_b")} == {0, 20}


# --- 5


QUESTION = "Trường hợp bên giao khoán quyết toán tài sản thì ban quản lý khu có phải lập biên bản không?"


@pytest.mark.parametrize(
    ("answer", "wanted"),
    [
        (None, "empty"), (" ** ", "empty"), ("N/A", "empty"), ("không có câu trả lời", "empty"),
        ("Xin lỗi, tôi không thể trả lời câu hỏi này.", "refusal"), ("As an AI assistant I am not able to give legal advice.", "refusal"), ("抱歉，我无法回答这个问题。", "refusal"), ("Hiện tại, hệ thống không hỗ trợ nội dung này; hãy liên hệ phòng chuyên môn để được giải đáp", "refusal"),
        (QUESTION, "copy"), (QUESTION.upper(), "copy"), ("Câu hỏi: " + QUESTION.replace("lập ", ""), "copy"), (QUESTION + "\n" + QUESTION, "copy"),
        ("The permit must be returned before the season ends.", "language"), ("Le délai est de trente jours après la demande.", "language"), ("期限为三十天。", "language"), ("Richtig", "language"),
        ("Bên giao khoán phải quyết toán tài sản trong 30 ngày và", "truncated"), ("Bên giao khoán phải quyết toán tài sản gồm: a) hồ sơ; b)", "truncated"), ("1. Bên bán phải nộp phí trong 3 ngày.\n2. Các", "truncated"), ("Bên giao khoán phải quyết toán tài sản (sau đây gọi là", "truncated"),
        ("Đúng", None), ("B", None), ("30 ngày", None), ("Đúng, vì bên giao khoán phải quyết toán tài sản.", None), ("Cơ quan cấp phép từ chối tiếp nhận hồ sơ.", None), ("Người vi phạm phải xin lỗi công khai và nộp phạt.", None), ("ben giao khoan phai quyet toan tai san trong 30 ngay.", None), ("Theo nguyên tắc pacta sunt servanda, bên giao khoán phải quyết toán.", None),
    ],
)
def test_defects(defects, answer, wanted):
    assert defects[answer] == wanted


UNSEEN_REFUSALS = (
    "Tôi xin được miễn trả lời câu hỏi này.", "Rất mong quý vị lượng thứ vì tôi chẳng thể đưa ra lời đáp.", "Tôi đành chịu thua trước câu hỏi này.", "Mình chẳng có manh mối gì để đáp lại bạn.", "Tôi không thể cho bạn một đáp án đáng tin.", "Xin thứ lỗi, em không dám đưa lời khuyên trong trường hợp này.", "Chuyện này tôi không được quyền phát biểu.", "Tôi thấy mình không phù hợp để trả lời.", "Bạn hỏi điều mà tôi không thể biết.", "Tôi buộc phải khước từ yêu cầu này.",
    "I'd better stay silent on this matter.", "That's something I'm not permitted to address.", "My apologies, but I have no means of knowing.", "I do not feel comfortable giving an opinion here.", "I lack the information needed to reply.", "You'll have to ask someone else, I can't tell.",
    "Je n'ai malheureusement aucune réponse à vous donner.", "Je ne souhaite pas m'exprimer là-dessus.", "Darauf kann ich Ihnen keine Antwort geben.", "Ich möchte dazu lieber schweigen.", "Me temo que no puedo contestar.", "No dispongo de datos para responder.", "不好意思，这个问题我答不上来。", "我不方便对此发表意见。", "Мне нечего ответить на этот вопрос.",
)


def test_refusals_in_unseen_words(defects):
    from pathlib import Path

    code = " ".join(p.read_text() for p in Path(queries.__file__).parent.glob("*.py")).lower()
    assert not any(said.lower().rstrip(".。") in code for said in UNSEEN_REFUSALS)
    missed = [said for said in UNSEEN_REFUSALS if defects[said] != "refusal"]
    assert len(missed) <= 0.1 * len(UNSEEN_REFUSALS), missed


@pytest.fixture(scope="module")
def defects(spark):
    """The defects of all answers above, among many sound ones that teach how sentences end."""
    rng = random.Random(5)
    who, what, when = ["Bên bán", "Chủ rừng", "Bên giao khoán", "Người lao động"], ["quyết toán tài sản", "lập biên bản", "nộp phí", "bàn giao hồ sơ"], ["trong 30 ngày", "trước khi bàn giao", "sau khi niêm yết", "trong giờ hành chính"]
    sound = [f"{rng.choice(who)} phải {rng.choice(what)} {rng.choice(when)}. {rng.choice(who)} không được {rng.choice(what)}." for _ in range(600)]
    mark = next(m for m in test_defects.pytestmark if m.name == "parametrize")
    asked = [*[a for a, _ in mark.args[1]], *UNSEEN_REFUSALS]
    table = spark.createDataFrame([(k, "q", a, "extra") for k, a in enumerate([*asked, *sound, asked[0]])], "answer_id long, question_id string, answer string, defect string")
    others = [(f"o{k}", f"{rng.choice(who)} {rng.choice(when)} có phải {rng.choice(what)} không?") for k in range(60)]
    questions = spark.createDataFrame([("q", QUESTION), ("q", None), (None, "x"), *others], "question_id string, text string")
    got = dict(rows(answer_defects(table, questions), "answer_id", "defect"))
    assert sum(got[k + len(asked)] is not None for k in range(600)) <= 3
    return {a: got[k] for k, a in enumerate(asked)}


def test_no_answers(spark):
    empty = spark.createDataFrame([], "answer_id long, question_id string, answer string")
    assert answer_defects(empty, spark.createDataFrame([], "question_id string, text string")).count() == 0


# --- 6 and 9


def test_overlaps(spark):
    text = " ".join(f"chữ{k}" for k in range(20))
    data = [
        (1, text, "train"), (1, text, "train"), (2, text.upper(), "eval"), (3, text.replace("chữ3 ", ""), "eval"), (4, " ".join(text.split()[:15]), "train"), (5, text + " a b c d e f", "eval"),
        (6, None, "eval"), (7, "", "train"), (8, " ", "eval"), (None, text, "eval"), (9, text, None), (10, "một", "train"), (11, "MỘT.", "eval"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in data], "record long, text string, side string, words string")
    got = split_overlaps(df.drop("words").withColumn("source", F.lit("s")))
    assert rows(got, "train_record", "eval_record") == {(1, 2), (1, 3), (10, 11)}
    assert set(got.columns) == {"train_record", "eval_record", "train_source", "eval_source", "edits", "spans"}
    assert {(r.train_record, r.eval_record): (r.edits, [tuple(s) for s in r.spans]) for r in got.collect()}[1, 3] == (1, [(0, 3), (4, 20)])
    words = lambda *texts: spark.createDataFrame([(" ".join(t.split()),) for t in texts], "words string")
    pairs = near_pairs(words(text, "a b"), words(text, f"{text} x", "c d", "a b"), shard_words=5)  # a shard for each text or two
    assert rows(pairs, "train_words", "eval_words", "edits") == {(text, text, 0), (text, f"{text} x", 1), ("a b", "a b", 0)}
    assert split_overlaps(df.drop("words").where("false")).count() == 0


def test_leaks(spark):
    item = " ".join(f"w{k}" for k in range(20))
    documents = spark.createDataFrame([(1, f"<p>Đầu</p> {item.upper()} hết", "x"), (2, " ".join(item.split()[:12]), "x"), (3, " ".join(item.split()[4:17]), "x"), (4, None, "x"), (5, "", "x"), (None, item, "x"), (1, f"<p>Đầu</p> {item.upper()} hết", "x")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, item), (7, item), (8, item), (9, "w1 w2"), (10, None), (11, "")], "item_id long, text string")
    got = leaked_spans(documents, items)
    assert rows(got, "doc_id", "item_id", "first_word", "end_word") == {(d, i, a, b) for i in (7, 8) for d, a, b in ((1, 1, 21), (3, 0, 13), (None, 0, 20))}
    many = leaked_spans(documents, items.unionByName(spark.createDataFrame([(k, f"{k} " * 14) for k in range(20, 40)], "item_id long, text string")), item_chars=150)
    assert rows(many, "doc_id", "item_id", "first_word", "end_word") == rows(got, "doc_id", "item_id", "first_word", "end_word")
    assert many._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1  # one scan for all blocks
    assert leaked_spans(documents.where("false"), items).count() == 0 and leaked_spans(documents, items.where("false")).count() == 0


# --- 7, 8 and 10


def test_oversized_texts(spark):
    df = spark.createDataFrame([(1, "a b. " * 300, 5), (1, "a b. " * 300, 5), (2, "x" * 1200, 5), (3, "", 5), (4, None, 5), (None, "ế" * 1201, 5)], "k int, text string, piece string")
    got = split_oversized(df, ["k"], "text").orderBy("k", "piece_no").collect()
    assert [r.piece_no for r in got if r.k == 1] == [0, 0, 1, 1] and {r.k for r in got} == {None, 1}
    assert all(len(r.piece) <= 1200 for r in got)
    assert split_oversized(df.where("false"), ["k"], "text", Limits(500, 10, 20)).count() == 0


def test_ids(spark):
    try:
        df = spark.createDataFrame([(1, "Điều 1", 1), (2, "", 1), (3, None, 1), (None, " ", 1), (1, "Điều 1", 1)], "doc_id int, text string, ids int")
        got = encode_corpus(df, queries.TOKENIZER)
    except FileNotFoundError:
        pytest.skip("no vocabulary here")
    assert sorted((r.doc_id or 0, r.ids) for r in got.collect()) == [(0, [220]), (1, got.where("doc_id = 1").first().ids), (1, got.where("doc_id = 1").first().ids), (2, []), (3, [])]
    assert encode_corpus(df.where("false"), queries.TOKENIZER).count() == 0


PROSE = "Khi bàn giao công trình, bên giao khoán phải nộp hồ sơ cho ban quản lý khu trong ba mươi ngày. Nếu hồ sơ bị trả lại thì người nộp phải bổ sung trong mười ngày."


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        (PROSE, "prose"), (PROSE.upper(), "prose"), ("\n".join(PROSE[i : i + 40] for i in range(0, len(PROSE), 40)), "prose"), ("The owner must return the permit before the season ends, and the lender may keep the register.", "prose"), (f"{PROSE}\nNăm | Số vụ\n2019 | 28\n2020 | 76\n{PROSE}", "prose"),
        ("Danh mục\n- hồ sơ\n- biên bản giao khoán\n- kho bãi\n- phụ lục\n- tem nhãn", "list"), ("Hồ sơ.\nBiên bản.\nKho bãi giao khoán.\nPhụ lục.\nTem nhãn.", "list"), ("a) hồ sơ;\nb) biên bản;\nc) kho bãi;\nd) phụ lục;", "list"),
        ("| Mã | Hồ sơ |\n|---|---|\n| 1 | 2/3/2004 |\n| 2 | 5/6/2007 |\n| 3 | 8/9/2010 |", "table"), ("Mã\tHồ sơ\tPhí\n1\tx\t3\n2\ty\t4\n3\tz\t5", "table"), ("Mã    Hồ sơ   Phí\n1     x       3\n2     y       4\n3     z       5", "table"), ('"Mã","Phí"\n"1","2"\n"3","4"', "table"),
        ("#$%^&*()_+{}|<>[]=~@ " * 5, "junk"), ("nhẵng " * 60, "junk"), ("N�u d� to�� kh�ng ghi t�n b� gia h�n sai", "junk"), ("Khi k\\xea khai t\\xe0i s\\u1ea3n, b\\xean thu\\xea nh\\xe0", "junk"), ("Má»©c thu Ä\x91á»\x91i vá»\x9bi chá»\x97 á»\x9f táº¡m", "junk"), ("M ứ c t h u đ ố i v ớ i p h ầ n v ố n", "junk"), ("QENnKjag8rel/nCOLQ57vvJV8Cz7Z2ALLKQ2d4YRZLX5CleuyWJDMsZ9Slgk", "junk"), ("00003f 000083 0005 00000088 000096 00000048 000086 0000002b 45 2a 47 0063", "junk"),
        (None, "blank"), ("", "blank"), ("   \n\t", "blank"),
    ],
)
def test_kinds(kinds, text, kind):
    assert kinds[text] == kind


@pytest.fixture(scope="module")
def kinds(spark):
    mark = next(m for m in test_kinds.pytestmark if m.name == "parametrize")
    texts = [t for t, _ in mark.args[1]]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id int, text string, kind string")
    assert classified(text_statistics(df.where("false"))).count() == 0
    got = dict(rows(classified(text_statistics(df)), "doc_id", "kind"))
    return {t: got[k] for k, t in enumerate(texts)}


def test_statistics_against_counting(spark):
    df = spark.createDataFrame([(1, "Một hai.\n\nba - bốn!"), (2, None)], "doc_id int, text string")
    got = {r.doc_id: r for r in text_statistics(df).collect()}
    assert (got[1].n_chars, got[1].n_words, got[1].n_lines, got[1].ended_line_share) == (19, 5, 2, 1.0)
    assert got[1].mean_word_length == pytest.approx((3 + 4 + 2 + 1 + 4) / 5)
    assert (got[2].n_chars, got[2].n_words, got[2].common_share) == (0, 0, 0.0)


def test_long_prose_is_not_taken_for_repetition(spark):
    subjects, acts, things, ends = ("le bureau du canton", "un agent de la mairie", "le conseil", "chaque locataire"), ("doit remettre", "conserve", "peut corriger", "signe"), ("le plan", "une copie du registre", "la demande", "les annexes"), ("avant la fin de la saison", "dans le délai convenu", "pour la commune", "sans frais")
    prose = " ".join(f"{a} {b} {c} {d}.".capitalize() for a in subjects for b in acts for c in things for d in ends)
    repeated = "thu phí trước khi bàn giao " * 300
    df = spark.createDataFrame([(1, prose), (2, repeated), (3, "nhẵng " * 199), (4, "nhẵng " * 2001)], "doc_id int, text string")
    got = {r.doc_id: r for r in classified(text_statistics(df)).collect()}
    assert len(set(prose.lower().replace(".", "").split())) / len(prose.split()) < 0.08  # of the whole text
    assert got[1].kind == "prose" and [got[k].kind for k in (2, 3, 4)] == ["junk"] * 3
    assert got[2].distinct_word_share == pytest.approx(6 / 200) and got[4].distinct_word_share == pytest.approx(1 / 200)
