"""The algorithms against brute force, without Spark."""

import random
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lawloom.llm.answers import clauses, final_words
from lawloom.llm.bpe import SPLIT, Automaton, Merges, _Words, encode_texts
from lawloom.llm.chunks import Limits, cut, cut_costs
from lawloom.llm.crf import Field, Positions, train
from lawloom.llm.fmindex import FMIndex, spread, suffix_array
from lawloom.llm.lawid import canonical_law
from lawloom.llm.leaks import matched_spans
from lawloom.llm.overlaps import EvalShard, common_words, edit_distance, factors_bound
from lawloom.llm.words import canonical_words

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.mark.parametrize(("text", "wanted"), [("<b>Đường</b> số&nbsp;5", ["duong", "so", "nbsp", "5"]), ("Ti­ế​ng VIỆT", ["tieng", "viet"]), ("ﬁ ２０", ["fi", "20"]), ("a < b và c > d", ["a", "b", "va", "c", "d"]), (None, []), ("", []), ("_ - _", [])])
def test_words(text, wanted):
    assert canonical_words(text) == wanted


def test_law_spellings():
    same = ["1/1992/NĐ-HKV", " 1 / 1992 / nđ–hkv\n", "1/19​92/NÐ-HKV", "１／１９９２／NĐ‐HKV", "1/1992/NĐ-HКV", "1/1992/Nđ -HKV"]
    assert len({canonical_law(s) for s in same}) == 1
    assert canonical_law("1/1992/ND-HKV") != canonical_law(same[0])
    assert {canonical_law(s) for s in (None, "", " ", "-", "None", "n/a", "​", "N/A ")} == {None}


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=12), min_size=1, max_size=6), st.lists(st.sampled_from("abcd"), min_size=1, max_size=4))
@settings(max_examples=120, deadline=None)
def test_index_finds_all_occurrences(texts, pattern):
    index = FMIndex(texts, sample=3)
    low, high = index.search(index.numbers(pattern).reshape(1, -1))
    rows, _ = spread(low, high)
    joined = [w for t in texts for w in (*t, "|")]
    assert sorted(index.locate(rows).tolist()) == [i for i in range(len(joined)) if joined[i : i + len(pattern)] == pattern]


def test_suffixes_of_repeated_texts():
    symbols = np.array(([1] * 50 + [0]) * 4 + [2, 1, 0])
    order = suffix_array(symbols).tolist()
    seen = {p: k for k, p in enumerate(np.flatnonzero(symbols == 0).tolist())}
    key = lambda i: [(0, seen[j]) if symbols[j] == 0 else (1, int(symbols[j])) for j in range(i, i + symbols[i:].tolist().index(0) + 1)]
    assert order == sorted(range(len(symbols)), key=key)


@given(st.lists(st.integers(0, 3), max_size=9), st.lists(st.integers(0, 3), max_size=9))
@settings(max_examples=200, deadline=None)
def test_edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    assert edit_distance(a, b) == row[-1]


def test_near_texts_against_all_pairs():
    rng = random.Random(7)
    texts = [[rng.choice("abcdefgh") for _ in range(rng.randrange(1, 26))] for _ in range(60)]
    for t in texts[:40]:
        copy = [w for w in t if rng.random() > 0.1]
        copy.insert(rng.randrange(len(copy) + 1), "z")
        texts.append(copy)
    shard = EvalShard(range(len(texts)), texts)
    found = list(shard.near(texts, 20))
    got = {(i, j) for i, j, *_ in found}
    assert all(apart == edit_distance(texts[i], texts[j]) for i, j, apart, _ in found)
    assert all(0 <= a < b <= len(texts[i]) and (j != i or (a, b) == (0, len(texts[i]))) for i, j, _, spans in found for a, b in spans)
    wanted = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if 5 * edit_distance(a, b) <= max(len(a), len(b))}
    assert got == wanted


def test_matching_statistics():
    rng = random.Random(9)
    texts = [[rng.choice("abc") for _ in range(rng.randrange(1, 30))] for _ in range(12)]
    index, sought = FMIndex(texts), [[rng.choice("abcd") for _ in range(40)], texts[3], ["d"]]
    joined = np.concatenate([index.numbers(s) for s in sought])
    room = np.concatenate([np.arange(1, len(s) + 1) for s in sought])
    length, low, high = index.matching(joined, room, np.full(len(joined), 2))
    inside = ["|".join(t) for t in texts]
    at = 0
    for s in sought:
        for j in range(len(s)):
            fits = [n for n in range(1, j + 2) if any(f"|{'|'.join(s[j - n + 1 : j + 1])}|" in f"|{t}|" for t in inside)]
            assert length[at] == max(fits, default=0)
            count = sum(t[i : i + 2] == s[j - 1 : j + 1] for t in texts for i in range(len(t) - 1)) if j else 0
            assert high[at] - low[at] == count
            at += 1


@given(st.lists(st.sampled_from("abcd"), max_size=25), st.lists(st.tuples(st.integers(0, 24), st.sampled_from("abcdx")), max_size=4))
@settings(max_examples=100, deadline=None)
def test_few_edits_leave_few_matches(text, changes):
    other = list(text)
    for at, word in changes:
        if at < len(other):
            other[at : at + 1] = {"x": [], "a": [word, word]}.get(word, [word])
    k, index = edit_distance(text, other), FMIndex([other])
    if text:
        length, *_ = index.matching(index.numbers(text), np.arange(1, len(text) + 1), np.ones(len(text)))
        assert factors_bound(length, k + 1)


@given(st.lists(st.sampled_from([-1, 1, 2, 3]), max_size=12), st.lists(st.sampled_from([1, 2, 3, 4]), max_size=12))
@settings(max_examples=200, deadline=None)
def test_common_words_bound_the_edits(a, b):
    common = common_words(Counter(a), b)
    assert common == sum((Counter(a) & Counter(b)).values()) and edit_distance(a, b) >= max(len(a), len(b)) - common


def test_only_texts_of_enough_common_words_are_compared(monkeypatch):
    from lawloom.llm import overlaps

    compared = []
    monkeypatch.setattr(overlaps, "edit_distance", lambda a, b: compared.append(1) or edit_distance(a, b))
    fill = lambda n: [f"form{i}" for i in range(22)] + [f"w{n}-{i}" for i in range(18)]
    texts = [fill(n) for n in range(20)]
    found = list(EvalShard(range(20), texts).near([fill(3), [*fill(3)[:-1], "x"], fill(99)], 20))
    assert [(t, k, e) for t, k, e, _ in found] == [(0, 3, 0), (1, 3, 1)] and len(compared) == 2


def test_spans_merge():
    item = [f"w{i}" for i in range(30)]
    texts = [["x", *item[:20], "y", *item[10:24]], item[3:15], ["q"] * 40, item]
    rows = {tuple(map(int, r)) for r in zip(*matched_spans(FMIndex(texts), [item, ["q"] * 13, ["short"]], 13), strict=True)}
    assert rows == {(0, 0, 1, 21), (0, 0, 22, 36), (3, 0, 0, 30), (2, 1, 0, 40)}


@given(st.text(alphabet="ab .\n;ế́😀", max_size=1500), st.integers(0, 40))
@settings(max_examples=60, deadline=None)
def test_pieces(text, low):
    limits = Limits(200, low, low + 15)
    pieces = cut(text, limits)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(b - a <= limits.size for a, b in pieces)
    assert all(low <= b - c <= low + 15 and d > b for (_, b), (c, d) in pairwise(pieces))
    assert (len(pieces) == 1) == (len(text) <= limits.size)
    assert "".join(text[(pieces[k - 1][1] if k else 0) : b] for k, (_, b) in enumerate(pieces)) == text


def test_pieces_have_the_smallest_sum():
    rng, limits = random.Random(12), Limits(60, 6, 10)

    def total(text, pieces):
        costs = cut_costs(text)
        count = -(-(len(text) - limits.high) // (limits.size - limits.high))
        even = (len(text) + (count - 1) * (limits.low + limits.high) / 2) / count
        inner = sum(costs[b] + costs[c] for (_, b), (c, _) in pairwise(pieces))
        return inner + 30 * sum(((b - a - even) / even) ** 2 for a, b in pieces)

    for _ in range(15):
        text = "".join(rng.choice("abcd  .\n,") if k % 90 < 60 else "x" for k in range(rng.randrange(61, 190)))
        costs, n = cut_costs(text), len(text)
        begin = lambda e, costs=costs: min(range(e - limits.high, e - limits.low + 1), key=lambda p: (costs[p], p))
        best = {}

        def search(start, n=n, text=text, costs=costs, begin=begin, best=best):
            if start not in best:
                count = -(-(n - limits.high) // (limits.size - limits.high))
                even = (n + (count - 1) * (limits.low + limits.high) / 2) / count
                off = lambda e: 30 * ((e - start - even) / even) ** 2
                least = off(n) if limits.high < n - start <= limits.size else float("inf")
                for e in range(start + limits.high + 1, min(n - 1, start + limits.size) + 1):
                    if begin(e) > start:
                        least = min(least, off(e) + costs[e] + costs[begin(e)] + search(begin(e)))
                best[start] = least
            return best[start]

        assert total(text, cut(text, limits)) <= search(0) + 45  # a boundary is taken where there is one within reach, so an inside cut saves little
        offered = [e for e in range(n) if costs[e] < 40]
        if max(b - a for a, b in pairwise([*offered, n])) <= limits.high:
            assert total(text, cut(text, limits)) <= search(0) + 1e-6 or any(costs[e] >= 40 for e in range(n))


def test_pieces_end_where_the_text_does():
    text = "\n".join("Điều này phải được thực hiện trong mười ngày." for _ in range(80))
    assert all(text[b - 1] == "\n" for _, b in cut(text)[:-1])
    assert cut("x" * 1200) == [(0, 1200)] and len(cut("x" * 1201)) == 2
    with pytest.raises(ValueError, match="three times"):
        Limits(300, 100, 150)


def test_tokens_equal_the_public_library():
    regex, tokenizers = pytest.importorskip("regex"), pytest.importorskip("tokenizers")
    try:
        automaton = Automaton(Merges.read(VOCABULARY))
    except FileNotFoundError:
        pytest.skip("no vocabulary here")
    public = tokenizers.Tokenizer.from_file(VOCABULARY)
    public.encode_special_tokens = True
    rng = random.Random(3)
    texts = ["Điều 5. Mức thu là 45.600.000 đồng\n\n  trong 30 ngày.", "<|endoftext|>", "a" * 3000, "=-" * 500, " \x1c\x85 x", "'ll 'S", "́e"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x20, 0x250), rng.randrange(0x4E00, 0x4F00), 0x1F600, 10, 0xA0])) for _ in range(rng.randrange(1, 60))) for _ in range(500)]
    got = encode_texts([*texts, None, ""], _Words(automaton), regex.compile(SPLIT).findall).to_pylist()
    assert got == [*(e.ids for e in public.encode_batch(texts, add_special_tokens=False)), [], []]
    assert all(automaton.decode(ids) == t.encode() for ids, t in zip(got, texts, strict=False))


def test_small_automaton_against_merging_by_rank():
    rng = random.Random(11)
    for _ in range(40):
        merges: list[tuple[int, int]] = []
        labels = [bytes([b]) for b in range(256)]
        while len(merges) < 25:
            u, v = (rng.choice([97, 98, 99, *range(256, len(labels))]) for _ in range(2))
            if labels[u] + labels[v] not in labels and len(labels[u] + labels[v]) < 9:
                merges.append((u, v))
                labels.append(labels[u] + labels[v])
        automaton = Automaton(Merges(np.array(merges, np.int32), np.arange(len(labels), dtype=np.int32)))
        for _ in range(60):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 20)))
            tokens = list(word)
            for k, pair in enumerate(merges):
                out = []
                for t in tokens:
                    if out and (out[-1], t) == pair:
                        out[-1] = 256 + k
                    else:
                        out.append(t)
                tokens = out
            assert automaton.encode(word) == tuple(tokens)


def test_field_learns_order():
    rng = np.random.default_rng(0)
    features, tags, sizes = [], [], []
    for k in range(200):
        y = [0] * int(rng.integers(1, 4)) + [1] * int(rng.integers(1, 4)) if k else [0, 1] * 2500  # one very long sequence
        features += [([0, 1], [1.0, 1.0]) if rng.random() < (0.7 if t else 0.3) else ([0], [1.0]) for t in y]
        tags += y
        sizes.append(len(y))
    x, y = Positions.of(features), np.array(tags)
    weight = np.array([0.0] + [1.0] * 199)
    field = train(x, y, sizes, 2, 2, weight=weight)
    scores, at, right, count = x.scores(field.weights), 0, 0, 0
    for k, n in enumerate(sizes):
        if k:
            right += sum(a == b for a, b in zip(field.decode(scores[at : at + n]), tags[at : at + n], strict=True))
            count += n
        at += n
    assert right / count > 0.75
    assert isinstance(field, Field) and field.moves[1, 0] < field.moves[1, 1]
    assert len(field.decode(scores[: sizes[0]])) == 5000 and Positions.of([]).scores(field.weights).shape == (0, 2)


def test_gradient_of_the_field():
    """The likelihood of the trained field is higher than that of its neighbours."""
    rng = np.random.default_rng(4)
    features = [([int(rng.integers(3)), 3], [1.0, 0.5]) for _ in range(60)]
    sizes, tags = [3, 1, 6] * 6, rng.integers(0, 3, 60)
    x = Positions.of(features)

    def likelihood(field):
        total, at = 0.0, 0
        scores = x.scores(field.weights)
        for n in sizes:
            paths = np.array(np.meshgrid(*[range(3)] * n, indexing="ij")).reshape(n, -1).T
            s, y = scores[at : at + n], tags[at : at + n]
            value = lambda p, s=s, n=n: field.starts[p[0]] + field.ends[p[-1]] + sum(s[i, p[i]] for i in range(n)) + sum(field.moves[p[i], p[i + 1]] for i in range(n - 1))
            values = np.array([value(p) for p in paths])
            total += value(y) - values.max() - np.log(np.exp(values - values.max()).sum())
            at += n
        return total

    field = train(x, tags, sizes, 3, 4, rounds=300, ridge=0.0)
    best = likelihood(field)
    for name in ("weights", "moves", "starts", "ends"):
        moved = Field(field.weights.copy(), field.moves.copy(), field.starts.copy(), field.ends.copy())
        getattr(moved, name).flat[1] += 0.3
        assert likelihood(moved) < best


def test_clauses():
    assert clauses("Trả lời: Đúng, vì a. B; c\n2. Các") == ["Đúng", "vì a.", "B", "c", "Các"]
    assert clauses("D. sổ theo dõi") == ["sổ theo dõi"] and clauses("B.") == ["B."]
    assert final_words("một hai, BA.") == ("hai ba", "ba") and final_words("") == ("", "")
