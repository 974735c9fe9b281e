"""Exact and near overlaps between splits: training texts are streamed through FM-indexes of the evaluation texts."""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawloom.llm.fmindex import FMIndex, spread
from lawloom.llm.words import joined_words
from lawloom.plans import new_folder, staged
from lawloom.plans.stored import StoredTable

#: Words of an index shard, training texts of a task, and words of the texts searched at once: bounds of memory that change no result.
SHARD_WORDS, TASK_TEXTS, AT_ONCE = 500_000, 20_000, 200_000


def edits(size_a: int | np.ndarray, size_b: int | np.ndarray, percent: int) -> np.ndarray:
    """The edits allowed between texts of these sizes: percent of the words of the longer, rounded down."""
    return np.maximum(size_a, size_b) * percent // 100


def edit_distance(a: Sequence[int], b: Sequence[int]) -> int:
    """Words to insert, delete or replace to turn a into b, by bit-parallel dynamic programming over whole columns."""
    if not a or not b:
        return len(a) or len(b)
    places: dict[int, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for w in b:
        eq = places.get(w, 0)
        vertical = eq | down
        horizontal = (((eq & up) + up) ^ up) | eq
        plus, minus = down | ~(horizontal | up), up & horizontal
        score += bool(plus & top) - bool(minus & top)
        plus, minus = plus << 1 | 1, minus << 1
        up, down = (minus | ~(vertical | plus)) & full, plus & vertical & full
    return score


def common_words(bag: Mapping[int, int], other: Sequence[int]) -> int:
    """The words of other that a text with this many of each has too, repeated ones as often as both have them."""
    left, common = dict(bag), 0
    for w in other:
        if left.get(w):
            left[w] -= 1
            common += 1
    return common


def _gram_size(n: int, percent: int) -> int:
    """The longest grams, of 3 words at most, of which a near text keeps at least one for certain; 0 if not even words do."""
    longest = n * 100 // (100 - percent)
    k = longest * percent // 100
    return next((q for q in (3, 2, 1) if n - q + 1 - k * q >= 1), 0)


def factors_bound(length: np.ndarray, most: int) -> bool:
    """Whether a text, given the longest match that ends at each of its words, falls into at most `most` matches with a word between them.

    A text within k edits of another is made of at most k + 1 pieces of it, with at most one word of its own between two;
    taking the longest match from the right each time needs no more.
    """
    at, used = len(length) - 1, 0
    while at >= 0:
        used += 1
        if used > most:
            return False
        at -= int(length[at]) + 1
    return True


class EvalShard:
    """The index of some evaluation texts, ordered by size."""

    def __init__(self, keys: Sequence, texts: Sequence[list[str]]) -> None:
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        self.keys = [keys[i] for i in order]
        texts = [texts[i] for i in order]
        self.index = FMIndex(texts, sample=4)
        self.numbers = [self.index.numbers(t).tolist() for t in texts]
        self.sizes = np.array([len(t) for t in texts], np.int64)

    def near(self, texts: Sequence[list[str]], percent: int) -> Iterator[tuple[int, object, int, list[tuple[int, int]]]]:
        """(number of the text, key of an evaluation text, edits, matched spans) for all pairs within percent of the words of the longer, equal ones too.

        Every word of the training texts is extended backwards until nothing matches any more. A text that falls into
        more maximal matches than edits allow is near no evaluation text. For the others, the matches of q words and more
        are located and counted by pair: an edit spoils q grams at most, so pairs with fewer than n - q + 1 - kq common
        ones can't be near, nor can those with fewer common words, in whatever order, than the longer has without its
        edits. The few that remain are compared word by word, and their matches merged into spans of the training text
        (first word, word after the last).
        """
        begin = 0
        while begin < len(texts):
            end, words = begin, 0
            while end < len(texts) and (end == begin or words + len(texts[end]) <= AT_ONCE):
                words += len(texts[end])
                end += 1
            for text, *found in self._near(texts[begin:end], percent):
                yield begin + text, *found
            begin = end

    def _near(self, texts: Sequence[list[str]], percent: int) -> Iterator[tuple[int, object, int, list[tuple[int, int]]]]:
        numbers = [self.index.numbers(t) for t in texts]
        sizes = np.array([len(t) for t in numbers], np.int64)
        q = np.array([_gram_size(n, percent) for n in sizes.tolist()], np.int64)
        joined = np.concatenate(numbers)
        first = np.concatenate([[0], np.cumsum(sizes)])
        room = np.arange(len(joined)) - np.repeat(first[:-1], sizes) + 1
        length, low, high = self.index.matching(joined, room, np.repeat(q, sizes))
        for text, (n, gram) in enumerate(zip(sizes.tolist(), q.tolist(), strict=True)):
            if not factors_bound(length[first[text] : first[text + 1]], n * 100 // (100 - percent) * percent // 100 + 1):
                low[first[text] : first[text + 1]] = high[first[text] : first[text + 1]] = 0
                q[text] = -1
        windows: dict[int, tuple[int, int, np.ndarray, np.ndarray]] = {}
        postings = {g: self._postings(low, high, np.repeat(q, sizes) == g) for g in (1, 2, 3)}
        for text, (known, n, gram) in enumerate(zip(numbers, sizes.tolist(), q.tolist(), strict=True)):
            if n not in windows:
                windows[n] = self._window(n, percent)
            begin, end, allowed, least = windows[n]
            if begin >= end or gram < 0:
                continue
            if gram:
                which, offsets, held = postings[gram]
                mine = which[first[text] : first[text + 1]]
                mine = mine[mine >= 0]
                at, _ = spread(offsets[mine], offsets[mine + 1])
                counts = np.bincount(held[at], minlength=len(self.sizes))[begin:end]
                close = np.flatnonzero(counts >= least)
            else:
                close = np.arange(end - begin)
            own = known.tolist()
            bag = Counter(own) if len(close) else {}
            for c in close.tolist():
                other = self.numbers[begin + c]
                if max(n, len(other)) - common_words(bag, other) > allowed[c]:
                    continue
                apart = edit_distance(own, other)
                if apart <= allowed[c]:
                    yield text, self.keys[begin + c], apart, matched(own, other, max(1, gram))

    def _window(self, n: int, percent: int) -> tuple[int, int, np.ndarray, np.ndarray]:
        """The texts (first, after the last) whose sizes are near n words, the edits allowed for each, and the common grams needed."""
        begin = int(np.searchsorted(self.sizes, -(-n * (100 - percent) // 100), side="left"))
        end = int(np.searchsorted(self.sizes, n * 100 // (100 - percent), side="right"))
        allowed, gram = edits(n, self.sizes[begin:end], percent), _gram_size(n, percent)
        return begin, end, allowed, n - gram + 1 - allowed * gram

    def _postings(self, low: np.ndarray, high: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the positions asked for: the number of each one's match (-1 for none), and by number where its texts begin and which they are."""
        which = np.full(len(low), -1, np.int64)
        at = np.flatnonzero(asked & (high > low))
        distinct, place, which[at] = np.unique(low[at], return_index=True, return_inverse=True)
        ends, pairs = high[at][place], []
        begin = 0
        while begin < len(distinct):
            upto = begin + max(1, int(np.searchsorted(np.cumsum(ends[begin:] - distinct[begin:]), 2_000_000, side="right")))
            rows, owner = spread(distinct[begin:upto], ends[begin:upto])
            found = np.sort((owner + begin) * len(self.sizes) + self.index.texts_of(self.index.locate(rows)))
            pairs.append(found[np.diff(found, prepend=-1) > 0])
            begin = upto
        both = np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
        offsets = np.searchsorted(both // max(1, len(self.sizes)), np.arange(len(distinct) + 1))
        return which, offsets, (both % max(1, len(self.sizes))).astype(np.int32)


def matched(text: Sequence[int], other: Sequence[int], q: int) -> list[tuple[int, int]]:
    """The spans (first word, word after the last) of text made of runs of q words and more that other has, merged."""
    grams = {tuple(other[i : i + q]) for i in range(len(other) - q + 1)}
    spans: list[tuple[int, int]] = []
    for i in range(len(text) - q + 1):
        if tuple(text[i : i + q]) in grams:
            if spans and spans[-1][1] >= i:
                spans[-1] = (spans[-1][0], i + q)
            else:
                spans.append((i, i + q))
    return spans


FOUND = "train_words string, eval_words string, edits int, spans array<struct<first_word: int, end_word: int>>"


def near_pairs(train: DataFrame, held_out: DataFrame, percent: int = 20, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(train_words, eval_words, edits, spans) for texts (words: joined canonical words, distinct and not null) within percent edits.

    Evaluation texts are dealt into shards of about shard_words words, whose indexes are written to the shared folder
    once. Training texts are shuffled once, into tasks of about TASK_TEXTS; each task reads the indexes one after
    another, so neither side is copied, and neither a hot text (texts are distinct here) nor a hot gram makes a task
    larger. All pairs within the limit come out, whatever the texts.
    """
    spark = train.sparkSession
    shards = int((held_out.agg(F.sum(F.size(F.split("words", " ")))).first()[0] or 0) // shard_words) + 1
    tasks = max(int(train.count() // TASK_TEXTS) + 1, 2 * spark.sparkContext.defaultParallelism)

    def build(group: pd.DataFrame) -> pd.DataFrame:
        words = group["words"].sort_values().tolist()
        shard = EvalShard(words, [w.split(" ") for w in words])
        return pd.DataFrame({"part": [group["part"].iloc[0]], "index": [pickle.dumps(shard, protocol=5)]})

    path = new_folder(spark, "evaluation")
    placed = held_out.select(F.pmod(F.xxhash64("words"), F.lit(shards)).cast("int").alias("part"), "words")
    placed.groupBy("part").applyInPandas(build, "part int, index binary").write.parquet(path)
    stored = StoredTable(path)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = [w for batch in batches for w in batch["words"]]  # about TASK_TEXTS
        texts = [w.split(" ") for w in kept]
        for part in range(shards) if texts else ():
            for index in stored.part(part, "index"):
                shard = pickle.loads(index)
                found = [(kept[i], k, n, [{"first_word": a, "end_word": b} for a, b in spans]) for i, k, n, spans in shard.near(texts, percent)]
                if found:
                    yield pd.DataFrame(found, columns=["train_words", "eval_words", "edits", "spans"])

    return train.repartition(tasks, "words").mapInPandas(search, FOUND)


def split_overlaps(texts: DataFrame, percent: int = 20) -> DataFrame:
    """Pairs of a training and an evaluation record whose texts are equal or near, for texts (record, text, side, ...).

    side is "train" or "eval"; other sides and nulls take no part, nor do texts without a word or null records. Columns:
    train_record and eval_record, then the other columns of each with the same prefix, then edits and spans: the words to
    insert, delete or replace, and the merged spans of the training text's words that match. Records of equal words are
    compared once and only listed as pairs at the end, as the result asks for; repeated rows count once.
    """
    others = [c for c in texts.columns if c not in ("record", "text", "side")]
    rows = texts.where(F.col("side").isin("train", "eval") & F.col("record").isNotNull()).withColumn("words", joined_words("text"))
    rows = staged(rows.where(F.col("words").isNotNull()).select("record", "side", "words", *others).distinct(), "texts")
    train, held_out = rows.where("side = 'train'"), rows.where("side = 'eval'")
    pairs = staged(near_pairs(staged(train.select("words").distinct(), "train"), held_out.select("words").distinct(), percent), "pairs")
    own = lambda side, table: table.select(F.col("words").alias(f"{side}_words"), F.col("record").alias(f"{side}_record"), *[F.col(c).alias(f"{side}_{c}") for c in others])
    listed = pairs.join(own("train", train), "train_words").join(own("eval", held_out), "eval_words")
    return listed.select("train_record", *[f"train_{c}" for c in others], "eval_record", *[f"eval_{c}" for c in others], "edits", "spans")
