"""Defective question-answer pairs: clauses are tagged by a conditional random field, and their coverage decides the defect."""

from __future__ import annotations

import random
import re
import unicodedata
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lawloom.llm import seeds
from lawloom.llm.crf import Field, Positions, train
from lawloom.llm.words import canonical_words
from lawloom.plans import join_unique, spread_out, staged

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
#: Answers of the sample that the field is trained on, and words of the questions that count as known.
SAMPLE, KNOWN = 3000, 5000

# Fixed values, in the form of canonical words: what stands for no answer.
PLACEHOLDERS = frozenset((
    "none", "null", "nan", "nil", "n a", "na", "khong co", "khong co cau tra loi", "khong co tra loi", "chua co cau tra loi", "chua co", "chua tra loi", "khong tra loi", "trong", "de trong", "bo trong", "rong", "empty", "no answer", "no response", "not available", "tbd", "todo", "undefined", "unknown", "chua cap nhat", "dang cap nhat", "khong co du lieu", "khong co noi dung",
))
# Labels before an answer, list markers, and verdicts, which are clauses of their own.
_LABEL = re.compile(r"^\W*(?:(?:câu\s+)?trả\s+lời|đáp\s+án|câu\s+hỏi|hỏi|đáp|answer|question|tra\s+loi|cau\s+tra\s+loi|dap\s+an|cau\s+hoi|réponse|antwort|q|a)\s*[:：]\s*", re.IGNORECASE)
_MARKER = re.compile(r"^\W*(?:\d{1,3}|[a-zđ]|[ivx]{1,4})\s*[.)]\s+", re.IGNORECASE)
_LONE_MARKER = re.compile(r"(?:^|[\s;.:,])(?:\d{1,3}|[a-zđ]|[ivx]{1,4})\s*[.)]?$", re.IGNORECASE)
_VERDICT = re.compile(r"^\W*(đúng|sai|có|không|dung|co|khong)\s*[,.:;!]\s*(?=\w)", re.IGNORECASE)
_SPELT = re.compile(r"[^\W\d_]+")
_BREAK = re.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])|[;\n]+")
_CLOSED = ".!?。！？)]}”\"’»"
_SHARES = (0.0, 0.03, 0.1, 0.3)
FEATURES = (
    "bias", "first", "last", "only", "words_1", "words_2", "words_4", "words_8", "words_more", "marks_only", "other_script", "known_none", "known_few", "known_half", "known_most", "known_all", "accents_none", "accents_some", "accents_many",
    "echo_low", "echo_half", "echo_most", "echo_all", "whole_low", "whole_half", "whole_most", "echo_all_whole", "echo_most_whole",
    "closed", "ellipsis", "open_mark", "open_bracket", "lone_marker", "bare", "pair_new", *(f"pair_{k}" for k in range(5)), "word_new", *(f"word_{k}" for k in range(5)), "brief_new", *(f"brief_{k}" for k in range(5)),
)
_AT = {name: i for i, name in enumerate(FEATURES)}
#: What an answer of the sample counts if it seems to break off: many do that end without a mark.
_DOUBTED = 0.4
#: The probability of a defect from which an answer of the sample isn't taken for sound.
_UNSURE = 0.15
#: Places of the hashed features: words with and without accents, pairs of words, last words, and letters of words that the questions don't have.
HASHED = 1 << 14
WIDTH = len(FEATURES) + HASHED
#: Words and pairs whose places a worker keeps; beyond it the table starts anew, which changes no result.
TABLE = 400_000


def clauses(answer: str) -> list[str]:
    """The clauses of an answer: sentences and list entries, without labels and list markers; a leading verdict is one of its own."""
    out = []
    for line in re.split(r"\n+", _LABEL.sub("", answer)):
        line = _LABEL.sub("", line)
        line = _MARKER.sub("", line) if canonical_words(_MARKER.sub("", line)) else line
        for piece in _BREAK.split(line):
            if m := _VERDICT.match(piece):
                out.append(m.group(1))
                piece = piece[m.end() :]
            if canonical_words(piece):
                out.append(piece.strip())
    return out


def _stripped(text: str) -> str:
    """text without trailing white space, invisible characters and emphasis marks."""
    return re.sub(r"[\s​﻿ *_`~]+$", "", text)


def final_words(answer: str) -> tuple[str, str]:
    """The last two canonical words of an answer, or as many as there are, and its last one."""
    words = canonical_words(answer)[-2:]
    return " ".join(words), words[-1] if words else ""


def ending_counts(texts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(gram, seen, ended, bare) of the texts of a partition: how often two words, or one, are seen, end a clause with a mark, or end the text without one."""
    for batch in texts:
        tally: dict[str, list[int]] = {}
        for text in batch["t"]:
            body = _stripped(text or "")
            marked = body[-1:] in ".!?。！？"
            lines = [c for c in re.split(r"(?<=[.!?;])\s+|[;\n]+", body) if c.strip()]
            for k, line in enumerate(lines):
                words = canonical_words(line)
                final = k + 1 == len(lines)
                for i, w in enumerate(words):
                    ends = i + 1 == len(words)
                    for gram in (w, f"{words[i - 1]} {w}") if i else (w,):
                        count = tally.setdefault(gram, [0, 0, 0])
                        count[0] += 1
                        count[1] += ends and (not final or marked)
                        count[2] += ends and final and not marked
        yield pd.DataFrame([(g, *c) for g, c in tally.items()], columns=["gram", "seen", "ended", "bare"])


class Reader:
    """Features of clauses; known are the frequent words of the questions, which are in the language that answers should be in."""

    def __init__(self, known: frozenset[str]) -> None:
        self.known = known
        self.places: dict[str, tuple[int, ...]] = {}

    def _word(self, word: str) -> tuple[int, ...]:
        found = self.places.get(word)
        if found is None:
            kinds = ["w:#"] if word.isdigit() else [f"w:{word}"]
            if not word.isascii():
                kinds += [f"g:{c}" for c in word] + [f"g:{word[i : i + 2]}" for i in range(len(word) - 1)]
            elif word not in self.known and not word.isdigit():
                edged = f"^{word[:40]}$"
                kinds += [f"c:{edged[i : i + 3]}" for i in range(len(edged) - 2)]
            found = self._keep(word, kinds)
        return found

    def _keep(self, name: str, kinds: Sequence[str]) -> tuple[int, ...]:
        if len(self.places) > TABLE:
            self.places.clear()
        places = tuple(len(FEATURES) + zlib.crc32(k.encode()) % HASHED for k in kinds)
        self.places[name] = places
        return places

    def _pair(self, a: str, b: str) -> tuple[int, ...]:
        name = f"{a} {b}"
        return self.places.get(name) or self._keep(name, [f"b:{name}"])

    def _spelling(self, word: str) -> tuple[int, ...]:
        name = f"~{word}"
        return self.places.get(name) or self._keep(name, [f"r:{word}"])

    def _end(self, words: str) -> tuple[int, ...]:
        name = f"{words}$"
        return self.places.get(name) or self._keep(name, [f"e:{words}"])

    def read(self, answer: str, question: str, pair: Sequence[float], word: Sequence[float], own: bool) -> tuple[list[int], list[tuple[list[int], list[float]]]]:
        """The number of words of each clause, and its features as (places, values).

        pair, word: seen, ended and bare counts of the answer's last two words and of its last one over all answers;
        own: whether the answer is one of those counted, so that it isn't evidence for itself.
        """
        parts = clauses(answer) or [answer]
        told = [canonical_words(p) for p in parts]
        asked = canonical_words(question)
        grams = set(zip(asked, asked[1:], strict=False))
        said = {g for w in told for g in zip(w, w[1:], strict=False)} if grams else set()
        whole = sum(g in said for g in grams) / len(grams) if grams else 0.0
        out = []
        for i, (part, words) in enumerate(zip(parts, told, strict=True)):
            on = ["bias"]
            n = len(words)
            on.append("words_1" if n < 2 else "words_2" if n == 2 else "words_4" if n < 5 else "words_8" if n < 9 else "words_more")
            if i == 0:
                on.append("first")
            if len(parts) == 1:
                on.append("only")
            letters = [w for w in words if not w.isdigit() and (len(w) > 1 or not w.isascii())]
            if not letters:
                on.append("marks_only")
            else:
                other = sum(1 for w in letters if not w.isascii() and not unicodedata.name(w[0], "").startswith("LATIN"))
                if other * 2 >= len(letters):
                    on.append("other_script")
                share = sum(w in self.known for w in letters) / len(letters)
                on.append("known_none" if share == 0 else "known_few" if share < 0.4 else "known_half" if share < 0.7 else "known_most" if share < 1 else "known_all")
                spoken = part.split()
                accents = sum(not w.isascii() for w in spoken) / len(spoken)
                on.append("accents_none" if accents == 0 else "accents_some" if accents < 0.3 else "accents_many")
            own_grams = list(zip(words, words[1:], strict=False))
            if grams and own_grams:
                shared = sum(g in grams for g in own_grams) / len(own_grams)
                echo = "echo_all" if shared >= 0.85 else "echo_most" if shared >= 0.65 else "echo_half" if shared >= 0.4 else "echo_low"
                covers = "whole_most" if whole >= 0.7 else "whole_half" if whole >= 0.4 else "whole_low"
                on += [echo, covers]
                if covers == "whole_most" and echo in ("echo_all", "echo_most"):
                    on.append(f"{echo}_whole")
            if i + 1 == len(parts):
                on += ["last", *self._ending(answer, parts, words, pair, word, own)]
            places = [_AT[name] for name in on]
            hashed = [p for w in words for p in self._word(w)]
            hashed += [p for a, b in own_grams for p in self._pair(a, b)]
            if not part.isascii():
                spelt = _SPELT.findall(unicodedata.normalize("NFC", part).lower())
                hashed += [p for w in spelt if not w.isascii() for p in self._spelling(w)]
            if i + 1 == len(parts) and "closed" not in on:
                spelt = _SPELT.findall(unicodedata.normalize("NFC", answer).lower())[-2:]
                places += [p for last in (spelt[-1:], spelt) if last for p in self._end(" ".join(last))]
            value = 2.0 / max(1, len(hashed)) ** 0.5
            out.append((places + hashed, [1.0] * len(places) + [value] * len(hashed)))
        return [len(w) for w in told], out

    @staticmethod
    def _ending(answer: str, parts: Sequence[str], words: Sequence[str], pair: Sequence[float], word: Sequence[float], own: bool) -> list[str]:
        """What the end of an answer looks like, and how often its last words end a clause elsewhere."""
        body = _stripped(answer)
        dots = body.endswith(("…", "..."))
        lone = len(parts) > 1 and _LONE_MARKER.search(body) is not None and re.search(r"(?:^|[\s;:.])(?:\d{1,3}|[a-zđ])[.)]?$", body) is not None
        if body[-1:] in _CLOSED and not dots and not lone:
            return ["closed"]
        on = ["ellipsis"] if dots else []
        inner = _stripped(body.rstrip(".…"))
        if inner[-1:] in ",:;-–—(/[&“":
            on.append("open_mark")
        if any(inner.count(a) > inner.count(b) for a, b in ("()", "[]", "“”")) or answer.count("`") % 2 == 1 or answer.count("**") % 2 == 1:
            on.append("open_bracket")
        if lone:
            on.append("lone_marker")
        for name, (seen, ended, bare) in (("brief" if len(words) < 5 and len(parts) == 1 else "pair", pair), ("word", word)):
            seen, bare = seen - own, bare - own
            if seen <= 0:
                on.append(f"{name}_new")
            else:
                share = (ended + (max(0.0, bare) if name == "brief" else 0.0)) / seen
                if name == "pair" and bare > 0:
                    on.append("bare")
                on.append(f"{name}_{sum(share > s for s in _SHARES)}")
        return on


def plain(text: str) -> str:
    """text without diacritics, as it's typed on plain keyboards."""
    return unicodedata.normalize("NFD", text.replace("đ", "d").replace("Đ", "D")).encode("ascii", "ignore").decode()


Example = tuple[str, str, int, bool]  # answer, question, tag, whether it is one of the sample


def examples(sample: pd.DataFrame, seed: int = 5) -> list[Example]:
    """Answers with the tag of their clauses: those of the sample, taken for sound, and corruptions of them; then the seeds.

    Tag 4 holds for the last clause only. An example of a question and an answer after it has tag -2: the first clauses echo.
    """
    rng = random.Random(seed)
    out: list[Example] = []
    for answer, question in sample[["answer", "question"]].drop_duplicates("answer").itertuples(index=False):
        question = question or ""
        out.append((answer, question, 0, True))
        body = _stripped(answer).split()
        for _ in range(2 if len(body) > 8 else 0):
            end = rng.randrange(4, len(body))
            head = " ".join(body[:end])
            if rng.random() < 0.25 and len(body[end]) > 3:
                out.append((f"{head} {body[end][: rng.randrange(1, len(body[end]) - 1)]}", question, 4, False))
            elif head[-1:] not in ".!?;,:":
                out.append((head + rng.choice(["", "", "", "", "…", "...", ",", ",", " (", " “", " [", ";\nb)", ".\n2. ", "\n3.", "\n- ", "\n- ", ",", ".\n2. Các", ":", *[" " + rng.choice(seeds.CUT) for _ in range(8)]]), question, 4, False))
        asked = question.split()
        if len(asked) > 4 and rng.random() < 0.4:
            kind = rng.randrange(5)
            if kind < 3:
                drop = rng.randrange(len(asked))
                near = " ".join(w for i, w in enumerate(asked) if i != drop or rng.random() < 0.5)
                near = rng.choice([near, near.upper(), near.rstrip("?"), near.rstrip("?") + "…", f"{near}\n{near}", near.lower()])
                out.append((rng.choice(["", "", "Câu hỏi: ", "Trả lời: "]) + near, question, 2, False))
            elif kind == 3 and len(body) > 8:
                out.append((f"{question}\n{answer}", question, -2, False))
            elif kind == 4 and len(asked) > 12:
                begin = rng.randrange(len(asked) // 2)
                out.append((" ".join(asked[begin : begin + len(asked) // 3]).rstrip("?,") + " " + rng.choice(["là đúng.", "theo quy định.", "trong 30 ngày."]), question, 0, False))
    questions = [q or "" for q in sample["question"]] or [""]
    for said in sorted(set(questions)):
        words = said.rstrip("?. ").split()
        if len(words) > 4:
            begin = rng.randrange(len(words) - 3)
            out.append((" ".join(words[begin:] if rng.random() < 0.5 else words) + rng.choice([".", ".", "!", ""]), rng.choice(questions), 0, False))
    taught = lambda said, tag: out.append((said, rng.choice(questions), tag, False))
    for said in seeds.refusals(rng, 900):
        taught(rng.choice(["", "", "", "Trả lời: ", "**", "Hiện tại, "]) + said, 1)
        words = said.split()
        if len(words) > 6 and rng.random() < 0.15:
            taught(" ".join(words[: -rng.randrange(1, 3)]), 1)
        if rng.random() < 0.3:
            taught(f"{said} {rng.choice(seeds.OTHER_REFUSALS)}" if said.isascii() else f"{said}\n{rng.choice(seeds.MORE_REFUSALS)}", 1)
        if rng.random() < 0.3:
            taught(plain(said), 1)
    for said in seeds.statements(rng, 600):
        taught(rng.choice(["", "", "", "Đáp án: ", "Answer: ", "**"]) + said, 3)
    for said in seeds.SHORT * 9 + seeds.SOUND * 3:
        taught(rng.choice([said, said, plain(said)]), 0)
    return [e for e in out if canonical_words(e[0])]


def fit(chosen: Sequence[Example], counts: dict[str, tuple[float, float, float]], reader: Reader) -> Field:
    """The field, trained three times, as the sample has no labels and some of its answers are defective.

    First its answers don't count at all, and what other questions say stands for sound ones: no question is a refusal, and
    both are about the same things. What a field finds defective teaches the next one nothing as a sound answer, nor do the
    corruptions of it, but for those that only seem to break off; where all its clauses are refusals, or foreign, with a probability of 0.9, it's an example of that.
    """
    zero = (0.0, 0.0, 0.0)
    features, tags, sizes = [], [], []
    for answer, question, tag, own in chosen:
        pair, word = final_words(answer)
        _, x = reader.read(answer, question, counts.get(pair, zero), counts.get(word, zero), own)
        n = len(x)
        if tag == -2:
            asked = min(n - 1, max(1, len(clauses(question))))
            y = [2] * asked + [0] * (n - asked)
        else:
            y = [0] * (n - 1) + [4] if tag == 4 else [tag] * n
        features += x
        tags += y
        sizes.append(n)
    x, y = Positions.of(features), np.array(tags)
    weight = np.array([0.0 if own else 1.0 for _, _, _, own in chosen])
    field = train(x, y, sizes, len(TAGS), WIDTH, rounds=25, weight=weight)
    for rounds in (30, 40):
        scores, weight, learnt, at, suspect = x.scores(field.weights), np.ones(len(sizes)), y.copy(), 0, False
        for k, (n, (_, _, tag, own)) in enumerate(zip(sizes, chosen, strict=True)):
            here = scores[at : at + n]
            if own:
                found = field.decode(here)
                odds = np.exp(here - here.max(axis=1, keepdims=True))
                odds /= odds.sum(axis=1, keepdims=True)
                other, broken = odds[:, [1, 3]].sum(axis=1).max() > _UNSURE, odds[-1, 4] > _UNSURE
                suspect = other or broken or any(found)
                if suspect:
                    weight[k] = 0.0 if other or set(found) - {0, 4} else _DOUBTED
                    if found[0] in (1, 3) and len(set(found)) == 1 and odds[:, found[0]].min() >= 0.9:
                        learnt[at : at + n], weight[k] = found[0], 1.0
            elif suspect and tag in (4, -2):
                weight[k] = 0.0
            at += n
        field = train(x, learnt, sizes, len(TAGS), WIDTH, rounds=rounds, weight=weight)
    return field


def is_empty(answer: str | None) -> bool:
    words = canonical_words(answer)
    return not words or " ".join(words) in PLACEHOLDERS


def defect(sizes: Sequence[int], tags: Sequence[int]) -> str | None:
    """The first defect that applies to an answer with clauses of these sizes and tags; None for a sound answer."""
    total = sum(sizes) or 1
    share = [sum(n for n, tag in zip(sizes, tags, strict=True) if tag == t) / total for t in range(len(TAGS))]
    if share[1] >= 0.5:
        return "refusal"
    if share[2] >= 0.9:
        return "copy"
    if share[3] > 0.5:
        return "language"
    return "truncated" if tags[-1] == 4 else None


def judged(answers: Sequence[str | None], questions: Sequence[str | None], pairs: Sequence, words: Sequence, reader: Reader, field: Field) -> list[str | None]:
    """The defect of each answer; the clauses of all are scored at once."""
    zero = (0.0, 0.0, 0.0)
    out: list[str | None] = []
    sizes, features = [], []
    for answer, question, pair, word in zip(answers, questions, pairs, words, strict=True):
        if is_empty(answer):
            out.append("empty")
            sizes.append([])
            continue
        n, x = reader.read(answer, question or "", zero if pair is None else pair, zero if word is None else word, True)
        out.append(None)
        sizes.append(n)
        features += x
    scores, at = Positions.of(features).scores(field.weights), 0
    for k, n in enumerate(sizes):
        if n:
            out[k] = defect(n, field.decode(scores[at : at + len(n)]))
            at += len(n)
    return out


def answer_defects(answers: DataFrame, questions: DataFrame, sample_rows: int = SAMPLE) -> DataFrame:
    """(answer_id, defect) for answers (answer_id, question_id, answer) and questions (question_id, text); defect is null for sound answers.

    A null answer is empty; a missing or null question leaves nothing to copy. Of several texts of one question the
    smallest counts; every distinct row of an answer is judged, and repeats come once. Empty tables give an empty one;
    other columns aren't read.

    How often a word, or two, end a clause is counted over all answers, and joined to each answer by its last words. The
    words that the questions use most are known ones. The field is trained on the driver on a sample of at most sample_rows
    answers, drawn by hash, on corruptions of them with the counts of the words they are cut at, and on seeds.py; all
    answers are tagged. Joins are salted by exact counts, where one question or one ending has very many answers.
    """
    spark = answers.sparkSession
    asked = staged(questions.where(F.col("question_id").isNotNull() & F.col("text").isNotNull()).groupBy("question_id").agg(F.min("text").alias("question")), "asked")
    rows = join_unique(answers.select("answer_id", "question_id", "answer").distinct(), asked, ["question_id"], "left")
    last = F.pandas_udf(lambda s: pd.DataFrame([final_words(t or "") for t in s], columns=["pair", "word"]), T.StructType([T.StructField("pair", T.StringType()), T.StructField("word", T.StringType())]))
    rows = staged(rows.select("answer_id", "answer", "question", last("answer").alias("last")).select("answer_id", "answer", "question", F.col("last.pair").alias("p"), F.col("last.word").alias("w")), "answers")
    counts = spread_out(rows.select(F.col("answer").alias("t")).where(F.col("t").isNotNull())).mapInPandas(ending_counts, "gram string, seen long, ended long, bare long")
    counts = staged(counts.groupBy("gram").agg(F.array(*[F.sum(c).cast("double") for c in ("seen", "ended", "bare")]).alias("n")), "endings")

    words = F.pandas_udf(lambda s: pd.Series([canonical_words(t) for t in s]), T.ArrayType(T.StringType()))
    frequent = asked.select(F.explode(F.array_distinct(words("question"))).alias("word")).groupBy("word").count().where(F.col("count") > 1)
    known = frozenset(r["word"] for r in frequent.orderBy(F.col("count").desc(), "word").limit(KNOWN).collect())
    total = rows.count()
    drawn = rows.where(F.col("answer").isNotNull() & (F.pmod(F.xxhash64("answer_id", "answer"), F.lit(1 << 20)) < int(min(1.0, 1.2 * sample_rows / max(1, total)) * (1 << 20)) + 1))
    sample = drawn.select("answer", "question").orderBy(F.xxhash64("answer_id", "answer"), "answer_id").limit(sample_rows).toPandas()
    chosen = examples(sample)
    ends = sorted({gram for e in chosen for gram in final_words(e[0])})  # two for each example at most
    table = counts.join(F.broadcast(spark.createDataFrame([(g,) for g in ends], "gram string")), "gram").collect()
    reader = Reader(known)
    shared = spark.sparkContext.broadcast((known, fit(chosen, {r["gram"]: tuple(r["n"]) for r in table}, reader)))

    of = lambda name: counts.select(F.col("gram").alias(name), F.col("n").alias(f"{name}_counts"))
    counted = join_unique(join_unique(rows, of("p"), ["p"], "left"), of("w"), ["w"], "left").select("answer_id", "answer", "question", "p_counts", "w_counts")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Reader(shared.value[0])
        for batch in batches:
            found = judged(batch["answer"], batch["question"], batch["p_counts"], batch["w_counts"], own, shared.value[1])
            yield pd.DataFrame({"answer_id": batch["answer_id"], "defect": pd.Series(found, dtype=object)})

    schema = T.StructType([T.StructField("answer_id", rows.schema["answer_id"].dataType), T.StructField("defect", T.StringType())])
    return spread_out(counted).mapInPandas(judge, schema).distinct()
