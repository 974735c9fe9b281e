"""Model slots as column-producing stages, with deterministic offline stand-ins.

A scorer is a function from batches of texts to numbers. A real model is loaded once a worker inside it; the stand-ins
need none, and their figures say nothing about real models.
"""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PairScorer = Callable[[pd.Series, pd.Series], pd.Series]
Encoder = Callable[[pd.Series], list[np.ndarray]]
Answerer = Callable[[list], Sequence[str]]


#: White space of a regular expression in SQL: a no-break space and the like are part of a word.
_GAP = re.compile(r"[\t\n\f\r ]+")


def overlap_score(questions: pd.Series, texts: pd.Series) -> pd.Series:
    """The share of a question's distinct words that its text has; words end at white space as a regular expression in SQL has it."""
    out = []
    for q, t in zip(questions, texts, strict=True):
        a, b = (set(_GAP.split(x or "")) - {""} for x in (q, t))
        out.append(len(a & b) / len(a) if a else 0.0)
    return pd.Series(out, dtype="float64")


def hashed_words(texts: pd.Series, size: int = 64) -> list[np.ndarray]:
    """Unit vectors of word counts, words being hashed to places; a text without words is all zeros."""
    out = []
    for t in texts:
        v = np.zeros(size, np.float32)
        for w in (t or "").split():
            v[zlib.crc32(w.encode()) % size] += 1
        n = float(np.linalg.norm(v))
        out.append(v / n if n else v)
    return out


def score_pairs(pairs: DataFrame, question: str, text: str, scorer: PairScorer = overlap_score, out: str = "score", threshold: float = 0.5) -> DataFrame:
    """pairs with the scorer's number and whether it is above the threshold, in Arrow batches."""

    @F.pandas_udf(T.DoubleType())
    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        return scorer(q, t)

    return pairs.withColumn(out, run(F.col(question), F.col(text))).withColumn(f"{out}_predict", (F.col(out) > threshold).cast("int"))


def encode(texts: DataFrame, column: str, encoder: Encoder = hashed_words, out: str = "embedding") -> DataFrame:
    """texts with one vector each."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([v.tolist() for v in encoder(batch)])

    return texts.withColumn(out, run(F.col(column)))


def answer(prompts: DataFrame, key: str, prompt: str, answerer: Answerer, batch_rows: int = 64, pause: float = 0.0) -> DataFrame:
    """(key, answer): the answerer takes up to batch_rows prompts at once and gives as many answers; with a pause between the calls of a task."""
    narrow = prompts.select(F.col(key).alias("k"), F.col(prompt).alias("p"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), batch_rows):
                part = batch.iloc[begin : begin + batch_rows]
                yield pd.DataFrame({"k": part["k"], "answer": pd.Series(list(answerer(part["p"].tolist())), index=part.index, dtype=object)})
                if pause:
                    time.sleep(pause)

    schema = T.StructType([T.StructField("k", narrow.schema["k"].dataType), T.StructField("answer", T.StringType())])
    return narrow.mapInPandas(run, schema).withColumnRenamed("k", key)
