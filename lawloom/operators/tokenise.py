"""Pairs of texts as token ids of a public vocabulary, cut to a length, as training of a model wants them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tokenised_pairs(pairs: DataFrame, first: str, second: str, vocabulary: str, length: int = 256) -> DataFrame:
    """pairs with input_ids, token_types (0 for the first text, 1 for the second) and whether anything was cut.

    The longer of the two texts is cut first, one token at a time, until both have at most `length` tokens together; a null text
    has none. Special tokens are left to the model. The vocabulary is a file of the tokenizers library, read once by the
    driver and sent as text; texts go through in Arrow batches.
    """
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(vocabulary).to_str()
    shared = pairs.sparkSession.sparkContext.broadcast(model)  # the vocabulary: a few megabytes
    kind = T.StructType([T.StructField("input_ids", T.ArrayType(T.IntegerType())), T.StructField("token_types", T.ArrayType(T.IntegerType())), T.StructField("cut", T.BooleanType())])

    @F.pandas_udf(kind)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        tokenizer = Tokenizer.from_str(shared.value)
        for a, b in batches:
            sides = [[e.ids for e in tokenizer.encode_batch(s.fillna("").tolist(), add_special_tokens=False)] for s in (a, b)]
            rows = []
            for x, y in zip(*sides, strict=True):
                keep = max(0, min(len(x), max(length - len(y), length // 2))), max(0, min(len(y), max(length - len(x), length - length // 2)))
                rows.append((x[: keep[0]] + y[: keep[1]], [0] * keep[0] + [1] * keep[1], keep != (len(x), len(y))))
            yield pd.DataFrame(rows, columns=["input_ids", "token_types", "cut"])

    return pairs.withColumn("__t", run(F.col(first), F.col(second))).select("*", "__t.*").drop("__t")
