"""Passages of held-out items inside a corpus, found in an FM-index of each corpus shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lawloom.llm.fmindex import FMIndex, spread
from lawloom.llm.words import canonical_words, joined_words
from lawloom.plans import is_small, new_folder, spread_out, staged
from lawloom.plans.stored import StoredTable

#: Words of a shard, characters of a block of items, and occurrences located at once: bounds of memory that change no result.
SHARD_WORDS, ITEM_CHARS, AT_ONCE = 1_000_000, 20_000_000, 2_000_000


def matched_spans(index: FMIndex, items: list[list[str]], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, first word, word after the last) of the merged spans of each indexed text that match an item for at least least words."""
    known = [index.numbers(words) for words in items]
    phrases = [np.lib.stride_tricks.sliding_window_view(k, least) if len(k) >= least else np.zeros((0, least), np.int64) for k in known]
    owner = np.repeat(np.arange(len(items)), [len(p) for p in phrases])
    low, high = index.search(np.concatenate(phrases) if phrases else np.zeros((0, least), np.int64))
    hit = high > low
    owner, low, high = owner[hit], low[hit], high[hit]
    found: list[tuple[np.ndarray, ...]] = []
    while len(owner):
        upto = max(1, int(np.searchsorted(np.cumsum(high - low), AT_ONCE, side="right")))
        upto = int(np.searchsorted(owner, owner[upto - 1], side="right"))  # whole items, so that their spans merge
        rows, which = spread(low[:upto], high[:upto])
        at = index.locate(rows)
        text = index.texts_of(at)
        item, begin = owner[which], at - index.text_starts[text]
        order = np.lexsort((begin, item, text))
        text, item, begin = text[order], item[order], begin[order]
        fresh = np.ones(len(text), bool)
        fresh[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (begin[1:] > begin[:-1] + least)
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(text)) - 1
        found.append((text[first], item[first], begin[first], begin[last] + least))
        owner, low, high = owner[upto:], low[upto:], high[upto:]
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def leaked_spans(documents: DataFrame, items: DataFrame, least: int = 13, item_chars: int = ITEM_CHARS, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_key, first_word, end_word): the spans of documents that match at least least consecutive words of an item.

    Words are in canonical form, numbered from 0 in the document; overlapping and touching matches of an item are one
    span. Null and empty texts, and items of fewer words, match nothing. Every copy of a document and of an item counts;
    repeated rows of an item count once. Empty tables give an empty one; other columns aren't read.

    The corpus is scanned once, without a shuffle (a scan with fewer partitions than cores is dealt out first). A worker
    indexes its documents in shards of SHARD_WORDS words and searches all phrases of the items in each, so work grows
    with the corpus, and a hot item costs its occurrences. The words of the items are written to the shared folder in
    blocks of about item_chars characters, which the workers read one after another for each shard: none go
    through the driver, and however many blocks there are, a shard is indexed once.
    """
    spark = documents.sparkSession
    wanted = items.select(F.col(f"`{item_key}`").alias("i"), joined_words(f"`{item_text}`").alias("words")).where(F.size(F.split("words", " ")) >= least)
    wanted = staged(wanted.distinct(), "items")
    texts = staged(wanted.select("words").distinct().withColumn("n", F.monotonically_increasing_id()), "phrases")
    blocks = int((texts.agg(F.sum(F.length("words"))).first()[0] or 0) // item_chars) + 1
    path = new_folder(spark, "blocks")
    texts.withColumn("part", F.pmod(F.xxhash64("n"), F.lit(blocks)).cast("int")).write.parquet(path)
    stored = StoredTable(path)
    corpus = spread_out(documents.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).where(F.col("t").isNotNull()))
    fields = [T.StructField("k", corpus.schema["k"].dataType), *[T.StructField(n, T.LongType()) for n in ("n", "first_word", "end_word")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush(keys: list, texts: list[list[str]]) -> Iterator[pd.DataFrame]:
            index = FMIndex(texts)
            for part in range(blocks):
                block = list(stored.part(part, "n", "words"))
                text, item, begin, end = matched_spans(index, [words.split(" ") for _, words in block], least)
                if len(text):
                    yield pd.DataFrame({"k": pd.Series([keys[t] for t in text], dtype=object), "n": [block[i][0] for i in item], "first_word": begin, "end_word": end})

        keys, texts, size = [], [], 0
        for batch in batches:
            for k, t in zip(batch["k"].tolist(), batch["t"], strict=True):
                words = canonical_words(t)
                if len(words) >= least:
                    keys.append(k)
                    texts.append(words)
                    size += len(words)
                    if size >= SHARD_WORDS:
                        yield from flush(keys, texts)
                        keys, texts, size = [], [], 0
        if texts:
            yield from flush(keys, texts)

    found = corpus.mapInPandas(run, T.StructType(fields))
    owners = wanted.join(texts, "words").select("n", "i")
    owners = F.broadcast(staged(owners, "owners")) if is_small(owners) else owners
    return found.join(owners, "n").select(F.col("k").alias(key), F.col("i").alias(item_key), "first_word", "end_word")
