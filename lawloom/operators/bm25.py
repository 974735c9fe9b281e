"""BM25 retrieval: documents are scored where they are, and only the best of each task travel."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lawloom.config import EngineConfig
from lawloom.functions.text import collapse, tokens
from lawloom.plans.stage import new_folder, spread_out, staged
from lawloom.plans.stored import StoredTable

#: Query terms of a block, scores computed at once, single sums and rows given on at once: bounds of memory that change no result.
BLOCK_TERMS, CELLS, SUMS, ROWS = 100_000, 4_000_000, 2_000_000, 50_000
#: Terms whose numbers a worker holds; documents of more are stored as texts, not as numbers of terms.
VOCABULARY = 500_000
#: The share of scores that a term takes part in, above which a matrix product is cheaper than single sums.
DENSE = 0.001


def _text(normalise: bool):
    return collapse(F.col("text")) if normalise else F.col("text")


def document_frequencies(docs: DataFrame, normalise: bool = True) -> DataFrame:
    """(term, df): the documents that have a term; an empty text has one empty term. Terms are counted in the row and combined before the shuffle."""
    words = docs.where(F.col("text").isNotNull()).select(F.explode(F.array_distinct(tokens(_text(normalise)))).alias("term"))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def term_statistics(frequencies: DataFrame, total: int, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(term, df, idf): negative idfs are replaced by epsilon times the mean idf of all terms before replacement."""
    raw = frequencies.withColumn("raw", F.log(F.lit(total) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw")).first()[0]
    floor = F.lit(float(mean or 0.0) * config.bm25_epsilon)
    return raw.select("term", "df", F.when(F.col("raw") < 0, floor).otherwise(F.col("raw")).alias("idf"))


def corpus_size(docs: DataFrame, normalise: bool = True) -> tuple[int, float]:
    """Number of documents with a text and their mean number of terms."""
    row = docs.where(F.col("text").isNotNull()).agg(F.count(F.lit(1)), F.avg(F.size(tokens(_text(normalise))))).first()
    return int(row[0]), float(row[1] or 0.0)


class _Block:
    """The terms of some queries, and for each the queries that have it with their weights."""

    def __init__(self, rows: list[tuple]) -> None:
        self.queries = sorted({q for q, _, _ in rows})
        number = {q: i for i, q in enumerate(self.queries)}
        self.terms = {t: i for i, t in enumerate(sorted({t for _, t, _ in rows}))}
        term = np.fromiter((self.terms[t] for _, t, _ in rows), np.int64, len(rows))
        order = np.argsort(term, kind="stable")
        self.term = term[order]
        self.query = np.fromiter((number[q] for q, _, _ in rows), np.int64, len(rows))[order]
        self.weight = np.fromiter((w for _, _, w in rows), np.float64, len(rows))[order]
        self.starts = np.searchsorted(self.term, np.arange(len(self.terms) + 1))
        self.positive = bool((self.weight > 0).all())

    def scores(self, texts: list[list[str]], mean: float, k1: float, b: float) -> tuple[np.ndarray, np.ndarray]:
        """documents x queries: the scores, and whether they share a term."""
        find, size = self.terms.get, np.fromiter(map(len, texts), np.int64, len(texts))
        code = np.fromiter((find(w, -1) for words in texts for w in words), np.int64, int(size.sum()))
        doc = np.repeat(np.arange(len(texts)), size)[code >= 0]
        both, tf = np.unique(doc * len(self.terms) + code[code >= 0], return_counts=True)
        doc, code = both // max(1, len(self.terms)), both % max(1, len(self.terms))
        return self.sums(len(texts), doc, code, _part(tf, size[doc], mean, k1, b))

    def sums(self, documents: int, doc: np.ndarray, code: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As scores(), of the documents' distinct terms of this block.

        Terms that many documents and queries have are multiplied as matrices, the others summed one by one. Where a
        weight isn't positive, a score doesn't tell whether a term is shared, so all are summed and noted.
        """
        common = (np.bincount(code, minlength=len(self.terms)) * np.diff(self.starts) > DENSE * documents * len(self.queries)) & self.positive
        dense = common[code]
        column, own = np.cumsum(common) - 1, common[self.term]
        left, right = np.zeros((documents, int(common.sum()))), np.zeros((int(common.sum()), len(self.queries)))
        left[doc[dense], column[code[dense]]] = part[dense]
        right[column[self.term[own]], self.query[own]] = self.weight[own]
        total = left @ right
        flat, shared = total.reshape(-1), None if self.positive else np.zeros(total.size, bool)
        doc, code, part = doc[~dense], code[~dense], part[~dense]
        first, many = self.starts[code], self.starts[code + 1] - self.starts[code]
        group = np.cumsum(many) // SUMS
        for begin, end in zip(cuts := [0, *(np.flatnonzero(np.diff(group)) + 1), len(many)], cuts[1:]):
            m = many[begin:end]
            at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[begin:end], m)
            cell = np.repeat(doc[begin:end], m) * len(self.queries) + self.query[at]
            np.add.at(flat, cell, np.repeat(part[begin:end], m) * self.weight[at])
            if shared is not None:
                shared[cell] = True
        return total, total > 0 if shared is None else shared.reshape(total.shape)


def _part(tf: np.ndarray, size: np.ndarray, mean: float, k1: float, b: float) -> np.ndarray:
    """What a term of a document adds to a score for each unit of its weight."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean))


class _Best:
    """The k best of each query so far; equal scores, to nine decimals, by the larger document. With ranges, also how many match and between which scores."""

    def __init__(self, queries: int, k: int, ranges: bool = True) -> None:
        self.k, self.floor, self.held, self.limit, self.ranges = k, np.full(queries, -np.inf), 0, 2 * k * queries + 100_000, ranges
        self.kept: list[pd.DataFrame] = []
        self.n, self.low, self.high = np.zeros(queries, np.int64), np.full(queries, np.inf), np.full(queries, -np.inf)

    def add(self, documents: pd.Series, scores: np.ndarray, matched: np.ndarray) -> None:
        if self.ranges:
            self.n += np.count_nonzero(matched, axis=0)
            self.low = np.minimum(self.low, np.min(scores, axis=0, initial=np.inf, where=matched))
            self.high = np.maximum(self.high, np.max(scores, axis=0, initial=-np.inf, where=matched))
        if len(scores) > self.k and len(free := np.flatnonzero(np.isneginf(self.floor))):
            held = np.where(matched[:, free], scores[:, free], -np.inf)
            self.floor[free] = np.partition(held, len(scores) - self.k, axis=0)[len(scores) - self.k]
        d, q = np.divmod(np.flatnonzero((scores >= self.floor - 2e-9) & matched), len(self.floor))  # floors are rounded, and so are scores when they are compared
        score = scores[d, q]
        self.kept.append(pd.DataFrame({"q": q.astype(np.int32), "r": np.round(score, 9), "doc": documents.to_numpy()[d], "score": score}))
        self.held += len(d)
        if self.held > self.limit:
            self.prune()

    def prune(self) -> pd.DataFrame:
        every = pd.concat(self.kept, ignore_index=True)
        doc = every["doc"].to_numpy() if every["doc"].dtype.kind in "iu" else pd.factorize(every["doc"], sort=True)[0]
        order = np.lexsort((-doc.astype(np.int64), -every["r"].to_numpy(), every["q"].to_numpy()))
        q = every["q"].to_numpy()[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        every = every.iloc[order[place < self.k]].reset_index(drop=True)
        last, r = place[place < self.k] == self.k - 1, every["r"].to_numpy()
        held = every["q"].to_numpy()[last]
        self.floor[held] = np.maximum(self.floor[held], r[last])
        self.kept, self.held = [every], len(every)
        return every


def bm25_search(docs: DataFrame, queries: DataFrame, k: int, config: EngineConfig = EngineConfig(), normalise: bool = True, block_terms: int = BLOCK_TERMS) -> tuple[DataFrame, DataFrame]:
    """(query_id, doc_id, score) of the k best documents of each query, and (query_id, n, low, high): how many share a term with it, and the range of their scores.

    docs (doc_id, text), queries (query_id, text). A repeated query term counts as often as it occurs; queries that are
    blank have no result, nor have documents without a text. Equal scores: the larger doc_id. Statistics cover the whole corpus.

    Query terms are written to the shared folder in blocks of about block_terms. One scan of the documents, without a
    shuffle, scores each batch against the blocks one after another; a task gives on k rows for each query, so neither a
    stop word nor the number of documents makes pairs that travel. Where there are more blocks than cores, the documents are
    stored too, with their terms as numbers, and a task takes one block through all of them, so that it holds the best of
    that block only, and its ranks are final.
    """
    found, _ = _search(docs, queries, k, config, normalise, block_terms, True)
    best = top_k(found.where("n is null").select("query_id", "doc_id", "score"), k).drop("rank")
    return best, found.where("n is not null").groupBy("query_id").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def bm25_ranked(docs: DataFrame, queries: DataFrame, k: int, config: EngineConfig = EngineConfig(), normalise: bool = True, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(query_id, doc_id, score, rank) of the k best documents of each query, stored; see bm25_search. Blocks whose ranks are final aren't shuffled."""
    found, final = _search(docs, queries, k, config, normalise, block_terms, False)
    found = found.select("query_id", "doc_id", "score", "rank")
    return found if final else staged(top_k(found.drop("rank"), k), "ranks")


def _search(docs: DataFrame, queries: DataFrame, k: int, config: EngineConfig, normalise: bool, block_terms: int, ranges: bool) -> tuple[DataFrame, bool]:
    """(query_id, doc_id, score, rank, n, low, high): the k best documents of each query in each task, stored, with ranges in rows of their own; whether a task holds whole queries."""
    spark = docs.sparkSession
    total, mean = corpus_size(docs, normalise)
    asked = staged(queries.select("query_id", collapse(F.col("text")).alias("text")).where("text != ''"), "queries")
    vocabulary = StoredTable(new_folder(spark, "statistics"))
    term_statistics(staged(document_frequencies(docs, normalise), "frequencies"), total, config).select("term", "idf").write.parquet(vocabulary.path)
    statistics = spark.read.schema("term string, idf double").parquet(vocabulary.path)
    blocks, cores = (asked.agg(F.sum(F.size(tokens(F.col("text"))))).first()[0] or 0) // block_terms + 1, spark.sparkContext.defaultParallelism
    by_block = blocks > cores
    blocks = max(blocks, 4 * cores) if by_block else blocks
    stored, k1, b = StoredTable(new_folder(spark, "query-terms"), by_folder=by_block), config.bm25_k1, config.bm25_b
    part = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    if by_block:
        asked.withColumn("part", part).repartition("part").write.partitionBy("part").parquet(stored.path)
    else:
        counted = asked.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf"))
        counted.join(statistics, "term").select("query_id", "term", (F.col("qf") * F.col("idf")).alias("weight"), part.alias("part")).write.parquet(stored.path)
    narrow = docs.where(F.col("text").isNotNull()).select("doc_id", _text(normalise).alias("text"))
    kinds = [queries.schema["query_id"].dataType, docs.schema["doc_id"].dataType, T.DoubleType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(("query_id", "doc_id", "score", "rank", "n", "low", "high"), kinds, strict=True)])

    def load(part: int) -> _Block:
        return _Block(list(stored.part(part, "query_id", "term", "weight")))

    def load_texts(part: int) -> tuple[_Block, np.ndarray]:
        """The block of a part, and the numbers of its terms in the order of the vocabulary."""
        counts: dict = {}
        for q, t in stored.part(part, "query_id", "text"):
            counts.setdefault(q, Counter()).update(t.split(" "))
        wanted = {t for c in counts.values() for t in c}
        known = {t: (n, idf) for n, (t, idf) in enumerate(vocabulary.rows("term", "idf")) if t in wanted}
        block = _Block([(q, t, n * known[t][1]) for q, c in counts.items() for t, n in c.items() if t in known])
        return block, np.fromiter((known[t][0] for t in block.terms), np.int64, len(block.terms))

    def score(block: _Block, top: _Best, batch: pd.DataFrame, texts: list[list[str]]) -> None:
        step = max(1, CELLS // len(block.queries))
        for begin in range(0, len(texts), step):
            top.add(batch["doc_id"].iloc[begin : begin + step], *block.scores(texts[begin : begin + step], mean or 1.0, k1, b))

    def score_numbers(block: _Block, top: _Best, batch: pyarrow.RecordBatch, place: np.ndarray) -> None:
        """As score(), of numbered terms; place: a number's term in the block, or -1."""
        ids, size = batch.column("doc_id").to_pandas(), batch.column("size").to_numpy()
        code = place[batch.column("terms").flatten().to_numpy()]
        doc = np.repeat(np.arange(len(ids)), np.diff(batch.column("terms").offsets.to_numpy()))[code >= 0]
        tf = batch.column("counts").flatten().to_numpy()[code >= 0]
        code, weighed = code[code >= 0], _part(tf, size[doc], mean or 1.0, k1, b)
        step = max(1, CELLS // len(block.queries))
        for begin in range(0, len(ids), step):
            end = min(len(ids), begin + step)
            own = slice(*np.searchsorted(doc, [begin, end]))
            top.add(ids.iloc[begin:end], *block.sums(end - begin, doc[own] - begin, code[own], weighed[own]))

    def given(block: _Block, top: _Best) -> Iterator[pd.DataFrame]:
        ids = np.array(block.queries, dtype=object)
        every = top.prune()
        q = every["q"].to_numpy(np.int64)
        rank = np.arange(len(q)) - np.searchsorted(q, q, side="left") + 1
        for begin in range(0, len(every), ROWS):
            part = every.iloc[begin : begin + ROWS]
            none = pd.Series([None] * len(part), dtype=object)
            yield pd.DataFrame({"query_id": ids[q[begin : begin + ROWS]], "doc_id": part["doc"].to_numpy(), "score": part["score"].to_numpy(), "rank": rank[begin : begin + ROWS], "n": none, "low": none, "high": none})
        some = np.flatnonzero(top.n)
        none = pd.Series([None] * len(some), dtype=object)
        if ranges:
            yield pd.DataFrame({"query_id": ids[some], "doc_id": none, "score": none, "rank": none, "n": top.n[some], "low": top.low[some], "high": top.high[some]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, _Block] = {}
        found: dict[int, _Best] = {}
        for batch in batches:
            texts = [t.split(" ") for t in batch["text"]]
            for part in range(blocks):
                block = known.get(part) or load(part)
                if blocks == 1:
                    known[part] = block
                if block.queries:
                    score(block, found.setdefault(part, _Best(len(block.queries), k, ranges)), batch, texts)
        for part, top in found.items():
            yield from given(known.get(part) or load(part), top)

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = {t: n for n, (t,) in enumerate(vocabulary.rows("term"))}
        for batch in batches:
            counts = [Counter(t.split(" ")) for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "size": [c.total() for c in counts],
                "terms": [np.fromiter((numbers[t] for t in c), np.int32, len(c)) for c in counts], "counts": [np.fromiter(c.values(), np.int32, len(c)) for c in counts],
            })

    def run_block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in [int(p) for batch in batches for p in batch["id"]]:
            block, own = load_texts(part)
            if not block.queries or not total:
                continue
            top = _Best(len(block.queries), k, ranges)
            if numbered:
                place = np.full(terms, -1, np.int64)
                place[own] = np.arange(len(own))
                for batch in documents.record_batches("doc_id", "size", "terms", "counts"):
                    score_numbers(block, top, batch, place)
            else:
                for batch in documents.batches("doc_id", "text"):
                    score(block, top, batch, [t.split(" ") for t in batch["text"]])
            yield from given(block, top)

    if not by_block:
        return staged(spread_out(narrow).mapInPandas(run, schema), "scores"), False
    terms, documents = statistics.count(), StoredTable(new_folder(spark, "documents"))
    numbered = terms <= VOCABULARY
    kind = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("size", T.IntegerType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])
    (spread_out(narrow).mapInPandas(number, kind) if numbered else narrow).write.parquet(documents.path)
    return staged(spark.range(0, blocks, 1, blocks).mapInPandas(run_block, schema), "scores"), True


def padded(best: DataFrame, ranges: DataFrame, docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """best, with zero-score documents added where a query matches fewer than k: the last ones by id, as ties rank."""
    matched = queries.where(collapse(F.col("text")) != "").select("query_id").distinct().join(ranges, "query_id", "left")
    short = matched.where(F.coalesce("n", F.lit(0)) < k).select("query_id")
    last = [r[0] for r in docs.where(F.col("text").isNotNull()).select("doc_id").orderBy(F.col("doc_id").desc()).limit(2 * k).collect()]
    if not last:
        return best
    fill = short.select("query_id", F.explode(F.array(*map(F.lit, last)).cast(T.ArrayType(docs.schema["doc_id"].dataType))).alias("doc_id"))
    return best.unionByName(fill.join(best, ["query_id", "doc_id"], "left_anti").withColumn("score", F.lit(0.0)))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The k best documents of each query with their ranks; equal scores by the larger id."""
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.col("doc_id").desc())
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
