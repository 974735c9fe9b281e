"""Dense retrieval: cosine similarity of stated queries with all items, pooled by group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lawloom.operators.ranking import best
from lawloom.plans.stage import join_unique, new_folder, spread_out, staged
from lawloom.plans.stored import StoredTable

#: Queries of a block, and similarities computed at once: bounds of memory that change no result.
BLOCK_QUERIES, CELLS = 20_000, 4_000_000


def _units(vectors: list) -> np.ndarray:
    v = np.array([np.asarray(x, np.float64) for x in vectors])
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def cosine_best(items: DataFrame, queries: DataFrame, key: str, k: int, digits: int = 9, apart: str | None = None, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, key, similarity, rank): the k best keys of the items for each query, a key by the best of its items.

    items (key, v, and apart if given), queries (query_id, v); vectors have one length and aren't all zero. Null keys
    don't take part; equal similarities, to `digits` decimals, rank by key. apart: a column of the items that, where
    it equals the query's id, leaves the pair out.

    Queries are written to the shared folder in blocks of about block_queries. One scan of the items, without a shuffle,
    multiplies each batch with the blocks one after another; a task gives on k keys for each query.
    """
    spark = items.sparkSession
    asked = staged(queries.select("query_id", F.col("v").alias("v")), "queries")
    blocks = asked.count() // block_queries + 1
    path = new_folder(spark, "query-vectors")
    asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).write.parquet(path)
    stored = StoredTable(path)
    narrow = items.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), "v", *([F.col(apart).alias("apart")] if apart else []))
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField(key, items.schema[key].dataType), T.StructField("similarity", T.DoubleType())])

    def load(part: int) -> tuple[np.ndarray, np.ndarray]:
        rows = list(stored.part(part, "query_id", "v"))
        return np.array([q for q, _ in rows], dtype=object), _units([v for _, v in rows]) if rows else np.zeros((0, 0))

    def keep(kept: list[pd.DataFrame]) -> pd.DataFrame:
        every = pd.concat(kept).sort_values(["q", "r", "key"], ascending=[True, False, True])
        return every.drop_duplicates(["q", "key"]).groupby("q").head(k)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        found: dict[int, list[pd.DataFrame]] = {}
        for batch in batches:
            if not len(batch):
                continue
            codes, names = pd.factorize(batch["key"], sort=True)
            order = np.argsort(codes, kind="stable")
            starts = np.searchsorted(codes[order], np.arange(len(names)))
            units = _units(batch["v"].tolist())[order]
            others = batch["apart"].to_numpy(dtype=object)[order] if apart else None
            for part in range(blocks):
                ids, wanted = known.get(part) or load(part)
                if blocks == 1:
                    known[part] = ids, wanted
                kept = found.setdefault(part, [])
                step = max(1, CELLS // len(batch))
                for begin in range(0, len(ids), step):
                    similarity = wanted[begin : begin + step] @ units.T
                    if apart:
                        similarity[ids[begin : begin + step][:, None] == others[None, :]] = -np.inf
                    pooled = np.maximum.reduceat(similarity, starts, axis=1)
                    rounded = np.round(pooled, digits)
                    floor = np.partition(rounded, len(names) - k, axis=1)[:, len(names) - k][:, None] if len(names) > k else -np.inf
                    q, g = np.nonzero((rounded >= floor) & (pooled > -np.inf))
                    kept.append(pd.DataFrame({"q": q + begin, "key": np.asarray(names)[g], "r": rounded[q, g], "s": pooled[q, g]}))
                if sum(map(len, kept)) > 4 * k * len(ids) + 100_000:
                    found[part] = [keep(kept)]
        for part, kept in found.items():
            if kept:
                every, (ids, _) = keep(kept), known.get(part) or load(part)
                yield pd.DataFrame({"query_id": ids[every["q"].to_numpy(np.int64)], key: every["key"].to_numpy(), "similarity": every["s"].to_numpy()})

    pooled = spread_out(narrow).mapInPandas(run, schema).groupBy("query_id", key).agg(F.max("similarity").alias("similarity"))
    return best(pooled, ["query_id"], [F.round("similarity", digits).desc(), F.col(key).asc()], k)


def with_runs(items: DataFrame, group: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(items with their run, (run, group)): items in order make runs of one group, numbered from 1; the last item takes part in none.

    Items are sorted into ranges; the runs of a range are numbered in its task, and the ends of the ranges, a row each,
    tell which runs go on in the next.
    """
    placed = staged(items.repartitionByRange(F.col(order)).withColumn("__range", F.spark_partition_id()), "ordered")
    w = Window.partitionBy("__range").orderBy(order)
    fresh = F.when(F.lag(F.lit(1)).over(w).isNull() | ~F.lag(group).over(w).eqNullSafe(F.col(group)), 1).otherwise(0)
    local = staged(placed.withColumn("__new", fresh).withColumn("__run", F.sum("__new").over(w)), "runs")
    ends = local.groupBy("__range").agg(F.min_by(group, order).alias("first"), F.max_by(group, order).alias("last"), F.max("__run").alias("runs"), F.max(order).alias("top")).orderBy("__range").collect()
    offsets, used, before = [], 0, None
    for k, r in enumerate(ends):
        joined = k > 0 and r["first"] == before
        offsets.append((r["__range"], used - int(joined)))
        used += r["runs"] - int(joined)
        before = r["last"]
    table = F.broadcast(items.sparkSession.createDataFrame(offsets, "__range int, __offset long"))
    numbered = local.join(table, "__range").withColumn("run", F.col("__run") + F.col("__offset")).drop("__range", "__new", "__run", "__offset")
    if ends:
        numbered = numbered.where(F.col(order) != ends[-1]["top"])
    return numbered, numbered.select("run", group).distinct()


def pooled_runs(items: DataFrame, queries: DataFrame, group: str, order: str, k: int, sentinel: str = "-1") -> DataFrame:
    """The compatible form of pooling: the best of each run of one group in the order, without the last item, and a sentinel of 0; the k best, equal ones in order."""
    numbered, runs = with_runs(items, group, order)
    pooled = join_unique(cosine_best(numbered.select("run", "v"), queries, "run", k).drop("rank"), runs, ["run"])
    zero = queries.select("query_id").distinct().select("query_id", F.lit(1 << 40).alias("run"), F.lit(sentinel).alias(group), F.lit(0.0).alias("similarity"))
    return best(pooled.select("query_id", "run", group, "similarity").unionByName(zero), ["query_id"], [F.round("similarity", 9).desc(), F.col("run")], k).drop("run")
