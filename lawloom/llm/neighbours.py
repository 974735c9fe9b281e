"""The most similar vectors of every vector, by randomly rotated one-bit codes with error bounds, and exact reranking."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lawloom.plans import is_small, join_unique, staged


@dataclass(frozen=True)
class IndexOptions:
    """Parameters of the index; those of the first group change only speed and recall.

    lists: vectors are filed under this many lists times the square root of their number, so both the number and the
    size of the lists grow as the square root.
    probes: lists that a query looks into, apart from those that can't hold anything of the least similarity.
    probe_share: at least this share of the lists. The ten most similar of any similarity need it (0.4 finds 98 % and
    more of them); pairs of 0.8 or more don't.
    sample_per_list: the centroids are fitted on about this many vectors each; all vectors are indexed.
    epsilon: width of the error bound of an estimate, in its standard deviations.
    block_rows, queries_per_block: most items of a task, and most queries of a task for each of them.
    """

    lists: float = 4.0
    probes: int = 64
    probe_share: float = 0.4
    sample_per_list: int = 24
    epsilon: float = 2.5
    block_rows: int = 50_000
    queries_per_block: int = 8
    seed: int = 7
    dimensions: int = 64
    k: int = 10


def usable(vector: Column, dimensions: int) -> Column:
    """Whether a vector has this many finite numbers, not all of them 0."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


#: Items estimated and pairs compared at once: bounds of memory that change no result.
_SLICE, _COMPARED = 1024, 32_768


def _units(packed: pd.Series, dimensions: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(packed), np.float32).reshape(-1, dimensions).astype(np.float64)
    raw /= np.abs(raw).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def fit_centroids(sample: np.ndarray, lists: int, seed: int, rounds: int = 4) -> np.ndarray:
    """Unit centroids of unit vectors by a few rounds of k-means; a list that loses all its vectors keeps its centroid.

    Many lists are fitted in two levels, so that time grows as their number to the power 1.5.
    """
    rng = np.random.default_rng(seed)
    points = sample.astype(np.float32)
    if lists > 1024 and len(points) > 2 * lists:
        coarse = fit_centroids(points[rng.choice(len(points), min(len(points), 64 * math.isqrt(lists)), replace=False)], math.isqrt(lists), seed, rounds)
        cell = _nearest(points, coarse)
        parts = [points[cell == c] for c in range(len(coarse))]
        return np.concatenate([fit_centroids(p, max(1, round(lists * len(p) / len(points))), seed, rounds) for p in parts if len(p)])
    centroids = points[rng.choice(len(points), min(lists, len(points)), replace=False)]
    for _ in range(rounds):
        nearest = _nearest(points, centroids)
        sums = np.zeros((len(centroids), points.shape[1]), np.float64)
        np.add.at(sums, nearest, points)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centroids).astype(np.float32)
    return centroids


def _nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmax(points[i : i + 4096] @ centroids.T, axis=1) for i in range(0, len(points), 4096)])


class Lists:
    """The centroids of all lists, in cells of near ones.

    A vector is compared with the cells and with the lists of its nearest cells only, so filing costs the fourth root of
    the number of vectors. Lists are numbered by cell, and cells along the first principal axis: near lists have near
    numbers.
    """

    def __init__(self, cells: np.ndarray, centroids: np.ndarray, cell: np.ndarray) -> None:
        axis = np.linalg.svd(cells - cells.mean(axis=0), full_matrices=False)[2][0] if len(cells) > 1 else np.ones(cells.shape[1])
        order = np.argsort(cells @ axis, kind="stable")
        place = np.empty(len(cells), np.int64)
        place[order] = np.arange(len(cells))
        by_cell = np.argsort(place[cell], kind="stable")
        self.cells, self.centroids = cells[order].astype(np.float32), centroids[by_cell].astype(np.float32)
        self.starts = np.searchsorted(place[cell][by_cell], np.arange(len(cells) + 1))

    def near(self, units: np.ndarray, cells: int, floor: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """(rows, first list, similarities) of the vectors and the lists of each of their nearest cells."""
        units = units.astype(np.float32)
        close = units @ self.cells.T
        chosen = close >= np.partition(close, len(self.cells) - cells, axis=1)[:, len(self.cells) - cells][:, None]
        for c in range(len(self.cells)):
            rows = np.flatnonzero(chosen[:, c])
            if len(rows) and self.starts[c] < self.starts[c + 1]:
                yield rows, int(self.starts[c]), units[rows] @ self.centroids[self.starts[c] : self.starts[c + 1]].T

    def file(self, units: np.ndarray, cells: int = 3) -> np.ndarray:
        """The list of each vector."""
        best, where = np.full(len(units), -np.inf, np.float32), np.zeros(len(units), np.int32)
        for rows, first, near in self.near(units, min(cells, len(self.cells))):
            top = near.argmax(axis=1)
            score = near[np.arange(len(rows)), top]
            better = score > best[rows]
            best[rows[better]], where[rows[better]] = score[better], first + top[better]
        return where

    def probed(self, units: np.ndarray, probes: int, least: float, widest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list, similarity to its centroid) for the lists that each vector looks into: its `probes` nearest, in the
        cells that hold three times as many, without those whose widest angle says that nothing in them reaches least."""
        size = max(1, len(self.centroids) // len(self.cells))
        cells = min(len(self.cells), -(-3 * probes // size) + 1)
        rows, lists, scores = [], [], []
        for r, first, near in self.near(units, cells):
            # <q, x> is at most cos(angle(q, c) - angle(c, x))
            at = widest[first : first + near.shape[1]]
            possible = np.cos(np.maximum(np.arccos(np.clip(near, -1, 1)) - at, 0)) >= least - 1e-5
            q, x = np.nonzero(possible & (at >= 0))
            rows.append(r[q])
            lists.append(first + x)
            scores.append(near[q, x])
        row, place, score = np.concatenate(rows), np.concatenate(lists), np.concatenate(scores)
        order = np.lexsort((place, -score, row))
        row, place, score = row[order], place[order], score[order]
        begin = np.searchsorted(row, np.arange(len(units)))
        kept = np.arange(len(row)) - begin[row] < probes
        return row[kept], place[kept], score[kept]


class Codes:
    """One-bit codes of unit vectors, relative to their centroids, under one random rotation."""

    def __init__(self, units: np.ndarray, centroids: np.ndarray, rotation: np.ndarray, epsilon: float) -> None:
        d = units.shape[1]
        residual = (units - centroids).astype(np.float32) @ rotation
        length = np.linalg.norm(residual, axis=1)
        sign = residual > 0
        padded = np.zeros((len(units), -(-d // 64) * 64), np.uint8)
        padded[:, :d] = sign
        self.bits = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)
        self.ones = np.bitwise_count(self.bits).sum(axis=1).astype(np.float32)
        # <code, residual>, as the code is the sign vector of length 1: how well the code points along the residual
        along = np.abs(residual).sum(axis=1) / (math.sqrt(d) * np.maximum(length, 1e-12))
        along = np.where(length > 1e-12, along, 1.0)
        self.scale = (length / (along * math.sqrt(d))).astype(np.float32)  # from <signs, query> to <residual, query>
        self.width = (length * np.sqrt(np.maximum(1 - along**2, 0)) / along * epsilon / math.sqrt(max(1, d - 1))).astype(np.float32)


class Queries:
    """Rotated queries, each quantised to four bit planes."""

    def __init__(self, units: np.ndarray, rotation: np.ndarray) -> None:
        d = units.shape[1]
        rotated = units.astype(np.float32) @ rotation
        low, high = rotated.min(axis=1), rotated.max(axis=1)
        self.low, self.step = low, np.maximum(high - low, 1e-12) / 15
        level = np.clip(np.rint((rotated - low[:, None]) / self.step[:, None]), 0, 15).astype(np.uint8)
        padded = np.zeros((len(units), -(-d // 64) * 64), np.uint8)
        self.planes = []
        for plane in range(4):
            padded[:, :d] = (level >> plane) & 1
            self.planes.append(np.packbits(padded, axis=1, bitorder="little").view(np.uint64))
        self.total = rotated.sum(axis=1)
        self.width = (3 * 2 * self.step / math.sqrt(12)).astype(np.float32)  # of <signs, query> for each root of a one-bit

    def signed(self, rows: np.ndarray, codes: Codes, at: slice) -> np.ndarray:
        """<signs, query> for queries (rows) and codes (columns), from packed bits."""
        counts = np.zeros((len(rows), at.stop - at.start), np.float32)
        for plane, bits in enumerate(self.planes):
            for word in range(bits.shape[1]):
                counts += np.bitwise_count(bits[rows, word][:, None] & codes.bits[at, word][None, :]).astype(np.float32) * np.float32(1 << plane)
        counts *= (2 * self.step[rows])[:, None]
        counts += (2 * self.low[rows])[:, None] * codes.ones[at][None, :]
        counts -= self.total[rows][:, None]
        return counts


def _best(query: np.ndarray, item: np.ndarray, key: np.ndarray, similarity: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best of each query, by similarity, then key."""
    order = np.lexsort((key[item], -similarity, query))
    q = query[order]
    fresh = np.ones(len(q), bool)
    fresh[1:] = q[1:] != q[:-1]
    first = np.flatnonzero(fresh)
    rank = np.arange(len(q)) - first[np.cumsum(fresh) - 1]
    return order[rank < k]


def search_block(queries: pd.DataFrame, items: pd.DataFrame, centroids: np.ndarray, rotation: np.ndarray, options: IndexOptions, least: float, chunk: int = 1024, most: int = 1_000_000) -> pd.DataFrame:
    """(a, b, similarity) for the options.k + 1 best items of each query, itself among them, by exact cosine rounded to 6 decimals.

    queries (id, vec, reach): a query looks into the lists whose centroids are at least reach near it. An item is compared exactly if its estimate plus the error bound reaches both least and the last of the best that its query
    has so far. At most about `most` compared pairs are kept at once.
    """
    items = items.sort_values("list", kind="stable")
    item_units, query_units = _units(items["vec"], options.dimensions), _units(queries["vec"], options.dimensions)
    lists, item_key = items["list"].to_numpy(), items["id"].to_numpy()
    codes = Codes(item_units, centroids[lists], rotation, options.epsilon)
    axis = np.linalg.svd(item_units[:4096], full_matrices=False)[2][0]
    own = np.argsort(query_units @ axis, kind="stable")
    reach, query_key = queries["reach"].to_numpy(), queries["id"].to_numpy()
    present, starts = np.unique(lists, return_index=True)
    ends = np.append(starts[1:], len(lists))
    coded, keep = Queries(query_units, rotation), options.k + 1
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for begin in range(0, len(own), chunk):
        mine = own[begin : begin + chunk]
        near = query_units[mine].astype(np.float32) @ centroids[present].T
        floor = np.full(len(mine), least - 1e-6, np.float32)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def compact() -> None:
            nonlocal kept, held
            q, x, s = (np.concatenate(c) for c in zip(*kept, strict=True))
            best = _best(q, x, item_key, s, keep)
            q, x, s = q[best], x[best], s[best]
            kept, held = [(q, x, s)], len(q)
            full = np.flatnonzero(np.bincount(q, minlength=len(mine)) == keep)
            worst = np.full(len(mine), np.inf)
            np.minimum.at(worst, q, s)
            floor[full] = np.maximum(floor[full], worst[full] - 1e-6)

        for column in np.argsort(-near.max(axis=0), kind="stable"):
            rows = np.flatnonzero(near[:, column] >= reach[mine] - 1e-6)
            for first in range(starts[column], ends[column], _SLICE) if len(rows) else ():
                at = slice(first, min(first + _SLICE, ends[column]))
                bound = coded.signed(mine[rows], codes, at)
                bound += coded.width[mine[rows]][:, None] * np.sqrt(np.maximum(codes.ones[at], 1))[None, :]
                bound *= codes.scale[at][None, :]
                bound += near[rows, column][:, None] + codes.width[at][None, :]
                q, x = np.nonzero(bound >= floor[rows][:, None])
                if not len(q):
                    continue
                q, x = rows[q], x + at.start
                exact = np.empty(len(q))
                for part in range(0, len(q), _COMPARED):
                    those = slice(part, part + _COMPARED)
                    exact[those] = np.einsum("ij,ij->i", query_units[mine[q[those]]], item_units[x[those]])
                exact = np.round(exact, 6)
                good = exact >= np.maximum(least, floor[q])
                kept.append((q[good], x[good], exact[good]))
                held += int(good.sum())
                if held > most:
                    compact()
        if held:
            compact()
            q, x, s = kept[0]
            out.append((query_key[mine[q]], item_key[x], s))
    if not out:
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "similarity": np.zeros(0)})
    a, b, s = (np.concatenate(c) for c in zip(*out, strict=True))
    return pd.DataFrame({"a": a, "b": b, "similarity": s})


def _blocks(counts: np.ndarray, rows: int) -> list[tuple[int, int, int]]:
    """(list, parts of the list, first block) for every list that has items: lists of near numbers share a block, a long one is dealt over several."""
    out, block, filled = [], 0, 0
    for place, n in enumerate(counts.tolist()):
        if not n:
            continue
        if filled and filled + n > rows:
            block, filled = block + 1, 0
        parts = -(-n // rows)
        out.append((place, parts, block))
        block, filled = (block + parts, 0) if parts > 1 else (block, filled + n)
    return out


def _pack(vectors: pd.Series) -> pd.Series:
    return pd.Series([np.asarray(v, np.float32).tobytes() for v in vectors], dtype=object)


def _classes(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(id, vec) of one key for every different vector, and (same, id, n) of the keys that share one: the class's key, and the first k + 1 keys by n.

    Vectors are told apart by two hashes, and only the few that occur more than once are shuffled whole.
    """
    tally = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("same"))
    repeated = staged(tally.where(F.col("c") > 1).drop("c"), "repeated")
    several = staged(join_unique(rows, repeated, ["h1", "h2"]).select("h1", "h2", "same", "id", "vec"), "several")
    single = join_unique(rows, repeated.select("h1", "h2"), ["h1", "h2"], "left_anti").select("id", "vec")
    shared = several.groupBy("h1", "h2").agg(F.min("same").alias("id"), F.first("vec").alias("vec")).select("id", "vec")
    keys = several.select("same", "h1", "h2", "id").distinct().select("same", "id")
    return single.unionByName(shared), keys


def similar_vectors(vectors: DataFrame, key: str, vector: str, least: float = -1.0, options: IndexOptions = IndexOptions(), wanted: Callable[[Column], Column] | None = None) -> DataFrame:
    """(vec_a, vec_b, similarity, rank): for every usable vector a, its options.k most similar others of similarity least or more.

    Similarity is the cosine rounded to 6 decimals; equal ones rank by vec_b. wanted: a condition on a column of keys that
    limits the vectors a, not b. Rows with a null key, and vectors that are null, of another length, not finite or all
    zero are no vectors; repeats count once. An empty table gives an empty one; other columns aren't read.

    Equal vectors are one class, searched once: k + 1 of its smallest keys stand for it, which is all that ranks can show.
    Classes are filed under the nearest of the centroids; a query looks into the lists whose centroids are nearest to it.
    Near lists make up blocks of options.block_rows; each item goes to one block, and each query to the blocks that
    hold a list it looks into; of two near ones it's enough that one finds the other. A block that very many queries look into is copied for every queries_per_block *
    block_rows of them, by exact counts. So what's missed is only what lies in lists that a query doesn't look into or
    beyond the error bound. What is broadcast are the centroids: 4 * sqrt(N) vectors, 32 MB for 10^9 of them.
    """
    spark, k, d = vectors.sparkSession, options.k, options.dimensions
    rows = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").cast("array<float>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"), d))
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.select("id", F.xxhash64(F.lit(1), "v").alias("h1"), F.xxhash64(F.lit(2), "v").alias("h2"), "v")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["id", "h1", "h2"]].assign(vec=_pack(batch["v"]))

    rows = staged(rows.mapInPandas(pack, f"id {kind}, h1 long, h2 long, vec binary"), "vectors")
    classes, keys = _classes(rows, k)
    total = classes.count()
    if not total:
        return spark.createDataFrame([], f"vec_a {kind}, vec_b {kind}, similarity double, rank int")
    lists = _fit(classes, total, options)
    rotation = np.linalg.qr(np.random.default_rng(options.seed).standard_normal((d, d)))[0].astype(np.float32)
    shared = spark.sparkContext.broadcast((lists, rotation))

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                units = _units(batch["vec"], d)
                place = shared.value[0].file(units)
                angle = np.arccos(np.clip(np.einsum("ij,ij->i", units, shared.value[0].centroids[place]), -1, 1))
                yield pd.DataFrame({"id": batch["id"], "list": place, "angle": angle.astype(np.float32), "vec": batch["vec"]})

    filed = staged(classes.mapInPandas(file, f"id {kind}, list int, angle float, vec binary"), "filed")
    table = filed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("a")).toArrow()  # a row for each centroid
    count, widest = np.zeros(len(lists.centroids), np.int64), np.full(len(lists.centroids), -1.0, np.float32)
    at = table.column("list").to_numpy()
    count[at], widest[at] = table.column("n").to_numpy(), table.column("a").to_numpy() + 1e-4
    cores = spark.sparkContext.defaultParallelism
    layout = _blocks(count, max(256, min(options.block_rows, -(-total // cores))))
    where = np.zeros((len(count), 2), np.int32)
    for place, parts, first in layout:
        where[place] = first, parts
    spots = spark.sparkContext.broadcast((where, widest))
    probes = min(len(count), max(options.probes, math.ceil(options.probe_share * len(count))))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            first, parts = spots.value[0][batch["list"].to_numpy()].T
            deal = pd.util.hash_array(batch["id"].to_numpy()) % np.maximum(parts, 1).astype(np.uint64)
            yield batch[["id", "list", "vec"]].assign(block=(first + deal.astype(np.int64)).astype(np.int32))

    def aim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A query for each block that holds a list it looks into."""
        for batch in batches:
            for begin in range(0, len(batch), 2048):
                part = batch.iloc[begin : begin + 2048]
                q, x, score = shared.value[0].probed(_units(part["vec"], d), probes, least, spots.value[1])
                reach = np.full(len(part), np.inf, np.float32)
                np.minimum.at(reach, q, score)
                first, parts = spots.value[0][x].T
                q, first = np.repeat(q, parts), np.repeat(first, parts) + np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                pairs = np.unique(q.astype(np.int64) << 32 | first)
                q = pairs >> 32
                yield part.iloc[q][["id", "vec"]].assign(block=(pairs & 0xFFFFFFFF).astype(np.int32), reach=reach[q])

    items = filed.mapInPandas(place, f"id {kind}, list int, vec binary, block int")
    asking = filed.select("id", "vec")
    if wanted is not None:
        asked = keys.where(wanted(F.col("id"))).select(F.col("same").alias("id")).distinct()
        asking = join_unique(filed, asked.unionByName(filed.select("id").where(wanted(F.col("id")))).distinct(), ["id"], "left_semi").select("id", "vec")
    queries = asking.mapInPandas(aim, f"id {kind}, vec binary, block int, reach float")
    most = options.queries_per_block * options.block_rows
    crowded = queries.groupBy("block").count().where(F.col("count") > most).collect() if total > most else []  # fewer than blocks
    slices = {r["block"]: -(-r["count"] // most) for r in crowded}
    blocks = max(first + parts for _, parts, first in layout)
    tasks = blocks
    task, copies = F.col("block"), F.array("block")
    for block, many in slices.items():  # the first slice keeps the block's number, the others are numbered after all blocks
        slice_of = F.pmod(F.xxhash64("id"), F.lit(many)).cast("int")
        task = F.when(F.col("block") == block, F.when(slice_of == 0, F.lit(block)).otherwise(slice_of + (tasks - 1))).otherwise(task)
        copies = F.when(F.col("block") == block, F.array(F.lit(block), *[F.lit(tasks + s) for s in range(many - 1)])).otherwise(copies)
        tasks += many - 1
    queries = queries.select("id", "vec", "reach", task.alias("task"))
    items = items.select("id", "list", "vec", F.explode(copies).alias("task") if slices else F.col("block").alias("task"))
    if tasks <= 20_000:  # one task for each partition; more of them spread evenly by hash
        queries, items = (t.repartitionById(tasks, F.col("task")) for t in (queries, items))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "similarity": []})
        lists, rotation = shared.value
        return search_block(left, right, lists.centroids, rotation, options, least)

    near = queries.groupBy("task").cogroup(items.groupBy("task")).applyInPandas(search, f"a {kind}, b {kind}, similarity double")
    by_rank = Window.partitionBy("a").orderBy(F.col("similarity").desc(), "b")
    if wanted is None:  # what either of two finds, both have found
        near = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity")).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    near = staged(near.withColumn("r", F.row_number().over(by_rank)).where(F.col("r") <= k + 1).drop("r"), "near")  # the class itself is one
    return _unfolded(near, keys, k, wanted)


def _unfolded(near: DataFrame, keys: DataFrame, k: int, wanted: Callable[[Column], Column] | None) -> DataFrame:
    """From classes to keys: a class found stands for its first k + 1 keys, and every key of the class that asked has its own rows.

    Only classes of several keys are joined; a hot one is salted by its exact count.
    """
    if not keys.isEmpty():
        shown = keys.withColumn("n", F.row_number().over(Window.partitionBy("same").orderBy("id"))).where(F.col("n") <= k + 1)
        shown = staged(shown.groupBy("same").agg(F.collect_list("id").alias("ids")), "shown")  # k + 1 at most
        folded = join_unique(near, shown.select(F.col("same").alias("b"), F.col("ids").alias("b_ids")), ["b"], "left")
        folded = join_unique(folded, shown.select(F.col("same").alias("a"), F.lit(True).alias("many")), ["a"], "left")
        found = folded.select("a", "many", F.explode(F.coalesce("b_ids", F.array("b"))).alias("vec_b"), "similarity")
        best = F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("s"), F.col("vec_b").alias("b"))))  # (k + 1)^2 at most
        own = found.where("many").groupBy("a").agg(F.slice(best, 1, (k + 1) * 2).alias("best"))
        own = staged(own, "own")
        of_class = join_unique(keys.select(F.col("same").alias("a"), F.col("id").alias("vec_a")), own, ["a"])
        of_class = of_class.select("vec_a", F.inline("best")).select("vec_a", F.col("b").alias("vec_b"), (-F.col("s")).alias("similarity"))
        near = found.where("many is null").select(F.col("a").alias("vec_a"), "vec_b", "similarity").unionByName(of_class)
    else:
        near = near.select(F.col("a").alias("vec_a"), F.col("b").alias("vec_b"), "similarity")
    if wanted is not None:
        near = near.where(wanted(F.col("vec_a")))
    pairs = near.where(F.col("vec_a") != F.col("vec_b")).groupBy("vec_a", "vec_b").agg(F.max("similarity").alias("similarity"))
    final = Window.partitionBy("vec_a").orderBy(F.col("similarity").desc(), "vec_b")
    return pairs.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)


#: Vectors that the cells are fitted on at most, on the driver: 16 MB.
_CELL_SAMPLE = 65_536


def _fit(classes: DataFrame, total: int, options: IndexOptions) -> Lists:
    """Cells from at most _CELL_SAMPLE vectors on the driver, then the centroids of each cell from its sampled vectors where they are; both drawn by hash."""
    lists, d, seed = max(1, round(options.lists * math.sqrt(total))), options.dimensions, options.seed
    draw = lambda n: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, n / total) * (1 << 30)) + 1
    count = max(1, math.isqrt(lists))
    table = classes.where(draw(min(_CELL_SAMPLE, 256 * count + 1000))).select("vec").limit(2 * _CELL_SAMPLE).toPandas()
    if not len(table):
        table = classes.select("vec").limit(1).toPandas()
    cells = fit_centroids(_units(table["vec"], d), count, seed)
    size = options.sample_per_list * lists
    shared = classes.sparkSession.sparkContext.broadcast(cells)

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"cell": _nearest(_units(batch["vec"], d).astype(np.float32), shared.value).astype(np.int32), "vec": batch["vec"]})

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        ours = max(1, round(len(group) / max(1.0, min(size, total) / lists)))
        units = _units(group["vec"].sort_values(), d)  # in one order, so that the same data give the same centroids
        return pd.DataFrame({"cell": group["cell"].iloc[0], "vec": [c.tobytes() for c in fit_centroids(units, ours, seed)]})

    fitted = classes.where(draw(size)).select("vec").mapInPandas(sort, "cell int, vec binary").groupBy("cell").applyInPandas(fit, "cell int, vec binary").toArrow()
    if not fitted.num_rows:
        return Lists(cells, cells, np.arange(len(cells)))
    centroids = np.frombuffer(b"".join(fitted.column("vec").to_pylist()), np.float32).reshape(-1, d)
    return Lists(cells, centroids, fitted.column("cell").to_numpy())
