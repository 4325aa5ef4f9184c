"""Approximate nearest neighbours by an inverted multi-index.

Each half of a vector is quantised by a codebook of its own; a cell is a pair of centroids.
A query visits cells in the order of the summed distances of its halves to the centroids,
popped from a heap, until the visited cells hold a share of all entries; their vectors are
reranked by the exact distance. The share is fitted on pilot queries, whose true neighbours
are found by brute force, so that ``RECALL`` of those lie in the visited cells.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import written

K = 10
CENTROIDS = 64
#: Vectors that the codebooks are fitted on, and pilot queries, about, at most.
SAMPLE = 20_000
PILOTS = 100
RECALL = 0.97
BLOCK = 512
ASKED = 256
#: Queries whose nearest a task holds before it passes them on.
HELD = 50_000


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, v (array of double), dim: rows with an id whose vector is not null, empty or
    zero and has only finite components."""
    v = F.col("embedding").cast("array<double>")
    rows = rows.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def centroids(data: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm on a bounded sample; fewer centroids if there are fewer points."""
    data = np.unique(data, axis=0)
    if len(data) <= k:
        return data
    made = data[np.random.default_rng(seed).choice(len(data), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(data, made)
        sizes = np.bincount(own, minlength=k)
        sums = np.zeros_like(made)
        np.add.at(sums, own, data)
        made[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return made


def squared(data: np.ndarray, made: np.ndarray) -> np.ndarray:
    return np.maximum((data**2).sum(1)[:, None] - 2 * data @ made.T + (made**2).sum(1), 0)


def nearest(data: np.ndarray, made: np.ndarray) -> np.ndarray:
    return squared(data, made).argmin(axis=1)


@dataclass
class MultiIndex:
    """Codebooks of both halves and the number of entries in each cell."""

    one: np.ndarray
    two: np.ndarray
    sizes: np.ndarray

    @property
    def half(self) -> int:
        return self.one.shape[1]

    def cells(self, data: np.ndarray) -> np.ndarray:
        return nearest(data[:, : self.half], self.one) * len(self.two) + nearest(data[:, self.half :], self.two)

    def visit(self, query: np.ndarray) -> Iterator[int]:
        """Cells from the nearest on: pairs of centroids by summed distance, from a heap."""
        d1 = squared(query[None, : self.half], self.one)[0]
        d2 = squared(query[None, self.half :], self.two)[0]
        o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
        heap, seen = [(d1[o1[0]] + d2[o2[0]], 0, 0)], {(0, 0)}
        while heap:
            _, i, j = heapq.heappop(heap)
            yield int(o1[i]) * len(self.two) + int(o2[j])
            for a, b in ((i + 1, j), (i, j + 1)):
                if a < len(o1) and b < len(o2) and (a, b) not in seen:
                    seen.add((a, b))
                    heapq.heappush(heap, (d1[o1[a]] + d2[o2[b]], a, b))

    def plan(self, query: np.ndarray, entries: float, least: int) -> list[int]:
        """The non-empty cells to visit for ``entries`` entries, and ``least`` at any rate."""
        found, held = [], 0
        for cell in self.visit(query):
            if self.sizes[cell]:
                found.append(cell)
                held += self.sizes[cell]
                if held >= max(entries, least):
                    break
        return found


def _stacked(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0))


def _celled(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            cells = model.value.cells(_stacked(batch, "v"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.astype(np.int64))], names=[*batch.schema.names, "cell"])


def _visits(batches: Iterator[pa.RecordBatch], model, share: float, least: int) -> Iterator[pa.RecordBatch]:
    index = model.value
    entries = share * index.sizes.sum()
    for batch in batches:
        for query, row in zip(batch.column("vec_id").to_pylist(), _stacked(batch, "v"), strict=True):
            cells = index.plan(row, entries, least)
            yield pa.RecordBatch.from_arrays(
                [pa.array([query] * len(cells)), pa.array([row] * len(cells), pa.list_(pa.float64())), pa.array(cells, pa.int64())],
                names=["query_id", "q", "cell"],
            )


def _ranked(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Each row holds some queries and some entries of one cell. The k nearest of a query are
    kept over all rows of the task; they are passed on when ``HELD`` queries are held."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def passed_on() -> pa.RecordBatch:
        queries = np.repeat(list(held), [len(ids) for ids, _ in held.values()])
        columns = [queries, *(np.concatenate(c) for c in zip(*held.values(), strict=True))]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    for batch in batches:
        for row in range(batch.num_rows):
            asked, queries = (np.array(batch.column(c)[row].values) for c in ("query_ids", "qs"))
            ids, own = (np.array(batch.column(c)[row].values) for c in ("vec_ids", "vs"))
            queries, own = queries.reshape(len(asked), -1), own.reshape(len(ids), -1)
            for query, point in zip(asked.tolist(), queries, strict=True):
                differ = own - point
                score = np.sqrt((differ * differ).sum(axis=1))
                other = ids != query
                found, score = ids[other], score[other]
                if query in held:
                    found, score = np.concatenate([held[query][0], found]), np.concatenate([held[query][1], score])
                order = np.lexsort((found, score))[:k]
                held[query] = found[order], score[order]
            if len(held) >= HELD:
                yield passed_on()
    if held:
        yield passed_on()


FOUND = "query_id long, vec_id long, score double"


def packed(rows: DataFrame, keys: list[str], lists: dict[str, str], size: int) -> DataFrame:
    """Rows of one key packed into lists of about ``size``, dealt by hash: a hot key has many."""
    count = rows.groupBy(*keys).count().select(*keys, F.ceil(F.col("count") / size).cast("long").alias("_lists"))
    dealt = rows.join(count, keys).withColumn("_list", F.pmod(F.xxhash64(*lists), F.col("_lists")))
    made = dealt.groupBy(*keys, "_list").agg(F.collect_list(F.struct(*lists)).alias("_rows"))
    named = [F.flatten(f"_rows.{c}").alias(to) if c in ("v", "q") else F.col(f"_rows.{c}").alias(to) for c, to in lists.items()]
    return made.select(*keys, "_list", *named)


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _true_neighbours(batches: Iterator[pa.RecordBatch], pilots, k: int) -> Iterator[pa.RecordBatch]:
    asked, points = pilots.value
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, own, cells = batch.column("vec_id").to_numpy(), _stacked(batch, "v"), batch.column("cell").to_numpy()
        distance = np.sqrt(squared(points, own))
        for n, query in enumerate(asked):
            row = np.where(ids == query, np.inf, distance[n])
            near = np.lexsort((ids, row))[:k]
            near = near[row[near] < np.inf]
            yield pa.RecordBatch.from_arrays(
                [pa.array([query] * len(near), pa.int64()), pa.array(ids[near]), pa.array(row[near]), pa.array(cells[near])],
                names=["query_id", "vec_id", "score", "cell"],
            )


def fitted_share(spark: SparkSession, index: MultiIndex, celled: DataFrame, sample: list, k: int, recall: float) -> float:
    """The share of entries to visit so that ``recall`` of the pilots' neighbours are met."""
    pilots = (np.array([r["vec_id"] for r in sample]), np.array([r["v"] for r in sample]))
    found = celled.mapInArrow(partial(_true_neighbours, pilots=spark.sparkContext.broadcast(pilots), k=k), f"{FOUND}, cell long")
    wanted = defaultdict(set)
    for r in best(found, k).select("query_id", "cell", "vec_id").collect():
        wanted[r["query_id"]].add((r["cell"], r["vec_id"]))
    total, needs = index.sizes.sum(), []
    for query, point in zip(*pilots, strict=True):
        held, left = 0, sorted(c for c, _ in wanted[query])
        for cell in index.visit(point):
            held += index.sizes[cell]
            while left and cell in left:
                left.remove(cell)
                needs.append(held / total)
            if not left:
                break
    return float(np.quantile(needs, recall)) if needs else 1.0


def search(
    spark: SparkSession, rows: DataFrame, queries: str = "vec_id % 100 = 0", k: int = K, recall: float = RECALL, size: int = CENTROIDS
) -> DataFrame:
    """query_id, rank, vec_id, score: of each query (rows of ``rows`` (vec_id, embedding)
    that meet ``queries``) the k nearest others found, by Euclidean distance, ties to the
    smaller vec_id; all others if there are fewer.

    Vectors that are null, empty or zero, or hold null or non-finite components, and rows
    with a null vec_id take no part. Only vectors of one length meet. Of rows that repeat a
    vec_id the smallest vector counts. Empty tables give no rows.

    Of equal vectors only the k + 1 smallest ids are kept as entries: more can't be in any
    result, so a vector that a third of all rows share makes no hot cell.
    """
    own = usable(rows)
    own = own.groupBy("vec_id").agg(F.min(F.struct("v", "dim")).alias("_r")).select("vec_id", "_r.*")
    own = written(spark, own, "vectors")
    parts = [_search(spark, own.where(F.col("dim") == d), queries, k, recall, size) for d in sorted(r["dim"] for r in own.select("dim").distinct().collect())]
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _search(spark: SparkSession, own: DataFrame, queries: str, k: int, recall: float, size: int) -> DataFrame:
    total = own.count()
    drawn = own.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < 1_000_000 * min(1.0, SAMPLE / total))
    sample = np.array(drawn.select("v").toArrow()["v"].to_pylist())
    if not len(sample):
        sample = np.array([own.first()["v"]])
    half = max(1, sample.shape[1] // 2)
    sample = np.concatenate([sample, np.zeros((len(sample), 1))], axis=1) if sample.shape[1] == 1 else sample
    one, two = centroids(sample[:, :half], size, 1), centroids(sample[:, half:], size, 2)
    if own.first()["dim"] == 1:
        own = own.withColumn("v", F.concat("v", F.array(F.lit(0.0))))
    same = Window.partitionBy("v").orderBy("vec_id")
    entries = own.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k + 1).select("vec_id", "v")
    index = MultiIndex(one, two, np.zeros(len(one) * len(two), np.int64))
    sent = spark.sparkContext.broadcast(index)
    celled = written(spark, entries.mapInArrow(partial(_celled, model=sent), "vec_id long, v array<double>, cell long"), "cells")
    for r in celled.groupBy("cell").count().collect():
        index.sizes[r["cell"]] = r["count"]
    asked = own.where(queries).select("vec_id", "v")
    n = asked.count()
    pilots = asked.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1_000_000)) < 1_000_000 * min(1.0, PILOTS / max(1, n)))
    pilots = pilots.collect()
    sent = spark.sparkContext.broadcast(index)
    share = fitted_share(spark, index, celled, pilots, k, recall) if pilots else 1.0
    visits = asked.mapInArrow(partial(_visits, model=sent, share=share, least=k + 1), "query_id long, q array<double>, cell long")
    left = packed(visits, ["cell"], {"query_id": "query_ids", "q": "qs"}, ASKED).withColumnRenamed("_list", "_asked")
    right = packed(celled, ["cell"], {"vec_id": "vec_ids", "v": "vs"}, BLOCK)
    met = left.join(right, "cell").select("query_ids", "qs", "vec_ids", "vs")
    found = best(met.mapInArrow(partial(_ranked, k=k), FOUND), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
