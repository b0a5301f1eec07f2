"""Exact k-nearest-neighbour search of many queries at once.

Queries are sent to the rows in blocks of bounded size; rows are never shuffled or sent anywhere. Each
partition keeps its k best rows for each query, so what meets in the final ranking is k rows for each
query and partition. Equal distances go by insertion order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halyard.config import NO_ID, CollectionConfig, SearchParams
from halyard.functions import kernels, vectors
from halyard.operators.validation import check_queries

#: Bytes of queries broadcast at once; rows of a partition scored at once.
BLOCK_BYTES, ROWS = 64 << 20, 2048
#: Queries of a part in the forms by expressions.
MOST_ASKED = 4096
CANDIDATE = "qid long, row_id long, id long, distance float"


def query_blocks(queries: DataFrame, dim: int, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(qids, matrix) in blocks of at most ``block_bytes``; the driver holds one block at a time."""
    most = max(1, block_bytes // (4 * dim))
    qids: list[int] = []
    rows: list = []
    for r in queries.select("qid", "query").toLocalIterator():
        qids.append(r[0])
        rows.append(r[1])
        if len(qids) == most:
            yield np.array(qids, np.int64), np.array(rows, np.float32)
            qids, rows = [], []
    if qids:
        yield np.array(qids, np.int64), np.array(rows, np.float32)


def ranked(candidates: DataFrame, k: int) -> DataFrame:
    """(qid, rank, id, distance): the k nearest of each query, ranks from 1."""
    order = Window.partitionBy("qid").orderBy("distance", "row_id")
    found = candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("qid", "rank", "id", "distance")


class Best:
    """The k nearest rows of each query so far."""

    def __init__(self, n: int, k: int):
        self.k, self.q = k, np.zeros(0, np.int64)
        self.row, self.id, self.d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        self.limit = np.full(n, np.inf, np.float32)  # distance of the k-th so far

    def candidates(self, d: np.ndarray, first: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) places of ``d``, of queries from ``first``, that may be among the k nearest."""
        limit = self.limit[first : first + len(d)]
        if np.isfinite(limit).all():
            return np.nonzero(d <= limit[:, None])
        return kernels.smallest(d, order, self.k)

    def scan(self, mode: str, q: np.ndarray, inverse: np.ndarray, v: np.ndarray, row: np.ndarray, id_: np.ndarray, strict: bool) -> None:
        """Scores the rows ``v``, numbered ``row``, for all queries."""
        for s in range(0, len(row), ROWS):
            for t in range(0, len(q), ROWS):
                d = kernels.scores(mode, q[t : t + ROWS], inverse[t : t + ROWS], v[s : s + ROWS], strict)
                at, c = self.candidates(d, t, row[s : s + ROWS])
                self.add(at + t, row[s : s + ROWS][c], id_[s : s + ROWS][c], d[at, c])

    def add(self, q: np.ndarray, row: np.ndarray, id_: np.ndarray, d: np.ndarray) -> None:
        q, row, id_, d = (np.concatenate(x) for x in ((self.q, q), (self.row, row), (self.id, id_), (self.d, d)))
        order = np.lexsort((row, d, q))
        q = q[order]
        near = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        keep = order[near]
        self.q, self.row, self.id, self.d = q[near], row[keep], id_[keep], d[keep]
        last = np.searchsorted(self.q, np.arange(len(self.limit)), "right") - 1
        full = np.bincount(self.q, minlength=len(self.limit)) == self.k
        self.limit[full] = self.d[last[full]]


def exact_search(rows: DataFrame, queries: DataFrame, config: CollectionConfig, params: SearchParams = SearchParams(), strict: bool = True) -> DataFrame:
    """(qid, rank, id, distance) of ``queries`` (qid, query) among live ``rows`` (row_id, id, vector, deleted).

    In unit modes ``rows`` hold unit vectors. All queries are checked first; one bad query fails all.
    """
    return ranked(candidates(rows, queries, config, params, strict), params.k)


def candidates(rows: DataFrame, queries: DataFrame, config: CollectionConfig, params: SearchParams = SearchParams(), strict: bool = True) -> DataFrame:
    """(qid, row_id, id, distance): of each partition the k nearest rows of each query."""
    check_queries(queries, config)
    live = rows.where("not deleted").select("row_id", "id", "vector")
    spark, k, mode, dim = rows.sparkSession, params.k, config.mode, config.dim
    found = []
    for qids, q in query_blocks(queries, dim):
        sent = spark.sparkContext.broadcast((qids, q, kernels.inverse_norm(q) if config.normalize else np.ones(len(q), np.float32)))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            qids, q, inverse = sent.value
            best = Best(len(q), k)
            for batch in batches:
                row, id_ = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                best.scan(mode, q, inverse, kernels.matrix(batch.column(2), dim), row, id_, strict)
            yield pa.RecordBatch.from_arrays([pa.array(qids[best.q]), pa.array(best.row), pa.array(best.id), pa.array(best.d)], ["qid", "row_id", "id", "distance"])

        found.append(live.mapInArrow(scan, CANDIDATE))
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], CANDIDATE)


def _parts(queries: DataFrame, config: CollectionConfig) -> list[DataFrame]:
    """``queries`` with their inverse norms, in parts small enough to broadcast."""
    inverse = vectors.inverse_norm(F.col("query")) if config.normalize else F.lit(1.0).cast("float")
    asked = queries.select("qid", "query", inverse.alias("inverse"))
    n = -(-queries.count() // max(1, min(MOST_ASKED, BLOCK_BYTES // (4 * config.dim))))
    return [asked.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == i) for i in range(n)] if n > 1 else [asked]


def search_expression(rows: DataFrame, queries: DataFrame, config: CollectionConfig, k: int) -> DataFrame:
    """The same result as plain expressions: parts of the queries are broadcast, and each query meets every row."""
    live = rows.where("not deleted").select("row_id", "id", "vector")
    distance = vectors.score(config.mode, F.col("query"), F.col("inverse"), F.col("vector")).alias("distance")
    met = [live.join(F.broadcast(q)).select("qid", "row_id", "id", distance) for q in _parts(queries, config)]
    return ranked(reduce(DataFrame.union, met), k)


def search_lateral(rows: DataFrame, queries: DataFrame, config: CollectionConfig, k: int) -> DataFrame:
    """The same result by a correlated subquery: for each query the k nearest rows of a lateral join, parts of the queries at a time.

    The subquery knows its query by id and a hash of the vector, and finds the vector itself. Were it correlated by the
    vector, each pair of a query and a row would be sorted by the vector's components.
    """
    live = rows.where("not deleted").select("row_id", "id", "vector")
    distance = vectors.score(config.mode, F.col("query"), F.col("inverse"), F.col("vector")).alias("distance")
    found = []
    for q in _parts(queries, config):
        q = q.withColumn("mark", F.xxhash64("query"))
        asked = F.broadcast(q.select(F.col("qid").alias("asked"), F.col("mark").alias("asked_mark"), "query", "inverse").dropDuplicates(["asked", "asked_mark"]))
        own = F.col("asked").eqNullSafe(F.col("qid").outer()) & (F.col("asked_mark") == F.col("mark").outer())
        near = live.join(asked).where(own).select("row_id", "id", distance).orderBy("distance", "row_id").limit(k)
        found.append(q.select("qid", "mark").lateralJoin(near).select("qid", "row_id", "id", "distance"))
    return ranked(reduce(DataFrame.union, found), k)


def ranked_by_slice(candidates: DataFrame, k: int) -> DataFrame:
    """Like :func:`ranked`, by sorting all candidates of a query and slicing; for as many candidates as a row may hold."""
    best = F.slice(F.array_sort(F.collect_list(F.struct("distance", "row_id", "id"))), 1, k)
    found = candidates.groupBy("qid").agg(best.alias("best")).select("qid", F.posexplode("best").alias("at", "x"))
    return found.select("qid", (F.col("at") + 1).alias("rank"), "x.id", "x.distance")


def padded(results: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``results`` with exactly k ranks for each query: missing ones have id -1 and an infinite distance."""
    every = queries.select("qid", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    found = every.join(results, ["qid", "rank"], "left")
    return found.select("qid", "rank", F.coalesce("id", F.lit(NO_ID).cast("long")).alias("id"), F.coalesce("distance", F.lit(float("inf")).cast("float")).alias("distance"))


def counts(results: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, n): the real results of each query."""
    n = results.groupBy("qid").agg(F.count("*").alias("n"))
    return queries.select("qid").join(n, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
