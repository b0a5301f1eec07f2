"""A collection of vectors: batches in, versions out, searches over the current version.

A version is a table (row_id, id, vector, deleted) that never changes; a mutation makes the next one and
switches to it once all checks have passed, so a failed batch leaves no trace and readers see whole
versions. ``row_id`` is the order of insertion; an upsert appends a row and marks the old one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.config import CollectionConfig, SearchParams
from halyard.errors import InvalidInput, NotFound
from halyard.functions import vectors
from halyard.operators import graph as graphs
from halyard.operators.numbering import numbered
from halyard.operators.search import counts, exact_search, padded
from halyard.operators.validation import check_batch
from halyard.storage import stored

ROWS = "row_id long, id long, vector array<float>, deleted boolean"


class VectorCollection:
    def __init__(self, spark: SparkSession, config: CollectionConfig, rows: DataFrame | None = None, next_row: int = 0, next_id: int = 0):
        self.spark, self.config = spark, config
        self.rows = rows if rows is not None else spark.createDataFrame([], ROWS)
        self.next_row, self.next_id = next_row, next_id
        self._graph: DataFrame | None = None
        self._packed: tuple[DataFrame, DataFrame] | None = None
        #: The last batch of each stream that is part of the version.
        self.applied: dict[str, int] = {}

    # --- mutations

    def add_batch(self, batch: DataFrame, upsert: bool = False, order: str | None = None) -> int:
        """Adds ``batch`` (id, vector), all or nothing; returns its number of rows.

        Rows are inserted in the order of the column ``order`` (the id if none). Without a column ``id``, ids
        follow a counter that never turns back, whatever was removed or compacted.
        """
        if "id" not in batch.columns:
            batch = numbered(batch, [order or "vector"], "id", self.next_id)
            order = order or "id"
        vector = F.col("vector").cast("array<float>").alias("vector")
        batch = batch.select(F.col("id").cast("long").alias("id"), vector, F.col(order or "id").alias("sort_key"))
        batch = numbered(batch, ["sort_key", "id"], "position_in_batch").drop("sort_key")
        n, most = check_batch(batch, self.live() if self.next_row else None, self.config, upsert, self.next_row)
        if not n:
            return 0
        unit = vectors.normalize(F.col("vector")) if self.config.normalize else F.col("vector")
        new = batch.select((F.col("position_in_batch") + self.next_row).alias("row_id"), "id", unit.alias("vector"), F.lit(False).alias("deleted"))
        old = self._marked(batch.select("id")) if upsert and self.next_row else self.rows
        self._commit(old.unionByName(new), self.next_row + n, max(self.next_id, most + 1))
        return n

    def add(self, id_: int, vector: list[float], upsert: bool = False) -> None:
        self.add_batch(self.spark.createDataFrame([(id_, [float(x) for x in vector])], "id long, vector array<float>"), upsert)

    def remove(self, ids: DataFrame | list[int]) -> int:
        """Marks the rows of ``ids`` deleted; if one isn't live, none is, and NotFound is raised."""
        if not isinstance(ids, DataFrame):
            ids = self.spark.createDataFrame([(int(i),) for i in ids], "id long")
        ids = ids.select(F.col("id").cast("long").alias("id")).distinct()
        missing = ids.join(self.live().select("id"), "id", "left_anti").orderBy("id").first()
        if missing:
            raise NotFound(f"no id {missing['id']}")
        n = ids.count()
        self._commit(self._marked(ids), self.next_row, self.next_id)
        return n

    def compact(self) -> dict[str, int]:
        """Drops deleted rows; live rows keep their order and their bits, and get new numbers."""
        before, after = self.rows.count(), self.live().count()
        if before > after:
            rows = numbered(self.live().select("row_id", "id", "vector", "deleted"), ["row_id"], "new_row")
            self._commit(rows.select(F.col("new_row").alias("row_id"), "id", "vector", "deleted"), after, self.next_id)
        return {"rows_before": before, "removed_rows": before - after, "rows_after": after}

    def _marked(self, ids: DataFrame) -> DataFrame:
        gone = ids.select("id", F.lit(True).alias("gone")).distinct()
        return self.rows.join(gone, "id", "left").select("row_id", "id", "vector", (F.col("deleted") | F.coalesce("gone", F.lit(False))).alias("deleted"))

    def _commit(self, rows: DataFrame, next_row: int, next_id: int) -> None:
        rows = stored(rows)
        self.rows, self.next_row, self.next_id, self._graph = rows, next_row, next_id, None

    # --- reads

    def live(self) -> DataFrame:
        return self.rows.where("not deleted")

    def size(self) -> int:
        return self.live().count()

    def describe(self) -> dict:
        """Parameters, counts, and the bytes that the vectors take in memory."""
        s = self.stats().first().asDict()
        return s | {"dim": self.config.dim, "metric": self.config.metric, "index": self.config.index, "normalize": self.config.normalize, "vector_bytes": 4 * self.config.dim * s["rows"]}

    def stats(self) -> DataFrame:
        """One row (live, deleted, rows)."""
        return self.rows.agg(F.count_if(~F.col("deleted")).alias("live"), F.count_if(F.col("deleted")).alias("deleted"), F.count("*").alias("rows"))

    def contains(self, ids: DataFrame) -> DataFrame:
        """(id, found) for each id asked."""
        known = self.live().select("id", F.lit(True).alias("found"))
        return ids.select("id").join(known, "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"))

    def get(self, id_: int) -> list[float]:
        """The stored vector, of unit length where the collection normalizes."""
        row = self.live().where(F.col("id") == id_).select("vector").first()
        if row is None:
            raise NotFound(f"no id {id_}")
        return row[0]

    def graph(self) -> DataFrame:
        if self._graph is None:
            self._graph = graphs.build(self.rows, self.config)
        return self._graph

    def search(self, queries: DataFrame, k: int = 10, ef_search: int | None = None, strict: bool = True) -> DataFrame:
        """(qid, rank, id, distance) for ``queries`` (qid, query); fewer than k ranks if fewer rows are live."""
        params = SearchParams(k, ef_search)
        queries = queries.select(F.col("qid").cast("long").alias("qid"), F.col("query").cast("array<float>").alias("query"))
        if self.config.index == "hnsw":
            if self._packed is None or self._packed[0] is not self.graph():
                self._packed = self.graph(), graphs.packed(self.graph(), self.config)
            return graphs.graph_search(self._packed[1], queries, self.config, params)
        return exact_search(self.rows, queries, self.config, params, strict)

    def search_padded(self, queries: DataFrame, k: int = 10, ef_search: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(exactly k ranks for each query, counts of real results)."""
        found = stored(self.search(queries, k, ef_search))
        return padded(found, queries, k), counts(found, queries)

    def search_one(self, query: list[float], k: int = 10) -> list[tuple[int, float]]:
        if isinstance(query, (int, float)) or not len(query):
            raise InvalidInput("a query is a list of numbers")
        q = self.spark.createDataFrame([(0, [float(x) for x in query])], "qid long, query array<float>")
        return [(r["id"], r["distance"]) for r in self.search(q, k).orderBy("rank").collect()]
