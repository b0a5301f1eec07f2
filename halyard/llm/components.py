"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import scratch, stored


class Forest:
    """Disjoint sets; the root of a set is its smallest member."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while (up := self.parent.get(x, x)) != root:
            self.parent[x], x = root, up
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as stars, one for each of its components."""
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(a, b)
    pairs = [(x, forest.find(x)) for x in list(forest.parent)]
    pairs = [p for p in pairs if p[0] != p[1]]
    yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of each node that has an edge in (a, b).

    Edges are contracted to stars in their partitions, then large-star and small-star rounds follow, a
    logarithmic number in the size of a component, until no edge changes. Each round goes to the shared
    folder. A star's centre may have any number of edges: only minima are taken over them.
    """
    with scratch(edges.sparkSession) as keep:
        edges = stored(edges.where("a <> b").select("a", "b").mapInArrow(_contract, "a long, b long").distinct())
        before = None
        while True:
            both = edges.union(edges.select("b", "a"))
            # stored, so that both sides of the joins are plain shuffles and a star's partition can be split
            least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
            large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            down = large.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
            down = stored(down)
            least = stored(down.groupBy("a").agg(F.min("b").alias("m")))
            small = down.join(least, "a")
            small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
            edges = stored(small.where("a <> b").distinct())
            now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
            if now == before:
                break
            before = now
        return keep(stored(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())))
