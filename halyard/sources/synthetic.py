"""Seeded synthetic vectors, the same on every machine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.errors import InvalidInput
from halyard.functions.random import Xoshiro

#: Rows of a batch.
BLOCK = 8192


@dataclass(frozen=True)
class Mixture:
    """Gaussian clusters around centres drawn from ``mixture_seed``; ``clusters`` 0: uniform in [-1, 1)."""

    dim: int
    seed: int = 1
    clusters: int = 100
    center_range: float = 1.0
    spread: float = 0.1
    mixture_seed: int = 42

    def __post_init__(self):
        if not 1 <= self.dim <= 65_536 or not 0 <= self.clusters <= 1 << 20 or self.clusters * self.dim > 1 << 28:
            raise InvalidInput("dimension or clusters out of range")
        if not (0 <= self.center_range <= 1e6 and 0 <= self.spread <= 1e6):
            raise InvalidInput("range or spread out of range")

    def rows(self, n: int) -> Iterator[np.ndarray]:
        """The first ``n`` rows of the one sequence that the seeds define."""
        rng = Xoshiro(self.seed)
        if not self.clusters:
            for _ in range(n):
                yield np.array([rng.between(-1.0, 1.0) for _ in range(self.dim)], np.float32)
            return
        centre = Xoshiro(self.mixture_seed)
        r = self.center_range
        centres = np.array([centre.between(-r, r) for _ in range(self.clusters * self.dim)], np.float32).reshape(self.clusters, self.dim)
        normal = rng.normals()
        spread = float(np.float32(self.spread))
        for _ in range(n):
            c = centres[rng.below(self.clusters)]
            yield np.array([float(x) + spread * next(normal) for x in c], np.float64).astype(np.float32)


def synthetic(spark: SparkSession, spec: Mixture, n: int) -> DataFrame:
    """(row, vector): the sequence is serial, so one task makes it; see :func:`uniform` for many rows."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            pass
        rows = spec.rows(n)
        for first in range(0, n, BLOCK):
            some = list(islice(rows, BLOCK))
            yield pa.RecordBatch.from_arrays([pa.array(range(first, first + len(some)), pa.int64()), pa.array(some, pa.list_(pa.float32()))], ["row", "vector"])

    return spark.range(1, numPartitions=1).mapInArrow(make, "row long, vector array<float>")


def uniform(spark: SparkSession, dim: int, n: int, seed: int = 1) -> DataFrame:
    """(row, vector) uniform in [-1, 1) from hashes of (seed, row, dimension): any part can be made anywhere."""
    bits = lambda j: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("id"), j), 11)
    value = lambda j: (bits(j) * F.lit(2.0**-52) - 1).cast("float")
    return spark.range(n).select(F.col("id").alias("row"), F.transform(F.sequence(F.lit(1), F.lit(dim)), value).alias("vector"))
