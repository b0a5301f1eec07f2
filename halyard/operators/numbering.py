"""Dense numbers for ordered rows without one task seeing them all."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.storage import stored


def numbered(df: DataFrame, order: list[str], name: str, first: int = 0) -> DataFrame:
    """``df`` with ``name``: first, first + 1, ... in the order of the columns ``order``.

    Rows are sorted by range; each partition counts its own rows, and one number for each partition is
    added. The sorted rows go to the shared folder between the two, so both see the same partitions.
    """
    schema = df.schema
    within = df.repartitionByRange(*order).sortWithinPartitions(*order)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            k = batch.num_rows
            columns = [*batch.columns, pa.array([part] * k, pa.int32()), pa.array(range(n, n + k), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "_part", "_at"])
            n += k

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    rows = stored(within.mapInArrow(count, f"{out}, _part int, _at long"))
    base, bases = first, []
    for part, n in sorted(tuple(r) for r in rows.groupBy("_part").count().collect()):  # one row for each partition
        bases.append((part, base))
        base += n
    bases = df.sparkSession.createDataFrame(bases, "_part int, _base long")
    return rows.join(F.broadcast(bases), "_part").withColumn(name, F.col("_base") + F.col("_at")).drop("_part", "_at", "_base")
