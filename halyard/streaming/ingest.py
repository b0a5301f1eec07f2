"""Streaming ingestion: each micro-batch is one upsert or insert, committed once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from halyard.catalog import VectorCatalog
from halyard.operators.collection import VectorCollection


class Ingest:
    """Feeds a stream of (id, vector, order column) to a collection. A replayed micro-batch is left out.

    The last batch of each ``stream`` is part of the collection's version. With a ``catalog``, each batch is
    saved there with its number in the manifest, whose replacement commits both, so a batch counts once
    also where the driver starts anew between the two commits of Spark and the catalog.
    """

    def __init__(self, collection: VectorCollection | str, upsert: bool = True, order: str = "id", stream: str = "stream", catalog: VectorCatalog | None = None):
        self.name = collection if isinstance(collection, str) else None
        self._own = collection if self.name is None else None
        self.upsert, self.order, self.stream, self.catalog = upsert, order, stream, catalog

    @property
    def collection(self) -> VectorCollection:
        return self._own or self.catalog.get(self.name)

    @property
    def done(self) -> int:
        return self.collection.applied.get(self.stream, -1)

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        if epoch <= self.done:
            return
        if self.upsert:  # of an id that stands twice in a batch, the last in order counts
            last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(self.order)))
            batch = batch.withColumn("_last", last).where("_last = 1").drop("_last")
        collection = self.collection
        collection.add_batch(batch, self.upsert, self.order)
        collection.applied[self.stream] = epoch
        if self.catalog:
            self.catalog.save(self.name)

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
