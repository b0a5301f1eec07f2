"""Named collections under one folder, each saved as numbered generations.

    <root>/<name>/CONFIG                  parameters, written once
    <root>/<name>/MANIFEST                the current generation; replacing it is the commit
    <root>/<name>/generation.000001/rows, /graph

A save writes the next generation, then the manifest, then drops older generations. What a crash leaves
behind is a generation that no manifest names; opening removes it.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

from halyard.config import CollectionConfig
from halyard.errors import AlreadyExists, Corrupt, InvalidInput, NotFound
from halyard.operators.collection import ROWS, VectorCollection
from halyard.operators.graph import NODE
from halyard.storage import Files

NAME = re.compile(r"[A-Za-z0-9_-]{1,64}")
KEYS = {"generation", "rows", "live", "next_row", "next_id", "graph", "applied"}


class VectorCatalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)
        self.files.make(self.root)
        self.open: dict[str, VectorCollection] = {}
        for name in self.files.names(self.root):
            if NAME.fullmatch(name):
                self._recover(name)

    def _at(self, name: str, *parts: str) -> str:
        return "/".join([self.root, name, *parts])

    def _recover(self, name: str) -> None:
        """Removes a creation that stopped before its parameters, and generations that no manifest names."""
        if not self.files.exists(self._at(name, "CONFIG")):
            self.files.delete(self._at(name))
            return
        current = self._manifest(name)
        keep = f"generation.{current['generation']:06d}" if current else ""
        for part in self.files.names(self._at(name)):
            if part.startswith("generation.") and part != keep:
                self.files.delete(self._at(name, part))

    def _manifest(self, name: str) -> dict | None:
        path = self._at(name, "MANIFEST")
        if not self.files.exists(path):
            if not self.files.exists(f"{path}.old"):
                return None
            path += ".old"  # stopped between two renames
        try:
            found = json.loads(self.files.read(path))
        except Exception as e:  # noqa: BLE001  whatever the file system says of a damaged file
            raise Corrupt(f"{path} can't be read as JSON: {str(e)[:200]}") from None
        if not isinstance(found, dict) or set(found) != KEYS or not all(isinstance(found[k], int) and found[k] >= 0 for k in KEYS - {"graph", "applied"}) or not isinstance(found["applied"], dict):
            raise Corrupt(f"{path} does not describe a generation")
        return found

    def create(self, name: str, config: CollectionConfig) -> VectorCollection:
        if not NAME.fullmatch(name):
            raise InvalidInput("a name has 1 to 64 letters, digits, _ or -")
        if self.files.exists(self._at(name)):
            raise AlreadyExists(name)
        self.files.make(self._at(name))
        self.files.write(self._at(name, "CONFIG"), config.to_json())
        self.open[name] = VectorCollection(self.spark, config)
        return self.open[name]

    def get(self, name: str) -> VectorCollection:
        if name in self.open:
            return self.open[name]
        if not NAME.fullmatch(name) or not self.files.exists(self._at(name, "CONFIG")):
            raise NotFound(name)
        config = CollectionConfig.from_json(self.files.read(self._at(name, "CONFIG")))
        current = self._manifest(name)
        if current is None:
            self.open[name] = VectorCollection(self.spark, config)
        else:
            at = self._at(name, f"generation.{current['generation']:06d}")
            rows = self.spark.read.schema(ROWS).parquet(f"{at}/rows")
            found = VectorCollection(self.spark, config, rows, current["next_row"], current["next_id"])
            found.applied = dict(current["applied"])
            if current["graph"]:
                found._graph = self.spark.read.schema(NODE).parquet(f"{at}/graph")
            self.open[name] = found
        return self.open[name]

    def save(self, name: str) -> int:
        """Writes the collection's version as the next generation; returns its number."""
        collection, current = self.get(name), self._manifest(name)
        n = current["generation"] + 1 if current else 1
        at = self._at(name, f"generation.{n:06d}")
        self.files.delete(at)
        collection.rows.write.parquet(f"{at}/rows")
        graph = collection.config.index == "hnsw"
        if graph:
            collection.graph().write.parquet(f"{at}/graph")
        s = collection.stats().first()
        manifest = {"generation": n, "rows": s["rows"], "live": s["live"], "next_row": collection.next_row, "next_id": collection.next_id, "graph": graph, "applied": collection.applied}
        self.files.write(self._at(name, "MANIFEST"), json.dumps(manifest, sort_keys=True))
        del self.open[name]
        self.get(name)
        self._recover(name)
        return n

    def save_all(self) -> dict[str, int]:
        """Saves every open collection; all are tried, then the first error is raised."""
        done, failed = {}, None
        for name in sorted(self.open):
            try:
                done[name] = self.save(name)
            except NotFound:
                continue
            except Exception as e:  # noqa: BLE001  raised below
                failed = failed or e
        if failed:
            raise failed
        return done

    def drop(self, name: str) -> None:
        if not NAME.fullmatch(name) or not self.files.exists(self._at(name)):
            raise NotFound(name)
        self.open.pop(name, None)
        self.files.delete(self._at(name))

    def names(self) -> list[str]:
        return [n for n in self.files.names(self.root) if NAME.fullmatch(n) and self.files.exists(self._at(n, "CONFIG"))]

    def entries(self) -> DataFrame:
        """(name, dim, metric, index, generation, rows, live) of saved and open collections, by name."""
        rows = []
        for name in self.names():
            config = CollectionConfig.from_json(self.files.read(self._at(name, "CONFIG")))
            m = self._manifest(name) or {"generation": 0, "rows": 0, "live": 0}
            rows.append((name, config.dim, config.metric, config.index, m["generation"], m["rows"], m["live"]))
        return self.spark.createDataFrame(rows, "name string, dim int, metric string, index string, generation long, rows long, live long").orderBy("name")
