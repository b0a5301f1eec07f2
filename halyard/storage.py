"""Files through Spark's own file systems, and tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from halyard.errors import InvalidInput

_cleaned: set[str] = set()


class Files:
    """The few file operations that catalogs need, on any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(path))) if self.exists(path) else []

    def make(self, path: str) -> None:
        self.fs.mkdirs(self._path(path))

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Writes beside the file, then renames: a reader sees the old text or the new one."""
        beside = f"{path}.{uuid.uuid4().hex}"
        stream = self.fs.create(self._path(beside), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.exists(path):
            old = f"{path}.old"
            self.delete(old)
            self.fs.rename(self._path(path), self._path(old))
        self.fs.rename(self._path(beside), self._path(path))


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application below spark.checkpoint.dir, removed when Python ends.

    Where that is unset, a temporary folder will do if all of Spark is one process; on a cluster, whose
    machines would each write to their own disk, it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise InvalidInput("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="halyard-")
        spark.conf.set("spark.checkpoint.dir", found)
    path = f"{found}/halyard-{spark.sparkContext.applicationId}"
    if path not in _cleaned:
        _cleaned.add(path)
        atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes ``path`` if Spark still runs; what a stopped Spark leaves is its administrator's to clean."""
    try:
        Files(spark, path).delete(path)
    except Exception:  # noqa: BLE001  the JVM is gone
        pass


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so that its lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


_scopes: list[list[str]] = []


@contextmanager
def scope() -> Iterator[list[str]]:
    """The paths of the tables that are stored inside."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes.pop()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes the tables that are stored inside, except those that it is told to keep: ``with scratch(spark) as keep: ... keep(stored(df))``.

    Nothing else that is read after it may depend on tables stored inside.
    """
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.stored_at)
        return df

    with scope() as made:
        yield keep
    if _scopes:
        _scopes[-1].extend(kept)
    for path in made:
        if path not in kept:
            remove(spark, path)
