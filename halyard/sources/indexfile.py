"""One-file index exchange: rows, tombstones and the graph of one shard, with checksums.

The layout is little-endian: a header of 64 bytes, sections at multiples of 8 (vectors of 4096), and a table of
sections at the end; every region has a CRC-32C. Spark's own snapshots stay Parquet; this file is for
passing an index to a program that maps it.

Rows are written in order, streamed through the driver, and read by row ranges in parallel. Files are opened
by path, so they must lie on storage that driver and executors mount.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from halyard.config import CollectionConfig, GraphParams
from halyard.errors import Corrupt, InvalidInput, Unsupported

#: Fixed values of the format.
MAGIC = b"VFIDX\r\n\x1a"
ENDIAN, OTHER_ENDIAN, MAJOR, HEADER, ENTRY, ALIGN, PAGE = 0x01020304, 0x04030201, 1, 64, 32, 8, 4096
HAS_GRAPH, HAS_TOMBSTONES, NORMALIZED = 1, 2, 4
METADATA, VECTORS, LABELS, TOMBSTONES, LEVELS, L0_LINKS, UPPER_INDEX, UPPER_LINKS = range(1, 9)
METRICS, INDEXES = ("l2", "ip", "cosine"), ("flat", "hnsw")
NOTHING, NO_BLOCK, POLYNOMIAL = 0xFFFFFFFF, (1 << 64) - 1, 0x82F63B78
VERIFY = ("none", "metadata", "full")
ROWS_A_TASK = 65_536
#: Lanes of the checksum: so many stretches of a block run side by side.
LANES = 4096


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


@lru_cache(maxsize=64)
def _shift(zeros: int) -> np.ndarray:
    """What ``zeros`` bytes of zero do to each bit of a checksum's register, by repeated squaring."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    out, step = bits.copy(), _table()[bits & 0xFF] ^ (bits >> np.uint32(8))
    while zeros:
        if zeros & 1:
            out = _apply(step, out)
        step = _apply(step, step)
        zeros >>= 1
    return out


def _apply(shift: np.ndarray, x: np.ndarray) -> np.ndarray:
    on = (x[:, None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)
    return np.bitwise_xor.reduce(np.where(on == 1, shift[None, :], np.uint32(0)), axis=1).astype(np.uint32)


def crc32c(data: bytes, before: int = 0) -> int:
    """CRC-32C of ``data`` after bytes whose checksum is ``before``."""
    raw, table = np.frombuffer(data, np.uint8), _table()
    register = np.array([before ^ NOTHING], np.uint32)
    length = len(raw) // LANES
    if length:  # lanes run from 0 and are put together by what the bytes after each do to it
        lanes, own = raw[: length * LANES].reshape(LANES, length), np.zeros(LANES, np.uint32)
        for k in range(length):
            own = table[(own ^ lanes[:, k]) & np.uint32(0xFF)] ^ (own >> np.uint32(8))
        shift = _shift(length)
        for x in own:
            register = _apply(shift, register) ^ x
    x = int(register[0])
    plain = table.tolist() if len(raw) % LANES else None
    for byte in raw[length * LANES :].tolist():
        x = plain[(x ^ byte) & 0xFF] ^ (x >> 8)
    return x ^ NOTHING


@dataclass
class Meta:
    config: CollectionConfig
    rows: int
    live: int
    entry: int = NOTHING
    top: int = 0
    creator: str = "halyard"
    created_ms: int = 0

    def encode(self) -> bytes:
        c, g, name = self.config, self.config.graph, self.creator.encode()
        head = struct.pack("<IBBBBQQIIIIBBHIQQ", c.dim, METRICS.index(c.metric), INDEXES.index(c.index), c.normalize and c.metric != "cosine", 0, self.rows, self.live, g.m, 2 * g.m, g.ef_construction, g.ef_search, g.max_level, self.top, 0, self.entry, g.seed, 0)
        return head + struct.pack("<H", len(name)) + name + struct.pack("<Q", self.created_ms)

    @staticmethod
    def decode(raw: bytes) -> Meta:
        if len(raw) < 74:
            raise Corrupt("METADATA: too short")
        dim, metric, index, normalize, pad, rows, live, m, m0, efc, efs, cap, top, pad2, entry, seed, pad3 = struct.unpack("<IBBBBQQIIIIBBHIQQ", raw[:64])
        n = struct.unpack("<H", raw[64:66])[0]
        if pad or pad2 or pad3 or metric > 2 or index > 1 or normalize > 1 or n > 256 or len(raw) != 74 + n or m0 != 2 * m or live > rows or rows >= NOTHING:
            raise Corrupt("METADATA: a field is out of range")
        try:
            config = CollectionConfig(dim, METRICS[metric], bool(normalize), INDEXES[index], GraphParams(m, efc, efs, cap, seed, shards=1))
            name = raw[66 : 66 + n].decode()
        except (InvalidInput, UnicodeDecodeError) as e:
            raise Corrupt(f"METADATA: {e}") from None
        if (entry == NOTHING) != (config.index == "flat" or rows == 0) or (entry != NOTHING and entry >= rows) or top > cap or (entry == NOTHING and top):
            raise Corrupt("METADATA: entry point")
        return Meta(config, rows, live, entry, top, name, struct.unpack("<Q", raw[66 + n :])[0])


class _Writer:
    def __init__(self, f):
        self.f, self.crc = f, 0

    def put(self, data: bytes) -> None:
        self.f.write(data)
        self.crc = crc32c(data, self.crc)

    def pad(self, to: int) -> int:
        self.f.write(b"\0" * (-self.f.tell() % to))
        self.crc = 0
        return self.f.tell()


def _lists(links: list[list[int]], room: int) -> bytes:
    out = np.full((len(links), room + 1), NOTHING, np.uint32)
    for i, own in enumerate(links):
        out[i, 0], out[i, 1 : 1 + len(own)] = len(own), own
    return out.tobytes()


def _blocks(df: DataFrame, columns: list[str], order: str) -> Iterator[list[tuple]]:
    some = []
    for r in df.orderBy(order).select(*columns).toLocalIterator():
        some.append(tuple(r))
        if len(some) == 8192:
            yield some
            some = []
    if some:
        yield some


def write_index(rows: DataFrame, config: CollectionConfig, path: str, graph: DataFrame | None = None, creator: str = "halyard", created_ms: int = 0) -> int:
    """Writes ``rows`` (row_id, id, vector, deleted) and the ``graph`` of an hnsw collection, which has one shard; returns the bytes.

    The same rows give the same bytes. The file is written beside ``path`` and renamed once it is whole.
    """
    if (config.index == "hnsw") != (graph is not None):
        raise InvalidInput("an hnsw index is written with its graph, others without one")
    counts = rows.agg(F.count("*").alias("n"), F.count_if(~F.col("deleted")).alias("live")).first()
    meta = Meta(config, counts["n"], counts["live"], creator=creator, created_ms=created_ms)
    if graph is not None:
        if graph.select("shard").distinct().count() > 1:
            raise InvalidInput("only a graph of one shard fits into one file")
        top = graph.agg(F.max_by("node", F.struct("level", -F.col("node"))).alias("node"), F.max("level").alias("level")).first()
        meta.entry, meta.top = (top["node"], top["level"]) if top["node"] is not None else (NOTHING, 0)
    beside, entries, m = f"{path}.tmp", [], config.graph.m
    with open(beside, "wb") as f:
        w = _Writer(f)
        f.write(b"\0" * HEADER)

        def section(kind: int, data: Iterator[bytes], align: int = ALIGN) -> None:
            start = w.pad(align)
            for block in data:
                w.put(block)
            entries.append((kind, 0, start, f.tell() - start, w.crc, 0))

        section(METADATA, iter([meta.encode()]))
        section(LABELS, (np.array([r[0] for r in b], np.int64).astype("<u8").tobytes() for b in _blocks(rows, ["id"], "row_id")))
        if meta.rows > meta.live:
            gone = np.concatenate([np.array([r[0] for r in b], bool) for b in _blocks(rows, ["deleted"], "row_id")])
            section(TOMBSTONES, iter([np.packbits(np.r_[gone, np.zeros(-len(gone) % 64, bool)], bitorder="little").tobytes()]))
        if graph is not None:
            section(LEVELS, (np.array([r[0] for r in b], np.uint8).tobytes() for b in _blocks(graph, ["level"], "node")))
            section(L0_LINKS, (_lists([r[0][0] for r in b], 2 * m) for b in _blocks(graph, ["links"], "node")))
            place = 0

            def places() -> Iterator[bytes]:
                nonlocal place
                for b in _blocks(graph, ["level"], "node"):
                    own = np.array([r[0] for r in b], np.int64) * (1 + m)
                    at = place + np.cumsum(own) - own
                    place += int(own.sum())
                    yield np.where(own > 0, at.astype(np.uint64), np.uint64(NO_BLOCK)).tobytes()

            section(UPPER_INDEX, places())
            section(UPPER_LINKS, (_lists([own for r in b for own in r[0][1:]], m) for b in _blocks(graph, ["links"], "node")))
        section(VECTORS, (np.array([r[0] for r in b], "<f4").tobytes() for b in _blocks(rows, ["vector"], "row_id")), PAGE)
        at = w.pad(ALIGN)
        w.put(b"".join(struct.pack("<IIQQII", *e) for e in entries))
        size = f.tell()
        flags = (graph is not None) * HAS_GRAPH | (meta.rows > meta.live) * HAS_TOMBSTONES | config.normalize * NORMALIZED
        head = MAGIC + struct.pack("<HHIQQQIIQ", MAJOR, 0, ENDIAN, flags, size, at, len(entries), w.crc, 0)
        f.seek(0)
        f.write(head + struct.pack("<II", crc32c(head), 0))
        f.flush()
        os.fsync(f.fileno())
    os.replace(beside, path)
    return size


def _crc_of(f, start: int, size: int) -> int:
    f.seek(start)
    crc = 0
    while size:
        block = f.read(min(size, 16 << 20))
        crc, size = crc32c(block, crc), size - len(block)
    return crc


def inspect(path: str, verify: str = "full") -> tuple[Meta, dict[int, tuple[int, int]], int]:
    """(metadata, {section: (start, size)}, flags) of a file, checked: layout always, checksums as ``verify`` says."""
    if verify not in VERIFY:
        raise InvalidInput(f"verify is one of {', '.join(VERIFY)}")
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        head = f.read(HEADER)
        if len(head) < HEADER or head[:8] != MAGIC:
            raise Corrupt(f"{path}: not an index file")
        major, _, endian, flags, said, at, n, table_crc, zero = struct.unpack("<HHIQQQIIQ", head[8:56])
        if endian == OTHER_ENDIAN or (endian == ENDIAN and major != MAJOR):
            raise Unsupported(f"{path}: byte order or version")
        if endian != ENDIAN or struct.unpack("<II", head[56:]) != (crc32c(head[:56]), 0) or zero or said != size or flags > 7 or not 1 <= n <= 64 or at % ALIGN or at + n * ENTRY != size:
            raise Corrupt(f"{path}: header")
        f.seek(at)
        raw = f.read(n * ENTRY)
        if crc32c(raw) != table_crc:
            raise Corrupt(f"{path}: section table checksum")
        found, crcs, end = {}, {}, HEADER
        for kind, own, start, length, crc, zero in sorted(struct.iter_unpack("<IIQQII", raw), key=lambda e: e[2]):
            if own > 1 or zero or start % ALIGN or start < end or start + length > at or kind in found or (not METADATA <= kind <= UPPER_LINKS and not own):
                raise Corrupt(f"{path}: section {kind}")
            f.seek(end)
            if f.read(start - end).strip(b"\0"):
                raise Corrupt(f"{path}: bytes between sections")
            found[kind], crcs[kind], end = (start, length), crc, start + length
        f.seek(end)
        if f.read(at - end).strip(b"\0"):
            raise Corrupt(f"{path}: bytes before the section table")
        graph = {LEVELS, L0_LINKS, UPPER_INDEX, UPPER_LINKS}
        needed = {METADATA, VECTORS, LABELS} | (graph if flags & HAS_GRAPH else set()) | ({TOMBSTONES} if flags & HAS_TOMBSTONES else set())
        if needed != {k for k in found if k <= UPPER_LINKS} or found[VECTORS][0] % PAGE:
            raise Corrupt(f"{path}: sections and flags differ")
        for kind, (start, length) in found.items():
            if verify == "full" or (verify == "metadata" and kind != VECTORS):
                if _crc_of(f, start, length) != crcs[kind]:
                    raise Corrupt(f"{path}: checksum of section {kind}")
        f.seek(found[METADATA][0])
        meta = Meta.decode(f.read(found[METADATA][1]))
        c, m = meta.config, meta.config.graph.m
        if bool(flags & HAS_GRAPH) != (c.index == "hnsw") or bool(flags & NORMALIZED) != c.normalize or bool(flags & HAS_TOMBSTONES) != (meta.live < meta.rows):
            raise Corrupt(f"{path}: metadata and flags differ")
        sizes = {LABELS: 8 * meta.rows, VECTORS: 4 * c.dim * meta.rows, TOMBSTONES: -(-meta.rows // 64) * 8, LEVELS: meta.rows, L0_LINKS: 4 * meta.rows * (1 + 2 * m), UPPER_INDEX: 8 * meta.rows}
        if flags & HAS_GRAPH:
            f.seek(found[LEVELS][0])
            levels = np.frombuffer(f.read(found[LEVELS][1]), np.uint8).astype(np.int64)
            sizes[UPPER_LINKS] = 4 * int(levels.sum()) * (1 + m)
            f.seek(found[UPPER_INDEX][0])
            own = levels * (1 + m)
            want = np.where(own > 0, (np.cumsum(own) - own).astype(np.uint64), np.uint64(NO_BLOCK))
            if len(levels) == meta.rows and (not np.array_equal(np.frombuffer(f.read(found[UPPER_INDEX][1]), np.uint64), want) or (meta.rows and (levels.max() != meta.top or levels[meta.entry] != meta.top))):
                raise Corrupt(f"{path}: levels")
        if any(found[k][1] != s for k, s in sizes.items() if k in found):
            raise Corrupt(f"{path}: size of a section")
        if TOMBSTONES in found:
            f.seek(found[TOMBSTONES][0])
            bits = np.unpackbits(np.frombuffer(f.read(found[TOMBSTONES][1]), np.uint8), bitorder="little")
            if bits[meta.rows :].any() or int(bits.sum()) != meta.rows - meta.live:
                raise Corrupt(f"{path}: tombstones")
    return meta, found, flags


@dataclass
class _Range(InputPartition):
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, meta: Meta, found: dict):
        self.path, self.meta, self.found = path, meta, found

    def partitions(self) -> list[_Range]:
        return [_Range(i, min(i + ROWS_A_TASK, self.meta.rows)) for i in range(0, self.meta.rows, ROWS_A_TASK)] or [_Range(0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        c, found = self.meta.config, self.found
        with open(self.path, "rb") as f:

            def of(kind: int, type_: str, first: int, n: int, width: int = 1) -> np.ndarray:
                item = np.dtype(type_).itemsize * width
                f.seek(found[kind][0] + first * item)
                return np.frombuffer(f.read(n * item), type_).reshape(n, width) if width > 1 else np.frombuffer(f.read(n * item), type_)

            def lists(raw: np.ndarray) -> list[list[int]]:
                if (raw[:, 0] >= raw.shape[1]).any() or any((own[1 + own[0] :] != NOTHING).any() for own in raw):
                    raise Corrupt(f"{self.path}: a list of links")
                return [own[1 : 1 + own[0]].tolist() for own in raw]

            for first in range(part.first, part.last, 4096):
                n = min(4096, part.last - first)
                ids = of(LABELS, "<u8", first, n)
                words = of(TOMBSTONES, "u1", first // 8, (n + first % 8 + 7) // 8) if TOMBSTONES in found else np.zeros(n // 8 + 2, np.uint8)
                gone = np.unpackbits(words, bitorder="little")[first % 8 :][:n].astype(bool)
                if (ids[~gone] > (1 << 63) - 1).any():
                    raise Unsupported(f"{self.path}: ids from 2**63 on")
                flat = of(VECTORS, "<f4", first * c.dim, n * c.dim)
                columns = [pa.array(range(first, first + n), pa.int64()), pa.array(ids.astype(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * c.dim, pa.int32()), pa.array(flat)), pa.array(gone)]
                level, links = pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.list_(pa.int32())))
                if LEVELS in found:
                    m = c.graph.m
                    levels = of(LEVELS, "u1", first, n).astype(int)
                    links = [[own] for own in lists(of(L0_LINKS, "<u4", first * (1 + 2 * m), n * (1 + 2 * m)).reshape(n, -1))]
                    at = of(UPPER_INDEX, "<u8", first, n)
                    for i in np.flatnonzero(levels):
                        links[i] += lists(of(UPPER_LINKS, "<u4", int(at[i]), int(levels[i]) * (1 + m)).reshape(levels[i], -1))
                    level, links = pa.array(levels, pa.int32()), pa.array(links, pa.list_(pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([*columns, level, links], ["row_id", "id", "vector", "deleted", "level", "links"])


class IndexFileSource(DataSource):
    """``spark.read.format("indexfile").load(path)``: (row_id, id, vector, deleted, level, links)."""

    @classmethod
    def name(cls) -> str:
        return "indexfile"

    def schema(self) -> str:
        return "row_id long, id long, vector array<float>, deleted boolean, level int, links array<array<int>>"

    def reader(self, schema) -> _Reader:
        meta, found, _ = inspect(self.options["path"], self.options.get("verify", "full"))
        return _Reader(self.options["path"], meta, found)


def read_index(spark: SparkSession, path: str, verify: str = "full") -> tuple[Meta, DataFrame, DataFrame | None]:
    """(metadata, rows, graph or None) of a file; the values of rows and graph are checked too unless ``verify`` is less than full.

    Whatever the level, the layout is, and damage raises Corrupt.
    """
    from halyard.operators.graph import NODE, violations
    from halyard.operators.validation import duplicate_ids, vector_report

    spark.dataSource.register(IndexFileSource)
    meta, _, flags = inspect(path, verify)
    df = spark.read.format("indexfile").option("verify", "none").load(path)
    rows = df.select("row_id", "id", "vector", "deleted")
    graph = None
    if flags & HAS_GRAPH:
        none = [F.lit(None).cast("long").alias(c) for c in ("computed", "repaired", "unrepaired")]
        graph = df.select(F.lit(0).alias("shard"), F.col("row_id").cast("int").alias("node"), "row_id", "id", "vector", "deleted", "level", "links", *none)
        graph = graph.select(*(c.split()[0] for c in NODE.split(", ")))
    if verify == "full":
        live = rows.where("not deleted")
        if vector_report(rows, "row_id", "vector", CollectionConfig(meta.config.dim)).take(1) or duplicate_ids(live).take(1) or live.where("id < 0").take(1):
            raise Corrupt(f"{path}: a vector or an id")
        if graph is not None and violations(graph, meta.config.graph).take(1):
            raise Corrupt(f"{path}: the graph")
    return meta, rows, graph
