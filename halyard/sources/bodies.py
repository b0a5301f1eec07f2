"""Vectors in request bodies: strict JSON, and a packed binary form."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.errors import InvalidInput

INSERT = "upsert boolean, vectors array<struct<id: bigint, vector: array<float>>>"
#: Fixed values of the packed form: four bytes, a 32-bit dimension, a 64-bit count, ids, components.
MAGIC = b"VFB1"


def json_vectors(bodies: DataFrame, column: str = "body") -> DataFrame:
    """(upsert, id, vector) from JSON insert requests; malformed text or unknown keys are an error."""
    extra = bodies.where(F.expr(f"size(array_except(json_object_keys({column}), array('upsert', 'vectors'))) > 0 or json_object_keys({column}) is null"))
    if extra.take(1):
        raise InvalidInput("a request has upsert and vectors only")
    parsed = bodies.select(F.from_json(column, INSERT, {"mode": "FAILFAST"}).alias("b"))
    return parsed.select(F.coalesce("b.upsert", F.lit(False)).alias("upsert"), F.explode("b.vectors").alias("v")).select("upsert", "v.id", "v.vector")


def unpack(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of a packed body, which must have exactly the length that its head says."""
    if len(body) < 16 or body[:4] != MAGIC:
        raise InvalidInput("not a packed body")
    dim, n = struct.unpack("<IQ", body[4:16])
    if dim == 0 or len(body) != 16 + n * (8 + 4 * dim):
        raise InvalidInput("length of a packed body")
    ids = np.frombuffer(body, "<u8", n, 16)
    if (ids > (1 << 63) - 1).any():
        raise InvalidInput(f"id {int(ids.max())} is reserved or above {(1 << 63) - 1}")
    return ids, np.frombuffer(body, "<f4", n * dim, 16 + 8 * n).reshape(n, dim)


def pack(ids: np.ndarray, rows: np.ndarray) -> bytes:
    return MAGIC + struct.pack("<IQ", rows.shape[1], len(rows)) + ids.astype("<u8").tobytes() + rows.astype("<f4").tobytes()


def packed_vectors(bodies: DataFrame, column: str = "content") -> DataFrame:
    """(id, vector) from packed bodies, such as files read as ``binaryFile``."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0).to_pylist():
                ids, rows = unpack(body)
                yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(list(rows), pa.list_(pa.float32()))], ["id", "vector"])

    return bodies.select(column).mapInArrow(decode, "id long, vector array<float>")
