"""The same arithmetic over blocks of rows in numpy: one float32 rounding a step, dimensions in order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A column of float lists as an (n, dim) float32 matrix."""
    flat = column.flatten() if len(column) else pa.array([], pa.float32())
    return np.asarray(flat.to_numpy(zero_copy_only=False), np.float32).reshape(len(column), dim)


def norm2(a: np.ndarray) -> np.ndarray:
    s = np.zeros(len(a), np.float32)
    for j in range(a.shape[1]):
        s += a[:, j] * a[:, j]
    return s


def inverse_norm(a: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return (1.0 / np.sqrt(norm2(a).astype(np.float64))).astype(np.float32)


#: Queries and rows of a tile, small enough for a core's cache.
TILE = (64, 1024)


def _sum(mode: str, asked: np.ndarray, columns: np.ndarray, out: np.ndarray) -> None:
    """Sums over dimensions in order, of squared differences or of products, into ``out``."""
    total, term = np.zeros(out.shape, np.float32), np.empty(out.shape, np.float32)
    for q, v in zip(asked, columns):
        if mode == "l2":
            np.subtract(q[:, None], v, out=term)
            np.multiply(term, term, out=term)
        else:
            np.multiply(q[:, None], v, out=term)
        total += term
    out[:] = total


def scores(mode: str, queries: np.ndarray, inverse: np.ndarray, rows: np.ndarray, strict: bool = True) -> np.ndarray:
    """(queries, rows) distances. Without ``strict`` sums are left to the linear algebra library."""
    if strict and len(queries) == 1 and len(rows) <= TILE[1]:
        d = rows - queries if mode == "l2" else rows * queries
        if mode == "l2":
            d *= d
        out = np.add.accumulate(d, axis=1)[None, :, -1] + np.float32(0)  # running sums keep the order
        if mode == "l2":
            return out
    elif strict:
        out = np.empty((len(queries), len(rows)), np.float32)
        columns, asked = np.ascontiguousarray(rows.T), np.ascontiguousarray(queries.T)
        for i in range(0, len(queries), TILE[0]):
            for j in range(0, len(rows), TILE[1]):
                _sum(mode, asked[:, i : i + TILE[0]], columns[:, j : j + TILE[1]], out[i : i + TILE[0], j : j + TILE[1]])
        if mode == "l2":
            return out
    else:
        out = queries @ rows.T
    if mode == "l2":
        return np.maximum(norm2(queries)[:, None] + norm2(rows)[None, :] - 2 * out, 0)
    if mode == "ip":
        return -out + np.float32(0)
    out = out * inverse[:, None]
    if mode == "cosine_unit":
        return np.maximum(np.float32(0), np.float32(1) - out)
    if mode == "l2_unit":
        return np.maximum(np.float32(0), np.float32(2) - np.float32(2) * out)
    return -out + np.float32(0)


def pairs(mode: str, queries: np.ndarray, inverse: np.ndarray, rows: np.ndarray, strict: bool = True) -> np.ndarray:
    """Distance of each query to the row beside it, added in order if ``strict``."""
    term = rows - queries if mode == "l2" else rows * queries
    if mode == "l2":
        term *= term
    out = np.add.accumulate(term, axis=1)[:, -1] + np.float32(0) if strict else term.sum(1)
    if mode == "l2":
        return out
    if mode == "ip":
        return -out + np.float32(0)
    out = out * inverse
    if mode == "cosine_unit":
        return np.maximum(np.float32(0), np.float32(1) - out)
    if mode == "l2_unit":
        return np.maximum(np.float32(0), np.float32(2) - np.float32(2) * out)
    return -out + np.float32(0)


def smallest(distances: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) places of the ``k`` smallest of each row of ``distances``, ties by ``order``."""
    n = distances.shape[1]
    if n > k:
        limit = np.partition(distances, k - 1, axis=1)[:, k - 1]
        r, c = np.nonzero(distances <= limit[:, None])
    else:
        r, c = np.nonzero(np.ones_like(distances, bool))
    at = np.lexsort((order[c], distances[r, c], r))
    r, c = r[at], c[at]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    return r[place < k], c[place < k]
