"""Vectors between Arrow batches and numpy, without a Python object per row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def ragged(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, float32 values) of a list column; a null list has length 0, a null element is NaN."""
    off = np.asarray(col.offsets).astype(np.int64)
    val = col.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    n = np.diff(off)
    if col.null_count:
        n = np.where(np.asarray(col.is_valid()), n, 0)
    return off[:-1], n, val


def usable_by_dim(col: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, row numbers, float32 matrix) for each dimension, of the usable rows only.

    Usable: not null, not empty, all components finite, norm above 0.
    """
    start, n, val = ragged(col)
    out = []
    for d in np.unique(n[n > 0]):
        rows = np.flatnonzero(n == d)
        m = val[start[rows][:, None] + np.arange(d)]
        sq = np.einsum("ij,ij->i", m, m, dtype=np.float64)
        ok = np.isfinite(sq) & (sq > 0)
        out.append((int(d), rows[ok], m[ok]))
    return out


def unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, norms taken in double."""
    return (m / np.sqrt(np.einsum("ij,ij->i", m, m, dtype=np.float64))[:, None]).astype(np.float32)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine of two float32 matrices in double; equal rows give equal results wherever they stand."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def row_bytes(m: np.ndarray) -> pa.Array:
    """A float32 matrix as a binary column of little-endian rows."""
    m = np.ascontiguousarray(m, dtype="<f4")
    n, w = m.shape[0], m.shape[1] * 4
    if n * w >= 2**31:
        raise ValueError("batch too large for one Arrow column")
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * w, w, dtype=np.int32)), pa.py_buffer(m)]) if n else pa.array([], pa.binary())


def bytes_rows(col: pa.Array, width: int) -> np.ndarray:
    """The matrix of a binary column whose values all have `width` float32 components."""
    if len(col) == 0:
        return np.empty((0, width), np.float32)
    buf = col.buffers()[2]
    off = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, col.offset * 4)
    return np.frombuffer(buf, "<f4", len(col) * width, int(off[0])).reshape(len(col), width)


def row_hash(m: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each float32 row; -0.0 counts as 0.0."""
    bits = np.ascontiguousarray(m + np.float32(0)).view(np.uint32)
    odd = np.random.default_rng(20).integers(1, 2**63, bits.shape[1], dtype=np.uint64) | np.uint64(1)
    h = np.zeros(len(m), np.uint64)
    for j in range(bits.shape[1]):
        h = (h ^ (bits[:, j] * odd[j])) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def copy_classes(m: np.ndarray, key: np.ndarray | None = None) -> np.ndarray:
    """For each row the smallest row number among the rows equal to it (and of equal key)."""
    h = row_hash(m)
    if key is not None:
        h = h ^ (key.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, first, inv = np.unique(h, return_index=True, return_inverse=True)
    head = first[inv]
    same = (m == m[head]).all(1) & (True if key is None else key == key[head])
    if not same.all():  # two different rows with one hash: they stay apart
        head = np.where(same, head, np.arange(len(m)))
    return head
