"""Packed little-endian float32 blobs to float arrays and back, on Arrow buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BinaryType, FloatType


@arrow_udf(ArrayType(FloatType()))
def decode_blob(col: pa.Array) -> pa.Array:
    """Null for a null, empty or malformed blob (length not a multiple of 4)."""
    size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    good = (size > 0) & (size % 4 == 0)
    if not good.any():
        return pa.nulls(len(col), pa.list_(pa.float32()))
    kept = pa.concat_arrays([col.filter(pa.array(good)).cast(pa.binary())])
    off = np.frombuffer(kept.buffers()[1], np.int32, len(kept) + 1, kept.offset * 4)
    values = np.frombuffer(kept.buffers()[2], "<f4", (int(off[-1]) - int(off[0])) // 4, int(off[0]))
    ends = np.append(0, np.cumsum(np.where(good, size, 0) // 4)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=pa.array(~good))


@arrow_udf(BinaryType())
def encode_vector(col: pa.Array) -> pa.Array:
    """Null for a null vector; null components become NaN."""
    n = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.ascontiguousarray(col.flatten().to_numpy(zero_copy_only=False), "<f4")  # without what lies behind null lists
    ends = np.append(0, np.cumsum(n * 4))
    if ends[-1] >= 2**31:
        raise ValueError("batch too large for one Arrow column")
    out = pa.Array.from_buffers(pa.binary(), len(col), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)])
    return pc.if_else(col.is_valid(), out, pa.scalar(None, pa.binary())) if col.null_count else out
