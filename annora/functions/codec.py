"""Vectors and neighbour lists as little-endian blobs, for exchange with stores that keep them so; whole Arrow buffers at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F


def _packer(kind: str) -> Callable:
    size = np.dtype(kind).itemsize

    @F.arrow_udf("binary")
    def pack(lists: pa.Array) -> pa.Array:
        counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
        flat = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), kind)
        ends = (np.concatenate([[0], np.cumsum(counts)]) * size).astype(np.int64)
        whole = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
        return pc.if_else(lists.is_valid(), whole, pa.scalar(None, pa.large_binary())).cast(pa.binary())

    return pack


def _unpacker(kind: str, returns: str) -> Callable:
    """Null for null and for blobs of another length than so many whole numbers."""
    size = np.dtype(kind).itemsize

    @F.arrow_udf(returns)
    def unpack(blobs: pa.Array) -> pa.Array:
        length = np.asarray(pc.fill_null(pc.binary_length(blobs), -1))
        fine = (length >= 0) & (length % size == 0)
        kept = blobs.filter(pa.array(fine)).cast(pa.binary())
        ends = np.frombuffer(kept.buffers()[1], np.int32)[kept.offset : kept.offset + len(kept) + 1] if len(kept) else np.zeros(1, np.int32)
        flat = np.frombuffer(kept.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(kind)
        starts = np.concatenate([[0], np.cumsum(np.where(fine, length // size, 0))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(starts), pa.array(flat), mask=pa.array(~fine))

    return unpack


def pack_floats(column):
    """array<float> as 4 bytes each."""
    return _packer("<f4")(column)


def unpack_floats(column):
    return _unpacker("<f4", "array<float>")(column)


def pack_longs(column):
    """array<long> as 8 bytes each."""
    return _packer("<i8")(column)


def unpack_longs(column):
    return _unpacker("<i8", "array<long>")(column)
