"""Numpy arrays packed into binary columns, so that a shuffle moves few large rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from blockalloc.session import shuffle_partitions


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length (2-D ones by rows) as one byte string."""
    return np.int64(len(arrays[0])).tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    """The arrays again; a kind is a dtype, or (dtype, width) for a 2-D array."""
    n, at, out = int(np.frombuffer(blob, np.int64, 1)[0]), 8, []
    for kind in kinds:
        kind, width = kind if isinstance(kind, tuple) else (kind, 1)
        a = np.frombuffer(blob, kind, n * width, at)
        at += a.nbytes
        out.append(a.reshape(n, width) if width > 1 else a)
    return out


def unpack_all(blobs, *kinds) -> list[np.ndarray]:
    """The arrays of many byte strings, one after another."""
    parts = [unpack(b, *kinds) for b in blobs]
    if not parts:
        return [np.zeros((0, k[1]) if isinstance(k, tuple) else 0, k[0] if isinstance(k, tuple) else k) for k in kinds]
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def by_bucket(bucket: np.ndarray, *arrays: np.ndarray):
    """(bucket, packed arrays) for each bucket that has rows; order inside a bucket is kept."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    arrays = [a[order] for a in arrays]
    for lo, hi in zip(cuts, np.r_[cuts[1:], len(bucket)], strict=True):
        yield int(bucket[lo]), pack(*(a[lo:hi] for a in arrays))


def binary_parts(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column without Python objects; null counts as empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = a.chunk(0) if a.num_chunks else pa.array([], pa.large_binary())
    a = a.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8) if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of 0..n-1 over links u-v, by hooking and pointer jumping."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        live = a != b
        if not live.any():
            return label
        u, v, a, b = u[live], v[live], a[live], b[live]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def block_count(texts: DataFrame, block_bytes: int) -> int:
    """Into how many blocks of about ``block_bytes`` the column ``text`` is dealt; at least one a shuffle partition."""
    held = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(shuffle_partitions(texts.sparkSession), -(-held // block_bytes))


def by_number(rows: DataFrame, key: str) -> GroupedData:
    """Groups by an int column of numbers that are dealt in turn, one after another, to the shuffle partitions.

    Blocks and owners are about as many as partitions and alike in size; by hash, several
    of them would share a partition by chance while others stay empty. Cogroups of two
    such sides stay where they are.
    """
    return rows.repartitionById(shuffle_partitions(rows.sparkSession), key).groupBy(key)
