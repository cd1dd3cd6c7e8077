"""Numeric records through a shuffle: packed per target part instead of row by row.

A map task splits its arrays by a key's part and writes one row of packed bytes
for each part; Spark shuffles these rows, and a reduce task unpacks all its rows
into arrays again.  Sorting and grouping are then numpy's, on a partition's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame


def parts_for(df: DataFrame) -> int:
    """Parts of an exchange: the session's shuffle partitions, or twice the input's if those are more."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * df.rdd.getNumPartitions())


def pack(columns: list[np.ndarray]) -> bytes:
    """Arrays of 64-bit numbers of one length as byte planes, without planes that are all zero at the top."""
    n = len(columns[0])
    out = [np.array([n, len(columns)], "<u8").tobytes()]
    for c in columns:
        u = np.ascontiguousarray(c).view("<u8")
        k = (int(u.max()).bit_length() + 7) // 8 if n else 0
        out.append(bytes([k]))
        out.append(np.ascontiguousarray(u.view(np.uint8).reshape(n, 8)[:, :k].T).tobytes())
    return b"".join(out)


def unpack(data) -> list[np.ndarray]:
    """The arrays of :func:`pack` as unsigned 64-bit numbers."""
    raw = np.frombuffer(data, np.uint8)
    n, count = (int(x) for x in raw[:16].view("<u8"))
    at, out = 16, []
    for _ in range(count):
        k = int(raw[at])
        u = np.zeros((n, 8), np.uint8)
        u[:, :k] = raw[at + 1:at + 1 + n * k].reshape(k, n).T
        out.append(u.reshape(-1).view("<u8"))
        at += 1 + n * k
    return out


def unpack_all(blobs: list) -> list[np.ndarray] | None:
    """The arrays of many rows end to end; None without rows."""
    got = [unpack(b) for b in blobs]
    return [np.concatenate(c) for c in zip(*got, strict=True)] if got else None


def by_part(key: np.ndarray, parts: int, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """(part, packed columns) for every part that has records; order within a part stays."""
    part = (key % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        if edges[p] < edges[p + 1]:
            at = order[edges[p]:edges[p + 1]]
            yield p, pack([c[at] for c in columns])


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start in sorted arrays."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)
