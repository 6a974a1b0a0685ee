"""Numpy columns packed into one binary value, so that a shuffle moves few rows and compresses them well."""

from __future__ import annotations

import numpy as np


def pack(*columns: np.ndarray) -> bytes:
    """Columns of any numeric types and lengths as bytes. The bytes of each column are stored plane by
    plane (all lowest bytes, then all second bytes ...): sorted or small numbers give runs that Spark's
    shuffle compression removes."""
    head = [len(columns)]
    body = []
    for c in columns:
        c = np.ascontiguousarray(c)
        head += [ord(c.dtype.char), len(c)]
        body.append(c.view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes())
    return np.array(head, dtype=np.int64).tobytes() + b"".join(body)


def unpack(value: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(value, np.int64, 1)[0])
    head = np.frombuffer(value, np.int64, 2 * n, 8)
    at, out = 8 + 16 * n, []
    for code, length in head.reshape(n, 2):
        kind = np.dtype(chr(code))
        size = int(length) * kind.itemsize
        planes = np.frombuffer(value, np.uint8, size, at).reshape(kind.itemsize, int(length))
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(int(length)))
        at += size
    return out


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Borders of runs of equal values in sorted keys: [0, ..., len]."""
    if not len(sorted_keys):
        return np.zeros(1, dtype=np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]])
