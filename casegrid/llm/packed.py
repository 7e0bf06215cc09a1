"""Packed rows: many small records of one shuffle key travel as one row of binary columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def rising(ids: np.ndarray) -> bytes:
    """Integers as differences, which compress well when neighbours are close."""
    return blob(np.diff(ids.astype(np.int64), prepend=np.int64(0)))


def risen(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.int64))


def short(hashes: np.ndarray) -> bytes:
    """The lower seven bytes of 64-bit hashes."""
    return np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def unshort(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(data, np.uint8).reshape(-1, 7)
    return out.view(np.uint64).reshape(-1)


def split_points(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
    return starts, np.append(starts[1:], len(keys))


def by_key(batches, key: str):
    """Yield (key, table) for each run of equal keys in batches sorted by ``key``; a run may cross batches."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        for a, b in zip(*split_points(keys), strict=True):
            if held and keys[a] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def whole_groups(batches, key: str, rows: int):
    """Tables of at least ``rows`` rows (but the last) from batches sorted by ``key``; a key's rows stay together."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if size >= rows:  # up to where the last held key ends
            keys = batch.column(key).to_numpy()
            cut = int((keys != held[-1].column(key)[-1].as_py()).argmax()) if keys[-1] != held[-1].column(key)[-1].as_py() else batch.num_rows
            held.append(batch.slice(0, cut))
            size += cut
            if cut == batch.num_rows:
                continue
            yield pa.Table.from_batches(held)
            held, size, batch = [], 0, batch.slice(cut)
        held.append(batch)
        size += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(ids.astype(np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least reachable node for each of n nodes, given links a-b."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        least = np.minimum(x, y)
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        while (label != (up := label[label])).any():
            label = up
    return label
