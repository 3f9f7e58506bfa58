"""Packed shuffles: many small records as few compressed blobs, dealt to groups by hash.

A task gathers up to `CHUNK` records, settles among them what it can, and sends on the rest as one blob a group: columns of
64-bit numbers in order of their hash, byte by byte, so that what neighbours share costs next to nothing. Whatever a key's
share of all records, a task sends on at most one or a few of them a chunk, so no group grows with a hot key.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard

from fathomline.llm.kernels import mix

#: Records that a task settles at a time.
CHUNK = 1 << 19
#: Records that meet in one group: the least to be worth it, and the most that a worker should hold.
GROUP = (1 << 18, 1 << 22)
#: Groups: the least to keep a cluster busy, and how many there are before groups grow.
GROUPS = (32, 4096)
BLOBS = pa.schema([("b", pa.int64()), ("z", pa.binary())])
BLOB_COLUMNS = "b bigint, z binary"


def groups_for(records: float) -> int:
    """Groups for about that many records: enough that one fits a worker, however many records there are."""
    size = min(max(records / GROUPS[1], GROUP[0]), GROUP[1])
    return max(GROUPS[0], int(records / size))


def give_back() -> None:
    """Return freed memory to the system: workers stay for other tasks, and idle ones should hold little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def giving_back(each: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same function of a group's table; what it freed is returned after each group."""

    def then(table: pa.Table) -> pa.Table:
        out = each(table)
        give_back()
        return out

    return then


def packed(columns: list[np.ndarray]) -> bytes:
    raw = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpacked(blobs: pa.ChunkedArray, columns: int) -> list[np.ndarray]:
    parts = [np.frombuffer(zstandard.decompress(z.as_py()), np.uint8).reshape(columns, 8, -1).transpose(0, 2, 1) for z in blobs]
    whole = np.ascontiguousarray(np.concatenate(parts, axis=1)) if parts else np.zeros((columns, 0, 8), np.uint8)
    return list(whole.view(np.int64)[..., 0])


def dealt(by: np.ndarray, groups: int, columns: list[np.ndarray], base: int = 0) -> pa.RecordBatch:
    """One row a group: its number from `base` on, and the records whose hash `by` falls to it."""
    order = np.argsort(by, kind="stable")
    group = (by[order] >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)
    first = spans(group)[1]
    edges = np.append(first, len(group))
    columns = [np.ascontiguousarray(c[order]).view(np.int64) for c in columns]
    blobs = [packed([c[x:y] for c in columns]) for x, y in zip(edges, edges[1:], strict=False)]
    return pa.RecordBatch.from_arrays([pa.array(group[first].astype(np.int64) + base), pa.array(blobs, pa.binary())], schema=BLOBS)


def dealt_by(number: np.ndarray, groups: int, columns: list[np.ndarray], base: int = 0) -> pa.RecordBatch:
    """The same for records of a numbered thing, all of which meet."""
    return dealt(mix(np.ascontiguousarray(number).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), groups, [number, *columns], base)


def lists_of(name: str, names: list[str]):
    """For groups of `dealt_by`: one row a number, and its distinct records' other columns as lists."""

    def each(table: pa.Table) -> pa.Table:
        columns = unpacked(table.column("z"), 1 + len(names))
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        new = np.ones(len(order), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        number, *rest = (c[new] for c in columns)
        first = spans(number)[1]
        offsets = pa.array(np.append(first, len(number)).astype(np.int32))
        return pa.table([pa.array(number[first]), *(pa.ListArray.from_arrays(offsets, pa.array(c)) for c in rest)], names=[name, *names])

    return each


def spans(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted values: the number of its run for each, and where the runs begin."""
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    return np.cumsum(new) - 1, np.flatnonzero(new)


def by_first(keys: list[np.ndarray]) -> np.ndarray:
    """The order by all keys, the first being a hash: only where it recurs are the others looked at."""
    order = np.argsort(keys[0], kind="stable")
    h = keys[0][order]
    again = np.zeros(len(h) + 1, bool)
    again[1:-1] = h[1:] == h[:-1]
    many = np.flatnonzero(again[:-1] | again[1:])
    if len(many):
        own = order[many]
        order[many] = own[np.lexsort([k[own] for k in reversed(keys)])]
    return order
