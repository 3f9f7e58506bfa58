"""Repeated passages by difference-cover anchors.

D is a difference cover of the integers modulo a period v: every residue is a difference of two of its members. Stretches
of W-v+1 words are hashed at positions in D modulo v only. Where W words occur at i in one document and at j in another,
some shift below v makes both i and j cover positions, so the two places share an aligned anchor inside the passage. From
each shared anchor the comparison extends to all W-word windows around it, which are compared whole (two independent
64-bit hashes over words, each word two independent 64-bit hashes over bytes); a window is removed when the same one starts
in a document with a smaller id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.dealing import BLOB_COLUMNS, CHUNK, by_first, dealt, dealt_by, give_back, unpacked
from fathomline.llm.kernels import byte_prefix, cover, prefix, ranges, runs, words
from fathomline.llm.repeats import Kernel, removals

WINDOW = 50
PERIOD = 31
#: A perfect difference set modulo 31 (fixed values).
COVER = (0, 1, 3, 8, 12, 18)


def is_cover(members: tuple[int, ...], period: int) -> bool:
    return {(a - b) % period for a in members for b in members} == set(range(period))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    return ranges(byte_prefix(data, seed), starts, ends, seed)


class Passages(Kernel):
    within = False

    def __init__(self, window: int = WINDOW, period: int = PERIOD, members: tuple[int, ...] = COVER):
        if not is_cover(members, period) or window < period:
            raise ValueError("not a difference cover, or a period longer than the window")
        self.window, self.period, self.members = window, period, members
        self.anchor = window - period + 1
        self.density = len(members) / period

    def whole(self, raw: bytes) -> tuple[int, str]:
        w = raw.split()
        return len(w), hashlib.sha256(b" ".join(w)).hexdigest()

    def marks(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, ends, of = words(data, at)
        n = np.diff(of)
        doc = np.repeat(np.arange(len(n)), n)
        position = np.arange(len(starts)) - of[doc]
        due = np.zeros(self.period, bool)
        due[list(self.members)] = True
        k = np.flatnonzero(due[position % self.period] & (position + self.anchor <= n[doc]) & (n[doc] >= self.window))
        h = ranges(prefix(word_hashes(data, starts, ends, 11), 12), k, k + self.anchor, 12) if len(k) else np.zeros(0, np.uint64)
        return doc[k], h, position[k]

    def windows(self, raw: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the windows around shared anchors, and their two hashes."""
        starts, ends, _ = words(raw, np.array([0, len(raw)]))
        n = len(starts) - self.window + 1
        flags = cover(max(n, 0), np.maximum(anchors - self.window + self.anchor, 0), np.minimum(anchors + 1, n)) if n > 0 else np.zeros(0, bool)
        s = np.flatnonzero(flags)
        return s, *(ranges(prefix(word_hashes(raw, starts, ends, a), b), s, s + self.window, b) for a, b in ((21, 22), (23, 24)))

    def earlier(self, found: DataFrame, groups: int) -> tuple[DataFrame, list[DataFrame]]:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[list[np.ndarray]] = []
            waiting = 0
            for b in batches:
                for z, marks, i, u in zip(b.column("z"), b.column("s"), b.column("id").to_pylist(), b.column("u").to_pylist(), strict=True):
                    s, x, y = self.windows(np.frombuffer(zstandard.decompress(z.as_py()), np.uint8), marks.values.to_numpy())
                    held.append([x, y, np.full(len(s), i), np.full(len(s), u), s])
                    waiting += len(s)
                    if waiting >= CHUNK:
                        yield from out(held)
                        held, waiting = [], 0
            if held:
                yield from out(held)
            give_back()

        def out(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            x, y, i, u, s, later = not_first(*(np.concatenate(c) for c in zip(*held, strict=True)))
            yield runs_of(u[later], s[later], groups)
            yield dealt(x[~later], groups, [c[~later] for c in (x, y, i, u, s)])

        def meet(table: pa.Table) -> pa.Table:
            if table.column("b")[0].as_py() >= groups:  # settled before, on the way to their texts
                return table
            x, y, i, u, s = unpacked(table.column("z"), 5)
            _, _, _, u, s, later = not_first(x.view(np.uint64), y.view(np.uint64), i, u, s)
            return pa.Table.from_batches([runs_of(u[later], s[later], groups)])

        return found.select("u", "id", "z", "s").mapInArrow(each, BLOB_COLUMNS).groupBy("b").applyInArrow(meet, BLOB_COLUMNS), []

    def removed(self, raw: bytes, s: np.ndarray, n: np.ndarray) -> tuple[list[int], str]:
        w = raw.split()
        gone = cover(len(w), s, s + n - 1 + self.window)
        first, last = runs(gone)
        kept = b" ".join(x for x, g in zip(w, gone.tolist(), strict=True) if not g)
        return np.column_stack([first, last]).ravel().tolist(), hashlib.sha256(kept).hexdigest()


def not_first(x: np.ndarray, y: np.ndarray, i: np.ndarray, u: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, ...]:
    """The windows (hashes x and y, document id i, text u, start s) in order of x, y, i, and which of them start in a
    document with a smaller id too."""
    order = by_first([x, y, i])
    x, y, i, u, s = (c[order] for c in (x, y, i, u, s))
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    least = i[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return x, y, i, u, s, i > least


def runs_of(u: np.ndarray, s: np.ndarray, groups: int) -> pa.RecordBatch:
    """Windows (u, s) as blobs of runs (u, s, n)."""
    order = np.lexsort((s, u))
    u, s = u[order], s[order]
    new = np.ones(len(u), bool)
    new[1:] = (u[1:] != u[:-1]) | (s[1:] != s[:-1] + 1)
    first = np.flatnonzero(new)
    return dealt_by(u[first], groups, [s[first], np.diff(np.append(first, len(u)))], groups)


def repeated_passages(df: DataFrame, key: str, text: str, window: int = WINDOW) -> DataFrame:
    """key, raw, n (words), n_removed, n_spans, kept_sha256 and spans (in words) of each row.

    Each word covered by a window of `window` words whose word sequence also starts in a document with a smaller key goes.
    Words are the runs of bytes other than 9 to 13 and 32. Null and empty texts have no words; a null key is after all
    others; rows that share a key are not earlier than one another, and repeated rows fare alike."""
    return removals(df, key, text, Passages(window))


def without_repeats(df: DataFrame, key: str, text: str, window: int = WINDOW) -> DataFrame:
    """The rows of `df`, texts with repeats as their kept words joined by a space and the others as they are."""
    found = repeated_passages(df, key, text, window).where("n_removed > 0").select(F.col(key).alias("__key"), F.col("raw").alias("__raw"), F.col("spans").alias("__spans")).dropDuplicates(["__key", "__raw"])
    joined = df.withColumn("__raw", F.xxhash64(F.col(text))).join(found.withColumnRenamed("__raw", "__raw2"), F.col(key).eqNullSafe(F.col("__key")) & (F.col("__raw") == F.col("__raw2")), "left")

    @F.arrow_udf("string")
    def keep(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            if s:
                w, at, parts = t.encode().split(), 0, []
                for a, b in zip(s[::2], s[1::2], strict=True):
                    parts += w[at:a]
                    at = b
                t = b" ".join(parts + w[at:]).decode()
            out.append(t)
        return pa.array(out, pa.string())

    return joined.withColumn(text, keep(F.col(text), F.col("__spans"))).select(*df.columns)

