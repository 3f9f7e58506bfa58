"""Repeated byte strings by suffix sorting in the deep-shallow manner.

Suffixes are sorted to a depth of W bytes where they can matter. Every W-byte window is given the least-hashed of its
grams (leftmost of equals), so equal windows choose the same gram at the same offset; consecutive windows with one chosen
gram make a piece. Pieces whose gram occurs at a single place hold no repeat and are dropped; the others meet by gram, and
each task sorts the suffixes of its pieces:

- shallow: multikey quicksort by 8-byte symbols, in which only groups of equal prefix go on to the next symbol, to `SHALLOW`
  bytes;
- deep: what still agrees there is ordered by blind tries. A trie node compares all its suffixes with one representative
  leaf; a branch is known by its depth and byte alone, and recurs with a representative of its own. Sorting by (side,
  depth, byte) at each node is the trie's in-order walk.

Suffixes that agree to W bytes form a class; all but its first in (document, start) order are repeats. Pieces of the same
bytes are settled before (all but the first are repeats whole), so a passage copied into a third of all documents is sorted
once; should one gram still own more than `HOT` different pieces, they go on as single windows dealt by their own hash,
with the same result (tested with `hot=2`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import cut
from fathomline.llm.dealing import BLOB_COLUMNS, CHUNK, by_first, dealt, dealt_by, give_back, lists_of, spans, unpacked
from fathomline.llm.kernels import byte_prefix, cover, gram_hashes, mix, ranges, runs, sliding_min
from fathomline.llm.repeats import Kernel, removals

WINDOW = 100
GRAM = 32
SHALLOW = 24
HOT = 5_000
#: Bytes of a long text that are marked at a time, and suffixes that a task sorts at a time (more if one gram has more).
SEGMENT = 4 << 20
SUFFIXES = 150_000
_PLACE = 24


def symbols(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as big-endian numbers."""
    out = np.zeros(len(at), np.uint64)
    for j in range(8):
        out = out << np.uint64(8) | data[at + j].astype(np.uint64)
    return out


def deep_shallow(data: np.ndarray, at: np.ndarray, depth: int = WINDOW, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes that begin `at`, compared to `depth` bytes, and along it the class of equal ones.

    data must hold `depth` bytes after each of them."""
    n = len(at)
    order, group = np.arange(n), np.zeros(n, np.int64)
    if not n:
        return order, group
    active = np.ones(n, bool)  # places in the order whose group may still be split

    def split(places: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Sort the order at `places` by (group, key); group numbers become places of group starts. Returns the sorted keys."""
        by = np.lexsort((key, group[places]))
        order[places] = order[places][by]
        key, old = key[by], group[places]  # groups are contiguous and ascending along the order
        new = np.ones(len(places), bool)
        new[1:] = (old[1:] != old[:-1]) | (key[1:] != key[:-1])
        group[places] = places[np.flatnonzero(new)][np.cumsum(new) - 1]
        return key

    def alone() -> np.ndarray:
        edge = np.ones(n + 1, bool)
        edge[1:-1] = group[1:] != group[:-1]
        return edge[:-1] & edge[1:]

    for level in range(0, shallow, 8):
        places = np.flatnonzero(active)
        if not len(places):
            break
        split(places, symbols(data, at[order[places]] + level))
        active &= ~alone()
    view = np.lib.stride_tricks.sliding_window_view(data, depth - shallow)
    while len(places := np.flatnonzero(active)):
        rows = view[at[order[places]] + shallow]
        first = np.ones(len(places), bool)
        first[1:] = group[places][1:] != group[places][:-1]
        leaf = rows[np.flatnonzero(first)[np.cumsum(first) - 1]]
        differs = rows != leaf
        where = differs.argmax(1)
        here = np.arange(len(places))
        same = ~differs[here, where]
        byte, other = rows[here, where].astype(np.int64), leaf[here, where]
        side = where * 256 + byte
        key = np.where(same, 1 << 20, np.where(byte < other, side, (1 << 21) + (depth - where) * 256 + byte))
        done = split(places, key) == 1 << 20
        active[places[done]] = False
        active &= ~alone()
    return order, group


class Strings(Kernel):
    within = True
    density = 1 / 32

    def __init__(self, window: int = WINDOW, gram: int = GRAM, hot: int = HOT):
        if not SHALLOW < window <= 127 or gram >= window:
            raise ValueError("the window must be over the shallow depth, at most 127 and longer than a gram")
        self.window, self.gram, self.hot = window, gram, hot

    def whole(self, raw: bytes) -> tuple[int, str]:
        return len(raw), hashlib.sha256(raw).hexdigest()

    def marks(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of all texts of a block; a position code is first window * 128 + windows."""
        if len(at) > 2 or len(data) <= SEGMENT:
            return self._marks(data, at)
        parts = []
        for lo in range(0, len(data), SEGMENT):
            d, h, s = self._marks(data[lo : lo + SEGMENT + self.window - 1], np.array([0, min(SEGMENT + self.window - 1, len(data) - lo)]))
            parts.append((d, h, s + lo * 128))
        return tuple(map(np.concatenate, zip(*parts, strict=True)))

    def _marks(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        if len(data) < self.window:
            return none, none.view(np.uint64), none
        h = gram_hashes(data, self.gram)
        low = np.uint64((1 << _PLACE) - 1)
        order = h & ~low
        order |= np.arange(len(h), dtype=np.uint64)
        chosen = sliding_min(order, self.window - self.gram + 1)
        chosen &= low
        n = np.maximum(np.diff(at) - self.window + 1, 0)
        inside = cover(len(chosen), at[:-1][n > 0], (at[:-1] + n)[n > 0])
        new = inside.copy()
        new[1:] &= (chosen[1:] != chosen[:-1]) | ~inside[:-1]
        new[at[:-1][n > 0]] = True
        last = inside.copy()
        last[:-1] &= new[1:] | ~inside[1:]
        first, last = np.flatnonzero(new), np.flatnonzero(last)
        doc = np.searchsorted(at, first, "right") - 1
        return doc, h[chosen[first].astype(np.int64)], (first - at[doc]) * 128 + last - first + 1

    def earlier(self, found: DataFrame, groups: int) -> tuple[DataFrame, list[DataFrame]]:
        width = self.window

        def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[list[np.ndarray]] = []
            waiting = 0
            for b in batches:
                for z, h, s, i, u in zip(b.column("z"), b.column("h"), b.column("s"), b.column("id").to_pylist(), b.column("u").to_pylist(), strict=True):
                    h, s = h.values.to_numpy().view(np.uint64), s.values.to_numpy()
                    p = byte_prefix(np.frombuffer(zstandard.decompress(z.as_py()), np.uint8), 31)
                    ph = ranges(p, s >> 7, (s >> 7) + (s & 127) + width - 1, 31)
                    held.append([h, ph, np.full(len(s), i), s, np.full(len(s), u)])
                    waiting += len(s)
                    if waiting >= CHUNK:
                        yield from out(held)
                        held, waiting = [], 0
            if held:
                yield from out(held)
            give_back()

        def out(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            h, ph, i, s, u, copy = copies(*(np.concatenate(c) for c in zip(*held, strict=True)))
            yield dealt_by(u[copy], groups, [s[copy] >> 7, s[copy] & 127], groups)
            h, ph, i, s, u = (c[~copy] for c in (h, ph, i, s, u))
            run, first = spans(h)
            many = np.diff(np.append(first, len(h))) > 1
            known = many[run]  # other pieces of the gram are here: each goes its own way, and one record tells of the gram
            told = h[first[many]]
            none = np.full(len(told), -1)
            by = np.concatenate([np.where(known, mix(h ^ ph * np.uint64(0x9E3779B97F4A7C15)), h), told])
            yield dealt(by, groups, [np.concatenate([h, told]), np.concatenate([ph, told]), *(np.concatenate([c, none]) for c in (i, s, u)), np.concatenate([known.astype(np.int64), none])])

        def meet(table: pa.Table) -> pa.Table:
            """Copies of pieces as runs; what else shares its gram with another piece is wanted: (u, code, gram)."""
            if table.column("b")[0].as_py() >= groups:  # settled before, on the way to their texts
                return table
            h, ph, i, s, u, known = unpacked(table.column("z"), 6)
            told = np.unique(h[known < 0])
            h, ph, i, s, u, copy, known = copies(*(c[known >= 0] for c in (h, ph, i, s, u)), known[known >= 0])
            gone = dealt_by(u[copy], groups, [s[copy] >> 7, s[copy] & 127], groups)
            h, s, u, known = (c[~copy] for c in (h, s, u, known))
            run, first = spans(h)
            meets = (np.diff(np.append(first, len(h))) > 1)[run] | (known > 0) | np.isin(h.view(np.int64), told)
            return pa.Table.from_batches([gone, dealt_by(u[meets], groups, [s[meets], h[meets].view(np.int64)])])

        def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(b.num_rows):
                    raw = zstandard.decompress(b.column("z")[k].as_py())
                    s, n = b.column("s")[k].values.to_numpy(), len(b.column("s")[k].values)
                    for lo in range(0, n, 100_000):
                        own = s[lo : lo + 100_000]
                        start, size = own >> 7, own & 127
                        cutout = [raw[x : x + m + width - 1] for x, m in zip(start.tolist(), size.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([b.column("h")[k].values.slice(lo, len(own)), pa.array(cutout, pa.binary()), *(pa.array(np.full(len(own), b.column(c)[k].as_py())) for c in ("id", "u")), pa.array(start), pa.array(size)], names=["h", "piece", "id", "u", "s", "n"])

        def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hot = b.column("hot")
                yield b.drop_columns(["hot"]).filter(pc.invert(hot))
                for r in b.filter(hot).to_pylist():
                    k = np.arange(r["n"])
                    windows = [r["piece"][j : j + width] for j in k]
                    yield pa.RecordBatch.from_arrays([pa.array([hash_long(w) for w in windows], pa.int64()), pa.array(windows, pa.binary()), pa.array(np.full(len(k), r["id"])), pa.array(np.full(len(k), r["u"])), pa.array(k + r["s"]), pa.array(np.ones(len(k), np.int64))], names=["h", "piece", "id", "u", "s", "n"])

        met = cut(found.select("u", "id", "z", "s", "h").mapInArrow(pieces, BLOB_COLUMNS).groupBy("b").applyInArrow(meet, BLOB_COLUMNS))
        wanted = met.where(F.col("b") < groups).groupBy("b").applyInArrow(lists_of("u", ["s", "h"]), "u bigint, s array<bigint>, h array<bigint>")
        schema = "h bigint, piece binary, id bigint, u bigint, s bigint, n bigint"
        apart = cut(found.select("id", "u", "z").join(wanted, "u").select("id", "u", "z", "s", "h"))
        hot = cut(apart.select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("m")).where(F.col("m") > self.hot).select("h"))
        sorted_out = apart.mapInArrow(cut_out, schema)
        if not hot.isEmpty():
            sorted_out = sorted_out.join(hot.withColumn("hot", F.lit(True)), "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False))).mapInArrow(single, schema)
        own = sorted_out.repartition("h").sortWithinPartitions("h").mapInArrow(lambda batches: self._sort(batches, groups), BLOB_COLUMNS)
        return met.where(F.col("b") >= groups).unionByName(own), [met, apart, hot]

    def _sort(self, batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        waiting = 0
        for b in batches:
            held.append(b)
            waiting += b.num_rows
            if waiting * (self.window - self.gram) // 2 < SUFFIXES:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            h = rows.column("h").to_numpy()
            ends = int(np.searchsorted(h, h[-1]))  # the last gram may go on in the next batch
            held, waiting = rows.slice(ends).to_batches(), len(h) - ends
            yield from self._repeats(rows.slice(0, ends), groups)
        if held:
            yield from self._repeats(pa.Table.from_batches(held), groups)

    def _repeats(self, rows: pa.Table, groups: int) -> Iterator[pa.RecordBatch]:
        h = rows.column("h").to_numpy()
        step = max(1, SUFFIXES * 2 // (self.window - self.gram))
        lo = 0
        while lo < len(h):
            hi = min(lo + step, len(h))
            hi = max(hi if hi == len(h) else int(np.searchsorted(h, h[hi])), int(np.searchsorted(h, h[lo], "right")))
            yield self._repeats_in(rows.slice(lo, hi - lo), groups)
            lo = hi

    def _repeats_in(self, rows: pa.Table, groups: int) -> pa.RecordBatch:
        pieces = rows.column("piece").to_pylist()
        n, ids, us, starts = (rows.column(k).to_numpy() for k in ("n", "id", "u", "s"))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        begin = np.concatenate([[0], np.cumsum([len(p) for p in pieces])[:-1]]).astype(np.int64)
        own = np.repeat(np.arange(len(n)), n)
        offset = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        order, group = deep_shallow(data, begin[own] + offset, self.window)
        by = np.lexsort((us[own][order], (starts[own] + offset)[order], ids[own][order], group))
        repeat = np.ones(len(own), bool)
        repeat[order[by[np.flatnonzero(np.diff(group[by], prepend=-1))]]] = False
        edge = np.concatenate([[0], np.cumsum(n)])
        gap = np.zeros(len(own) + len(n), bool)  # one cleared place after each piece, so that runs end there
        gap[np.arange(len(own)) + own] = repeat
        first, last = runs(gap)
        piece = np.searchsorted(edge + np.arange(len(edge)), first, "right") - 1
        return dealt_by(us[piece], groups, [starts[piece] + first - (edge[piece] + piece), last - first], groups)

    def removed(self, raw: bytes, s: np.ndarray, n: np.ndarray) -> tuple[list[int], str]:
        gone = cover(len(raw), s, s + n - 1 + self.window)
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        first, last = runs(gone)
        return np.column_stack([first, last]).ravel().tolist(), hashlib.sha256(kept).hexdigest()


def copies(h: np.ndarray, ph: np.ndarray, i: np.ndarray, s: np.ndarray, u: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces in order of gram, hash, document, start and text, which of them are the same as the one before, and `more`.
    One gram and one hash (128 bits together) are the same bytes."""
    order = by_first([h, ph, i, s, u])
    h, ph, i, s, u = (c[order] for c in (h, ph, i, s, u))
    copy = np.zeros(len(h), bool)
    copy[1:] = (h[1:] == h[:-1]) & (ph[1:] == ph[:-1])
    return h, ph, i, s, u, copy, *(c[order] for c in more)


def hash_long(b: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "big", signed=True)


def repeated_strings(df: DataFrame, key: str, text: str, window: int = WINDOW) -> DataFrame:
    """key, raw, n (UTF-8 bytes), n_removed, n_spans, kept_sha256 and spans (in bytes) of each row.

    Each byte covered by a `window`-byte string that also starts earlier goes: in a document with a smaller key, or in the
    same document before. Strings may overlap and never cross documents. Null texts are empty; a null key is after all
    others; rows that share a key are one document where their texts are equal, and are taken one after the other by start
    where they differ."""
    return removals(df, key, text, Strings(window))
