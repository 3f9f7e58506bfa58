"""Benchmark decontamination by spaced seeds.

A seed mask keeps some of a few consecutive token positions and ignores the others. Each benchmark item's seeds are hashed
under each mask and joined with those of the documents; a substituted word under an ignored position doesn't hide a
passage. Each hit fixes a diagonal (document position minus item position), on which the item is laid against the document
and compared word by word; all equal words on it count. Diagonals of one item add up, so that an inserted or dropped word
splits a passage and doesn't lose it. An item is in a document if at least `SIMILAR` of its words are matched.

With the masks here no substitution of a fifth of the words of an item of up to 20 hides it (checked by enumeration in the
tests); longer ones have longer runs. Items of fewer than four words are sought as they are.

The benchmark's hashes go to every task if its text is at most `MOST_BYTES`; otherwise they are joined by shuffle, with the
same result (tested with `most_bytes=0`). Documents are read once and not moved in the first case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import blocks, cut, text_block
from fathomline.llm.kernels import byte_prefix, mix, ranges, words

#: Token positions used (1) and ignored (0).
MASKS = ("1111", "11011", "11101", "10111")
SIMILAR = 0.8
#: Benchmark text up to this goes to every task; its hashes take about ten times as much.
MOST_BYTES = 8 << 20
_FILTER_BITS = 24

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and for the Latin letters U+00C0 to U+00DE."""
    out = data + np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8)
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    after = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    out[after] += 32
    return out


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (letters, digits and all non-ASCII characters) and where each text's begin."""
    low = folded(data)
    starts, ends, of = words(low, at, ~_WORD)
    return (ranges(byte_prefix(low, 11), starts, ends, 11) if len(starts) else np.zeros(0, np.uint64)), of


def seeds(th: np.ndarray, of: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the mask's seeds inside texts, and their hashes."""
    n = len(th) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.full(n, int(mask, 2), np.uint64)
    for j, used in enumerate(mask):
        if used == "1":
            h = h * np.uint64(0x9E3779B97F4A7C15) + th[j : j + n]
    fits = np.ones(n + len(mask), bool)
    for edge in range(1, len(mask)):
        before = of[1:-1] - edge
        fits[before[before >= 0]] = False
    at = np.flatnonzero(fits[:n])
    return at, mix(h[at])


def masks_of(n: int, masks: tuple[str, ...]) -> list[str]:
    """The masks for an item of n words."""
    return [m for m in masks if len(m) <= n] or ["1" * n] * (n > 0)


def matched(th: np.ndarray, item: np.ndarray, diagonals: np.ndarray) -> float:
    """The share of the item's words matched on the given diagonals (sorted) of one document: all equal words of the
    diagonals of one passage, which are at most a fifth of the item's words apart, and the best-scoring stretches of others.
    Far diagonals don't add single words, else a long document's chance hits would add up to any item."""

    def laid(d: int) -> tuple[int, np.ndarray]:
        lo, hi = max(0, -d), min(len(item), len(th) - d)
        return lo, th[lo + d : hi + d] == item[lo:hi]

    got = np.zeros(len(item), bool)
    for d in diagonals.tolist():
        lo, same = laid(d)
        score = np.concatenate([[0], np.cumsum(np.where(same, 1, -1))])
        least = np.minimum.accumulate(score)
        end = int((score - least).argmax())
        begin = int(score[: end + 1].argmin())
        got[lo + begin : lo + end] |= same[begin:end]
    most, first = 0, 0
    inside = np.zeros(len(item), np.int32)
    for d in diagonals.tolist():
        lo, same = laid(d)
        inside[lo : lo + len(same)] += same
        while d - diagonals[first] > len(item) // 5:
            lo, same = laid(int(diagonals[first]))
            inside[lo : lo + len(same)] -= same
            first += 1
        most = max(most, int(np.count_nonzero(got | (inside > 0))))
    return most / len(item)


class Index:
    """The benchmark's seeds, sorted by hash, behind a bitmap."""

    def __init__(self, ids: list[int], texts: list[str], masks: tuple[str, ...]):
        th, of = tokens(*text_block(pa.array(texts, pa.string())))
        self.ids, self.items = ids, [th[a:b] for a, b in zip(of, of[1:], strict=False)]
        found: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for i, item in enumerate(self.items):
            for m in masks_of(len(item), masks):
                at, h = seeds(item, np.array([0, len(item)]), m)
                found.setdefault(m, []).append((h, np.full(len(at), i), at))
        self.masks = list(found)
        h, i, at = (np.concatenate([x[k] for v in found.values() for x in v]) if found else np.zeros(0, np.int64) for k in range(3))
        order = np.argsort(h, kind="stable")
        self.h, self.item, self.at = h[order].astype(np.uint64), i[order], at[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.h >> np.uint64(64 - _FILTER_BITS)] = True

    def hits(self, th: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Distinct (document, item, diagonal) rows of a block."""
        out = [np.zeros((0, 3), np.int64)]
        for m in self.masks:
            at, h = seeds(th, of, m)
            maybe = np.flatnonzero(self.filter[h >> np.uint64(64 - _FILTER_BITS)])
            at, h = at[maybe], h[maybe]
            lo, hi = np.searchsorted(self.h, h, "left"), np.searchsorted(self.h, h, "right")
            n = hi - lo
            j = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            doc = np.searchsorted(of, np.repeat(at, n), "right") - 1
            out.append(np.column_stack([doc, self.item[j], np.repeat(at, n) - of[doc] - self.at[j]]))
        return np.unique(np.concatenate(out), axis=0)


RESULT = "contaminated boolean, item_ids array<bigint>, overlaps array<double>"


def _judged(found: dict[int, float], similar: float) -> tuple[bool, list[int], list[float]]:
    over = sorted((i, s) for i, s in found.items() if s >= similar)
    return bool(over), [i for i, _ in over], [s for _, s in over]


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", masks: tuple[str, ...] = MASKS, similar: float = SIMILAR, most_bytes: int = MOST_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns `carry`, contaminated, item_ids and overlaps (the share of each item found, `similar` or more) of each document.

    Null and empty texts and items without a word match nothing; items without an id are left out; repeated rows are judged
    each; items of equal text are all named. `carry` must not name the result's own columns. A text of any length is one row
    of one task."""
    if {"contaminated", "item_ids", "overlaps"} & {key, *carry}:
        raise ValueError("a carried column has the name of a result")
    items = benchmark.where(F.col(item).isNotNull() & F.col("text").isNotNull()).select(F.col(item).cast("long").alias("item"), F.col("text").alias("item_text"))
    size = items.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    if size > most_bytes:
        return _joined(docs, items, key, text, masks, similar, carry)
    rows = items.collect()
    index = docs.sparkSession.sparkContext.broadcast(Index([r.item for r in rows], [r.item_text for r in rows], masks))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = index.value
        for batch in batches:
            for b in blocks(batch, text):
                th, of = tokens(*text_block(b.column(text)))
                found: list[dict[int, float]] = [{} for _ in range(b.num_rows)]
                hits = ix.hits(th, of)
                edges = [*np.flatnonzero(np.any(np.diff(hits[:, :2], axis=0, prepend=-1) != 0, axis=1)), len(hits)]
                for lo, hi in zip(edges, edges[1:], strict=False):
                    d, i = hits[lo, 0], hits[lo, 1]
                    share = matched(th[of[d] : of[d + 1]], ix.items[i], hits[lo:hi, 2])
                    found[d][ix.ids[i]] = max(share, found[d].get(ix.ids[i], 0.0))
                out = [_judged(f, similar) for f in found]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array([o[0] for o in out], pa.bool_()), pa.array([o[1] for o in out], pa.list_(pa.int64())), pa.array([o[2] for o in out], pa.list_(pa.float64()))], names=[*kept, "contaminated", "item_ids", "overlaps"])

    kept = list(dict.fromkeys([key, *carry]))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(each, f"{kinds}, {RESULT}")


def _joined(docs: DataFrame, items: DataFrame, key: str, text: str, masks: tuple[str, ...], similar: float, carry: tuple[str, ...]) -> DataFrame:
    """The same for a benchmark of any size: seeds of both sides meet in a join; a text meets its items in one row. Texts are
    known by 128 bits of hash."""

    short = range(1, min(map(len, masks)))

    def seeded(of_item: bool):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in blocks(batch, "t"):
                    th, of = tokens(*text_block(b.column("t")))
                    n = np.diff(of)
                    for m in [*masks, *("1" * k for k in short)]:
                        at, h = seeds(th, of, m)
                        d = np.searchsorted(of, at, "right") - 1
                        if of_item:
                            fits = np.isin(n[d], [k for k in np.unique(n) if m in masks_of(int(k), masks)])
                            at, h, d = at[fits], h[fits], d[fits]
                        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *(b.column(c).take(pa.array(d)) for c in "ij"), pa.array(at - of[d])], names=["h", "i", "j", "p"])

        return each

    names = (F.xxhash64(F.col(text)).alias("i"), F.xxhash64(F.lit(7), F.col(text)).alias("j"))
    own = docs.where(F.col(text).isNotNull()).select(*names, F.col(text).alias("t")).dropDuplicates(["i", "j"])
    schema = "h bigint, i bigint, j bigint, p bigint"
    left = own.mapInArrow(seeded(False), schema)
    right = items.select(F.col("item").alias("i"), F.lit(0).cast("long").alias("j"), F.col("item_text").alias("t")).mapInArrow(seeded(True), schema).select("h", F.col("i").alias("item"), F.col("p").alias("q"))
    # Written first, so that both sides are shuffled for the join and Spark can split the tasks of a common seed.
    pairs = left.join(cut(right), "h").groupBy("i", "j", "item").agg(F.collect_set(F.col("p") - F.col("q")).alias("diagonals"))
    laid = cut(pairs.join(items, "item").groupBy("i", "j").agg(F.collect_list(F.struct("item", "item_text", "diagonals")).alias("items")))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for k in range(b.num_rows):
                a = tokens(*text_block(b.column("t").slice(k, 1)))[0]
                share: dict[int, float] = {}
                for x in b.column("items")[k].as_py():
                    own = tokens(*text_block(pa.array([x["item_text"]])))[0]
                    share[x["item"]] = max(matched(a, own, np.sort(np.array(x["diagonals"], np.int64))), share.get(x["item"], 0.0))
                found.append(_judged(share, similar))
            yield pa.RecordBatch.from_arrays([b.column("i"), b.column("j"), pa.array([f[0] for f in found], pa.bool_()), pa.array([f[1] for f in found], pa.list_(pa.int64())), pa.array([f[2] for f in found], pa.list_(pa.float64()))], names=["i", "j", "contaminated", "item_ids", "overlaps"])

    best = cut(laid.join(own, ["i", "j"]).select("i", "j", "t", "items").mapInArrow(verify, f"i bigint, j bigint, {RESULT}").where("contaminated"))
    kept = list(dict.fromkeys([key, *carry]))
    named = docs.select(*(F.col(c).alias(f"__{k}") for k, c in enumerate(kept)), *names).join(best, ["i", "j"], "left")
    return named.select(*(F.col(f"__{k}").alias(c) for k, c in enumerate(kept)), F.coalesce("contaminated", F.lit(False)).alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("overlaps", F.array().cast("array<double>")).alias("overlaps"))
