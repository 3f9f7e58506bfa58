"""The plan that removal of repeated windows shares, whatever a unit (word, byte) and however windows are compared.

1. A window of W units that occurs twice holds, at both places, one and the same *mark*: a short stretch chosen by rule.
   Marks are hashed; only marks that occur in more than one place matter.
2. Copies of a whole text never reach that step twice: a mark counts as repeated by (content, position), so that all
   copies of a content are one, and later copies are removed whole by their content alone.
3. The first copy of each content with repeated marks is fetched once, and the kernel finds there the windows that occur
   earlier. Their union is removed.

Marks and windows move as packed blobs (`dealing`), each once: a task settles among its own what it can and sends on one
record of a hot mark, so that no mark or window gathers the rows of all documents that hold it. Text moves in step 3 only,
compressed, keyed by (id, content), so that no hot content gathers anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import LAST_ID, blocks, cut, forget, text_block
from fathomline.llm.dealing import BLOB_COLUMNS, CHUNK, by_first, dealt, dealt_by, give_back, groups_for, lists_of, spans, unpacked


class Kernel:
    """What differs: units, marks, and how windows are compared."""

    window: int
    #: Whether repeats within one text count.
    within: bool
    #: Marks for each unit, about.
    density: float

    def whole(self, raw: bytes) -> tuple[int, str]:
        """Units of a text, and the sha256 of it with nothing removed."""
        raise NotImplementedError

    def marks(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text number, hash and position code of each mark of a block."""
        raise NotImplementedError

    def earlier(self, found: DataFrame, groups: int) -> tuple[DataFrame, list[DataFrame]]:
        """Runs of windows that occur earlier, as blobs of (u, s, n) dealt by u: n windows from s on; and tables to forget
        once these have been read. found: u, id, c, z (compressed text), s and h (positions and hashes of the repeated marks)."""
        raise NotImplementedError

    def removed(self, raw: bytes, s: np.ndarray, n: np.ndarray) -> tuple[list[int], str]:
        """Removed spans as start, end, start, end ... and the sha256 of what is kept."""
        raise NotImplementedError


def content(raw: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(raw)
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of bounded size, and the UTF-8 texts of their rows."""
    for batch in batches:
        for b in blocks(batch, "text"):
            data, at = text_block(b.column("text"))
            yield b, [data[x:y].tobytes() for x, y in zip(at, at[1:], strict=False)]


def at_places(h: np.ndarray, c: np.ndarray, s: np.ndarray, within: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct marks (h, c, s) in order of h, and whether h is known to be at several places: in two contents, or if
    `within` at two positions of one. A record of position -1 says that somebody knows."""
    order = by_first([h, c, s])
    h, c, s = h[order], c[order], s[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (s[1:] != s[:-1])
    h, c, s = h[new], c[new], s[new]
    run, first = spans(h)
    last = np.append(first[1:], len(h)) - 1
    many = (first != last) & (within | (c[first] != c[last])) if len(h) else np.zeros(0, bool)
    if len(h):
        many |= np.minimum.reduceat(s, first) < 0
    return h, c, s, many[run]


EMPTY_SHA = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def removals(df: DataFrame, key: str, text: str, kernel: Kernel) -> DataFrame:
    """key, raw (xxhash64 of the text), n, n_removed, n_spans, kept_sha256 and spans (flat starts and ends) of each row.

    Documents are in the order of their keys, a null key after all; rows with one key are one document each, none earlier
    than the other. Null texts are empty. A text of any length is one row of one task."""
    kind = df.schema[key].dataType.simpleString()
    docs = df.select(F.col(key).alias("key"), F.coalesce(F.col(key).cast("long"), F.lit(LAST_ID)).alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("raw"))

    def each_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, raws in texts_of(batches):
            cs, whole = [content(r) for r in raws], [kernel.whole(r) for r in raws]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("id"), b.column("raw"), pa.array([c[0] for c in cs], pa.int64()), pa.array([c[1] for c in cs], pa.int64()), pa.array([w[0] for w in whole], pa.int64()), pa.array([w[1] for w in whole], pa.string())], names=["key", "id", "raw", "c", "c2", "n", "sha"])

    rows = cut(docs.mapInArrow(each_whole, f"key {kind}, id bigint, raw bigint, c bigint, c2 bigint, n bigint, sha string"))
    groups = groups_for((rows.agg(F.sum("n")).first()[0] or 0) * kernel.density)
    within = kernel.within

    def each_mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        waiting = 0

        def out() -> Iterator[pa.RecordBatch]:
            h, c, s, known = at_places(*(np.concatenate(x) for x in zip(*held, strict=True)), within)
            held.clear()
            told = h[spans(h)[1]][known[spans(h)[1]]]
            yield dealt_by(c[known], groups, [s[known], h[known].view(np.int64)], groups)
            none = np.zeros(len(told), np.int64)
            yield dealt(np.concatenate([h[~known], told]), groups, [np.concatenate(x) for x in ((h[~known], told), (c[~known], none), (s[~known], none - 1))])

        for _, raws in texts_of(batches):
            data, at = np.frombuffer(b"".join(raws), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raws])])
            own = np.array([content(r)[0] for r in raws], np.int64)
            d, h, s = kernel.marks(data, at)
            held.append((h, own[d], s.astype(np.int64)))
            waiting += len(h)
            if waiting >= CHUNK:
                yield from out()
                waiting = 0
        if held:
            yield from out()
        give_back()

    def meet(table: pa.Table) -> pa.Table:
        if table.column("b")[0].as_py() >= groups:  # settled before, on the way to their texts
            return table
        h, c, s = unpacked(table.column("z"), 3)
        h, c, s, known = at_places(h.view(np.uint64), c, s, within)
        known &= s >= 0
        return pa.Table.from_batches([dealt_by(c[known], groups, [s[known], h[known].view(np.int64)], groups)])

    def each_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small, sent = zstandard.ZstdCompressor(level=3), set()
        for b, raws in texts_of(batches):
            if len(sent) > CHUNK:
                sent.clear()
            rows = {(i, content(r)[0]): r for i, r in zip(b.column("id").to_pylist(), raws, strict=True)}  # repeated rows once
            rows = {k: r for k, r in rows.items() if k not in sent}
            sent.update(rows)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in rows], pa.int64()), pa.array([k[1] for k in rows], pa.int64()), pa.array([small.compress(r) for r in rows.values()], pa.binary())], names=["id", "c", "z"])

    def each_kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [kernel.removed(zstandard.decompress(z.as_py()), s.values.to_numpy(), n.values.to_numpy()) for z, s, n in zip(b.column("z"), b.column("s"), b.column("n"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("c"), pa.array([o[0] for o in out], pa.list_(pa.int64())), pa.array([o[1] for o in out], pa.string())], names=["id", "c", "spans", "kept_sha256"])

    long = docs.where(F.octet_length("text") >= kernel.window)
    marks = long.select("text").mapInArrow(each_mark, BLOB_COLUMNS).groupBy("b").applyInArrow(meet, BLOB_COLUMNS)
    hits = marks.groupBy("b").applyInArrow(lists_of("c", ["s", "h"]), "c bigint, s array<bigint>, h array<bigint>")
    firsts = rows.groupBy("c", "c2").agg(F.min("id").alias("id"))
    wanted = firsts.join(hits, "c").select("id", "c", "s", "h").dropDuplicates(["id", "c"])
    stored = long.select("id", "text").mapInArrow(each_text, "id bigint, c bigint, z binary")
    found = cut(stored.join(wanted, ["id", "c"]).dropDuplicates(["id", "c"]).withColumn("u", F.monotonically_increasing_id()))
    earlier, used = kernel.earlier(found, groups)
    runs = earlier.groupBy("b").applyInArrow(lists_of("u", ["s", "n"]), "u bigint, s array<bigint>, n array<bigint>")
    kept = found.select("u", "id", "c", "z").join(runs, "u").select("id", "c", "z", "s", "n").mapInArrow(each_kept, "id bigint, c bigint, spans array<bigint>, kept_sha256 string")
    # Written first, so that both sides are shuffled for the join and Spark can split the tasks of a content with many copies.
    judged = cut(firsts.join(kept, ["id", "c"], "left").select("c", "c2", F.col("id").alias("first"), "spans", "kept_sha256"))
    forget(found, *used)
    copy = (F.col("id") > F.col("first")) & (F.col("n") >= kernel.window)
    spans_of = F.when(copy, F.array(F.lit(0).cast("long"), F.col("n"))).otherwise(F.coalesce("spans", F.array().cast("array<bigint>")))
    lengths = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).cast("long").alias("sign")), lambda a, x: F.struct((a["sum"] + a["sign"] * x).alias("sum"), (-a["sign"]).alias("sign")))
    return (
        rows.join(judged, ["c", "c2"])
        .select(F.col("key").alias(key), "raw", "n", spans_of.alias("spans"), F.when(copy, EMPTY_SHA).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))
        .select(key, "raw", "n", lengths["sum"].alias("n_removed"), F.expr("size(spans) div 2").cast("long").alias("n_spans"), "kept_sha256", "spans")
    )
