"""Near copies by true similarity of their shingles: the pipeline's near-duplicate stage.

Two texts are linked if the sets of their five-word shingles have a Jaccard similarity of at least 0.8. Candidates come from
the covering SimHash tables first (`simhash.links` over fingerprints of the same shingles). No radius of 64 bits reaches
that similarity, so prefixes complete them: put all shingles in one order, whatever it is; of two sets that similar the
first n - ceil(0.8 n) + 1 shingles of each have one in common. Shingles that no other text has go first in the order and
make no bucket, so that a text with a fifth of such shingles is in none, whatever passages it shares. A filter of fixed size
knows them; where it fills up it takes some for shared ones. Shingles that are frequent in a sample go last. Both change the
work and not the result.

Sets that share a prefix shingle make a bucket. A task lays the members it has against one of them and sends on only that
one, so that no bucket gathers. Of these pairs the likeliest of each set is verified on the texts. Buckets of which all
members turn out connected are done. Of the others the largest one of each set is looked at, blocks of up to `BLOCK` members
laid against each other, and the likeliest pair of any two components verified, `PIVOTS` times; then all pairs of all buckets
that are left are. A pair is a candidate only if sizes and a 1024-bit parity signature (which differs in at most as many bits as the sets in elements) allow the similarity.
Work, not rows, grows with the square of a bucket whose sets are not connected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm import simhash
from fathomline.llm.common import blocks, cut, forget, text_block
from fathomline.llm.components import components
from fathomline.llm.dealing import BLOB_COLUMNS, BLOBS, CHUNK, by_first, dealt, dealt_by, give_back, giving_back, groups_for, spans, unpacked
from fathomline.llm.kernels import byte_prefix, mix, ranges, words
from fathomline.llm.simhash import _LOWER

SHINGLE = 5
#: Least similarity of a link, as a fraction.
SIMILAR = (4, 5)
PIVOTS = 2
#: Members of a bucket that one task holds of either side.
BLOCK = 2048
#: Texts in the sample that finds frequent shingles, and how many of these go to every task.
SAMPLE, MOST_FREQUENT = 20_000, 100_000
#: Places of the filters that find buckets to go on with; what they let through in vain is sorted out after.
FILTER_BITS = 20
#: Places, as a power of two at most, of the filter that tells shingles of several texts (32 MB), and hashes that a task
#: settles for it at a time.
SHARED_BITS, SHARED_CHUNK = 28, 1 << 21
#: Bits of a shingle's hash that name its bucket: others that share them only add candidates.
_NAMED = np.uint64(0xFFFFFFFFFFFF0000)


def block_sets(data: np.ndarray, at: np.ndarray, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of all texts of a block; a shorter text is one shingle, no words are none."""
    low = _LOWER[data]
    starts, ends, of = words(low, at)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * (len(at) - 1)
    th = ranges(byte_prefix(low, 11), starts, ends, 11)
    by = np.uint64(0x9E3779B97F4A7C15)
    h = np.full(max(len(th) - shingle + 1, 0), shingle, np.uint64)
    for j in range(shingle):
        h = h * by + th[j : j + len(h)]
    h = mix(h)
    out = []
    for a, b in zip(of.tolist(), of[1:].tolist(), strict=False):
        if b - a >= shingle:
            out.append(np.unique(h[a : b - shingle + 1]))
        else:
            own = np.full(min(b - a, 1), b - a, np.uint64)
            for x in th[a:b]:
                own = own * by + x
            out.append(mix(own))
    return out


def prefix(own: np.ndarray, frequent: np.ndarray, counts: np.ndarray, shared: np.ndarray | None = None) -> np.ndarray:
    """The first shingles of a set that a similar set can't all miss: those of no other text, then by rising count in the
    sample. With a filter of shared ones, the others are left out of what is returned."""
    a, b = SIMILAR
    n = len(own)
    take = n - -(-a * n // b) + 1 if n else 0
    rank = np.zeros(n, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
        rank = np.where(frequent[at] == own, counts[at], 0)
    if shared is not None:
        slot = own >> np.uint64(64 - int(len(shared) * 8 - 1).bit_length())
        rank[(shared[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 0] = -1
    first = np.lexsort((own, rank))[:take]
    return own[first[rank[first] >= 0]]


def signature(own: np.ndarray) -> np.ndarray:
    """1024 parities of the set's elements as 128 bytes."""
    bits = np.bincount((own >> np.uint64(54)).astype(np.int64), minlength=1024) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def signatures(column: pa.ChunkedArray) -> np.ndarray:
    """Signatures as rows of sixteen words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 16)


def possible(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In how many bits signatures x and y differ, and whether that and the sizes n and m allow the similarity: with d
    elements in one set only, it is a/b or more if and only if (b + a) d <= (b - a) (n + m)."""
    a, b = SIMILAR
    differ = np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)
    return differ, (differ * (a + b) <= (n + m) * (b - a)) & (np.minimum(n, m) * b >= np.maximum(n, m) * a)


def fingerprint(own: np.ndarray) -> int:
    """The SimHash of a set: a bit is 1 if it is in over half the elements."""
    ones = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(own), bitorder="little").view(np.int64)[0])


def _frequent(docs: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of at least three sampled texts, sorted, and in how many they are."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "t"):
                sets = block_sets(*text_block(part.column("t")))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["h"])
        give_back()

    raw = F.xxhash64(F.lit(5), F.col(text))
    rate = max(1, docs.count() // SAMPLE)
    sample = docs.where(F.pmod(raw, F.lit(rate)) == 0).select(raw.alias("r"), F.col(text).alias("t")).dropDuplicates(["r"]).select("t")
    rows = sample.mapInArrow(each, "h bigint").groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(MOST_FREQUENT).toArrow()
    h, n = rows.column("h").to_numpy().view(np.uint64), rows.column("count").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _shared(docs: DataFrame, text: str, shingles: int) -> np.ndarray:
    """Packed flags by the first bits of a shingle's hash: clear only if no shingle there is in several texts. Sent are hashes
    alone, of which as many bits are kept as tell that many shingles apart; the last bit says that a task had it twice."""
    length = int(shingles).bit_length()
    bits = min(SHARED_BITS, max(10, length + 2))
    kept = np.uint64(((1 << min(62, max(bits, length + 9))) - 1) << (64 - min(62, max(bits, length + 9))))
    groups = groups_for(shingles)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        waiting, seen = 0, set()

        def out() -> pa.RecordBatch:
            h = np.concatenate(held) & kept
            held.clear()
            h.sort()
            first = spans(h)[1]
            own = h[first]
            return dealt(own, groups, [own | (np.diff(np.append(first, len(h))) > 1).astype(np.uint64)])

        for batch in batches:
            for part in blocks(batch, text):
                sets = block_sets(*text_block(part.column(text)))
                for v, own in zip(names(sets).tolist(), sets, strict=True):
                    if v not in seen:
                        seen.add(v)
                        held.append(own)
                        waiting += len(own)
                if waiting >= SHARED_CHUNK:
                    yield out()
                    waiting = 0
                    seen.clear()
        if waiting:
            yield out()
        give_back()

    def meet(table: pa.Table) -> pa.Table:
        h = unpacked(table.column("z"), 1)[0].view(np.uint64)
        h.sort()
        own = h >> np.uint64(1)
        first = spans(own)[1]
        several = (np.diff(np.append(first, len(h))) > 1) | (h[np.append(first[1:], len(h)) - 1] & np.uint64(1) == 1)
        slot = np.unique(h[first[several]] >> np.uint64(64 - bits)).astype(np.int64)
        if not len(slot):
            return BLOBS.empty_table()
        start = slot[0] >> 3
        flags = np.zeros(((slot[-1] >> 3) - start + 1) * 8, np.uint8)
        flags[slot - start * 8] = 1
        return pa.table({"b": [int(start)], "z": [np.packbits(flags, bitorder="little").tobytes()]}, schema=BLOBS)

    flags = np.zeros(1 << (bits - 3), np.uint8)
    found = docs.select(text).mapInArrow(each, BLOB_COLUMNS).groupBy("b").applyInArrow(giving_back(meet), BLOB_COLUMNS).toArrow()
    for start, z in zip(found.column("b").to_pylist(), found.column("z"), strict=True):
        part = np.frombuffer(z.as_py(), np.uint8)
        flags[start : start + len(part)] |= part
    return flags


def _marked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, v (the hash that names a set), n, the signature and the fingerprint of each row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text):
                sets = block_sets(*text_block(part.column(text)))
                arrays = [part.column(key), pa.array(names(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) for s in sets], pa.binary()), pa.array([fingerprint(s) for s in sets], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[key, "v", "n", "sig", "fp"])
        give_back()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(each, f"{key} {kind}, v bigint, n bigint, sig binary, fp bigint")


def names(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s)) for s in sets], np.uint64).view(np.int64)


def starred(h: np.ndarray, v: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Members v of buckets h, each once, in order, and the place of each one's bucket's first. Which is first is drawn by
    lot, the same for all buckets, so that buckets of the same sets choose alike."""
    order = by_first([h, mix(v.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)), *(-m for m in more)])
    h, v, more = h[order], v[order], [m[order] for m in more]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (v[1:] != v[:-1])
    h, v, more = h[new], v[new], [m[new] for m in more]
    run, first = spans(h)
    return h, v, first[run] if len(h) else run, *more


def _met(docs: DataFrame, text: str, groups: int, shingles: int) -> DataFrame:
    """Blobs: edges (x, p) from each member of a bucket to another that connect it (from number `groups` on), and the members
    (h, x) of all buckets that have several (from 2 * `groups` on)."""
    order = docs.sparkSession.sparkContext.broadcast((*_frequent(docs, text), _shared(docs, text, shingles)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts, shared = order.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting, seen = 0, set()

        def out() -> Iterator[pa.RecordBatch]:
            h, v, first = starred(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            seen.clear()
            later = first != np.arange(len(h))
            many = np.zeros(len(h), bool)
            many[first[later]] = True
            yield dealt_by(v[later], groups, [v[first[later]]], groups)
            yield dealt(h[later | many], groups, [h[later | many], v[later | many]], 2 * groups)
            yield dealt(h[~later], groups, [h[~later], v[~later], many[~later].astype(np.int64)])

        for batch in batches:
            for part in blocks(batch, text):
                sets = block_sets(*text_block(part.column(text)))
                for v, own in zip(names(sets).tolist(), sets, strict=True):
                    if v in seen:
                        continue
                    seen.add(v)
                    first = prefix(own, frequent, counts, shared) & _NAMED
                    held.append((first, np.full(len(first), v)))
                    waiting += len(first)
                if waiting >= CHUNK:
                    yield from out()
                    waiting = 0
        if held:
            yield from out()
        give_back()

    def meet(table: pa.Table) -> pa.Table:
        if table.column("b")[0].as_py() >= groups:
            return table
        h, v, told = unpacked(table.column("z"), 3)
        h, v, first, told = starred(h.view(np.uint64), v, told)
        later = first != np.arange(len(h))
        many = later.copy()
        many[first[later]] = True
        fresh = many & (told == 0)  # a task that had several has listed its members
        return pa.Table.from_batches([dealt_by(v[later], groups, [v[first[later]]], groups), dealt(h[fresh], groups, [h[fresh], v[fresh]], 2 * groups)])

    met = cut(docs.select(text).mapInArrow(each, BLOB_COLUMNS).groupBy("b").applyInArrow(giving_back(meet), BLOB_COLUMNS))
    order.unpersist()
    return met


def _filter(of: DataFrame, column: str) -> np.ndarray:
    """Flags by the first bits of the column's mixed hash: a filter of fixed size."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _places(b.column(0).to_numpy().view(np.uint64))
        give_back()

    return _flags(of.select(column).mapInArrow(each, "at bigint"))


def _places(x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.unique(slots(x)).astype(np.int64))], names=["at"])


def _flags(places: DataFrame) -> np.ndarray:
    flags = np.zeros(1 << FILTER_BITS, bool)
    flags[places.distinct().toArrow().column("at").to_numpy()] = True
    return flags


def slots(x: np.ndarray) -> np.ndarray:
    return mix(x ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(64 - FILTER_BITS)


def _buckets(listed: DataFrame, v: np.ndarray) -> np.ndarray:
    """The filter of the buckets h of listed members whose set the filter v passes. One function unpacks and marks: two in a
    row would run in two Python workers a task, and the others stay on each executor, idle and with what they hold."""
    shared = listed.sparkSession.sparkContext.broadcast(v)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for z in b.column("z"):
                x, y = (c.view(np.uint64) for c in unpacked([z], 2))
                yield _places(x[shared.value[slots(y)]])
        give_back()

    flags = _flags(listed.select("z").mapInArrow(each, "at bigint"))
    shared.unpersist()
    return flags


def _members(listed: DataFrame, h: np.ndarray) -> DataFrame:
    """(h, v) of the listed members whose bucket the filter passes."""
    shared = listed.sparkSession.sparkContext.broadcast(h)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for z in b.column("z"):
                x, y = (c.view(np.uint64) for c in unpacked([z], 2))
                good = shared.value[slots(x)]
                yield pa.RecordBatch.from_arrays([pa.array(x[good].view(np.int64)), pa.array(y[good].view(np.int64))], names=["h", "v"])
        give_back()

    return listed.select("z").mapInArrow(each, "h bigint, v bigint")


def _likeliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The candidates among joined pairs, and in how many bits their signatures differ."""
    for b in batches:
        differ, good = possible(signatures(b.column("xs")), signatures(b.column("ys")), b.column("xn").to_numpy(), b.column("yn").to_numpy())
        kept = pa.array(good)
        yield pa.RecordBatch.from_arrays([b.column("v").filter(kept), b.column("w").filter(kept), pa.array(differ[good])], names=["v", "w", "d"])
    give_back()


def apart_pairs(table: pa.Table, only_best: bool) -> pa.Table:
    """Candidate pairs (v, w) of different components in one block of a bucket, or between two: of any two components the
    likeliest, or all. Columns: v, root, own (the member's block), n and the signature."""
    v, root, own, n = (table.column(c).to_numpy() for c in ("v", "root", "own", "n"))
    marks = signatures(table.column("sig"))
    cross = len(np.unique(own)) > 1
    found: list[np.ndarray] = [np.zeros((0, 5), np.int64)]
    step = max(1, (1 << 18) // len(v))
    for lo in range(0, len(v), step):
        at = slice(lo, lo + step)
        differ, good = possible(marks[at, None, :], marks[None, :, :], n[at, None], n[None, :])
        good &= (root[at, None] < root[None, :]) & ((own[at, None] != own[None, :]) | (not cross))
        i, j = np.nonzero(good)
        found.append(np.column_stack([root[i + lo], root[j], differ[i, j], v[i + lo], v[j]]))
        if only_best:
            found = [_first_of_each(np.concatenate(found))]
    pairs = np.concatenate(found)
    return pa.table({"v": pairs[:, 3], "w": pairs[:, 4]})


def _first_of_each(rows: np.ndarray) -> np.ndarray:
    rows = rows[np.lexsort(rows.T[::-1])]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    return rows[new]


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those (u, v) of which the texts' sets are similar. texts: v, z (compressed)."""
    a, b = SIMILAR

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[bytes, np.ndarray] = (b"", np.zeros(0, np.uint64))  # rows of one u come one after the other
        for batch in batches:
            good = []
            for x, y in zip(batch.column("tu"), batch.column("tv"), strict=True):
                if (x := x.as_py()) != known[0]:
                    known = (x, set_of(x))
                p, q = known[1], set_of(y.as_py())
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(both * b >= (len(p) + len(q) - both) * a)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good, pa.bool_())) for c in "uv"], names=["u", "v"])
        give_back()

    named = lambda c: texts.select(F.col("v").alias(c), F.col("z").alias(f"t{c}"))
    return pairs.join(named("v"), "v").join(named("u"), "u").select("u", "v", "tu", "tv").mapInArrow(each, "u bigint, v bigint")


def set_of(z: bytes) -> np.ndarray:
    raw = zstandard.decompress(z)
    return block_sets(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]


def _links(sets: DataFrame, met: DataFrame, groups: int, texts_of: Callable[[DataFrame], DataFrame], pivots: int) -> DataFrame | None:
    """(v, root) of all connected sets; none if nothing is similar. sets: v, n, sig, fp, one row a set; texts_of: (v, z) of the
    sets v that it is given."""
    marks = sets.select("v", "n", "sig")

    def pairs_of(table: pa.Table) -> pa.Table:
        x, p = unpacked(table.column("z"), 2)
        both = np.unique(np.column_stack([x, p]), axis=0)
        return pa.table({"v": both[:, 0], "w": both[:, 1]})

    stars = cut(met.where(F.col("b").between(groups, 2 * groups - 1)).groupBy("b").applyInArrow(giving_back(pairs_of), "v bigint, w bigint"))
    prints = sets.groupBy("fp").agg(F.min("v").alias("w"))
    alike = sets.join(prints, "fp").where("v != w").select("v", "w")
    beside = simhash.links(prints.select("fp"))
    beside = beside.join(prints.select(F.col("fp").alias("u"), F.col("w").alias("a")), "u").join(prints.select(F.col("fp").alias("v"), F.col("w").alias("b")), "v").select(F.col("a").alias("v"), F.col("b").alias("w"))
    near = cut(stars.unionByName(alike).unionByName(beside))
    texts = cut(texts_of(near.select(F.explode(F.array("v", "w")).alias("v")).distinct()))
    laid = near.join(marks.select("v", F.col("n").alias("xn"), F.col("sig").alias("xs")), "v").join(marks.select(F.col("v").alias("w"), F.col("n").alias("yn"), F.col("sig").alias("ys")), "w")
    likely = laid.select("v", "w", "xn", "xs", "yn", "ys").mapInArrow(_likeliest, "v bigint, w bigint, d bigint").groupBy("v").agg(F.min(F.struct("d", "w")).alias("best")).select("v", F.col("best.w").alias("w"))

    def checked(near: DataFrame) -> DataFrame:
        """The similar ones of the pairs (v, w)."""
        return cut(_verified(near.select(F.least("v", "w").alias("u"), F.greatest("v", "w").alias("v")).distinct(), texts))

    edges = checked(likely)
    if edges.isEmpty():
        edges = roots = None
        open_ends = stars
    else:
        roots = cut(components(edges, "u", "v"))
        rooted = lambda c: roots.select(F.col("v").alias(c), F.col("root").alias(f"r{c}"))
        open_ends = stars.join(rooted("v"), "v", "left").join(rooted("w"), "w", "left").where(F.coalesce("rv", "v") != F.coalesce("rw", "w"))
    listed = met.where(F.col("b") >= 2 * groups)
    inside = _buckets(listed, _filter(open_ends, "v"))

    def apart(members: DataFrame) -> DataFrame:
        """Members with their roots, of the buckets that have several roots; buckets of the same members once."""
        now = members.withColumn("root", F.col("v")) if roots is None else members.join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
        now = cut(now.select("h", "v", "root"))
        done.append(now)
        several = now.groupBy("h").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("size"), F.sum(F.xxhash64("v").cast("decimal(20,0)")).alias("s"), F.sum(F.xxhash64(F.lit(1), "v").cast("decimal(20,0)")).alias("t"))
        several = cut(several.where("a != b").groupBy("s", "t", "size").agg(F.min("h").alias("h")))
        done.append(several)
        return cut(now.join(several.select("h", "size"), "h"))

    done = [met, stars, near, texts]
    live = apart(_members(listed, inside))
    for r in range(pivots + 1):
        if live.isEmpty():
            break
        parts = F.ceil(F.col("size") / BLOCK).cast("int")
        chosen = live
        if r < pivots:
            largest = live.groupBy("v").agg(F.max(F.struct("size", "h")).alias("most")).select("most.h").distinct()
            chosen = live.join(largest, "h", "left_semi")
        blocks_of = chosen.withColumn("own", F.pmod(F.xxhash64("v"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        blocks_of = blocks_of.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("size", "other")
        held = blocks_of.join(marks, "v").select("h", "i", "j", "v", "root", "own", "n", "sig")
        found = checked(held.groupBy("h", "i", "j").applyInArrow(apart_pairs_of(r < pivots), "v bigint, w bigint"))
        if not found.isEmpty():
            edges = found if edges is None else edges.unionByName(found)
            roots = cut(components(edges, "u", "v"))
        done.append(live)
        if r < pivots:
            live = apart(live.select("h", "v"))
    forget(*done, live)
    return roots


def apart_pairs_of(only_best: bool) -> Callable[[pa.Table], pa.Table]:
    def each(table: pa.Table) -> pa.Table:
        return apart_pairs(table, only_best)

    return each


def near_copies(docs: DataFrame, key: str, text: str, pivots: int = PIVOTS) -> DataFrame:
    """key and component: the smallest key reachable over links, itself included. Texts without words (null and empty ones
    among them) are alike; repeated rows share a component."""
    marked = cut(_marked(docs, key, text))
    least = marked.groupBy("v").agg(F.min(key).alias("least"))
    sets = marked.drop(key).dropDuplicates(["v"])
    shingles = sets.agg(F.sum("n")).first()[0] or 0
    groups = groups_for(shingles / 5)

    def each_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in blocks(batch, "t"):
                data, at = text_block(part.column("t"))
                yield pa.RecordBatch.from_arrays([part.column("least"), pa.array([small.compress(data[x:y].tobytes()) for x, y in zip(at, at[1:], strict=False)], pa.binary())], names=["least", "z"])
        give_back()

    stored = docs.select(F.col(key).alias("least"), F.col(text).alias("t")).mapInArrow(each_text, f"least {docs.schema[key].dataType.simpleString()}, z binary")

    def texts(wanted: DataFrame) -> DataFrame:
        return stored.join(least.join(wanted, "v"), "least").select("v", "z").dropDuplicates(["v"])

    roots = _links(sets, _met(docs, text, groups, shingles), groups, texts, pivots)
    if roots is None:
        return marked.join(least, "v").select(key, F.col("least").alias("component"))
    rooted = least.join(roots, "v", "left").select("v", "least", F.coalesce("root", "v").alias("root"))
    firsts = cut(rooted.groupBy("root").agg(F.min("least").alias("component")))
    named = cut(rooted.select("v", "root").join(firsts, "root").select("v", "component"))
    return marked.select(key, "v").join(named, "v").select(key, "component")
