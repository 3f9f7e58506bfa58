"""SimHash near-duplicates by covering locality-sensitive hashing.

For radius r every bit position i gets a nonzero vector m(i) of r+1 bits; table v (a nonzero vector) keeps the positions
with odd <m(i), v>. The m(i) of at most r differing positions span at most r dimensions, so some v is orthogonal to all of
them and that table's mask leaves the pair equal: every pair within the radius meets in one of 2^(r+1)-1 tables, whatever
the data.

Work is on distinct fingerprints only (copies collapse before any shuffle of tables). A bucket of up to `MOST_IN_BUCKET`
fingerprints is compared inside one task and leaves a spanning forest of its links, never all pairs. Members of larger
buckets are linked exactly without gathering them, with the same result (radius up to 2; tested with `most=3`): x and y
differ in at most two bits if and only if some z is within one bit of each, so each member is sent to its own key and its
one-bit neighbours, and each key (at most 65 members) links its members to the least of those in range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import blocks, cut, text_block
from fathomline.llm.components import components, forest
from fathomline.llm.kernels import words

BITS = 64
SEED = 42
SHINGLE = 3
RADIUS = 2
MOST_IN_BUCKET = 2048

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def masks(radius: int = RADIUS) -> list[int]:
    """The covering masks as unsigned 64-bit numbers."""
    n = 1 << (radius + 1)
    return [sum(1 << i for i in range(BITS) if ((i % (n - 1) + 1) & v).bit_count() & 1) for v in range(1, n)]


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_fingerprints(data: np.ndarray, at: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprints of all texts of a block."""
    starts, ends, of = words(data, at)
    fp = np.zeros(len(at) - 1, np.uint64)
    if not len(starts):
        return fp
    sizes = ends - starts
    joined = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)
    inside = np.repeat(np.arange(len(sizes)), sizes)
    take = np.arange(len(inside)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[inside]
    joined[np.arange(len(inside)) + inside] = _LOWER[data[take]]
    begin = np.cumsum(sizes + 1) - sizes - 1
    finish = begin + sizes
    n = np.diff(of)
    count = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    filled = np.flatnonzero(n)
    first = np.concatenate([np.arange(of[d], of[d] + count[d]) for d in filled])
    last = np.minimum(first + shingle - 1, np.repeat(of[filled + 1] - 1, count[filled]))
    buf, hash_of = joined.tobytes(), xxhash.xxh64_intdigest
    h = np.array([hash_of(buf[a:b], SEED) for a, b in zip(begin[first].tolist(), finish[last].tolist(), strict=True)], np.uint64)
    edges = np.concatenate([[0], np.cumsum(count[filled])])
    for j, d in enumerate(filled):
        own = h[edges[j] : edges[j + 1]]
        set_bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        fp[d] = np.packbits(set_bits * 2 > len(own), bitorder="little").view(np.uint64)[0]
    return fp


def fingerprints(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, fp long) of each row. A null text has no words; no words make fingerprint zero."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text):
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(block_fingerprints(*text_block(part.column(text))).view(np.int64))], names=[key, "fp"])

    return df.select(key, text).mapInArrow(each, f"{key} {df.schema[key].dataType.simpleString()}, fp bigint")


def links_in(members: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links within one bucket of distinct fingerprints."""
    a, b = [], []
    for lo in range(0, len(members), 256):
        near = np.bitwise_count(members[lo : lo + 256, None] ^ members[None, :]) <= radius
        i, j = np.nonzero(near)
        keep = j > i + lo
        a.append(members[i[keep] + lo])
        b.append(members[j[keep]])
    return forest(np.concatenate(a).view(np.int64).tolist(), np.concatenate(b).view(np.int64).tolist())


def links(distinct: DataFrame, radius: int = RADIUS, most: int = MOST_IN_BUCKET) -> DataFrame:
    """(u, v) pairs of fingerprints within `radius` that connect the same ones as all such pairs. distinct: one column fp."""
    if radius > 2 and most is not None:
        raise ValueError("buckets beyond the bound are linked exactly up to radius 2 only")
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_long(m))).alias("k")) for t, m in enumerate(masks(radius))])
    keyed = distinct.select("fp", F.inline(tables))
    # Written first, as are the minima below, so that joins shuffle both sides and Spark can split the tasks of a hot key.
    sizes = cut(keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1"))
    met = keyed.join(sizes, ["t", "k"])

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u: list[int] = []
            v: list[int] = []
            for members in batch.column(0):
                x, y = links_in(np.array(members.as_py(), np.int64).view(np.uint64), radius)
                u += x
                v += y
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    small = met.where(F.col("n") <= most).groupBy("t", "k").agg(F.collect_list("fp").alias("members")).select("members").mapInArrow(bucket, "u bigint, v bigint")
    hot = met.where(F.col("n") > most).select("fp").distinct()
    steps = F.array(F.lit(0).cast("long"), *[F.lit(_long(1 << i)) for i in range(BITS)][: BITS if radius else 0])
    beside = hot.select("fp", F.explode(F.transform(steps, lambda s: F.col("fp").bitwiseXOR(s))).alias("z"))
    if radius == 1:  # only pairs of which one is the key itself
        near = beside.where("fp != z").join(hot.withColumnRenamed("fp", "z"), "z", "left_semi").select(F.col("fp").alias("u"), F.col("z").alias("v"))
    else:
        near = beside.join(cut(beside.groupBy("z").agg(F.min("fp").alias("v"))), "z").where("fp != v").select(F.col("fp").alias("u"), "v")
    return small.unionByName(near)


def near_duplicates(df: DataFrame, key: str, text: str, radius: int = RADIUS) -> DataFrame:
    """key, fp and component: the smallest key reachable over links of at most `radius` differing bits, itself included.

    Null and empty texts have fingerprint zero and link like any other; repeated rows share a component; a null key counts
    as no key, so a component of null keys only has a null name. A text of any length is one row of one task."""
    marked = cut(fingerprints(df, key, text))
    distinct = marked.groupBy("fp").agg(F.min(key).alias("least"))
    joined = components(links(distinct.select("fp"), radius), "u", "v")
    rooted = distinct.join(joined.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = cut(rooted.groupBy("root").agg(F.min("least").alias("component")))
    named = cut(rooted.select("fp", "root").join(names, "root").select("fp", "component"))
    return marked.join(named, "fp").select(key, "fp", "component")
