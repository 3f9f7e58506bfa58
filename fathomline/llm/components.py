"""Connected components by alternating large-star and small-star rounds on a checkpointed edge table.

Before each round every task contracts its own edges with union-find (a forest has at most one edge per vertex), so what
is shuffled shrinks fast. Neighbourhoods are never gathered: a round is two group-wise minima, which combine before the
shuffle, and two joins against them. The minima are written before they are joined, so that both sides of a join are
shuffled for it and Spark can split the tasks of a star's hot centre.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import cut, forget

#: Edges that one task contracts at a time.
CONTRACT = 1 << 20


def forest(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """For each vertex of the edges that is not the least of its component, that least vertex."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top:
            up[x], x = top, y
        return top

    for x, y in zip(a, b, strict=True):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return list(up), [root(x) for x in up]


def contracted(edges: DataFrame) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[np.ndarray] = []
        n = 0

        def out() -> pa.RecordBatch:
            both = np.concatenate(a) if a else np.zeros((0, 2), np.int64)
            high, low = forest(both[:, 0].tolist(), both[:, 1].tolist())
            return pa.RecordBatch.from_arrays([pa.array(high, pa.int64()), pa.array(low, pa.int64())], names=["u", "v"])

        for b in batches:
            a.append(np.column_stack([b.column(0).to_numpy(), b.column(1).to_numpy()]))
            n += b.num_rows
            if n >= CONTRACT:
                yield out()
                a, n = [], 0
        yield out()

    return edges.mapInArrow(each, "u bigint, v bigint").where("u != v")


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(v, root) for every vertex of the undirected edges (two long columns); root is the least vertex reachable.

    Nulls and loops are left out, repeated edges count once; without edges there are no rows."""
    now = cut(contracted(edges.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull()).where(F.col(a) != F.col(b))))
    before = None
    for _ in range(most_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(state) == before or not state[0]:
            break
        before = tuple(state)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select("v", "m").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, now = now, cut(contracted(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()))
        forget(last, least, low)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.groupBy(F.col("u").alias("v")).agg(F.min(F.col("v")).alias("root")).unionByName(now.select(F.col("v"), F.col("v").alias("root")).distinct())
