"""Exact nearest neighbours, for one query vector, for a table of them, and over inverted lists of centroids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import vectors as V
from fathomline.operators.lineage import cut

#: Query tables up to this many vectors are broadcast; larger ones go block by block.
QUERY_BLOCK = 4096


def ranked(df: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """Rows numbered from 1. For results already limited: the window is over one partition."""
    return df.withColumn(rank, F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def nearest(df: DataFrame, key: str, vector: str, query: list[float], k: int, distance: str = "cosine", where: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The k rows nearest to `query`: key, keep, distance and rank. The filter comes before the limit; ties go by key as
    text; null vectors are never near. One pass with a bounded heap per task (TakeOrderedAndProject)."""
    rows = df if where is None else df.where(where)
    rows = rows.where(F.col(vector).isNotNull()).select(key, *keep, V.search_distance(distance, F.col(vector), V.literal(query)).alias("distance"))
    order = [F.col("distance").asc_nulls_last(), F.col(key).cast("string")]
    return ranked(rows.orderBy(*order).limit(k), order, "rank")


def nearest_many(df: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, k: int, distance: str = "cosine") -> DataFrame:
    """query_key, key, distance and rank of the k rows nearest to each query (a stated set against all rows, in blocks).

    A block of queries is broadcast at a time. Each task keeps the k best of each query with their vectors, from which the
    exact distance is then computed, so the table is read once a block and never joined. Rows may share keys or have none;
    distances that are not numbers (of zero vectors) come last, by key."""
    import pyarrow as pa

    q = queries.where(F.col(query_vector).isNotNull()).select(F.monotonically_increasing_id().alias("n"), F.col(query_key).alias("q"), F.col(query_vector).cast("array<float>").alias("w"))
    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(key).cast("string").alias("t"), F.col(vector).cast("array<float>").alias("v"))
    kinds = f"n bigint, k {df.schema[key].dataType.simpleString()}, t string, v array<float>"

    def local(block):
        ids = [r.n for r in block]
        m = np.array([r.w for r in block], np.float64)

        def far(x: np.ndarray) -> np.ndarray:
            if distance == "cosine":
                with np.errstate(invalid="ignore", divide="ignore"):
                    d = 1 - (m @ x.T) / np.outer(np.sqrt((m * m).sum(1)), np.sqrt((x * x).sum(1)))
                return np.where(np.isnan(d), np.inf, d)
            if distance == "l2":
                return np.sqrt(np.maximum((m * m).sum(1)[:, None] + (x * x).sum(1) - 2 * m @ x.T, 0))
            return -(m @ x.T)

        def kept(d: np.ndarray, names: list) -> np.ndarray:
            """Places of the k least, and of those so close to the last that the exact distance must decide; infinite ones
            are equal, and decided by name."""
            if len(d) <= k:
                return np.arange(len(d))
            edge = np.partition(d, k - 1)[k - 1]
            if np.isfinite(edge):
                return np.flatnonzero(d <= edge + 1e-9 * max(1.0, abs(edge)))
            finite, rest = np.flatnonzero(np.isfinite(d)), np.flatnonzero(~np.isfinite(d))
            rest = sorted(rest.tolist(), key=lambda i: (names[i] is not None, names[i] or ""))
            return np.concatenate([finite, np.array(rest[: k - len(finite)], np.int64)])

        def each(batches):
            held = None  # per query: distances, and the rows they are of
            for b in batches:
                if not b.num_rows:
                    continue
                d = far(np.array(b.column("v").flatten().to_numpy(), np.float64).reshape(b.num_rows, -1))
                names = b.column("t").to_pylist()
                picks = [kept(row, names) for row in d]
                used, place = np.unique(np.concatenate(picks), return_inverse=True)
                part, at = b.take(pa.array(used)), np.cumsum([0, *map(len, picks)])
                if held is None:
                    table, best = part, [(d[i][p], place[x:y]) for i, (p, x, y) in enumerate(zip(picks, at, at[1:]))]
                else:
                    base = table.num_rows
                    table = pa.Table.from_batches([table, part]).combine_chunks().to_batches()[0]
                    names = table.column("t").to_pylist()
                    best = []
                    for i, (p, x, y) in enumerate(zip(picks, at, at[1:])):
                        both, where = np.concatenate([held[i][0], d[i][p]]), np.concatenate([held[i][1], place[x:y] + base])
                        good = kept(both, [names[w] for w in where] if not np.isfinite(both).all() else names)
                        best.append((both[good], where[good]))
                    used, place = np.unique(np.concatenate([w for _, w in best]), return_inverse=True)
                    table, at = table.take(pa.array(used)), np.cumsum([0, *(len(w) for _, w in best)])
                    best = [(x, place[lo:hi]) for (x, _), lo, hi in zip(best, at, at[1:])]
                held = best
            for i, (_, where) in enumerate(held or []):
                own = table.take(pa.array(where))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(where), ids[i])), own.column("k"), own.column("t"), own.column("v")], names=["n", "k", "t", "v"])

        return rows.mapInArrow(each, kinds)

    q = cut(q)  # numbered once
    out, block = None, []

    def add(part):
        return local(part) if out is None else out.unionByName(local(part))

    for r in q.toLocalIterator():
        block.append(r)
        if len(block) == QUERY_BLOCK:
            out, block = add(block), []
    if block or out is None:
        out = add(block) if block else df.sparkSession.createDataFrame([], kinds)
    exact = out.join(q, "n").select("n", "q", "k", "t", V.search_distance(distance, "v", "w").alias("distance"))
    first = Window.partitionBy("n").orderBy(F.col("distance").asc_nulls_last(), F.col("t"))
    top = exact.withColumn("rank", F.row_number().over(first).cast("bigint")).where(F.col("rank") <= k)
    return top.select(F.col("q").alias(query_key), F.col("k").alias(key), "distance", "rank")


def most_similar(words: DataFrame, positive: list[str], negative: list[str], n: int, word: str = "word", vector: str = "vector") -> DataFrame:
    """The n words of the greatest dot product with the normalised sum of the positive minus the negative words' unit
    vectors, without the words themselves. Words are compared in lower case."""
    plus, minus = [w.lower() for w in positive], [w.lower() for w in negative]
    used = words.where(F.lower(word).isin(plus + minus)).select(F.lower(word).alias("w"), V.normalized(vector).alias("v")).collect()
    v = sum((np.array(r.v) * (plus.count(r.w) - minus.count(r.w)) for r in used), np.zeros(len(used[0].v) if used else 0))
    v = v / max(float(np.linalg.norm(v)), 1e-9)
    rest = words.where(~F.lower(word).isin(plus + minus)).select(word, V.dot(V.normalized(vector), V.literal(v.tolist())).alias("similarity"))
    return rest.orderBy(F.col("similarity").desc_nulls_last(), word).limit(n)


class InvertedLists:
    """An optional index: rows by their nearest centroid. Searching probes the nearest lists only, so it is approximate;
    k rows are sought on until the probed lists hold them (or none is left). `ready_for` says whether it fits a search."""

    def __init__(self, centroids: np.ndarray, rows: DataFrame, key: str, vector: str, distance: str):
        self.centroids, self.rows, self.key, self.vector, self.distance = centroids, rows, key, vector, distance

    @classmethod
    def build(cls, df: DataFrame, key: str, vector: str, lists: int, distance: str = "l2", sample: int = 20_000, seed: int = 1) -> InvertedLists:
        """Centroids by a few k-means rounds on at most `sample` rows (of least hash); all rows are assigned."""
        part = df.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(key, F.lit(seed))).limit(sample).select(vector).collect()
        x = np.array([r[0] for r in part], np.float64)
        c = x[np.random.default_rng(seed).permutation(len(x))[: max(1, min(lists, len(x)))]].copy()
        for _ in range(10):
            own = ((x[:, None, :] - c[None]) ** 2).sum(2).argmin(1) if len(x) * len(c) * c.shape[1] < 5e7 else ((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)).argmin(1)
            for i in range(len(c)):
                if (own == i).any():
                    c[i] = x[own == i].mean(0)
        near = F.array(*[F.struct(V.euclidean_distance(vector, V.literal(row.tolist())).alias("d"), F.lit(i).alias("i")) for i, row in enumerate(c)])
        return cls(c, df.where(F.col(vector).isNotNull()).withColumn("list_id", F.array_min(near)["i"]), key, vector, distance)

    def ready_for(self, vector: str, dim: int, distance: str) -> bool:
        return (vector, dim, distance) == (self.vector, self.centroids.shape[1], self.distance)

    def search(self, query: list[float], k: int, probes: int = 4, where: Column | None = None) -> DataFrame:
        order = np.argsort(((self.centroids - np.array(query)) ** 2).sum(1)).tolist()
        rows = self.rows if where is None else self.rows.where(where)
        n = min(max(1, probes), len(order))
        while n < len(order) and rows.where(F.col("list_id").isin(order[:n])).limit(k).count() < k:
            n = min(len(order), 2 * n)
        return nearest(rows.where(F.col("list_id").isin(order[:n])), self.key, self.vector, query, k, self.distance)

    def search_many(self, queries: DataFrame, query_key: str, query_vector: str, k: int, probes: int) -> DataFrame:
        """query_key, key, distance and rank of the k nearest in the `probes` lists nearest to each query."""
        lists = F.array(*[F.struct(V.euclidean_distance("w", V.literal(row.tolist())).alias("d"), F.lit(i).alias("i")) for i, row in enumerate(self.centroids)])
        q = queries.select(F.col(query_key).alias("q"), F.col(query_vector).alias("w"))
        near = q.select("q", "w", F.explode(F.slice(F.array_sort(lists), 1, max(1, probes))["i"]).alias("list_id"))
        rows = self.rows.select(F.col(self.key).alias("k"), F.col(self.vector).alias("v"), "list_id")
        found = rows.join(near, "list_id").select("q", "k", V.search_distance(self.distance, "v", "w").alias("distance"))
        first = Window.partitionBy("q").orderBy(F.col("distance").asc_nulls_last(), F.col("k").cast("string"))
        top = found.withColumn("rank", F.row_number().over(first).cast("bigint")).where(F.col("rank") <= k)
        return top.select(F.col("q").alias(query_key), F.col("k").alias(self.key), "distance", "rank")
