"""Fused search: an exact nearest-neighbour leg and a BM25 leg, each the best `candidates`, joined by weighted reciprocal
ranks. Filters apply to both legs before their limits; chunked search keeps the best chunk of each document.

Ranks are numbered after the limits, over at most 100000 rows; everything before is one pass with a bounded heap per task.
"""

from __future__ import annotations

import math
import struct
import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import vectors as V
from fathomline.operators import lexical
from fathomline.operators.filters import compile_filter
from fathomline.operators.knn import ranked

MOST_ROWS, MOST_CANDIDATES, MOST_TEXT, MOST_QUERY = 1000, 100_000, 64 << 20, 1 << 20
#: Vectors wider than this are compared in half precision where that is asked for.
WIDE = 2000


class SearchError(ValueError):
    """The arguments are refused."""


@dataclass(frozen=True)
class Spec:
    """Validated arguments of a search."""

    limit: int = 10
    semantic_weight: float = 0.5
    rrf_k: int = 60
    candidates: int | None = None
    chunked: bool = False

    def __post_init__(self) -> None:
        if not 1 <= self.limit <= MOST_ROWS:
            raise SearchError(f"limit must be in 1..{MOST_ROWS}")
        if self.candidates is not None and not 1 <= self.candidates <= MOST_CANDIDATES:
            raise SearchError(f"candidates must be in 1..{MOST_CANDIDATES}")
        if self.rrf_k < 1:
            raise SearchError("rrf_k must be at least 1")
        if not (math.isfinite(self.semantic_weight) and 0 <= self.semantic_weight <= 1):
            raise SearchError("semantic_weight must be in 0..1")

    @property
    def depth(self) -> int:
        return self.candidates or (max(16 * self.limit, 200) if self.chunked else max(4 * self.limit, 50))

    @property
    def weight(self) -> float:
        """As a float32 widened to double."""
        return struct.unpack("f", struct.pack("f", self.semantic_weight))[0]


def check_vector(vector: list[float] | None, dim: int) -> list[float]:
    if vector is None:
        raise SearchError("query vector is null")
    if len(vector) != dim:
        raise SearchError(f"query vector has {len(vector)} dimensions, the column has {dim}")
    if not all(x is not None and math.isfinite(x) for x in vector):
        raise SearchError("query vector has values that are not finite")
    return [float(x) for x in vector]


def semantic_leg(rows: DataFrame, key: str, vector: str, query: list[float], distance: str, depth: int, half: bool = False) -> DataFrame:
    """key, semantic_distance, semantic_rank."""
    column, q = F.col(vector), V.literal(query)
    if half and len(query) > WIDE:
        column, q = V.half_precision(column), V.half_precision(q)
    near = rows.where(F.col(vector).isNotNull()).select(key, V.search_distance(distance, column, q).alias("semantic_distance"))
    order = [F.col("semantic_distance").asc_nulls_last(), F.col(key).cast("string")]
    return ranked(near.orderBy(*order).limit(depth), order, "semantic_rank")


def lexical_leg(rows: DataFrame, key: str, text: str, query: str, stats: lexical.Statistics | None, config: str, depth: int, as_text: bool = True, index: lexical.Index | None = None) -> DataFrame:
    """key, fts_score, fts_rank; equal scores by key (as text, or as it is for chunks). With an index only the query's
    postings are read; `rows` then says which documents may be found."""
    found = index.scored(query) if index is not None else None
    if found is not None:
        hits = found.select(F.col("key").alias(key), F.col("score").alias("fts_score")).join(rows.select(key), key, "left_semi")
    else:
        hits = lexical.scored(rows.select(key, text), text, query, stats, config).select(key, F.col("score").alias("fts_score"))
    order = [F.col("fts_score").desc_nulls_last(), F.col(key).cast("string") if as_text else F.col(key)]
    return ranked(hits.orderBy(*order).limit(depth), order, "fts_rank")


def fuse(semantic: DataFrame, fts: DataFrame, key: str, spec: Spec) -> DataFrame:
    """Full outer join on the key with rrf_score. A leg of weight 0 still adds its rows, at score 0."""
    part = lambda w, rank: F.coalesce(F.lit(w) / (F.lit(float(spec.rrf_k)) + F.col(rank)), F.lit(0.0))
    return semantic.join(fts, key, "full_outer").withColumn("rrf_score", part(spec.weight, "semantic_rank") + part(1.0 - spec.weight, "fts_rank"))


RESULT = ["pk_value", "rrf_score", "semantic_rank", "fts_rank", "semantic_distance", "fts_score", "chunk_seq", "chunk_start", "chunk_end", "chunk_text"]
_CHUNK = {"chunk_seq": "int", "chunk_start": "bigint", "chunk_end": "bigint", "chunk_text": "string"}


def _as_result(df: DataFrame) -> DataFrame:
    for name, kind in {"semantic_rank": "bigint", "semantic_distance": "double", **_CHUNK}.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df.select(*RESULT)


def key_text(*columns: str) -> Column:
    """A key as text: one column as it is, several as a record, `(a,b)`, with quotes where needed."""
    if len(columns) == 1:
        return F.col(columns[0]).cast("string")
    quoted = [F.when(c.isNull(), F.lit("")).when(c.rlike(r'^$|[\s,()"\\]'), F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\\\\\"), '"', '""'), F.lit('"'))).otherwise(c) for c in (F.col(n).cast("string") for n in columns)]
    return F.concat(F.lit("("), F.concat_ws(",", *quoted), F.lit(")"))


@dataclass
class HybridIndex:
    """A table with a text and a vector column, its statistics, and how a query becomes a vector.

    For chunked search, `chunks` has chunk_id, source_pk, chunk_seq, char_start, char_end, chunk_text and the vector, and
    joins `table` on its key (source_pk being the text of a key of several columns); filters are on the table's columns."""

    table: DataFrame
    key: str | list[str]
    text: str
    vector: str
    dim: int
    distance: str = "cosine"
    config: str = "simple"
    stats: lexical.Statistics | None = None
    embed: Callable[[str], list[float]] | None = None
    degrade: bool = True
    chunks: DataFrame | None = None
    half: bool = False
    index: lexical.Index | None = None

    def refreshed(self) -> HybridIndex:
        source, text = (self.chunks, "chunk_text") if self.chunks is not None else (self.table, self.text)
        self.stats = lexical.statistics(source, text, self.config)
        return self

    def indexed(self, path: str) -> HybridIndex:
        """Write postings and statistics below `path`; searches read these instead of the texts from then on."""
        if self.chunks is not None:
            self.index = lexical.Index.build(self.chunks, "chunk_id", "chunk_text", path, self.config)
        else:
            self.index = lexical.Index.build(self._keyed(None), "pk_value", self.text, path, self.config)
        return self

    def _keyed(self, filter: str | dict | None) -> DataFrame:
        keys = [self.key] if isinstance(self.key, str) else list(self.key)
        p = compile_filter(self.table, filter)
        rows = self.table if p is None else self.table.where(p)
        return rows.withColumn("pk_value", key_text(*keys))

    def search(self, query: str, limit: int = 10, semantic_weight: float = 0.5, rrf_k: int = 60, candidates: int | None = None, filter: str | dict | None = None) -> DataFrame:
        """Embed the query and search; if that fails and `degrade` is on, by text alone."""
        spec = Spec(limit, semantic_weight, rrf_k, candidates, self.chunks is not None)
        if len(query.encode()) > MOST_QUERY:
            raise SearchError(f"query is over {MOST_QUERY} bytes")
        compile_filter(self.table, filter)  # refused before any inference
        try:
            if self.embed is None:
                raise SearchError("no embedder")
            vector: list[float] | None = check_vector(self.embed(query), self.dim)
        except Exception as e:  # noqa: BLE001 whatever the embedder throws
            if not self.degrade:
                raise
            warnings.warn(f"searching by text only: {e}", stacklevel=2)
            vector = None
        return self._run(vector, query, spec, filter)

    def search_with_vector(self, vector: list[float], query: str = "", limit: int = 10, semantic_weight: float = 0.5, rrf_k: int = 60, candidates: int | None = None, filter: str | dict | None = None) -> DataFrame:
        """With the caller's vector; an empty text leaves the lexical leg empty."""
        spec = Spec(limit, semantic_weight, rrf_k, candidates, self.chunks is not None)
        return self._run(check_vector(vector, self.dim), query, spec, filter)

    def _run(self, vector: list[float] | None, query: str, spec: Spec, filter: str | dict | None) -> DataFrame:
        rows = self._keyed(filter)
        if self.chunks is not None:
            return self._chunked(rows, vector, query, spec)
        final = [F.col("rrf_score").desc_nulls_last(), F.col("pk_value")]
        fts = lexical_leg(rows, "pk_value", self.text, query, self.stats, self.config, spec.depth, index=self.index)
        if vector is None:
            out = fts.withColumn("rrf_score", F.lit(1.0) / (F.lit(float(spec.rrf_k)) + F.col("fts_rank")))
        else:
            out = fuse(semantic_leg(rows, "pk_value", self.vector, vector, self.distance, spec.depth, self.half), fts, "pk_value", spec)
        return _as_result(out.orderBy(*final).limit(spec.limit)).orderBy(*final)

    def _chunked(self, rows: DataFrame, vector: list[float] | None, query: str, spec: Spec) -> DataFrame:
        keys = [self.key] if isinstance(self.key, str) else list(self.key)
        source = rows.select(F.col(keys[0] if len(keys) == 1 else "pk_value").alias("source_pk"), "pk_value")
        pool = self.chunks.join(source, "source_pk")
        fts = lexical_leg(pool, "chunk_id", "chunk_text", query, self.stats, self.config, spec.depth, as_text=False, index=self.index)
        if vector is None:
            fused = fts.withColumn("rrf_score", F.lit(1.0) / (F.lit(float(spec.rrf_k)) + F.col("fts_rank"))).withColumns({"semantic_rank": F.lit(None).cast("bigint"), "semantic_distance": F.lit(None).cast("double")})
        else:
            fused = fuse(semantic_leg(pool, "chunk_id", self.vector, vector, self.distance, spec.depth, self.half), fts, "chunk_id", spec)
        # At most twice `MOST_CANDIDATES` rows of numbers: small enough to go to the chunks, and with them to the documents.
        own = self.chunks.select("chunk_id", "source_pk", "chunk_seq", F.col("char_start").cast("bigint").alias("chunk_start"), F.col("char_end").cast("bigint").alias("chunk_end"))
        placed = source.join(F.broadcast(own.join(F.broadcast(fused), "chunk_id")), "source_pk")
        last = F.lit((1 << 63) - 1)
        best = Window.partitionBy("pk_value").orderBy(F.col("rrf_score").desc(), F.coalesce("semantic_rank", last), F.coalesce("fts_rank", last), "chunk_seq", "chunk_id")
        final = [F.col("rrf_score").desc_nulls_last(), F.col("pk_value")]
        winners = placed.withColumn("__n", F.row_number().over(best)).where("__n = 1").orderBy(*final).limit(spec.limit)
        return _as_result(with_texts(winners, self.chunks, final)).orderBy(*final)


def with_texts(winners: DataFrame, chunks: DataFrame, order: list[Column], most: int = MOST_TEXT) -> DataFrame:
    """Chunk texts joined to the winners only, in order, until their bytes pass the budget; later rows have none."""
    texts = chunks.select("chunk_id", "chunk_text").join(F.broadcast(winners.select("chunk_id")), "chunk_id")  # at most 1000 ids
    running = F.sum(F.octet_length("chunk_text")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return winners.join(texts, "chunk_id").withColumn("__b", running).withColumn("chunk_text", F.when(F.col("__b") <= most, F.col("chunk_text")))
