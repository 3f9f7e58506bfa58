"""Embedders and converters as Python plugins run over Arrow batches, and the files they are read from.

An embedder maps texts to vectors; a converter maps vectors of one space to another. They may raise `TooLong` (the batch is
split until the one text to blame stands alone), `Permanent` (the row is dead) or `Transient` (the batch is tried again).
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_ITEMS = 4096
MOST_REQUEST_BYTES = 16 << 20
MOST_DIMENSIONS = 16_000
#: Rows and tokens of one padded inference batch.
BATCH_ROWS, BATCH_TOKENS = 32, 512


class Permanent(Exception):
    """The row can never succeed."""


class TooLong(Permanent):
    """Some text of the batch is longer than the model takes."""


class Transient(Exception):
    """The batch may succeed later."""


class Embedder(Protocol):
    dim: int

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class Converter(Protocol):
    source_dim: int
    target_dim: int

    def convert(self, vectors: Sequence[Sequence[float]]) -> list[list[float]]: ...


class MockEmbedder:
    """For tests: component i is the text's length in bytes + i/1000. Texts with `poison` are too long, with `nan` not
    finite, with `short` of a wrong dimension, with `later` transient."""

    def __init__(self, dim: int = 3):
        self.dim = dim

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        if any("poison" in t for t in texts):
            raise TooLong("text is too long")
        if any("later" in t for t in texts):
            raise Transient("try later")
        return [[math.nan if "nan" in t else len(t.encode()) + 0.001 * i for i in range(self.dim - ("short" in t))] for t in texts]


class MockConverter:
    """Component j is the sum of the input + j/100."""

    def __init__(self, source_dim: int = 3, target_dim: int = 4):
        self.source_dim, self.target_dim = source_dim, target_dim

    def convert(self, vectors: Sequence[Sequence[float]]) -> list[list[float]]:
        return [[sum(v) + 0.01 * j for j in range(self.target_dim)] for v in vectors]


class HashedEmbedder:
    """A deterministic bag of words: each word adds a fixed random direction; the sum has unit length."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        from fathomline.functions.text import words_of

        out = []
        for t in texts:
            v = np.zeros(self.dim)
            for w in words_of(t):
                v += np.random.default_rng(int.from_bytes(w.encode(), "little") % (1 << 63)).standard_normal(self.dim)
            out.append((v / max(float(np.linalg.norm(v)), 1e-9)).tolist())
        return out


class Bridge:
    """Embeds with one model and converts into another's space."""

    def __init__(self, embedder: Embedder, converter: Converter):
        if embedder.dim != converter.source_dim:
            raise ValueError("the converter takes vectors of another dimension")
        self.embedder, self.converter, self.dim = embedder, converter, converter.target_dim

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        return self.converter.convert(self.embedder.embed(texts))


class ConvertBridge:
    """Two conversions in a row."""

    def __init__(self, first: Converter, second: Converter):
        if first.target_dim != second.source_dim:
            raise ValueError("the second converter takes vectors of another dimension")
        self.first, self.second, self.source_dim, self.target_dim = first, second, first.source_dim, second.target_dim

    def convert(self, vectors: Sequence[Sequence[float]]) -> list[list[float]]:
        return self.second.convert(self.first.convert(vectors))


class Identity:
    """Passes vectors through."""

    def __init__(self, dim: int):
        self.source_dim = self.target_dim = dim

    def convert(self, vectors: Sequence[Sequence[float]]) -> list[list[float]]:
        return [list(v) for v in vectors]


class RowNormaliser:
    """A converter whose rows are scaled to unit length; zero rows stay."""

    def __init__(self, inner: Converter):
        self.inner, self.source_dim, self.target_dim = inner, inner.source_dim, inner.target_dim

    def convert(self, vectors: Sequence[Sequence[float]]) -> list[list[float]]:
        out = self.inner.convert(vectors)
        if any(len(v) != self.target_dim for v in out):
            raise Permanent("the converter gave another dimension")
        return [[x / n for x in v] if (n := math.sqrt(sum(x * x for x in v))) else list(v) for v in out]


def batches_of(texts: Sequence[str], most_items: int = MOST_ITEMS, most_bytes: int = MOST_REQUEST_BYTES) -> Iterator[list[int]]:
    """Row numbers in order, cut by item count and bytes; a text over the bytes is a batch of its own."""
    batch: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        n = len(t.encode())
        if batch and (len(batch) >= most_items or size + n > most_bytes):
            yield batch
            batch, size = [], 0
        batch.append(i)
        size += n
    if batch:
        yield batch


def padded_batches(lengths: Sequence[int], rows: int = BATCH_ROWS, tokens: int = BATCH_TOKENS) -> list[list[int]]:
    """Rows grouped by similar length so that rows x longest and rows x longest^2 stay within a full batch's."""
    out: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: lengths[i]):
        longest = max(1, lengths[i])
        n = len(out[-1]) + 1 if out else 1
        if out and n * longest <= rows * tokens and n * longest**2 <= rows * tokens**2:
            out[-1].append(i)
        else:
            out.append([i])
    return out


Outcome = tuple[str, list[float] | None, str | None]  # status, vector, error


def attempt(call: Callable[[list], list[list[float]]], items: list, dim: int) -> list[Outcome]:
    """ok, dead or retry for each item. Only a batch that is too long is halved; other faults are of the whole batch."""
    try:
        got = call(items)
    except TooLong as e:
        if len(items) == 1:
            return [("dead", None, str(e))]
        half = len(items) // 2
        return attempt(call, items[:half], dim) + attempt(call, items[half:], dim)
    except Permanent as e:
        return [("dead", None, str(e))] * len(items)
    except Exception as e:  # noqa: BLE001 plugins may raise anything; it may pass
        return [("retry", None, f"{type(e).__name__}: {e}")] * len(items)
    if len(got) != len(items):
        return [("retry", None, f"{len(got)} vectors for {len(items)} items")] * len(items)
    out: list[Outcome] = []
    for v in got:
        if len(v) != dim:
            out.append(("dead", None, f"vector has {len(v)} dimensions, expected {dim}"))
        elif not all(map(math.isfinite, v)):
            out.append(("dead", None, "vector has values that are not finite"))
        else:
            out.append(("ok", [float(x) for x in v], None))
    return out


def _outcomes(df: DataFrame, column: str, call: Callable[[list], list[list[float]]], dim: int, sizes: bool) -> DataFrame:
    keep = [c for c in df.columns if c != column]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            items = b.column(column).to_pylist()
            out: list[Outcome] = [("empty", None, None)] * len(items)
            there = [i for i, x in enumerate(items) if x is not None]
            groups = batches_of([items[i] for i in there]) if sizes else [list(range(k, min(k + MOST_ITEMS, len(there)))) for k in range(0, len(there), MOST_ITEMS)]
            for g in groups:
                own = [there[j] for j in g]
                for i, o in zip(own, attempt(call, [items[i] for i in own], dim), strict=True):
                    out[i] = o
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.list_(pa.float32())), pa.array([o[2] for o in out], pa.string())], names=[*keep, "status", "vector", "error"])

    return df.mapInArrow(each, f"{kinds}{', ' if kinds else ''}status string, vector array<float>, error string")


def embedded(df: DataFrame, text: str, embedder: Embedder) -> DataFrame:
    """The other columns of `df` with status (ok, empty for null, dead, retry), vector and error."""
    return _outcomes(df, text, embedder.embed, embedder.dim, True)


def converted(df: DataFrame, vector: str, converter: Converter) -> DataFrame:
    """The same for vectors; those of another dimension than the converter takes are dead."""

    def call(vs: list) -> list[list[float]]:
        if any(len(v) != converter.source_dim for v in vs):
            raise TooLong("vector has another dimension than the converter takes")
        return converter.convert(vs)

    return _outcomes(df, vector, call, converter.target_dim, False)


def embed(embedder: Embedder, texts: str | list[str]) -> list[float] | list[list[float]]:
    """On the driver, for queries: at most 4096 texts."""
    many = [texts] if isinstance(texts, str) else texts
    if len(many) > MOST_ITEMS:
        raise ValueError(f"at most {MOST_ITEMS} texts")
    out = [o for g in batches_of(many) for o in attempt(embedder.embed, [many[i] for i in g], embedder.dim)]
    for status, _, error in out:
        if status != "ok":
            raise RuntimeError(error)
    return out[0][1] if isinstance(texts, str) else [o[1] for o in out]


def convert(converter: Converter, vector: list[float]) -> list[float]:
    if not 1 <= len(vector) <= MOST_DIMENSIONS or not all(map(math.isfinite, vector)):
        raise ValueError(f"a vector of 1 to {MOST_DIMENSIONS} finite numbers is needed")
    status, out, error = attempt(lambda v: converter.convert(v), [vector], converter.target_dim)[0]
    if status != "ok":
        raise RuntimeError(error)
    return out


def word_vectors(spark: SparkSession, path: str, normalise: bool = True) -> DataFrame:
    """(word, vector) of binary word-vector files: a line `count dim`, then per word its bytes, a space and dim
    little-endian float32. Words in lower case, the first of equals; vectors of unit length."""

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for c in b.column("content"):
                data = c.as_buffer().to_pybytes() if hasattr(c, "as_buffer") and c.as_buffer() else c.as_py()
                head, _, _ = data.partition(b"\n")
                count, dim = map(int, head.split())
                at, words, vectors = len(head) + 1, [], []
                for _ in range(count):
                    end = data.index(b" ", at)
                    v = np.array(struct.unpack_from(f"<{dim}f", data, end + 1))
                    words.append(data[at:end].decode("utf-8", "replace").strip("\n").lower())
                    vectors.append((v / max(float(np.linalg.norm(v)), 1e-9) if normalise else v).tolist())
                    at = end + 1 + 4 * dim
                    if len(words) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(vectors, pa.list_(pa.float32()))], names=["word", "vector"])
                        words, vectors = [], []
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(vectors, pa.list_(pa.float32()))], names=["word", "vector"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(each, "word string, vector array<float>").dropDuplicates(["word"])


def shards(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows dealt evenly for inference, whatever the skew of their sources."""
    return df.repartition(n, F.xxhash64(key))
