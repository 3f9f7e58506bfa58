"""Tensors as columns: struct<shape: array<int>, values: array<float>>, built from nested arrays or JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomline.functions.vectors import ColumnLike, _c, flattened, shape, tumbling

MOST_DEPTH = 5


def _nested(depth: int, kind: str = "float") -> str:
    if not 1 <= depth <= MOST_DEPTH:
        raise ValueError(f"depth must be in 1..{MOST_DEPTH}")
    return "array<" * depth + kind + ">" * depth


def rectangular(m: ColumnLike, depth: int) -> Column:
    """Whether all arrays along each axis have one size."""
    m, ok = _c(m), F.lit(True)
    for _ in range(depth - 1):
        sizes = F.transform(m, lambda r: F.size(r))
        ok = ok & (F.size(F.array_distinct(sizes)) <= 1)
        m = F.flatten(m)
    return ok


def from_json(text: ColumnLike, depth: int) -> Column:
    """A nested array of floats from its JSON; null if it isn't one, an error if it isn't rectangular."""
    m = F.from_json(_c(text), _nested(depth))
    return F.when(rectangular(m, depth), m).otherwise(F.when(m.isNotNull(), F.raise_error(F.lit("array is not rectangular")).cast(_nested(depth))))


def tensor(m: ColumnLike, depth: int) -> Column:
    """Shape and values of a rectangular nested array."""
    m = _c(m)
    ok = F.when(rectangular(m, depth), m).otherwise(F.raise_error(F.lit("array is not rectangular")).cast(_nested(depth)))
    return F.when(m.isNotNull(), F.struct(shape(ok, depth).alias("shape"), flattened(ok, depth).cast("array<float>").alias("values")))


def reshaped(t: ColumnLike, *sizes: int) -> Column:
    """With another shape of as many values; one size may be -1 and is inferred."""
    if sum(s == -1 for s in sizes) > 1 or any(s == 0 or s < -1 for s in sizes):
        raise ValueError("sizes must be positive, one may be -1")
    t, known = _c(t), 1
    for s in sizes:
        known *= s if s > 0 else 1
    n = F.size(t["values"])
    fits = (n % known == 0) if -1 in sizes else (n == known)
    ok = F.when(t.isNull() | fits, n).otherwise(F.raise_error(F.lit("sizes do not fit")).cast("int"))
    return F.when(t.isNotNull(), F.struct(F.array(*[(ok / known).cast("int") if s == -1 else F.when(ok >= 0, F.lit(s)) for s in sizes]).alias("shape"), t["values"].alias("values")))


def nested(t: ColumnLike, *inner: int) -> Column:
    """As nested arrays whose inner axes have the given sizes."""
    v = _c(t)["values"]
    for s in reversed(inner):
        v = tumbling(v, s)
    return v


def same_shape(a: ColumnLike, b: ColumnLike) -> Column:
    return _c(a)["shape"] == _c(b)["shape"]


def integers(t: ColumnLike) -> Column:
    return F.transform(_c(t)["values"], lambda x: x.cast("bigint"))


def try_float(x: ColumnLike) -> Column:
    """A number, text or JSON scalar as float; null if it isn't one."""
    return F.trim(F.regexp_replace(_c(x).cast("string"), r'^\s*"|"\s*$', "")).try_cast("float")
