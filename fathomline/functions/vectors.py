"""Vector functions as columns over array<float> or array<double>; all arithmetic is in double.

Every function takes columns (or names) and returns a column made of built-in higher-order functions, so plans stay in the
JVM. A null vector gives null. Where an input has no answer (other dimensions, a norm below 1e-9 where one is needed) the
row fails with a message, as `raise_error`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-9
ColumnLike = Column | str


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(v: ColumnLike) -> Column:
    return _c(v).cast("array<double>")


def literal(values: list[float]) -> Column:
    """A query vector as a driver-side literal."""
    return F.array(*[F.lit(float(x)) for x in values]) if values else F.array().cast("array<double>")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once a row: inside a lambda it would be worked out again for each element."""
    return F.transform(F.array(value), use)[0]


def _require(ok: Column, message: str, value: Column) -> Column:
    return F.when(ok.isNull() | ok, value).otherwise(F.raise_error(F.lit(message)).cast("double"))


def _same(a: Column, b: Column, value: Column) -> Column:
    return _require(F.size(a) == F.size(b), "vectors differ in dimension", F.when(a.isNotNull() & b.isNotNull(), value))


def total(v: ColumnLike) -> Column:
    return F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x)


def dot(a: ColumnLike, b: ColumnLike) -> Column:
    a, b = doubles(a), doubles(b)
    return _same(a, b, F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))


def norm(v: ColumnLike) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine_similarity(a: ColumnLike, b: ColumnLike) -> Column:
    """0 if either norm is below 1e-9."""
    na, nb = norm(a), norm(b)
    return F.when((na < TINY) | (nb < TINY), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def cosine_distance(a: ColumnLike, b: ColumnLike) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def euclidean_distance(a: ColumnLike, b: ColumnLike) -> Column:
    a, b = doubles(a), doubles(b)
    return _same(a, b, F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)))


def angular_similarity(a: ColumnLike, b: ColumnLike) -> Column:
    """1 - acos(cosine)/pi, a cosine that isn't a number counting as -1."""
    c = cosine_similarity(a, b)
    c = F.when(F.isnan(c), F.lit(-1.0)).otherwise(c)
    return F.lit(1.0) - F.acos(F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0))) / F.lit(3.141592653589793)


def search_distance(kind: str, v: ColumnLike, q: ColumnLike) -> Column:
    """The search operators: least is nearest for each kind; a zero vector has no cosine (NaN, after all others)."""
    if kind == "cosine":
        d = norm(v) * norm(q)
        return F.lit(1.0) - F.when(d == 0, F.lit(float("nan"))).otherwise(dot(v, q) / d)
    if kind == "l2":
        return euclidean_distance(v, q)
    if kind == "ip":
        return -dot(v, q)
    raise ValueError(f"unknown distance {kind!r}: cosine, l2 or ip")


def normalized(v: ColumnLike) -> Column:
    """Divided by the norm; a zero vector stays (its divisor is 1e-9)."""
    return _once(norm(v), lambda n: F.transform(doubles(v), lambda x: x / F.when(n == 0, F.lit(TINY)).otherwise(n)))


def normalized_strict(v: ColumnLike) -> Column:
    return _once(norm(v), lambda n: F.transform(doubles(v), lambda x: x / _require(n >= TINY, "cannot normalise a zero vector", n)))


def mean(v: ColumnLike) -> Column:
    return total(v) / _require(F.size(_c(v)) > 0, "mean of an empty vector", F.size(_c(v)).cast("double"))


def greatest_of(v: ColumnLike) -> Column:
    """-infinity for an empty vector."""
    return F.when(_c(v).isNotNull(), F.coalesce(F.array_max(doubles(v)), F.lit(float("-inf"))))


def least_of(v: ColumnLike) -> Column:
    return F.when(_c(v).isNotNull(), F.coalesce(F.array_min(doubles(v)), F.lit(float("inf"))))


def variance(v: ColumnLike) -> Column:
    """Of a sample (n-1); 0 for fewer than two values."""
    n = F.size(_c(v))
    squares = _once(total(v) / n, lambda m: F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + (x - m) * (x - m)))
    return F.when(n <= 1, F.lit(0.0)).otherwise(squares / (n - 1))


def stdev(v: ColumnLike) -> Column:
    return F.sqrt(variance(v))


def softmax(v: ColumnLike) -> Column:
    powers = _once(F.array_max(doubles(v)), lambda top: F.transform(doubles(v), lambda x: F.exp(x - top)))
    summed = lambda e: F.struct(e.alias("e"), F.aggregate(e, F.lit(0.0), lambda a, x: a + x).alias("s"))
    return _once(_once(powers, summed), lambda p: F.transform(p["e"], lambda x: F.when(p["s"] > TINY, x / p["s"]).otherwise(x)))


def sigmoid(v: ColumnLike) -> Column:
    return F.transform(doubles(v), lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x)))


def arg_max(v: ColumnLike) -> Column:
    """The first greatest position, from 0."""
    return (F.array_position(doubles(v), F.array_max(doubles(v))) - 1).cast("bigint")


def arg_sort_descending(v: ColumnLike) -> Column:
    """Positions by falling value, equal values in their order."""
    pairs = F.transform(doubles(v), lambda x, i: F.struct((-x).alias("k"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda p: p["i"])


def ordered(v: ColumnLike, descending: bool = False) -> Column:
    return F.sort_array(doubles(v), not descending)


def percentile(v: ColumnLike, p: float) -> Column:
    """Linear interpolation between order statistics, p in 0..100."""
    if not 0 <= p <= 100:
        raise ValueError("percentile must be in 0..100")
    s = F.sort_array(doubles(v))
    at = (F.size(s) - 1) * F.lit(p / 100.0)
    low = F.floor(at).cast("int")
    a, b = F.element_at(s, low + 1), F.element_at(s, F.least(low + 2, F.size(s)))
    return F.when(F.size(s) > 0, a + (b - a) * (at - low))


def median(v: ColumnLike) -> Column:
    return percentile(v, 50.0)


def quantile_slice(v: ColumnLike, low: float, high: float) -> Column:
    """The values between two quantiles (0..1), both included."""
    ends = F.struct(percentile(v, low * 100).alias("a"), percentile(v, high * 100).alias("b"))
    return _once(ends, lambda p: F.filter(doubles(v), lambda x: (x >= p["a"]) & (x <= p["b"])))


def z_scores(v: ColumnLike) -> Column:
    m = F.when(F.size(_c(v)) > 0, total(v) / F.size(_c(v)))  # an empty vector has none and needs none
    moments = F.struct(m.alias("m"), stdev(v).alias("s"))
    return _once(moments, lambda p: F.transform(doubles(v), lambda x: (x - p["m"]) / _require(p["s"] >= TINY, "standard deviation is zero", p["s"])))


def cumulative_sum(v: ColumnLike) -> Column:
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(doubles(v), start, lambda a, x: F.struct((a["s"] + x).alias("s"), F.array_append(a["out"], a["s"] + x).alias("out")), lambda a: a["out"])


def element_wise(a: ColumnLike, b: ColumnLike, f: Callable[[Column, Column], Column] = lambda x, y: x * y) -> Column:
    a, b = doubles(a), doubles(b)
    ok = F.when(F.size(a) == F.size(b), F.lit(True)).otherwise(F.raise_error(F.lit("vectors differ in dimension")).cast("boolean"))
    return F.when(ok, F.zip_with(a, b, f))


def scaled_to_max(v: ColumnLike) -> Column:
    return _once(F.array_max(doubles(v)), lambda m: F.transform(doubles(v), lambda x: x / _require(F.abs(m) >= TINY, "greatest value is zero", m)))


def scaled_to_sum(v: ColumnLike) -> Column:
    return _once(total(v), lambda s: F.transform(doubles(v), lambda x: x / _require(F.abs(s) >= TINY, "sum is zero", s)))


def deduplicated(v: ColumnLike) -> Column:
    return F.array_distinct(_c(v))


def count_uniques(v: ColumnLike) -> Column:
    return F.size(F.array_distinct(_c(v))).cast("bigint")


def is_zero(v: ColumnLike) -> Column:
    return F.forall(_c(v), lambda x: x == 0)


def content_hash(v: ColumnLike) -> Column:
    return F.xxhash64(_c(v))


def size_bytes(v: ColumnLike) -> Column:
    return (F.size(_c(v)) * 4).cast("bigint")


def as_longs(v: ColumnLike) -> Column:
    """Truncating; out of range values go to the ends, NaN to 0."""
    top = 9223372036854775807
    return F.transform(doubles(v), lambda x: F.when(F.isnan(x), F.lit(0)).when(x >= 9.223372036854775807e18, F.lit(top)).when(x <= -9.223372036854775808e18, F.lit(-top - 1)).otherwise(x.try_cast("bigint")))


def filled(n: int, value: float) -> Column:
    return F.array_repeat(F.lit(float(value)), n)


def uniform(n: int, seed: int = 1234) -> Column:
    return F.array(*[F.rand(seed + i) for i in range(n)])


def gaussian(n: int, seed: int = 1234) -> Column:
    return F.array(*[F.randn(seed + i) for i in range(n)])


def random_sample(v: ColumnLike, n: int, replace: bool = False, seed: int = 1234) -> Column:
    """n values; without replacement an error if there are fewer."""
    if replace:
        return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.element_at(_c(v), (F.pmod(F.xxhash64(i, F.lit(seed), _c(v)), F.size(_c(v)).cast("bigint")) + 1).cast("int")))
    keyed = F.array_sort(F.transform(_c(v), lambda x, i: F.struct(F.xxhash64(i, F.lit(seed), _c(v)).alias("k"), i.alias("i"), x.alias("x"))))
    enough = F.when(F.size(_c(v)) >= n, F.lit(n)).otherwise(F.raise_error(F.lit("sample larger than the vector")).cast("int"))
    return F.transform(F.slice(keyed, F.lit(1), enough), lambda s: s["x"])


def multinomial(v: ColumnLike, n: int, seed: int = 1234) -> Column:
    """How often each place is drawn in n seeded draws by weight; zeros if the weights sum to about 0."""
    s, cum = total(v), cumulative_sum(v)
    draws = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.pmod(F.xxhash64(i, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52)) * s)
    return F.transform(_c(v), lambda x, j: F.when(F.abs(s) < TINY, F.lit(0)).otherwise(F.size(F.filter(draws, lambda d: (d < F.element_at(cum, j + 1)) & ((j == 0) | (d >= F.coalesce(F.try_element_at(cum, F.when(j > 0, j)), F.lit(0.0))))))).cast("bigint"))


def nucleus(v: ColumnLike, top_p: float, temperature: float = 1.0) -> Column:
    """(position, probability) of the shortest likeliest prefix of softmax(v / temperature) that reaches top_p."""
    p = softmax(F.transform(doubles(v), lambda x: x / F.lit(float(temperature))))
    order = F.array_sort(F.transform(p, lambda x, i: F.struct((-x).alias("k"), i.alias("i"))))
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<struct<i:int,p:double>>").alias("out"))
    return F.aggregate(order, start, lambda a, x: F.when(a["s"] >= top_p, a).otherwise(F.struct((a["s"] - x["k"]).alias("s"), F.array_append(a["out"], F.struct(x["i"].alias("i"), (-x["k"]).alias("p"))).alias("out"))), lambda a: a["out"])


def sampled(v: ColumnLike, top_p: float = 1.0, temperature: float = 1.0, seed: int = 1234) -> Column:
    """One position drawn from the nucleus, by a draw fixed by the row's vector and the seed."""
    kept = nucleus(v, top_p, temperature)
    s = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x["p"])
    draw = F.pmod(F.xxhash64(_c(v), F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52)) * s
    start = F.struct(F.lit(0.0).alias("s"), F.lit(-1).alias("at"))
    return F.aggregate(kept, start, lambda a, x: F.struct((a["s"] + x["p"]).alias("s"), F.when((a["at"] < 0) & (a["s"] + x["p"] > draw), x["i"]).otherwise(a["at"]).alias("at")), lambda a: a["at"])


def to_text(v: ColumnLike) -> Column:
    """`[f1,f2,...]` with shortest round-trip numbers."""
    return F.concat(F.lit("["), F.array_join(F.transform(_c(v), lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")), ","), F.lit("]"))


def from_text(s: ColumnLike) -> Column:
    """Of that form, with spaces allowed; `[]` is empty."""
    body = F.trim(F.regexp_replace(_c(s), r"^\s*\[|\]\s*$", ""))
    return F.when(body == "", F.array().cast("array<float>")).otherwise(F.transform(F.split(body, ","), lambda x: F.trim(x).cast("float")))


def to_bytes(v: ColumnLike) -> Column:
    """Little-endian float32."""

    @F.arrow_udf("binary")
    def pack(a):
        import numpy as np
        import pyarrow as pa

        return pa.array([None if x is None else np.asarray(x, "<f4").tobytes() for x in a.to_pylist()], pa.binary())

    return pack(_c(v).cast("array<float>"))


def from_bytes(b: ColumnLike) -> Column:
    """Little-endian float32; null if the length isn't a multiple of 4."""

    @F.arrow_udf("array<float>")
    def unpack(a):
        import numpy as np
        import pyarrow as pa

        return pa.array([None if x is None or len(x) % 4 else np.frombuffer(x, "<f4").tolist() for x in a.to_pylist()], pa.list_(pa.float32()))

    return unpack(_c(b))


def to_base64(v: ColumnLike) -> Column:
    return F.base64(to_bytes(v))


def half_precision(v: ColumnLike) -> Column:
    """Rounded to float16 and back, as wide vectors are compared."""

    @F.arrow_udf("array<float>")
    def rounded(a):
        import numpy as np
        import pyarrow as pa

        return pa.array([None if x is None else np.asarray(x, np.float16).astype(np.float32).tolist() for x in a.to_pylist()], pa.list_(pa.float32()))

    return rounded(_c(v).cast("array<float>"))


def shortened(v: ColumnLike, n: int, renormalise: bool = False) -> Column:
    """The first n dimensions; normalised again if asked or if the whole was of unit length (within 1e-3)."""
    enough = F.when(F.size(_c(v)) >= n, F.lit(n)).otherwise(F.raise_error(F.lit(f"vector has fewer than {n} dimensions")).cast("int"))
    cut = F.slice(doubles(v), F.lit(1), enough)
    return F.when(F.lit(renormalise) | (F.abs(norm(v) - 1) <= 1e-3), normalized(cut)).otherwise(cut)


def pooled(rows: ColumnLike, mask: ColumnLike, how: str) -> Column:
    """One vector of token vectors: `cls` the first, `last` the last masked in, `mean` weighted by the mask."""
    rows, mask = _c(rows), _c(mask)
    if how == "cls":
        return F.element_at(rows, 1)
    if how == "last":
        return F.element_at(rows, F.greatest(F.aggregate(mask, F.lit(0).cast("bigint"), lambda s, x: s + x), F.lit(1)).cast("int"))
    if how != "mean":
        raise ValueError(f"unknown pooling {how!r}: cls, mean or last")
    weight = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, x: s + x), F.lit(TINY))
    both = F.arrays_zip(rows.alias("r"), mask.alias("m"))
    zero = F.transform(F.element_at(rows, 1), lambda x: F.lit(0.0))
    summed = F.aggregate(both, zero, lambda a, t: F.zip_with(a, t["r"], lambda x, y: x + y * t["m"]))
    return F.transform(summed, lambda x: x / weight)


# Matrices: arrays of rows.
def matrix_column(m: ColumnLike, i: int) -> Column:
    return F.transform(_c(m), lambda r: F.element_at(r, i + 1))


def arg_max_rows(m: ColumnLike) -> Column:
    return F.transform(_c(m), lambda r: F.array_position(r, F.array_max(r)) - 1)


def tumbling(v: ColumnLike, length: int) -> Column:
    """Consecutive groups of `length` items, which must divide the size."""
    v = _c(v)
    ok = F.when(v.isNull() | (F.size(v) % length == 0), F.size(v)).otherwise(F.raise_error(F.lit(f"size is not a multiple of {length}")).cast("int"))
    return F.when(F.size(v) == 0, F.slice(F.array(v), 1, 0)).when(v.isNotNull(), F.transform(F.sequence(F.lit(0), (ok / length).cast("int") - 1), lambda i: F.slice(v, i * length + 1, F.lit(length))))


def sliding(v: ColumnLike, length: int, step: int, zero: Column | None = None) -> Column:
    """Windows of `length` from every `step`-th item, the tail filled with zeros."""
    v, zero = _c(v), F.lit(0.0) if zero is None else zero
    starts = F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), F.lit(step))
    return F.transform(starts, lambda s: F.concat(F.slice(v, s + 1, F.lit(length)), F.array_repeat(zero, F.greatest(F.lit(0), s + length - F.size(v)))))


def flattened(m: ColumnLike, depth: int = 2) -> Column:
    m = _c(m)
    for _ in range(depth - 1):
        m = F.flatten(m)
    return m


def expanded(m: ColumnLike) -> Column:
    return F.array(_c(m))


def shape(m: ColumnLike, depth: int) -> Column:
    """Sizes along each axis of a rectangular nested array."""
    out, m = [], _c(m)
    for _ in range(depth):
        out.append(F.size(m))
        m = F.element_at(m, 1)
    return F.array(*out)


def reshaped(v: ColumnLike, *sizes: int) -> Column:
    """A flat array as nested ones; one size may be -1. The sizes must fit."""
    v, known = _c(v), 1
    for s in sizes:
        known *= s if s > 0 else 1
    inner = [s for s in sizes]
    if -1 not in sizes:
        v = F.when(F.size(v) == known, v).otherwise(F.raise_error(F.lit("sizes do not fit")).cast("array<double>"))
    else:
        v = F.when(F.size(v) % known == 0, v).otherwise(F.raise_error(F.lit("sizes do not fit")).cast("array<double>"))
        if sizes.index(-1) > 0:
            raise ValueError("only the first size may be inferred")
    for s in reversed(inner[1:]):
        v = tumbling(v, s)
    return v


# Lists of (key, value) pairs: array<struct<key,value>>.
def pairs_sorted(p: ColumnLike) -> Column:
    return F.array_sort(_c(p), lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).otherwise(0))


def pairs_max(p: ColumnLike) -> Column:
    return F.coalesce(F.array_max(F.transform(_c(p), lambda x: x["value"])), F.lit(0.0))


def pairs_to_unit(p: ColumnLike) -> Column:
    m = pairs_max(p)
    return F.transform(_c(p), lambda x: F.struct(x["key"].alias("key"), F.when(m == 0, x["value"]).otherwise(x["value"] / m).alias("value")))


def pairs_cut(p: ColumnLike, n: int) -> Column:
    return F.slice(_c(p), 1, n)


# Aggregates.
def mean_vector(df: DataFrame, by: list[str], vector: str, weight: str | None = None, out: str = "mean") -> DataFrame:
    """The mean of each group's vectors (weighted: sum of w*v over sum of w, which must not be 0), by position, so that
    partial sums combine before the shuffle and no group is gathered."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    cells = df.where(F.col(vector).isNotNull()).select(*by, w.alias("__w"), F.posexplode(doubles(vector)).alias("__i", "__x"))
    sums = cells.groupBy(*by, "__i").agg((F.sum(F.col("__w") * F.col("__x")) / _require(F.sum("__w") != 0, "weights sum to zero", F.sum("__w"))).alias("__m"))
    return sums.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__m"))), lambda s: s["__m"]).alias(out))
