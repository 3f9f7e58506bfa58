"""Registered queries over vectors, with their SQL. Floats are rounded to six places on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import vectors as V
from fathomline.operators import knn

QUERIES, SQL = {}, {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _first(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(_read(spark, sf_dir, "embeddings").where("vec_id = 0").first().embedding)


_DISTANCE = {
    "cosine": "list_cosine_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[])",
    "l2": "list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[])",
    "ip": "-list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])",
}


def _knn(kind: str, where: str | None = None, name: str | None = None) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = knn.nearest(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding", _first(spark, sf_dir), 20, kind, F.expr(where) if where else None)
        return rows.select("vec_id", F.round("distance", 6).alias("distance"), "rank")

    name = name or f"knn_{kind}"
    QUERIES[name] = query
    SQL[name] = f"""
WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0),
d AS (SELECT e.vec_id, {_DISTANCE[kind]} AS x FROM embeddings e, q {f"WHERE e.{where}" if where else ""}),
r AS (SELECT vec_id, x, row_number() OVER (ORDER BY x, vec_id::VARCHAR) AS rank FROM d)
SELECT vec_id, round(x, 6) AS distance, rank FROM r WHERE rank <= 20"""


for _kind in _DISTANCE:
    _knn(_kind)
_knn("cosine", "label = 3", "knn_filtered")


def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings")
    out = knn.nearest_many(e, "vec_id", "embedding", e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id", "q", 5, "l2")
    return out.select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


QUERIES["knn_batch"] = knn_batch
SQL["knn_batch"] = f"""
WITH d AS (SELECT q.vec_id AS query_id, e.vec_id, {_DISTANCE["l2"]} AS x FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x, vec_id::VARCHAR) AS rank FROM d)
SELECT query_id, vec_id, round(x, 6) AS distance, rank FROM r WHERE rank <= 5"""


#: Of 16 lists.
IVF_PROBES = 13


def ivf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate, so without SQL; its recall is tested, and probing all lists it equals the exact search (tested)."""
    e = _read(spark, sf_dir, "embeddings")
    index = knn.InvertedLists.build(e, "vec_id", "embedding", 16)
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return index.search_many(queries, "query_id", "q", 10, probes=IVF_PROBES)


QUERIES["ivf_search"] = ivf_search


def _per_row(name: str, column: Callable[[], Column], sql: str, out: str = "value", digits: bool = True) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        value = F.round(column(), 6) if digits else column()
        return _read(spark, sf_dir, "embeddings").select("vec_id", value.alias(out))

    QUERIES[name] = query
    SQL[name] = f"WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT vec_id, {f'round({sql}, 6)' if digits else sql} AS {out} FROM e"


_E = "embedding"


def _fixed() -> Column:
    return V.literal([1.0 if i % 2 else -0.5 for i in range(64)])



_FIXED_SQL = "list_transform(range(64), lambda i: CASE WHEN i % 2 = 1 THEN 1.0::DOUBLE ELSE -0.5::DOUBLE END)"
_MEAN_SQL = "(list_sum(v) / 64)"
_VAR_SQL = f"(list_sum(list_transform(v, lambda x: (x - {_MEAN_SQL}) * (x - {_MEAN_SQL}))) / 63)"
_per_row("vec_norm", lambda: V.norm(_E), "sqrt(list_inner_product(v, v))")
_per_row("vec_sum", lambda: V.total(_E), "list_sum(v)")
_per_row("vec_mean", lambda: V.mean(_E), _MEAN_SQL)
_per_row("vec_max", lambda: V.greatest_of(_E), "list_max(v)")
_per_row("vec_min", lambda: V.least_of(_E), "list_min(v)")
_per_row("vec_variance", lambda: V.variance(_E), _VAR_SQL)
_per_row("vec_stdev", lambda: V.stdev(_E), f"sqrt({_VAR_SQL})")
_per_row("vec_dot", lambda: V.dot(_E, _fixed()), f"list_inner_product(v, {_FIXED_SQL})")
_per_row("vec_cosine", lambda: V.cosine_similarity(_E, _fixed()), f"list_cosine_similarity(v, {_FIXED_SQL})")
_per_row("vec_euclidean", lambda: V.euclidean_distance(_E, _fixed()), f"list_distance(v, {_FIXED_SQL})")
_per_row("vec_angular", lambda: V.angular_similarity(_E, _fixed()), f"1 - acos(greatest(-1, least(1, list_cosine_similarity(v, {_FIXED_SQL})))) / pi()")
_per_row("vec_median", lambda: V.median(_E), "(list_sort(v)[32] + list_sort(v)[33]) / 2")
_per_row("vec_percentile", lambda: V.percentile(_E, 90), "list_sort(v)[57] + (list_sort(v)[58] - list_sort(v)[57]) * (63 * 0.9 - 56)")
_per_row("vec_argmax", lambda: V.arg_max(_E), "list_position(v, list_max(v)) - 1", "position", False)
_per_row("vec_argsort", lambda: F.slice(V.arg_sort_descending(_E), 1, 3).cast("array<bigint>"), "list_transform(list_sort(list_transform(v, lambda x, i: {'k': -x, 'i': i}))[1:3], lambda s: (s.i - 1)::BIGINT)", "positions", False)
_per_row("vec_dedup", lambda: V.count_uniques(_E), "len(list_distinct(v))::BIGINT", "n", False)
_per_row("vec_is_zero", lambda: V.is_zero(_E), "list_max(v) = 0 AND list_min(v) = 0", "zero", False)
_per_row("vec_size", lambda: V.size_bytes(_E), "len(v)::BIGINT * 4", "bytes", False)
_per_row("vec_longs", lambda: V.as_longs(F.transform(F.col(_E).cast("array<double>"), lambda x: x * 1000)), "list_transform(v, lambda x: trunc(x * 1000)::BIGINT)", "longs", False)


def _spread(name: str, column: Callable[[], Column], sql: str) -> None:
    """One row per vector: the sum of squares, and the values at 1, 2 and the last place of a vector result."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        w = _read(spark, sf_dir, "embeddings").select("vec_id", column().alias("w"))
        return w.select("vec_id", F.round(F.aggregate("w", F.lit(0.0), lambda s, x: s + x * x), 6).alias("squares"), F.round(F.col("w")[0], 6).alias("first"), F.round(F.element_at("w", 2), 6).alias("second"), F.round(F.element_at("w", -1), 6).alias("last"), F.size("w").cast("bigint").alias("n"))

    QUERIES[name] = query
    SQL[name] = f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), t AS (SELECT vec_id, {sql} AS w FROM e)
SELECT vec_id, round(coalesce(list_sum(list_transform(w, lambda x: x * x)), 0), 6) AS squares, round(w[1], 6) AS first, round(w[2], 6) AS second, round(w[len(w)], 6) AS last, len(w)::BIGINT AS n FROM t"""


_spread("vec_normalize", lambda: V.normalized(F.transform(F.col(_E).cast("array<double>"), lambda x: x * 3)), "list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)))")
_spread("vec_softmax", lambda: V.softmax(_E), "list_transform(v, lambda x: exp(x - list_max(v)) / list_sum(list_transform(v, lambda y: exp(y - list_max(v)))))")
_spread("vec_sigmoid", lambda: V.sigmoid(_E), "list_transform(v, lambda x: 1 / (1 + exp(-x)))")
_spread("vec_zscore", lambda: V.z_scores(_E), f"list_transform(v, lambda x: (x - {_MEAN_SQL}) / sqrt({_VAR_SQL}))")
_spread("vec_cumsum", lambda: V.cumulative_sum(_E), "list_transform(range(1, 65), lambda i: list_sum(v[1:i]))")
_spread("vec_multiply", lambda: V.element_wise(_E, _fixed()), f"list_transform(v, lambda x, i: x * ({_FIXED_SQL})[i])")
_spread("vec_scale_max", lambda: V.scaled_to_max(_E), "list_transform(v, lambda x: x / list_max(v))")
_spread("vec_sorted", lambda: V.ordered(_E, True), "list_reverse_sort(v)")
_spread("vec_slice_renorm", lambda: V.shortened(_E, 16, True), "list_transform(v[1:16], lambda x: x / sqrt(list_inner_product(v[1:16], v[1:16])))")
_spread("vec_quantile_slice", lambda: V.quantile_slice(_E, 0.25, 0.75), "list_filter(v, lambda x: x >= list_sort(v)[16] + (list_sort(v)[17] - list_sort(v)[16]) * 0.75 AND x <= list_sort(v)[48] + (list_sort(v)[49] - list_sort(v)[48]) * 0.25)")
_spread("mat_column", lambda: V.matrix_column(V.tumbling(F.col(_E).cast("array<double>"), 8), 2), "list_transform(range(8), lambda i: v[i * 8 + 3])")
_spread("mat_argmax_rows", lambda: F.transform(V.arg_max_rows(V.tumbling(F.col(_E).cast("array<double>"), 8)), lambda x: x.cast("double")), "list_transform(range(8), lambda i: (list_position(v[i * 8 + 1:i * 8 + 8], list_max(v[i * 8 + 1:i * 8 + 8])) - 1)::DOUBLE)")
_spread("mat_reshape", lambda: V.flattened(F.transform(V.reshaped(F.col(_E).cast("array<double>"), -1, 4, 4), lambda m: F.element_at(m, 2))), "flatten(list_transform(range(4), lambda i: v[i * 16 + 5:i * 16 + 8]))")
_spread("pool_mean", lambda: V.pooled(V.tumbling(F.col(_E).cast("array<double>"), 16), F.array(F.lit(1), F.lit(1), F.lit(0), F.lit(1)).cast("array<bigint>"), "mean"), "list_transform(range(1, 17), lambda i: (v[i] + v[i + 16] + v[i + 48]) / 3)")
_spread("pool_last", lambda: V.pooled(V.tumbling(F.col(_E).cast("array<double>"), 16), F.array(F.lit(1), F.lit(1), F.lit(1), F.lit(0)).cast("array<bigint>"), "last"), "v[33:48]")
_spread("pool_cls", lambda: V.pooled(V.tumbling(F.col(_E).cast("array<double>"), 16), F.array(F.lit(1)).cast("array<bigint>"), "cls"), "v[1:16]")


def vec_mean_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = V.mean_vector(_read(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return out.select("label", F.posexplode("mean").alias("i", "x")).select("label", F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("x"))


QUERIES["vec_mean_by_label"] = vec_mean_by_label
SQL["vec_mean_by_label"] = "WITH c AS (SELECT label, unnest(range(64)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings) SELECT label, i, round(avg(x), 6) AS x FROM c GROUP BY ALL"


def vec_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings").withColumn("w", F.col("vec_id") % 7 + 1)
    out = V.mean_vector(e, ["label"], "embedding", "w")
    return out.select("label", F.posexplode("mean").alias("i", "x")).select("label", F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("x"))


QUERIES["vec_weighted_mean"] = vec_weighted_mean
SQL["vec_weighted_mean"] = "WITH c AS (SELECT label, vec_id % 7 + 1 AS w, unnest(range(64)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings) SELECT label, i, round(sum(w * x) / sum(w), 6) AS x FROM c GROUP BY ALL"


def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings")
    w = e.select("vec_id", F.posexplode(V.tumbling(F.col("embedding").cast("array<double>"), 16)).alias("window", "w"))
    return w.select("vec_id", F.col("window").cast("bigint").alias("window"), F.round(V.total("w"), 6).alias("total"))


QUERIES["tumbling_windows"] = tumbling_windows
SQL["tumbling_windows"] = "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, unnest(range(4)) AS w FROM embeddings) SELECT vec_id, w AS \"window\", round(list_sum(v[w * 16 + 1:w * 16 + 16]), 6) AS total FROM e"


def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings")
    w = e.select("vec_id", F.posexplode(V.sliding(F.col("embedding").cast("array<double>"), 24, 12)).alias("window", "w"))
    return w.select("vec_id", F.col("window").cast("bigint").alias("window"), F.size("w").cast("bigint").alias("n"), F.round(V.total("w"), 6).alias("total"))


QUERIES["sliding_windows"] = sliding_windows
SQL["sliding_windows"] = "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, unnest(range(6)) AS w FROM embeddings) SELECT vec_id, w AS \"window\", 24::BIGINT AS n, round(list_sum(v[w * 12 + 1:w * 12 + 24]), 6) AS total FROM e"


def wordvec_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _read(spark, sf_dir, "embeddings").select(F.concat(F.lit("W"), "vec_id").alias("word"), F.col("embedding").alias("vector"))
    return knn.most_similar(words, ["w1", "W2"], ["w3"], 15).select("word", F.round("similarity", 6).alias("similarity"))


QUERIES["wordvec_similar"] = wordvec_similar
SQL["wordvec_similar"] = """
WITH u AS (SELECT 'W' || vec_id AS word, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
s AS (SELECT list_transform(range(1, 65), lambda i: a.v[i] + b.v[i] - c.v[i]) AS q FROM u a, u b, u c WHERE a.word = 'W1' AND b.word = 'W2' AND c.word = 'W3')
SELECT word, round(list_inner_product(v, q) / sqrt(list_inner_product(q, q)), 6) AS similarity FROM u, s WHERE word NOT IN ('W1', 'W2', 'W3') ORDER BY list_inner_product(v, q) DESC, word LIMIT 15"""


def vec_text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings")
    back = V.from_text(V.to_text("embedding"))
    wire = V.from_bytes(V.to_bytes("embedding"))
    return e.select("vec_id", (back == F.col("embedding")).alias("text_equal"), (wire == F.col("embedding")).alias("bytes_equal"))


QUERIES["vec_text_round_trip"] = vec_text_round_trip
SQL["vec_text_round_trip"] = "SELECT vec_id, true AS text_equal, true AS bytes_equal FROM embeddings"


def vec_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user and type as (key, value) lists: sorted, scaled to 1 and cut."""
    e = _read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("n"))
    lists = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(F.col("event_type").alias("key"), F.col("n").alias("value")))).alias("p"))
    best = lists.select("user_id", F.posexplode(V.pairs_cut(V.pairs_to_unit(V.pairs_sorted("p")), 2)).alias("place", "s"))
    return best.select("user_id", F.col("place").cast("bigint").alias("place"), F.round("s.value", 6).alias("value"))


QUERIES["vec_pairs"] = vec_pairs
SQL["vec_pairs"] = """
WITH c AS (SELECT user_id, event_type, count(*)::DOUBLE AS n FROM events GROUP BY ALL),
r AS (SELECT user_id, n / max(n) OVER (PARTITION BY user_id) AS value, row_number() OVER (PARTITION BY user_id ORDER BY n DESC) - 1 AS place FROM c)
SELECT user_id, place, round(value, 6) AS value FROM r WHERE place < 2"""
