"""Registered queries over text: analysis, statistics, BM25, fusion, chunking, templates, filters; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import chunking, templates
from fathomline.functions import text as X
from fathomline.operators import filters, lexical
from fathomline.operators.lineage import shared_folder
from fathomline.operators.search import HybridIndex, Spec, key_text
from fathomline.plans.queries_vectors import _read

QUERIES, SQL = {}, {}

_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


def lex_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _read(spark, sf_dir, "documents").select("doc_id", X.tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"), F.element_at("t", 1).alias("first"))


QUERIES["lex_tokens"] = lex_tokens
SQL["lex_tokens"] = f"SELECT doc_id, len(t)::BIGINT AS n, len(list_distinct(t))::BIGINT AS n_distinct, t[1] AS first FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)"


def lex_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.statistics(_read(spark, sf_dir, "documents"), "text").frequencies


QUERIES["lex_df"] = lex_df
SQL["lex_df"] = f"SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct({_TOKENS})) AS term FROM documents) GROUP BY term HAVING count(*) > 1"


def lex_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lexical.statistics(_read(spark, sf_dir, "documents"), "text")
    return spark.createDataFrame([(int(s.n), round(float(s.avgdl), 6))], "n bigint, avgdl double")


QUERIES["lex_stats"] = lex_stats
SQL["lex_stats"] = f"SELECT count(*) AS n, round(avg(len({_TOKENS})), 6) AS avgdl FROM documents WHERE text IS NOT NULL"


def lex_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lexical.postings(_read(spark, sf_dir, "documents"), "doc_id", "text")
    return p.select("term", F.col("key").alias("doc_id"), "tf", F.element_at("positions", 1).cast("bigint").alias("at"), F.element_at("positions", -1).cast("bigint").alias("last"))


QUERIES["lex_postings"] = lex_postings
SQL["lex_postings"] = f"""
WITH t AS (SELECT doc_id, {_TOKENS} AS t FROM documents), p AS (SELECT doc_id, unnest(t) AS term, unnest(range(1, len(t) + 1)) AS i FROM t)
SELECT term, doc_id, count(*) AS tf, min(i) AS at, max(i) AS last FROM p GROUP BY term, doc_id"""

_WORDS = {"bm25_single": ("eriner", ["eriner"], "list_contains(t, 'eriner')"), "bm25_and": ("attion thanedble the", ["attion", "thanedble", "the"], "list_contains(t, 'attion') AND list_contains(t, 'thanedble') AND list_contains(t, 'the')"), "bm25_or": ("aulich or idiot OR eriner", ["aulich", "eriner", "idiot"], "list_contains(t, 'aulich') OR list_contains(t, 'idiot') OR list_contains(t, 'eriner')"), "bm25_not": ("licensed -apache", ["licensed"], "list_contains(t, 'licensed') AND NOT list_contains(t, 'apache')"), "phrase_match": ('"nicht aulich für"', ["aulich", "für", "nicht"], "list_contains(list_transform(range(1, len(t) - 1), lambda i: t[i:i + 2]), ['nicht', 'aulich', 'für'])")}


def bm25_sql(terms: list[str], match: str, extra: str = "") -> str:
    """CTEs t, s, d, m ending in scored(doc_id, score) of the matching documents."""
    values = ", ".join(f"('{t}')" for t in terms)
    return f"""
t AS (SELECT doc_id, lang, source, {_TOKENS} AS t FROM documents),
s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM t),
w(term) AS (VALUES {values}),
d AS (SELECT term, greatest(1, count(*) FILTER (WHERE list_contains(t, term))) AS df FROM w, t GROUP BY term),
m AS (SELECT * FROM t WHERE ({match}) {extra}),
p AS (SELECT doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, len(list_filter(t, lambda x: x = term))::DOUBLE AS tf, len(t) / avgdl AS rel FROM m, d, s),
scored AS (SELECT doc_id, sum(idf * tf * 2.2 / (tf + 0.3 + 0.9 * rel)) AS score FROM p GROUP BY doc_id)"""


def _bm25(name: str, query: str, terms: list[str], match: str, where: dict | None = None, extra: str = "") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _read(spark, sf_dir, "documents")
        hits = lexical.scored(filters.filtered(docs, where), "text", query, lexical.statistics(docs, "text"))
        return hits.select("doc_id", F.round("score", 6).alias("score"))

    QUERIES[name] = run
    SQL[name] = f"WITH {bm25_sql(terms, match, extra)} SELECT doc_id, round(score, 6) AS score FROM scored"


for _name, (_q, _terms, _match) in _WORDS.items():
    _bm25(_name, _q, _terms, _match)
_bm25("bm25_filtered", "eriner the", ["eriner", "the"], "list_contains(t, 'eriner') AND list_contains(t, 'the')", {"lang": "en", "source": {"in": ["src1", "src2", "src3"]}}, "AND lang = 'en' AND source IN ('src1', 'src2', 'src3')")


def bm25_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as bm25_or from postings that are written first."""
    index = lexical.Index.build(_read(spark, sf_dir, "documents"), "doc_id", "text", shared_folder(spark, "bm25_index"))
    return index.scored(_WORDS["bm25_or"][0]).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


QUERIES["bm25_index"] = bm25_index
SQL["bm25_index"] = SQL["bm25_or"]


def cover_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return lexical.scored(docs, "text", "eriner", None).select("doc_id", F.round("score", 6).alias("score"))


QUERIES["cover_density"] = cover_density
SQL["cover_density"] = f"SELECT doc_id, round(0.1::DOUBLE * len(list_filter(t, lambda x: x = 'eriner')), 6) AS score FROM (SELECT doc_id, {_TOKENS} AS t FROM documents) WHERE list_contains(t, 'eriner')"


def _english(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.statistics(_read(spark, sf_dir, "documents"), "text", "english").frequencies


QUERIES["lex_english"] = _english


def _with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with the embedding whose vec_id is doc_id modulo the number of embeddings."""
    e = _read(spark, sf_dir, "embeddings")
    n = e.count()
    return _read(spark, sf_dir, "documents").withColumn("__v", F.col("doc_id") % n).join(e.select(F.col("vec_id").alias("__v"), "embedding"), "__v").drop("__v")


def _hybrid(name: str, weight: float, leg: str = "both", distance: str = "cosine") -> None:
    query, (_, terms, match) = "attion thanedble the", _WORDS["bm25_and"]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = HybridIndex(_with_vectors(spark, sf_dir), "doc_id", "text", "embedding", 64, distance).refreshed()
        vector = list(_read(spark, sf_dir, "embeddings").where("vec_id = 1").first().embedding)
        out = index._run(None, query, Spec(15), None) if leg == "fts" else index.search_with_vector(vector, query if leg == "both" else "", 15, weight)
        return out.select("pk_value", F.round("rrf_score", 8).alias("rrf_score"), "semantic_rank", "fts_rank", F.round("semantic_distance", 6).alias("semantic_distance"), F.round("fts_score", 6).alias("fts_score"))

    QUERIES[name] = run
    d = {"cosine": "list_cosine_distance", "l2": "list_distance"}[distance]
    wide = f"({weight}::FLOAT)::DOUBLE"
    fts = "SELECT doc_id::VARCHAR AS k, score, row_number() OVER (ORDER BY score DESC, doc_id::VARCHAR) AS rf FROM scored" + (" WHERE false" if leg == "semantic" else "")
    if leg == "fts":
        tail = f"f AS ({fts}) SELECT k AS pk_value, round(1.0 / (60 + rf), 8) AS rrf_score, NULL::BIGINT AS semantic_rank, rf AS fts_rank, NULL::DOUBLE AS semantic_distance, round(score, 6) AS fts_score FROM f WHERE rf <= 15"
    else:
        tail = f"""
n AS (SELECT count(*) AS n FROM embeddings),
x AS (SELECT d.doc_id, {d}(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS dist FROM documents d, n JOIN embeddings e ON e.vec_id = d.doc_id % n.n, embeddings q WHERE q.vec_id = 1),
l AS (SELECT doc_id::VARCHAR AS k, dist, row_number() OVER (ORDER BY dist, doc_id::VARCHAR) AS rs FROM x),
f AS ({fts}),
b AS (SELECT coalesce(l.k, f.k) AS k, rs, rf, dist, score, coalesce({wide} / (60 + rs), 0) + coalesce((1 - {wide}) / (60 + rf), 0) AS rrf
      FROM (SELECT * FROM l WHERE rs <= 60) l FULL OUTER JOIN (SELECT * FROM f WHERE rf <= 60) f ON l.k = f.k)
SELECT k AS pk_value, round(rrf, 8) AS rrf_score, rs AS semantic_rank, rf AS fts_rank, round(dist, 6) AS semantic_distance, round(score, 6) AS fts_score FROM b ORDER BY rrf DESC, k LIMIT 15"""
    SQL[name] = f"WITH {bm25_sql(terms, match)}, {tail}"


_hybrid("rrf_hybrid", 0.5)
_hybrid("rrf_weight0", 0.0)
_hybrid("rrf_weight1", 1.0)
_hybrid("rrf_weight03", 0.3, distance="l2")
_hybrid("rrf_fts_only", 0.5, "fts")
_hybrid("rrf_semantic_only", 0.5, "semantic")


def _line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as chunks, with the embedding of (doc_id * 7 + line) modulo the number of embeddings."""
    docs, e = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "embeddings")
    n = e.count()
    lines = docs.select(F.col("doc_id").alias("source_pk"), F.posexplode(F.split("text", "\n")).alias("chunk_seq", "chunk_text")).where("chunk_text != ''")
    lines = lines.withColumns({"chunk_id": F.col("source_pk") * 100_000 + F.col("chunk_seq"), "char_start": F.lit(0), "char_end": F.length("chunk_text"), "__v": (F.col("source_pk") * 7 + F.col("chunk_seq")) % n})
    return lines.join(e.select(F.col("vec_id").alias("__v"), "embedding"), "__v").drop("__v")


def chunk_best_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    index = HybridIndex(docs, "doc_id", "text", "embedding", 64, chunks=_line_chunks(spark, sf_dir)).refreshed()
    vector = list(_read(spark, sf_dir, "embeddings").where("vec_id = 5").first().embedding)
    out = index.search_with_vector(vector, "eriner", 12, filter={"lang": {"neq": "fr"}})
    return out.select("pk_value", F.round("rrf_score", 8).alias("rrf_score"), "semantic_rank", "fts_rank", F.col("chunk_seq").cast("bigint").alias("chunk_seq"), F.length("chunk_text").cast("bigint").alias("chars"))


QUERIES["chunk_best_per_doc"] = chunk_best_per_doc
SQL["chunk_best_per_doc"] = r"""
WITH n AS (SELECT count(*) AS n FROM embeddings),
c0 AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS seq FROM documents),
c AS (SELECT doc_id, lang, line, seq, doc_id * 100000 + seq AS cid, regexp_extract_all(lower(line), '[\p{L}\p{N}]+') AS t FROM c0 WHERE line != ''),
s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM c),
d AS (SELECT greatest(1, count(*)) AS df FROM c WHERE list_contains(t, 'eriner')),
pool AS (SELECT c.*, list_cosine_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS dist FROM c, n JOIN embeddings e ON e.vec_id = (c.doc_id * 7 + c.seq) % n.n, embeddings q WHERE q.vec_id = 5 AND lang != 'fr'),
l AS (SELECT cid, row_number() OVER (ORDER BY dist, cid::VARCHAR) AS rs FROM pool),
g AS (SELECT cid, ln(1 + (s.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 0.3 + 0.9 * len(t) / avgdl) AS score FROM (SELECT *, len(list_filter(t, lambda x: x = 'eriner'))::DOUBLE AS tf FROM pool) p, s, d WHERE list_contains(t, 'eriner')),
f AS (SELECT cid, row_number() OVER (ORDER BY score DESC, cid) AS rf FROM g),
b AS (SELECT coalesce(l.cid, f.cid) AS cid, rs, rf, coalesce(0.5 / (60 + rs), 0) + coalesce(0.5 / (60 + rf), 0) AS rrf FROM (SELECT * FROM l WHERE rs <= 200) l FULL OUTER JOIN (SELECT * FROM f WHERE rf <= 200) f ON l.cid = f.cid),
r AS (SELECT pool.doc_id, b.*, pool.seq, pool.line, row_number() OVER (PARTITION BY pool.doc_id ORDER BY rrf DESC, coalesce(rs, 9223372036854775807), coalesce(rf, 9223372036854775807), pool.seq, b.cid) AS k FROM b JOIN pool ON b.cid = pool.cid)
SELECT doc_id::VARCHAR AS pk_value, round(rrf, 8) AS rrf_score, rs AS semantic_rank, rf AS fts_rank, seq AS chunk_seq, length(line)::BIGINT AS chars FROM r WHERE k = 1 ORDER BY rrf DESC, doc_id::VARCHAR LIMIT 12"""


def chunk_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunked(_read(spark, sf_dir, "documents"), "doc_id", "text", 500, 50)[0]


QUERIES["chunk_split"] = chunk_split

_FORMAT = "Order $o_orderkey ($o_orderstatus) of ${c_name}: $$$o_totalprice $o_orderpriority"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "customer")
    priority = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority"))
    name = F.when(F.col("o_orderkey") % 5 != 0, F.col("c_name"))
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "o_orderstatus", priority.alias("o_orderpriority"), name.alias("c_name"), F.col("o_totalprice").cast("decimal(12,2)").alias("o_totalprice"))


_ORDERS_SQL = "o AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 != 0 THEN o_orderpriority END AS p, CASE WHEN o_orderkey % 5 != 0 THEN c_name END AS c, o_totalprice::DECIMAL(12,2) AS t FROM orders JOIN customer ON o_custkey = c_custkey)"
_TEXT_SQL = "'Order ' || o_orderkey || ' (' || o_orderstatus || ') of ' || c || ': $' || t || ' ' || coalesce(p, '')"


def template_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("o_orderkey", templates.rendered(_FORMAT, "c_name").alias("text"))


def template_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("o_orderkey", templates.rendered_bytes(_FORMAT, "c_name").alias("bytes"))


def template_null_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).where(templates.rendered(_FORMAT, "c_name").isNull()).select("o_orderkey")


def prompt_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "benchmark").select("item_id", templates.prompt("query: {{ text }} [{{text}}]", "text").alias("prompt"))


QUERIES |= {"template_render": template_render, "template_len": template_len, "template_null_anchor": template_null_anchor, "prompt_template": prompt_template}
SQL |= {
    "template_render": f"WITH {_ORDERS_SQL} SELECT o_orderkey, {_TEXT_SQL} AS text FROM o",
    "template_len": f"WITH {_ORDERS_SQL} SELECT o_orderkey, strlen({_TEXT_SQL})::BIGINT AS bytes FROM o",
    "template_null_anchor": f"WITH {_ORDERS_SQL} SELECT o_orderkey FROM o WHERE c IS NULL",
    "prompt_template": "SELECT item_id, 'query: ' || text || ' [' || text || ']' AS prompt FROM benchmark",
}

# Filters: name, table, key, filter, SQL condition.
_FILTERS = [
    ("filter_eq", "orders", "o_orderkey", {"o_orderstatus": "F", "o_custkey": 7}, "o_orderstatus = 'F' AND o_custkey = 7"),
    ("filter_neq_range", "orders", "o_orderkey", {"o_totalprice": {"gte": 1000.5, "lt": 60000, "neq": 5000}, "o_orderkey": {"gt": 10, "lte": 9000}}, "o_totalprice >= 1000.5 AND o_totalprice < 60000 AND o_totalprice != 5000 AND o_orderkey > 10 AND o_orderkey <= 9000"),
    ("filter_in", "customer", "c_custkey", {"c_mktsegment": ["BUILDING", "MACHINERY"], "c_nationkey": {"in": [1, 2, 3, 24]}}, "c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey IN (1, 2, 3, 24)"),
    ("filter_like", "orders", "o_orderkey", {"o_orderpriority": {"like": "%-%"}}, "o_orderpriority LIKE '%-%'"),
    ("filter_ilike", "customer", "c_custkey", {"c_mktsegment": {"ilike": "build%"}}, "c_mktsegment ILIKE 'build%'"),
    ("filter_ts", "orders", "o_orderkey", {"o_orderdate": {"gte": "1995-01-01", "lt": "1996-06-15 12:00:00"}}, "o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-06-15 12:00:00'"),
    ("filter_none", "nation", "n_nationkey", {}, "true"),
]


def _filter(name: str, table: str, key: str, spec: dict, where: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: filters.filtered(_read(spark, sf_dir, table), spec).select(key)
    SQL[name] = f"SELECT {key} FROM {table} WHERE {where}"


for _f in _FILTERS:
    _filter(*_f)


def _noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with a note on six of seven and a flag."""
    return _read(spark, sf_dir, "events").withColumns({"note": F.when(F.col("event_id") % 7 != 0, F.col("event_type")), "late": F.col("event_id") % 5 > 2})


def _noted_filter(name: str, spec: dict, where: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: filters.filtered(_noted(spark, sf_dir), spec).select("event_id")
    SQL[name] = f"SELECT event_id FROM events WHERE {where}"


_noted_filter("filter_null", {"note": None}, "event_id % 7 = 0")
_noted_filter("filter_not_null", {"note": {"is_not": None}, "user_id": {"gt": 20}}, "event_id % 7 != 0 AND user_id > 20")
_noted_filter("filter_bool", {"late": True, "note": {"neq": "click"}}, "event_id % 5 > 2 AND event_id % 7 != 0 AND event_type != 'click'")


def composite_chunked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns nearest to a vector, turns being documents with a key of two columns and one chunk each."""
    e = _read(spark, sf_dir, "embeddings")
    n = e.count()
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    chunks = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), key_text("conv_id", "turn").alias("source_pk"), F.lit(0).alias("chunk_seq"), F.lit(0).alias("char_start"), F.length("text").alias("char_end"), F.col("text").alias("chunk_text"), ((F.col("conv_id") * 31 + F.col("turn")) % n).alias("__v"))
    chunks = chunks.join(e.select(F.col("vec_id").alias("__v"), "embedding"), "__v").drop("__v")
    vector = list(e.where("vec_id = 3").first().embedding)
    out = HybridIndex(turns, ["conv_id", "turn"], "text", "embedding", 64, chunks=chunks).search_with_vector(vector, "", 15)
    return out.select("pk_value", F.round("rrf_score", 8).alias("rrf_score"), "semantic_rank", F.length("chunk_text").cast("bigint").alias("chars"))


QUERIES["composite_chunked_search"] = composite_chunked_search
SQL["composite_chunked_search"] = """
WITH n AS (SELECT count(*) AS n FROM embeddings),
c AS (SELECT conv_id * 1000 + turn AS cid, '(' || conv_id || ',' || turn || ')' AS pk, text, list_cosine_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS dist
      FROM conversations, n JOIN embeddings e ON e.vec_id = (conv_id * 31 + turn) % n.n, embeddings q WHERE q.vec_id = 3),
r AS (SELECT *, row_number() OVER (ORDER BY dist, cid::VARCHAR) AS rs FROM c)
SELECT pk AS pk_value, round(0.5 / (60 + rs), 8) AS rrf_score, rs AS semantic_rank, length(text)::BIGINT AS chars FROM r WHERE rs <= 15"""
