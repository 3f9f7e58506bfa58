"""Registered queries of maintenance, routing and status, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.functions import templates
from fathomline.operators import changes as C
from fathomline.plans import models as M
from fathomline.plans import status as S
from fathomline.plans.queries_vectors import _read
from fathomline.sources.embedders import MockConverter, MockEmbedder, converted, embedded

QUERIES, SQL = {}, {}


def budget_running_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("size"))
    return C.budget_prefix(docs, [F.col("doc_id")], F.col("size"), 300_000)


SQL["budget_running_sum"] = "SELECT doc_id, size FROM (SELECT doc_id, strlen(text)::BIGINT AS size, sum(strlen(text)) OVER (ORDER BY doc_id) AS s FROM documents) WHERE s <= 300000"


def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 10 != 0, F.octet_length("text")).cast("bigint").alias("size"))
    return C.admitted(docs, ["doc_id"], "size", C.Limits(batch_bytes=200_000, document_bytes=9_000))


SQL["admission"] = """
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 10 != 0 THEN strlen(text)::BIGINT END AS size FROM documents),
r AS (SELECT *, sum(CASE WHEN size <= 9000 THEN size ELSE 0 END) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS s FROM d)
SELECT doc_id, size, CASE WHEN size IS NULL THEN 'null' WHEN size > 9000 THEN 'too_large' WHEN s <= 200000 THEN 'admitted' ELSE 'deferred' END AS verdict FROM r"""


def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.keyset_page(_read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 700, 256)


SQL["keyset_page"] = "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 700 ORDER BY o_orderkey LIMIT 256"


def composite_paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after a row in the middle of an order: rows that share its first key column come next."""
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return C.keyset_page(rows, ["l_orderkey", "l_linenumber"], [100, 2], 300)


SQL["composite_paging"] = "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey, l_linenumber) > (100, 2) ORDER BY l_orderkey, l_linenumber LIMIT 300"


def staging_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.staged(_read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", ["9", 3, "x", 77, 5])


SQL["staging_scan"] = "WITH k(k, ord) AS (VALUES (9, 1::BIGINT), (3, 2), (77, 4), (5, 5)) SELECT c_custkey, c_name, ord FROM customer JOIN k ON c_custkey = k"


def _event_jobs(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").where(where)
    return e.select((F.col("event_id") % 3).alias("registry_id"), F.col("user_id").cast("string").alias("pk_value"), F.lit("embed").alias("op"), F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 5).alias("chunk_id"))


def coalesce_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.coalesced(_event_jobs(spark, sf_dir, "event_id % 7 = 0"), _event_jobs(spark, sf_dir, "event_id % 7 != 0")).select(*C.JOB_KEY)


_JOB_SQL = "SELECT event_id % 3 AS registry_id, user_id::VARCHAR AS pk_value, 'embed' AS op, CASE WHEN event_id % 2 = 0 THEN event_id % 5 END AS chunk_id FROM events WHERE "
SQL["coalesce_jobs"] = f"SELECT DISTINCT * FROM ({_JOB_SQL} event_id % 7 != 0) f WHERE NOT EXISTS (SELECT 1 FROM ({_JOB_SQL} event_id % 7 = 0) p WHERE p.registry_id = f.registry_id AND p.pk_value = f.pk_value AND p.op = f.op AND p.chunk_id IS NOT DISTINCT FROM f.chunk_id)"


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), (F.col("user_id") % 4).alias("registry_id"), F.col("user_id").cast("string").alias("pk_value"), F.when(F.col("event_type") == "click", "refresh").otherwise("embed").alias("op"), F.lit(None).cast("bigint").alias("chunk_id"), (F.col("event_id") % 8).cast("int").alias("attempts"), F.col("ts").cast("timestamp").alias("not_before"), F.when(F.col("event_id") % 6 == 0, F.col("ts").cast("timestamp")).alias("claimed_at"), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("e"), "event_id")).alias("last_error"), F.col("ts").cast("timestamp").alias("created_at"))


_QUEUE_SQL = "q AS (SELECT event_id AS id, user_id % 4 AS registry_id, user_id::VARCHAR AS pk_value, CASE WHEN event_type = 'click' THEN 'refresh' ELSE 'embed' END AS op, (event_id % 8)::INT AS attempts, ts AS not_before, CASE WHEN event_id % 6 = 0 THEN ts END AS claimed_at, CASE WHEN event_id % 4 = 0 THEN 'e' || event_id END AS last_error, ts AS created_at FROM events), now AS (SELECT max(ts) + INTERVAL 1 HOUR AS t FROM events)"


def _now(spark: SparkSession, sf_dir: str):
    return F.lit(_read(spark, sf_dir, "events").agg((F.max("ts").cast("timestamp") + F.expr("INTERVAL 1 HOUR"))).first()[0])


def claim_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.claim(_queue(spark, sf_dir), _now(spark, sf_dir), 64).select("id", "registry_id", "attempts")


SQL["claim_batch"] = f"WITH {_QUEUE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY registry_id ORDER BY not_before, id) AS n FROM q WHERE claimed_at IS NULL) SELECT id, registry_id, attempts + 1 AS attempts FROM r ORDER BY n, registry_id LIMIT 64"


def visibility_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue, dead = C.released(_queue(spark, sf_dir), _now(spark, sf_dir))
    return queue.select("id", F.col("claimed_at").isNull().alias("free"), F.lit(False).alias("dead")).unionByName(dead.select("id", F.lit(False).alias("free"), F.lit(True).alias("dead")))


SQL["visibility_timeout"] = f"WITH {_QUEUE_SQL}, s AS (SELECT *, claimed_at IS NOT NULL AND epoch_ms(t) - epoch_ms(claimed_at) > 300000 AS stale FROM q, now) SELECT id, NOT (stale AND attempts > 5) AND (stale OR claimed_at IS NULL) AS free, stale AND attempts > 5 AS dead FROM s"


def dead_letter_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _queue(spark, sf_dir)
    outcomes = jobs.select("id", F.when(F.col("id") % 5 == 0, "dead").when(F.col("id") % 5 == 1, "retry").when(F.col("id") % 5 == 2, "deferred").otherwise("ok").alias("status"), F.lit("because").alias("error"))
    queue, dead = C.settled(jobs, outcomes, _now(spark, sf_dir))
    return queue.select("id", "attempts", F.lit("queue").alias("place"), F.unix_millis("not_before").alias("due")).unionByName(dead.select("id", "attempts", F.lit("dead").alias("place"), F.unix_millis("not_before").alias("due")))


SQL["dead_letter_split"] = f"""
WITH {_QUEUE_SQL}, s AS (SELECT *, CASE id % 5 WHEN 0 THEN 'dead' WHEN 1 THEN CASE WHEN attempts > 5 THEN 'dead' ELSE 'retry' END WHEN 2 THEN 'deferred' ELSE 'ok' END AS o FROM q, now)
SELECT id, (CASE WHEN o = 'deferred' THEN greatest(attempts - 1, 0) ELSE attempts END)::INT AS attempts, CASE WHEN o = 'dead' THEN 'dead' ELSE 'queue' END AS place,
       CASE WHEN o = 'retry' THEN epoch_us(t) // 1000 + (5000 * power(2, least(attempts, 10)))::BIGINT ELSE epoch_us(not_before) // 1000 END AS due FROM s WHERE o != 'ok'"""


def distinct_on_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy(F.col("event_id").desc())
    return _read(spark, sf_dir, "events").withColumn("n", F.row_number().over(w)).where("n = 1").select("user_id", "event_type", "event_id")


SQL["distinct_on_latest"] = "SELECT DISTINCT ON (user_id, event_type) user_id, event_type, event_id FROM events ORDER BY user_id, event_type, event_id DESC"


def retry_dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    waits = "id % 3 = 0 and cast(pk_value as bigint) % 2 = 0"
    dead = _queue(spark, sf_dir).where(f"not ({waits})").withColumn("dead_id", F.col("id"))
    jobs, _ = C.retried(dead, _queue(spark, sf_dir).where(waits), None, _now(spark, sf_dir))
    return jobs.select("registry_id", "op", "pk_value", "dead_id", "attempts")


SQL["retry_dead"] = f"""
WITH {_QUEUE_SQL}, d AS (SELECT DISTINCT ON (registry_id, op, pk_value) * FROM q WHERE NOT (id % 3 = 0 AND pk_value::BIGINT % 2 = 0) ORDER BY registry_id, op, pk_value, id DESC)
SELECT registry_id, op, pk_value, id AS dead_id, 0 AS attempts FROM d WHERE NOT EXISTS (SELECT 1 FROM q p WHERE p.id % 3 = 0 AND p.pk_value::BIGINT % 2 = 0 AND p.registry_id = d.registry_id AND p.op = d.op AND p.pk_value = d.pk_value)"""


def backfill_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = _read(spark, sf_dir, "documents").select("doc_id"), _read(spark, sf_dir, "labels").select("doc_id")
    return docs.join(done, "doc_id", "left_anti")


SQL["backfill_gap"] = "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"


def exists_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").join(_read(spark, sf_dir, "orders").where("o_totalprice > 200000").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left_semi").select("c_custkey")


SQL["exists_semi"] = "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 200000)"


def cdc_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    old, new = o.where("o_orderkey % 11 != 0"), o.where("o_orderkey % 13 != 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))).withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderpriority")))
    return C.changed_rows(old, new, "o_orderkey", ["o_totalprice", "o_orderpriority"], "o_orderpriority")


SQL["cdc_diff"] = """
WITH a AS (SELECT * FROM orders WHERE o_orderkey % 11 != 0),
b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS t, CASE WHEN o_orderkey % 17 != 0 THEN o_orderpriority END AS p FROM orders WHERE o_orderkey % 13 != 0)
SELECT * FROM (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL AND p IS NOT NULL THEN 'insert' WHEN b.o_orderkey IS NULL THEN 'delete' WHEN a.o_orderkey IS NOT NULL AND (a.o_totalprice, a.o_orderpriority) IS DISTINCT FROM (t, p) THEN 'update' END AS change FROM a FULL OUTER JOIN b ON a.o_orderkey = b.o_orderkey) WHERE change IS NOT NULL"""


def write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 3 != 0, F.array(F.col("vec_id").cast("float"))).alias("vector_column"))
    fresh = e.where("vec_id % 2 = 0").select("vec_id", F.array(F.lit(-1.0).cast("float")).alias("vector"), (F.col("vec_id") % 10 == 0).alias("cleared"))
    return C.written_back(e, "vec_id", "vector_column", fresh).select("vec_id", F.element_at("vector_column", 1).cast("double").alias("x"))


SQL["write_back"] = "SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN NULL WHEN vec_id % 2 = 0 THEN -1.0 WHEN vec_id % 3 != 0 THEN vec_id END::DOUBLE AS x FROM embeddings"


def fresh_beats_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 3 != 0, F.array(F.col("vec_id").cast("float"))).alias("vector_new"))
    made = e.select("vec_id", F.array(F.lit(-1.0).cast("float")).alias("vector"), F.lit(False).alias("cleared"))
    return C.written_back(e, "vec_id", "vector_new", made, only_missing=True).select("vec_id", F.element_at("vector_new", 1).cast("double").alias("x"))


SQL["fresh_beats_converted"] = "SELECT vec_id, (CASE WHEN vec_id % 3 != 0 THEN vec_id ELSE -1 END)::DOUBLE AS x FROM embeddings"


def allocate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_ids(_read(spark, sf_dir, "nation").select("n_name"), "id", 1000, ["n_name"])


SQL["allocate_ids"] = "SELECT n_name, 1000 + row_number() OVER (ORDER BY n_name) AS id FROM nation"


def child_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _read(spark, sf_dir, "documents").where("doc_id % 3 != 0").select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 20).alias("source_pk"), F.when(F.col("doc_id") % 9 != 0, F.col("text")).alias("chunk_text"))
    jobs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 7 != 0, F.col("doc_id")).alias("chunk_id"), F.when(F.col("doc_id") % 4 == 0, "3").otherwise((F.col("doc_id") % 20).cast("string")).alias("pk_value"))
    return C.child_verdicts(jobs, chunks).select("id", "verdict")


SQL["child_matrix"] = "SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'dead' WHEN doc_id % 3 = 0 THEN 'obsolete' WHEN doc_id % 4 = 0 AND doc_id % 20 != 3 THEN 'dead' WHEN doc_id % 9 = 0 THEN 'empty' ELSE 'live' END AS verdict FROM documents"


def rechunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source_pk"), F.col("turn").alias("chunk_seq"))
    changed = chunks.where("source_pk % 3 = 0").select("source_pk")
    return C.rechunked(chunks, changed, changed.distinct().select("source_pk", F.lit(0).cast("bigint").alias("chunk_seq")))


SQL["rechunk"] = "SELECT conv_id AS source_pk, turn AS chunk_seq FROM conversations WHERE conv_id % 3 != 0 UNION ALL SELECT DISTINCT conv_id, 0 FROM conversations WHERE conv_id % 3 = 0"


def uncastable_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.uncastable(_read(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey").cast("string")).otherwise(F.concat(F.lit("k"), "p_partkey")).alias("pk_value")), "bigint")


SQL["uncastable_keys"] = "SELECT 'k' || p_partkey AS pk_value FROM part WHERE p_partkey % 2 != 0"


def embed_mock(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, None).when(F.col("doc_id") % 10 == 1, F.concat(F.lit("poison "), "text")).otherwise(F.regexp_replace("text", "poison|nan|short|later", "x")).alias("text"))
    out = embedded(texts, "text", MockEmbedder(3))
    return out.select("doc_id", "status", F.round(F.element_at("vector", 1).cast("double"), 3).alias("x"))


SQL["embed_mock"] = "SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 'empty' WHEN 1 THEN 'dead' ELSE 'ok' END AS status, CASE WHEN doc_id % 10 > 1 THEN strlen(regexp_replace(text, 'poison|nan|short|later', 'x', 'g'))::DOUBLE END AS x FROM documents"


def convert_mock(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return converted(e, "embedding", MockConverter(64, 4)).select("vec_id", "status", F.round(F.element_at("vector", 4).cast("double"), 4).alias("x"))


SQL["convert_mock"] = "SELECT vec_id, 'ok' AS status, round((list_sum(embedding::DOUBLE[]) + 0.03)::FLOAT::DOUBLE, 4) AS x FROM embeddings"


def composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathomline.operators.search import key_text

    return _read(spark, sf_dir, "conversations").withColumn("name", F.concat(F.lit('a "b" '), "role")).select("conv_id", "turn", key_text("conv_id", "turn", "name").alias("pk_value"))


SQL["composite_key"] = """SELECT conv_id, turn, '(' || conv_id || ',' || turn || ',"a ""b"" ' || role || '")' AS pk_value FROM conversations"""


def composite_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("k")).orderBy("k")
    return o


SQL["composite_order"] = "SELECT l_orderkey || '-' || l_linenumber AS k FROM lineitem ORDER BY k"


_MODELS = [("local-a", "embed", None, "s1", None, 64, 512, "{}"), ("api-b", "embed", None, "s1", None, 64, 8192, '{"extra":{"provider":"openai"}}'), ("api-c", "embed", None, "s1", None, 64, 8192, '{"extra":{"provider":"cohere","priority":50,"priority_explicit":true}}'), ("api-d", "embed", None, "s2", None, 32, None, '{"extra":{"provider":"x","priority":"7"}}'), ("api-e", "embed", None, "s2", None, 32, None, '{"extra":{"provider":"x","priority":70000}}'), ("solo", "embed", None, None, None, 8, None, "{}"), ("c-1", "convert", "s1", "s3", 64, 16, None, "{}"), ("c-0", "convert", "s9", "s3", 64, 16, None, "{}"), ("c-2", "convert", "s1", "s2", 64, 32, None, '{"extra":{"provider":"x"}}'), ("c-3", "convert", "s1", "s2", 64, 32, None, "{}")]


def _models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*m, None) for m in _MODELS], M.MODELS)


def routes_preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.routes(_models(spark)).select("space", "route", "execution", "dim", "priority", "explicit", "preferred")


SQL["routes_preferred"] = "SELECT * FROM (VALUES ('s1', 'local-a', 'local', 64, 100, false, false), ('s1', 'api-b', 'provider openai', 64, 200, false, false), ('s1', 'api-c', 'provider cohere', 64, 50, true, true), ('s2', 'api-d', 'provider x', 32, 200, false, true), ('s2', 'api-e', 'provider x', 32, 200, false, false), ('solo', 'solo', 'local', 8, 100, false, true)) t(space, route, execution, dim, priority, explicit, preferred)"


def route_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = M.routes(_models(spark))
    cases = [("api-b", None), ("s1", None), ("gone", "s2"), ("solo", "s1")]
    out = None
    for model, space in cases:
        one = M.resolve_route(r, model, space).select(F.lit(model).alias("model"), "route")
        out = one if out is None else out.unionByName(one)
    return out


SQL["route_resolve"] = "SELECT * FROM (VALUES ('api-b', 'api-b'), ('s1', 'api-c'), ('gone', 'api-d'), ('solo', 'solo')) t(model, route)"


def bridge_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    ways = [(m, w.kind, w.route, w.via) for m in ("s3", "s2") if (w := M.resolve_embedding(_models(spark), m))]
    return spark.createDataFrame(ways, "model string, kind string, route string, via string")


SQL["bridge_resolve"] = "SELECT * FROM (VALUES ('s3', 'bridge', 'c-1', 'api-c'), ('s2', 'direct', 'api-d', NULL)) t(model, kind, route, via)"


def convert_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [("s1", "s2"), ("s1", "s3"), ("s3", "s1")]
    return spark.createDataFrame([(a, b, M.resolve_conversion(_models(spark), a, b)) for a, b in pairs], "source string, target string, route string")


SQL["convert_resolve"] = "SELECT * FROM (VALUES ('s1', 's2', 'c-3'), ('s1', 's3', 'c-1'), ('s3', 's1', NULL)) t(source, target, route)"


def effective_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("a", None, None, 1, "f"), ("b", "p", None, 3, "f"), ("c", "p", None, 2, "f"), ("d", "p", 7, 1, "f"), ("e", "p", None, 3, "e")]
    return M.effective_priorities(spark.createDataFrame(rows, "name string, provider string, explicit_priority int, added int, file string"))


SQL["effective_priorities"] = "SELECT * FROM (VALUES ('a', 100), ('b', 203), ('c', 201), ('d', 7), ('e', 202)) t(name, priority)"


def model_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _models(spark)
    fresh = old.where("name != 'solo'").withColumn("target_dim", F.when(F.col("name") == "c-1", 17).otherwise(F.col("target_dim")))
    return M.upserted(old, fresh, complete=True).select("name", "target_dim", "changed")


SQL["model_upsert"] = "SELECT * FROM (VALUES " + ", ".join(f"('{m[0]}', {17 if m[0] == 'c-1' else m[5]}, {'true' if m[0] == 'c-1' else 'false'})" for m in _MODELS if m[0] != "solo") + ") t(name, target_dim, changed)"


def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _queue(spark, sf_dir)
    return S.backlog(q.where("id % 5 != 0"), q.where("id % 5 = 0"), _now(spark, sf_dir))


SQL["status_rollup"] = f"""
WITH {_QUEUE_SQL}, p AS (SELECT registry_id, count(*) AS pending, count(*) FILTER (WHERE op = 'refresh') AS pending_refresh, count(*) FILTER (WHERE op = 'embed') AS pending_embed, min(created_at) AS oldest, arg_max(last_error, (not_before, id)) FILTER (WHERE last_error IS NOT NULL) AS last_error FROM q WHERE id % 5 != 0 GROUP BY registry_id),
d AS (SELECT registry_id, count(*) AS dead FROM q WHERE id % 5 = 0 GROUP BY registry_id)
SELECT registry_id, coalesce(pending, 0)::BIGINT AS pending, coalesce(pending_refresh, 0)::BIGINT AS pending_refresh, coalesce(pending_embed, 0)::BIGINT AS pending_embed, coalesce(dead, 0)::BIGINT AS dead, (floor(epoch(t)) - floor(epoch(oldest)))::DOUBLE AS oldest_seconds, last_error FROM p FULL OUTER JOIN d USING (registry_id), now"""


def migration_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("rows_total"), F.count_if(F.col("event_id") % 3 == 0).alias("rows_done"), F.count_if(F.col("event_id") % 3 == 1).alias("rows_skipped"))
    return S.progress(m)


SQL["migration_progress"] = "WITH m AS (SELECT event_type, count(*) AS rows_total, count(*) FILTER (WHERE event_id % 3 = 0) AS rows_done, count(*) FILTER (WHERE event_id % 3 = 1) AS rows_skipped FROM events GROUP BY event_type) SELECT *, least(100.0, round(100.0::DOUBLE * (rows_done + rows_skipped) / rows_total, 1)) AS percent FROM m"


def ordered_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _read(spark, sf_dir, "nation")
    return n.groupBy("n_regionkey").agg(F.array_sort(F.collect_set("n_name")).alias("names"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: s["n_name"]), ",").alias("listed"))


SQL["ordered_aggregates"] = "SELECT n_regionkey, list_sort(list(DISTINCT n_name)) AS names, string_agg(n_name, ',' ORDER BY n_nationkey) AS listed FROM nation GROUP BY n_regionkey"


def null_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("p"))
    first = o.orderBy(F.col("p").asc_nulls_first(), "o_orderkey").limit(30).select("o_orderkey", F.lit("first").alias("end"))
    return first.unionByName(o.orderBy(F.col("p").desc_nulls_last(), "o_orderkey").limit(30).select("o_orderkey", F.lit("last").alias("end")))


SQL["null_order"] = "WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 != 0 THEN o_totalprice END AS p FROM orders) (SELECT o_orderkey, 'first' AS \"end\" FROM o ORDER BY p ASC NULLS FIRST, o_orderkey LIMIT 30) UNION ALL (SELECT o_orderkey, 'last' FROM o ORDER BY p DESC NULLS LAST, o_orderkey LIMIT 30)"


def bounded_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    return spark.createDataFrame([(e.where("user_id = 3").limit(5).count(), e.limit(1000).count())], "few long, many long")


SQL["bounded_count"] = "SELECT (SELECT count(*) FROM (SELECT 1 FROM events WHERE user_id = 3 LIMIT 5)) AS few, (SELECT count(*) FROM (SELECT 1 FROM events LIMIT 1000)) AS many"


def lateral_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("best"))
    c = _read(spark, sf_dir, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "best")


SQL["lateral_top"] = "SELECT c_custkey, best FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS best FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey"


def partition_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recursive walk of a partition tree with its modification counts, in SQL."""
    spark.createDataFrame([(1, None, 5), (2, 1, 7), (3, 1, 11), (4, 3, 13), (9, None, 100)], "oid int, parent int, mods bigint").createOrReplaceTempView("fathomline_tree")
    return spark.sql("WITH RECURSIVE t(oid, mods) AS (SELECT oid, mods FROM fathomline_tree WHERE oid = 1 UNION ALL SELECT c.oid, c.mods FROM fathomline_tree c JOIN t ON c.parent = t.oid) SELECT sum(mods) AS mods FROM t")


SQL["partition_tree"] = "SELECT 36::BIGINT AS mods"


def embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole write path on a table: template, lengths, embedding."""
    c = _read(spark, sf_dir, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")))
    out = embedded(c.select("c_custkey", templates.rendered("$c_name: $c_mktsegment", "c_mktsegment").alias("text")), "text", MockEmbedder(2))
    return out.select("c_custkey", "status", F.element_at("vector", 1).cast("double").alias("x"))


SQL["embed_text"] = "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'empty' ELSE 'ok' END AS status, CASE WHEN c_custkey % 4 != 0 THEN strlen(c_name || ': ' || c_mktsegment)::DOUBLE END AS x FROM customer"

for _f in [budget_running_sum, admission, keyset_page, composite_paging, staging_scan, coalesce_jobs, claim_batch, visibility_timeout, dead_letter_split, distinct_on_latest, retry_dead, backfill_gap, exists_semi, cdc_diff, write_back, fresh_beats_converted, allocate_ids, child_matrix, rechunk, uncastable_keys, embed_mock, convert_mock, composite_key, composite_order, routes_preferred, route_resolve, bridge_resolve, convert_resolve, effective_priorities, model_upsert, status_rollup, migration_progress, ordered_aggregates, null_order, bounded_count, lateral_top, partition_tree, embed_text]:
    QUERIES[_f.__name__] = _f
