"""The registered queries of the corpus operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import difference_cover, html_crf, language_mixture, mpeg_ts, packing, rule_ensemble, simhash, spaced_seeds, suffix_array, url_rules
from fathomline.llm.common import crc32_mod, table


TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_mpeg_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mpeg_ts.transport_streams(table(spark, sf_dir, "documents"), "doc_id", "text", media=False)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "stream_pid", "stream_type", "pts", "unit_bytes", "random_access", "continuity_errors")


def quality_model(docs: DataFrame, labels: DataFrame) -> rule_ensemble.Ensemble:
    """Fitted on labels whose crc32(doc_id) modulo 3 is not 1."""
    return rule_ensemble.train(docs, labels.where(crc32_mod("doc_id", 3) != 1))


def op2_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = rule_ensemble.scored(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(crc32_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op4_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seeds.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text", TOKENIZER)


def op6_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_mixture.train(docs.where(crc32_mod("doc_id", 4) != 2))
    out = language_mixture.identified(docs, model)
    return out.select("doc_id", F.coalesce(crc32_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "languages", "proportions")


def op7_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = difference_cover.repeated_passages(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select("doc_id", F.col("n").alias("n_words"), "n_removed", "kept_sha256")


def op8_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extracted(table(spark, sf_dir, "pages"))


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_array.repeated_strings(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select("doc_id", F.col("n").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mpeg_ts": op1_mpeg_ts,
    "op2_rule_ensemble": op2_rule_ensemble,
    "op3_simhash": op3_simhash,
    "op4_spaced_seeds": op4_spaced_seeds,
    "op5_packing": op5_packing,
    "op6_language_mixture": op6_language_mixture,
    "op7_difference_cover": op7_difference_cover,
    "op8_html_crf": op8_html_crf,
    "op9_url_rules": op9_url_rules,
    "op10_suffix_array": op10_suffix_array,
}

SQL: dict[str, str] = {
    "op9_url_rules": r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
k AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rhost, rpath, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
b AS (SELECT page_id, arg_max(rhost || rpath, length(rhost) * 10000 + length(rpath)) AS rule, arg_max(verdict, length(rhost) * 10000 + length(rpath)) AS verdict
      FROM k JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM k LEFT JOIN b USING (page_id)""",
}
