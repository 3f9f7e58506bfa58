"""The scalar functions of search for SQL: temporary functions with SQL bodies, so that they run as built-in expressions."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "lexical_tokens": ("text STRING", "ARRAY<STRING>", r"regexp_extract_all(lower(text), r'([\p{L}\p{N}]+)', 1)"),
    "lexical_score": (
        "tok ARRAY<STRING>, term STRING, df INT, n BIGINT, avgdl DOUBLE",
        "DOUBLE",
        "ln(1 + (n - least(df, n) + 0.5D) / (least(df, n) + 0.5D)) * size(array_remove(transform(tok, t -> if(t = term, 1, 0)), 0)) * 2.2D / (size(array_remove(transform(tok, t -> if(t = term, 1, 0)), 0)) + 0.3D + 0.9D * size(array_compact(tok)) / avgdl)",
    ),
    "rrf_part": ("weight DOUBLE, k INT, place BIGINT", "DOUBLE", "coalesce(weight / (k + place), 0D)"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session's SQL; their names.

    lexical_tokens: the words of a text (`simple`). lexical_score: one term's share of BM25, to be summed over a query's
    terms. rrf_part: one leg's share of a fused score, 0 for a row that isn't in it."""
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
